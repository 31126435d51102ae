"""Quality rules: an isolation forest on rule statistics.

Statistics of every document's whole text feed a set of base rules and the features of an isolation
forest. Trees split random features at random values of small subsamples, so documents that few
random splits set apart are anomalous. A subsample shows what good documents are like: labelled good
ones, with ``RARE`` low-quality ones among them, so that splits also fall beyond the range of the good.
(Drawn as they come, low-quality documents of one kind are a dense cluster and no anomaly.) The forest
is fitted on a bounded sample of labelled documents (``SAMPLE`` rows of each label, those of smallest
hash); the score from which a document is rejected is calibrated on all labelled documents: the one that
sets low quality best apart from good quality while at most ``GOOD_LOST`` of the good ones fall.

Defined edge cases
  * null, empty or blank text: all counts 0, so the base rule of length fails
  * a document labelled twice counts with its lower quality; null labels and null ids count for nothing
  * no labelled document passes the base rules, or no good or no low-quality one does: no score is rejected
  * repeated rows get equal verdicts; an empty table gives an empty result; extra columns are carried
    by ``filter_documents`` and not read otherwise
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import cut, small_batches
from pulsefeat.llm.wordblocks import INK, as_bytes, chunks, mix, shingles, words

SAMPLE = 4096
TREES, SUBSAMPLE, RARE, DEPTH = 256, 256, 2, 8
GOOD_LOST = 0.005
TRACE = 3e-4  # a share that counts as hardly any
SCORE_STEPS = 2000
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

KINDS = np.zeros((5, 256), dtype=bool)
KINDS[0] = INK & ((np.arange(256) & 0xC0) != 0x80)  # first bytes of code points in words
KINDS[1, list(SYMBOLS)] = True
KINDS[2, 0x41:0x5B] = True  # capitals
KINDS[3, 0x30:0x3A] = True  # digits
KINDS[4, [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True  # ASCII marks
COUNTS = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_digits", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(w) -> np.ndarray:
    """Per text, the words that lie in a three-word window found twice or more in the text."""
    per_text = np.zeros(len(w.text_at), dtype=np.int64)
    h, whole = shingles(w, 3)
    at = np.flatnonzero(whole)
    if len(at):
        key = mix(h[at] ^ mix(w.text[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(w.hash), dtype=bool)
        for i in range(3):
            covered[at[twice] + i] = True
        per_text += np.bincount(w.text[covered], minlength=len(per_text))
    return per_text


def lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    own = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(own), len(own) - len(set(own))


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    for lo, hi in chunks([len(t) for t in texts]):
        w = words(texts[lo:hi], fold_case=False)
        out[lo:hi, 0] = np.diff(w.first)
        for i, kind in enumerate(KINDS):
            of_kind = np.flatnonzero(kind[w.buffer])
            out[lo:hi, 1 + i] = np.diff(np.searchsorted(of_kind, np.append(w.text_at, len(w.buffer) + 1)))
        out[lo:hi, 6:8] = [lines(t) for t in texts[lo:hi]]
        out[lo:hi, 8] = repeated_words(w)
    return out


def with_counts(docs: DataFrame, carry: list[str], forest: Forest | None = None) -> DataFrame:
    """``row`` (a struct of the columns in ``carry``), the COUNTS of the text and, of a given forest, the
    ``score``, made in the same worker."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").alias("text"))
    row_type = packed.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            table = counts(as_bytes(batch.column("text")))
            score = np.zeros(len(table)) if forest is None else forest.rounded(features(pd.DataFrame(table, columns=COUNTS)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(table[:, i]) for i in range(len(COUNTS))], pa.array(score)], names=["row", *COUNTS, "score"])

    return packed.mapInArrow(run, f"row {row_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(table: pd.DataFrame) -> np.ndarray:
    """The forest's features: shares, so that length alone is no anomaly, and their logarithms where most
    documents have next to none, so that a random split falls between none and some."""
    count = {c: table[c].to_numpy(float) for c in COUNTS}
    n, letters, rows = (np.maximum(count[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    few = [count["n_symbols"] / n, count["n_marks"] / n, count["n_digits"] / letters, count["n_dup_lines"] / rows, count["n_repeat_words"] / n]
    return np.column_stack([*np.log(np.array(few) + TRACE), count["word_chars"] / n, count["n_capitals"] / letters])


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among n points, the forest's unit of path length."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as complete binary heaps: the feature and value of each split, the path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    subsample: int

    @classmethod
    def fit(cls, x: np.ndarray, rare: np.ndarray | None = None, seed: int = 42) -> Forest:
        """Trees over subsamples of ``x``; RARE rows of each, or fewer, come from ``rare``."""
        few = min(RARE, len(rare)) if rare is not None else 0
        rng = np.random.default_rng(seed)
        nodes = 2 ** (DEPTH + 1) - 1
        feature = np.zeros((TREES, nodes), dtype=np.int32)
        value = np.full((TREES, nodes), np.inf)
        length = np.zeros((TREES, nodes))
        size = min(SUBSAMPLE - few, len(x))
        for t in range(TREES):
            drawn = x[rng.choice(len(x), size, replace=False)]
            if few:
                drawn = np.concatenate([drawn, rare[rng.choice(len(rare), few, replace=False)]])
            todo = [(0, 0, drawn)]
            while todo:
                node, depth, part = todo.pop()
                spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
                if depth == DEPTH or len(spread) == 0:
                    # A leaf above the last level goes on to the left, down to a node of its own.
                    path = depth + float(expected_path(len(part)))
                    for _ in range(depth, DEPTH):
                        node = 2 * node + 1
                    length[t, node] = path
                    continue
                f = int(rng.choice(spread))
                cut_at = rng.uniform(part[:, f].min(), part[:, f].max())
                feature[t, node], value[t, node] = f, cut_at
                right = part[:, f] > cut_at
                todo += [(2 * node + 1, depth + 1, part[~right]), (2 * node + 2, depth + 1, part[right])]
        return cls(feature, value, length, size + few)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(float(expected_path(self.subsample)), 1e-9))


    def rounded(self, x: np.ndarray) -> np.ndarray:
        """Scores without the last digits, in which summation may differ."""
        return np.round(self.score(x), 9) if len(x) else np.zeros(0)


@dataclass
class Rules:
    """A fitted forest with the score from which documents are rejected."""

    forest: Forest | None
    threshold: float

    def score(self) -> Column:
        if self.forest is None:
            return F.lit(0.0)
        forest = self.forest

        @F.pandas_udf("double")
        def anomaly(*columns: pd.Series) -> pd.Series:
            return pd.Series(forest.rounded(features(pd.DataFrame(dict(zip(COUNTS, columns))))))

        return anomaly(*[F.col(c) for c in COUNTS])


def fit(counted: DataFrame, labels: DataFrame) -> Rules:
    """``counted``: ``doc_id`` and COUNTS of documents; ``labels``: ``doc_id, quality``."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    labelled = counted.where(~base_failed()).join(graded, F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", *COUNTS)
    labelled = cut(labelled, "labelled")
    order = [F.xxhash64(F.lit(1), "doc_id"), "doc_id", *COUNTS]
    good, rare = (labelled.where(of).orderBy(*order).limit(SAMPLE).toPandas() for of in (F.col("quality") >= 1, F.col("quality") < 1))
    if len(good) < 2 or not len(rare):
        return Rules(None, float("inf"))
    rules = Rules(Forest.fit(features(good), features(rare)), float("inf"))
    step = F.floor(rules.score() * SCORE_STEPS).cast("int")
    graded_scores = labelled.select("quality", step.alias("step")).groupBy("step").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count_if(F.col("quality") < 1).alias("low"))
    table = graded_scores.toPandas().sort_values("step", ascending=False)  # SCORE_STEPS + 1 rows at most
    good, low = table["good"].cumsum().to_numpy(), table["low"].cumsum().to_numpy()
    lost, caught = good / max(good[-1], 1), low / low[-1]
    gain = np.where(lost <= GOOD_LOST, caught - lost, -1.0)
    best = int(gain.argmax())
    if gain[best] > 0:
        rules.threshold = float(table["step"].iloc[best]) / SCORE_STEPS
    return rules


def judge(scored: DataFrame, rules: Rules) -> DataFrame:
    """``scored`` with ``base_failed`` and ``kept``."""
    failed = scored.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") * SCORE_STEPS) < F.lit(rules.threshold * SCORE_STEPS)))


def document_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id``, COUNTS, ``base_failed``, ``score`` and ``kept``."""
    counted = cut(with_counts(docs, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), *COUNTS), "counts")
    rules = fit(counted, labels)
    return judge(counted.withColumn("score", rules.score()), rules)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass base rules and forest. Texts are read twice, never shuffled."""
    counted = with_counts(docs, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), *COUNTS)
    rules = fit(counted, labels)
    return judge(with_counts(docs, docs.columns, rules.forest), rules).where("kept").select("row.*")
