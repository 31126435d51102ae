"""Language identification as inference of a mixture of languages.

Model. Every learning document's character trigrams (letters in lower case, one gap for any run of other
characters) are counted per language, hashed into a fixed number of cells. A task counts all its texts
into one table per language and hands on its cells; Spark adds them up per (language, cell), so a language
of most rows is no hot key. A cell's likelihood mixes the language's share with BACKGROUND of the share in
all languages, so that grams a language never showed count alike for all.

Inference. A document is a mixture of languages: expectation-maximisation over its distinct cells finds
the proportions that make its grams likeliest, with PRIOR pseudo-grams per language, so that few letters
give no certainty. The language set is chosen by penalised likelihood: of the best single language, the
likeliest two, three and so on, re-estimated, the set of least -2 log L + (size - 1) log(grams), sets
growing only while that falls. The prediction is the set's language of the highest proportion.

The model is a table of languages x cells of at most MODEL_BYTES, in fewer cells where languages are
many, and goes to the tasks as a broadcast variable.

Defined edge cases
  * null texts and texts without a letter: ``und``, score 0, no languages; they teach nothing
  * a null doc_id is not held out, and teaches nothing; a null lang teaches nothing
  * no learning document with a letter: ``und`` and score 0 for all
  * equal proportions or likelihoods: the language that is first in order of code points
  * repeated rows are rows; very long texts are read whole, in segments; empty tables give empty results
  * columns other than those named are neither read nor returned
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import cut, small_batches
from pulsefeat.llm.wordblocks import BLOCK_BYTES, ROLES, chunks, mix

MODEL_BYTES = 64 << 20
MOST_CELLS, LEAST_CELLS = 1 << 16, 1 << 12
BACKGROUND = 0.05
PRIOR = 1.0
ROUNDS, STILL = 40, 1e-3
SEGMENT = 1 << 20  # characters
UNDETERMINED = "und"
GAP = 0


def cells_for(languages: int) -> int:
    """Cells of a model that stays within MODEL_BYTES."""
    cells = MOST_CELLS
    while cells > LEAST_CELLS and cells * languages * 4 > MODEL_BYTES:
        cells //= 2
    if cells * languages * 4 > MODEL_BYTES:
        raise ValueError(f"{languages} languages are more than a model of {MODEL_BYTES} bytes holds")
    return cells


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-case letters, with one GAP for each run of others, and around them."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    padded = np.concatenate([[GAP], np.where(is_letter, codes, GAP), [GAP]]).astype(np.uint64)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != GAP) | (padded[:-1] != GAP)
    return padded[keep]


def gram_cells(text: str, cells: int) -> Iterator[np.ndarray]:
    """Cells of all trigrams that have a letter in the middle, a segment of the text at a time."""
    held = ""
    for at in range(0, max(len(text), 1), SEGMENT):
        part = held + text[at : at + SEGMENT]
        last = at + SEGMENT >= len(text)
        if not last:
            # A segment ends at its last gap; a word of over 1,000 letters there is cut where it is.
            tail = next((i for i in range(len(part) - 1, max(len(part) - 1000, 0), -1) if not part[i].isalpha()), len(part) - 1)
            part, held = part[: tail + 1], part[tail + 1 :]
        c = letter_runs(part)
        if len(c) >= 3:
            middle = c[1:-1] != GAP
            h = mix(c[:-2] * ROLES[20] + c[1:-1] * ROLES[21] + c[2:] * ROLES[22])[middle]
            yield (h & np.uint64(cells - 1)).astype(np.int64)


def cell_counts(text: str, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a text and how many grams each has."""
    parts = list(gram_cells(text, cells)) if len(text) <= SEGMENT else None
    if parts is not None:
        return np.unique(parts[0], return_counts=True) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    total = np.zeros(cells, dtype=np.int64)
    for part in gram_cells(text, cells):
        total += np.bincount(part, minlength=cells)
    some = np.flatnonzero(total)
    return some, total[some]


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # (cells, languages): natural logarithms of the likelihoods

    @property
    def cells(self) -> int:
        return len(self.logs)


def learn(labelled: DataFrame) -> Model | None:
    """The model of a table ``text, lang`` of learning rows; None if nothing can be learned from it."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MODEL_BYTES // (4 * LEAST_CELLS) + 1).collect())  # languages, not documents
    if not names:
        return None
    cells, number = cells_for(len(names)), {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), cells), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                for part in gram_cells(text.as_py(), cells):
                    total[number[lang]] += np.bincount(part, minlength=cells)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[lang, cell])], names=["lang", "cell", "n"])

    counted = cut(rows.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "grams")
    counts = np.zeros((cells, len(names)))
    table = counted.toArrow()  # at most languages x cells rows, whatever the corpus
    counts[table.column("cell").to_numpy(), table.column("lang").to_numpy()] = table.column("n").to_numpy()
    taught = np.flatnonzero(counts.sum(axis=0))
    if not len(taught):
        return None
    counts = counts[:, taught]
    background = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum() + cells)
    likelihood = (1 - BACKGROUND) * counts / counts.sum(axis=0) + BACKGROUND * background
    return Model(tuple(names[i] for i in taught), np.log(likelihood).astype(np.float32))


def proportions(likelihood: np.ndarray, n: np.ndarray, first: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many documents at a time. ``likelihood``: a row per distinct cell of a
    document and a column per language, scaled to at most 1; ``first``: where each document begins. Returns
    proportions per document and its log likelihood under them (less the scale)."""
    sizes = np.diff(np.append(first, len(n)))
    total = np.add.reduceat(n, first)
    k = likelihood.shape[1]
    share = np.full((len(first), k), 1 / k, dtype=np.float32)
    open_ = np.arange(len(first))
    rows, at, held = np.arange(len(n)), first, sizes
    for _ in range(ROUNDS):
        part = likelihood[rows] if len(open_) < len(first) else likelihood
        part = part * np.repeat(share[open_], held, axis=0)
        part *= (n[rows] / part.sum(axis=1))[:, None]
        new = (np.add.reduceat(part, at, axis=0) + prior) / (total[open_] + k * prior)[:, None]
        moving = np.abs(new - share[open_]).max(axis=1) > STILL
        share[open_] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            rows, open_, held = rows[np.repeat(moving, held)], open_[moving], held[moving]
            at = np.cumsum(held) - held
    logs = np.log((likelihood * np.repeat(share, sizes, axis=0)).sum(axis=1)) * n
    return share, np.add.reduceat(logs.astype(np.float64), first)


def choose(logs: np.ndarray, n: np.ndarray, first: np.ndarray) -> list[tuple[list[int], list[float], float]]:
    """Per document: the languages of its set, the likeliest first, their proportions, and the score: the
    proportion of the first one when all languages may take part."""
    top = logs.max(axis=1, keepdims=True)
    likelihood = np.exp(logs - top)
    n = n.astype(np.float32)
    share, _ = proportions(likelihood, n, first)
    base = np.add.reduceat(logs.astype(np.float64) * n[:, None], first, axis=0)
    scale = np.add.reduceat(top[:, 0].astype(np.float64) * n, first)
    total = np.add.reduceat(n.astype(np.float64), first)
    sizes = np.diff(np.append(first, len(n)))
    order = np.argsort(-share, axis=1, kind="stable")
    single = base.argmax(axis=1)
    sets: list[list[int]] = [[int(x)] for x in single]
    weights: list[list[float]] = [[1.0] for _ in sets]
    penalised = -2 * base.max(axis=1)
    growing = np.arange(len(first))
    for size in range(2, logs.shape[1] + 1):
        rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(first)), sizes), growing))
        held = sizes[growing]
        chosen = np.sort(order[growing, :size], axis=1)
        some = np.take_along_axis(likelihood[rows], np.repeat(chosen, held, axis=0), axis=1)
        mixed, value = proportions(some, n[rows], np.cumsum(held) - held, prior=0.0)
        value = -2 * (value + scale[growing]) + (size - 1) * np.log(np.maximum(total[growing], 2))
        better = value < penalised[growing]
        for i in np.flatnonzero(better).tolist():
            doc, by = growing[i], np.argsort(-mixed[i], kind="stable")
            sets[doc], weights[doc] = chosen[i][by].tolist(), mixed[i][by].astype(float).tolist()
        penalised[growing[better]] = value[better]
        growing = growing[better]
        if not len(growing):
            break
    return [(s, w, float(share[i, s[0]])) for i, (s, w) in enumerate(zip(sets, weights))]


def infer(texts: Sequence[str], model: Model) -> list[tuple[str, float, list[str], list[float]]]:
    """Language, score, languages and proportions of each text."""
    out: list[tuple[str, float, list[str], list[float]]] = [(UNDETERMINED, 0.0, [], [])] * len(texts)
    found = [(i, *cell_counts(t, model.cells)) for i, t in enumerate(texts)]
    found = [f for f in found if len(f[1])]
    if found:
        first = np.cumsum([0, *[len(c) for _, c, _ in found[:-1]]])
        chosen = choose(model.logs[np.concatenate([c for _, c, _ in found])], np.concatenate([n for _, _, n in found]), first)
        for (i, _, _), (languages, weights, score) in zip(found, chosen):
            names = [model.languages[x] for x in languages]
            out[i] = (names[0], min(max(score, 0.0), 1.0), names, weights)
    return out


def identify(documents: DataFrame, model: Model | None, carry: Sequence[Column] = ()) -> DataFrame:
    """``carry`` columns, then ``lang_pred, score, languages, proportions`` of every document."""
    spark = documents.sparkSession
    small_batches(spark)
    kept = documents.select(*carry, F.col("text"))
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_BYTES
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    names = ["lang_pred", "score", "languages", "proportions"]

    # Texts taken up at a time, so that cells x languages of all of them stay small.
    most = BLOCK_BYTES * 8 // max(8, len(model.languages) if model else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.large_binary())]
            for lo, hi in chunks(sizes, most):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("text").to_pylist()]
                results = list(zip(*(infer(texts, known) if known else [(UNDETERMINED, 0.0, [], [])] * len(texts))))
                made = [pa.array(results[0], pa.string()), pa.array(results[1], pa.float64()), pa.array(results[2], pa.list_(pa.string())), pa.array(results[3], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])

    return kept.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double, languages array<string>, proportions array<double>")


def identify_held_out(documents: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all: ``doc_id, held_out, lang_pred, score,
    languages, proportions``."""
    marked = documents.where(F.col("doc_id").isNotNull() & ~held_out())
    return identify(documents, learn(marked), [F.col("doc_id"), held_out().alias("held_out")])
