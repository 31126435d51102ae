"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A word starts as its byte symbols in a doubly linked list; a heap gives the adjacent pair of lowest
rank (leftmost first), which is merged in place until no pair has a rank. The count is the number
of initial symbols minus merges. Counts of words met lately are remembered in tables of bounded size.

Defined edge cases
  * null text counts as empty: 0 bytes, 0 tokens
  * special strings inside a text count as one token each, as the library's default has it
  * a word of any length costs n log n; repeated rows repeat their counts; other columns are not read
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import small_batches
from pulsefeat.llm.vocabulary import byte_letters, load

#: Fixed value: the split pattern of the word vocabulary, with \s as White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")
REMEMBERED = 1 << 17  # strings in each half of a table
SEPARATORS = re.compile("[\x1c-\x1f]")


SHIFT = 20


def merges_of(symbols: list[int], rank_of: Callable[[int], int | None], joined: list[int]) -> int:
    """How many merges the list of symbols undergoes. A heap entry holds the rank and the position of
    a pair's left symbol; it is stale once the pair there has another rank."""
    n = len(symbols)
    ranks = [rank_of(a << SHIFT | b) for a, b in zip(symbols, symbols[1:])]
    heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank is not None]
    if not heap:
        return 0
    ranks.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(heap)
    done = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        if ranks[i] != (rank := entry >> 32):
            continue
        j = after[i]
        new = symbols[i] = joined[rank]
        ranks[j] = None
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            ranks[i] = rank = rank_of(new << SHIFT | symbols[k])
            if rank is not None:
                heappush(heap, rank << 32 | i)
        else:
            ranks[i] = None
        h = before[i]
        if h >= 0:
            ranks[h] = rank = rank_of(symbols[h] << SHIFT | new)
            if rank is not None:
                heappush(heap, rank << 32 | h)
    return done


class Remembered(dict):
    """Counts of strings met lately. When half of the bound is reached, what was there before goes."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count
        self.older: dict[str, int] = {}

    def __missing__(self, text: str) -> int:
        n = self.older.get(text)
        if n is None:
            n = self.count(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.older = self.copy()
                self.clear()
            self[text] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        spec = load(path)
        letters = byte_letters()
        self.special = spec["special"]
        self.rank_of = {a << SHIFT | b: rank for (a, b), (rank, _) in spec["merges"].items()}.get
        self.joined = [new for _, new in sorted(spec["merges"].values())]
        self.inner = [spec["ids"][c] for c in letters]
        self.final = [spec["ids"][c + spec["suffix"]] for c in letters]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Remembered(self.word)
        self.runs = Remembered(self.run)

    def word(self, word: str) -> int:
        data = word.encode()
        symbols = list(map(self.inner.__getitem__, data))
        symbols[-1] = self.final[data[-1]]
        return len(symbols) - merges_of(symbols, self.rank_of, self.joined)

    def run(self, text: str) -> int:
        """Tokens of a run of text; no word goes over white space, so runs between it count apart."""
        if text.isascii():
            return sum(map(self.words.__getitem__, SPLIT_ASCII.findall(text.lower())))
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: no letter's form depends on its neighbours.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return sum(map(self.words.__getitem__, SPLIT.findall(text)))

    def plain(self, text: str) -> int:
        # str.split also splits at the separators U+001C to U+001F, which the pattern takes for symbols.
        return self.run(text) if SEPARATORS.search(text) else sum(map(self.runs.__getitem__, text.split()))

    def tokens(self, text: str) -> int:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return len(self.at_special.findall(text)) + sum(map(self.plain, self.at_special.split(text)))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per Python worker and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_tokens, over_limit``."""

    def run(batches):
        counting = counter(path)
        for batch in batches:
            tokens = [counting.tokens(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
