"""Words of many texts at a time, hashed with NumPy straight from their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over per-byte
random values, read off prefix sums, so no word is ever made a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 19
INK = np.ones(256, dtype=bool)
INK[[0x20, *range(0x09, 0x0E)]] = False
VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
FOLDED = VALUE.copy()
FOLDED[0x41:0x5B] = VALUE[0x61:0x7B]
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 2**64)
ROLES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_power = {STEP: np.ones(1, dtype=np.uint64), STEP_BACK: np.ones(1, dtype=np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_power[base]) < n:
        factors = np.full(max(n, SEGMENT + 1024), base, dtype=np.uint64)
        factors[0] = 1
        _power[base] = np.cumprod(factors)
    return _power[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    buffer: np.ndarray  # bytes of all texts, a newline between them
    text_at: np.ndarray  # where each text begins
    start: np.ndarray  # of each word, in the buffer
    end: np.ndarray
    text: np.ndarray  # which text each word is in
    hash: np.ndarray
    first: np.ndarray  # for each text, and one more: its first word


def words(texts: list[bytes], fold_case: bool) -> Words:
    """All words of the texts; ``fold_case`` lower-cases A-Z before hashing."""
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    text_at = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=text_at[1:])
    ink = INK[buffer]
    edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    hashes = np.empty(len(start), dtype=np.uint64)
    lo = word = 0
    while word < len(start):
        # A segment ends with a word, so that tables of powers stay small however long the texts.
        upto = max(word + 1, int(np.searchsorted(end, lo + SEGMENT, side="right")))
        hi = int(end[upto - 1])
        sums = np.cumsum((FOLDED if fold_case else VALUE)[buffer[lo:hi]] * powers(STEP, hi - lo))
        s, e = start[word:upto] - lo, end[word:upto] - lo
        h = sums[e - 1]
        h[s > 0] -= sums[s[s > 0] - 1]
        hashes[word:upto] = mix(h * powers(STEP_BACK, hi - lo)[s] + (e - s).astype(np.uint64))
        word, lo = upto, int(start[upto]) if upto < len(start) else hi
    text = np.searchsorted(text_at, start, side="right") - 1
    return Words(buffer, text_at, start, end, text, hashes, np.searchsorted(start, np.append(text_at, len(buffer) + 1)))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether all of them are in one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h += w.hash[i : i + n] * ROLES[i]
    return mix(h), w.text[:n] == w.text[k - 1 :]


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and the index of their text. A text of fewer
    than ``k`` words, but one at least, has its whole sequence as its only shingle."""
    h, whole = shingles(w, k)
    text = w.text[: len(h)][whole]
    h = h[whole]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.full(len(short), k, dtype=np.uint64) * ROLES[60]
        for i in range(k - 1):
            has = count[short] > i
            own[has] += w.hash[w.first[short[has]] + i] * ROLES[i] + ROLES[61 + i % 3]
        h, text = np.concatenate([h, mix(own)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes together, one text at least."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows with one value of an integer column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and ids[lo] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = ids[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
