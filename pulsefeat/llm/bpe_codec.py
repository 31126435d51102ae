"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental inverse.

Encoding. Every piece of the split pattern goes through the transducer: bytes are fed in block by block,
and a token leaves once no byte still to come can change it. How far ahead one has to look is a property
of the merge list (``sufficient_lookahead``); the end of a piece settles all of it. Short pieces are
lanes that advance together, round by round, each merging its own lowest rank; a piece too long for a
lane is fed by itself, and merged within its buffer by a heap over linked symbols. What is held of a
piece is the lookahead and two blocks, however long the piece. The ids of stretches between single
spaces are remembered in a table of bounded size, the older half of which goes when it is full.

Decoding. Token bytes go through an incremental UTF-8 state machine; ill-formed bytes become U+FFFD.

Defined edge cases
  * null text counts as empty: no ids, empty decoded text
  * the special token's string inside a text is that token, and decodes to its string
  * one piece of any length (no spaces, one repeated byte) is streamed; repeated rows repeat results
  * an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import small_batches
from pulsefeat.llm.vocabulary import byte_letters, load

#: Fixed value: the split pattern of the byte-level vocabulary, with \s as White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
SINGLE_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
WINDOW = 1 << 17  # characters of a text cut into stretches at a time
TOGETHER = 1 << 20  # characters of windows whose new stretches are coded together
BLOCK = 1 << 12  # bytes the transducer takes in between two looks for stable tokens
LANE = 48  # bytes of the longest piece that is a lane
LANES = 1 << 13  # pieces that advance together
STRETCH = 1 << 10  # characters of the longest stretch that is remembered
REMEMBERED = 1 << 17  # stretches in each half of the table


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], length: list[int]) -> int:
    """Bytes after a token's end that decide it.

    Compare the merging of a text and of a prefix of it, rank by rank. They differ only right of a
    frontier. Merging (a, b) moves the frontier left by ``a`` at most, and only if ``b`` begins at it
    in one of the two. After that the token at the frontier begins with ``a``, so the next merge to
    move it, of a later rank, has a right part with ``a`` on its left spine. The longest such chain
    of ranks is the lookahead; the longest token is added for the frontier's start.
    """
    first: dict[int, int] = {}  # merged token -> its left part
    reach: dict[int, int] = {}  # token -> farthest frontier with that token at it
    most = 0
    for (a, b), (_, ab) in sorted(merges.items(), key=lambda x: x[1][0]):
        far, t = 0, b
        while t is not None:
            far = max(far, reach.get(t, 0))
            t = first.get(t)
        far += length[a]
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
        first.setdefault(ab, a)
    return most + max(length)


class Ranks:
    """Ranks of many pairs of symbols at a time, from two tables with one entry at most in a place."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.none = len(merges)
        bits = max(4, (2 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.factors = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        keys = np.array([a << 32 | b for a, b in merges], dtype=np.uint64)
        places = [self.place(keys, side).tolist() for side in (0, 1)]
        tables: tuple[dict[int, int], dict[int, int]] = {}, {}
        for k in range(len(keys)):
            side, moves = 0, 0
            while k >= 0:  # what is in the way goes to its place in the other table
                at = places[side][k]
                tables[side][at], k = k, tables[side].get(at, -1)
                side, moves = 1 - side, moves + 1
                if moves > 1000:
                    raise ValueError("the merges do not fit their tables")
        ranks = np.array([rank for rank, _ in merges.values()], dtype=np.int32)
        self.keys = [np.full(1 << bits, 2**64 - 1, dtype=np.uint64) for _ in tables]
        self.ranks = [np.full(1 << bits, self.none, dtype=np.int32) for _ in tables]
        for side, table in enumerate(tables):
            self.keys[side][list(table)] = keys[list(table.values())]
            self.ranks[side][list(table)] = ranks[list(table.values())]

    def place(self, keys: np.ndarray, side: int) -> np.ndarray:
        return (keys * self.factors[side] >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        one = self.place(keys, 0)
        found = np.where(self.keys[0][one] == keys, self.ranks[0][one], np.int32(self.none))
        rest = np.flatnonzero(found == self.none)
        two = self.place(keys[rest], 1)
        found[rest] = np.where(self.keys[1][two] == keys[rest], self.ranks[1][two], np.int32(self.none))
        return found


class ByteBpe:
    """The codec for one vocabulary file."""

    def __init__(self, path: str):
        spec = load(path)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        merges = spec["merges"]
        self.none = len(merges)
        self.rank_of = {a << 20 | b: rank for (a, b), (rank, _) in merges.items()}.get
        self.joined = [new for _, new in sorted(merges.values())]
        made_at = {new: rank for rank, new in reversed(list(enumerate(self.joined)))}
        if any(max(made_at.get(a, -1), made_at.get(b, -1)) >= rank for (a, b), (rank, _) in merges.items()):
            raise ValueError("a merge comes before the one that makes its part")
        self.special = spec["special"]
        self.start = [spec["ids"][c] for c in letters]
        self.ranks, self.starts, self.joins = Ranks(merges), np.array(self.start, dtype=np.int32), np.array(self.joined, dtype=np.int32)
        size = max([*spec["ids"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in spec["ids"].items():
            if i not in self.special.values():
                self.bytes[i] = bytes(of_letter[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lookahead = sufficient_lookahead(merges, [len(b) for b in self.bytes])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}  # ids of stretches met lately, each with the space before it
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """All merges of a bounded buffer, lowest rank first and leftmost first within a rank. A heap entry
        holds the rank and the place of a pair's left symbol; it is stale once that pair has another rank."""
        symbols = [self.start[b] for b in data]
        n, rank_of, joined, none = len(symbols), self.rank_of, self.joined, self.none
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(symbols, symbols[1:])] + [none]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank != none]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if ranks[i] != rank:
                continue
            j = after[i]
            new = symbols[i] = joined[rank]
            symbols[j], ranks[j], ranks[i] = -1, none, none
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = rank = rank_of(new << 20 | symbols[k], none)
                if rank != none:
                    heapq.heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                ranks[h] = rank = rank_of(symbols[h] << 20 | new, none)
                if rank != none:
                    heapq.heappush(heap, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece that arrives in blocks; each token is emitted once it is stable."""
        held = b""
        for block in blocks:
            held += block
            if len(held) <= self.lookahead + BLOCK:
                continue
            stable, done = [], 0
            for i in self.merged(held):
                if done + len(self.bytes[i]) > len(held) - self.lookahead:
                    break
                stable.append(i)
                done += len(self.bytes[i])
            held = held[done:]
            yield stable
        yield self.merged(held)

    def lanes(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short pieces laid end to end, and how many each has. A lane's input ends with its buffer,
        so its tokens are stable once no pair has a rank. In a round, each lane merges the pairs of its
        lowest rank from left to right: pairs that such a merge makes all have later ranks."""
        lane = np.repeat(np.arange(len(size)), size)
        symbol, place = self.starts[data], np.arange(len(data))
        out, kept = symbol.copy(), np.ones(len(data), dtype=bool)
        rank = np.full(len(data), self.none, dtype=np.int32)
        pair = np.flatnonzero(lane[1:] == lane[:-1])
        rank[pair] = self.ranks.of(symbol[pair], symbol[pair + 1])
        while len(symbol):
            begin = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
            length = np.diff(np.append(begin, len(lane)))
            low = np.minimum.reduceat(rank, begin)
            at = np.flatnonzero((rank == np.repeat(low, length)) & (rank < self.none))
            if not len(at):
                break
            # Of one symbol repeated, every other pair.
            count = np.arange(len(at))
            at = at[(count - np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), count, 0))) % 2 == 0]
            symbol[at] = self.joins[rank[at]]
            out[place[at]] = symbol[at]
            kept[place[at + 1]] = False
            stay = np.repeat(low < self.none, length)  # lanes without a rank are done
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            symbol, place, rank, lane = symbol[stay], place[stay], rank[stay], lane[stay]
            rank[at] = self.none
            pair = np.concatenate([at, at[at > 0] - 1])  # a pair between two merges comes twice
            pair = pair[pair < len(lane) - 1]
            pair = pair[lane[pair] == lane[pair + 1]]
            rank[pair] = self.ranks.of(symbol[pair], symbol[pair + 1])
        return out[kept], np.add.reduceat(kept, np.cumsum(size) - size, dtype=np.int64) if len(size) else size

    def piecewise(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of pieces that follow each other, block by block."""
        held: list[str] = []
        for piece in pieces:
            if len(piece) > STRETCH or len(held) == LANES:
                yield self.coded(held)[1]
                held = []
            if len(piece) > STRETCH:
                for ids in self.stream(piece[i : i + BLOCK // 4].encode() for i in range(0, len(piece), BLOCK // 4)):
                    yield np.asarray(ids, dtype="<u4").tobytes()
            else:
                held.append(piece)
        yield self.coded(held)[1]

    def coded(self, pieces: list[str]) -> tuple[np.ndarray, bytes]:
        """How many ids each of some pieces has, and the ids."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        long = np.flatnonzero(size > LANE).tolist()
        streamed = {i: [x for ids in self.stream([raw[i]]) for x in ids] for i in long}
        for i in long:
            raw[i] = b""
        short, n = size <= LANE, np.zeros(len(raw), dtype=np.int64)
        ids, n[short] = self.lanes(np.frombuffer(b"".join(raw), dtype=np.uint8), size[short])
        if long:
            ids = np.insert(ids, np.repeat(np.cumsum(n)[long], [len(x) for x in streamed.values()]), [x for i in long for x in streamed[i]])
            n[long] = [len(x) for x in streamed.values()]
        return n, ids.astype("<u4").tobytes()

    def learn(self, stretches: set[str]) -> None:
        """Put the ids of all these stretches, each with a space before it, into the table."""
        new = stretches.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.older, new = {}, self.known, stretches
        self.known.update([(s, self.older[s]) for s in new if s in self.older])
        new = new.difference(self.older)
        for some, split in (([s for s in new if s.isascii()], SPLIT_ASCII), ([s for s in new if not s.isascii()], SPLIT)):
            # The space before a stretch always begins a piece.
            pieces = split.findall(" " + " ".join(some)) if some else []
            begin = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1)
            ends = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))), begin) + 1
            self.known.update(zip(some, self.grouped(pieces, ends)))

    def grouped(self, pieces: list[str], ends: np.ndarray) -> list[bytes]:
        """Ids of groups of pieces that follow each other."""
        size, flat = [], []
        for lo in range(0, len(pieces), LANES):
            n, ids = self.coded(pieces[lo : lo + LANES])
            size.append(n)
            flat.append(ids)
        at = np.append(0, np.cumsum(np.concatenate([[0], *size])) * 4)[1:][np.append(0, ends)].tolist()
        whole = b"".join(flat)
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Windows of a text, cut at spaces: a string and further ones that follow a space each. A window ends
        before a space between two characters that aren't white space."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > WINDOW and (cut := SINGLE_SPACE.search(text, at + WINDOW)):
                end = cut.start()
            yield (text[at:end] if at or end < len(text) else text).split(" ")
            at = end

    def pieces(self, text: str) -> Iterator[str]:
        return (m[0] for m in (SPLIT_ASCII if text.isascii() else SPLIT).finditer(text))

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
        """The windows of all texts, with the text's number; a special token is a window of its own."""
        for i, text in enumerate(texts):
            for part in self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]:
                yield from ((i, window) for window in ([[part]] if part in self.special else self.stretches(part)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """Number of the text, and ids as little-endian 32-bit integers, block by block in order."""
        held, size = [], 0
        for i, window in self.parts(texts):
            held.append((i, window))
            size += len(window) + sum(map(len, window))
            if size >= TOGETHER:
                yield from self._windows(held)
                held, size = [], 0
        yield from self._windows(held)

    def _windows(self, windows: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        heads = [window[0] for _, window in windows]
        met = set().union(*(window[1:] for _, window in windows))
        new = met.difference(self.known)
        # White space on both sides of a space: the window is cut at other spaces only.
        odd = {s for s in new if not s or s[0].isspace() or s[-1].isspace()}
        tails = {}
        for k, (i, window) in enumerate(windows):
            if len(window) > 1 and (heads[k][-1:].isspace() or odd and not odd.isdisjoint(window[1:])):
                windows[k] = (i, window := SINGLE_SPACE.split(" ".join(window)))
                heads[k] = window[0]
                if len(window) > 1 and window[-1][-1].isspace():
                    tails[k] = " " + window.pop()
                met.update(window[1:])
        met -= odd
        long = {s for s in met if len(s) > STRETCH}
        self.learn(met - long)
        of = self.known.__getitem__
        ends = [s for s in (*heads, *tails.values()) if len(s) <= STRETCH and s not in self.special]
        split = [list(self.pieces(s)) for s in ends]
        of_end = dict(zip(ends, self.grouped([p for x in split for p in x], np.cumsum(np.array([len(x) for x in split], dtype=np.int64)))))
        of_end.update((s, np.asarray([n], dtype="<u4").tobytes()) for s, n in self.special.items())
        for k, (i, (head, *rest)) in enumerate(windows):
            if long.isdisjoint(rest) and head in of_end and k not in tails:
                yield i, b"".join([of_end[head], *map(of, rest)])
                continue
            for known, string in ((of_end.get(head), head), *((None, " " + s) if s in long else (of(s), s) for s in rest), (None, tails.get(k, ""))):
                yield from ((i, ids) for ids in (self.piecewise(self.pieces(string)) if known is None else [known]))

    def encode(self, text: str) -> Iterator[bytes]:
        return (ids for _, ids in self.encode_all([text]))

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        machine = self.decoder()
        for block in blocks:
            yield self.text_of(block, machine)
        yield machine.decode(b"", True)

    @staticmethod
    def decoder() -> codecs.IncrementalDecoder:
        return codecs.getincrementaldecoder("utf-8")("replace")

    def text_of(self, block: bytes, machine: codecs.IncrementalDecoder) -> str:
        """What the machine has of the text after the ids of a block, and hadn't before."""
        return machine.decode(b"".join(map(self.bytes.__getitem__, np.frombuffer(block, dtype="<u4").tolist())))


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One codec per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids and decoded text pass
    through the digests block by block and are never held whole."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            rows = batch.num_rows
            counts, of_ids, of_text = [0] * rows, [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            machines = [bpe.decoder() for _ in range(rows)]
            for i, block in bpe.encode_all(t.as_py() or "" for t in batch.column("text")):
                counts[i] += len(block) // 4
                of_ids[i].update(block)
                of_text[i].update(bpe.text_of(block, machines[i]).encode())
            for sha, machine in zip(of_text, machines):
                sha.update(machine.decode(b"", True).encode())
            digests = [pa.array([sha.hexdigest() for sha in x], pa.string()) for x in (of_ids, of_text)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with an array column of token ids in place of the text column. ``check`` names a further
    column that says whether the ids, decoded in the same worker, give the text again."""
    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, to, check)]
    packed = docs.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(1).alias("_")).alias("row"), F.col(f"`{text}`").alias("text"))
    row_type = packed.schema["row"].dataType.simpleString()

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded: list[list[bytes]] = [[] for _ in texts]
            for i, block in bpe.encode_all(texts):
                coded[i].append(block)
            ids = [np.frombuffer(b"".join(x), dtype="<u4").astype(np.int32) for x in coded]
            equal = ["".join(bpe.decode(iter(x))) == t if check else None for x, t in zip(coded, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.list_(pa.int32())), pa.array(equal, pa.bool_())], names=["row", "ids", "equal"])

    out = packed.mapInArrow(run, f"row {row_type}, ids array<int>, equal boolean")
    return out.select(*(["row.*"] if rest else []), F.col("ids").alias(to), *([F.col("equal").alias(check)] if check else []))


def decode(coded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``coded`` with the text that an array column of token ids stands for, as a further column."""

    small_batches(coded.sparkSession)

    @F.pandas_udf("string")
    def text_of(column):
        bpe = codec(path)
        return column.map(lambda x: "".join(bpe.decode(iter([np.asarray(x if x is not None else [], dtype="<u4").tobytes()]))))

    return coded.withColumn(to, text_of(F.col(f"`{ids}`")))
