"""BPE coding and counting against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsefeat.llm import bpe_codec, token_count

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string"
HARD = [
    "", " ", "a" * 9000, "ab" * 7000, " " * 300 + "x", "\n\n \n  y", "don't we'll I'M 're", "x<|endoftext|><|endoftext|> y <|startoftext|>z", "Σίσυφος ΣΑΣ", "\x1c\x1d a b\u0085c ½ Ⅷ ٣ é ﬁ İ",
    "日本語テキスト" * 900, "😀👍🏽 x" * 40, "tab\tand  two spaces \r\n", "the " * 60000,
]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def same(text, libraries):
    byte, word = libraries
    bpe = bpe_codec.codec(BYTE)
    ids = np.frombuffer(b"".join(bpe.encode(text)), dtype="<u4").tolist()
    want = byte.encode(text, add_special_tokens=False).ids
    assert ids == want
    blocks = [np.asarray(ids[i : i + 3], dtype="<u4").tobytes() for i in range(0, len(ids), 3)]
    assert "".join(bpe.decode(iter(blocks))) == byte.decode(want, skip_special_tokens=False)
    assert token_count.counter(WORD).tokens(text) == len(word.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("i", range(len(HARD)))
def test_hard_texts(libraries, i):
    same(HARD[i], libraries)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Zs")) | st.sampled_from(" \n\t'sdtre"), max_size=60))
def test_any_text(libraries, text):
    same(text, libraries)


def test_streamed_piece_equals_merging_it_whole():
    rng = random.Random(4)
    bpe = bpe_codec.ByteBpe(BYTE)
    assert bpe.lookahead < 2000
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
        data = "".join(rng.choice(alphabet) for _ in range(20000)).encode()
        whole = bpe.merged(data)
        parts = list(bpe.stream(data[i : i + 700] for i in range(0, len(data), 700)))
        assert len(parts) > 3 and [x for p in parts for x in p] == whole


def test_one_unbroken_piece_is_held_in_blocks(libraries, monkeypatch):
    rng = random.Random(9)
    bpe = bpe_codec.ByteBpe(BYTE)
    held, merged = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda data: held.append(len(data)) or merged(data))
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    blocks = list(bpe.encode("one " + text))
    assert max(held) <= bpe.lookahead + 2 * bpe_codec.BLOCK and max(map(len, blocks)) <= 4 * max(held) and len(blocks) > 200
    assert "".join(bpe.decode(iter(blocks))) == "one " + text
    part = text[:100_000]
    assert np.frombuffer(b"".join(bpe.encode(part)), dtype="<u4").tolist() == libraries[0].encode(part, add_special_tokens=False).ids


@pytest.mark.parametrize("window,together", [(7, 50), (1 << 17, 1 << 20)])
def test_texts_coded_together_keep_their_own_ids(libraries, monkeypatch, window, together):
    monkeypatch.setattr(bpe_codec, "WINDOW", window)
    monkeypatch.setattr(bpe_codec, "TOGETHER", together)
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 40)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "日", "12", "'s", "$$", "<|endoftext|>", "½", " \n", "\r\n", "z" * 50, "q" * 1100]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    got = [b""] * len(texts)
    for i, ids in bpe_codec.ByteBpe(BYTE).encode_all(texts):
        got[i] += ids
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, dtype="<u4").tolist() == libraries[0].encode(text, add_special_tokens=False).ids, text


def test_ill_formed_bytes_decode_to_replacement_characters(libraries):
    ids = [bpe_codec.codec(BYTE).start[b] for b in b"a\xe2\x82b\xff\xf0\x9f"]
    got = "".join(bpe_codec.codec(BYTE).decode(iter([np.asarray([i], dtype="<u4").tobytes() for i in ids])))
    assert got == libraries[0].decode(ids, skip_special_tokens=False)


def test_counting_by_heap_equals_plain_merging():
    merges = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("a", "a"): 3}
    numbers = {s: i for i, s in enumerate(["a", "b", "c", "ab", "abc", "bc", "aa"])}
    rank_of = {numbers[x] << token_count.SHIFT | numbers[y]: r for (x, y), r in merges.items()}.get
    joined = [numbers[x + y] for x, y in merges]
    for text, want in (("abc", 2), ("aaaa", 2), ("bcabcbc", 4), ("", 0), ("cab", 1), ("aab", 1)):
        assert token_count.merges_of([numbers[c] for c in text], rank_of, joined) == want


def test_queries_over_odd_rows(spark, libraries):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, None), (None, "", ""), (3, HARD[2], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe_codec.round_trip(df, BYTE).collect()
    for (i, t, _), r in zip(rows, got):
        ids = libraries[0].encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe_codec.encode(df, BYTE, to="ids")
    assert coded.columns == ["doc_id", "ids"]
    assert [r.text for r in bpe_codec.decode(coded, BYTE).collect()] == [t or "" for _, t, _ in rows]
    counted = token_count.token_counts(df, WORD, limit=2).collect()
    assert [(r.n_bytes, r.over_limit) for r in counted] == [(12, False), (12, False), (0, False), (0, False), (9000, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe_codec.round_trip(empty, BYTE).collect() == [] and token_count.token_counts(empty, WORD).collect() == []
