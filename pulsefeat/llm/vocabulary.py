"""Reading of public BPE tokenizer files (JSON with ``model.vocab`` and ``model.merges``)."""

from __future__ import annotations

import json


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others take the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def load(path: str) -> dict:
    """``ids`` (token string to id), ``merges`` ((left id, right id) to (rank, merged id)),
    ``special`` (content to id) and ``suffix`` (mark of a word's end)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        suffix = model.get("end_of_word_suffix") or ""
        merges[ids[left], ids[right]] = (rank, ids[left + right])
    return {
        "ids": ids,
        "merges": merges,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "suffix": suffix,
    }
