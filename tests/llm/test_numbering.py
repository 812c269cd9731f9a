"""Exact numbers of ranges, and ids of whole texts against the library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as sampled
from hypothesis import settings
from hypothesis import strategies as st

from pricewarden.llm import numbering
from pricewarden.llm.numbering import FlatMemo, numbered, same_bytes
from pricewarden.llm.queries import tokenizer
from pricewarden.llm.text_ids import TextIds
from pricewarden.llm.words import HASHER, joined, words

PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u2003", "\u3000", "\u200b", "a", "Zz", "'s", "'S", "don't", "é", "e\u0301", "ß", "ǆ",
         "\U0001f600", "1", "²", "½", "12 345", "...", "—", "€", "_", "日本", "ا", "<|endoftext|>", "<|endoftext", "x" * 600]
TEXTS = st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=6)


def _numbers(texts):
    data, starts = joined(pa.array(texts))
    begins, ends, _ = words(data, starts)
    first, which = numbered(data, begins, ends)
    raw = data.tobytes()
    found = [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    assert [found[first[w]] for w in which] == found
    assert len(first) == len(set(found)) == len({found[i] for i in first})


def test_numbers_are_exact_even_when_hashes_meet(monkeypatch):
    texts = ["one two one", "", "two three two one", "x" * 100]
    _numbers(texts)
    monkeypatch.setattr(HASHER, "ranges", lambda data, begins, ends: ((ends - begins) % 2).astype(np.uint64))
    _numbers(texts)


def test_memo_forgets_and_stays_right(monkeypatch):
    class Bytes(FlatMemo):
        def compute(self, pieces):
            ids, counts = numbering.flattened(map(list, pieces))
            return ids, np.cumsum(counts) - counts, counts, np.array([p != b"bad" for p in pieces])

    monkeypatch.setattr(numbering, "MEMO_PIECES", 5)
    monkeypatch.setattr(numbering, "PART_BYTES", 16)
    memo = Bytes()
    text = " ".join(f"w{i % 9}" for i in range(60)) + " bad"
    data, starts = joined(pa.array([text, "bad"]))
    begins, ends, _ = words(data, starts)
    for _ in range(3):
        ids, counts, good = memo.encode(data, begins, ends)
        assert bytes(ids.astype(np.uint8)) == (text + "bad").replace(" ", "").encode()
        assert counts.tolist() == (ends - begins).tolist()
        assert good.tolist() == [True] * (len(begins) - 2) + [False] * 2


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    path, out = tokenizer("byte_bpe_50k.json"), {}
    for plain in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        out[plain] = library, TextIds(path, plain)
    return out


def check(encoders, texts):
    for library, fast in encoders.values():
        assert fast.fast is not None
        ids, counts = fast.of(texts)
        found = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        raw = [t.encode() for t in texts]
        start = np.cumsum(counts) - counts
        assert same_bytes(raw, ids, start, counts, fast.table, fast.begin, fast.sizes).all()
        wrong = [r[:-1] + b"?" if len(r) > 1 else r for r in raw]
        got = same_bytes(wrong, ids, start, counts, fast.table, fast.begin, fast.sizes)
        assert got.tolist() == [w == r for w, r in zip(wrong, raw, strict=True)]


@settings(max_examples=300, deadline=None)
@sampled(texts=TEXTS)
def test_ids_are_those_of_the_library(encoders, texts):
    check(encoders, texts)


def test_ids_of_every_latin_character(encoders):
    check(encoders, [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}1{chr(i)}  x" for i in [*range(0x250), *range(0x2010, 0x203B), 0x20AC]])
    check(encoders, ["", " ", "a" * 50_000, " \n" * 20_000, "ab1 " * 20_000])
