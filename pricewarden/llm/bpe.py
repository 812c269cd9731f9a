"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pricewarden.llm.common import texts
from pricewarden.llm.pieces import WHITE, Memo, per_worker, sliced

# The pretoken pattern of byte-level vocabularies, for any text and, faster, for ASCII text.
PRETOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
ASCII_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves; the others, in order, for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Byte-level vocabulary: ids of bytes and merges, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols, vocab = byte_symbols(), model["model"]["vocab"]
        self.bytes = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.single = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {token["content"]: token["id"] for token in model["added_tokens"]}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        self.none = len(self.merges)  # above every rank: no merge here

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken.

        Leaf i of the tree holds the rank of the pair that begins at symbol i, together with i itself, so the root is
        the leftmost pair of the lowest rank. A merge changes three leaves, each updated on its path to the root.
        """
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, self.none
        width = 1 << (n - 1).bit_length()
        empty = none * width
        tree = [empty] * (2 * width)
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                tree[width + i] = found[0] * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def update(i: int, value: int) -> None:
            k = width + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < empty:
            i = tree[1] % width
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            update(j, empty)
            if k < n:
                before[k] = i
                found = merges.get((ids[i], ids[k]))
                update(i, found[0] * width + i if found else empty)
            else:
                update(i, empty)
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], ids[i]))
                update(h, found[0] * width + h if found else empty)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become the replacement character."""
        known = self.bytes
        return b"".join([known[i] for i in ids]).decode("utf-8", "replace")

    def pretokens(self, text: str) -> list[str]:
        pattern = ASCII_PRETOKENS if text.isascii() else PRETOKENS
        if any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
            return [p for part in parts for p in ([part] if part in self.special else pattern.findall(part))]
        return pattern.findall(text)


class _Encoded(Memo):
    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = Vocabulary(path)

    def compute(self, pieces):
        special, encode = self.vocabulary.special, self.vocabulary.encode
        return [np.asarray([special[p]] if p in special else encode(p.encode()), "<u4").tobytes() for p in pieces]


def _encode(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    memo = per_worker(("bpe", path), lambda: _Encoded(path))
    vocabulary = memo.vocabulary
    for batch in batches:
        for part in sliced(batch, "text"):
            found = [vocabulary.pretokens(text) for text in part.column("text").to_pylist()]
            ids_of = memo.of({p for pieces in found for p in pieces})
            ids = [b"".join(map(ids_of.__getitem__, pieces)) for pieces in found]
            numbers = [np.frombuffer(x, "<u4") for x in ids]
            back = [vocabulary.decode(x.tolist()) for x in numbers]
            columns = [
                part.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([x.astype(np.int32) for x in numbers], pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, with `keep` also ids and the decoded text.

    Pretokens are merged by the segment tree, each distinct one once; a worker remembers a bounded number. A pretoken of n
    bytes costs n log n. Special strings inside a text become their ids, as the library's default has it. One pass, no
    shuffle.

    Null or empty text: no ids, empty decoded text. Repeated rows: each gets its own row. Null doc_id: kept. Further
    columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _encode(it, tokenizer_path, keep), schema)
