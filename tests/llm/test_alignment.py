"""Alignment of two vocabularies against the libraries and a plain merge."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from pricewarden.llm import alignment
from pricewarden.llm.alignment import align_tokenizers, common_ends, merge_path
from pricewarden.llm.bpe import byte_symbols
from pricewarden.llm.queries import QUERIES, tokenizer

from .conftest import AWKWARD


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    symbols = byte_symbols()

    def of_a(i):
        return bytes(symbols[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if regex.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    counts, held = Counter(), []
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(of_a, ids_a)) != whole or b"".join(map(of_b, ids_b)) != whole:
            ids_a = ids_b = []
        ends_a, ends_b = (np.cumsum([len(f(i)) for i in ids]).tolist() if ids else [] for f, ids in ((of_a, ids_a), (of_b, ids_b)))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        held.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (d, n_a, n_b, n, sum(links.values()), sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), digest)
        for d, n_a, n_b, n, links, digest in held
    ]


def found(frame):
    return sorted((tuple(r) for r in frame.select(*alignment.RESULT_NAMES).collect()), key=str)


def test_alignment(spark, given, texts):
    assert found(QUERIES["op11_tokenizer_alignment"](spark, given)) == sorted(plain(texts.items()), key=str)


ODD = [(20, "a▁b"), (21, "▁"), (22, "  two  blanks  "), (23, " "), (24, "日本語のテキスト、混ざった text 123456"), (25, "\x00\x01 é́"), (26, "<s> </s> <0x41> <unk>"), (27, "\n\n x\n  y \n")]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_alignment(spark, awkward, monkeypatch, small):
    frame = awkward.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(d, t) for d, t, _ in AWKWARD] + ODD
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    if small:  # in this process, where the sizes can be changed: many pieces and many flushes
        import pyarrow as pa

        for name, value in (("PIECE", 3), ("PAIRS", 5), ("BLOCK_BYTES", 50), ("PACK_ROWS", 7), ("ROWS_OUT", 11)):
            monkeypatch.setattr(alignment, name, value)
        rows = [(d, t) for d, t in rows if len(t or "") < 500]
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
        out = pa.Table.from_batches(alignment._align(iter([batch.slice(0, 9), batch.slice(9)]), *paths)).to_pylist()
        expected = {r[0]: r for r in plain(rows) if r[0] is not None}
        for r in out:
            if r["kind"] == alignment.TEXT and r["doc_id"] is not None:
                assert tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*expected[r["doc_id"]][:5], expected[r["doc_id"]][7])
        assert len({r["block"] for r in out}) > 1
        return
    assert found(align_tokenizers(frame, *paths)) == sorted(plain(rows), key=str)


def test_alignment_of_nothing(empty):
    assert align_tokenizers(empty, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).collect() == []


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_merge_path(step):
    rng = np.random.default_rng(step)
    for _ in range(60):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        cuts = merge_path(a, b, step)
        assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
        for i, j in cuts:
            assert (i + j) % step == 0 or (i, j) == cuts[-1]
            assert sorted(merged[: i + j]) == sorted([(x, 0) for x in a[:i].tolist()] + [(x, 1) for x in b[:j].tolist()])
        at_a, at_b = common_ends(a, b, step)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
