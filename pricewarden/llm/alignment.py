"""Cross-tokenizer alignment: token ends of two vocabularies merged into groups, and how often their ids are linked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.llm.common import stored, texts
from pricewarden.llm.numbering import FlatMemo, flattened, id_bytes, positions, same_bytes
from pricewarden.llm.pieces import per_worker, sliced
from pricewarden.llm.text_ids import TextIds
from pricewarden.llm.words import joined

SLICE_BYTES = 1 << 20  # text aligned at a time inside a batch
BLOCK_BYTES = 16 << 20  # text of the documents that look up pair counts together
PIECE = 1 << 18  # token ends of both sides that one piece of the merge handles
PAIRS = 1 << 21  # linked pairs spelled out at a time
PACK_ROWS = 1 << 18  # looked-up pairs a task holds before it sends them
ROWS_OUT = 100_000  # rows of an Arrow batch
IDS = 1 << 17  # above every id of both vocabularies
PAIR, TEXT = 0, 1

TEXT_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
FIRST = f"block long, kind int, pair long, n long, {TEXT_COLUMNS}, pairs binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


class _PieceIds(FlatMemo):
    """Ids of a sentence-piece model, which puts a blank before every text itself; no piece goes on after a blank."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of this model reaches over a blank, so texts cannot be cut at blanks")
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        known = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.table, self.begin, self.sizes = id_bytes(known)
        self.blank = [self.model.piece_to_id("▁")]

    def compute(self, pieces):
        # The model leaves an empty text empty, so the one blank that ends a text is told by itself.
        ids, counts = flattened(ids or self.blank for ids in self.model.encode([p[1:].decode() for p in pieces], num_threads=1))
        start = np.cumsum(counts) - counts
        return ids, start, counts, same_bytes(pieces, ids, start, counts, self.table, self.begin, self.sizes)


def _blank_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that begin at the first blank of a run and end before the next run; every text of the buffer begins with a blank."""
    blank = data == 0x20
    begin = blank & ~np.concatenate([[False], blank[:-1]])
    begin[starts[:-1]] = True
    begins = np.flatnonzero(begin)
    owner = np.searchsorted(starts, begins, "right") - 1
    return begins, np.minimum(np.concatenate([begins[1:], [len(data)]]), starts[owner + 1] - 1), owner


def merge_path(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> list[tuple[int, int]]:
    """Cuts (i, j) that divide the merge of two increasing arrays into pieces of `step` elements.

    The cut of a diagonal d is found by binary search on it: i + j = d, and all of a[:i], b[:j] stand before the rest in the
    merge, where of two equal elements that of `a` comes first. Every piece has the same work, however the elements lie.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        # a[middle] belongs before b[d - middle - 1] or with it: the cut lies further along a.
        open_ = low < high
        before = a[np.minimum(middle, max(len(a) - 1, 0))] <= b[np.clip(diagonal - middle - 1, 0, max(len(b) - 1, 0))] if len(a) and len(b) else open_
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return list(zip(low.tolist(), (diagonal - low).tolist(), strict=True))


def common_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and `b` of the ends that both have, piece by piece of the merge.

    A piece finds those within itself. Where a cut falls between two equal ends, the piece before has that of `a` last and the
    piece after that of `b` first; such boundaries are stitched.
    """
    at_a, at_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = merge_path(a, b, step)
    for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False):
        if i and j < m and a[i - 1] == b[j]:  # stitched to the piece before
            at_a.append(np.array([i - 1]))
            at_b.append(np.array([j]))
        own, other = a[i:k], b[j:m]
        if len(own) and len(other):
            place = np.minimum(np.searchsorted(other, own), len(other) - 1)
            same = np.flatnonzero(other[place] == own)
            at_a.append(i + same)
            at_b.append(j + place[same])
    return np.concatenate(at_a), np.concatenate(at_b)


_DIGITS = np.frombuffer("".join(f"{i:>6}" for i in range(IDS)).encode(), np.uint8).reshape(IDS, 6)
_SIZES = np.array([len(str(i)) for i in range(IDS)])


def _spelled(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with the byte that follows it, as one buffer; and where each ends, the byte included."""
    table = np.empty((len(ids), 7), np.uint8)
    table[:, :6] = _DIGITS[ids]
    table[:, 6] = after
    return table[np.arange(7) >= 6 - _SIZES[ids][:, None]], np.cumsum(_SIZES[ids] + 1)


class _Aligned:
    """The tokens of a slice of texts under both vocabularies, and their groups."""

    def __init__(self, column: pa.Array, a: TextIds, b: _PieceIds):
        n = len(column)
        spaced = [" " + t if t else "" for t in column.to_pylist()]
        data, starts = joined(pa.array(spaced, pa.string()))
        empty = np.diff(starts) == 1
        ids, counts = a.of(spaced)
        start = np.cumsum(counts) - counts
        raw = data.tobytes()
        whole = [raw[x : y - 1] for x, y in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
        good = same_bytes(whole, ids, start, counts, a.table, a.begin, a.sizes)
        sides = [(ids.astype(np.int64), np.repeat(np.arange(n), counts), ~good, a.sizes)]
        begins, ends, owner = _blank_spans(data, starts)
        some = ends > begins
        begins, ends, owner = begins[some], ends[some], owner[some]
        ids, counts, good = b.encode(data, begins, ends)
        sides.append((ids.astype(np.int64), np.repeat(owner, counts), np.bincount(owner, ~good, n) > 0, b.sizes))
        odd = empty | sides[0][2] | sides[1][2]
        self.ids, self.owner, stops = [], [], []
        for ids, owner, _, sizes in sides:
            keep = ~odd[owner]
            self.ids.append(ids[keep])
            self.owner.append(owner[keep])
            stops.append(np.cumsum(sizes[ids[keep]]))
        at_a, at_b = common_ends(*stops)
        self.n = [np.bincount(o, minlength=n).astype(np.int64) for o in self.owner]
        first = np.zeros(1, np.int64)
        self.begin = [np.concatenate([first, at[:-1] + 1])[: len(at)] for at in (at_a, at_b)]
        self.size = [np.diff(np.concatenate([first - 1, at])) for at in (at_a, at_b)]
        self.group_of = self.owner[0][at_a]
        self.documents = n
        self.links = np.bincount(self.group_of, self.size[0] * self.size[1], n).astype(np.int64) if len(at_a) else np.zeros(n, np.int64)
        self.groups = np.bincount(self.group_of, minlength=n).astype(np.int64)

    def digests(self) -> list[str]:
        """sha256 of each document's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        many = len(self.group_of)
        before = np.cumsum(self.size[0] + self.size[1]) - self.size[0] - self.size[1]  # tokens of the groups before
        ids = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        after = np.full(len(ids), ord(","), np.uint8)
        for own, begin, size, shift in zip(self.ids, self.begin, self.size, (0, self.size[0]), strict=True):
            ids[positions(before + shift, size)] = own[positions(begin, size)]
        after[before + self.size[0] - 1] = ord("|")
        after[before + self.size[0] + self.size[1] - 1] = ord(";")
        text, ends = _spelled(ids, after)
        of = np.bincount(self.group_of, self.size[0] + self.size[1], self.documents).astype(np.int64) if many else np.zeros(self.documents, np.int64)
        stops = np.cumsum(of)
        raw, ends = memoryview(text), np.concatenate([[0], ends]).tolist()
        return [hashlib.sha256(raw[ends[s - k] : ends[s] - 1]).hexdigest() if k else "" for s, k in zip(stops.tolist(), of.tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times): distinct linked id pairs of each document, a * IDS + b, and their token pairs.

        A group is spelled out by its distinct ids, a bounded number of pairs at a time.
        """
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sides = []
        for ids, begin, size in zip(self.ids, self.begin, self.size, strict=True):
            group = np.repeat(np.arange(len(size)), size)
            keys, times = _folded(group * IDS + ids[positions(begin, size)], None)
            sides.append((keys % IDS, times, np.bincount(keys // IDS, minlength=len(size)).astype(np.int64)))
        (a, times_a, n_a), (b, times_b, n_b) = sides
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # One row for each distinct `a` of a group, beside all distinct `b` of that group.
        group = np.repeat(np.arange(len(n_a)), n_a)
        width = n_b[group]
        reach = np.cumsum(width)
        begin = 0
        while begin < len(a):
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + PAIRS, "right")))
            own = np.repeat(np.arange(begin, end), width[begin:end])
            other = positions(first_b[group[begin:end]], width[begin:end])
            keys = (self.group_of[group[own]] << 34) | (a[own] * IDS + b[other])
            held.append(_folded(keys, times_a[own] * times_b[other]))
            begin = end
        if not held:
            return (np.zeros(0, np.int64),) * 3
        keys, times = held[0] if len(held) == 1 else _folded(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return keys >> 34, keys & ((1 << 34) - 1), times


def _folded(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts, of ones where there are none."""
    by = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if by is None else keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(keys))
    if by is None:
        return keys[first], ends - first
    sums = np.concatenate([[0], np.cumsum(counts[by])])
    return keys[first], sums[ends] - sums[first]


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A row for each document and, after the documents of a block, one for each pair they hold."""
    a, b = per_worker(("align-a", path_a), lambda: TextIds(path_a, plain_specials=True)), per_worker(("align-b", path_b), lambda: _PieceIds(path_b))
    context, press = TaskContext.get(), zstandard.ZstdCompressor(level=1).compress
    block = (context.partitionId() if context else 0) << 24
    names = [c.split()[0] for c in FIRST.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in FIRST.split(", ")]

    def rows(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    held, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0

    def close() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held[0]), ROWS_OUT):
            own = held[0][i : i + ROWS_OUT]
            yield rows(len(own), {"block": np.full(len(own), block), "kind": np.full(len(own), PAIR, np.int32), "pair": own, "n": held[1][i : i + ROWS_OUT]})

    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            if size and size + part.column("text").nbytes > BLOCK_BYTES:
                yield from close()
                block, held, size = block + 1, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
            aligned = _Aligned(part.column("text"), a, b)
            document, pair, times = aligned.pairs()
            found, counts = _folded(pair, np.ones(len(pair), np.int64))
            held = _folded(np.concatenate([held[0], found]), np.concatenate([held[1], counts]))
            size += part.column("text").nbytes
            bounds = np.searchsorted(document, np.arange(part.num_rows + 1))
            spans = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
            steps = np.diff(pair, prepend=0)
            steps[bounds[:-1][bounds[:-1] < bounds[1:]]] = pair[bounds[:-1][bounds[:-1] < bounds[1:]]]
            yield rows(part.num_rows, {
                "block": np.full(part.num_rows, block), "kind": np.full(part.num_rows, TEXT, np.int32), "doc_id": part.column("doc_id"),
                "n_a": aligned.n[0], "n_b": aligned.n[1], "n_groups": aligned.groups, "n_links": aligned.links, "groups_sha256": aligned.digests(),
                "pairs": [press(steps[x:y].tobytes()) for x, y in spans], "times": [press(times[x:y].tobytes()) for x, y in spans],
            })
    if size:
        yield from close()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts dealt out to the blocks that hold the pairs: a row for each block and flush of a task."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        block, pair, value = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.argsort(block, kind="stable")
        block, pair, value = block[by], pair[by], value[by]
        bounds = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        spans = list(zip(bounds, bounds[1:], strict=False))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[bounds[:-1]]), pa.array([pair[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([value[x:y].tobytes() for x, y in spans], pa.binary())],
            ["block", "pairs", "times"],
        )

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("block", "pair", "value")))
        size += batch.num_rows
        if size >= PACK_ROWS:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum of the documents of each block, whose packed counts come before its documents."""
    open_up = zstandard.ZstdDecompressor().decompress
    current, packs, known, value = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        best, total, texts_at = [], [], []
        for i, (block, kind) in enumerate(zip(columns["block"].to_pylist(), columns["kind"].to_pylist(), strict=True)):
            if block != current:
                current, packs, known = block, [], None
            first, second = columns["pairs"][i].as_py(), columns["times"][i].as_py()
            if kind == PAIR:
                packs.append((np.frombuffer(first, np.int64), np.frombuffer(second, np.int64)))
                continue
            if known is None:
                known = np.concatenate([k for k, _ in packs] or [np.zeros(0, np.int64)])
                value = np.concatenate([v for _, v in packs] or [np.zeros(0, np.int64)])
                by = np.argsort(known, kind="stable")
                known, value, packs = known[by], value[by], []
            pair = np.cumsum(np.frombuffer(open_up(first), np.int64))
            times = np.frombuffer(open_up(second), np.int64)
            found = value[np.searchsorted(known, pair)] if len(pair) else np.zeros(0, np.int64)
            texts_at.append(i)
            best.append(int(times[found & 1 == 1].sum()))
            total.append(int((times * (found >> 1)).sum()))
        if texts_at:
            own = batch.take(pa.array(texts_at))
            extra = {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([extra[c] if c in extra else own.column(c) for c in RESULT_NAMES], RESULT_NAMES)


def align_tokenizers(docs: DataFrame, byte_level_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of both vocabularies are laid over the bytes of a blank and the text. Where tokens of both end at one byte, a group
    ends; all its pairs of an A and a B token are links. The count of an id pair is the number of rows of the table that
    hold it linked; the best counts of an A id are those equal to its highest.

    Each task encodes its texts once, distinct pieces only, merges the ends of a slice by pieces of equal work and closes a block
    after a bounded number of bytes. A block sends its distinct pairs with their number of documents; these are summed up by
    pair, the highest of each A id (at most as many as the vocabulary has ids) is sent to all tasks, and each block gets back
    the counts of its own pairs. What travels grows with the text, and no table of the corpus is held in one place.

    Null or empty texts, and texts that either vocabulary does not give back byte by byte: zeros and ''. Null doc_id: kept.
    Repeated rows: each counts as a document. An empty table gives an empty table. Further columns are not read.
    """
    first = stored(texts(docs, id_col, text_col).mapInArrow(lambda it: _align(it, byte_level_path, piece_path), FIRST), "aligned")
    held = first.where(F.col("kind") == PAIR).select("block", "pair", "n")
    # A pair has one row for each block at most.
    counted = stored(held.select("block", "pair", F.sum("n").over(W.partitionBy("pair")).alias("count")), "pairs")
    a = F.shiftright("pair", IDS.bit_length() - 1)
    highest = counted.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    valued = counted.join(F.broadcast(highest), a == F.col("a")).select(
        "block", "pair", (F.col("count") * 2 + (F.col("count") == F.col("highest")).cast("long")).alias("value")
    )
    packed = valued.mapInArrow(_packed, "block long, pairs binary, times binary").withColumn("kind", F.lit(PAIR))
    documents = first.where(F.col("kind") == TEXT).drop("pair", "n")
    together = packed.unionByName(documents, allowMissingColumns=True)
    return together.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_summed, RESULT)
