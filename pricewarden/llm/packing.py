"""Best-fit packing: token pieces into sequences, by residual tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.llm.common import stored, texts
from pricewarden.llm.pieces import per_worker, sliced
from pricewarden.llm.text_ids import TextIds

CAPACITY = 1024
MAX_DOCS = 1024  # documents in a sequence: as many as one-token pieces fit, so the limit never costs a sequence
WEIGHTS = (1.0, 0.05, 0.05)  # of tokens, documents and attention cost, each as a share of its capacity
RANK_ROWS = 2_000  # rows ranked in one group


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    known = per_worker(("ids", path), lambda: TextIds(path))
    for batch in batches:
        for part in sliced(batch, "text"):
            found, counts = known.of(part.column("text").to_pylist())
            n = counts + 1
            stops = np.cumsum(n)
            ids = np.full(int(n.sum()), end_id, "<u4")
            own = np.ones(len(ids), bool)
            own[stops - 1] = False
            ids[own] = found
            first = (n - 1) % capacity + 1
            many = 1 + (n - first) // capacity
            doc = np.repeat(np.arange(part.num_rows), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = ((stops - n)[doc] + start).tolist()
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at, length.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:  # pieces follow each other as their ids do
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids and the end id, whole if they fit, else cut into pieces of `capacity`; the first may be shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _cut(it, tokenizer_path, end_id, capacity, keep_ids), schema)


class _Bins:
    """Open sequences by state: bins of equal residual capacities are one entry, held as ranges of bin numbers."""

    def __init__(self):
        self.ranges: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        self.states = np.zeros((0, 3), np.int64)
        self.stale = True

    def add(self, state: tuple[int, int, int], begin: int, count: int) -> None:
        if count and state[0] > 0 and state[1] > 0 and state[2] > 0:
            if state not in self.ranges:
                self.ranges[state] = []
                self.stale = True
            self.ranges[state].append((begin, count))

    def best(self, length: int, capacities: np.ndarray, weights: np.ndarray, score: str) -> tuple[int, int, int] | None:
        if self.stale:
            self.states, self.stale = np.array(list(self.ranges), np.int64).reshape(-1, 3), False
        need = np.array([length, 1, length * length], np.int64)
        fits = self.states[(self.states >= need).all(axis=1)]
        if not len(fits):
            return None
        if score == "dot_product":  # the residual that points most along the piece
            value = -((fits / capacities) * (need / capacities) * weights).sum(axis=1)
        else:  # the smallest residual that is left
            value = ((((fits - need) / capacities) ** 2) * weights).sum(axis=1)
        at = np.lexsort((fits[:, 2], fits[:, 1], fits[:, 0], value))[0]
        return tuple(int(x) for x in fits[at])

    def take(self, state: tuple[int, int, int], wanted: int) -> tuple[int, int]:
        """A range of at most `wanted` bins in that state, no longer open."""
        begin, count = self.ranges[state].pop()
        if count > wanted:
            self.ranges[state].append((begin + wanted, count - wanted))
            count = wanted
        if not self.ranges[state]:
            del self.ranges[state]
            self.stale = True
        return begin, count


def plan_placements(
    counts: dict[int, int], *, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, score: str = "residual_norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit over a histogram of lengths: rows (length, first_rank, n, first_bin, per_bin, offset).

    Pieces are taken by falling length. Among the open sequences whose residual tokens, documents and attention cost (sum of
    squared lengths) all hold the piece, the best by `score` takes it; else a new one opens. Pieces of one length and bins of one
    state are placed together, so the work follows the number of lengths and states and not the number of pieces: the
    pieces ranked first_rank .. first_rank + n - 1 of that length go to bins from first_bin on, `per_bin` in each.
    """
    max_cost = capacity * capacity if max_cost is None else max_cost
    if score not in ("residual_norm", "dot_product"):
        raise ValueError(f"unknown score: {score}")
    capacities, importance = np.array([capacity, max_docs, max_cost], float), np.array(weights, float)
    bins, placed, next_bin = _Bins(), [], 0
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity or length * length > max_cost:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = counts[length], 0
        while left > 0:
            state = bins.best(length, capacities, importance, score) or (capacity, max_docs, max_cost)
            opens = state == (capacity, max_docs, max_cost)
            # A piece that fits best leaves a still better fit for the next of its length, until the bin is full.
            most = min(state[0] // length, state[1], state[2] // (length * length)) if score == "residual_norm" or opens else 1
            each = min(most, left)
            if opens:
                begin, count = next_bin, left // each
                next_bin += count
            else:
                begin, count = bins.take(state, left // each)
            placed.append((length, rank, count * each, begin, each, capacity - state[0]))
            bins.add((state[0] - each * length, state[1] - each, state[2] - each * length * length), begin, count)
            left -= count * each
            rank += count * each
    return placed


def pack_pieces(
    pieces: DataFrame, *, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, score: str = "residual_norm",
) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 to `capacity`; reads `pieces` three times, so store it first.

    The driver sees the histogram of lengths alone, at most `capacity` numbers. Pieces get their rank among those of
    their length in groups of about `RANK_ROWS` rows, more groups for a hot length, and meet the placements by length and rank.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = plan_placements(counts, capacity=capacity, max_docs=max_docs, max_cost=max_cost, weights=weights, score=score)
    groups = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // RANK_ROWS))) for n in range(capacity + 1)])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(groups, F.col("length").cast("int"))).cast("long"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_at", within).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_start") + F.col("_at"))
    table = pa.table(
        dict(zip(("_length", "_first", "_count", "_bin", "_each", "_offset"), ([r[i] for r in placed] for i in range(6)), strict=True)),
        schema=pa.schema([(n, pa.int64()) for n in ("_length", "_first", "_count", "_bin", "_each", "_offset")]),
    )
    segments = spark.createDataFrame(table)
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    step = F.col("_rank") - F.col("_first")
    return ranked.join(segments, here).select(
        *pieces.columns,
        (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (step % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, score: str = "residual_norm", keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Every token of every document is packed exactly once. Null or empty text: the end id alone. Repeated rows: each is
    packed by itself. Null doc_id: packed like any other. An empty table gives an empty table. Further columns are not read.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id=end_id, capacity=capacity, keep_ids=keep_ids, id_col=id_col, text_col=text_col)
    return pack_pieces(stored(pieces, "pieces"), capacity=capacity, max_docs=max_docs, max_cost=max_cost, weights=weights, score=score)
