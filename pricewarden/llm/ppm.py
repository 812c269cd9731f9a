"""Language-model scoring by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.llm.common import blocks_for, stored, texts
from pricewarden.llm.pieces import pack_text, sliced, unpack
from pricewarden.llm.words import HASHER, LOWER, SPACE, joined, words

ORDER = 5  # bytes of context
ESCAPE = 0.3  # what every symbol of a context gives up of its count, for the escape from it
SYMBOLS = 256
BLANK, END = 0x20, 0x0A  # after a word; after a text, and before its first byte as context
BLOCK_BYTES = 24 << 20  # text of the documents that look up the model together
WORD, GRAM, TEXT = 0, 1, 2
SLICE_BYTES = 400 << 10  # compressed text read at a time, about a megabyte of it
FOLD_SLICES = 16  # slices whose counts are held apart
PACK_ENTRIES = 1 << 18  # looked-up values a task holds before it sends them
RANGE_BLOCKS = 256  # blocks that one row of a key names; a key of more blocks has more rows
ROWS_OUT = 100_000  # rows of an Arrow batch
END_KEY = 10  # stands for the end of a text among the word hashes
FOLDS, HELD_OUT = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _stream(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their texts; the model's bytes as grams of order + 1 bytes and their texts.

    The bytes of a text are its words with a blank between them and the end symbol last; what is before its first byte
    counts as end symbols.
    """
    data, starts = joined(column)
    data = LOWER[data]
    begins, ends, owner = words(data, starts, SPACE)
    hashes = HASHER.ranges(data, begins, ends)
    n = len(starts) - 1
    keep = ~SPACE[data]
    data = data.copy()
    keep[ends] = True
    data[ends] = BLANK
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    data[ends[last]] = END
    empty = np.ones(n, bool)
    empty[owner] = False
    keep[starts[1:][empty] - 1] = True
    text_of = np.repeat(np.arange(n), np.diff(starts))[keep] if n else np.zeros(0, np.int64)
    kept = data[keep]
    # Room for the context before each text.
    place = np.arange(len(kept)) + (text_of + 1) * order
    padded = np.full(len(kept) + n * order, END, np.int64)
    padded[place] = kept
    grams = np.zeros(len(kept), np.int64)
    for j in range(order, -1, -1):
        grams = (grams << 8) | padded[place - j]
    return hashes.view(np.int64), owner, grams, text_of


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a stream sorted by block; none holds rows of two blocks."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        bounds = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for begin, end in zip(bounds, bounds[1:], strict=False):
            if end > begin:
                yield int(blocks[begin]), batch.slice(begin, end - begin)


def _postings(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """The distinct words and grams of each block, each with its count in the block's training texts."""
    kept: dict[int, tuple[list, list]] = {WORD: ([], []), GRAM: ([], [])}

    def rows(block: int) -> Iterator[pa.RecordBatch]:
        for kind, (keys, counts) in kept.items():
            found, total = _folded(keys, counts)
            for i in range(0, len(found), ROWS_OUT):
                own = found[i : i + ROWS_OUT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block, np.int32)), pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(total[i : i + ROWS_OUT])],
                    ["block", "kind", "key", "n"],
                )
            keys.clear()
            counts.clear()

    current = None
    for block, rest in _parts(batches):
        if current is not None and block != current:
            yield from rows(current)
        current = block
        for part in sliced(rest, "packed", SLICE_BYTES):
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            hashes, owner, grams, text_of = _stream(unpack(part.column("packed")), order)
            hashes = np.concatenate([hashes, np.full(part.num_rows, END_KEY, np.int64)])
            owner = np.concatenate([owner, np.arange(part.num_rows)])
            for kind, keys, of in ((WORD, hashes, owner), (GRAM, grams, text_of)):
                found, counts = _folded([keys], [train[of].astype(np.int64)])
                kept[kind][0].append(found)
                kept[kind][1].append(counts)
                if len(kept[kind][0]) >= FOLD_SLICES:
                    found, counts = _folded(*kept[kind])
                    kept[kind] = ([found], [counts])
    if current is not None:
        yield from rows(current)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and values dealt out to the blocks that hold the keys: a row for each block, kind and flush of a task."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        block, kind, key, value = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.lexsort((kind, block))
        block, kind, key, value = block[by], kind[by], key[by], value[by]
        bounds = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1), len(block)]
        spans = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[[a for a, _ in spans]].astype(np.int32)), pa.array(kind[[a for a, _ in spans]].astype(np.int32)),
             pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())],
            ["block", "kind", "keys", "values"],
        )

    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("blocks")).to_numpy())
        begin = 0
        while begin < batch.num_rows:  # rows of about as many entries, however many blocks their keys have
            reach = (ends[begin - 1] if begin else 0) + PACK_ENTRIES
            end = max(begin + 1, int(np.searchsorted(ends, reach, "right")))
            own = batch.slice(begin, end - begin)
            lengths = pc.list_value_length(own.column("blocks")).to_numpy()
            held.append((own.column("blocks").flatten().to_numpy(), *(np.repeat(own.column(c).to_numpy(), lengths) for c in ("kind", "key", "value"))))
            size += len(held[-1][0])
            begin = end
            if size >= PACK_ENTRIES:
                yield rows()
                held, size = [], 0
    if size:
        yield rows()


def train_ppm(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 of the probability of a gram's last byte after its first `order` bytes, for every row of `grams`.

    `grams` holds (key, n): distinct grams of order + 1 bytes with their count in training texts, 0 for those to be scored
    only. The trie's level k is the table of the last k + 1 bytes, summed up. Where a context was seen, a symbol it
    was seen with has probability (n - ESCAPE) / T and the escape to the next shorter context has ESCAPE x D / T, T being
    the counts and D the number of its symbols. Symbols of the longer context are excluded from T and D of the shorter. Below
    level 0 the symbols never seen share the rest evenly.

    Levels join by context; only those of at most two bytes, 65,536 contexts at most, are sent to all tasks.
    """
    suffix = lambda column, k: F.col(column).bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
    levels: dict[int, DataFrame] = {}
    source = grams.where("n > 0").select("key", "n")
    for k in range(order, -1, -1):
        cut = suffix("key", k)
        source = stored(source.groupBy(cut.alias("key")).agg(F.sum("n").alias("n")), f"level{k}")
        levels[k] = source.withColumn("context", F.shiftright("key", 8))
    zero = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("d")).first()
    contexts: dict[int, DataFrame] = {}
    for k in range(order, 0, -1):
        below = levels[k - 1].select(F.col("key").alias("_below"), F.col("n").alias("_n"))
        below = F.broadcast(below) if k <= 2 else below
        excluded = levels[k].join(below, suffix("key", k - 1) == F.col("_below"))
        table = excluded.groupBy("context").agg(F.sum("n").alias(f"t{k}"), F.count(F.lit(1)).alias(f"d{k}"), F.sum("_n").alias(f"x{k}"))
        contexts[k] = stored(table.withColumnRenamed("context", f"c{k}"), f"contexts{k}")

    rows = grams.select("key")
    for k in range(order, -1, -1):
        level = levels[k].select(F.col("key").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
        rows = rows.join(F.broadcast(level) if k <= 1 else level, suffix("key", k) == F.col(f"g{k}"), "left").drop(f"g{k}")
        if k:
            context = F.broadcast(contexts[k]) if k <= 2 else contexts[k]
            rows = rows.join(context, F.shiftright(suffix("key", k), 8) == F.col(f"c{k}"), "left").drop(f"c{k}")
    rows = rows.withColumns({"t0": F.lit(zero.t), "d0": F.lit(zero.d)})

    # From the shortest context up: the value of a level is that of a symbol which no longer context was seen with.
    never = SYMBOLS - zero.d
    value = -F.log10(F.lit(float(max(never, 1))))
    for k in range(order + 1):
        t, d = F.col(f"t{k}"), F.col(f"d{k}")
        if k < order:  # without the symbols of the longer context, if that was seen
            t, d = t - F.coalesce(F.col(f"x{k + 1}"), F.lit(0)), d - F.coalesce(F.col(f"d{k + 1}"), F.lit(0))
        escape = F.when(F.coalesce(d, F.lit(0)) > 0, F.log10(ESCAPE * d / t) + value).otherwise(value)
        value = F.when(F.col(f"n{k}") > 0, F.log10((F.col(f"n{k}") - ESCAPE) / t)).otherwise(escape)
    return rows.select("key", value.alias("value"))


def _scored(batches: Iterator[pa.RecordBatch], order: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Scores of the texts of each block, whose packed values come before its texts."""
    current, packs, tables = None, {}, {}

    def find(kind: int, wanted: np.ndarray) -> np.ndarray:
        known, value = tables[kind]
        if not len(known):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, value[at], 0.0)

    for block, rest in _parts(batches):
        if block != current:
            current, packs, tables = block, {WORD: [], GRAM: []}, {}
        kinds = rest.column("kind").to_numpy()
        for i in np.flatnonzero(kinds != TEXT):
            keys, values = (np.frombuffer(rest.column(c)[int(i)].as_py(), kind) for c, kind in (("keys", np.int64), ("values", np.float64)))
            packs[int(kinds[i])].append((keys, values))
        docs = rest.filter(pa.array(kinds == TEXT))
        if docs.num_rows and not tables:
            for kind, held in packs.items():
                keys = np.concatenate([k for k, _ in held] or [np.zeros(0, np.int64)])
                by = np.argsort(keys, kind="stable")
                tables[kind] = keys[by], np.concatenate([v for _, v in held] or [np.zeros(0)])[by]
            packs = {}
            del keys, by
        for part in sliced(docs, "packed", SLICE_BYTES):
            n = part.num_rows
            hashes, owner, grams, text_of = _stream(unpack(part.column("packed")), order)
            hashes = np.concatenate([hashes, np.full(n, END_KEY, np.int64)])
            owner = np.concatenate([owner, np.arange(n)])
            words_at, word_of = np.unique(hashes, return_inverse=True)
            counts = find(WORD, words_at)[word_of]
            grams_at, gram_of = np.unique(grams, return_inverse=True)
            columns = [
                part.column("doc_id"),
                part.column("held_out"),
                pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                pa.array(np.bincount(owner, counts > 0, n).astype(np.int64)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(np.bincount(owner, np.log10((counts + 1) / (total + distinct + 1)), n)),
                pa.array(np.bincount(text_of, find(GRAM, grams_at)[gram_of], n)),
                pa.array(np.bincount(text_of, minlength=n).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: the log10 probability of its text under the model, next to an add-one word model.

    The model learns from all documents that `held_out` leaves in, and scores all. Documents go to blocks of bounded size by
    a hash. A block sends its distinct words and grams with their training counts; these are summed up by key, which makes the
    model, and each block gets back the values of its own keys alone: nothing of the model is sent to all tasks, and
    what travels grows with the text. A key comes once from a block, however often it occurs, and goes back in rows of at
    most `RANGE_BLOCKS` blocks. Words travel as 64-bit hashes.

    Null or empty text: the end alone. Null doc_id: a training document. Repeated rows: each is learned and scored. An
    empty table gives an empty table. Further columns are not read.
    """
    source = texts(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    blocks = blocks_for(source, BLOCK_BYTES)
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    blocked = placed.mapInArrow(pack_text, "doc_id long, packed binary, held_out boolean, block int")
    tasks = min(blocks, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    together = lambda df, *order: df.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions(*order)
    postings = together(blocked, "block").mapInArrow(lambda it: _postings(it, order), "block int, kind int, key long, n long")
    # A key has one entry for each block at most; rows of a key name a bounded number of blocks each, and all have its total.
    by_key = W.partitionBy("kind", "key")
    ranged = (
        postings.withColumn("range", F.floor(F.col("block") / RANGE_BLOCKS).cast("int"))
        .repartition("kind", "key")
        .groupBy("kind", "key", "range")
        .agg(F.sum("n").alias("own"), F.collect_list("block").alias("blocks"))
    )
    counted = stored(ranged.select("kind", "key", F.sum("own").over(by_key).alias("n"), (F.col("range") == F.min("range").over(by_key)).alias("once"), "blocks"), "counts")
    word_rows, gram_rows = (counted.where(F.col("kind") == kind) for kind in (WORD, GRAM))
    sums = word_rows.where("n > 0 AND once").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("words")).first()
    values = train_ppm(gram_rows.where("once").select("key", "n"), order)
    valued = word_rows.where("n > 0").select("kind", "key", F.col("n").cast("double").alias("value"), "blocks").unionByName(
        gram_rows.join(values, "key").select("kind", "key", "value", "blocks")
    )
    packed = valued.mapInArrow(_packed, "block int, kind int, keys binary, values binary")
    rows = packed.unionByName(blocked.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True)
    return together(rows, "block", "kind").mapInArrow(lambda it: _scored(it, order, sums.total, sums.words), SCHEMA)
