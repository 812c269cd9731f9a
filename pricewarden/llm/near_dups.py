"""Near duplicates by ProbMinHash: exponential arrivals per weighted shingle, banding, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import stored, texts
from pricewarden.llm.components import connected_components
from pricewarden.llm.pieces import sliced
from pricewarden.llm.words import HASHER, joined, mix, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 64, 8  # a pair at the threshold shares no band with a chance of one in 100,000
REGISTERS = BANDS * ROWS
MARGIN = 0.08  # 4.5 standard deviations of the estimate at the threshold: loses 3 pairs in a million, fewer than banding
# In mixed buckets, where all members may meet, a second signature of other draws joins the first: with twice the registers a
# margin of 0.06 is 4.8 standard deviations and loses one pair in a million.
FINE_MARGIN = 0.06
BLOCK_MEMBERS = 1_000  # members of a bucket that meet in one task


def shingles(column: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash, count) of a column, sorted; a text of fewer words is one shingle of them all."""
    data, starts = joined(column)
    begins, ends, owner = words(data, starts)
    hashes = HASHER.ranges(data, begins, ends)
    n = len(column)
    per_text = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - first[owner]
    begin = np.flatnonzero((place <= per_text[owner] - width) | (place == 0))
    with np.errstate(over="ignore"):
        total = np.zeros(len(begin), np.uint64)
        for j in range(width):
            at = begin + j
            inside = at < first[owner[begin]] + per_text[owner[begin]]
            total += np.where(inside, mix(hashes[np.minimum(at, max(len(hashes) - 1, 0))], 20 + j), np.uint64(0))
    owner, keys = owner[begin], mix(total, 30)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(change)
    return owner[at], keys[at], np.diff(np.append(at, len(owner)))


def signatures(n: int, owner: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ProbMinHash registers of n weighted sets, a byte each; texts without elements have zeros.

    Each element arrives at the times of a Poisson process of its weight, each time at a random register; a register
    keeps its earliest arrival. An element stops once its time is later than every register of its set, so a set of any
    size takes about REGISTERS x log(REGISTERS) arrivals beyond the first of each element. All draws follow from the
    hash of the element, so two sets agree in a register with their probability Jaccard similarity.
    """
    earliest = np.full(n * REGISTERS, np.inf)
    chosen = np.zeros(n * REGISTERS, np.uint64)
    time = np.zeros(len(owner))
    scale = 1.0 / weights
    active = np.arange(len(owner))
    turn = 0
    while len(active):
        draw = mix(keys[active], 100 + turn)
        register = (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        time[active] -= np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) * scale[active]
        slot = owner[active] * REGISTERS + register
        now = time[active]
        np.minimum.at(earliest, slot, now)
        won = earliest[slot] == now
        chosen[slot[won]] = keys[active[won]]
        if turn % 4 == 3 or turn < 4:
            latest = earliest.reshape(n, REGISTERS).max(axis=1) if n else np.zeros(0)
        active = active[now < latest[owner[active]]]
        turn += 1
    return (mix(chosen, 99) >> np.uint64(56)).astype(np.uint8).reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Exact probability Jaccard of n pairs, from the (pair, key, count) of either side.

    The sum over common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i); elements of equal y_i / x_i share their inner
    sum, so pairs whose common counts agree, nearly all, are done at once.
    """
    owner = np.concatenate([a[0], b[0]])
    keys = np.concatenate([a[1], b[1]])
    x = np.concatenate([a[2], np.zeros(len(b[0]), np.int64)]).astype(float)
    y = np.concatenate([np.zeros(len(a[0]), np.int64), b[2]]).astype(float)
    order = np.lexsort((keys, owner))
    owner, keys, x, y = owner[order], keys[order], x[order], y[order]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(change)
    if not len(at):
        return np.zeros(n)
    owner, x, y = owner[at], np.add.reduceat(x, at), np.add.reduceat(y, at)
    common = (x > 0) & (y > 0)
    result = np.zeros(n)
    even = np.ones(n, bool)
    even[owner[common & (x != y)]] = False
    summed = np.bincount(owner, np.maximum(x, y), n)
    shared = np.bincount(owner[common], x[common], n)
    result[even] = shared[even] / np.maximum(summed[even], 1)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for pair in np.flatnonzero(~even):
        u, v, c = x[bounds[pair] : bounds[pair + 1]], y[bounds[pair] : bounds[pair + 1]], common[bounds[pair] : bounds[pair + 1]]
        for ratio in np.unique(v[c] / u[c]):
            result[pair] += u[c & (v == ratio * u)].sum() / np.maximum(u, v / ratio).sum()
    return result


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, "text", 1 << 20, 2_000):
            owner, keys, counts = shingles(part.column("text"))
            signs = signatures(part.num_rows, owner, keys, counts)
            filled = np.zeros(part.num_rows, bool)
            filled[owner] = True
            signed = pa.array([row.tobytes() if some else None for row, some in zip(signs, filled, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "h1", "h2")] + [signed], ["doc_id", "h1", "h2", "signature"])


def _sign_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A second signature, whose draws are independent of the first one's."""
    for batch in batches:
        for part in sliced(batch, "text", 1 << 20, 2_000):
            owner, keys, counts = shingles(part.column("text"))
            signs = signatures(part.num_rows, owner, mix(keys, 77), counts)
            again = pa.array([row.tobytes() for row in signs], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("signature"), again], ["rep", "signature", "again"])


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sign_a", "sign_b"))
        near = pa.array((a == b).mean(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, "text_a"):
            sets = [shingles(part.column(c)) for c in ("text_a", "text_b")]
            near = pa.array(probability_jaccard(*sets, part.num_rows) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(near), part.column("b").filter(near)], ["a", "b"])


def _pairs_met(band: int, ids: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, signs: np.ndarray, least: float):
    """Pairs of one block of a bucket: of two components, estimated near, and not met in a bucket of an earlier band."""
    rows, others = np.flatnonzero(left), np.flatnonzero(right)
    for i in rows:
        mates = others[(component[others] != component[i]) & ((ids[others] > ids[i]) | ~left[others])]
        equal = signs[mates] == signs[i]
        near = equal.mean(axis=1) >= least
        mates, equal = mates[near], equal[near]
        mates = mates[equal[:, :REGISTERS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(mates):
            yield np.minimum(ids[i], ids[mates]), np.maximum(ids[i], ids[mates])


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of all blocks of a task; blocks arrive in order, one may go on in the next batch."""

    def done(table: pa.Table) -> pa.RecordBatch:
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if table.num_rows:
            band, ids, component, left, right = (table.column(c).to_numpy() for c in ("band", "rep", "component", "left", "right"))
            both = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("signature", "again"))
            signs = np.hstack(list(both))
            bounds = [0, *(_changes(table) + 1), table.num_rows]
            for begin, end in zip(bounds, bounds[1:], strict=False):
                at = slice(begin, end)
                for a, b in _pairs_met(band[begin], ids[at], component[at], left[at], right[at], signs[at], least):
                    low.append(a)
                    high.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], ["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        changes = _changes(table)
        if len(changes):
            yield done(table.slice(0, changes[-1] + 1))
            table = table.slice(changes[-1] + 1)
        held = table
    if held is not None:
        yield done(held)


def _changes(table: pa.Table) -> np.ndarray:
    """The last row of every block but the last one."""
    keys = [table.column(c).to_numpy() for c in ("band", "key", "x", "y")]
    return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))


def _verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    left = known.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = known.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(lambda it: _verified(it, threshold), "a long, b long")


def _texts_of_one_id(signed: DataFrame, reps: DataFrame, wordless: int | None) -> DataFrame:
    """Links between the texts of a doc_id that has several, by the smallest doc_id of each text."""
    own = signed.where(F.col("doc_id").isNotNull()).select("doc_id", "h1", "h2", F.col("signature").isNotNull().alias("full"))
    several = own.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2")])
    several = several.where("min_h1 < max_h1 OR min_h2 < max_h2").select("doc_id")
    named = own.join(several, "doc_id", "left_semi").join(reps, ["h1", "h2"], "left")
    rep = F.when(F.col("full"), F.col("rep")).otherwise(F.lit(wordless).cast("long"))
    nodes = stored(named.select("doc_id", rep.alias("b")).distinct(), "texts-of-ids")
    least = nodes.groupBy("doc_id").agg(F.min("b").alias("a"))
    return nodes.join(least, "doc_id").where("a < b").select("a", "b").distinct()


def near_duplicate_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row (doc_id, class_id) per input row: documents linked by a similarity of `threshold` or more, directly or in steps.

    The similarity is the probability Jaccard of the counts of five-word shingles; for texts that repeat no shingle it is the plain
    Jaccard similarity. A class is named after its smallest doc_id.

    1. Equal texts are folded to their smallest doc_id by hash; only these are compared, and copies join their class.
    2. Each band of eight registers puts a text in a bucket. Every member is compared with the bucket's smallest id: linear in the bucket. Pairs that the signatures estimate within MARGIN of the threshold are verified on their texts.
    3. Links make components. Buckets that hold members of two or more components are compared in full, in blocks of bounded size inside tasks; only pairs that two signatures together estimate near and that no earlier band has seen come out, and are verified. No pair
       of a bucket is left out, and pairs already in one component cost nothing.

    Null or empty texts, and others without a word, are equal as words go: they are one class. Null doc_id: a class of null. Repeated rows: each
    has its row in the same class. Different texts of one doc_id: one document, linked by either text. Further columns are not read.
    """
    source = texts(docs, id_col, text_col)
    hashed = source.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    signed = stored(hashed.mapInArrow(_sign, "doc_id long, h1 long, h2 long, signature binary"), "signatures")
    full = signed.where(F.col("signature").isNotNull() & F.col("doc_id").isNotNull())
    reps = stored(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "representatives")

    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda j: F.struct(j.alias("band"), F.xxhash64(j, F.substring("signature", j * ROWS + 1, F.lit(ROWS))).alias("key")),
    )
    placed = reps.select("rep", F.inline(bands))
    shared = stored(placed.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").drop("last"), "buckets")
    members = stored(placed.join(shared, ["band", "key"]), "members")
    candidates = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()

    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi")
    found = hashed.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "h1", "h2"])
    known = stored(found.groupBy("rep", "h1", "h2").agg(F.min("text").alias("text"), F.first("signature").alias("signature")), "texts")
    left = known.select(F.col("rep").alias("a"), F.col("signature").alias("sign_a"))
    right = known.select(F.col("rep").alias("b"), F.col("signature").alias("sign_b"))
    near = candidates.join(left, "a").join(right, "b").mapInArrow(lambda it: _estimated(it, threshold - MARGIN), "a long, b long")
    links = stored(_verify(stored(near, "near"), known, threshold), "links")

    component = connected_components(links)
    labelled = members.join(component, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("band", "key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low < high AND n > 2").select("band", "key", F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    mixed = stored(mixed, "mixed")
    meeting = labelled.join(mixed, ["band", "key"], "left_semi").select("rep").distinct()
    # A document of several texts has both signatures of each; any pair of them may bring its link.
    signs = known.select("rep", "signature", "text").join(meeting, "rep", "left_semi")
    signs = stored(signs.mapInArrow(_sign_again, "rep long, signature binary, again binary"), "both-signatures")
    blocked = labelled.join(mixed, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A member goes to every pair of blocks that its own block is part of: (own, own) and each (lower, higher).
    spread = blocked.select(
        "band", "key", "rep", "component", "own",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))).alias("at"),
    ).select("band", "key", "rep", "component", "at.x", "at.y", (F.col("own") == F.col("at.x")).alias("left"), (F.col("own") == F.col("at.y")).alias("right"))
    met = (
        spread.join(signs, "rep")
        .repartition("band", "key", "x", "y")
        .sortWithinPartitions("band", "key", "x", "y")
        .mapInArrow(lambda it: _met(it, threshold - FINE_MARGIN), "a long, b long")
    )
    more = stored(_verify(stored(met, "met"), known, threshold), "more-links")
    wordless = signed.where(F.col("signature").isNull()).agg(F.min("doc_id")).first()[0]
    named = reps.select("h1", "h2", "rep")
    same = _texts_of_one_id(signed, named, wordless)
    classes = connected_components(links.unionByName(more).unionByName(same))

    of_text = reps.join(classes, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("class_id"))
    keyed = signed.select("doc_id", "h1", "h2", F.col("signature").isNotNull().alias("full"))
    # Texts without words have one class, which a document of several texts may have joined to another.
    joined_to = classes.where(F.col("node") == F.lit(wordless).cast("long")).select("component").first()
    empty = joined_to.component if joined_to is not None else wordless
    found = F.when(F.col("full"), F.col("class_id")).otherwise(F.lit(empty).cast("long"))
    return keyed.join(stored(of_text, "text-classes"), ["h1", "h2"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), found).alias("class_id")
    )


def keep_first_of_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the smallest doc_id of each class, all columns; rows that repeat its id and text come down to one.

    A document that has several texts keeps them all. Rows without doc_id stay: they belong to no class.
    """
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__first")).distinct()
    kept = docs.join(first, F.col(f"`{id_col}`").cast("long") == F.col("__first"), "left_semi")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    once = kept.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(7), text)}).dropDuplicates([id_col, "__h1", "__h2"])
    return once.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
