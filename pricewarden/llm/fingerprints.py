"""I-Match fingerprints: distinct terms in a band of inverse document frequency, hashed under randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.llm.common import stored, texts
from pricewarden.llm.pieces import pack_text, sliced, unpack
from pricewarden.llm.words import mix, terms

MIN_IDF, MAX_IDF = math.log(8), math.log(2000)  # terms in one document of 8 to one of 2000
LEVELS, PER_LEVEL = 10, 6  # subsets of level j keep a term with probability 2^-(j+1)
SUBSETS = LEVELS * PER_LEVEL
HASH_BYTES = 3  # of each subset in the fingerprint
CUT_SAMPLE = 200  # ids drawn for each stretch of the order of documents
LOWEST, HASH_TOP = -(1 << 63), (1 << 63) - 1
FLUSH_TERMS = 1 << 20  # distinct terms a task holds before it sends its counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(sums)], ["term", "df"])

    for batch in batches:
        for part in sliced(batch, "text"):
            own, n = np.unique(terms(part.column("text"))[1], return_counts=True)
            held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, n]), len(held)).astype(np.int64)
            if len(held) > FLUSH_TERMS:
                yield rows()
                held, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(held):
        yield rows()


def learn_lexicon(docs: DataFrame, *, text_col: str = "text", min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> np.ndarray:
    """Sorted hashes of the terms whose inverse document frequency over all documents lies in the band.

    A term of the band is in at least N e^-max_idf documents, so there are at most D e^max_idf of them, where D is the mean
    number of distinct terms of a document: the size does not depend on the number of documents. This is what makes it fit
    to be sent to every task.
    """
    source = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = source.count()
    counted = source.mapInArrow(_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    found = counted.where((idf >= min_idf) & (idf <= max_idf)).select("term").toArrow().column(0)
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def _masks(hashes: np.ndarray) -> np.ndarray:
    """For each term, the set of subsets that keep it, as bits."""
    bits = np.zeros(len(hashes), np.uint64)
    for level in range(LEVELS):
        draw = mix(hashes, 1000 + level)
        for r in range(PER_LEVEL):  # level + 1 own bits of the draw must be zero
            own = (draw >> np.uint64(r * (level + 1))) if (r + 1) * (level + 1) <= 64 else mix(hashes, 2000 + 10 * level + r)
            keep = (own & np.uint64((1 << (level + 1)) - 1)) == 0
            bits |= keep.astype(np.uint64) << np.uint64(level * PER_LEVEL + r)
    return bits


def fingerprint(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row of SUBSETS hashes per text; 0 where a subset keeps none of its terms.

    A subset's hash adds up the scrambled hashes of its distinct terms, which says the same as hashing them in sorted order.
    A text without a term of the lexicon is described by all its terms, so that short texts differ too.
    """
    n = len(column)
    owner, hashes = terms(column)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        kept = lexicon[at] == hashes
    else:
        kept = np.zeros(len(hashes), bool)
    known = np.zeros(n, bool)
    known[owner[kept]] = True
    kept |= ~known[owner]
    owner, hashes = owner[kept], hashes[kept]
    out = np.zeros((n, SUBSETS), np.uint64)
    if not len(owner):
        return out
    bits = _masks(hashes)
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    mixed = mix(hashes, 7)
    with np.errstate(over="ignore"):
        for k in range(SUBSETS):
            chosen = ((bits >> np.uint64(k)) & np.uint64(1)).astype(bool)
            out[owner[begins], k] = np.add.reduceat(np.where(chosen, mixed, np.uint64(0)), begins)
        some = out != 0
        out = mix(out, 11) >> np.uint64(64 - 8 * HASH_BYTES)
    out[some & (out == 0)] = 1
    out[~some] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal subsets among those that keep a term of either text; two texts without any term are equal."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def _bytes(prints: np.ndarray) -> pa.Array:
    raw = prints.astype(">u8").view(np.uint8).reshape(len(prints), SUBSETS, 8)[:, :, 8 - HASH_BYTES :]
    return pa.array([row.tobytes() for row in np.ascontiguousarray(raw)], pa.binary())


def _numbers(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SUBSETS, HASH_BYTES)
    out = np.zeros(raw.shape[:2], np.uint64)
    for i in range(HASH_BYTES):
        out = out << np.uint64(8) | raw[:, :, i].astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, lexicon: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint) per input row: SUBSETS hashes in hexadecimal. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _bytes(fingerprint(part.column("text"), lexicon))], ["doc_id", "fingerprint"])

    found = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint binary")
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _compared(ids: pa.Array, own: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray, lexicon: np.ndarray) -> list[pa.Array]:
    edited = [edited_text(a, b) for a, b in zip(own, following, strict=True)]
    edited_prints = fingerprint(pa.array(edited, pa.string()), lexicon)
    return [
        ids,
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        _bytes(prints),
        _bytes(edited_prints),
        pa.array(likeness(prints, edited_prints)),
        pa.array(likeness(prints, next_prints)),
    ]


def _cuts(docs: DataFrame, id_col: str, tasks: int) -> list[tuple[int, int]]:
    """Where the descending order of ids is cut into `tasks` stretches of about as many rows: (id, hash) each stretch ends before.

    Taken from a sample of the ids alone, about CUT_SAMPLE rows a stretch; it only balances the work. An id that fills several
    stretches is cut by the hash of its texts.
    """
    ids = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("id"))
    n = ids.count()
    share = min(1.0, CUT_SAMPLE * tasks / max(n, 1))
    drawn = np.sort(ids.sample(share, seed=7).toArrow().column(0).to_numpy())[::-1]
    if not len(drawn):
        return []
    picked = [int(drawn[k * len(drawn) // tasks]) for k in range(1, tasks)]
    cuts = []
    for value in sorted(set(picked), reverse=True):
        many = picked.count(value)
        cuts += [(value, HASH_TOP - (2 * HASH_TOP + 1) * k // many) for k in range(many)]
    return cuts


def _walk(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one stretch, each compared with the one after it. The first brings its text along, and so does the last, which waits for its next."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    held: tuple | None = None
    part = head = None

    def rows(columns: list[pa.Array], first: str | None, last: str | None) -> pa.RecordBatch:
        n = len(columns[0])
        heads, tails = pa.array([first, *[None] * (n - 1)], pa.string()), pa.array([*[None] * (n - 1), last], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *columns, heads, tails], ["part", *NAMES, "head", "tail"])

    for batch in batches:
        for some in sliced(batch, "packed"):
            column = unpack(some.column("packed"))
            part = some.column("part")[0].as_py()
            prints = fingerprint(column, lexicon)
            ids, own = some.column("doc_id"), column.to_pylist()
            if held is None:
                head = own[0]
            else:
                ids, own, prints = pa.concat_arrays([held[0], ids]), [held[1], *own], np.concatenate([held[2], prints])
            n = len(own)
            if n > 1:
                yield rows(_compared(ids[: n - 1], own[: n - 1], own[1:], prints[: n - 1], prints[1:], lexicon), head, None)
                head = None
            held = ids[n - 1 :], own[-1], prints[n - 1 :]
    if held is not None:
        none = [pa.nulls(1, kind) for kind in kinds]
        yield rows([held[0], none[1], none[2], _bytes(held[2]), *none[4:]], head, held[1])


def edit_stability(docs: DataFrame, lexicon: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document, of its edited text, and how alike they and the next document's are.

    The next document is the one before in doc_id order, after the smallest comes the largest. Documents are dealt to stretches of
    the descending order and walked there one after the other, a slice at a time, so a text moves once and no group is held,
    however long its texts are or however often an id repeats. The last of a stretch meets the first of the next one by a join of
    one row per stretch.

    Null or empty text: empty; its fingerprint is all zeros. Null doc_id: smaller than every other. Repeated ids follow
    each other by a hash of their texts. A single row is its own next document. Further columns are not read.
    """
    lexicon = learn_lexicon(docs, text_col=text_col) if lexicon is None else lexicon
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(docs, id_col, tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The complement of a number reverses the order of numbers; cuts fall, so their complements rise.
        bounds = np.array([(~i, ~h) for i, h in cuts], [("id", "i8"), ("h", "i8")])
        for batch in batches:
            keys = np.empty(batch.num_rows, bounds.dtype)
            keys["id"] = ~pc.fill_null(batch.column("doc_id"), LOWEST).to_numpy(zero_copy_only=False)
            keys["h"] = ~batch.column("h").to_numpy()
            order = np.searchsorted(bounds, keys, "left")
            yield from pack_text([batch.append_column("part", pa.array(order.astype(np.int32)))])

    source = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    dealt = source.select("doc_id", "h", "text").mapInArrow(deal, "doc_id long, h long, packed binary, part int")
    walked = dealt.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    met = stored(walked.mapInArrow(lambda it: _walk(it, lexicon), f"part int, {_COLUMNS}, head string, tail string"), "neighbours")
    heads = met.where(F.col("head").isNotNull()).select("part", "head", F.col("fingerprint").alias("head_print"))
    # One row per stretch: a window without a key is bounded by the number of tasks.
    following = heads.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    pairs = (
        met.where(F.col("tail").isNotNull())
        .select("part", "doc_id", "tail", "fingerprint")
        .join(following, "part")
        .join(heads.withColumnRenamed("part", "next_part"), "next_part")
        .select("doc_id", "tail", "fingerprint", "head", "head_print")
    )

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "tail"):
                arrays = _compared(
                    part.column("doc_id"), part.column("tail").to_pylist(), part.column("head").to_pylist(),
                    _numbers(part.column("fingerprint")), _numbers(part.column("head_print")), lexicon,
                )
                yield pa.RecordBatch.from_arrays(arrays, NAMES)

    rows = met.where(F.col("tail").isNull()).select(*NAMES).unionByName(pairs.mapInArrow(across, _COLUMNS))
    written = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return rows.withColumns(written)
