"""Source divergence audit: how far the terms of each source of a language lie from the other sources and from the language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.llm.common import stored
from pricewarden.llm.numbering import numbered, positions
from pricewarden.llm.pieces import sliced
from pricewarden.llm.words import LOWER, joined, words

MIN_DOCS = 10  # documents of a language that hold a kept term
TOP = 10  # ranks of the part `term`
SCALE = 1_000_000_000
CHUNK_CELLS = 1 << 18  # entries of a table of kept terms by sources that is compared at a time
SLICE_BYTES = 2 << 20  # text counted at a time

# Letters of ASCII and every byte of a character outside ASCII; all else separates terms.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

COUNTS = "lang string, source string, term string, n long, docs long"
HEADER, TERM = 0, 1


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.ascontiguousarray(data[positions(begins, sizes)])
    return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a slice, by language and source."""
    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            groups: dict[tuple[str, str], int] = {}
            pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(g, len(groups)) for g in pairs], np.int64)
            data, starts = joined(part.column("text"))
            data = LOWER[data]
            begins, ends, owner = words(data, starts, NO_TERM)
            first, term = numbered(data, begins, ends)
            if not len(first):
                continue
            held, n = np.unique(owner * len(first) + term, return_counts=True)
            keys, at = np.unique(group[held // len(first)] * len(first) + held % len(first), return_inverse=True)
            names, of = list(groups), keys // len(first)
            own = first[keys % len(first)]
            columns = [
                pa.array([x for x, _ in names]).take(pa.array(of)),
                pa.array([x for _, x in names]).take(pa.array(of)),
                _strings(data, begins[own], ends[own]),
                pa.array(np.bincount(at, n, len(keys)).astype(np.int64)),
                pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source, and the documents of that source that hold it."""
    column = lambda name, alias: F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(alias)
    source = docs.select(column(lang_col, "lang"), column(source_col, "source"), column(text_col, "text"))
    return source.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = (whole(count) + F.lit(2)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, whole(total) + whole(terms) * F.lit(2))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares reach SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed distances of all pairs of sources over the terms of each (lang, chunk); a chunk's header rows come first."""
    current, sources, shares, terms = None, {}, [], []

    def rows() -> pa.RecordBatch:
        names = list(sources)
        table = np.repeat(np.array(shares, np.int64)[None, :], len({t for t, _, _ in terms}), axis=0)
        number: dict[str, int] = {}
        for term, source, p in terms:
            table[number.setdefault(term, len(number)), sources[source]] = p
        own, other, value = [], [], []
        for k in range(len(names) - 1):
            near, rest = table[:, k : k + 1], table[:, k + 1 :]
            value += ((rest - near) ** 2 // (rest + near)).sum(axis=0).tolist()
            own += [names[k]] * (len(names) - 1 - k)
            other += names[k + 1 :]
        lang = pa.array([current[0]] * len(own), pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(own, pa.string()), pa.array(other, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "other", "value"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "kind", "source", "term", "p")), strict=True):
            lang, chunk, kind, source, term, p = row
            if (lang, chunk) != current:
                if current is not None:
                    yield rows()
                current, sources, shares, terms = (lang, chunk), {}, [], []
            if kind == HEADER:
                sources[source] = len(shares)
                shares.append(p)
            else:
                terms.append((term, source, p))
    if current is not None:
        yield rows()


def source_divergence(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part `pair`: every other source of the language, by the distance of the term shares of both, summed over the language's
    kept terms. Part `term`: the `top` terms that the source uses more than the language does.

    Terms are counted per slice of documents, summed by key, and kept where at least `min_docs` documents of the language hold
    them. For the terms, a language's and a source's count fix the value, so the terms of a group are folded to cells of
    both counts; cells are valued, those of one value are merged, and the best values are taken until their multiplicities
    reach `top`. Only the terms of these cells are read again and put in order. For the pairs, kept terms are dealt in
    chunks; a chunk is a table of terms by sources of bounded size, and its sums are added up by pair. No source's or
    language's terms come together in one task; what does are the sources of a language, whose pairs are the result.

    Null lang, source or text count as empty. Texts without terms still make their group occur. Repeated rows count each.
    Equal values are ordered by item. An empty table gives an empty table. Further columns are not read.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "terms")
    by_term = W.partitionBy("lang", "term")
    summed = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(by_term).alias("nl"), F.sum("docs").over(by_term).alias("_docs"),
        (F.col("source") == F.min("source").over(by_term)).cast("long").alias("once"),
    )
    kept = stored(summed.where(F.col("_docs") >= min_docs).drop("_docs"), "kept")

    column = lambda name, alias: F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(alias)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = docs.select(column(lang_col, "lang"), column(source_col, "source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("once").alias("terms"))
    by_lang = W.partitionBy("lang")
    stats = groups.join(own, ["lang", "source"], "left").select(
        "lang", "source", zero(F.col("total")).alias("total"), zero(F.sum("total").over(by_lang)).alias("total_l"),
        zero(F.sum("terms").over(by_lang)).alias("terms"), F.count(F.lit(1)).over(by_lang).alias("sources"),
    )
    stats = stored(stats, "groups")
    valued = kept.join(stats, ["lang", "source"]).select(
        "lang", "source", "term", "n", "nl", "terms", "sources",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("nl"), F.col("total_l"), F.col("terms")).alias("q"),
    )

    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") * F.col("sources") / CHUNK_CELLS))
    header = stats.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), F.lit(HEADER).alias("kind"), "source",
        F.lit(None).cast("string").alias("term"),
        # Without a kept term nothing is compared, and the table has no rows.
        F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1).alias("p"),
    )
    body = valued.select("lang", F.pmod(F.xxhash64("term"), chunks).alias("chunk"), F.lit(TERM).alias("kind"), "source", "term", "p")
    chunked = header.unionByName(body).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "kind", "source")
    halves = chunked.mapInArrow(_compared, "lang string, source string, other string, value long")
    sums = halves.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    mirrored = sums.select("lang", "value", both.alias("_side")).select("lang", "_side.source", "_side.item", "value")
    order = [F.col("value").desc(), F.col("item")]
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", rank]
    pairs = mirrored.select(*columns("pair"))

    cells = valued.where("p > q").groupBy("lang", "source", "n", "nl").agg(F.first("p").alias("p"), F.first("q").alias("q"), F.count(F.lit(1)).alias("many"))
    values = cells.groupBy("lang", "source", distance(F.col("p"), F.col("q")).alias("value")).agg(F.sum("many").alias("many"))
    falling = W.partitionBy("lang", "source").orderBy(F.col("value").desc())
    best = values.withColumn("_at", F.row_number().over(falling)).where(F.col("_at") <= top)
    before = F.coalesce(F.sum("many").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("_before", before).where(F.col("_before") < top).select("lang", "source", "value")
    terms = valued.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    expanded = terms.join(best, ["lang", "source", "value"]).select(*columns("term")).where(F.col("rank") <= top)
    return pairs.unionByName(expanded)
