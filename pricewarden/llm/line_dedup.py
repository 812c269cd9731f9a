"""Repeated lines across documents: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import BLANKS, let, stored, texts

MIN_CHARS = 10  # shorter keys are never dropped
MIN_DOCS = 2  # documents that must hold a key


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row (doc_id, text, n_lines, n_dropped) per input row; `text` keeps the lines that stay.

    A text is split at `\\n`. A key of at least `min_chars` code points that `min_docs` or more documents hold loses all its
    lines, except those of the smallest doc_id holding it. Keys travel as two 64-bit hashes, positions as numbers: the text
    of a line never leaves its document. Counting goes over (key, document) pairs, folded before each shuffle, and only
    keys over the threshold meet the lines again, in a join that splits hot keys.

    Null or empty text: one empty line, kept. Null doc_id: larger than every other, all such rows are one document to the count. Repeated
    rows of one doc_id: one document to the count; each keeps the lines its doc_id may keep. Further columns are left out.
    """
    source = _marked(texts(docs, id_col, text_col))
    joined = source.join(_dropped(source, min_chars, min_docs), ["__doc", "__mark"], "left")
    n_lines = F.size(F.split("text", "\n"))
    return joined.select(
        "doc_id",
        _rest(F.col("text")).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )


def keep_new_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The same rows and columns, each text without the lines it loses. Null text stays null."""
    source = _marked(texts(docs, id_col, text_col))
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"__doc": _doc(F.col(f"`{id_col}`").cast("long")), "__mark": F.xxhash64(F.coalesce(text, F.lit("")))})
    joined = keyed.join(_dropped(source, min_chars, min_docs), ["__doc", "__mark"], "left")
    return joined.select(*[_rest(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _doc(doc_id: Column) -> Column:
    """Null is larger than every other id."""
    return F.coalesce(doc_id, F.lit((1 << 63) - 1))


def _marked(source: DataFrame) -> DataFrame:
    return source.withColumns({"__doc": _doc(F.col("doc_id")), "__mark": F.xxhash64("text")})


def _rest(text: Column) -> Column:
    """The text without its lines at the positions `__gone`; array_except keeps the others in order."""
    n_lines = F.size(F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__gone"))
    rest = let(F.split(text, "\n"), lambda lines: F.transform(stay, lambda i: F.get(lines, i)))
    return F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(rest, "\n"))


def _dropped(source: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(__doc, __mark, __gone): the positions of the lines that a document loses."""
    lines = source.select(F.col("__doc").alias("doc"), F.col("__mark").alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = (
        lines.where(F.char_length("line") >= min_chars)
        .select("doc", "mark", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    if min_docs == 2:  # two documents differ exactly if the smallest and the largest do
        held = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
        shared = held.where("first_doc < last_doc").drop("last_doc")
    else:
        held = keyed.select("h1", "h2", "doc").distinct().groupBy("h1", "h2")
        held = held.agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("docs"))
        shared = held.where(F.col("docs") >= min_docs).drop("docs")
    return (
        keyed.join(stored(shared, "shared-lines"), ["h1", "h2"])  # from a table, so that the join may split hot keys
        .where("doc > first_doc")
        .select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), "pos")
        .groupBy("__doc", "__mark")  # at most the lines of one text; rows that repeat a document name each position once
        .agg(F.collect_set("pos").alias("__gone"))
    )
