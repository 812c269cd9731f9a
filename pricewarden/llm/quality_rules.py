"""Quality rules by distribution: character classes and common words against references of the languages.

Everything here is made of DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import SPACES, let, stored, texts

# Frequent function words of the languages; together they are the bins of the word histogram.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "by", "this", "from", "or"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "avec", "au", "ce"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una", "su", "al", "es", "lo"),
}
BINS = tuple(sorted({word for words in COMMON_WORDS.values() for word in words}))
# The character classes, as Java patterns of what lies outside them; the last bin holds all other characters.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\s", r"[.,;:!?'\"()\-]", r"[#*$%&|<>{}\[\]\\^~_=+@/]")
MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_CLASS_CHARS = 200  # below: the character histogram is too thin to judge
MIN_HISTOGRAM_WORDS = 50  # below: so is the word histogram
MAX_CLASS_DISTANCE = 0.30  # alone enough to reject
ODD_CLASS_DISTANCE, ODD_WORD_DISTANCE = 0.17, 0.28  # enough together
# Parameters of `apply_quality_rules`, which the README states.
MIN_REFERENCE_DOCS = 20  # a language of fewer documents has no reference, so its documents meet the plain rules alone
PSEUDO_DOC_CHARS = 2_000  # one document adds at most this weight to a reference, so no long text rules it
MAX_LANGUAGES = 1_000  # references that become literals of the plan; more than languages are written, an error beyond


def words_of(text: Column) -> Column:
    """The words of a text, no empty ones."""
    return F.filter(F.split(text, rf"[{SPACES}]+"), lambda w: w != "")


def _length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the text, the first find included.

    Windows are compared by a 64-bit hash chained over their words. Only a text in which two windows are equal pays for
    finding where.
    """
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("i"))))

        def places(found: Column) -> Column:
            same = lambda a, b: F.coalesce(a["key"] == b["key"], F.lit(False))
            kept = F.filter(found, lambda x, i: same(F.get(found, i - 1), x) | same(F.get(found, i + 1), x))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        # Each window covers up to three words, fewer where the next one begins earlier.
        step = lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        spans = let(placed, lambda found: let(places(found), step))
        return F.aggregate(spans, F.lit(0), lambda total, x: total + x)

    return let(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(F.lit(0)))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: the counts of the rules, the class histogram and the common-word histogram, as long arrays.

    `mark` is a hash of the text; with the id it tells rows of different texts apart.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), lang.alias("lang")
    )
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACES}]"))
    inside = [F.char_length(text) - _length_without(text, p) for p in CLASSES]
    bins = F.array(*[F.lit(word) for word in BINS])
    # Words of the lists, as numbers from 1; punctuation at the end of a word is not part of it.
    def word_counts(words: Column) -> Column:
        plain = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
        common = F.filter(plain, lambda w: w.isin(*BINS))
        codes = F.transform(common, lambda w: F.array_position(bins, w).cast("int"))
        count = lambda found: F.array(*[F.size(found) - F.size(F.array_remove(found, k)) for k in range(1, len(BINS) + 1)])
        return let(codes, count)

    counted = let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            word_counts(words).cast("array<long>").alias("word_bins"),
        ),
    )
    return source.select(
        "doc_id",
        "lang",
        F.xxhash64(text).alias("mark"),
        counted.alias("c"),
        _length_without(text, rf"[{SPACES}]").cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        F.array(*inside, F.char_length(text)).cast("array<long>").alias("class_bins"),
    ).select("doc_id", "lang", "mark", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "class_bins", "c.word_bins")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: x / F.greatest(t, F.lit(1e-300))))


def class_histogram(class_bins: Column) -> Column:
    """Counts per class with what lies in none of them; the last entry of `class_bins` is the length of the text."""
    n = len(CLASSES)
    rest = F.get(class_bins, n) - reduce(lambda a, b: a + b, [F.get(class_bins, i) for i in range(n)])
    return F.transform(F.concat(F.slice(class_bins, 1, n), F.array(F.greatest(rest, F.lit(0)))), lambda x: x.cast("double"))


def word_histogram() -> Column:
    """Counts of the common words; the last bin holds all other words."""
    common = F.aggregate("word_bins", F.lit(0).cast("long"), lambda t, x: t + x)
    return F.transform(F.concat("word_bins", F.array(F.col("n_words") - common)), lambda x: x.cast("double"))


def learn_references(
    measured: DataFrame, min_docs: int = MIN_REFERENCE_DOCS, pseudo_chars: int = PSEUDO_DOC_CHARS
) -> list[tuple[str, list[float], list[float]]]:
    """Reference histograms (lang, classes, words) of every language of which enough documents pass the plain rules.

    All such documents count; a long one is scaled down to a bounded weight, so that it can't rule its language. Folded
    before the shuffle to one row per language. Character classes need no word list, so every script has its reference; in
    languages without a list of common words the word histogram has one bin and says nothing.
    """
    n_class, n_word = len(CLASSES) + 1, len(BINS) + 1
    good = measured.where(F.col("lang").isNotNull() & ~base_failed())
    weight = F.least(F.lit(1.0), F.lit(float(pseudo_chars)) / F.greatest(F.get("class_bins", n_class - 1), F.lit(1)))
    rows = good.select("lang", weight.alias("w"), class_histogram(F.col("class_bins")).alias("h"), word_histogram().alias("v"))
    sums = [F.sum(F.get("h", i) * F.col("w")).alias(f"c{i}") for i in range(n_class)]
    sums += [F.sum(F.get("v", i) * F.col("w")).alias(f"w{i}") for i in range(n_word)]
    folded = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *sums).where(F.col("docs") >= min_docs)
    shared = folded.select(
        "lang",
        _shares(F.array(*[F.col(f"c{i}") for i in range(n_class)])).alias("classes"),
        _shares(F.array(*[F.col(f"w{i}") for i in range(n_word)])).alias("words"),
    )
    found = shared.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError("the language column holds more values than there are languages")
    return sorted((row.lang, list(row.classes), list(row.words)) for row in found)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, between 0 and 1 (logarithms to base 2)."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda t, x: t + x) / 2, F.lit(0.0)))


def judge(measured: DataFrame, references: list[tuple[str, list[float], list[float]]]) -> DataFrame:
    """Adds class_distance, word_distance, base_failed and kept.

    A document is compared with the reference of its language. One without a language is compared with all references, of which
    the nearest counts; one of a language that has none meets the plain rules alone. `references` holds one entry per language
    and becomes literals of the plan.
    """

    def nearest(counts: Column, position: int) -> Column:
        if not references:
            return F.lit(None).cast("double")
        shares = _shares(counts)
        known = F.create_map(*[c for ref in references for c in (F.lit(ref[0]), F.array(*[F.lit(float(x)) for x in ref[position]]))])

        def chosen(p: Column) -> Column:
            every = F.array_min(F.transform(F.map_values(known), lambda ref: jensen_shannon(p, ref)))
            own = let(F.try_element_at(known, F.col("lang")), lambda ref: F.when(ref.isNotNull(), jensen_shannon(p, ref)))
            return F.when(F.col("lang").isNull(), every).otherwise(own)

        return let(shares, chosen)

    length = F.get("class_bins", len(CLASSES))
    judged = measured.select(
        *measured.columns,
        F.when(length >= MIN_CLASS_CHARS, nearest(class_histogram(F.col("class_bins")), 1)).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_HISTOGRAM_WORDS, nearest(word_histogram(), 2)).alias("word_distance"),
        base_failed().alias("base_failed"),
    )
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    odd = (by_class > MAX_CLASS_DISTANCE) | ((by_class > ODD_CLASS_DISTANCE) & (by_word > ODD_WORD_DISTANCE))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd)


def apply_quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_docs: int = MIN_REFERENCE_DOCS, pseudo_chars: int = PSEUDO_DOC_CHARS,
) -> DataFrame:
    """One row per input row: the counts, both distances (null under the length guards), base_failed, kept.

    Null or empty text: no words, so base_failed. Null language: the nearest reference counts. A language without a reference:
    no distances, only the base rules decide. Repeated rows: each gets its own equal row. Texts of any length are
    measured whole. Columns besides the three are not read.
    """
    measured = stored(features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    first = judge(measured, learn_references(measured, min_docs, pseudo_chars))
    trimmed = first.where("kept").select(*measured.columns)  # references once more, without what they reject
    return judge(measured, learn_references(trimmed, min_docs, pseudo_chars))


def reject_low_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, all columns. Rows of one id, text and language are kept or go together."""
    judged = apply_quality_rules(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("lang").alias("__lang")).distinct()
    own = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("__mark"))
    return docs.join(rejected, same & own.eqNullSafe(F.col("__lang")), "left_anti")
