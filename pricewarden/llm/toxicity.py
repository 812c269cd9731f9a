"""Toxicity by a weighted finite-state grammar over clauses: insult, threat, target, negation and reported speech."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import stored, texts
from pricewarden.llm.pieces import sliced

# Words of the grammar in English, French, German and Spanish.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "crétin", "imbécile", "connard", "dummkopf", "arschloch", "estúpido", "imbécil")
THREATS = ("kill", "destroy", "hurt", "crush", "tuer", "frapper", "töten", "schlagen", "matar", "golpear")
TARGETS = ("you", "your", "you're", "he", "she", "they", "tu", "vous", "toi", "du", "ihr", "dich", "ustedes", "usted", "ellos")
NEGATIONS = ("not", "never", "isn't", "aren't", "pas", "jamais", "nicht", "kein", "nie", "nunca", "jamás")
REPORTS = ("said", "says", "called", "quoted", "wrote", "dit", "sagte", "schrieb", "dijo", "escribió")

SAMPLE_ROWS = 20_000  # labelled rows at most that the lexicon and the weights are fitted on
MAX_STEMS = 4_000  # learned stems at most: the top of their list
MIN_CONTEXTS = 5  # different words before a stem in toxic texts, so that copies of one text can't make a stem
MIN_ODDS = 3.0  # log odds a stem needs
STEM_CHARS = (3, 4, 5, 6)
FOLDS, HELD_OUT = 5, 0
SCOPE = 4  # words a target, a negation or a threat reaches

_FOLD = {c: c + 32 for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}
_BREAKS = re.compile(r"[.!?;\n|]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# Tags of words, the input alphabet of the transducers.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
FEATURES = ("insult", "aimed", "negated", "reported", "threat", "strength", "clauses", "density")


@dataclass
class Transducer:
    """A finite-state machine over tags: after a trigger it marks `marks` for the next `reach` words (0: to the clause's end)."""

    trigger: int
    marks: int
    reach: int
    state: int = field(default=0, init=False)

    def step(self, tag: int) -> bool:
        """Reads one tag; whether the machine accepts: the tag is marked and a trigger is in reach."""
        accepts = tag == self.marks and self.state > 0
        if tag == self.trigger:
            self.state = self.reach or 1 << 30
        elif self.state:
            self.state -= 1
        return accepts


def clause_features(tags: list[int], strengths: list[float]) -> np.ndarray:
    """Runs the composed machines over one clause; each insult or threat gets one reading.

    Negated and reported insults are read as such and no longer as plain ones; an insult with a target before or after it
    in reach is aimed. `strengths` holds the learned log odds of each insult.
    """
    out = np.zeros(len(FEATURES))
    negation, report = Transducer(NEGATION, INSULT, SCOPE), Transducer(REPORT, INSULT, 0)
    before, after = Transducer(TARGET, INSULT, SCOPE), Transducer(INSULT, TARGET, SCOPE)
    threat = Transducer(THREAT, TARGET, SCOPE)
    for tag, strength in zip(tags, strengths, strict=True):
        negated, reported, aimed, back, threatens = (m.step(tag) for m in (negation, report, before, after, threat))
        if tag == INSULT:
            kind = 2 if negated else 3 if reported else 1 if aimed else 0
            out[kind] += 1
            out[5] += strength if kind < 2 else 0.0
        elif back and out[0] > 0:  # the target follows its insult
            out[0] -= 1
            out[1] += 1
        out[4] += threatens
    out[6] = float(out[:5].sum() > 0)
    return out


class Grammar:
    """The lexicon as one automaton over whole texts, and the machines over the clauses it finds."""

    def __init__(self, stems: Iterable[tuple[str, float]]):
        self.stems = dict(stems)
        self.tags = {w: tag for tag, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        for word in INSULTS:
            self.stems.setdefault(word + "$", MIN_ODDS)
        self.finder = ahocorasick.Automaton()
        for stem in self.stems:
            self.finder.add_word(stem.rstrip("$"), stem.rstrip("$"))
        for word in THREATS:
            self.finder.add_word(word, word)
        self.finder.make_automaton()

    def strength(self, word: str) -> float | None:
        """Log odds of a word: its own as a whole, else of its longest stem."""
        if word + "$" in self.stems:
            return self.stems[word + "$"]
        for n in range(min(len(word), max(STEM_CHARS)), min(STEM_CHARS) - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return None

    def features(self, text: str) -> np.ndarray:
        folded = text.translate(_FOLD)
        starts = set()
        for end, word in self.finder.iter(folded):
            begin = end - len(word) + 1
            if begin == 0 or not folded[begin - 1].isalnum():
                starts.add(begin)
        total = np.zeros(len(FEATURES))
        if not starts:
            return total
        breaks = [m.start() for m in _BREAKS.finditer(folded)]
        for clause in sorted({bisect_right(breaks, at) for at in starts}):
            piece = folded[breaks[clause - 1] + 1 if clause else 0 : breaks[clause] if clause < len(breaks) else len(folded)]
            tags, strengths = [], []
            for word in _WORD.findall(piece):
                odds = self.strength(word)
                tags.append(self.tags.get(word, OTHER) if odds is None else INSULT)
                strengths.append(odds or 0.0)
            total += clause_features(tags, strengths)
        total[7] = total[:2].sum() * 1000 / (len(text) + 200)
        return np.concatenate([np.log1p(total[:7]), np.log1p(total[7:])])


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stem of the sample's texts: toxic and other texts that hold it, and hashes of the words before it in toxic ones."""
    toxic, other, contexts = defaultdict(int), defaultdict(int), defaultdict(set)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found, before = set(), ""
            for word in _WORD.findall(text.translate(_FOLD)):
                stems = [word + "$", *[word[:n] for n in STEM_CHARS if n <= len(word)]]
                found.update(stems)
                if label:
                    mark = np.int64(int.from_bytes(before.encode()[-7:], "big"))
                    for stem in stems:
                        contexts[stem].add(mark)
                before = word
            for stem in found:
                (toxic if label else other)[stem] += 1
    names = sorted(set(toxic) | set(other))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([toxic[s] for s in names], pa.int64()), pa.array([other[s] for s in names], pa.int64()),
         pa.array([sorted(contexts.get(s, ())) for s in names], pa.list_(pa.int64()))],
        ["stem", "toxic", "other", "contexts"],
    )


def learn_stems(sample: DataFrame) -> list[tuple[str, float]]:
    """Whole words (ending in $) and beginnings of words that tell toxic from other texts, with their log odds.

    Counted over the sample by Spark; the driver gets at most MAX_STEMS rows. A beginning that adds nothing to a shorter one is left out.
    """
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return []
    counted = sample.mapInArrow(_stem_counts, "stem string, toxic long, other long, contexts array<long>").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    top = counted.where(F.col("contexts") >= MIN_CONTEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    found = {r.stem: r.odds for r in top.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "stem").limit(MAX_STEMS).collect()}
    kept = {}
    for stem in sorted(found, key=lambda s: (len(s.rstrip("$")), s)):
        shorter = [kept[stem[:n]] for n in STEM_CHARS if n < len(stem) and stem[:n] in kept]
        if not shorter or found[stem] > max(shorter) + 0.7:
            kept[stem] = found[stem]
    return sorted(kept.items())


def _measured(batches: Iterator[pa.RecordBatch], stems: list[tuple[str, float]], kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    grammar = Grammar(stems)
    for batch in batches:
        for part in sliced(batch, "text"):
            rows = [grammar.features(text).tolist() for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(rows, pa.list_(pa.float64()))], [*kept, "features"])


def fit_weights(features: np.ndarray, labels: np.ndarray, penalty: float = 0.1, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


# Without labels to learn from: what the grammar says by itself.
DEFAULT_WEIGHTS = np.array([1.0, 1.5, -0.5, -0.5, 1.5, 0.5, 0.5, 0.5, -3.0])


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold: all, or `sample_rows` on average by a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = own.count()
    if total > sample_rows:
        own = own.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / total))
    return docs.join(F.broadcast(own), "doc_id").select("text", "toxic")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per input row.

    The lexicon of the insult machine and the weights of the readings are learned from a sample of labelled rows of at most about
    `sample_rows` (SAMPLE_ROWS), none of the held-out fold; the texts alone make a score. An automaton finds lexicon words,
    the machines run over the clauses around them, and a logistic weight sums up the readings. Scoring is one pass over all
    whole texts without a shuffle.

    Null or empty text: no clause, the score of none. Without labels of both kinds the built-in lexicon and weights hold.
    Null doc_id: kept, never a training row. Repeated rows: each gets its own row. Further columns of either table are not read.
    """
    source = texts(docs, id_col, text_col)
    sample = stored(training_sample(source, labels, sample_rows).repartition(64), "toxic-sample")
    stems = learn_stems(sample)
    fitted = sample.mapInArrow(lambda it: _measured(it, stems, ("toxic",)), "toxic int, features array<double>").toArrow()
    weights = DEFAULT_WEIGHTS
    if stems:
        flat = fitted.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        weights = fit_weights(flat, fitted.column("toxic").to_numpy().astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measured(batches, stems, ("doc_id", "held_out")):
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            value = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    marked = source.withColumn("held_out", held_out(F.col("doc_id")))
    return marked.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
