"""Secrets: fixed patterns, and runs that look random to character Markov models learned from labelled samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewarden.llm.common import texts
from pricewarden.llm.pieces import sliced

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

# States of the models: the characters of identifiers and encoded values; all others are one state, the end of a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
CODES = np.zeros(256, np.uint8)
CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
SEPARATORS = CODES[np.frombuffer(b"+/_=-", np.uint8)]
HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

MIN_RUN = 20  # characters a run must have to be judged
MIN_RATIO = 0.8  # mean log-likelihood ratio a character, in nats; README: misses and false alarms on held-out halves of sf0.1
SMOOTHING = 0.5
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def fixed_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, value_start) of the fixed patterns: leftmost, non-overlapping in a kind, too short ones left out."""
    found = [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found


def _hex_spans(text: str) -> list[tuple[str, int, int, int]]:
    return [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]


def _long_runs(text: str, taken: list[tuple[str, int, int, int]]) -> Iterator[re.Match]:
    """The runs to be judged: long ones apart from the fixed spans. Runs and spans are walked side by side."""
    spans = sorted((start, end) for _, start, end, _ in taken)
    k, reach = 0, 0
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():  # spans that begin before the run ends; the farthest decides
            reach = max(reach, spans[k][1])
            k += 1
        if m.end() - m.start() >= MIN_RUN and reach <= m.start():
            yield m


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column with one end byte after each text, and where each text begins."""
    data = "\n".join(column.to_pylist()).encode() + b"\n"
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes + 1)])


def _rows_with_run(mask: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Which texts hold a run of at least `least` marked bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    hit = np.zeros(len(starts) - 1, bool)
    hit[np.searchsorted(starts, begins[ends - begins >= least], "right") - 1] = True
    return hit


def _pairs(text: str) -> np.ndarray:
    codes = CODES[np.frombuffer(b"\n" + text.encode() + b"\n", np.uint8)].astype(np.int64)
    return codes[:-1] * STATES + codes[1:]


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character pairs of a task's texts, by label: 1 in values that a fixed pattern caught, 0 elsewhere but in runs to be judged."""
    every, caught, judged = (np.zeros(STATES * STATES, np.int64) for _ in range(3))
    for batch in batches:
        for part in sliced(batch, "text"):
            data, starts = _joined(part.column("text"))
            codes = CODES[data].astype(np.int32)
            every += np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES)
            hexes = _rows_with_run(HEX_BYTES[data], starts, MIN_HEX)
            runs = _rows_with_run(codes > 0, starts, MIN_RUN)
            for i, text in enumerate(part.column("text").to_pylist()):
                taken: list[tuple[int, int]] = []
                fixed = fixed_spans(text) + (_hex_spans(text) if hexes[i] else [])
                for m in _long_runs(text, fixed) if runs[i] else ():
                    np.add.at(judged, _pairs(m.group()), 1)
                for _, _, end, value in sorted(fixed, key=lambda s: s[3]):
                    if not taken or value >= taken[-1][1]:  # a value caught by two kinds counts once
                        taken.append((value, end))
                        np.add.at(caught, _pairs(text[value:end]), 1)
    pairs = np.arange(STATES * STATES, dtype=np.int64)
    for label, counts in ((0, np.maximum(every - caught - judged, 0)), (1, caught)):
        seen = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), label, np.int32)), pa.array(pairs[seen]), pa.array(counts[seen])], ["label", "pair", "n"])


def learn_models(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each character pair: random strings against ordinary identifiers and words.

    The labelled samples are the texts themselves, all of them: values that the fixed patterns caught are random strings,
    everything else is ordinary, apart from the runs to be judged, which may be either. Each task sends its counts of character
    pairs; the driver gets at most two numbers for each of the STATES x STATES pairs, however large the table is. A pair with a
    separator, or of a character and itself, speaks for a random string only if a caught value held it: rules, paths and
    joined words are full of such pairs, and neither sample may know them.
    """
    source = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counted = source.mapInArrow(_bigrams, "label int, pair long, n long")
    table = np.zeros((2, STATES, STATES))
    for row in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        table[row.label, row.pair // STATES, row.pair % STATES] = row.n
    unknown = np.eye(STATES, dtype=bool)
    unknown[SEPARATORS, :] = unknown[:, SEPARATORS] = True
    unknown &= table[1] == 0
    if not table[1].sum():  # no sample of a secret: every character after any other alike
        table[1, 1:, 1:] = 1
    log = lambda counts: np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True))
    ratios = log(table[1]) - log(table[0])
    return np.where(unknown, np.minimum(ratios, 0), ratios)


def looks_random(run: str, ratios: np.ndarray) -> bool:
    """Whether a run is judged a secret: random strings explain it far better than words do. Nothing else is asked of it."""
    codes = CODES[np.frombuffer(run.encode(), np.uint8)].astype(np.int64)
    return float(ratios[codes[:-1], codes[1:]].mean()) >= MIN_RATIO


def _added(text: str, ratios: np.ndarray, taken: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    return [("random", m.start(), m.end(), m.start()) for m in _long_runs(text, taken) if looks_random(m.group(), ratios)]


def _spans(column: pa.Array, ratios: np.ndarray) -> list[list[dict]]:
    """Spans of each text, by start and then kind as listed. Texts without a long run skip the patterns for runs."""
    data, starts = _joined(column)
    hexes = _rows_with_run(HEX_BYTES[data], starts, MIN_HEX)
    runs = _rows_with_run(CODES[data] > 0, starts, MIN_RUN)
    out = []
    for i, text in enumerate(column.to_pylist()):
        found = fixed_spans(text) + (_hex_spans(text) if hexes[i] else [])
        if runs[i]:
            found += _added(text, ratios, found)
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        out.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
    return out


SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, "text"):
            spans = pa.array(_spans(part.column("text"), ratios), SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, ratios: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, spans) per input row; a span is (kind, start, end) in code points, end exclusive.

    Kinds `assign`, `access` and `hex` come from fixed patterns; `random` are further runs, apart from those, that the Markov
    models judge random. `ratios` are models learned before; by default they are learned from `docs`. Two passes over the
    scan, no shuffle but the sum of the counts.

    Null or empty text: no spans. Repeated rows: each gets its own row. Null doc_id: kept. Texts of any length are scanned
    whole. Further columns are not read.
    """
    ratios = learn_models(docs, text_col=text_col) if ratios is None else ratios
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPAN)])
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _scan(it, ratios), schema)


def _masked(text: str, spans: list[dict], mask: str) -> str:
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], mask]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, ratios: np.ndarray | None = None, *, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by `mask`, overlapping spans by one.

    Null text stays null; a text without spans stays as it is.
    """
    ratios = learn_models(docs, text_col=text_col) if ratios is None else ratios
    place = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text_col):
                column = part.column(text_col)
                filled = pc.fill_null(column, "")
                changed = [
                    None if text is None else _masked(text, spans, mask)
                    for text, spans in zip(column.to_pylist(), _spans(filled, ratios), strict=True)
                ]
                columns = [*part.columns[:place], pa.array(changed, column.type), *part.columns[place + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(rewrite, docs.schema)
