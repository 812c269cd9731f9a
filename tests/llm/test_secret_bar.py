"""The bar of random runs: misses and false alarms on documents the models have not seen, and planted strings in the pipeline."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from math import log
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pricewarden.llm import quality_rules, secret_scan
from pricewarden.llm.queries import tokenizer

from . import brute
from .test_operators import check_packing, library
from .test_pipeline import SF, rows_of

LARGE = "/root/testdata/sf0.1"
UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
KINDS = {
    "letters and digits": UPPER + LOWER + DIGITS, "letters": UPPER + LOWER, "capitals": UPPER, "small letters": LOWER,
    "upper-case hex": DIGITS + "ABCDEF", "lower-case hex": DIGITS + "abcdef", "base64url": UPPER + LOWER + DIGITS + "-_",
}


def drawn(rng: random.Random, kind: str, size: int = 20) -> str:
    return "".join(rng.choices(KINDS[kind], k=size))


def identifiers(text: str, rng: random.Random) -> list[str]:
    """Words of a text joined to identifiers of 20 characters or more, one for each way to join."""
    found, own = [], re.findall("[A-Za-z]+", text)
    for mark in "_-/":
        at, name = rng.randrange(max(1, len(own) - 8)), ""
        for word in own[at : at + 8]:
            name = f"{name}{mark}{word}" if name else word
            if len(name) >= 20:
                found.append(name)
                break
    return found


@pytest.fixture(scope="module")
def held_out(spark):
    """Models of the documents with an even doc_id, texts of the others."""
    if not Path(LARGE).exists():
        pytest.skip("the given tables are not here")
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    return secret_scan.learn_models(docs.where("doc_id % 2 = 0")), [t or "" for d, t, _ in rows_of(LARGE) if d % 2]


def test_few_random_strings_are_missed(held_out):
    ratios, _ = held_out
    rng = random.Random(2)
    missed = {k: sum(not secret_scan.looks_random(drawn(rng, k), ratios) for _ in range(2000)) / 2000 for k in KINDS}
    assert max(missed.values()) < 0.05, missed
    assert missed["letters"] < 0.001 and missed["letters and digits"] < 0.001, missed


def test_ordinary_runs_stay(held_out):
    ratios, texts = held_out
    rng = random.Random(3)
    for text in texts:
        assert not secret_scan._added(text, ratios, secret_scan.fixed_spans(text) + secret_scan._hex_spans(text))
    names = [name for text in texts for name in identifiers(text, rng)]
    assert sum(secret_scan.looks_random(name, ratios) for name in names) < 0.002 * len(names)
    for rule in ("-" * 30, "=" * 30, "x" * 30, "_" * 30, "+" + "-" * 20 + "+", "-=" * 15):
        assert not secret_scan.looks_random(rule, ratios), rule


def plain_ratios(texts: list[str]):
    """The two models by counting pairs one by one."""
    state = lambda c: c if c in secret_scan.ALPHABET else ""
    every, caught, judged = Counter(), Counter(), Counter()
    for text in texts:
        every.update((state(a), state(b)) for a, b in zip(text, (text[1:] + "\n")[: len(text)], strict=True))
        end, fixed = 0, secret_scan.fixed_spans(text) + secret_scan._hex_spans(text)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            if not any(m.start() < stop and m.end() > begin for _, begin, stop, _ in fixed):
                run = f"\n{m[0]}\n"
                judged.update((state(a), state(b)) for a, b in zip(run, run[1:], strict=False))
        for _, _, stop, value in sorted(fixed, key=lambda s: s[3]):
            if value >= end:
                end = stop
                caught.update((state(a), state(b)) for a, b in zip(text[value:stop], text[value + 1 : stop] + "\n", strict=True))
    ordinary = {p: max(n - caught[p] - judged[p], 0) for p, n in every.items()}
    totals = Counter(), Counter()
    for total, counts in zip(totals, (ordinary, caught), strict=True):
        for (a, _), n in counts.items():
            total[a] += n

    def chance(k, counts, a, b):
        return (counts.get((a, b), 0) + 0.5) / (totals[k][a] + 0.5 * secret_scan.STATES)

    def ratio(a, b):
        found = log(chance(1, caught, a, b) / chance(0, ordinary, a, b))
        return min(found, 0) if (a == b or a in "+/_=-" or b in "+/_=-") and not caught[a, b] else found

    return ratio


def test_planted_strings_leave_the_pipeline(spark, given, tmp_path):
    rng = random.Random(7)
    table = pq.read_table(f"{SF}/documents.parquet")
    planted, texts = {}, table.column("text").to_pylist()
    for i in range(0, len(texts), 9):
        kind = list(KINDS)[i // 9 % len(KINDS)]
        planted[i] = drawn(rng, kind, 32 if "hex" not in kind else 22)
        head, *rest = (texts[i] or "").split(" ")
        texts[i] = " ".join([head, planted[i], *rest])
    pq.write_table(table.set_column(table.column_names.index("text"), "text", pa.array(texts)), tmp_path / "documents.parquet")

    rows = rows_of(str(tmp_path))
    verdicts = brute.quality_verdicts(rows, quality_rules)
    left = {d: t for d, _, _, t in brute.dedup_lines([(d, t) for d, t, _ in rows if verdicts[d]])}
    classes = brute.near_classes(left)
    left = {d: t for d, t in left.items() if classes[d] == d}
    ratio = plain_ratios(list(left.values()))
    masked, reported = {}, set()
    for d, text in left.items():
        fixed = brute.base_spans(text)
        spans = list(fixed)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            if not any(m.start() < end and m.end() > begin for _, begin, end in fixed):
                if sum(ratio(a, b) for a, b in zip(m[0], m[0][1:], strict=False)) / (len(m[0]) - 1) >= secret_scan.MIN_RATIO:
                    spans.append(("random", m.start(), m.end()))
                    reported.add(m[0])
        out, at = [], 0
        for _, begin, end in sorted(spans, key=lambda s: s[1]):
            if end > at:
                out += [text[at:begin], "[SECRET]"] if begin >= at else []
                at = end
        masked[d] = "".join([*out, text[at:]])
    kept = [s for s in planted.values() if any(s in t for t in left.values())]
    assert len(kept) > 50 and len(set(kept) & reported) >= 0.9 * len(kept)
    assert reported <= set(kept)

    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(masked)
    known = library("byte_bpe_50k.json")
    check_packing(packed, {d: known.encode(t, add_special_tokens=False).ids + [2] for d, t in masked.items()})
