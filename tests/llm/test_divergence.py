"""Source divergence against plain whole numbers, over awkward rows and over ties."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from pricewarden.llm import divergence
from pricewarden.llm.divergence import source_divergence

from .brute import low

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=10, top=10):
    rows = [(lang or "", source or "", Counter(map(low, TERM.findall(text or "")))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: c[t] for t in kept if c[t]})
            counts[None].update({t: c[t] for t in kept if c[t]})
        for source, _ in [(s, 0) for _, s, _ in own]:
            counts[source]
        share = {g: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for g, c in counts.items()}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for source in {s for _, s, _ in own}:
            pairs = [(-sum(f(share[source][t], share[o][t]) for t in kept), o) for o in counts if o not in (source, None)]
            terms = [(-f(share[source][t], share[None][t]), t) for t in kept if counts[source][t] and share[source][t] > share[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(ordered[:most])]
    return sorted(out)


def found(frame, **more):
    return sorted(tuple(r) for r in source_divergence(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    *[("en", f"s{i % 3}", f"common Rare{i} tie{i % 5} tie{(i + 1) % 5} É\U0001f600 é common") for i in range(40)],
    *[("en", "hot", "common words repeat words repeat " + "tieA tieB tieC tieD " * (i % 2)) for i in range(60)],
    ("en", "s1", None), ("en", "none", "1234 !!"), (None, None, "common"), (None, "x", ""), ("de", None, None), ("xx", "a", "b"),
    ("fr", "long", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))),
    *[("fr", "long", "waa wba")] * 12,
]


@pytest.mark.parametrize("cells", [divergence.CHUNK_CELLS, 7])
def test_divergence(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CHUNK_CELLS", cells)
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "lang string, source string, text string, term string, value string").repartition(5)
    assert found(frame) == plain(ROWS)
    assert found(frame, min_docs=2, top=3) == plain(ROWS, 2, 3)


def test_divergence_of_nothing(spark):
    assert found(spark.createDataFrame([], "lang string, source string, text string")) == []


def test_shares_are_exact_beyond_a_long(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(10**13, 10**15, 10**6)], "n long, total long, terms long")
    got = frame.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 2) // (10**15 + 2 * 10**6)
