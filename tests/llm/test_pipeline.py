"""The pipeline against plain Python, stage by stage, and as one run."""

from __future__ import annotations

import pyarrow.parquet as pq

import corpus_pipeline
from pricewarden.llm import quality_rules
from pricewarden.llm.queries import QUERIES, tokenizer

from . import brute
from .conftest import AWKWARD, SECRET
from .test_operators import check_packing

SF = "/root/testdata/sf0.01"


def rows_of(sf: str) -> list[tuple]:
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pydict()
    return list(zip(table["doc_id"], table["text"], table["lang"], strict=True))


def test_quality_verdicts(spark, given):
    expected = brute.quality_verdicts(rows_of(SF), quality_rules)
    assert {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, SF).collect()} == expected


def test_run_equals_plain_stages(spark, given):
    from tokenizers import Tokenizer

    rows = rows_of(given)
    verdicts = brute.quality_verdicts(rows, quality_rules)
    kept = [(d, t) for d, t, _ in rows if verdicts[d]]
    texts = {d: t for d, _, _, t in brute.dedup_lines(kept)}
    classes = brute.near_classes(texts)
    texts = {d: t for d, t in texts.items() if classes[d] == d}
    masked = {}
    for d, text in texts.items():
        out, at = [], 0
        for _, begin, end in brute.base_spans(text):
            if end <= at:
                continue
            if begin >= at:
                out += [text[at:begin], "[SECRET]"]
            at = max(at, end)
        masked[d] = "".join([*out, text[at:]])
    known = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, given).toPandas()
    assert set(packed.doc_id) == set(masked)
    check_packing(packed, {d: known.encode(t, add_special_tokens=False).ids + [2] for d, t in masked.items()})


def test_stages_keep_columns_and_bear_awkward_rows(spark, awkward, given):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, awkward, given)
        assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes), name
        assert stage(spark, awkward.where("false"), given).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, awkward, given)
    assert packed.where("piece = 0").count() == len(AWKWARD)
    assert SECRET in next(t for d, t, _ in AWKWARD if d == 10)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "secret scan", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
