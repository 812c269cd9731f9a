"""Queries over tables that the given ones do not show: other values, larger ones."""

from __future__ import annotations

from datetime import datetime

from checks import load
from checks.compare import compare


def test_summary_contract_with_a_mean_of_zero(spark, tmp_path):
    """The SQL knows no rule on means; a value of zero under an odd id broke one of the contract's."""
    rows = [(11, datetime(2024, 1, 5, 12), 1, "click", 0.0), (12, datetime(2024, 1, 6, 12), 1, "click", 3.0), (15, datetime(2024, 1, 7, 12), 2, "view", 0.0)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    from checks.compare import TABLES

    for name in TABLES:
        frame.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        part = next((tmp_path / f"{name}.parquet").glob("part-*.parquet")).read_bytes()
        (tmp_path / "flat").mkdir(exist_ok=True)
        (tmp_path / "flat" / f"{name}.parquet").write_bytes(part)
    contract = load()
    good, message = compare(spark, str(tmp_path / "flat"), "summary_contract", contract.queries["summary_contract"], contract.oracles["summary_contract"])
    assert good, message


def test_written_texts_are_read_by_many_tasks(spark):
    """A small table lay in one task, and a shuffle without a number was merged back into one."""
    from pyspark.sql import functions as F

    from checks.stream_queries import _written

    assert _written(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() >= 16


def test_lookup_never_broadcasts_a_dimension_by_its_estimate(spark):
    """A dimension exploded from few bytes was broadcast whole; now it is dealt out, folded and merged."""
    from pyspark.sql import functions as F

    from pricewarden.operators.reports import safe_lookup

    dim = spark.range(500).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("code"), (F.col("id") * 2).alias("value"))
    dim = dim.unionByName(dim.where("id = 7 AND code = 'a'"))
    left = spark.range(600).select("id", F.lit("a").alias("code"))
    found = safe_lookup(left, dim, ["id", "code"], ["value"], "d_")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    rows = {r["id"]: (r["d_matches"], r["d_value"]) for r in found.collect()}
    assert rows == {i: (2, None) if i == 7 else (1, 2 * i) if i < 500 else (0, None) for i in range(600)}
