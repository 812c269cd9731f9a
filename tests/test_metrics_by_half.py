"""Metrics of the first half of a month are checked too."""

from __future__ import annotations

from datetime import datetime

from __spark_entry__ import queries


def test_groups_bad_only_before_the_fifteenth(spark, tmp_path):
    early = [(i, datetime(2024, 1, 3), 5 * i, "click", 1.0, "{}") for i in range(4)]
    late = [(10 + i, datetime(2024, 1, 20), 5 * i, "click", 30.0, "{}") for i in range(4)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(early + late, schema).write.parquet(f"{tmp_path}/events.parquet")
    found = queries()["metrics_by_half"](spark, str(tmp_path)).collect()
    assert {(r.product, r.grp, str(r.half)) for r in found} == {("click", 0, "2024-01-01")}
    assert "ready_offers" in {r.rule for r in found}
    assert queries()["metrics_contract"](spark, str(tmp_path)).count() == 0
