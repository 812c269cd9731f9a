"""Rows that come after the stream has closed their day come out of the stream itself."""

from __future__ import annotations

from datetime import date, datetime
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewarden.operators.history import local_date
from pricewarden.streaming import daily

PRICES = "product string, site_id long, price double, observed_at timestamp"


def noon(day, month=1):
    return datetime(2024, month, day, 17)


def deliver(spark, root, deliveries, **more):
    """Each delivery is a run of its own, over what the runs before left in state."""
    for rows in deliveries:
        spark.createDataFrame(rows, PRICES).coalesce(1).write.mode("append").parquet(f"{root}/received")
        query = daily.store_site_days(spark.readStream.schema(PRICES).parquet(f"{root}/received"), root, **more)
        query.awaitTermination()
    return spark.read.parquet(f"{root}/sites")


def late(stored):
    found = daily.late_sites(stored).collect()
    assert len({tuple(r)[:3] for r in found}) == len(found)
    return {tuple(r) for r in found}


DELIVERIES = [
    [("regular", 1, 5.0, noon(1)), ("regular", 2, 6.0, noon(1)), ("regular", 1, 5.0, noon(5))],
    [
        ("regular", 1, 5.0, noon(1)),  # says again what is stored
        ("regular", 2, 7.0, noon(1)),  # a counted site names another price
        ("regular", 3, 8.0, noon(1)),  # a site that isn't counted
        ("premium", 1, 9.0, noon(1)),  # a product of which every row of the day is late
        ("regular", 4, 9.0, noon(2)),  # a day of which every row is late
        ("premium", None, None, noon(1)),
        ("regular", 9, 1.0, noon(5)),  # an open day
        ("regular", 8, 1.0, None),  # no day at all
    ],
    [("regular", 1, 5.0, noon(9)), ("regular", 3, 7.5, noon(1)), ("regular", 2, 6.5, noon(1))],
]
LATE = {
    ("regular", date(2024, 1, 1), 2, 6.0, 7.0, 6.0, 6.0),
    ("regular", date(2024, 1, 1), 3, 7.5, 8.0, None, None),
    ("premium", date(2024, 1, 1), 1, 9.0, 9.0, None, None),
    ("premium", date(2024, 1, 1), None, None, None, None, None),
    ("regular", date(2024, 1, 2), 4, 9.0, 9.0, None, None),
}


def test_late_rows_come_out_of_the_stream(spark, tmp_path):
    stored = deliver(spark, str(tmp_path), DELIVERIES)
    assert late(stored) == LATE
    closed = stored.where("kind = 'closed'").select("product", "date", "site_id", "lowest", "highest").collect()
    assert {tuple(r) for r in closed} == {
        ("regular", date(2024, 1, 1), 1, 5.0, 5.0), ("regular", date(2024, 1, 1), 2, 6.0, 6.0),
        ("regular", date(2024, 1, 5), 1, 5.0, 5.0), ("regular", date(2024, 1, 5), 9, 1.0, 1.0),
    }
    assert len(closed) == 4  # a day closes once, however many runs follow


def test_the_stream_agrees_with_everything_received(spark, tmp_path):
    """Closed and late rows together say what a look at all rows says."""
    rows = [(f"p{i % 2}", i % 7, float(1 + i * 7 % 11), datetime(2024, 1, 1 + i % 12, i % 24, i % 60)) for i in range(400)]
    deliveries = [[r for k, r in enumerate(rows) if k % 3 == n] for n in range(3)] + [[("p0", 0, 1.0, noon(20))]]
    stored = deliver(spark, str(tmp_path), deliveries)
    now = spark.createDataFrame(rows, PRICES).groupBy("product", local_date(F.col("observed_at")).alias("date"), "site_id")
    expected = {tuple(r) for r in now.agg(F.min("price"), F.max("price")).collect()}
    said = {tuple(r)[:3]: tuple(r) for r in stored.where("kind = 'closed'").select("product", "date", "site_id", "lowest", "highest").collect()}
    late_ = {r[:3]: r for r in late(stored)}
    for key, r in late_.items():
        assert (r[5], r[6]) == (said[key][3:] if key in said else (None, None))
        said[key] = r[:5]
    assert set(said.values()) == expected


def test_state_goes_after_the_lateness(spark, tmp_path):
    stored = deliver(spark, str(tmp_path), [
        [("regular", 1, 5.0, noon(1)), ("regular", 1, 5.0, noon(5))],
        [("regular", 1, 6.0, noon(1)), ("regular", 1, 5.0, noon(20))],  # the day is watched still
        [("regular", 1, 7.0, noon(1)), ("regular", 1, 5.0, noon(21))],  # no longer
    ], lateness="10 days")
    assert late(stored) == {("regular", date(2024, 1, 1), 1, 5.0, 6.0, 5.0, 5.0)}
    with pytest.raises(ValueError, match="longer"):
        daily.site_days(spark.readStream.schema(PRICES).parquet(f"{tmp_path}/received"), delay="6 hours", lateness="6 hours")


def test_local_days_have_one_zone():
    assert daily._day_start() == "18000 seconds"
    with pytest.raises(ValueError, match="local days"):
        daily._day_start("Europe/Paris")


class Calls:
    """A handle whose states count what is asked of them and hold nothing."""

    def __init__(self):
        self.made = 0

    def _state(self, *_):
        def call(*_):
            self.made += 1

        return SimpleNamespace(get=call, update=call, getValue=call, updateValue=call, clear=call)

    getValueState = getMapState = getListState = _state

    def registerTimer(self, _):
        self.made += 1


def test_state_is_asked_by_group_not_by_site():
    """Each call crosses between Python and the state store, so one for every site of a day takes longer than all else."""
    handle, days = Calls(), daily._Days(6 * 3_600_000, 35 * 86_400_000)
    days.init(handle)
    frames = [pd.DataFrame({"site": [f"={i}" for i in range(500 * n, 500 * n + 500)], "price": 1.0}) for n in range(4)]
    list(days.handleInputRows(("regular", date(2024, 1, 1), 0, 1_704_171_600_000), iter(frames), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert handle.made <= 4


def test_a_group_of_many_sites_comes_out_whole(spark, tmp_path):
    """More sites than a frame holds, counted, then late, some of them without a price or without an id."""
    n = 2 * daily.FRAME_ROWS + 7
    price = F.when(F.col("id") % 100 != 3, (F.col("id") % 9).cast("double"))
    first = spark.range(n).select(F.lit("p").alias("product"), F.when(F.col("id") > 0, F.col("id")).alias("site_id"), price.alias("price"), F.lit(noon(1)).alias("observed_at"))
    later = spark.createDataFrame([("p", 1, 5.0, noon(9))], PRICES)
    again = first.withColumn("price", F.when(F.col("site_id") % 2 == 0, F.col("price")).otherwise(F.lit(10.0)))
    for rows in (first.unionByName(later), again):
        rows.write.mode("append").parquet(f"{tmp_path}/received")
        stream = daily.site_days(spark.readStream.schema(PRICES).parquet(f"{tmp_path}/received"), parts=1)
        spark.conf.set(daily.PROVIDER, daily.ROCKS)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/sites").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/sites")
    closed = {r[0]: tuple(r)[1:] for r in stored.where("kind = 'closed' AND date = '2024-01-01'").select("site_id", "lowest", "highest").collect()}
    said = {i or None: None if i % 100 == 3 else float(i % 9) for i in range(n)}
    assert closed == {i: (p, p) for i, p in said.items()}
    assert late(stored) == {("p", date(2024, 1, 1), i, 10.0 if p is None else p, 10.0, p, p) for i, p in said.items() if i is None or i % 2}
