"""Daily means as event-time windows of the local day, emitted once each day is complete."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from pricewarden.operators.history import ZONE, local_date

CLOSED, LATE = "closed", "late"
MEASURES = ["lowest", "highest", "counted_lowest", "counted_highest"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 16  # groups that the sites of one product and day are dealt over; each is one value of the state
FRAME_ROWS = 10_000


def _day_start(zone: str = ZONE) -> str:
    """Where the local day begins in UTC, for windows; a zone whose clocks change has no such place."""
    offsets = {datetime(2024, month, 1, tzinfo=ZoneInfo(zone)).utcoffset() for month in range(1, 13)}
    if len(offsets) != 1:
        raise ValueError(f"windows of a fixed length cannot follow the local days of {zone}")
    return f"{int(-offsets.pop().total_seconds()) % 86_400} seconds"


def _millis(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


class _Days(StatefulProcessor):
    """Smallest and largest price of each site of one product, day and part: counted while the day is open, watched while it is closed.

    The watermark runs `lateness` behind the newest instant, so rows of closed days still arrive. A day closes `delay` after its
    end; its sites then come out as they stand. A site whose prices change later comes out as late, beside the prices it was
    counted with. The state goes when no row of the day can arrive any more.

    State is one value, an array per field with an element per site: a call reads and writes it once, however many sites it names.
    """

    def __init__(self, delay: int, lateness: int):
        self.delay, self.lateness = delay, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        prices = ", ".join(f"{name} array<double>" for name in MEASURES)
        self.sites = handle.getValueState("sites", f"site array<string>, {prices}, counted array<boolean>, late array<boolean>")

    def _rows(self, key, kind: str, found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=["site", "lowest", "highest", "counted_lowest", "counted_highest"], dtype=object)
        frame.insert(0, "kind", kind)
        frame.insert(1, "product", key[0])
        frame.insert(2, "date", key[1])
        return frame

    @staticmethod
    def _folded(rows: Iterator[pd.DataFrame]) -> dict:
        """Smallest and largest price of each site, both None where no price is known."""
        found: dict = {}
        for frame in rows:
            for site, price in zip(frame["site"].tolist(), frame["price"].tolist(), strict=True):
                low, high = found.get(site, (None, None))
                if price is None or price != price:
                    found[site] = (low, high)
                else:
                    found[site] = (price if low is None or price < low else low, price if high is None or price > high else high)
        return found

    def _held(self) -> dict:
        """Per site: the prices received, those it was counted with, whether it is counted and whether it is late."""
        held = self.sites.get()
        return {} if held is None else {row[0]: row[1:] for row in zip(*held, strict=True)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = key[3]
        closes = ends + self.delay - self.lateness
        closed = closes <= timerValues.getCurrentWatermarkInMs()
        sites, changed = self._held(), []
        for site, (low, high) in self._folded(rows).items():
            held = sites.get(site)
            if held is None:
                sites[site] = (low, high, None, None, not closed, closed)
            else:
                both = lambda f, a, b: f(a, b) if a is not None and b is not None else b if a is None else a
                least, most = both(min, held[0], low), both(max, held[1], high)
                if (least, most) == (held[0], held[1]):
                    continue
                counted = (held[0], held[1]) if closed and not held[5] else (held[2], held[3])
                sites[site] = (least, most, *counted, held[4], held[5] or closed)
            changed.append(site)
        if changed:
            self.sites.update((list(sites), *(list(field) for field in zip(*sites.values(), strict=True))))
        # Timers fire once the watermark has passed them.
        if not closed:
            self.handle.registerTimer(closes - 1)
        self.handle.registerTimer(ends - 1)
        if closed:
            for first in range(0, len(changed), FRAME_ROWS):
                yield self._rows(key, LATE, [(site, *sites[site][:4]) for site in changed[first : first + FRAME_ROWS]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if expiredTimerInfo.getExpiryTimeInMs() >= key[3] - 1:
            self.sites.clear()
            return
        found = []
        for site, value in self._held().items():
            if value[4]:
                low, high = (value[2], value[3]) if value[5] else (value[0], value[1])
                found.append((site, low, high, low, high))
                if len(found) >= FRAME_ROWS:
                    yield self._rows(key, CLOSED, found)
                    found = []
        if found:
            yield self._rows(key, CLOSED, found)

    def close(self) -> None:
        pass


def site_days(prices: DataFrame, delay: str = "6 hours", lateness: str = "35 days", parts: int = PARTS) -> DataFrame:
    """A stream of `closed` and `late` rows: kind, product, date, site_id, lowest, highest, counted_lowest, counted_highest.

    prices  product, site_id, price, observed_at

    When a local day closes, `delay` after its end by the newest instant seen, each of its sites comes out once as `closed`, with the
    smallest and largest price received. A row that arrives later and changes what is known of its site comes out as `late`: the
    prices as received by now, and those the site was counted with, null where it wasn't counted at all. Days of which every
    row comes late are among them; a late row between the known prices changes nothing. Closed days are watched until
    `lateness` after the newest instant; rows older than that are dropped by the watermark, which the query's progress counts.

    State holds a value per product, day and part, in RocksDB: all its sites, some 40 bytes each. The sites of a day are dealt over
    `parts` groups, and a batch reads and writes those of its own rows only; a day of many millions of sites wants more of them,
    as a group is held in memory while its rows are folded in. A row without an instant belongs to no day.
    """
    late_by, closes_by = _millis(lateness), _millis(delay)
    if late_by <= closes_by:
        raise ValueError("closed days must be watched for longer than it takes to close them")
    day = local_date(F.col("observed_at"))
    ends = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), ZONE))
    # State is keyed by the text of a site's id, which a missing id has none of.
    site = F.coalesce(F.concat(F.lit("="), F.col("site_id").cast("string")), F.lit(""))
    rows = (
        prices.where(F.col("observed_at").isNotNull())
        .withWatermark("observed_at", lateness)
        .select("product", day.alias("date"), F.pmod(F.xxhash64("site_id"), F.lit(parts)).cast("int").alias("part"), ends.alias("ends"), site.alias("site"), F.col("price").cast("double").alias("price"), "observed_at")
    )
    out = StructType([
        StructField("kind", StringType()), StructField("product", prices.schema["product"].dataType), StructField("date", DateType()), StructField("site", StringType()),
        *[StructField(c, DoubleType()) for c in MEASURES],
    ])
    found = rows.groupBy("product", "date", "part", "ends").transformWithStateInPandas(_Days(closes_by, late_by), out, "Append", "EventTime")
    site_id = F.expr("CASE WHEN site <> '' THEN substring(site, 2) END").cast(prices.schema["site_id"].dataType)
    return found.select("kind", "product", "date", site_id.alias("site_id"), *MEASURES)


def store_site_days(prices: DataFrame, root: str, delay: str = "6 hours", lateness: str = "35 days") -> StreamingQuery:
    """Append `site_days` below `root`, one folder for each kind, for what is available, then stop; call again to go on where it stopped."""
    conf = prices.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # the query keeps what it was started with
    try:
        return (
            site_days(prices, delay, lateness)
            .writeStream.format("parquet")
            .outputMode("append")
            .partitionBy("kind")
            .option("path", f"{root}/sites")
            .option("checkpointLocation", f"{root}/progress")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(PROVIDER, before)


def late_sites(stored: DataFrame) -> DataFrame:
    """The last word on each late site of a stored stream: product, date, site_id, the prices received and those counted.

    Prices received only widen, so the widest are the newest; the counted ones never change.
    """
    return (
        stored.where(F.col("kind") == LATE)
        .groupBy("product", "date", "site_id")
        .agg(
            F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
            F.max("counted_lowest").alias("counted_lowest"), F.max("counted_highest").alias("counted_highest"),
        )
    )


def _sites(prices: DataFrame, delay: str) -> DataFrame:
    day = F.window("observed_at", "1 day", startTime=_day_start())
    return (
        prices.withWatermark("observed_at", delay)
        .groupBy(day.alias("day"), "product", "site_id")
        .agg(F.min("price").alias("price"), F.max("price").alias("_top"))
    )


def daily_windows(prices: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Mean of the sites' prices per product and local day: one vote per site, as the batch measure has it.

    prices  product, site_id, price, observed_at

    Equal repeats of a site count once. A site that names two prices on one day makes its product invalid: the mean is
    null. Sites are folded to their smallest and largest price first, so state holds one row per site and day. Rows later than
    `delay` after a day's end are dropped by the watermark; the stream `site_days` names their sites as late, for a rebuild.
    """
    return (
        _sites(prices, delay).groupBy("day", "product")
        .agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") != F.col("_top")).alias("contradictions"))
        .select(
            "product",
            local_date(F.col("day.start")).alias("date"),
            F.when(F.col("contradictions") == 0, F.round("mean", 4)).alias("mean"),
            "n",
            "contradictions",
            F.when(F.col("contradictions") > 0, F.lit("invalid")).otherwise(F.lit("ok")).alias("status"),
        )
    )
