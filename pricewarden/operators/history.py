"""Daily history: means, observations, gap-honest summaries and the guards that protect them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.operators import pricing

ZONE = "America/Lima"
MAX_DAYS = 30
DEFAULT_WINDOW = 7
STALE_HOURS = 36
METHOD_VERSION = "daily-mean-2"
MAX_SUMMARY_BYTES = 64 * 1024


def local_date(instant: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


# --- daily mean ---------------------------------------------------------------------------------


def vote_per_site(evaluated: DataFrame, by: Sequence[str] = ("product",)) -> DataFrame:
    """One vote per site: its first offer by id, how many repeat it and how many contradict it.

    A fresh offer has a usable price by definition; one without a site is a problem, not a vote. Equal offers are counted together before sites are, so a site with a million copies is one row
    per distinct statement after the first shuffle.
    """
    usable = (F.col("state") == "fresh") & F.col("site_id").isNotNull()
    said = (
        evaluated.where(usable)
        .groupBy(*by, "site_id", "price", "reported_at")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    )
    return (
        said.groupBy(*by, "site_id")
        .agg(F.min(F.struct("_id", "price", "_n")).alias("_first"), F.sum("_n").alias("_all"))
        .select(
            *by,
            "site_id",
            F.col("_first.price").alias("price"),
            (F.col("_first._n") - 1).alias("duplicates"),
            (F.col("_all") - F.col("_first._n")).alias("contradictions"),
        )
    )


def daily_mean(evaluated: DataFrame, by: Sequence[str] = ("product",)) -> DataFrame:
    """Mean of the sites' prices per product. A contradicted product is invalid, not averaged away.

    `status` tells apart a mean, an empty product (mean null, n 0) and an invalid one (mean null).
    """
    means = (
        vote_per_site(evaluated, by)
        .groupBy(*by)
        .agg(
            F.round(F.avg("price"), 4).alias("mean"),
            F.count(F.lit(1)).alias("n"),
            F.sum("duplicates").alias("duplicates_ignored"),
            F.sum("contradictions").alias("contradictions"),
        )
    )
    skipped = evaluated.groupBy(*by).agg(
        F.count_if((F.col("state") == "fresh") & F.col("site_id").isNull()).alias("problems")
    )
    zero = F.lit(0).cast("long")
    bad = F.coalesce(F.col("contradictions"), zero)
    status = F.when(bad > 0, F.lit("invalid")).when(F.col("mean").isNull(), F.lit("empty")).otherwise(F.lit("ok"))
    return skipped.join(means, list(by), "left").select(
        *by,
        F.when(bad == 0, F.col("mean")).alias("mean"),
        F.coalesce("n", zero).alias("n"),
        F.coalesce("duplicates_ignored", zero).alias("duplicates_ignored"),
        bad.alias("contradictions"),
        "problems",
        status.alias("status"),
    )


def measure(offers: DataFrame, as_of: datetime, cutoff_at: datetime, by: Sequence[str] = ("product",)) -> DataFrame:
    """Daily mean at an instant. A clock older than the cutoff is `blocked`, which is not the same as empty."""
    if pricing.instant(as_of) < pricing.instant(cutoff_at):
        zero = F.lit(0).cast("long")
        return (
            offers.select(*by)
            .distinct()
            .select(
                *by,
                F.lit(None).cast("double").alias("mean"),
                *[zero.alias(c) for c in ("n", "duplicates_ignored", "contradictions", "problems")],
                F.lit("blocked").alias("status"),
            )
        )
    return daily_mean(pricing.evaluate(offers, as_of, cutoff_at), by)


def observation_id(observed_at: Column, archive_hash: Column, method: str = METHOD_VERSION) -> Column:
    body = F.concat(F.lit("obs-v1\n"), observed_at, F.lit("\n"), archive_hash, F.lit(f"\n{method}\n"))
    return F.concat(F.lit("obs_"), F.substring(F.sha2(body, 256), 1, 24))


# --- one observation per day, and the calendar ---------------------------------------------------


def last_of_day(observations: DataFrame, by: Sequence[str], id_col: str, instant: str = "observed_at") -> DataFrame:
    """The newest observation of each local day, ties to the larger id: one fold, no window."""
    rest = [c for c in observations.columns if c not in (*by, id_col, instant)]
    day = observations.withColumn("local_date", local_date(F.col(instant)))
    top = F.max(F.struct(F.col(instant), F.col(id_col), *[F.col(c) for c in rest])).alias("_top")
    return day.groupBy(*by, "local_date").agg(top).select(*by, "local_date", "_top.*")


def window_dates(end: date, days: int) -> tuple[date, date]:
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"window out of range: {days}")
    return end - timedelta(days=days - 1), end


def calendar(keys: DataFrame, end: date, days: int) -> DataFrame:
    """Every date of the window for every key."""
    start, stop = window_dates(end, days)
    spine = F.sequence(F.lit(start), F.lit(stop))
    return keys.distinct().select("*", F.explode(spine).alias("date"))


def daily_spine(daily: DataFrame, by: Sequence[str], end: date, days: int = MAX_DAYS) -> DataFrame:
    """The window with every date present; days without an observation stay, as nulls."""
    start, stop = window_dates(end, days)
    inside = daily.where(F.col("date").between(F.lit(start), F.lit(stop)))
    return calendar(daily.select(*by), end, days).join(inside, [*by, "date"], "left")


def measured(mean: Column, n: Column) -> Column:
    """A day counts only with a finite mean that somebody voted for."""
    finite = mean.isNotNull() & ~F.isnan(mean) & (F.abs(mean) != float("inf"))
    return F.coalesce(finite & (n > 0), F.lit(False))


def frame_window(spine: DataFrame, end: date, days: int = DEFAULT_WINDOW) -> DataFrame:
    """The last days of the summary with their position and whether they have a measure."""
    start, stop = window_dates(end, days)
    has = measured(F.col("mean"), F.col("n"))
    return spine.where(F.col("date").between(F.lit(start), F.lit(stop))).select(
        *[c for c in spine.columns if c not in ("mean", "n")],
        F.when(has, F.col("mean")).alias("mean"),
        F.when(has, F.col("n")).alias("n"),
        F.datediff("date", F.lit(start)).alias("index"),
        (F.col("date") == F.lit(stop)).alias("is_today"),
    )


def islands(framed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs of consecutive measured days; a day without data ends a run.

    Measured days keep a constant difference between their date and their rank, so the run is a
    group. A key's partition is its calendar, at most the window's days.
    """
    w = W.partitionBy(*by).orderBy("date")
    days = framed.where(measured(F.col("mean"), F.col("n")))
    anchor = F.date_sub("date", F.row_number().over(w))
    return (
        days.withColumn("_run", anchor)
        .groupBy(*by, "_run")
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"))
        .drop("_run")
    )


def last_point(framed: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last measured day of each key, with its own date."""
    has = measured(F.col("mean"), F.col("n"))
    point = F.struct("date", "mean", "n")
    return (
        framed.groupBy(*by)
        .agg(F.max_by(point, F.when(has, F.col("date"))).alias("_p"))
        .where(F.col("_p").isNotNull())
        .select(*by, "_p.*")
    )


def period_mean(framed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unweighted mean of the measured days, how many there are and how long the window is."""
    has = measured(F.col("mean"), F.col("n"))
    return (
        framed.groupBy(*by)
        .agg(
            F.avg(F.when(has, F.col("mean"))).alias("mean"),
            F.count_if(has).alias("k"),
            F.count(F.lit(1)).alias("window"),
        )
        .where("k > 0")
    )


def stale_hours(framed: DataFrame, by: Sequence[str], now: datetime, instant: str = "observed_at") -> DataFrame:
    """Hours since the last observation, never negative, null without one; stale from 36 on."""
    elapsed = (F.unix_micros(pricing.instant_lit(now)) - F.unix_micros(F.max(instant))) / 3.6e9
    hours = F.when(F.max(instant).isNotNull(), F.greatest(F.lit(0.0), elapsed))
    return framed.groupBy(*by).agg(hours.alias("stale_hours")).withColumn(
        "stale", F.coalesce(F.col("stale_hours") >= STALE_HOURS, F.lit(False))
    )


def date_breaks(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dates that do not follow the previous one by exactly a day; a key's dates are its calendar."""
    w = W.partitionBy(*by).orderBy("date")
    step = series.select(*by, "date", F.lag("date").over(w).alias("previous"))
    return step.where(F.datediff("date", "previous") != 1)


# --- guards -------------------------------------------------------------------------------------


def lost_dates(previous: DataFrame, candidate: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dates that had an observation, lie inside the new window and have none now."""
    had = previous.where(F.col("observation_id").isNotNull()).select(*by, "date")
    window = candidate.select(*by, "date").distinct()
    now = candidate.where(F.col("observation_id").isNotNull()).select(*by, "date")
    return had.join(window, [*by, "date"], "left_semi").join(now, [*by, "date"], "left_anti")


def write_decision(
    previous: DataFrame, candidate: DataFrame, by: Sequence[str]
) -> DataFrame:
    """What to do with a rebuilt summary, per key: the first guard that holds.

    `previous` and `candidate` hold by, date, observation_id, content (any comparable text) and generated_at.
    """
    p = previous.select(
        *by, "date", F.struct("observation_id", "content", "generated_at").alias("_p")
    )
    c = candidate.select(
        *by, "date", F.struct("observation_id", "content", "generated_at").alias("_c")
    )
    both = p.join(c, [*by, "date"], "full")
    stated = both.groupBy(*by).agg(
        F.max("_p.generated_at").alias("_pg"),
        F.max("_c.generated_at").alias("_cg"),
        F.max(F.when(F.col("_p").isNotNull(), F.col("date"))).alias("_pd"),
        F.max(F.when(F.col("_c").isNotNull(), F.col("date"))).alias("_cd"),
        F.count_if(
            F.col("_c").isNotNull()
            & F.col("_p.observation_id").isNotNull()
            & F.col("_c.observation_id").isNull()
        ).alias("lost"),
        F.count_if(
            F.col("_p").isNull()
            | F.col("_c").isNull()
            | ~F.col("_p.content").eqNullSafe(F.col("_c.content"))
            | ~F.col("_p.observation_id").eqNullSafe(F.col("_c.observation_id"))
        ).alias("differences"),
    )
    known = F.col("_pg").isNotNull()
    older = (F.col("_cg") < F.col("_pg")) | (F.col("_cd") < F.col("_pd"))
    decision = (
        F.when(known & older, F.lit("skipped_stale"))
        .when(known & (F.col("lost") > 0), F.lit("blocked_missing_observations"))
        .when(known & (F.col("differences") == 0), F.lit("skipped_unchanged"))
        .otherwise(F.lit("written"))
    )
    return stated.where(F.col("_cg").isNotNull()).select(*by, decision.alias("write"), "lost")


def append_observations(existing: DataFrame, incoming: DataFrame, id_col: str = "observation_id") -> DataFrame:
    """Incoming observations not stored yet. The same id with another payload fails the job.

    Both sides are keyed by a content-derived id, so re-running an append adds nothing.
    """
    rest = [c for c in incoming.columns if c != id_col]
    stored = existing.select(id_col, F.struct(*[F.col(c) for c in rest]).alias("_stored"))
    joined = incoming.join(stored, id_col, "left")
    same = F.struct(*[F.col(c) for c in rest]).eqNullSafe(F.col("_stored"))
    fresh = F.col("_stored").isNull()
    clash = F.raise_error(F.concat(F.lit("stored observation differs: "), F.col(id_col).cast("string")))
    return joined.where(F.when(fresh, F.lit(True)).when(same, F.lit(False)).otherwise(clash.cast("boolean"))).select(
        *incoming.columns
    )
