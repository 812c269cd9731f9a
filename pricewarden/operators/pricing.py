"""Which of two prices is effective at an instant, and when that answer can change.

An offer carries the reported price (`price`, `reported_at`) and, if linked, the price seen live
(`live_price`, `live_observed_at`). Every function takes the instant; none reads a clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.functions.parse import positive

MAX_REPORT_DAYS = 30
MAX_LIVE_HOURS = 24
REPUBLISH_HOURS = 18
DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
LIVE, CSV = "live", "csv"


class ClockError(ValueError):
    """The instant asked for is older than the data's cutoff."""


def instant(value: datetime) -> datetime:
    """A timezone-aware UTC instant; a naive value is taken as UTC."""
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def instant_lit(value: datetime) -> Column:
    micros = (instant(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def check_clock(as_of: datetime, cutoff_at: datetime) -> None:
    if instant(as_of) < instant(cutoff_at):
        raise ClockError("the instant is older than the cutoff")


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(float(DAY_MICROS))


def csv_holds(as_of: Column) -> Column:
    """The reported price counts: usable, not from the future and at most thirty days old.

    Plain comparisons of stored columns, so a filter on it reaches the scan instead of dragging the
    whole price rule down with it.
    """
    at = F.col("reported_at")
    return positive(F.col("price")) & F.coalesce(
        at.between(as_of - F.expr(f"INTERVAL {MAX_REPORT_DAYS} DAYS"), as_of), F.lit(False)
    )


def live_holds(as_of: Column) -> Column:
    at = F.col("live_observed_at")
    return positive(F.col("live_price")) & F.coalesce(
        at.between(as_of - F.expr(f"INTERVAL {MAX_LIVE_HOURS} HOURS"), as_of), F.lit(False)
    )


def report_expired(as_of: Column) -> Column:
    return F.coalesce(F.col("reported_at") < as_of - F.expr(f"INTERVAL {MAX_REPORT_DAYS} DAYS"), F.lit(False))


def price_reason(as_of: Column) -> Column:
    """Which price holds and why; the first rule that applies. Both windows are inclusive."""
    csv_ok = csv_holds(as_of)
    usable = positive(F.col("price")) & F.col("reported_at").isNotNull()
    return (
        F.when(csv_ok & F.coalesce(F.col("reported_at") > F.col("live_observed_at"), F.lit(False)), F.lit(R.CSV_AFTER_LIVE))
        .when(live_holds(as_of), F.lit(R.LIVE_CURRENT))
        .when(csv_ok, F.lit(R.CSV_CURRENT))
        .when(usable & (F.col("reported_at") > as_of), F.lit(R.CSV_FUTURE))
        .when(usable, F.lit(R.CSV_EXPIRED))
        .otherwise(F.lit(R.NO_PRICE))
    )


def choose(offers: DataFrame, as_of: Column) -> DataFrame:
    return offers.withColumn("price_reason", price_reason(as_of))


def _from_live() -> Column:
    return F.col("price_reason") == R.LIVE_CURRENT


def _from_csv() -> Column:
    return F.col("price_reason").isin(R.CSV_AFTER_LIVE, R.CSV_CURRENT)


def effective_source() -> Column:
    return F.when(_from_live(), F.lit(LIVE)).when(_from_csv(), F.lit(CSV))


def effective_price(offers: DataFrame, as_of: datetime) -> DataFrame:
    """Each offer with `effective_price`, `price_source`, `price_at`, `age_days` and `price_reason`."""
    now = instant_lit(as_of)
    chosen = choose(offers, now).withColumns(
        {
            "effective_price": F.when(_from_live(), F.col("live_price")).when(_from_csv(), F.col("price")),
            "price_source": effective_source(),
            "price_at": F.when(_from_live(), F.col("live_observed_at")).when(_from_csv(), F.col("reported_at")),
        }
    )
    return chosen.withColumn("age_days", age_days(F.col("price_at"), now))


def evaluate(offers: DataFrame, as_of: datetime, cutoff_at: datetime) -> DataFrame:
    """Offers that may be shown, with their effective price and `state`: fresh or expired.

    Fresh rows have a price that holds. Expired rows keep the reported price, because a site that
    stopped reporting still exists. Future and unreadable reports without a price are left out.
    """
    check_clock(as_of, cutoff_at)
    now = instant_lit(as_of)
    fresh = csv_holds(now) | live_holds(now)
    shown = offers.where(fresh | report_expired(now)).withColumn(
        "state", F.when(fresh, F.lit("fresh")).otherwise(F.lit("expired"))
    )
    priced = effective_price(shown, as_of).withColumn("reported_age_days", age_days(F.col("reported_at"), now))
    return priced.withColumns(
        {
            "price": F.coalesce(F.col("effective_price"), F.col("price")),
            "age_days": F.coalesce(F.col("age_days"), F.col("reported_age_days")),
        }
    ).drop("effective_price")


def micros_until_change(offers: DataFrame, as_of: datetime) -> DataFrame:
    """Add `until_change`: microseconds until an offer's answer may change; null when it never will."""
    now = instant_lit(as_of)
    moment = F.unix_micros(now)
    live_left = F.when(_from_live(), F.unix_micros("live_observed_at") + MAX_LIVE_HOURS * HOUR_MICROS - moment)
    report_left = F.when(
        F.col("reported_at") <= now, F.unix_micros("reported_at") + MAX_REPORT_DAYS * DAY_MICROS - moment
    )
    # least() skips nulls in Spark, so an expired or missing bound simply does not take part.
    left = F.least(F.when(live_left > 0, live_left), F.when(report_left > 0, report_left))
    return choose(offers, now).withColumn("until_change", left).drop("price_reason")


def next_change(offers: DataFrame, as_of: datetime, cutoff_at: datetime) -> DataFrame:
    """The first instant after `as_of` at which any offer's answer may change."""
    check_clock(as_of, cutoff_at)
    soonest = F.unix_micros(instant_lit(as_of)) + F.min("until_change")
    return micros_until_change(offers, as_of).agg(F.timestamp_micros(soonest).alias("refresh_at"))


def effective_source_counts(offers: DataFrame, by: Sequence[str], now: datetime, cutoff_at: datetime) -> DataFrame:
    """Offers by effective source at the later of the clock and the cutoff."""
    at = instant_lit(max(instant(now), instant(cutoff_at)))
    source = F.coalesce(effective_source(), F.lit("none")).alias("source")
    return choose(offers, at).groupBy(*by, source).agg(F.count(F.lit(1)).alias("n"))


# --- comparing two versions ---------------------------------------------------------------------


def version_diff(candidate: DataFrame, published: DataFrame, key: str = "id") -> DataFrame:
    """Offers whose live price differs, appears or disappears between two versions."""
    c = candidate.select(key, F.col("live_price").alias("new_price"), F.lit(True).alias("_new"))
    p = published.select(
        key, F.col("live_price").alias("old_price"), F.col("live_observed_at"), F.lit(True).alias("_old")
    )
    change = (
        F.when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("old_price").eqNullSafe(F.col("new_price")), F.lit("same"))
        .when(F.col("old_price").isNull(), F.lit("appears"))
        .when(F.col("new_price").isNull(), F.lit("disappears"))
        .otherwise(F.lit("changed"))
    )
    return c.join(p, key, "full").select(
        key, "old_price", "new_price", "live_observed_at", F.col("_old").isNotNull().alias("was_published"),
        change.alias("change"),
    )


def republish_decision(diff: DataFrame, now: datetime) -> DataFrame:
    """One row: is the new version worth publishing, why, and how many offers changed."""
    clock = instant_lit(now)
    totals = diff.agg(
        F.count_if("was_published").alias("published"),
        F.count_if(F.col("change") != "removed").alias("candidates"),
        F.count_if(F.col("change") != "same").alias("changed"),
        F.min("live_observed_at").alias("oldest"),
    )
    aged = F.coalesce(
        F.unix_micros(clock) - F.unix_micros("oldest") > REPUBLISH_HOURS * HOUR_MICROS, F.lit(False)
    )
    reason = (
        F.when(F.col("published") == 0, F.lit("nothing_published"))
        .when(F.col("changed") > 0, F.lit("effective_price_changes"))
        .when(aged, F.lit("published_capture_ages"))
        .otherwise(F.lit("unchanged"))
    )
    changed = F.when(F.col("published") == 0, F.col("candidates")).otherwise(F.col("changed"))
    return totals.select(
        (reason != "unchanged").alias("visible"), reason.alias("reason"), changed.alias("changed_offers")
    )
