"""Live captures: whole-unit acceptance, keyed state, links to offers and regressions.

A unit is everything read for one (district_code, product). Headers and rows are two long tables:
    units   district_code, product, observed_at, announced_total, last_attempt_at, last_attempt_status
    rows    district_code, product, observed_at, key_hash, price
Rows belong to the header with the same unit and instant, so replacing a unit is one header update
and no array ever grows with a district.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.functions.parse import parse_captured_price, positive
from pricewarden.functions.text import fold_text, link_key, link_text
from pricewarden.operators.pricing import HOUR_MICROS, MAX_LIVE_HOURS, instant_lit

UNIT = ("district_code", "product")


# --- acceptance ---------------------------------------------------------------------------------


# What can be wrong with a row, in the order in which its parts are judged.
ROW_FAULTS = (R.BAD_WIDTH, R.WRONG_DISTRICT, R.WRONG_UNIT, R.BAD_PRICE)


def _fault(reason: str) -> Column:
    """Place and kind of a fault as one number, so that the first of a unit is a plain minimum."""
    return F.col("row_ordinal").cast("long") * len(ROW_FAULTS) + ROW_FAULTS.index(reason)


def accept_units(units: DataFrame, rows: DataFrame, *, width: int, unit_name: str | None = None) -> DataFrame:
    """Each unit with `status`: ok, or the first failure, which rejects every row of the unit.

    units   UNIT, district_name, rejection, state, product_ok, headers_ok, complete, announced_total, observed_at
    rows    UNIT, row_ordinal, width, district_text, unit_text, price_text

    Rows are judged in order, and within a row: width, district, unit, price. They are folded by
    (unit, district text) before they meet the unit's own district name, so a unit of any size
    reaches the join as one row per spelling. Faults are folded as numbers and named once per unit.
    """
    bad_width = F.coalesce(F.col("width") != width, F.lit(True))
    own = F.when(bad_width, _fault(R.BAD_WIDTH))
    if unit_name:
        other_unit = F.coalesce(link_text(F.col("unit_text")) != F.lit(" ".join(fold_text(unit_name).split())), F.lit(True))
        own = own.when(other_unit, _fault(R.WRONG_UNIT))
    own = own.when(~positive(parse_captured_price(F.col("price_text"))), _fault(R.BAD_PRICE))
    spelled = rows.groupBy(*UNIT, "district_text").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(own).alias("_own"),
        F.min(F.when(~bad_width, _fault(R.WRONG_DISTRICT))).alias("_district"),
    )
    same = link_text(F.col("district_text")) == link_text(F.col("district_name"))
    folded = (
        spelled.join(units.select(*UNIT, "district_name"), list(UNIT))
        .groupBy(*UNIT)
        .agg(
            F.sum("_rows").alias("_rows"),
            F.min(F.least(F.col("_own"), F.when(~same, F.col("_district")))).alias("_bad"),
        )
    )
    n = F.coalesce(F.col("_rows"), F.lit(0).cast("long"))
    status = (
        F.when(F.col("rejection").isNotNull(), F.col("rejection"))
        .when(F.coalesce(F.col("state") != "ok", F.lit(True)), F.coalesce(F.col("state"), F.lit(R.NO_ANSWER)))
        .when(~F.coalesce(F.col("product_ok"), F.lit(True)), F.lit(R.WRONG_PRODUCT))
        .when(~F.col("headers_ok"), F.lit(R.UNKNOWN_HEADERS))
        .when(F.col("_bad").isNotNull(), F.get(F.array(*[F.lit(f) for f in ROW_FAULTS]), F.pmod(F.col("_bad"), F.lit(len(ROW_FAULTS))).cast("int")))
        .when(~F.coalesce(F.col("complete"), F.lit(False)), F.lit(R.INCOMPLETE))
        .when(F.col("announced_total") != n, F.lit(R.WRONG_TOTAL))
        .otherwise(F.lit(R.ATTEMPT_OK))
    )
    return units.join(folded, list(UNIT), "left").select(
        *UNIT, "observed_at", "announced_total", n.alias("rows_read"), status.alias("status")
    )


def accepted_rows(rows: DataFrame, accepted: DataFrame, scheme: str, keep: Sequence[str] = ()) -> DataFrame:
    """Link key and price of the rows of accepted units; names and addresses go no further."""
    good = accepted.where(F.col("status") == R.ATTEMPT_OK).select(*UNIT, "observed_at")
    return rows.join(good, list(UNIT)).select(
        *UNIT,
        *keep,
        "observed_at",
        link_key(F.col("name_text"), F.col("address_text"), F.col("district_text"), scheme).alias("key_hash"),
        parse_captured_price(F.col("price_text")).alias("price"),
    )


# --- state --------------------------------------------------------------------------------------


def fold_attempts(attempts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Attempts of one run folded per unit, as if applied one after the other in `seq` order.

    The winner is the newest good attempt (the earlier of equals); the last attempt only annotates.
    """
    good = F.col("status") == R.ATTEMPT_OK
    newest = F.struct(F.unix_micros("observed_at").alias("at"), (-F.col("seq")).alias("seq"))
    body = F.struct("observed_at", "announced_total", "seq", *extra)
    return attempts.groupBy(*UNIT).agg(
        F.max_by(body, F.when(good, newest)).alias("win"),
        F.max_by(F.struct("status", "seq"), F.col("seq")).alias("last"),
        F.count_if(good).alias("good"),
        F.count(F.lit(1)).alias("tries"),
    )


def apply_run(previous: DataFrame, attempts: DataFrame, attempted_at: datetime, extra: Sequence[str] = ()) -> DataFrame:
    """Next unit headers. A good unit replaces an older one; nothing is ever made younger.

    A failed or outdated attempt leaves the unit as it was and is noted beside it.
    """
    fields = ["observed_at", "announced_total", *extra]
    old = previous.select(
        *UNIT,
        F.struct(*fields).alias("old"),
        F.struct("last_attempt_at", "last_attempt_status").alias("old_attempt"),
    )
    joined = old.join(fold_attempts(attempts, extra), list(UNIT), "full")
    newer = F.col("win").isNotNull() & F.coalesce(
        F.col("win.observed_at") > F.col("old.observed_at"), F.lit(True)
    )
    tried = F.col("last").isNotNull()
    status = (
        F.when(F.col("last.status") != R.ATTEMPT_OK, F.col("last.status"))
        .when(newer & (F.col("win.seq") == F.col("last.seq")), F.lit(R.ATTEMPT_OK))
        .otherwise(F.lit(R.ATTEMPT_STALE))
    )
    return joined.where(F.col("old").isNotNull() | newer).select(
        *UNIT,
        *[F.when(newer, F.col(f"win.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields],
        F.when(tried, instant_lit(attempted_at)).otherwise(F.col("old_attempt.last_attempt_at")).alias(
            "last_attempt_at"
        ),
        F.when(tried, status).otherwise(F.col("old_attempt.last_attempt_status")).alias("last_attempt_status"),
    )


def current_rows(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows that the current headers stand for; rows of replaced units fall away."""
    return rows.join(units.select(*UNIT, "observed_at"), [*UNIT, "observed_at"], "left_semi")


def run_counts(units: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fresh, failed and reused units per product, from a full outer join of two small counts."""
    tried = attempts.groupBy("product").agg(
        F.count_if(F.col("status") == R.ATTEMPT_OK).alias("fresh"),
        F.count_if(F.col("status") != R.ATTEMPT_OK).alias("failed"),
    )
    kept = units.groupBy("product").agg(
        F.count(F.lit(1)).alias("_units"), F.max("observed_at").alias("newest_observed_at")
    )
    zero = F.lit(0).cast("long")
    return kept.join(tried, "product", "full").select(
        "product",
        F.coalesce("fresh", zero).alias("fresh"),
        F.coalesce("failed", zero).alias("failed"),
        F.greatest(zero, F.coalesce("_units", zero) - F.coalesce("fresh", zero)).alias("reused"),
        "newest_observed_at",
    )


def for_products(units: DataFrame, products: Sequence[str]) -> DataFrame:
    """The state as one group sees it: only the units of its products."""
    return units.where(F.col("product").isin(list(products)))


def group_counts(counts: DataFrame, products: Sequence[str]) -> DataFrame:
    """Run counts of the group's products added up; `reused` is recomputed, not summed."""
    units = F.col("reused") + F.col("fresh")
    return counts.where(F.col("product").isin(list(products))).agg(
        F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.greatest(F.lit(0), F.coalesce(F.sum(units) - F.sum("fresh"), F.lit(0))).alias("reused"),
    )


def unit_regressions(candidate: DataFrame, published: DataFrame, products: Sequence[str] | None = None) -> DataFrame:
    """Published units that the candidate lacks or holds at an older instant.

    Compared unit by unit: a newer maximum elsewhere never hides a unit that goes back in time.
    """
    p = published if products is None else for_products(published, products)
    c = candidate.select(*UNIT, F.col("observed_at").alias("candidate_at"))
    return (
        p.select(*UNIT, F.col("observed_at").alias("published_at"))
        .join(c, list(UNIT), "left")
        .where(F.col("candidate_at").isNull() | (F.col("candidate_at") < F.col("published_at")))
    )


def groups_behind(candidate: DataFrame, published: DataFrame) -> DataFrame:
    """Groups whose snapshot is older than the published one, or that are missing altogether."""
    c = candidate.select("group", F.col("snapshot_id").alias("candidate_snapshot"))
    return (
        published.select("group", F.col("snapshot_id").alias("published_snapshot"))
        .join(c, "group", "left")
        .where(F.col("candidate_snapshot").isNull() | (F.col("candidate_snapshot") < F.col("published_snapshot")))
        .withColumn("missing", F.col("candidate_snapshot").isNull())
    )


# --- link ---------------------------------------------------------------------------------------


def is_current(observed_at: Column, as_of: Column) -> Column:
    """Read within the last 24 hours and not in the future. Expired units stay in the state."""
    age = F.unix_micros(as_of) - F.unix_micros(observed_at)
    return F.coalesce(age.between(0, MAX_LIVE_HOURS * HOUR_MICROS), F.lit(False))


def link_keys(rows: DataFrame, offers: DataFrame, as_of: datetime) -> DataFrame:
    """Every live key with its outcome: linked, ambiguous or unlinked.

    A key that occurs more than once on either side is ambiguous; both sides are folded to one row
    per key before they meet, so a repeated key costs a counter and never a product of rows.
    """
    usable = is_current(F.col("observed_at"), instant_lit(as_of)) & F.col("key_hash").isNotNull() & positive(
        F.col("price")
    )
    live = rows.where(usable).groupBy("product", "key_hash").agg(
        F.count(F.lit(1)).alias("live_rows"),
        F.min(F.struct("price", "observed_at")).alias("_live"),
    )
    keyed = (
        offers.where(F.col("key_hash").isNotNull())
        .groupBy("product", "key_hash")
        .agg(F.count(F.lit(1)).alias("offers"), F.min("id").alias("_offer"))
    )
    status = (
        F.when((F.col("live_rows") > 1) | (F.coalesce(F.col("offers"), F.lit(0)) > 1), F.lit("ambiguous"))
        .when(F.col("offers").isNull(), F.lit("unlinked"))
        .otherwise(F.lit("linked"))
    )
    linked = F.col("status") == "linked"
    return (
        live.join(keyed, ["product", "key_hash"], "left")
        .withColumn("status", status)
        .select(
            "product",
            "key_hash",
            "status",
            F.when(linked, F.col("_offer")).alias("id"),
            F.when(linked, F.col("_live.price")).alias("live_price"),
            F.when(linked, F.col("_live.observed_at")).alias("live_observed_at"),
        )
    )


def link_counts(links: DataFrame, rows: DataFrame, units: DataFrame, as_of: datetime) -> DataFrame:
    """Rows in current units, keys by outcome and expired units, per product."""
    now = instant_lit(as_of)
    keys = links.groupBy("product").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("linked", "ambiguous", "unlinked")]
    )
    current = rows.groupBy("product").agg(F.count_if(is_current(F.col("observed_at"), now)).alias("rows"))
    expired = units.groupBy("product").agg(
        F.count_if(~is_current(F.col("observed_at"), now)).alias("expired_units")
    )
    joined = expired.join(current, "product", "full").join(keys, "product", "full")
    zero = F.lit(0).cast("long")
    return joined.select(
        "product",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("rows", "linked", "ambiguous", "unlinked", "expired_units")],
    )


def attach_live(offers: DataFrame, links: DataFrame) -> DataFrame:
    """Offers with the live price and instant of their link, null where there is none."""
    found = links.where(F.col("status") == "linked").select("id", "live_price", "live_observed_at")
    return offers.join(found, "id", "left")
