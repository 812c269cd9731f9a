"""Price reports: selection, latest per key, safe lookups and publishability.

Column names used below
    reports   id, activity, registration, department, province, district, reported_at (timestamp),
              price (double), product_name, unit and, where the feed has it, client_type
    registry  code, registration, department, province, district
    points    layer, registration, department, province, district, longitude, latitude
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.functions.geo import in_published_box
from pricewarden.functions.parse import positive
from pricewarden.functions.skew import spread
from pricewarden.session import cut_lineage

FRESH_DAYS = 30
PRODUCT_KEY = ("group", "product")


def source_max_reported_at(reports: DataFrame) -> DataFrame:
    """Newest readable instant over every row, before any filter."""
    return reports.agg(F.max("reported_at").alias("source_max_reported_at"))


def select_candidates(reports: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that name a configured activity and product, tagged with why they are left out, if they are.

    The configuration is a few dozen literal rows, so the hint broadcasts a side of known size.
    """
    client = F.col("client_type") if "client_type" in reports.columns else F.lit(None).cast("string")
    r = reports.withColumn("_client", client).drop("client_type")
    c = rules.select(
        *PRODUCT_KEY,
        "activity",
        "code",
        "layer",
        F.col("canonical").alias("product_name"),
        F.col("unit").alias("_unit"),
        F.col("client_type").alias("_wanted_client"),
        F.col("department").alias("scope_department"),
        F.col("province").alias("scope_province"),
        "id_prefix",
    )
    joined = r.join(F.broadcast(c), ["activity", "product_name"])
    exclusion = F.when(~F.col("unit").eqNullSafe(F.col("_unit")), F.lit(R.OTHER_UNIT)).when(
        F.col("_wanted_client").isNotNull() & ~F.col("_client").eqNullSafe(F.col("_wanted_client")),
        F.lit(R.OTHER_CLIENT),
    )
    return joined.withColumn("exclusion", exclusion).drop("_unit", "_wanted_client", "_client")


def exclusion_counts(candidates: DataFrame) -> DataFrame:
    """Rows per product: those that enter the funnel and those left out, by reason, in one pass."""
    return candidates.groupBy(*PRODUCT_KEY).agg(
        F.count_if(F.col("exclusion").isNull()).alias("source_rows"),
        F.count_if(F.col("exclusion") == R.OTHER_UNIT).alias("other_unit"),
        F.count_if(F.col("exclusion") == R.OTHER_CLIENT).alias("other_client"),
    )


def latest_per_key(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    id_col: str = "id",
    instant: str = "reported_at",
    price: str = "price",
    territory: Sequence[str] = ("department", "province", "district"),
) -> DataFrame:
    """The rows at each key's newest instant, folded into one: smallest id, and whether they disagree.

    The newest instant of each key is one number, so the feed is folded by hashing alone, before the shuffle and after it. A
    semi-join leaves the rows at that instant; only these, one for most keys, are folded with all their columns.
    Unreadable instants are ignored, and a key with nothing else disappears. A missing key value is a value of its own.
    """
    rest = [c for c in rows.columns if c not in (*keys, id_col, instant)]
    where = F.struct(*[F.col(c) for c in territory])
    read = rows.where(F.col(instant).isNotNull())
    newest = read.groupBy(*keys).agg(F.max(instant).alias(instant))
    same = reduce(lambda x, y: x & y, [F.col(f"_row.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in (*keys, instant)])
    tied = read.alias("_row").join(newest.alias("_new"), same, "left_semi")
    return (
        tied.groupBy(*keys)
        .agg(
            F.first(instant).alias(instant),
            F.min(F.struct(F.col(id_col), *[F.col(c) for c in rest])).alias("_row"),
            F.min(price).alias("_p0"),
            F.max(price).alias("_p1"),
            F.min(where).alias("_t0"),
            F.max(where).alias("_t1"),
        )
        .select(
            *keys,
            instant,
            F.col(f"_row.{id_col}").alias(id_col),
            *[F.col(f"_row.{c}").alias(c) for c in rest],
            (~F.col("_p0").eqNullSafe(F.col("_p1"))).alias("price_conflict"),
            (~F.col("_t0").eqNullSafe(F.col("_t1"))).alias("territory_conflict"),
        )
    )


def publishability(
    reported_at: Column, price: Column, price_conflict: Column, territory_conflict: Column, cutoff: Column
) -> dict[str, Column]:
    """Why a latest report cannot be published, and, independently, whether it is too old to show a price."""
    broken = (
        F.when(reported_at.isNull() | (reported_at > cutoff), F.lit(R.INVALID_REPORT))
        .when(price_conflict | territory_conflict | ~positive(price), F.lit(R.CONFLICT))
        .otherwise(F.lit(None).cast("string"))
    )
    expired = F.coalesce(reported_at < cutoff - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"), F.lit(False))
    return {
        "unpublishable_reason": broken,
        "expired": expired,
        "not_fresh_reason": F.coalesce(broken, F.when(expired, F.lit(R.EXPIRED_REPORT))),
    }


def in_scope(prefix: str = "") -> Column:
    return F.coalesce(
        (F.col(f"{prefix}department") == F.col("scope_department"))
        & (F.col(f"{prefix}province") == F.col("scope_province")),
        F.lit(False),
    )


def safe_lookup(
    left: DataFrame, dim: DataFrame, keys: Sequence[str], fields: Sequence[str], prefix: str
) -> DataFrame:
    """Attach the dimension row of each key, but only if the key names exactly one.

    The dimension is folded to one row per key first, so the join can neither multiply rows nor pick
    one of several. `<prefix>matches` keeps how many there were. A dimension of few bytes can have many rows: it is dealt out
    before it is folded, as sorting takes a task's whole share, and never broadcast on an estimate.
    """
    folded = spread(dim.select(*dict.fromkeys([*keys, *fields]))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}matches"),
        F.min(F.struct(*[F.col(f) for f in fields])).alias(f"_{prefix}row"),
    )
    joined = left.join(folded.hint("merge"), list(keys), "left")
    matches = F.coalesce(F.col(f"{prefix}matches"), F.lit(0).cast("long"))
    only = matches == 1
    return joined.select(
        *left.columns,
        matches.alias(f"{prefix}matches"),
        *[F.when(only, F.col(f"_{prefix}row.{f}")).alias(f"{prefix}{f}") for f in fields],
    )


def guarded_identities(raw: DataFrame, targets: DataFrame, id_cols: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Private columns of the selected ids. An id that occurs twice is reported as such, never resolved.

    `targets` names ids by all their columns or by some of them; the raw table is read once.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    by = [c for c in ids if c in targets.columns]
    wanted = raw.join(targets.select(*by), by, "left_semi")
    return (
        wanted.groupBy(*ids)
        .agg(
            F.count(F.lit(1)).alias("raw_rows"),
            F.min(F.struct(*[F.col(f) for f in fields])).alias("_row"),
        )
        .select(
            *ids,
            (F.col("raw_rows") > 1).alias("repeated"),
            *[F.when(F.col("raw_rows") == 1, F.col(f"_row.{f}")).alias(f) for f in fields],
        )
    )


def stage_reports(
    reports: DataFrame, rules: DataFrame, registry: DataFrame, points: DataFrame, cutoff: Column
) -> DataFrame:
    """Every latest report of every product with the funnel stages it passed, as flags on one row."""
    candidates = select_candidates(reports, rules).where(F.col("exclusion").isNull()).drop("exclusion")
    keys = [*PRODUCT_KEY, "registration", "code", "product_name", "unit"]
    latest = latest_per_key(candidates, keys)
    state = publishability(
        F.col("reported_at"), F.col("price"), F.col("price_conflict"), F.col("territory_conflict"), cutoff
    )
    staged = latest.withColumns({**state, "in_scope": in_scope()}).withColumn(
        "publishable", F.col("in_scope") & F.col("unpublishable_reason").isNull()
    )
    places = ["department", "province", "district"]
    staged = safe_lookup(staged, registry, ["code", "registration"], places, "registry_")
    staged = staged.withColumn(
        "registered",
        F.col("publishable")
        & (F.col("registry_matches") == 1)
        & in_scope("registry_")
        & F.col("registry_district").eqNullSafe(F.col("district")),
    )
    staged = safe_lookup(
        staged, points, ["layer", "registration"], [*places, "longitude", "latitude"], "point_"
    )
    return staged.withColumn(
        "located",
        F.col("registered")
        & (F.col("point_matches") == 1)
        & in_scope("point_")
        & F.col("point_district").eqNullSafe(F.col("district"))
        & in_published_box(F.col("point_longitude"), F.col("point_latitude")),
    )


def attach_identities(staged: DataFrame, raw: DataFrame, id_col: str = "id") -> DataFrame:
    """Legal name and address of the very report that is published; adds the last two stages.

    The staged rows are stored once: they say which reports to look up. The answers are stored by id alone and joined to them
    where they are read.
    """
    staged = cut_lineage(staged)
    identities = cut_lineage(guarded_identities(raw, staged.where("located"), id_col, ["legal_name", "address"]))
    joined = staged.join(identities, id_col, "left")
    complete = (F.coalesce(F.col("legal_name"), F.lit("")) != "") & (F.coalesce(F.col("address"), F.lit("")) != "")
    repeated = F.col("located") & F.coalesce(F.col("repeated"), F.lit(False))
    return joined.withColumns({"repeated": repeated, "ready": F.col("located") & ~repeated & complete})
