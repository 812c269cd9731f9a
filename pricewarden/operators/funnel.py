"""Where reports are lost: stage metrics, loss funnel and the deepest stage each site reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.operators.reports import PRODUCT_KEY


def _stages() -> dict[str, Column]:
    fresh = ~F.col("expired")
    return {
        "latest_offers": F.lit(True),
        "latest_in_scope": F.col("in_scope"),
        "fresh": F.col("publishable") & fresh,
        "registry_exact": F.col("registered") & fresh,
        "gis_safe": F.col("located") & fresh,
        "contract_ready": F.col("ready") & fresh,
        "published": F.col("ready"),
        "silent": F.col("ready") & F.col("expired"),
    }


def stage_metrics(staged: DataFrame) -> DataFrame:
    """Offers and districts per stage, coverage and conflict counts, one row per product.

    Counting by district first makes the distinct counts plain sums: no row is expanded per stage.
    """
    stages = _stages()
    conflicts = {
        "latest_price_conflicts": F.col("in_scope") & F.col("price_conflict"),
        "latest_territory_conflicts": F.col("in_scope") & F.col("territory_conflict"),
        "registry_ambiguous": F.col("publishable") & (F.col("registry_matches") > 1),
        "gis_ambiguous": F.col("registered") & (F.col("point_matches") > 1),
        "raw_duplicate": F.col("repeated"),
    }
    by_district = staged.groupBy(*PRODUCT_KEY, "district").agg(
        *[F.count_if(test).alias(name) for name, test in {**stages, **conflicts}.items()]
    )
    totals = by_district.groupBy(*PRODUCT_KEY).agg(
        *[F.sum(name).alias(f"{name}_offers") for name in stages],
        *[F.count_if(F.col(name) > 0).alias(f"{name}_districts") for name in stages],
        *[F.sum(name).alias(name) for name in conflicts],
    )
    ready, fresh = F.col("contract_ready_offers"), F.col("fresh_offers")
    return totals.withColumns(
        {
            "coverage_percent": F.when(fresh > 0, F.round(ready / fresh * 100, 3)).otherwise(F.lit(0.0)),
            "registry_excluded": fresh - F.col("registry_exact_offers"),
            "gis_excluded": F.col("registry_exact_offers") - F.col("gis_safe_offers"),
            "identity_excluded": F.col("gis_safe_offers") - ready,
        }
    )


def loss_reason() -> Column:
    return (
        F.when(~F.col("publishable"), F.col("not_fresh_reason"))
        .when(~F.col("registered"), F.lit(R.NO_REGISTRY))
        .when(~F.col("located"), F.lit(R.NO_UNIQUE_POINT))
        .when(F.col("repeated"), F.lit(R.REPEATED_ID))
        .when(~F.col("ready"), F.lit(R.NO_IDENTITY))
        .when(F.col("expired"), F.lit(R.PUBLISHED_EXPIRED))
        .otherwise(F.lit(R.PUBLISHED))
    )


def loss_funnel(staged: DataFrame) -> DataFrame:
    """Latest reports in scope by product, district and the one reason they ended in."""
    return (
        staged.where("in_scope")
        .withColumn("reason", loss_reason())
        .groupBy(*PRODUCT_KEY, "district", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def district_funnel(staged: DataFrame) -> DataFrame:
    """The same losses as one row per district."""
    ready = F.col("reason").isin(R.PUBLISHED, R.PUBLISHED_EXPIRED)
    return (
        staged.where("in_scope")
        .withColumn("reason", loss_reason())
        .groupBy(*PRODUCT_KEY, "district")
        .agg(
            F.count(F.lit(1)).alias("latest"),
            F.count_if(F.col("publishable") & ~F.col("expired")).alias("fresh"),
            F.count_if(F.col("reason") == R.PUBLISHED).alias("contract_ready"),
            F.count_if(ready).alias("published"),
        )
    )


def deepest_stage(staged: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """For every registered site without an offer: how far its best report got."""
    depth = (
        F.when(F.col("ready"), F.lit(5))
        .when(F.col("repeated"), F.lit(4))
        .when(F.col("located"), F.lit(3))
        .when(F.col("registered"), F.lit(2))
        .when(F.col("publishable"), F.lit(1))
        .otherwise(F.lit(0))
    )
    reached = (
        staged.where("in_scope")
        .withColumn("_depth", depth)
        .groupBy(*PRODUCT_KEY, "registration")
        .agg(
            F.max("_depth").alias("_depth"),
            F.min_by("not_fresh_reason", F.when(F.col("not_fresh_reason").isNotNull(), F.col("id"))).alias("_why"),
        )
    )
    codes = rules.select(*PRODUCT_KEY, "code").distinct()
    universe = (
        registry.join(F.broadcast(codes), "code")
        .where(F.trim(F.col("registration").cast("string")) != "")
        .select(*PRODUCT_KEY, "registration")
        .distinct()
    )
    stage = (
        F.when(F.col("_depth") == 4, F.lit(R.REPEATED_ID))
        .when(F.col("_depth") == 3, F.lit(R.NO_IDENTITY))
        .when(F.col("_depth") == 2, F.lit(R.NO_UNIQUE_POINT))
        .when(F.col("_depth") == 1, F.lit(R.NO_REGISTRY))
        .otherwise(F.coalesce(F.col("_why"), F.lit(R.NEVER_REPORTED)))
    )
    return (
        universe.join(reached, [*PRODUCT_KEY, "registration"], "left")
        .where(F.coalesce(F.col("_depth"), F.lit(0)) < 5)
        .select(*PRODUCT_KEY, "registration", stage.alias("stage"))
    )
