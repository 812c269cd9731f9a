"""Rows of a result list: one per site, with distance, radius, order, paging and the cheapest tag."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.functions.geo import box_around, checked_distance_km
from pricewarden.functions.ordering import predecessor

PAGE_SIZE = 6
SHOW_ALL_THRESHOLD = 4
RADIUS_MIN_KM, RADIUS_MAX_KM, RADIUS_STEP_KM = 1.0, 5.0, 0.5
SITE_ATTRIBUTES = ("address", "district", "latitude", "longitude", "brand", "site_name")


def site_rows(evaluated: DataFrame, products: Sequence[str], attributes: Sequence[str] = SITE_ATTRIBUTES) -> DataFrame:
    """One row per site from visible offers of every product.

    Attributes come from the first offer in (fresh before expired, product order, offer id); a product's
    price from its last fresh offer by id. Offers fold per (site, product) first, so the wide pivot only
    sees one row per product and a site with any number of offers is combined before the shuffle.
    """
    position = F.array_position(F.array(*[F.lit(p) for p in products]), F.col("product"))
    fresh = F.col("state") == "fresh"
    attributes = [a for a in attributes if a in evaluated.columns]
    cell = F.struct(
        "id", "price", "reported_at", "age_days", F.col("price_source").alias("source"), F.col("price_at").alias("at")
    )
    per_product = (
        evaluated.groupBy("site_id", "product")
        .agg(
            F.max(F.when(fresh, cell)).alias("_cell"),
            F.min(F.struct((~fresh).alias("late"), "id", *attributes)).alias("_first"),
            F.min(F.when(fresh, F.struct("age_days", "id", "price_source"))).alias("_age"),
            F.min(F.struct("reported_age_days", (~fresh).alias("late"), "id", "reported_at")).alias("_silence"),
            F.max("live_observed_at").alias("last_observed_at"),
        )
        .withColumn("_position", position)
    )
    silence = F.col("_silence")
    folded = per_product.groupBy("site_id").agg(
        F.min(
            F.struct(
                F.col("_first.late"), F.col("_position"), *[F.col(f"_first.{c}").alias(c) for c in ("id", *attributes)]
            )
        ).alias("_first"),
        *[F.max(F.when(F.col("product") == p, F.col("_cell"))).alias(f"price_{p}") for p in products],
        F.min(
            F.when(
                F.col("_age").isNotNull(), F.struct("_age.age_days", "_position", "_age.id", "_age.price_source")
            )
        ).alias("_age"),
        F.min(
            F.when(
                silence["reported_age_days"].isNotNull(),
                F.struct(
                    silence["reported_age_days"].alias("days"),
                    silence["late"].alias("late"),
                    F.col("_position"),
                    silence["id"].alias("id"),
                    silence["reported_at"].alias("at"),
                ),
            )
        ).alias("_silence"),
        F.max("last_observed_at").alias("last_observed_at"),
    )
    has_price = F.lit(False)
    for product in products:
        has_price = has_price | F.col(f"price_{product}").isNotNull()
    return folded.select(
        "site_id",
        *[F.col(f"_first.{a}").alias(a) for a in attributes],
        *[f"price_{p}" for p in products],
        F.col("_age.age_days").alias("age_days"),
        F.col("_age.price_source").alias("age_source"),
        F.col("_silence.days").alias("silent_days"),
        F.col("_silence.at").alias("last_reported_at"),
        "last_observed_at",
        has_price.alias("has_price"),
    )


def merged_cutoff(loaded: DataFrame) -> DataFrame:
    """Oldest cutoff of the loaded products; the whole is `saved` if any part is."""
    return loaded.agg(
        F.min("cutoff_at").alias("cutoff_at"),
        F.when(F.bool_or(F.col("data_mode") == "saved"), F.lit("saved")).otherwise(F.lit("network")).alias("data_mode"),
    )


@dataclass(frozen=True)
class Origin:
    latitude: float
    longitude: float


def with_distance(rows: DataFrame, origin: Origin) -> DataFrame:
    return rows.withColumn(
        "distance_km",
        checked_distance_km(
            F.lit(origin.latitude), F.lit(origin.longitude), F.col("latitude"), F.col("longitude")
        ),
    )


def check_radius(radius_km: float) -> None:
    if not radius_km > 0 or radius_km == float("inf"):
        raise ValueError("the radius must be a positive number")


def near(origin: Origin, radius_km: float) -> Column:
    """The box that encloses the radius: plain comparisons that reach the scan."""
    return box_around(F.col("latitude"), F.col("longitude"), origin.latitude, origin.longitude, radius_km)


def within_radius(rows: DataFrame, origin: Origin, radius_km: float) -> DataFrame:
    """Rows no farther than the radius; the enclosing box is tested before any trigonometry."""
    check_radius(radius_km)
    return with_distance(rows.where(near(origin, radius_km)), origin).where(F.col("distance_km") <= radius_km)


def order_keys(criterion: str, price: Column | None = None) -> list[Column]:
    """Sort keys: by distance, or by a product's price with missing prices last; ties by site."""
    if criterion == "distance":
        return [F.col("distance_km").asc_nulls_last(), F.col("site_id").asc()]
    if criterion == "price" and price is not None:
        return [price.asc_nulls_last(), F.col("site_id").asc()]
    raise ValueError(f"unknown order: {criterion}")


def next_visible(current: int, total: int) -> int:
    return total if total - current * 2 <= SHOW_ALL_THRESHOLD else current * 2


def shown(visible: int, total: int) -> int:
    """Rows on the page: what was asked for, or everything if only a few would remain."""
    asked = min(visible, total)
    return total if total - asked <= SHOW_ALL_THRESHOLD else asked


def initial_radius(rows: DataFrame, target: int = PAGE_SIZE) -> DataFrame:
    """Smallest stepped radius, within bounds, that holds `target` priced rows."""
    nearest = rows.select("distance_km").orderBy("distance_km").limit(target)
    reach = F.when(F.count(F.lit(1)) >= target, F.max("distance_km")).otherwise(F.lit(RADIUS_MAX_KM))
    stepped = F.round(F.ceil(reach / RADIUS_STEP_KM) * RADIUS_STEP_KM, 1)
    return nearest.agg(
        F.least(F.lit(RADIUS_MAX_KM), F.greatest(F.lit(RADIUS_MIN_KM), stepped)).alias("radius_km")
    )


def inert_counts() -> list[Column]:
    return [
        F.count_if(F.col("distance_km") <= RADIUS_MIN_KM).alias("near"),
        F.count_if(F.col("distance_km") <= RADIUS_MAX_KM).alias("far"),
    ]


def radius_is_inert(rows: DataFrame) -> DataFrame:
    """Does the radius filter change nothing between its two bounds?"""
    return rows.agg(*inert_counts()).withColumn("inert", F.col("near") == F.col("far"))


def districts(rows: DataFrame) -> DataFrame:
    return rows.select("district").distinct().orderBy("district")


def tag_folds(price: Column, member: Column) -> list[Column]:
    """Cheapest and nearest member of the pool as two folds: no sort."""
    cheap = F.struct(price.alias("price"), F.col("distance_km"), F.col("site_id"))
    return [
        F.min(F.when(member & price.isNotNull(), cheap)).alias("_cheapest"),
        F.min(F.when(member, F.struct("distance_km", "site_id"))).alias("_nearest"),
    ]


def cheapest_tag(pool: DataFrame, price: Column) -> DataFrame:
    """The cheapest row of the pool by (price, distance, site), and whether it is also the nearest."""
    return (
        pool.agg(*tag_folds(price, F.lit(True)))
        .where(F.col("_cheapest").isNotNull())
        .select(
            F.col("_cheapest.site_id").alias("site_id"),
            F.col("_cheapest.price").alias("price"),
            F.col("_cheapest.distance_km").alias("distance_km"),
            (F.col("_cheapest.site_id") == F.col("_nearest.site_id")).alias("also_nearest"),
        )
    )


def predecessors(rows: DataFrame, order: Sequence[Column], key: str) -> DataFrame:
    """Each row with the one before it, which states a whole order without numbering it."""
    return predecessor(rows, order, key, "after_site")
