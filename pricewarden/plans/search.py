"""The interactive query: offers of a view, at an instant, around a point or in a district."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.operators import listing, pricing
from pricewarden.operators.listing import Origin
from pricewarden.session import cut_lineage


@dataclass(frozen=True)
class Search:
    products: Sequence[str]
    product: str
    origin: Origin | None = None
    district: object | None = None
    radius_km: float = listing.RADIUS_MIN_KM
    sort: str = "distance"
    visible: int = listing.PAGE_SIZE


@dataclass(frozen=True)
class Results:
    items: DataFrame
    summary: dict[str, object]


def site_table(offers: DataFrame, products: Sequence[str], as_of: datetime, cutoff_at: datetime) -> DataFrame:
    return listing.site_rows(pricing.evaluate(offers, as_of, cutoff_at), products)


def start(rows: DataFrame, search: Search) -> Search:
    """Opening state of a search around a point: the radius that shows a first page of priced rows."""
    if search.origin is None:
        return search
    priced = listing.with_distance(rows.where("has_price"), search.origin)
    radius = listing.initial_radius(priced).first()["radius_km"]
    return replace(search, radius_km=radius, sort="distance", visible=listing.PAGE_SIZE)


def run(rows: DataFrame, search: Search) -> Results:
    """One page of ordered rows plus the flags the page shows, in two passes over the site rows, computed once.

    The first folds everything the flags need into one row; the second is a top-k, stored once. Only that row
    and the count of priced rows on the page reach the driver.
    """
    around = search.origin is not None
    price = F.col(f"price_{search.product}")["price"]
    if around:
        located = listing.with_distance(rows, search.origin)
        listing.check_radius(search.radius_km)
        member = F.col("distance_km") <= search.radius_km
    else:
        located = rows.withColumn("distance_km", F.lit(None).cast("double"))
        member = F.coalesce(F.col("district") == F.lit(search.district), F.lit(False))
    located = cut_lineage(located)
    facts = located.agg(
        F.coalesce(F.bool_or("has_price"), F.lit(False)).alias("has_prices"),
        F.count_if(member).alias("total"),
        *listing.inert_counts(),
        *listing.tag_folds(price, member),
    ).first()
    has_prices, total = facts["has_prices"], facts["total"]
    by_price = not around or (has_prices and search.sort == "price")
    size = listing.shown(search.visible, total)
    keys = listing.order_keys("price" if by_price else "distance", price)
    pool = located.where(member)
    if around:
        pool = pool.where(listing.near(search.origin, search.radius_km))
    page = cut_lineage(pool.orderBy(*keys).limit(size))
    comparable = page.where("has_price").count()
    items = page.withColumns({"cheapest": F.lit(False), "also_nearest": F.lit(False)})
    if around and comparable > 1 and facts["_cheapest"] is not None:
        best = facts["_cheapest"]["site_id"]
        mine = F.col("site_id") == F.lit(best)
        nearest = facts["_nearest"]["site_id"] == best
        items = items.withColumns({"cheapest": mine, "also_nearest": mine & F.lit(nearest)})
    criterion = "price" if search.sort == "price" or not around else "distance"
    return Results(
        items,
        {
            "total": total,
            "shown": size,
            "remaining": total - size,
            "next_visible": listing.next_visible(size, total),
            "paged": total > size or total > listing.PAGE_SIZE + listing.SHOW_ALL_THRESHOLD,
            "comparable": comparable,
            "sort_toggle": around and comparable >= 2,
            "product_toggle": len(search.products) > 1 and by_price and comparable >= 2,
            "radius_inert": facts["near"] == facts["far"] if around else None,
            "radius_empty": around and size == 0,
            "district_empty": not around and total == 0,
            "criterion": criterion if has_prices else "none",
        },
    )
