"""Places matched to registered sites: spatial pairs, corroboration, one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.functions import addresses as A
from pricewarden.functions import geo
from pricewarden.functions.graph import pair_components
from pricewarden.functions.skew import split_join, spread
from pricewarden.functions.text import fold
from pricewarden.session import cut_lineage

CANDIDATE_M = 150.0
FIRM_M = 80.0
MIN_MARGIN_M = 100.0
NEARBY_M = 40.0
CONFIRMING_WEIGHT = 25


# --- places -------------------------------------------------------------------------------------


def place_cards(harvest: DataFrame) -> DataFrame:
    """Fuel stations among harvested cards, one row per place id: the last card read wins.

    harvest  id, name, info array<string>, latitude, longitude, ordinal
    """
    last = (
        harvest.where(F.coalesce(F.col("id"), F.lit("")) != "")
        .withColumn("_fuel", _is_fuel(F.col("info"), F.col("name")))
        .where("_fuel")
        .groupBy("id")
        .agg(F.max(F.struct("ordinal", "name", "info", "latitude", "longitude")).alias("_c"))
        .select(F.col("id").alias("place_id"), "_c.*")
    )
    return last.select(
        "place_id",
        F.coalesce("name", F.lit("")).alias("place_name"),
        A.brand_in(F.coalesce("name", F.lit("")), A.CARD_BRANDS).alias("brand"),
        _category(F.col("info")).alias("category"),
        A.card_address(F.col("info")).alias("address"),
        "latitude",
        "longitude",
    )


def _category(info: Column) -> Column:
    lines = F.coalesce(info, F.array().cast("array<string>"))
    named = F.get(F.filter(lines, lambda t: t.rlike(A.FUEL_CATEGORY)), F.lit(0))
    return F.coalesce(named, F.get(lines, F.lit(0)), F.lit(""))


def _is_fuel(info: Column, name: Column) -> Column:
    return F.concat_ws(" ", _category(info), F.coalesce(name, F.lit(""))).rlike(A.FUEL_CATEGORY)


def last_wins(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row per key: the one with the highest ordinal."""
    rest = [c for c in rows.columns if c not in (*keys, ordinal)]
    top = F.max(F.struct(F.col(ordinal), *[F.col(c) for c in rest])).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, "_top.*")


# --- spatial ------------------------------------------------------------------------------------


def spatial_pairs(
    places: DataFrame, sites: DataFrame, metres: float = CANDIDATE_M, radius: float = geo.EARTH_M_ROUND
) -> DataFrame:
    """All (place, site) within `metres`. A grid turns the distance predicate into an equi-join.

    Each site sits in one cell and each place asks the few cells its circle touches, so a pair is
    found at most once. Crowded cells are split on both sides.
    """
    p = places.where(geo.is_coordinate(F.col("latitude"), F.col("longitude"))).withColumnsRenamed(
        {"latitude": "place_lat", "longitude": "place_lon"}
    )
    s = sites.where(geo.is_coordinate(F.col("latitude"), F.col("longitude"))).withColumnsRenamed(
        {"latitude": "site_lat", "longitude": "site_lon"}
    )
    p = p.withColumn("_cell", F.explode(geo.circle_probe(F.col("place_lat"), F.col("place_lon"), metres)))
    s = s.withColumn("_cell", geo.grid_cell(F.col("site_lat"), F.col("site_lon"), geo.grid_height(metres)))
    near = split_join(p, s, ["_cell"], ("place_id", "site_id"))
    distance = geo.haversine(F.col("place_lat"), F.col("place_lon"), F.col("site_lat"), F.col("site_lon"), radius)
    return near.withColumn("distance_m", distance).where(F.col("distance_m") <= metres).drop("_cell")


# A cell that a circle cuts is quartered as long as it holds more spots than this, down to a depth at which cells are points.
CELL_SPOTS = 24
MOST_QUARTERINGS = 16


def neighbour_counts(
    sites: DataFrame, metres: float, radius: float = geo.EARTH_M_ROUND, cell_spots: int = CELL_SPOTS
) -> DataFrame:
    """Sites within `metres` of each site, itself included.

    Sites on the same spot are counted once and weighted. Cells that lie wholly inside the circle add their
    total. A cell that the circle cuts is looked at spot by spot only if it holds few spots; else it is quartered, and so are
    its quarters, as deep as the spots lie dense. The rim that is compared spot by spot shrinks as the density grows, so a
    centre meets a number of cells and spots that hardly follows it.
    """
    spots = cut_lineage(sites.groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("n")))
    height = geo.grid_height(metres) / 2
    cell = lambda k: geo.grid_cell(F.col("latitude"), F.col("longitude"), height / 2**k)
    centre = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("centre")
    half = geo.grid_height(metres)
    half_lon = F.least(
        F.lit(180.0),
        F.lit(half * 1.001) / F.cos(F.radians(F.least(F.abs(F.col("latitude")) + half, F.lit(89.999)))),
    )
    asked = spots.select(
        centre,
        F.explode(geo.grid_probe(F.col("latitude"), F.col("longitude"), F.lit(half), half_lon, height)).alias("_c0"),
    )
    lat, lon = F.col("centre.lat"), F.col("centre.lon")
    corners = [geo.haversine(lat, lon, F.col(f"_{a}_latitude"), F.col(f"_{b}_longitude"), radius) for a in ("min", "max") for b in ("min", "max")]
    # The farthest point of a small box is a corner; the slack keeps rounding on the careful side.
    inside = F.greatest(*corners) * (1 + 1e-9) + 1e-6 < metres
    clamp = lambda at, name: F.greatest(F.col(f"_min_{name}"), F.least(at, F.col(f"_max_{name}")))
    outside = geo.haversine(lat, lon, clamp(lat, "latitude"), clamp(lon, "longitude"), radius) > metres * 1.01 + 1
    distance = geo.haversine(lat, lon, F.col("latitude"), F.col("longitude"), radius)
    path, found, placed = ["_c0"], [], spots.withColumn("_c0", cell(0))
    for k in range(MOST_QUARTERINGS + 1):
        totals = placed.groupBy(*path).agg(
            F.sum("n").alias("_cell_n"),
            F.count(F.lit(1)).alias("_spots"),
            *[f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in ("latitude", "longitude")],
        )
        # A dense cell meets its own quarters alone: four at most, and as many centres as it has neighbours.
        # The optimizer's sizes do not see the cells that a centre was exploded to: neither side is broadcast.
        met = cut_lineage(asked.hint("merge").join(totals, path if k == 0 else path[:-1]).where(~outside).withColumn("_inside", inside))
        found.append(met.where("_inside").select("centre", F.col("_cell_n").alias("n")))
        cut = met.where("NOT _inside")
        thin = cut if k == MOST_QUARTERINGS else cut.where(F.col("_spots") <= cell_spots)
        rim = split_join(thin.select("centre", *path), placed.select(*path, "latitude", "longitude", "n"), path, ("centre", "latitude"))
        found.append(rim.where(distance <= metres).select("centre", "n"))
        asked = cut.where(F.col("_spots") > cell_spots).select("centre", *path)
        if k == MOST_QUARTERINGS or asked.isEmpty():
            break
        path = [*path, f"_c{k + 1}"]
        placed = placed.withColumn(path[-1], cell(k + 1))
    counted = (
        reduce(DataFrame.unionByName, found)
        .groupBy("centre")
        .agg(F.sum("n").alias("neighbours"))
        .select(F.col("centre.lat").alias("latitude"), F.col("centre.lon").alias("longitude"), "neighbours")
    )
    return sites.select("site_id", "latitude", "longitude").join(counted, ["latitude", "longitude"]).select(
        "site_id", "neighbours"
    )


# --- corroboration ------------------------------------------------------------------------------


def place_features(places: DataFrame) -> DataFrame:
    """What a place says of itself, computed once per place and carried into its pairs.

    places  place_id, place_address, place_name, place_brand, latitude, longitude
    """
    return spread(places, "place_id").select(
        "place_id",
        "latitude",
        "longitude",
        A.door_numbers(F.col("place_address")).alias("place_doors"),
        A.street_words(F.col("place_address")).alias("place_streets"),
        A.street_words(F.col("place_name")).alias("place_names"),
        fold(F.col("place_brand")).alias("place_brand_key"),
    )


def site_features(sites: DataFrame) -> DataFrame:
    """sites  site_id, site_address, legal_name, latitude, longitude"""
    return spread(sites, "site_id").select(
        "site_id",
        "latitude",
        "longitude",
        A.door_numbers(F.col("site_address")).alias("site_doors"),
        A.street_words(F.col("site_address")).alias("site_streets"),
        A.street_words(F.col("legal_name")).alias("site_names"),
        fold(A.operator_brand(F.col("legal_name"))).alias("operator_key"),
    )


def corroborate(pairs: DataFrame) -> DataFrame:
    """Text signals of a pair of features, their weights and the score: nearness plus all that agrees."""
    shared = F.size(F.array_intersect("place_streets", "site_streets"))
    weighed = pairs.withColumn("_shared", shared).withColumns(
        {
            "door_weight": F.when(F.arrays_overlap("place_doors", "site_doors"), F.lit(50)).otherwise(F.lit(0)),
            "street_weight": F.when(F.col("_shared") >= 2, F.lit(20))
            .when(F.col("_shared") == 1, F.lit(8))
            .otherwise(F.lit(0)),
            "name_weight": F.when(F.arrays_overlap("place_names", "site_names"), F.lit(45)).otherwise(F.lit(0)),
            "brand_weight": F.when(
                (F.col("operator_key") != "") & (F.col("operator_key") == F.col("place_brand_key")), F.lit(25)
            ).otherwise(F.lit(0)),
        }
    )
    weights = ["door_weight", "street_weight", "name_weight", "brand_weight"]
    total = F.col("door_weight") + F.col("street_weight") + F.col("name_weight") + F.col("brand_weight")
    return weighed.select(
        "place_id",
        "site_id",
        "distance_m",
        *weights,
        (F.greatest(F.lit(0.0), 100 - F.col("distance_m") / 2) + total).alias("score"),
        (F.greatest(*weights) >= CONFIRMING_WEIGHT).alias("confirmed"),
    )


def scored_pairs(places: DataFrame, sites: DataFrame) -> DataFrame:
    return corroborate(spatial_pairs(place_features(places), site_features(sites)))


# --- assignment ---------------------------------------------------------------------------------


# Rounds of mutual choices before what is left is told apart by components, and the pairs of one component that a task takes whole.
FIRST_ROUNDS = 3
COMPONENT_PAIRS = 200_000


def _rank() -> Column:
    return F.struct(
        (-F.col("score")).alias("worse"),
        F.col("distance_m").alias("distance"),
        F.col("place_id").alias("place"),
        F.col("site_id").alias("site"),
    )


def _mutual_rounds(remaining: DataFrame, most: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """What rounds of mutual choices take, and the pairs left after `most` rounds (none if there is no limit).

    Under a strict total order a pair that is the best of both its place and its site is taken by the one-by-one rule too,
    so each round takes all of those at once and drops the pairs they block. What a round takes is written once.
    """
    rounds: list[DataFrame] = []
    while (most is None or len(rounds) < most) and not remaining.isEmpty():
        by_place = remaining.groupBy("place_id").agg(F.min("rank").alias("rank"))
        by_site = remaining.groupBy("site_id").agg(F.min("rank").alias("rank"))
        mutual = cut_lineage(
            by_place.select("place_id", F.col("rank.site").alias("site_id"), "rank").join(
                by_site.select(F.col("rank.place").alias("place_id"), "site_id"), ["place_id", "site_id"]
            )
        )
        rounds.append(mutual)
        remaining = cut_lineage(
            remaining.join(mutual.select("place_id"), "place_id", "left_anti").join(
                mutual.select("site_id"), "site_id", "left_anti"
            )
        )
    return rounds, remaining


def _one_by_one(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one component taken from the best down, each side once."""
    places, sites, kept = set(), set(), []
    ordered = pairs.sort_values(["worse", "distance", "place_id", "site_id"], kind="stable")
    for i, place, site in zip(ordered.index, ordered["place_id"], ordered["site_id"], strict=True):
        if place not in places and site not in sites:
            places.add(place)
            sites.add(site)
            kept.append(i)
    return pairs.loc[kept, ["place_id", "site_id", "worse", "distance"]]


def greedy_assign(pairs: DataFrame, first_rounds: int = FIRST_ROUNDS, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """One-to-one assignment by score, as if pairs were taken one by one from the best down.

    A few rounds of mutual choices settle most pairs. What is left falls into components that share no place and no site,
    and each is settled by itself: one of at most `component_pairs` pairs in a grouped step, a larger one by more
    rounds. A chain in which every choice waits for the one before takes a number of jobs that grows with its logarithm. No candidate
    is ever cut off.
    """
    rounds, remaining = _mutual_rounds(cut_lineage(pairs.select("place_id", "site_id", _rank().alias("rank"))), first_rounds)
    if not remaining.isEmpty():
        named = cut_lineage(remaining.join(pair_components(remaining, "place_id", "site_id"), "place_id"))
        sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > component_pairs).select("component")
        flat = named.select("component", "place_id", "site_id", F.col("rank.worse").alias("worse"), F.col("rank.distance").alias("distance"))
        kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("place_id", "site_id", "worse", "distance"))
        settled = flat.join(large, "component", "left_anti").groupBy("component").applyInPandas(_one_by_one, schema)
        rank = F.struct("worse", "distance", F.col("place_id").alias("place"), F.col("site_id").alias("site"))
        rounds.append(cut_lineage(settled.select("place_id", "site_id", rank.alias("rank"))))
        rest = cut_lineage(named.join(large, "component", "left_semi").select("place_id", "site_id", "rank"))
        rounds += _mutual_rounds(rest)[0]
    return reduce(DataFrame.unionByName, rounds) if rounds else remaining


# Best sites a place is given at first, and how many times as many once it runs out of them.
FIRST_CHOICES, MORE_CHOICES = 16, 8


def assign_nearby(places: DataFrame, sites: DataFrame, choices: int = FIRST_CHOICES) -> tuple[DataFrame, DataFrame]:
    """What `greedy_assign` takes of all scored pairs, and the scored pairs it was taken from.

    places, sites  the results of `place_features` and `site_features`, materialised

    Pairs are scored and folded to each place's best as they are found; all of them together are never stored, shuffled or
    sorted, so tables grow with the places, not with the pairs. Under one order of all pairs, taking the best down is the
    same as each place asking its sites from its best down, and a place asks no further than the site it gets. So the
    result is that of all pairs as soon as no place has run out of a list that was cut. Those that have are given longer
    lists and everything is taken anew, until none is left: no candidate is ever cut off.
    """
    best_first = W.partitionBy("place_id").orderBy(F.col("score").desc(), "distance_m", "site_id")
    asked, known, most = places, None, choices
    while True:
        # The optimizer limits each place before the exchange; one row more than asked for says that the list was cut.
        scored = corroborate(spatial_pairs(asked, sites)).withColumn("_nth", F.row_number().over(best_first))
        found = cut_lineage(scored.where(F.col("_nth") <= most + 1))
        longer = found.select(*found.columns, (F.max("_nth").over(W.partitionBy("place_id")) > most).alias("_cut")).where(F.col("_nth") <= most)
        known = cut_lineage(longer if known is None else known.join(asked.select("place_id"), "place_id", "left_anti").unionByName(longer))
        taken = cut_lineage(greedy_assign(known))
        short = known.where("_cut").select("place_id").distinct().join(taken.select("place_id"), "place_id", "left_anti")
        asked = cut_lineage(places.join(short, "place_id", "left_semi"))
        if asked.isEmpty():
            return taken, known.drop("_nth", "_cut")
        most *= MORE_CHOICES


def with_nearby_margin(chosen: DataFrame, taken: DataFrame, places: DataFrame, sites: DataFrame) -> DataFrame:
    """`with_margin` for pairs of which only each place's best were kept: rivals are looked for again, and folded as they are found.

    Places come with what they took and sites with who took them, so a pair is known for a rival where it is met.
    """
    mine = taken.select("place_id", F.col("site_id").alias("_mine"), F.col("rank").alias("_rank"))
    theirs = taken.select("site_id", F.col("rank").alias("_their_rank"))
    near = spatial_pairs(
        places.select("place_id", "latitude", "longitude").join(mine, "place_id"),
        sites.select("site_id", "latitude", "longitude").join(theirs, "site_id", "left"),
        FIRM_M,
    )
    free = F.col("_their_rank").isNull() | (F.col("_their_rank") > F.col("_rank"))
    rivals = near.where((F.col("site_id") != F.col("_mine")) & free).groupBy("place_id").agg(F.min("distance_m").alias("_rival_m"))
    return _margined(chosen, taken, rivals)


def with_margin(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """Taken pairs with their distance margin to the nearest rival site of the same place.

    A rival is within the firm distance and was still free when the pair was taken, that is, not
    taken by a better-ranked pair. No rival leaves the margin null.
    """
    mine = taken.select("place_id", F.col("site_id").alias("_mine"), F.col("rank").alias("_rank"))
    theirs = taken.select("site_id", F.col("rank").alias("_their_rank"))
    rivals = (
        pairs.where(F.col("distance_m") <= FIRM_M)
        .select("place_id", "site_id", "distance_m")
        .join(mine, "place_id")
        .where(F.col("site_id") != F.col("_mine"))
        .join(theirs, "site_id", "left")
        .where(F.col("_their_rank").isNull() | (F.col("_their_rank") > F.col("_rank")))
        .groupBy("place_id")
        .agg(F.min("distance_m").alias("_rival_m"))
    )
    return _margined(pairs, taken, rivals)


def _margined(pairs: DataFrame, taken: DataFrame, rivals: DataFrame) -> DataFrame:
    chosen = pairs.join(taken.select("place_id", "site_id"), ["place_id", "site_id"])
    return (
        chosen.join(rivals, "place_id", "left")
        .withColumn("margin_m", F.col("_rival_m") - F.col("distance_m"))
        .drop("_rival_m")
    )


def match_status(margined: DataFrame) -> DataFrame:
    """verified, conflict or candidate; a thin margin is a refusal to guess."""
    wide = F.col("margin_m").isNull() | (F.col("margin_m") >= MIN_MARGIN_M)
    status = (
        F.when((F.col("distance_m") <= FIRM_M) & F.col("confirmed") & wide, F.lit("verified"))
        .when(~wide, F.lit("conflict"))
        .otherwise(F.lit("candidate"))
    )
    return margined.withColumn("status", status)


def tier(status: Column, distance_m: Column) -> Column:
    """Confidence of a match: verified, nearby (a candidate on the doorstep) or none."""
    return F.when(status == "verified", F.lit("verified")).when(
        (status == "candidate") & (F.round(distance_m) <= NEARBY_M), F.lit("nearby")
    )


def unmatched(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return rows.join(taken.select(key), key, "left_anti")


