"""Reproducible samples and exact order statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.functions.ordering import global_index

# Shares of an audit sheet.
AUDIT_SHARES = (("verified", 0.62, "random_sample"), ("conflict", 0.25, "risk_sample"), ("tight", 0.13, "risk_sample"))
CENTS = 0.1
RECENT_HOURS = 72


def hash_order(salt: str, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)


def stratified_sample(rows: DataFrame, targets: Mapping[str, int | None], key: str, salt: str) -> DataFrame:
    """All reviewed rows, all risky ones, then random ones in hash order up to the stratum's target.

    rows  stratum, reviewed, risk and the key. A target of None takes the whole stratum; a stratum
    without a target only contributes its reviewed and risky rows.

    Targets of any size are cut by the hash itself: counts per hash prefix say which prefixes are taken
    whole, and only the one at the edge is ranked.
    """
    spark = rows.sparkSession
    drawn = F.when(F.col("reviewed"), F.lit("reviewed")).when(F.col("risk"), F.lit("risk")).otherwise(F.lit("random"))
    marked = rows.withColumn("drawn", drawn)
    target = spark.createDataFrame(
        [(name, size) for name, size in targets.items()], "stratum string, _target int"
    )
    done = (
        marked.groupBy("stratum")
        .agg(F.count_if(F.col("drawn") == "reviewed").alias("_done"))
        .join(F.broadcast(target), "stratum")
    )
    sure = marked.where("drawn <> 'random'")
    chance = marked.where("drawn = 'random'")
    everything = [name for name, size in targets.items() if size is None]
    picked = sure.unionByName(chance.where(F.col("stratum").isin(everything)))
    quota = done.where("_target IS NOT NULL").select(
        "stratum", F.greatest(F.lit(0), F.col("_target") - F.col("_done")).alias("_quota")
    )
    named = chance.where(F.col("stratum").isin([n for n, s in targets.items() if s is not None]))
    some = _by_hash_prefix(named.withColumn("_hash", hash_order(salt, key)), quota, key)
    return picked.unionByName(some.select(*picked.columns))


def _by_hash_prefix(hashed: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """The first `_quota` rows of each stratum in hash order, ranking only inside one prefix of 65,536."""
    prefixed = hashed.withColumn("_prefix", F.substring("_hash", 1, 4))
    running = W.partitionBy("stratum").orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        prefixed.groupBy("stratum", "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .join(quota, "stratum")
        .withColumn("_left", F.col("_quota") - F.col("_before"))
        .where("_left > 0")
        .select("stratum", "_prefix", "_n", "_left")
    )
    near = prefixed.join(counts, ["stratum", "_prefix"])
    w = W.partitionBy("stratum", "_prefix").orderBy("_hash", key)
    edge = near.where("_n > _left").withColumn("_rank", F.row_number().over(w)).where("_rank <= _left")
    return near.where("_n <= _left").unionByName(edge.drop("_rank"))


def systematic_sample(rows: DataFrame, size: int, order: Sequence[Column]) -> DataFrame:
    """Every (N/size)-th row of the whole order; all rows if there are no more than `size`."""
    indexed = global_index(rows, order)
    step = F.col("row_total") / F.lit(float(size))
    near = F.floor(F.col("row_index") / step)
    candidates = F.array(near - 1, near, near + 1)
    chosen = F.exists(
        candidates, lambda i: (i >= 0) & (i < size) & (F.floor(i * step) == F.col("row_index"))
    )
    return indexed.where((F.col("row_total") <= size) | chosen).drop("row_index", "row_total")


def audit_sheet(matches: DataFrame, size: int, tight_pool: int = 40) -> DataFrame:
    """Systematic shares of verified, conflicting and tight matches; a site drawn twice keeps the riskier reason.

    matches     site_id, status, margin_m, and an order: district, distance_m
    tight_pool  how many verified matches of the smallest margins the tight share is drawn from
    """
    order = [F.col("district"), F.col("distance_m"), F.col("site_id")]
    verified = matches.where("status = 'verified'")
    tight = verified.orderBy(F.coalesce("margin_m", F.lit(1e9)), *order).limit(tight_pool)
    pools = {
        "verified": (verified, order),
        "conflict": (matches.where("status = 'conflict'"), order),
        "tight": (tight, [F.coalesce("margin_m", F.lit(1e9)), *order]),
    }
    drawn = None
    for rank, (name, share, reason) in enumerate(AUDIT_SHARES):
        pool, by = pools[name]
        count = int(size * share + 0.5)
        part = systematic_sample(pool, count, by).select(
            "site_id", F.lit(rank).alias("_rank"), F.lit(reason).alias("reason")
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn.groupBy("site_id").agg(F.max_by("reason", "_rank").alias("reason"))


def round_robin(rows: DataFrame, size: int, reviewed: DataFrame | None = None) -> DataFrame:
    """One row per stratum and turn, biggest difference first, each site once, up to `size`.

    rows  id, site_id, stratum, difference. A row whose site was already taken still uses its turn,
    so the turn is the row's rank in its stratum and a site keeps its first turn.

    The first turns are ranked alone, with their number as a literal limit that every task applies before
    the exchange. Later turns can't come before them, so `size` sites found are the sample; as long as they are fewer
    and a stratum has turns left, the number doubles.
    """
    w = W.partitionBy("stratum").orderBy(F.abs("difference").desc(), F.col("id"))
    longest = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    turns = max(1, size)
    while True:
        ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= turns)
        if reviewed is not None:
            ranked = ranked.join(reviewed.select("site_id"), "site_id", "left_anti")
        rest = [c for c in ranked.columns if c not in ("site_id", "turn", "stratum")]
        first = (
            ranked.groupBy("site_id")
            .agg(F.min(F.struct("turn", "stratum", *rest)).alias("_first"))
            .select("site_id", "_first.*")
        )
        if turns >= longest or first.limit(size).count() >= size:
            return first.orderBy("turn", "stratum").limit(size)
        turns *= 2


def price_differences(rows: DataFrame) -> DataFrame:
    """n, equal, within ten cents, median, p90 and maximum of the absolute differences, for all
    rows and for those whose report is at most 72 hours older than the reading.

    rows  difference, hours. A quantile is the element at floor(p * n) of the sorted list, picked by
    exact position over the counted distinct values; nothing is interpolated or collected.
    """
    scopes = F.when(F.col("hours") <= RECENT_HOURS, F.array(F.lit("all"), F.lit("recent"))).otherwise(
        F.array(F.lit("all"))
    )
    counted = (
        rows.select(F.explode(scopes).alias("scope"), F.abs("difference").alias("d"))
        .groupBy("scope", "d")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = global_index(counted, [F.col("scope"), F.col("d")], F.col("_n"))
    totals = counted.groupBy("scope").agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("_n"))), F.lit(0)).alias("equal"),
        F.coalesce(F.sum(F.when(F.col("d") <= CENTS, F.col("_n"))), F.lit(0)).alias("within_ten_cents"),
        F.max("d").alias("maximum"),
    )
    starts = placed.groupBy("scope").agg(F.min("row_index").alias("_start"))
    joined = placed.join(totals.select("scope", "n").join(starts, "scope"), "scope")

    def element(p: float) -> Column:
        wanted = F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))) + F.col("_start")
        here = (F.col("row_index") <= wanted) & (wanted < F.col("row_index") + F.col("_n"))
        return F.max(F.when(here, F.col("d")))

    picked = joined.groupBy("scope").agg(element(0.5).alias("median"), element(0.9).alias("p90"))
    return totals.join(picked, "scope").select(
        "scope", "n", "equal", "within_ten_cents", "median", "p90", "maximum"
    )
