"""One observation run: measure the published offers, append, rebuild the summary, decide."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewarden.operators import history, pricing
from pricewarden.session import cut_lineage, exists
from pricewarden.sources import versions


def observation(offers: DataFrame, as_of: datetime, cutoff_at: datetime, revision: str) -> DataFrame:
    """One row per product, under one id derived from the instant, the content and the method."""
    digests = versions.product_digests(offers).select(
        F.col("product").alias("name"), "sha256", F.col("rows").alias("bytes")
    )
    digest = versions.archive_hash(digests, "archive-v1").first()["archive_hash"]
    stamp = pricing.instant(as_of).strftime("%Y-%m-%dT%H:%M:%S.") + f"{as_of.microsecond // 1000:03d}Z"
    key = history.observation_id(F.lit(stamp), F.lit(digest))
    measured = history.measure(offers.withColumnRenamed("establishment_id", "site_id"), as_of, cutoff_at)
    now = pricing.instant_lit(as_of)
    return measured.select(
        key.alias("observation_id"),
        now.alias("observed_at"),
        history.local_date(now).alias("local_date"),
        F.lit(revision).alias("revision_id"),
        F.lit(digest).alias("archive_hash"),
        pricing.instant_lit(cutoff_at).alias("cutoff_at"),
        "product",
        "mean",
        "n",
        "status",
    )


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/observations"
    return spark.read.parquet(path) if exists(spark, path) else None


def append(observed: DataFrame, root: str, products: Sequence[str]) -> int:
    """Append a complete and sound observation once; running again adds nothing.

    Complete means that every configured product has its row; sound, that each is measured or empty.
    """
    observed = cut_lineage(observed)
    states = {row["product"]: row["status"] for row in observed.select("product", "status").collect()}  # one row a product
    missing = sorted(set(products) - set(states))
    if missing:
        raise ValueError(f"the observation lacks {', '.join(missing)}")
    if not set(states.values()) <= {"ok", "empty"}:
        raise ValueError("the observation is blocked or contradicts itself")
    existing = stored(observed.sparkSession, root)
    keyed = observed.withColumn("row_id", F.concat_ws("|", "observation_id", "product"))
    fresh = keyed
    if existing is not None:
        day = observed.first()["local_date"]
        known = existing.where(F.col("local_date") == F.lit(day)).select(*keyed.columns)
        fresh = history.append_observations(known, keyed, "row_id")
    new = fresh.count()
    if new:
        fresh.coalesce(1).write.mode("append").partitionBy("local_date").parquet(f"{root}/observations")
    return new


def summary(spark: SparkSession, root: str, today: date, days: int = history.MAX_DAYS) -> DataFrame:
    """The window rebuilt from the stored observations, never from the previous summary.

    The date filter prunes partitions: only the window's days are read.
    """
    start, end = history.window_dates(today, days)
    seen = spark.read.parquet(f"{root}/observations").where(
        F.col("local_date").between(F.lit(start), F.lit(end))
    )
    last = seen.groupBy("local_date").agg(F.max(F.struct("observed_at", "observation_id")).alias("_last"))
    daily = (
        seen.join(last, "local_date")
        .where(F.col("observation_id") == F.col("_last.observation_id"))
        .select("product", F.col("local_date").alias("date"), "observation_id", "observed_at", "mean", "n")
    )
    return history.daily_spine(daily, ["product"], today, days)
