"""From feeds to a published version: select, locate, identify, link, check, write."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.config import Guardrails
from pricewarden.functions.addresses import display_address
from pricewarden.functions.ids import offer_id, site_id
from pricewarden.functions.text import link_key
from pricewarden.operators import catalog, funnel, live, pricing, quality, reports
from pricewarden.sources import versions


@dataclass(frozen=True)
class Namespaces:
    """Texts that go into the ids; a publisher keeps its own for good."""

    site: str
    offer: str
    link: str


@dataclass(frozen=True)
class Built:
    staged: DataFrame
    offers: DataFrame
    metrics: DataFrame
    losses: DataFrame
    traces: DataFrame


def build_products(
    feed: DataFrame,
    raw: DataFrame,
    registry: DataFrame,
    points: DataFrame,
    rules: DataFrame,
    *,
    cutoff_at: datetime,
    snapshot_id: str,
    names: Namespaces,
) -> Built:
    """Offers and explanations of every product of every group. The feed is staged and stored once; all five read that.

    Each product is a key, so adding a group never changes what another one gets.
    """
    staged = reports.attach_identities(reports.stage_reports(feed, rules, registry, points, pricing.instant_lit(cutoff_at)), raw)
    offers = staged.where("ready").select(
        "group",
        "product",
        offer_id(
            F.col("id_prefix"), names.offer, snapshot_id, F.col("product"), F.col("registration"), F.col("activity")
        ).alias("id"),
        site_id(F.col("registration"), names.site).alias("establishment_id"),
        display_address(F.col("address")).alias("address"),
        "price",
        "reported_at",
        "district",
        F.col("point_longitude").alias("longitude"),
        F.col("point_latitude").alias("latitude"),
        link_key(F.col("legal_name"), F.col("address"), F.col("district"), names.link).alias("key_hash"),
    )
    return Built(
        staged,
        offers,
        funnel.stage_metrics(staged),
        funnel.loss_funnel(staged),
        funnel.deepest_stage(staged, registry, rules),
    )


def compose(offers: DataFrame, entries: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """Offers with the public identity of their site and the live price of their link."""
    identity = entries.where(catalog.is_public()).select(
        "establishment_id", "brand", F.col("public_site_name").alias("site_name"), "confidence"
    )
    linked = live.attach_live(offers, live.link_keys(rows, offers, as_of))
    return linked.join(identity, "establishment_id", "left").drop("key_hash")


def release(
    offers: DataFrame,
    metrics: DataFrame,
    previous_metrics: DataFrame | None,
    root: str,
    *,
    prefix: str,
    snapshot_id: str,
    id_pattern: str,
    guard: Guardrails = Guardrails(),
) -> tuple[str | None, DataFrame]:
    """Write the version if its rows keep the contract and no product needs review.

    Returns the revision, or None with the reasons.
    """
    broken = quality.violation_counts(offers, quality.offer_rules(id_pattern))
    past = previous_metrics if previous_metrics is not None else metrics.where(F.lit(False))
    judged = quality.release_quality(metrics, past, reports.PRODUCT_KEY, guard)
    reasons = broken.select(F.lit("contract").alias("product"), F.col("rule").alias("reason")).unionByName(
        judged.select("product", F.explode("reasons").alias("reason"))
    )
    if not reasons.isEmpty():
        return None, reasons
    return versions.write_version(offers, root, prefix, snapshot_id), reasons
