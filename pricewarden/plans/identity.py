"""From harvested places and directories to catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.operators import catalog, matching
from pricewarden.session import cut_lineage


def match_places(places: DataFrame, sites: DataFrame) -> DataFrame:
    """Places assigned one to one to sites, with margin and status.

    places  place_id, place_name, place_brand, place_address, latitude, longitude
    sites   site_id, legal_name, site_address, latitude, longitude
    The features are read by every search for pairs, so they are materialised once; the pairs themselves never are.
    """
    p, s = cut_lineage(matching.place_features(places)), cut_lineage(matching.site_features(sites))
    taken, scored = matching.assign_nearby(p, s)
    return matching.match_status(matching.with_nearby_margin(scored, taken, p, s))


def build_entries(
    matches: DataFrame, evidence: DataFrame, verdicts: DataFrame, base: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Catalog entries and the evidence that was withheld.

    matches   site_id, place_name, legal_name, status, distance_m
    evidence  site_id, brand, stratum
    verdicts  site_id, brand, result, selection_reason
    base      site_id, base_brand, base_name
    """
    gated = cut_lineage(catalog.gate_evidence(evidence, matches, verdicts))
    usable = gated.where("withheld IS NULL").select("site_id", F.col("brand").alias("evidence_brand"))
    withheld = gated.where("withheld IS NOT NULL")
    named = catalog.keep_published_brand(catalog.named_entries(matches, usable, base), withheld, base)
    only = catalog.brand_only_entries(usable, named).withColumn("kept_published", F.lit(False))
    kept = base.where("base_brand IS NOT NULL").join(withheld.select("site_id").distinct(), "site_id", "left_semi")
    restored = kept.join(named.select("site_id"), "site_id", "left_anti").select(
        "site_id",
        F.col("base_brand").alias("brand"),
        F.col("base_name").alias("public_site_name"),
        F.lit("verified").alias("confidence"),
        F.lit(False).alias("with_evidence"),
        F.lit(False).alias("contradicted"),
        F.lit(True).alias("kept_published"),
    )
    entries = named.unionByName(only).unionByName(restored)
    protected = cut_lineage(catalog.protect_names(entries, base))
    return catalog.apply_verdicts(protected, verdicts, matches), withheld
