"""Contracts and guards: what every row, table and release has to satisfy.

A row contract is a map from rule name to a condition that holds for a good row. It yields the
names of the rules a row breaks, so one scan judges all rules and the violations are a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.config import Guardrails
from pricewarden.functions.geo import in_published_box
from pricewarden.functions.parse import positive
from pricewarden.functions.stats import wilson_lower_bound
from pricewarden.operators.history import MAX_DAYS, MAX_SUMMARY_BYTES, ZONE, local_date

ADDRESS_MAX = 48
SITE_PATTERN = r"^est_[a-f0-9]{24}$"
SHA_PATTERN = r"^[a-f0-9]{64}$"
CONFIDENCES = ("verified", "nearby")
MIN_SAMPLE = 20
# What may not appear in anything published.
SENSITIVE = (
    ("absolute_path", r"(?:/Users/|/home/|/private/var/|[A-Z]:\\Users\\)"),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("cloud_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("bearer_token", r"(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._-]+"),
    (
        "assigned_secret",
        r"(?i)(?:api[_-]?key|secret(?:[_-]?key)?|password)\s*[:=]\s*(?:['\"][^'\"\s]{8,}['\"]|[A-Za-z0-9._-]{12,})",
    ),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("tax_id", r"\b(?:10|20)\d{9}\b"),
)


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in declared order. A rule that cannot be decided is broken."""
    failed = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return F.array_compact(F.array(*failed))


def violations(rows: DataFrame, rules: Mapping[str, Column], key: str) -> DataFrame:
    return rows.select(key, F.explode(broken_rules(rules)).alias("rule"))


def violation_counts(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return rows.select(F.explode(broken_rules(rules)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def isolate_duplicates(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is unique, and every copy of the others. No copy is preferred.

    A key that occurs once carries its row through the aggregation, so the good rows need one
    shuffle and no window; only repeated keys go back to the table for their copies.
    """
    rest = [c for c in rows.columns if c not in keys]
    folded = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[F.col(c) for c in rest])).alias("_row")
    )
    unique = folded.where("_n = 1").select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    copies = rows.join(folded.where("_n > 1").select(*keys), list(keys), "left_semi")
    return unique.select(*rows.columns), copies


def meaningful(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""


def _null_or(name: str, test: Column) -> Column:
    return F.col(name).isNull() | test


# --- published offers ---------------------------------------------------------------------------


@dataclass(frozen=True)
class VersionFlags:
    """Which parts of an offer a schema version carries."""

    identity: bool = True
    address: bool = True
    confidence: bool = True
    accredited: bool = False
    snapshot: bool = True
    live: bool = True


# Versions of the published format.
VERSIONS = {
    "2.0.0": VersionFlags(False, False, False, False, False, False),
    "2.1.0": VersionFlags(True, False, False, False, False, False),
    "2.2.0": VersionFlags(True, True, False, False, False, False),
    "2.3.0": VersionFlags(True, True, True, False, False, False),
    "2.4.0": VersionFlags(True, True, True, True, False, False),
    "2.5.0": VersionFlags(True, True, True, True, False, False),
    "2.6.0": VersionFlags(True, True, True, False, True, False),
    "2.7.0": VersionFlags(True, True, True, False, True, True),
}
UNKNOWN_VERSION = VersionFlags(True, False, False, False, False, False)


def flags_for(version: str) -> VersionFlags:
    return VERSIONS.get(version, UNKNOWN_VERSION)


def offer_rules(id_pattern: str, flags: VersionFlags = VersionFlags()) -> dict[str, Column]:
    """Contract of a published offer (brand, site_name and confidence are null without an identity)."""
    rules = {"id": F.col("id").rlike(id_pattern)}
    if flags.identity:
        rules["establishment_id"] = F.col("establishment_id").rlike(SITE_PATTERN)
        present = F.col("brand").isNotNull() | F.col("site_name").isNotNull()
        texts = _null_or("brand", F.col("brand") != "") & _null_or("site_name", F.col("site_name") != "")
        sound = texts
        if flags.confidence:
            sound = sound & F.col("confidence").isin(*CONFIDENCES)
        if flags.accredited:
            sound = sound & F.col("brand_accredited").isNotNull() & (F.col("brand").isNotNull() | ~F.col("brand_accredited"))
        absent = ~present & (F.col("confidence").isNull() if flags.confidence else F.lit(True))
        rules["identity"] = absent | (present & sound)
    if flags.address:
        rules["address"] = _null_or("address", (F.col("address") != "") & (F.length("address") <= ADDRESS_MAX))
    if flags.live:
        nothing = F.col("live_price").isNull() & F.col("live_observed_at").isNull()
        rules["live"] = nothing | (positive(F.col("live_price")) & F.col("live_observed_at").isNotNull())
    return {
        **rules,
        "price": positive(F.col("price")),
        "reported_at": F.col("reported_at").isNotNull(),
        "district": F.coalesce(F.col("district").cast("string"), F.lit("")) != "",
        "coordinates": in_published_box(F.col("longitude"), F.col("latitude")),
    }


# --- metrics and releases -----------------------------------------------------------------------


def metrics_rules() -> dict[str, Column]:
    """Contract of the metrics that travel with a release."""
    return {
        "ready_offers": F.col("contract_ready_offers") >= 1,
        "ready_districts": F.col("contract_ready_districts") >= 1,
        "fresh_offers": F.col("fresh_offers") >= F.col("contract_ready_offers"),
        "fresh_districts": F.col("fresh_districts") >= F.col("contract_ready_districts"),
        "coverage": (F.col("coverage_percent") > 0) & (F.col("coverage_percent") <= 100),
        "price_conflicts": F.col("latest_price_conflicts") >= 0,
        "territory_conflicts": F.col("latest_territory_conflicts") >= 0,
        "cutoff": F.col("cutoff_at").isNotNull(),
    }


def release_quality(
    candidate: DataFrame, previous: DataFrame, by: Sequence[str] = ("product",), guard: Guardrails = Guardrails()
) -> DataFrame:
    """Per product: ready, or needs_review with every reason. A product without a past only meets the floors."""
    p = previous.select(
        *by, F.col("fresh_offers").alias("_fresh"), F.col("coverage_percent").alias("_coverage")
    )
    fresh, coverage = F.col("fresh_offers"), F.col("coverage_percent")
    dropped = (F.col("_fresh") > 0) & (fresh < F.col("_fresh") * (1 - guard.max_offer_drop))
    rules = {
        "no_fresh_offers": fresh >= 1,
        "no_ready_offers": F.col("contract_ready_offers") >= 1,
        "no_ready_districts": F.col("contract_ready_districts") >= 1,
        "invalid_coverage": (coverage > 0) & (coverage <= 100),
        "price_conflicts": F.col("latest_price_conflicts") == 0,
        "territory_conflicts": F.col("latest_territory_conflicts") == 0,
        "offer_drop": ~F.coalesce(dropped, F.lit(False)),
        "coverage_drop": ~F.coalesce(coverage < F.col("_coverage") - guard.max_coverage_drop_points, F.lit(False)),
    }
    joined = candidate.join(p, list(by), "left").withColumn("reasons", broken_rules(rules))
    return joined.select(*by, _status(F.col("reasons")).alias("status"), "reasons")


def _status(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.lit("needs_review")).otherwise(F.lit("ready"))


def source_advance(candidate_max: Column, previous_max: Column, forced: bool = False) -> Column:
    """Why a source's newest instant is not acceptable, or null."""
    return (
        F.when(candidate_max.isNull(), F.lit("invalid_source_maximum"))
        .when(candidate_max < previous_max, F.lit("source_went_back"))
        .when((candidate_max == previous_max) & F.lit(not forced), F.lit("source_did_not_advance"))
    )


def first_release(
    candidate: DataFrame, baseline: DataFrame, by: Sequence[str] = ("product",), guard: Guardrails = Guardrails()
) -> DataFrame:
    """A first release is measured against an audited baseline instead of the previous one.

    Both sides hold fresh_offers, coverage_percent, published_districts and source_max_reported_at.
    """
    judged = release_quality(candidate, baseline, by, guard)
    b = baseline.select(
        *by, F.col("published_districts").alias("_districts"), F.col("source_max_reported_at").alias("_max")
    )
    extra = {
        "source_older_than_baseline": ~F.coalesce(F.col("source_max_reported_at") < F.col("_max"), F.lit(False)),
        "district_loss": F.col("_districts").isNull()
        | (F.col("published_districts") >= F.col("_districts") - guard.max_district_loss),
    }
    more = candidate.join(b, list(by), "left").select(*by, broken_rules(extra).alias("_more"))
    return judged.join(more, list(by)).select(
        *by,
        _status(F.concat("reasons", "_more")).alias("status"),
        F.concat("reasons", "_more").alias("reasons"),
    )


# --- catalog, audit, reference and summary ------------------------------------------------------

# How each kind of source is obtained.
SOURCE_METHODS = {
    "owner_verified": "direct_observation",
    "first_party": "first_party_publication",
    "public_web_observed": "public_web_review",
    "open_reusable": "open_dataset",
    "known_contributor": "contributor_submission",
}
LINK_METHODS = ("official_registration_code_exact", "official_establishment_id_exact")
EVIDENCE_METHODS = ("official_directory", "storefront_observation")
YEAR = "INTERVAL 365 DAYS"


def catalog_rules() -> dict[str, Column]:
    """Contract of a catalog entry; dates are timestamps, the evidence columns are null without evidence."""
    method = F.lit(None).cast("string")
    for kind, acquired in SOURCE_METHODS.items():
        method = F.when(F.col("source_kind") == kind, F.lit(acquired)).otherwise(method)
    verified = F.col("link_status") == "verified"
    pending = F.col("publication_status") == "pending"
    evidence = F.col("evidence_method").isNotNull()

    def not_before(later: str, earlier: str) -> Column:
        return ~F.coalesce(F.col(later) < F.col(earlier), F.lit(False))

    return {
        "establishment_id": F.col("establishment_id").rlike(SITE_PATTERN),
        "brand_or_name": _null_or("brand", meaningful("brand"))
        & _null_or("public_site_name", meaningful("public_site_name"))
        & (F.col("brand").isNotNull() | F.col("public_site_name").isNotNull()),
        "confidence": F.col("confidence").isin(*CONFIDENCES),
        "source_kind": F.col("source_kind").isin(*SOURCE_METHODS),
        "acquisition_method": F.col("acquisition_method") == method,
        "source_description": meaningful("source_description"),
        "source_responsible": meaningful("source_responsible"),
        "observed_at": F.col("observed_at").isNotNull(),
        "link_method": F.col("link_method").isin(*LINK_METHODS),
        "link_status": F.col("link_status").isin("verified", "pending", "conflict"),
        "verified_at_required": ~verified | F.col("verified_at").isNotNull(),
        "verified_at_only_if_verified": verified | F.col("verified_at").isNull(),
        "verified_after_observed": not_before("verified_at", "observed_at"),
        "identity_freshness": F.col("identity_freshness").isin("current", "stale", "unknown"),
        "publication_status": F.col("publication_status").isin("publishable", "pending", "not_publishable"),
        "publishable_is_verified": (F.col("publication_status") != "publishable") | verified,
        "pending_has_no_review": ~pending | F.col("reviewed_at").isNull(),
        "review_required": pending | F.col("reviewed_at").isNotNull(),
        "publication_responsible": meaningful("publication_responsible"),
        "evidence_needs_brand": ~evidence | F.col("brand").isNotNull(),
        "evidence_method": ~evidence | F.col("evidence_method").isin(*EVIDENCE_METHODS),
        "evidence_reference": ~evidence | meaningful("evidence_reference"),
        "evidence_dates": ~evidence | (F.col("evidenced_at").isNotNull() & F.col("consulted_at").isNotNull()),
        "consulted_after_evidence": ~evidence | not_before("consulted_at", "evidenced_at"),
        "evidence_within_a_year": ~evidence
        | ~F.coalesce(F.col("reviewed_at") - F.expr(YEAR) > F.col("evidenced_at"), F.lit(False)),
    }


def duplicate_rule(rows: DataFrame, keys: Sequence[str], rule: str, key: str) -> DataFrame:
    """Every copy of a repeated key, as violations."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return rows.join(repeated, list(keys), "left_semi").select(key, F.lit(rule).alias("rule"))


def isolate_catalog(entries: DataFrame, key: str = "entry_index") -> tuple[DataFrame, DataFrame]:
    """Entries that satisfy the contract, and the reasons of those that do not; every duplicate goes."""
    broken = violations(entries, catalog_rules(), key).unionByName(
        duplicate_rule(entries, ["establishment_id"], "duplicate", key)
    )
    return entries.join(broken.select(key), key, "left_anti"), broken


def tier_rules(min_sample: int = MIN_SAMPLE) -> dict[str, Column]:
    """Contract of an audit tier: names need twenty reviews, brands at least one."""
    bound = wilson_lower_bound(F.col("correct"), F.col("sampled"))
    return {
        "population": F.col("population") >= 1,
        "sampled": F.col("sampled") >= min_sample,
        "correct": F.col("correct").between(0, F.col("sampled")),
        "sample_within_population": F.col("sampled") <= F.col("population"),
        "ratios": F.col("lower_bound_95").between(0, 1) & F.col("threshold").between(0, 1),
        "bound_matches": F.abs(bound - F.col("lower_bound_95")) <= 0.001,
    }


def verdict_rules() -> dict[str, Column]:
    return {
        "establishment_id": F.col("establishment_id").rlike(SITE_PATTERN),
        "entry_sha256": F.col("entry_sha256").rlike(SHA_PATTERN),
        "claim": F.col("claim").isin("name", "brand"),
        "confidence": F.col("confidence").isin(*CONFIDENCES),
        "selection_reason": F.col("selection_reason").isin("publishable_candidate", "random_sample", "risk_sample"),
        "result": F.col("result").isin("verified", "incorrect", "pending"),
        "reviewed": meaningful("reviewer") & F.col("reviewed_at").isNotNull(),
    }


def repeated_verdicts(verdicts: DataFrame) -> DataFrame:
    """Claims that were judged more than once: a claim on a site has one verdict."""
    claim = F.coalesce(F.col("claim"), F.lit("name")).alias("claim")
    counted = verdicts.groupBy("establishment_id", claim).agg(F.count(F.lit(1)).alias("verdicts"))
    return counted.where("verdicts > 1")


def registry_rules(codes: Sequence[str], department: str, province: str) -> dict[str, Column]:
    texts = meaningful("code") & meaningful("registration") & meaningful("district")
    return {
        "texts": texts,
        "scope": (F.col("department") == department) & (F.col("province") == province),
        "code": F.col("code").isin(list(codes)),
    }


def point_rules(layers: Sequence[str], department: str, province: str) -> dict[str, Column]:
    return {
        "layer": F.col("layer").isin(list(layers)),
        "texts": meaningful("registration") & meaningful("district"),
        "scope": (F.col("department") == department) & (F.col("province") == province),
        "coordinates": in_published_box(F.col("longitude"), F.col("latitude")),
    }


def summary_day_rules(products: Sequence[str]) -> dict[str, Column]:
    """Contract of one day of a summary; a gap day has only nulls."""
    gap = F.col("observation_id").isNull()
    rules = {
        "date": F.col("date").isNotNull(),
        "observation": gap
        | (
            (F.col("observation_id") != "")
            & F.col("observed_at").isNotNull()
            & (F.coalesce("revision_id", F.lit("")) != "")
            & F.col("archive_hash").rlike(SHA_PATTERN)
            & F.col("cutoff_at").isNotNull()
            & F.col("source_max_reported_at").isNotNull()
        ),
        "observed_after_cutoff": gap | (F.col("observed_at") >= F.col("cutoff_at")),
    }
    for product in products:
        mean, n = F.col(f"mean_{product}"), F.col(f"n_{product}")
        rules[f"n_{product}"] = gap | (n >= 0)
        rules[f"mean_{product}"] = gap | mean.isNull() | positive(mean)
        rules[f"mean_with_n_{product}"] = gap | (mean.isNull() == (n == 0))
    return rules


def summary_frame(days: DataFrame, generated_at: Column, size: int) -> DataFrame:
    """One row: does the summary have the days it declares, without holes, up to its own local day, in its size?

    The size is that of the days written as JSON lines, added up row by row.
    """
    if not 1 <= size <= MAX_DAYS:
        raise ValueError(f"days out of range: {size}")
    first, last = F.min("date"), F.max("date")
    return days.agg(
        (F.count(F.lit(1)) == size).alias("declared_days"),
        ((F.datediff(last, first) + 1 == F.count(F.lit(1))) & (F.count_distinct("date") == F.count(F.lit(1)))).alias(
            "consecutive"
        ),
        (last == local_date(generated_at, ZONE)).alias("ends_today"),
        (F.sum(F.octet_length(F.to_json(F.struct(*days.columns))) + 1) <= MAX_SUMMARY_BYTES).alias("within_size"),
    )


# --- sensitive content --------------------------------------------------------------------------


def sensitive_kinds(text: Column) -> Column:
    """Kinds of sensitive content found in a whole text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(kind)) for kind, p in SENSITIVE]))


def sensitive_scan(rows: DataFrame, key: str, text: str, max_bytes: int | None = None) -> DataFrame:
    """One row per finding; with a limit, oversized objects are findings too. A single pass, no shuffle."""
    kinds = sensitive_kinds(F.col(text))
    if max_bytes is not None:
        size = F.octet_length(F.col(text))
        kinds = F.concat(kinds, F.array_compact(F.array(F.when(size > max_bytes, F.lit("oversized")))))
    return rows.select(key, F.explode(kinds).alias("kind"))
