"""The identity catalog: who a site is, on which evidence, and whether that may be shown.

A catalog entry is one flat row:
    establishment_id, brand, public_site_name, confidence, link_status, publication_status,
    evidence_method, evidence_reference, evidenced_at, consulted_at (the last four null without evidence)
Verdicts: establishment_id, claim (name or brand), result, selection_reason, entry_sha256, confidence, brand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.functions import addresses as A
from pricewarden.functions.ids import brand_claim_sha256, name_claim_sha256
from pricewarden.functions.stats import wilson_lower_bound
from pricewarden.functions.text import fold, fold_text, let
from pricewarden.operators.matching import tier
from pricewarden.operators.pricing import instant_lit
from pricewarden.session import cut_lineage

EVIDENCE_DAYS = 365
BRAND_THRESHOLD = 0.9
# Lower bounds a tier of names has to reach, and words that name a brand.
NAME_THRESHOLDS = {"verified": 0.8, "nearby": 0.7}
BRAND_WORDS = (
    ("PRIMAX", "Primax"),
    ("COESTI", "Primax"),
    ("REPSOL", "Repsol"),
    ("PECSA", "Pecsa"),
    ("PETROPERU", "Petroperú"),
    ("TERPEL", "Terpel"),
    ("AVA", "AVA"),
    ("ENERGIGAS", "Energigas"),
)
OBSERVABLE_BRANDS = (
    "Pecsa", "Energigas", "Terpel", "Petroamérica", "Gazel", "Picorp", "GESA", "Primax", "Repsol", "Petroperú", "AVA",
)
CLASH_REJECTED, CLASH_UNREVIEWED = "choque_rechazado_por_owner", "choque_sin_revisar"
STRATUM_UNSAMPLED = "estrato_sin_muestra"
OBSERVED_STRATUM = "letrero_observado"
SIGN_METHOD = "storefront_observation"


def is_public() -> Column:
    return F.coalesce(
        (F.col("link_status") == "verified") & (F.col("publication_status") == "publishable"), F.lit(False)
    )


# --- projection ---------------------------------------------------------------------------------


def catalog_projection(catalog: DataFrame, registry_ids: DataFrame, offer_ids: DataFrame) -> DataFrame:
    """Each entry with what becomes of it: projected, without_offer, pending or unknown_anchor."""
    if registry_ids.isEmpty():
        raise ValueError("empty registry: identities are not checked without their reference")
    known = registry_ids.select("establishment_id").distinct().withColumn("_known", F.lit(True))
    offered = offer_ids.select("establishment_id").distinct().withColumn("_offered", F.lit(True))
    outcome = (
        F.when(F.col("_known").isNull(), F.lit("unknown_anchor"))
        .when(~is_public(), F.lit("pending"))
        .when(F.col("_offered").isNull(), F.lit("without_offer"))
        .otherwise(F.lit("projected"))
    )
    joined = catalog.join(known, "establishment_id", "left").join(offered, "establishment_id", "left")
    return joined.withColumn("outcome", outcome).drop("_known", "_offered")


def projection_metrics(projected: DataFrame) -> DataFrame:
    shown = F.col("outcome") == "projected"
    return projected.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(shown).alias("projected"),
        F.count_if(F.col("outcome") == "pending").alias("pending"),
        F.count_if(F.col("outcome") == "without_offer").alias("without_current_offer"),
        F.count_if(F.col("outcome") == "unknown_anchor").alias("unknown_anchors"),
        F.count_if(shown & F.col("brand").isNotNull()).alias("projected_with_brand"),
        F.count_if(shown & F.col("brand").isNotNull() & F.col("evidence_method").isNotNull()).alias(
            "with_brand_evidence"
        ),
    )


def stale_evidence(catalog: DataFrame, now: datetime) -> DataFrame:
    """Evidence older than a year, oldest first."""
    limit = instant_lit(now) - F.expr(f"INTERVAL {EVIDENCE_DAYS} DAYS")
    return (
        catalog.where(F.col("evidence_method").isNotNull() & (F.col("evidenced_at") < limit))
        .select("establishment_id", "brand", "evidence_method", "evidence_reference", "evidenced_at")
        .orderBy("evidenced_at", "establishment_id")
    )


def brand_coverage(evaluated: DataFrame) -> DataFrame:
    """Per brand: sites, sites with a current price, sites with only an expired one. No distinct is expanded."""
    sites = (
        evaluated.groupBy("brand", "site_id")
        .agg(
            F.bool_or(F.col("state") == "fresh").alias("_current"),
            F.count_if(F.col("state") == "fresh").alias("_fresh"),
            F.count_if(F.col("state") == "expired").alias("_expired"),
        )
    )
    return sites.groupBy("brand").agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if("_current").alias("with_current_price"),
        F.count_if(~F.col("_current")).alias("only_expired_price"),
        F.sum("_fresh").alias("current_offers"),
        F.sum("_expired").alias("expired_offers"),
    )


def coverage_totals(evaluated: DataFrame) -> DataFrame:
    """Sites seen, and sites with a brand on any of their offers."""
    sites = evaluated.groupBy("site_id").agg(F.bool_or(F.col("brand").isNotNull()).alias("_branded"))
    return sites.agg(
        F.count(F.lit(1)).alias("sites"),
        F.count_if("_branded").alias("with_brand"),
        F.count_if(~F.col("_branded")).alias("without_brand"),
    )


# --- audit --------------------------------------------------------------------------------------


def tier_audit(population: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """Population, sample, correct ones and the lower bound of each tier. Tiers without a sample stay."""
    total = population.groupBy(by).agg(F.count(F.lit(1)).alias("population"))
    seen = verdicts.groupBy(by).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("result") == "verified").alias("correct")
    )
    zero = F.lit(0).cast("long")
    joined = total.join(seen, by, "left").select(
        by, "population", F.coalesce("sampled", zero).alias("sampled"), F.coalesce("correct", zero).alias("correct")
    )
    return joined.withColumn("lower_bound_95", F.round(wilson_lower_bound(F.col("correct"), F.col("sampled")), 3))


def name_tiers(catalog: DataFrame, tiers: DataFrame) -> DataFrame:
    """Public names per confidence with what is wrong with their tier, if anything.

    tiers  confidence, population, lower_bound_95, threshold
    """
    named = catalog.where(is_public() & F.col("public_site_name").isNotNull())
    actual = named.groupBy("confidence").agg(F.count(F.lit(1)).alias("affected"))
    t = tiers.select("confidence", F.col("population").alias("_population"), "lower_bound_95", "threshold")
    problem = (
        F.when(F.col("_population").isNull(), F.lit("audit_missing_tier"))
        .when(F.col("_population") != F.col("affected"), F.lit("audit_population_mismatch"))
        .when(F.col("lower_bound_95") < F.col("threshold"), F.lit("audit_below_threshold"))
    )
    return actual.join(t, "confidence", "left").select("confidence", "affected", problem.alias("problem"))


def name_verdicts(catalog: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Worst state of a site's name verdicts: stale, pending or incorrect; sound ones are not listed."""
    current = catalog.select("establishment_id", name_claim_sha256().alias("_now"))
    state = (
        F.when(F.col("_now").isNull() | (F.col("_now") != F.col("entry_sha256")), F.lit("audit_stale"))
        .when(F.col("result") == "pending", F.lit("audit_pending"))
        .when(F.col("result") == "incorrect", F.lit("audit_incorrect"))
    )
    names = verdicts.where(F.coalesce("claim", F.lit("name")) == "name")
    return (
        names.join(current, "establishment_id", "left")
        .select("establishment_id", state.alias("problem"))
        .where("problem IS NOT NULL")
        .distinct()
    )


@dataclass(frozen=True)
class AuditHead:
    """What an audit says of itself: the catalog it describes, and whether its verdicts name their claim."""

    catalog_id: str
    names_claims: bool = True


def audit_gate(catalog: DataFrame, catalog_id: str, audit: AuditHead | None) -> str | None:
    """Why an audit can't back any name of this catalog, or None.

    No audit, or one of another catalog; or one of verdicts without claims, for a catalog whose brands carry evidence.
    """
    if audit is None or audit.catalog_id != catalog_id:
        return "audit_missing_or_catalog_mismatch"
    if not audit.names_claims and not catalog.where(F.col("evidence_method").isNotNull()).isEmpty():
        return "audit_schema_behind_catalog"
    return None


def name_backing(
    catalog: DataFrame, tiers: DataFrame, verdicts: DataFrame, gate: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Names that stay approved, and the problems found with how many names each concerns.

    A tier falls as a whole; inside a sound tier a name falls alone. A gate that the audit doesn't pass
    (`audit_gate`), or a verdict on a site outside the catalog, takes every name with it.
    """
    named = catalog.where(is_public() & F.col("public_site_name").isNotNull())
    names = verdicts.where(F.coalesce("claim", F.lit("name")) == "name")
    outside = names.join(catalog.select("establishment_id"), "establishment_id", "left_anti")
    fallen = gate or (None if outside.isEmpty() else "audit_entry_outside_catalog")
    if fallen:
        problems = named.groupBy(F.lit(fallen).alias("reason")).agg(F.count(F.lit(1)).alias("affected"))
        return named.select("establishment_id").where(F.lit(False)), problems
    levels = name_tiers(catalog, tiers)
    faults = name_verdicts(catalog, verdicts)
    approved = (
        named.join(levels.where("problem IS NULL").select("confidence"), "confidence", "left_semi")
        .join(faults.select("establishment_id"), "establishment_id", "left_anti")
        .select("establishment_id")
    )
    by_tier = levels.where("problem IS NOT NULL").select(
        F.concat_ws("_", "problem", "confidence").alias("reason"), "affected"
    )
    by_name = faults.groupBy(F.col("problem").alias("reason")).agg(F.count(F.lit(1)).alias("affected"))
    return approved, by_tier.unionByName(by_name)


def usable_catalog(catalog: DataFrame, approved: DataFrame) -> DataFrame:
    """The catalog without unbacked names; entries left with neither name nor brand vanish."""
    backed = approved.select("establishment_id").distinct().withColumn("_backed", F.lit(True))
    joined = catalog.join(backed, "establishment_id", "left")
    withdrawn = is_public() & F.col("public_site_name").isNotNull() & F.col("_backed").isNull()
    return (
        joined.withColumn("name_withdrawn", withdrawn)
        .where(~F.col("name_withdrawn") | F.col("brand").isNotNull())
        .withColumn("public_site_name", F.when(~F.col("name_withdrawn"), F.col("public_site_name")))
        .drop("_backed")
    )


def resolution_status(original: DataFrame, usable: DataFrame, problems: DataFrame) -> DataFrame:
    """complete, degraded or absent, with the counts a report shows. One row."""
    counts = usable.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(is_public()).alias("publishable"),
        F.count_if(is_public() & F.col("public_site_name").isNotNull()).alias("name_published"),
        F.count_if(is_public() & F.col("brand").isNotNull()).alias("brand_published"),
        F.count_if("name_withdrawn").alias("_kept_without_name"),
    )
    before = original.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = problems.agg(F.count(F.lit(1)).alias("n")).scalar()
    status = (
        F.when(found > 0, F.lit("degraded"))
        .when(F.col("publishable") > 0, F.lit("complete"))
        .otherwise(F.lit("absent"))
    )
    neutralized = before - F.col("entries")
    return counts.select(
        status.alias("status"),
        "entries",
        "publishable",
        "name_published",
        "brand_published",
        (F.col("_kept_without_name") + neutralized).alias("name_withdrawn"),
        neutralized.alias("neutralized"),
    )


def brand_accreditation(catalog: DataFrame, tiers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per evidence method: approved, or the first check that fails.

    tiers  evidence_method, population, sampled, lower_bound_95, threshold
    """
    groups = (
        catalog.where(is_public() & F.col("brand").isNotNull() & F.col("evidence_method").isNotNull())
        .groupBy("evidence_method")
        .agg(F.count(F.lit(1)).alias("population"))
    )
    current = catalog.select("establishment_id", "evidence_method", brand_claim_sha256().alias("_now"))
    reviewed = (
        verdicts.where("claim = 'brand'")
        .join(current, "establishment_id")
        .groupBy("evidence_method")
        .agg(
            F.count(F.lit(1)).alias("_reviews"),
            F.count_if(~F.col("_now").eqNullSafe(F.col("entry_sha256"))).alias("_stale"),
            F.count_if(F.col("result") == "pending").alias("_pending"),
        )
    )
    t = tiers.select(
        "evidence_method", F.col("population").alias("_population"), "sampled", "lower_bound_95", "threshold"
    )
    reviews = F.coalesce(F.col("_reviews"), F.lit(0).cast("long"))
    reason = (
        F.when(F.col("_population").isNull(), F.lit("audit_missing_brand_tier"))
        .when(F.col("_population") != F.col("population"), F.lit("brand_population_mismatch"))
        .when(F.col("lower_bound_95") < F.col("threshold"), F.lit("brand_below_threshold"))
        .when(reviews != F.col("sampled"), F.lit("brand_sample_mismatch"))
        .when(F.coalesce("_stale", F.lit(0).cast("long")) > 0, F.lit("brand_audit_stale"))
        .when(F.coalesce("_pending", F.lit(0).cast("long")) > 0, F.lit("brand_audit_pending"))
        .otherwise(F.lit("brand_sample_above_threshold"))
    )
    return (
        groups.join(t, "evidence_method", "left")
        .join(reviewed, "evidence_method", "left")
        .select(
            "evidence_method",
            "population",
            F.coalesce("sampled", F.lit(0).cast("long")).alias("sampled"),
            F.when(reason == "brand_sample_above_threshold", F.lit("approved")).otherwise(F.lit("pending")).alias(
                "status"
            ),
            reason.alias("reason"),
        )
    )


# --- evidence -----------------------------------------------------------------------------------


def brands_named(text: Column) -> Column:
    """Brands whose word occurs in a text, each once."""


    def found(folded: Column) -> Column:
        named = [F.when(folded.rlike(rf"\b{word}\b"), F.lit(brand)) for word, brand in BRAND_WORDS]
        return F.array_distinct(F.array_compact(F.array(*named)))

    return let(fold(text), found)


def clashing_brand(place_name: Column, legal_name: Column, brand: Column) -> Column:
    """Another brand that the place's name or the registered operator speaks for."""
    named = brands_named(place_name)
    agrees = F.exists(named, lambda b: A.same_name(b, brand))
    operator = A.operator_brand(legal_name)
    return F.when((F.size(named) > 0) & ~agrees, F.get(named, F.lit(0))).when(
        operator.isNotNull() & ~A.same_name(operator, brand), operator
    )


def brand_reviews(rows: DataFrame, verdicts: DataFrame, brand: str = "brand") -> DataFrame:
    """Was this brand on this site reviewed as verified or as incorrect? A verdict without a brand counts for any.

    Verdicts are folded per (site, brand), and the rows look them up by equality twice.
    """
    folded = (
        verdicts.withColumn("_brand", fold(F.coalesce("brand", F.lit(""))))
        .groupBy("site_id", "_brand")
        .agg(
            F.bool_or(F.col("result") == "verified").alias("verified"),
            F.bool_or(F.col("result") == "incorrect").alias("incorrect"),
        )
    )
    exact = folded.select("site_id", "_brand", F.col("verified").alias("_v1"), F.col("incorrect").alias("_i1"))
    any_ = folded.where("_brand = ''").select(
        "site_id", F.col("verified").alias("_v0"), F.col("incorrect").alias("_i0")
    )
    no = F.lit(False)
    joined = (
        rows.withColumn("_brand", fold(F.col(brand))).join(exact, ["site_id", "_brand"], "left").join(any_, "site_id", "left")
    )
    return joined.withColumns(
        {
            "brand_verified": F.coalesce("_v1", no) | F.coalesce("_v0", no),
            "brand_rejected": F.coalesce("_i1", no) | F.coalesce("_i0", no),
        }
    ).drop("_brand", "_v1", "_i1", "_v0", "_i0")


def gate_evidence(evidence: DataFrame, matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Evidence with `withheld`: null, or why it may not be used.

    evidence  site_id, brand, stratum        matches  site_id, place_name, legal_name
    verdicts  site_id, brand, result, selection_reason
    A clash needs a verified verdict; a stratum needs at least one decided random review among the rest.
    """
    named = matches.select("site_id", "place_name", "legal_name", F.lit(True).alias("_matched"))
    seen = brand_reviews(evidence.join(named, "site_id", "left"), verdicts)
    other = F.when(
        F.col("_matched").isNotNull(), clashing_brand(F.col("place_name"), F.col("legal_name"), F.col("brand"))
    )
    clash = F.when(
        F.col("clash_with").isNotNull() & ~F.col("brand_verified"),
        F.when(F.col("brand_rejected"), F.lit(CLASH_REJECTED)).otherwise(F.lit(CLASH_UNREVIEWED)),
    )
    first = seen.withColumn("clash_with", other).withColumn("withheld", clash)
    decided = verdicts.where(
        (F.col("selection_reason") == "random_sample") & F.col("result").isin("verified", "incorrect")
    ).select("site_id").distinct()
    sampled = (
        first.where("withheld IS NULL AND stratum IS NOT NULL")
        .join(decided, "site_id", "left_semi")
        .select("stratum", F.lit(True).alias("_sampled"))
        .distinct()
    )
    unsampled = F.col("stratum").isNotNull() & F.col("_sampled").isNull()
    return (
        first.join(sampled, "stratum", "left")
        .withColumn(
            "withheld",
            F.coalesce(F.col("withheld"), F.when(unsampled, F.lit(STRATUM_UNSAMPLED))),
        )
        .select(*evidence.columns, "clash_with", "withheld")
    )


def judge_observations(
    observations: DataFrame, matches: DataFrame, verdicts: DataFrame, known: DataFrame, reviewed_at: datetime
) -> DataFrame:
    """Brand signs seen on images, each with the first reason against it, or `incorporated`.

    observations  observation_id, site_id, brand, image_month (YYYY-MM), consulted_at, place_id
    matches       site_id, place_id, status, distance_m
    known         site_id, evidence_brand, base_brand, pending_brand, pending_reason; one row per site
    """

    def observable(folded: Column) -> Column:
        expr = F.lit(None).cast("string")
        for brand in reversed(OBSERVABLE_BRANDS):
            expr = F.when(folded == fold_text(brand), F.lit(brand)).otherwise(expr)
        return expr

    known_brand = let(fold(F.col("brand")), observable)
    dated = F.coalesce(F.col("image_month"), F.lit("")).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    month = F.when(dated, F.concat(F.col("image_month"), F.lit("-01T00:00:00-05:00"))).try_cast("timestamp")
    m = matches.select(
        "site_id", F.col("place_id").alias("_place"), tier(F.col("status"), F.col("distance_m")).alias("_tier")
    )
    rows = brand_reviews(
        observations.withColumns({"known_brand": known_brand, "evidenced_at": month}), verdicts, "known_brand"
    )
    rows = rows.join(m, "site_id", "left").join(known, "site_id", "left")

    def against(other: str) -> Column:
        return F.col(other).isNotNull() & ~A.same_name(F.col(other), F.col("known_brand"))

    contradicts = (
        against("evidence_brand")
        | against("base_brand")
        | (against("pending_brand") & (F.coalesce("pending_reason", F.lit("")) != CLASH_REJECTED))
    )
    age = F.expr(f"INTERVAL {EVIDENCE_DAYS} DAYS")
    outcome = (
        F.when(F.col("known_brand").isNull(), F.lit("marca_desconocida"))
        .when(F.col("evidenced_at").isNull(), F.lit("sin_fecha_de_imagen"))
        .when(instant_lit(reviewed_at) - age > F.col("evidenced_at"), F.lit("imagen_de_mas_de_12_meses"))
        .when(
            ~F.coalesce(F.col("consulted_at") >= F.col("evidenced_at"), F.lit(False)),
            F.lit("consulta_anterior_a_la_imagen"),
        )
        .when(~F.col("_place").eqNullSafe(F.col("place_id")), F.lit("ficha_de_otro_establecimiento"))
        .when(F.col("_tier").isNull(), F.lit("identidad_sin_corroborar"))
        .when(F.col("brand_rejected"), F.lit("rechazada_en_revision"))
        .when(~F.col("brand_verified"), F.lit("sin_revision_independiente"))
        .when(contradicts, F.lit("contradice_otra_evidencia"))
        .otherwise(F.lit("incorporated"))
    )
    return rows.withColumn("outcome", outcome).select(
        "observation_id", "site_id", "known_brand", "evidenced_at", "outcome"
    )


# --- entries ------------------------------------------------------------------------------------


def named_entries(matches: DataFrame, evidence: DataFrame, base: DataFrame) -> DataFrame:
    """Entries whose name comes from a matched place, with the brand that evidence supports.

    matches   site_id, place_name, legal_name, status, distance_m
    evidence  site_id, evidence_brand and its method, reference and dates (usable evidence only)
    base      site_id, base_brand, base_name: what is published today

    The brand in the name counts only if a directory or the operator backs it. A directory fills a
    blank; where it contradicts, the entry keeps its brand and says so.
    """
    confident = matches.withColumn("confidence", tier(F.col("status"), F.col("distance_m"))).where(
        "confidence IS NOT NULL"
    )
    rows = confident.join(evidence, "site_id", "left").join(base, "site_id", "left").withColumns(
        {"_operator": A.operator_brand(F.col("legal_name")), "_named": A.brand_in(F.col("place_name"))}
    )
    by_directory = A.same_name(F.col("_named"), F.col("evidence_brand"))
    by_operator = A.same_name(F.col("_named"), F.col("_operator"))
    rows = rows.withColumns(
        {
            "_backed": F.when(by_directory, F.col("evidence_brand")).when(by_operator, F.col("_operator")),
            "_by_operator": by_operator,
        }
    ).withColumn("public_site_name", A.display_name(F.col("place_name"), F.col("_backed").isNotNull()))
    # Names are long text rules; once written down, no filter or join below repeats them.
    rows = cut_lineage(
        rows.select(
            "site_id", "confidence", "public_site_name", "_backed", "_by_operator", "evidence_brand", "base_name"
        )
    )
    nameless = (
        A.same_name(F.col("_backed"), F.col("evidence_brand"))
        & ~F.col("_by_operator")
        & F.col("base_name").isNull()
        & A.only_generic(F.col("public_site_name"))
    )
    contradicted = F.col("_backed").isNotNull() & F.col("evidence_brand").isNotNull() & ~A.same_name(
        F.col("_backed"), F.col("evidence_brand")
    )
    return (
        rows.where(F.col("public_site_name").isNotNull() & ~nameless)
        .withColumn("contradicted", contradicted)
        .withColumn("brand", F.when(contradicted, F.col("_backed")).otherwise(F.coalesce("evidence_brand", "_backed")))
        .withColumn("with_evidence", F.col("evidence_brand").isNotNull() & ~contradicted)
        .select("site_id", "brand", "public_site_name", "confidence", "with_evidence", "contradicted")
    )


def keep_published_brand(entries: DataFrame, conflicts: DataFrame, base: DataFrame) -> DataFrame:
    """Where evidence is in conflict and the entry has no brand, the published brand stays."""
    held = conflicts.select("site_id").distinct().join(
        base.where("base_brand IS NOT NULL").select("site_id", "base_brand"), "site_id"
    )
    joined = entries.join(held, "site_id", "left")
    kept = F.col("brand").isNull() & F.col("base_brand").isNotNull()
    return joined.withColumn("kept_published", kept).withColumn("brand", F.coalesce("brand", "base_brand")).drop(
        "base_brand"
    )


def brand_only_entries(evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """Sites with brand evidence and no name: an entry with the brand alone."""
    return evidence.join(entries.select("site_id"), "site_id", "left_anti").select(
        "site_id",
        F.col("evidence_brand").alias("brand"),
        F.lit(None).cast("string").alias("public_site_name"),
        F.lit("verified").alias("confidence"),
        F.lit(True).alias("with_evidence"),
        F.lit(False).alias("contradicted"),
    )


def _bare_name(name: Column) -> Column:
    text = fold(name)
    for brand in A.NAME_BRANDS:
        text = F.regexp_replace(text, rf"\b{fold_text(brand)}\b", " ")
    return F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))


def protect_names(entries: DataFrame, base: DataFrame) -> DataFrame:
    """A published name stays if only its brand word differs; any other change voids its verdicts."""
    joined = entries.join(base.select("site_id", "base_name"), "site_id", "left")
    differs = F.col("base_name").isNotNull() & ~F.col("base_name").eqNullSafe(F.col("public_site_name"))
    said = A.brand_in(F.col("base_name"))
    backed = said.isNull() | A.same_name(said, F.col("brand"))
    keep = (
        differs
        & F.col("public_site_name").isNotNull()
        & backed
        & (_bare_name(F.col("base_name")) == _bare_name(F.col("public_site_name")))
    )
    return (
        joined.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        .withColumn("name_changed", differs & ~F.col("_keep"))
        .withColumn("public_site_name", F.when(F.col("_keep"), F.col("base_name")).otherwise(F.col("public_site_name")))
        .drop("_keep", "base_name")
    )


def apply_verdicts(entries: DataFrame, verdicts: DataFrame, matches: DataFrame) -> DataFrame:
    """Remove brands a review found wrong, and their word in the name; empty entries are dropped."""
    rows = brand_reviews(entries, verdicts).join(matches.select("site_id", "place_name"), "site_id", "left")
    wrong = F.col("brand").isNotNull() & F.col("brand_rejected")
    renamed = wrong & F.col("place_name").isNotNull() & A.same_name(
        A.brand_in(F.coalesce("public_site_name", F.lit(""))), F.col("brand")
    )
    return (
        rows.withColumns({"_wrong": wrong, "_renamed": renamed})
        .withColumn(
            "public_site_name",
            F.when(F.col("_renamed"), A.display_name(F.col("place_name"), F.lit(False))).otherwise(
                F.col("public_site_name")
            ),
        )
        .withColumn("brand_removed", F.col("_wrong"))
        .withColumn("brand", F.when(~F.col("_wrong"), F.col("brand")))
        .where("brand IS NOT NULL OR public_site_name IS NOT NULL")
        .select(*entries.columns, "brand_removed")
    )


def inherited_verdicts(previous: DataFrame, current: DataFrame, entries: DataFrame) -> DataFrame:
    """Old `incorrect` brand verdicts that nothing reviewed since stay in force."""
    old = previous.where("claim = 'brand' AND result = 'incorrect'")
    branded = entries.where("brand IS NOT NULL").select("site_id")
    seen = current.where("claim = 'brand'").select("site_id")
    return old.join(branded, "site_id", "left_anti").join(seen, "site_id", "left_anti")


def pending_reasons(projected: DataFrame, reason: str = "outcome") -> DataFrame:
    """Catalog entries that are not shown, by reason."""
    return (
        projected.where(F.col(reason) != "projected")
        .groupBy(F.col(reason).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- the universe of sites ----------------------------------------------------------------------


def site_universe(offers: DataFrame, raw: DataFrame, products: Sequence[str]) -> DataFrame:
    """Every site with an offer of any product: price and date per product, and its first raw row.

    raw  site_id, ordinal and the private columns; the smallest ordinal is the first row of the file.
    """
    cells = []
    for product in products:
        mine = F.col("product") == product
        cells.append(F.max_by(F.when(mine, F.col("price")), F.when(mine, F.col("id"))).alias(f"price_{product}"))
        cells.append(
            F.max_by(F.when(mine, F.col("reported_at")), F.when(mine, F.col("id"))).alias(f"reported_{product}")
        )
    united = offers.groupBy("site_id").agg(*cells)
    private = [c for c in raw.columns if c not in ("site_id", "ordinal")]
    first = (
        raw.join(united.select("site_id"), "site_id", "left_semi")
        .groupBy("site_id")
        .agg(F.min(F.struct("ordinal", *private)).alias("_first"))
        .select("site_id", *[F.col(f"_first.{c}").alias(c) for c in private])
    )
    return united.join(first, "site_id", "left")
