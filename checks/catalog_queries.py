"""Identity catalog: documents are entries, labels are verdicts, part/lineitem give coverage."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import standins as S
from checks.match_queries import _GREEDY_SQL, _matches
from checks.price_queries import CUTOFF, EFFECTIVE_SQL, NOW
from checks.registry import query
from pricewarden.functions.ids import name_claim_sha256
from pricewarden.functions.stats import wilson_lower_bound
from pricewarden.operators import catalog, directories, pricing

# --- tiers --------------------------------------------------------------------------------------

_WILSON = """CASE WHEN n >= 1 THEN greatest(0, ((k / n::DOUBLE) + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(
  (k / n::DOUBLE) * (1 - k / n::DOUBLE) / n + 3.8416::DOUBLE / (4 * n * n::DOUBLE))) / (1 + 3.8416::DOUBLE / n)) ELSE 0 END"""


def _documents(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _labels(spark, sf_dir):
    result = (
        F.when(F.col("toxic") == 1, F.lit("incorrect"))
        .when(F.col("quality") == 1, F.lit("verified"))
        .otherwise(F.lit("pending"))
    )
    return S.table(spark, sf_dir, "labels").withColumn("result", result)


@query(
    "wilson_tiers",
    f"""WITH s AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic <> 1) AS k
                  FROM labels JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT lang, count(*) AS population FROM documents GROUP BY 1)
SELECT p.lang, population::BIGINT AS population, coalesce(n, 0)::BIGINT AS sampled, coalesce(k, 0)::BIGINT AS correct,
       round({_WILSON}, 3)::DOUBLE AS lower_bound_95 FROM p LEFT JOIN s ON s.lang = p.lang""",
)
def wilson_tiers(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    verdicts = _labels(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    return catalog.tier_audit(docs, verdicts, "lang")


_BACKING_SQL = """
cat AS (SELECT 'est_' || doc_id::VARCHAR AS id, lang AS confidence, n_chars,
               CASE WHEN n_chars % 5 = 0 THEN NULL ELSE source END AS name,
               CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS brand,
               n_chars > 300 AS public FROM documents),
tier(confidence, threshold) AS (VALUES ('en', 0.05), ('fr', 0.99), ('de', 0.05)),
actual AS (SELECT confidence, count(*) AS affected FROM cat WHERE public AND name IS NOT NULL GROUP BY 1),
levels AS (SELECT a.confidence, a.affected, CASE WHEN t.confidence IS NULL THEN 'audit_missing_tier'
                  WHEN a.confidence = 'de' THEN 'audit_population_mismatch'
                  WHEN 0.5 < threshold THEN 'audit_below_threshold' END AS problem
           FROM actual a LEFT JOIN tier t ON t.confidence = a.confidence),
verdict AS (SELECT 'est_' || doc_id::VARCHAR AS id, doc_id, CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'verified'
                   ELSE 'pending' END AS result FROM labels),
faults AS (SELECT DISTINCT id, CASE WHEN doc_id % 7 = 0 THEN 'audit_stale' WHEN result = 'pending' THEN 'audit_pending'
                  WHEN result = 'incorrect' THEN 'audit_incorrect' END AS problem FROM verdict),
bad AS (SELECT * FROM faults WHERE problem IS NOT NULL),
approved AS (SELECT c.id FROM cat c JOIN levels l ON l.confidence = c.confidence AND l.problem IS NULL
             WHERE public AND name IS NOT NULL AND c.id NOT IN (SELECT id FROM bad))
"""


def _catalog(spark, sf_dir):
    n = F.col("n_chars")
    public = n > 300
    return _documents(spark, sf_dir).select(
        F.concat(F.lit("est_"), F.col("doc_id").cast("string")).alias("establishment_id"),
        F.when(n % 3 != 0, F.col("source")).alias("brand"),
        F.when(n % 5 != 0, F.col("source")).alias("public_site_name"),
        F.col("lang").alias("confidence"),
        F.when(public, F.lit("verified")).otherwise(F.lit("pending")).alias("link_status"),
        F.when(public, F.lit("publishable")).otherwise(F.lit("pending")).alias("publication_status"),
    )


def _backing(spark, sf_dir):
    entries = _catalog(spark, sf_dir)
    labels = _labels(spark, sf_dir).select(
        F.concat(F.lit("est_"), F.col("doc_id").cast("string")).alias("establishment_id"), "doc_id", "result"
    )
    hashed = entries.select("establishment_id", name_claim_sha256().alias("_sha"))
    verdicts = labels.join(hashed, "establishment_id").select(
        "establishment_id",
        F.lit("name").alias("claim"),
        "result",
        F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("_sha")).alias("entry_sha256"),
    )
    named = entries.where(catalog.is_public() & F.col("public_site_name").isNotNull())
    threshold = F.when(F.col("confidence") == "fr", F.lit(0.99)).otherwise(F.lit(0.05))
    tiers = (
        named.where("confidence IN ('en', 'fr', 'de')")
        .groupBy("confidence")
        .agg(F.count(F.lit(1)).alias("population"))
        .select(
            "confidence",
            (F.col("population") + (F.col("confidence") == "de").cast("int")).alias("population"),
            F.lit(0.5).alias("lower_bound_95"),
            threshold.alias("threshold"),
        )
    )
    return entries, *catalog.name_backing(entries, tiers, verdicts)


@query("name_backing", f"WITH {_BACKING_SQL} SELECT id AS establishment_id FROM approved")
def name_backing(spark, sf_dir):
    return _backing(spark, sf_dir)[1]


@query(
    "name_problems",
    f"""WITH {_BACKING_SQL}
SELECT problem || '_' || confidence AS reason, affected::BIGINT AS affected FROM levels WHERE problem IS NOT NULL
UNION ALL SELECT problem, count(*)::BIGINT FROM bad GROUP BY 1""",
)
def name_problems(spark, sf_dir):
    return _backing(spark, sf_dir)[2]


@query(
    "audit_gates",
    f"""WITH {_BACKING_SQL},
n AS (SELECT count(*) FILTER (public AND name IS NOT NULL) AS affected FROM cat)
SELECT gate AS "case", reason, affected::BIGINT AS affected FROM n, (VALUES ('none', 'audit_missing_or_catalog_mismatch'),
       ('other', 'audit_missing_or_catalog_mismatch'), ('old', 'audit_schema_behind_catalog')) g(gate, reason)""",
)
def audit_gates(spark, sf_dir):
    """No audit, one of another catalog, and one without claims: each takes every name of a catalog with evidence."""
    entries = _catalog(spark, sf_dir).withColumn("evidence_method", F.when(F.col("brand").isNotNull(), F.lit("official_directory")))
    tiers = spark.createDataFrame([], "confidence string, population long, lower_bound_95 double, threshold double")
    verdicts = spark.createDataFrame([], "establishment_id string, claim string, result string, entry_sha256 string")
    cases = {"none": None, "other": catalog.AuditHead("b"), "old": catalog.AuditHead("a", names_claims=False)}
    found = []
    for name, audit in cases.items():
        approved, problems = catalog.name_backing(entries, tiers, verdicts, catalog.audit_gate(entries, "a", audit))
        if not approved.isEmpty():
            raise AssertionError("a name was backed by an audit that says nothing of it")
        found.append(problems.select(F.lit(name).alias("case"), "reason", "affected"))
    return reduce(DataFrame.unionByName, found)


@query(
    "usable_catalog",
    f"""WITH {_BACKING_SQL},
u AS (SELECT c.*, public AND name IS NOT NULL AND id NOT IN (SELECT id FROM approved) AS withdrawn FROM cat c)
SELECT id AS establishment_id, brand, CASE WHEN NOT withdrawn THEN name END AS public_site_name, withdrawn AS name_withdrawn
FROM u WHERE NOT withdrawn OR brand IS NOT NULL""",
)
def usable_catalog(spark, sf_dir):
    entries, approved, _ = _backing(spark, sf_dir)
    return catalog.usable_catalog(entries, approved).select(
        "establishment_id", "brand", "public_site_name", "name_withdrawn"
    )


@query(
    "resolution_status",
    f"""WITH {_BACKING_SQL},
u AS (SELECT c.*, public AND name IS NOT NULL AND id NOT IN (SELECT id FROM approved) AS withdrawn FROM cat c),
k AS (SELECT * FROM u WHERE NOT withdrawn OR brand IS NOT NULL)
SELECT 'degraded' AS status, count(*)::BIGINT AS entries, count(*) FILTER (public)::BIGINT AS publishable,
       count(*) FILTER (public AND name IS NOT NULL AND NOT withdrawn)::BIGINT AS name_published,
       count(*) FILTER (public AND brand IS NOT NULL)::BIGINT AS brand_published,
       (SELECT count(*) FROM u WHERE withdrawn)::BIGINT AS name_withdrawn,
       (SELECT count(*) FROM u WHERE withdrawn AND brand IS NULL)::BIGINT AS neutralized FROM k""",
)
def resolution_status(spark, sf_dir):
    entries, approved, problems = _backing(spark, sf_dir)
    return catalog.resolution_status(entries, catalog.usable_catalog(entries, approved), problems)


# --- projection, queue and coverage -------------------------------------------------------------

_PROJECTION_SQL = """
p AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand, p_size < 40 AS public,
             CASE WHEN p_size % 3 = 0 THEN 'official_directory' END AS method FROM part),
o AS (SELECT p.*, CASE WHEN id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') THEN 'unknown_anchor'
                       WHEN NOT public THEN 'pending'
                       WHEN id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) THEN 'without_offer'
                       ELSE 'projected' END AS outcome FROM p)
"""


def _projected(spark, sf_dir):
    size = F.col("p_size")
    entries = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("establishment_id"),
        F.when(size % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(size < 40, F.lit("verified")).otherwise(F.lit("pending")).alias("link_status"),
        F.lit("publishable").alias("publication_status"),
        F.when(size % 3 == 0, F.lit("official_directory")).alias("evidence_method"),
    )
    lines = S.table(spark, sf_dir, "lineitem").withColumn("establishment_id", F.col("l_partkey"))
    return catalog.catalog_projection(entries, lines.where("l_returnflag = 'N'"), lines.where("l_discount > 0.08"))


@query("catalog_projection", f"WITH {_PROJECTION_SQL} SELECT id::BIGINT AS establishment_id, outcome FROM o")
def catalog_projection(spark, sf_dir):
    return _projected(spark, sf_dir).select("establishment_id", "outcome")


@query(
    "projection_metrics",
    f"""WITH {_PROJECTION_SQL}
SELECT count(*)::BIGINT AS entries, count(*) FILTER (outcome = 'projected')::BIGINT AS projected,
       count(*) FILTER (outcome = 'pending')::BIGINT AS pending,
       count(*) FILTER (outcome = 'without_offer')::BIGINT AS without_current_offer,
       count(*) FILTER (outcome = 'unknown_anchor')::BIGINT AS unknown_anchors,
       count(*) FILTER (outcome = 'projected' AND brand IS NOT NULL)::BIGINT AS projected_with_brand,
       count(*) FILTER (outcome = 'projected' AND brand IS NOT NULL AND method IS NOT NULL)::BIGINT AS with_brand_evidence
FROM o""",
)
def projection_metrics(spark, sf_dir):
    return catalog.projection_metrics(_projected(spark, sf_dir))


@query(
    "pending_reasons",
    f"WITH {_PROJECTION_SQL} SELECT outcome AS reason, count(*)::BIGINT AS n FROM o WHERE outcome <> 'projected' GROUP BY 1",
)
def pending_reasons(spark, sf_dir):
    return catalog.pending_reasons(_projected(spark, sf_dir))


@query(
    "stale_queue",
    """SELECT o_orderkey::BIGINT AS establishment_id, o_orderpriority AS brand, epoch(o_orderdate)::BIGINT AS evidenced_epoch
FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 365 DAYS""",
)
def stale_queue(spark, sf_dir):
    entries = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("establishment_id"),
        F.col("o_orderpriority").alias("brand"),
        F.when(F.col("o_orderstatus") != "P", F.lit("official_directory")).alias("evidence_method"),
        F.lit("reference").alias("evidence_reference"),
        F.col("o_orderdate").alias("evidenced_at"),
    )
    return catalog.stale_evidence(entries, datetime(1999, 1, 1)).select(
        "establishment_id", "brand", F.unix_seconds("evidenced_at").alias("evidenced_epoch")
    )


_COVERAGE_SQL = (
    EFFECTIVE_SQL
    + """,
b AS (SELECT e.*, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS brand FROM evaluated e
      JOIN customer ON c_custkey = site_id WHERE state <> 'hidden'),
s AS (SELECT brand, site_id, bool_or(state = 'fresh') AS cur, count(*) FILTER (state = 'fresh') AS f,
             count(*) FILTER (state = 'expired') AS x FROM b GROUP BY 1, 2)
"""
)


def _branded(spark, sf_dir):
    site = S.sites(spark, sf_dir).select(
        "site_id", F.when(F.col("district") % 5 != 0, F.col("segment")).alias("brand")
    )
    return pricing.evaluate(S.offers(spark, sf_dir).join(site, "site_id"), NOW, CUTOFF)


@query(
    "brand_coverage",
    f"""WITH {_COVERAGE_SQL}
SELECT brand, count(*)::BIGINT AS sites, count(*) FILTER (cur)::BIGINT AS with_current_price,
       count(*) FILTER (NOT cur)::BIGINT AS only_expired_price, sum(f)::BIGINT AS current_offers,
       sum(x)::BIGINT AS expired_offers FROM s GROUP BY 1""",
)
def brand_coverage(spark, sf_dir):
    return catalog.brand_coverage(_branded(spark, sf_dir))


@query(
    "coverage_totals",
    f"""WITH {_COVERAGE_SQL}, t AS (SELECT site_id, bool_or(brand IS NOT NULL) AS branded FROM b GROUP BY 1)
SELECT count(*)::BIGINT AS sites, count(*) FILTER (branded)::BIGINT AS with_brand,
       count(*) FILTER (NOT branded)::BIGINT AS without_brand FROM t""",
)
def coverage_totals(spark, sf_dir):
    return catalog.coverage_totals(_branded(spark, sf_dir))


@query(
    "site_universe",
    f"""WITH {S.OFFERS_SQL},
u AS (SELECT site_id, arg_max(price, id) FILTER (product = 'click') AS price_click,
             arg_max(price, id) FILTER (product = 'view') AS price_view FROM off GROUP BY 1),
r AS (SELECT o_custkey AS site_id, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1)
SELECT u.site_id::BIGINT AS site_id, price_click::DOUBLE AS price_click, price_view::DOUBLE AS price_view, priority
FROM u LEFT JOIN r ON r.site_id = u.site_id""",
)
def site_universe(spark, sf_dir):
    raw = S.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("priority")
    )
    found = catalog.site_universe(S.offers(spark, sf_dir), raw, ["click", "view"])
    return found.select("site_id", "price_click", "price_view", "priority")


# --- accreditation and claims -------------------------------------------------------------------


@query(
    "brand_accreditation",
    f"""WITH d AS (SELECT doc_id, lang, n_chars > 300 AS public FROM documents),
v AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic <> 1) AS k,
             count(*) FILTER (toxic <> 1 AND quality <> 1) AS pending, bool_or(doc_id % 7 = 0 AND lang = 'fr') AS stale
      FROM labels JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT lang, count(*) AS population FROM d WHERE public GROUP BY 1),
b AS (SELECT p.lang, population, n, pending, stale, {_WILSON} AS bound FROM p LEFT JOIN v ON v.lang = p.lang)
SELECT lang AS evidence_method, population::BIGINT AS population,
       (CASE WHEN lang = 'es' THEN 0 ELSE n + CASE WHEN lang = 'de' THEN 1 ELSE 0 END END)::BIGINT AS sampled,
       CASE WHEN lang <> 'es' AND bound >= 0.3 AND lang <> 'de' AND NOT (lang = 'fr' AND stale) AND pending = 0
            THEN 'approved' ELSE 'pending' END AS status,
       CASE WHEN lang = 'es' THEN 'audit_missing_brand_tier' WHEN bound < 0.3 THEN 'brand_below_threshold'
            WHEN lang = 'de' THEN 'brand_sample_mismatch' WHEN lang = 'fr' AND stale THEN 'brand_audit_stale'
            WHEN pending > 0 THEN 'brand_audit_pending' ELSE 'brand_sample_above_threshold' END AS reason
FROM b""",
)
def brand_accreditation(spark, sf_dir):
    public = F.col("n_chars") > 300
    entries = _documents(spark, sf_dir).select(
        F.col("doc_id").alias("establishment_id"),
        F.col("source").alias("brand"),
        F.when(public, F.lit("verified")).otherwise(F.lit("pending")).alias("link_status"),
        F.lit("publishable").alias("publication_status"),
        F.col("lang").alias("evidence_method"),
        F.lit("reference").alias("evidence_reference"),
        F.lit("2024-01-01").alias("evidenced_at"),
        F.lit("2024-01-02").alias("consulted_at"),
    )
    labels = _labels(spark, sf_dir).withColumnRenamed("doc_id", "establishment_id")
    hashed = entries.select("establishment_id", "evidence_method", catalog.brand_claim_sha256().alias("_sha"))
    altered = (F.col("evidence_method") == "fr") & (F.col("establishment_id") % 7 == 0)
    verdicts = labels.join(hashed, "establishment_id").select(
        "establishment_id",
        "evidence_method",
        F.lit("brand").alias("claim"),
        "result",
        F.when(altered, F.lit("0")).otherwise(F.col("_sha")).alias("entry_sha256"),
    )
    n = F.count(F.lit(1))
    correct = F.count_if(F.col("result") == "verified")
    counted = verdicts.groupBy("evidence_method").agg(
        (n + (F.col("evidence_method") == "de").cast("int")).alias("sampled"),
        wilson_lower_bound(correct, n).alias("lower_bound_95"),
    )
    population = entries.where(catalog.is_public()).groupBy("evidence_method").agg(n.alias("population"))
    tiers = (
        population.join(counted, "evidence_method")
        .where("evidence_method <> 'es'")
        .withColumn("threshold", F.lit(0.3))
    )
    return catalog.brand_accreditation(entries, tiers, verdicts.drop("evidence_method"))


@query(
    "claim_conflicts",
    """WITH c AS (SELECT l_orderkey AS site, concat_ws('#', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entry, l_returnflag AS brand,
                        round(l_quantity)::BIGINT AS score, l_tax > 0.079 AND l_discount > 0.099 AS clash
                 FROM lineitem),
f AS (SELECT site, min(brand) AS b0, max(brand) AS b1, bool_or(clash) AS clash, min((-score, entry)) AS best FROM c GROUP BY 1)
SELECT outcome, count(*)::BIGINT AS n FROM (
SELECT CASE WHEN b0 <> b1 THEN 'conflicto_entre_directorios' WHEN f.clash THEN 'choque_con_operador'
            WHEN (-c.score, c.entry) = best THEN 'accredited' ELSE 'perdio_asignacion' END AS outcome
FROM c JOIN f ON f.site = c.site) GROUP BY 1""",
)
def claim_conflicts(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem")
    claims = lines.select(
        F.col("l_orderkey").alias("site_id"),
        F.concat_ws("#", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("entry_key"),
        F.col("l_returnflag").alias("brand_key"),
        F.round("l_quantity").cast("long").alias("claim_score"),
        ((F.col("l_tax") > 0.079) & (F.col("l_discount") > 0.099)).alias("clash"),
    )
    return directories.resolve_claims(claims).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "match_tiers",
    f"""{_GREEDY_SQL},
rival AS (SELECT t.p, min(o.d) AS rd FROM taken t JOIN ord o ON o.p = t.p AND o.s <> t.s AND o.d <= 80
          LEFT JOIN taken u ON u.s = o.s WHERE u.i IS NULL OR u.i > t.i GROUP BY 1),
m AS (SELECT o.p, o.s, o.d, CASE WHEN o.d <= 80 AND o.confirmed AND (r.rd IS NULL OR r.rd - o.d >= 100) THEN 'verified'
             WHEN r.rd - o.d < 100 THEN 'conflict' ELSE 'candidate' END AS status
      FROM taken t JOIN ord o ON o.i = t.i LEFT JOIN rival r ON r.p = t.p)
SELECT CASE WHEN status = 'verified' THEN 'verified' WHEN status = 'candidate' AND round(d) <= 40 THEN 'nearby'
            ELSE 'none' END AS tier, count(*)::BIGINT AS n FROM m GROUP BY 1""",
)
def match_tiers(spark, sf_dir):
    level = F.coalesce(catalog.tier(F.col("status"), F.col("distance_m")), F.lit("none"))
    return _matches(spark, sf_dir).groupBy(level.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# --- what is published already ------------------------------------------------------------------


@query(
    "published_brands",
    """SELECT c_custkey::BIGINT AS site_id, CASE WHEN c_custkey % 4 <> 0 THEN 'Primax' WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'Repsol' END AS brand,
       c_custkey % 4 = 0 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS kept_published FROM customer""",
)
def published_brands(spark, sf_dir):
    """Every fourth entry lacks a brand; evidence is in conflict at every third site, the published brand known at most."""
    key = F.col("c_custkey")
    c = S.table(spark, sf_dir, "customer")
    entries = c.select(key.alias("site_id"), F.when(key % 4 != 0, F.lit("Primax")).alias("brand"))
    conflicts = c.where(key % 3 == 0).select(key.alias("site_id"))
    base = c.select(key.alias("site_id"), F.when(key % 5 != 0, F.lit("Repsol")).alias("base_brand"))
    return catalog.keep_published_brand(entries, conflicts, base).select("site_id", "brand", "kept_published")


@query(
    "protected_names",
    """WITH e AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 7 <> 0 THEN left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2)) END AS name,
                  CASE WHEN c_custkey % 8 = 4 THEN 'Repsol' WHEN c_custkey % 2 = 0 THEN 'Primax' END AS brand FROM customer),
b AS (SELECT *, CASE k % 4 WHEN 0 THEN 'Primax ' || seg WHEN 1 THEN seg WHEN 3 THEN 'Otro' END AS base FROM e),
r AS (SELECT *, base IS NOT NULL AND name IS NOT NULL AND (k % 4 = 1 OR (k % 4 = 0 AND k % 8 <> 4)) AS keep FROM b)
SELECT k::BIGINT AS site_id, CASE WHEN keep THEN base ELSE name END AS public_site_name, base IS NOT NULL AND NOT keep AS name_changed FROM r""",
)
def protected_names(spark, sf_dir):
    """Published names that differ by a brand word or by case alone stay; others, or those of another brand, change."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    c = S.table(spark, sf_dir, "customer")
    entries = c.select(
        key.alias("site_id"),
        F.when(key % 7 != 0, F.concat(F.substring(segment, 1, 1), F.lower(F.regexp_replace(segment, "^.", "")))).alias("public_site_name"),
        F.when(key % 8 == 4, F.lit("Repsol")).when(key % 2 == 0, F.lit("Primax")).alias("brand"),
    )
    published = F.when(key % 4 == 0, F.concat(F.lit("Primax "), segment)).when(key % 4 == 1, segment).when(key % 4 == 3, F.lit("Otro"))
    base = c.select(key.alias("site_id"), published.alias("base_name"))
    return catalog.protect_names(entries, base).select("site_id", "public_site_name", "name_changed")


@query(
    "inherited_verdicts",
    """SELECT c_custkey::BIGINT AS site_id FROM customer
WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""",
)
def inherited_verdicts(spark, sf_dir):
    """Old verdicts on brands: odd keys are sound, every third speaks of the name, every fifth is branded again, every seventh was reviewed."""
    key = F.col("c_custkey")
    c = S.table(spark, sf_dir, "customer").withColumn("site_id", key)
    claim = F.when(key % 3 == 0, F.lit("name")).otherwise(F.lit("brand")).alias("claim")
    old = c.select("site_id", claim, F.when(key % 2 == 0, F.lit("incorrect")).otherwise(F.lit("verified")).alias("result"))
    now = c.where(key % 7 == 0).select("site_id", F.lit("brand").alias("claim"), F.lit("verified").alias("result"))
    entries = c.select("site_id", F.when(key % 5 == 0, F.lit("Primax")).alias("brand"))
    return catalog.inherited_verdicts(old, now, entries).select("site_id")
