"""Contracts, guards, versions, scans and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.price_queries import CUTOFF, EFFECTIVE_SQL, NOW
from checks.registry import query
from pricewarden.operators import pricing, quality, sampling
from pricewarden.sources import reference, versions

# --- offers and metrics -------------------------------------------------------------------------

_OFFER_SQL = """
x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 7 THEN 'zz' ELSE 'g2_' || substr(sha256(o_orderkey::VARCHAR), 1, 24) END AS id,
             CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'bad' ELSE 'est_' || substr(md5(o_custkey::VARCHAR), 1, 24) END AS est,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderpriority END AS brand,
             CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'verified' END AS conf,
             CASE WHEN o_orderkey % 5 = 0 THEN repeat('x', (o_orderkey % 60)::INTEGER) END AS address,
             CASE WHEN o_totalprice > 480000 THEN -1.0 ELSE o_totalprice END AS price,
             -70.0::DOUBLE - (o_orderkey % 15) AS lon, -12.0::DOUBLE AS lat,
             CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice END AS live, CASE WHEN o_orderkey % 16 = 0 THEN o_orderdate END AS seen
      FROM orders)
"""
_OFFER_RULES_SQL = {
    "id": "regexp_matches(id, '^g2_[a-f0-9]{24}$')",
    "establishment_id": "regexp_matches(est, '^est_[a-f0-9]{24}$')",
    "identity": "(brand IS NULL AND conf IS NULL) OR (brand IS NOT NULL AND brand <> '' AND coalesce(conf = 'verified', FALSE))",
    "address": "address IS NULL OR (address <> '' AND length(address) <= 48)",
    "live": "(live IS NULL AND seen IS NULL) OR (coalesce(live > 0, FALSE) AND seen IS NOT NULL)",
    "price": "price > 0",
    "coordinates": "lon BETWEEN -82 AND -68 AND lat BETWEEN -19 AND 1",
}


def _contract_offers(spark, sf_dir):
    key = F.col("o_orderkey")
    return S.table(spark, sf_dir, "orders").select(
        key.alias("k"),
        F.when(key % 50 == 7, F.lit("zz"))
        .otherwise(F.concat(F.lit("g2_"), F.substring(F.sha2(key.cast("string"), 256), 1, 24)))
        .alias("id"),
        F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), F.lit("bad"))
        .otherwise(F.concat(F.lit("est_"), F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 24)))
        .alias("establishment_id"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, F.lit("")).otherwise(F.col("o_orderpriority")).alias("brand"),
        F.lit(None).cast("string").alias("site_name"),
        F.when(key % 6 != 0, F.lit("verified")).alias("confidence"),
        F.when(key % 5 == 0, F.repeat(F.lit("x"), (key % 60).cast("int"))).alias("address"),
        F.when(F.col("o_totalprice") > 480000, F.lit(-1.0)).otherwise(F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").alias("reported_at"),
        F.col("o_orderstatus").alias("district"),
        (F.lit(-70.0) - key % 15).alias("longitude"),
        F.lit(-12.0).alias("latitude"),
        F.when(key % 8 == 0, F.col("o_totalprice")).alias("live_price"),
        F.when(key % 16 == 0, F.col("o_orderdate")).alias("live_observed_at"),
    )


@query(
    "row_contract",
    f"WITH {_OFFER_SQL} "
    + " UNION ALL ".join(
        f"SELECT k::BIGINT AS k, '{name}' AS rule FROM x WHERE NOT ({test})" for name, test in _OFFER_RULES_SQL.items()
    ),
)
def row_contract(spark, sf_dir):
    return quality.violations(_contract_offers(spark, sf_dir), quality.offer_rules(r"^g2_[a-f0-9]{24}$"), "k")


_METRICS_SQL = """
m AS (SELECT event_type AS product, user_id % 5 AS grp, count(*) AS fresh_offers, count(DISTINCT user_id % 7) AS fresh_districts,
             count(*) FILTER (value > 20) AS contract_ready_offers,
             count(DISTINCT CASE WHEN value > 20 THEN user_id % 7 END) AS contract_ready_districts,
             round(count(*) FILTER (value > 20) / count(*)::DOUBLE * 100, 3) AS coverage_percent,
             count(*) FILTER (value > 250) AS latest_price_conflicts, 0 AS latest_territory_conflicts
      FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2),
p AS (SELECT event_type AS product, user_id % 5 AS grp, round(count(*) * 1.1) AS fresh_offers,
             round(count(*) FILTER (value > 15) / count(*)::DOUBLE * 100, 3) AS coverage_percent
      FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2)
"""


def _metrics(spark, sf_dir, late: bool):
    edge = F.lit("2024-01-15").cast("timestamp")
    e = S.table(spark, sf_dir, "events")
    e = e.where(F.col("ts") >= edge) if late else e.where(F.col("ts") < edge)
    by = [F.col("event_type").alias("product"), (F.col("user_id") % 5).alias("grp")]
    n = F.count(F.lit(1))
    if not late:
        return e.groupBy(*by).agg(
            F.round(n * 1.1).alias("fresh_offers"),
            F.round(F.count_if(F.col("value") > 15) / n * 100, 3).alias("coverage_percent"),
        )
    return _measures(e, by)


def _measures(e, by):
    n = F.count(F.lit(1))
    ready, district = F.col("value") > 20, F.col("user_id") % 7
    return e.groupBy(*by).agg(
        n.alias("fresh_offers"),
        F.count_distinct(district).alias("fresh_districts"),
        F.count_if(ready).alias("contract_ready_offers"),
        F.count_distinct(F.when(ready, district)).alias("contract_ready_districts"),
        F.round(F.count_if(ready) / n * 100, 3).alias("coverage_percent"),
        F.count_if(F.col("value") > 250).alias("latest_price_conflicts"),
        F.lit(0).alias("latest_territory_conflicts"),
        F.max("ts").alias("cutoff_at"),
    )


def _broken_metrics(metrics, by):
    told = metrics.withColumns(
        {
            "fresh_offers": F.col("fresh_offers") - 30 * (F.col("grp") % 2),
            "coverage_percent": F.col("coverage_percent") + 50 * F.floor(F.col("grp") / 4),
        }
    )
    broken = quality.violations(told.withColumn("_key", F.struct(*by)), quality.metrics_rules(), "_key")
    return broken.select(*[F.col(f"_key.{c}").cast("long").alias(c) if c == "grp" else F.col(f"_key.{c}") for c in by], "rule")


@query(
    "metrics_contract",
    """WITH m AS (SELECT event_type AS product, user_id % 5 AS grp, count(*) AS fresh, count(*) FILTER (value > 20) AS ready,
              round(count(*) FILTER (value > 20) / count(*)::DOUBLE * 100, 3) AS coverage FROM events GROUP BY 1, 2)
SELECT product, grp::BIGINT AS grp, 'ready_offers' AS rule FROM m WHERE NOT ready >= 1
UNION ALL SELECT product, grp, 'fresh_offers' FROM m WHERE NOT fresh - 30 * (grp % 2) >= ready
UNION ALL SELECT product, grp, 'coverage' FROM m WHERE NOT (coverage + 50 * (grp // 4) > 0 AND coverage + 50 * (grp // 4) <= 100)""",
)
def metrics_contract(spark, sf_dir):
    """Metrics of all events that some groups report too low or too high, under the real rules."""
    by = [F.col("event_type").alias("product"), (F.col("user_id") % 5).alias("grp")]
    return _broken_metrics(_measures(S.table(spark, sf_dir, "events"), by), ["product", "grp"])


@query(
    "metrics_by_half",
    """WITH h AS (SELECT event_type AS product, user_id % 5 AS grp,
              CAST(date_trunc('month', ts) AS DATE) + CASE WHEN day(ts) >= 15 THEN 14 ELSE 0 END AS half, count(*) AS fresh,
              count(*) FILTER (value > 20) AS ready, round(count(*) FILTER (value > 20) / count(*)::DOUBLE * 100, 3) AS coverage
       FROM events GROUP BY 1, 2, 3)
SELECT product, grp::BIGINT AS grp, half, 'ready_offers' AS rule FROM h WHERE NOT ready >= 1
UNION ALL SELECT product, grp, half, 'fresh_offers' FROM h WHERE NOT fresh - 30 * (grp % 2) >= ready
UNION ALL SELECT product, grp, half, 'coverage' FROM h WHERE NOT (coverage + 50 * (grp // 4) > 0 AND coverage + 50 * (grp // 4) <= 100)""",
)
def metrics_by_half(spark, sf_dir):
    """The rules of `metrics_contract` over all events: every group of a product in each half of a month, named by its first day."""
    half = F.make_date(F.year("ts"), F.month("ts"), F.when(F.dayofmonth("ts") >= 15, F.lit(15)).otherwise(F.lit(1)))
    by = [F.col("event_type").alias("product"), (F.col("user_id") % 5).alias("grp"), half.alias("half")]
    return _broken_metrics(_measures(S.table(spark, sf_dir, "events"), by), ["product", "grp", "half"])


@query(
    "guardrails",
    f"""WITH {_METRICS_SQL},
j AS (SELECT m.product, m.grp, latest_price_conflicts <> 0 AS pc, m.fresh_offers < p.fresh_offers * (1 - 0.2) AS od,
             m.coverage_percent < p.coverage_percent - 5 AS cd
      FROM m LEFT JOIN p ON p.product = m.product AND p.grp = m.grp),
r AS (SELECT product, grp, CASE WHEN pc THEN ['price_conflicts'] ELSE [] END || CASE WHEN od THEN ['offer_drop'] ELSE [] END
             || CASE WHEN cd THEN ['coverage_drop'] ELSE [] END AS reasons FROM j)
SELECT product, grp::BIGINT AS grp, CASE WHEN len(reasons) > 0 THEN 'needs_review' ELSE 'ready' END AS status,
       array_to_string(reasons, ',') AS reasons FROM r""",
)
def guardrails(spark, sf_dir):
    judged = quality.release_quality(
        _metrics(spark, sf_dir, True), _metrics(spark, sf_dir, False), ["product", "grp"]
    )
    return judged.select(
        "product", F.col("grp").cast("long").alias("grp"), "status", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "sensitive_scan",
    r"""WITH f AS (
SELECT doc_id, unnest([
  CASE WHEN regexp_matches(text, '(?:/Users/|/home/|/private/var/|[A-Z]:\\Users\\)') THEN 'absolute_path' END,
  CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END,
  CASE WHEN regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') THEN 'cloud_key' END,
  CASE WHEN regexp_matches(text, '(?i)authorization\s*[:=]\s*bearer\s+[A-Za-z0-9._-]+') THEN 'bearer_token' END,
  CASE WHEN regexp_matches(text, '(?i)(?:api[_-]?key|secret(?:[_-]?key)?|password)\s*[:=]\s*(?:[''"][^''"\s]{8,}[''"]|[A-Za-z0-9._-]{12,})') THEN 'assigned_secret' END,
  CASE WHEN regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') THEN 'email' END,
  CASE WHEN regexp_matches(text, '\b(?:10|20)\d{9}\b') THEN 'tax_id' END]) AS kind FROM documents)
SELECT doc_id::BIGINT AS doc_id, kind FROM f WHERE kind IS NOT NULL""",
)
def sensitive_scan(spark, sf_dir):
    return quality.sensitive_scan(S.documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


# --- versions -----------------------------------------------------------------------------------

_LANES = " || '|' || ".join(
    f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(8)
)
_DIGEST_SQL = f"""
j AS (SELECT o_orderstatus AS product, '{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":'
             || to_json(o_orderpriority)::VARCHAR || ',"product":"' || o_orderstatus || '"}}' AS body FROM orders),
d AS (SELECT product, count(*) AS rows, sha256(count(*)::VARCHAR || '|' || {_LANES}) AS sha256
      FROM (SELECT product, sha256(body) AS h FROM j) GROUP BY 1)
"""


def _version(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("product"), "o_orderkey", "o_custkey", "o_orderpriority"
    )


@query("content_digests", f"WITH {_DIGEST_SQL} SELECT product, rows::BIGINT AS rows, sha256 FROM d")
def content_digests(spark, sf_dir):
    return versions.product_digests(_version(spark, sf_dir))


@query(
    "content_revision",
    f"""WITH {_DIGEST_SQL}
SELECT 'diesel-snap1-' || substr(sha256(string_agg(product || ' ' || sha256 || ' ' || rows, chr(10) ORDER BY product)), 1, 12)
  AS revision_id FROM d""",
)
def content_revision(spark, sf_dir):
    return versions.revision_id(versions.product_digests(_version(spark, sf_dir)), "diesel-", "snap1")


@query(
    "manifest_errors",
    """SELECT 'r1' AS revision_id, o_orderstatus AS product, CASE o_orderstatus WHEN 'F' THEN 'content_differs'
       WHEN 'P' THEN 'missing' END AS problem FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 2""",
)
def manifest_errors(spark, sf_dir):
    """The manifest of the whole table against data in which one product lost a row's value and one is gone."""
    whole = _version(spark, sf_dir)
    manifest = versions.product_digests(whole).withColumn("revision_id", F.lit("r1"))
    changed = F.when(
        (F.col("product") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.lit("1-urgent")
    ).otherwise(F.col("o_orderpriority"))
    data = whole.where("product <> 'P'").withColumns({"o_orderpriority": changed, "revision_id": F.lit("r1")})
    return versions.manifest_errors(data, manifest)


@query(
    "archive_hash",
    """WITH o AS (SELECT event_type || '.json' AS name, sha256(sum(event_id)::VARCHAR) AS s, count(*) AS b FROM events GROUP BY 1)
SELECT sha256('archive-v1' || chr(10) || string_agg(name || ' ' || s || ' ' || b || chr(10), '' ORDER BY name)) AS archive_hash
FROM o""",
)
def archive_hash(spark, sf_dir):
    objects = (
        S.table(spark, sf_dir, "events")
        .groupBy(F.concat(F.col("event_type"), F.lit(".json")).alias("name"))
        .agg(F.sha2(F.sum("event_id").cast("string"), 256).alias("sha256"), F.count(F.lit(1)).alias("bytes"))
    )
    return versions.archive_hash(objects, "archive-v1")


# --- reference tables ---------------------------------------------------------------------------


@query(
    "reference_superset",
    """WITH new AS (SELECT l_returnflag AS code, l_orderkey, l_linenumber FROM lineitem),
old AS (SELECT l_returnflag AS code, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 7),
d AS ((SELECT * FROM new WHERE code <> 'N') EXCEPT ALL (SELECT * FROM old))
SELECT 'added' AS difference, code, l_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber FROM d""",
)
def reference_superset(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("code"), "l_orderkey", "l_linenumber"
    )
    old = lines.where("code <> 'N' AND l_linenumber <> 7")  # the older table knows neither the new code nor line 7
    return reference.restricted_differences(lines, old, F.col("code") != "N")


@query(
    "reference_build",
    """SELECT c_mktsegment AS code, c_custkey::BIGINT AS registration, c_nationkey::INTEGER AS district FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey BETWEEN 0 AND 9""",
)
def reference_build(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("code"),
        F.col("c_custkey").alias("registration"),
        F.when(F.col("c_nationkey") < 10, F.lit("D")).otherwise(F.lit("X")).alias("department"),
        F.lit("P").alias("province"),
        F.col("c_nationkey").alias("district"),
    )
    built = reference.build_registry(rows, ["BUILDING", "MACHINERY"], "D", "P")
    return built.select("code", "registration", "district")


@query(
    "reference_points",
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN '35' ELSE '36' END AS layer, c_custkey::BIGINT AS registration,
       CASE WHEN c_custkey % 11 <> 0 THEN round(c_acctbal, 2) END::DOUBLE AS longitude, c_custkey::DOUBLE AS latitude FROM customer
WHERE c_custkey % 3 <> 2 AND c_nationkey < 15""",
)
def reference_points(spark, sf_dir):
    """Points as texts: a third lies in another layer, some nations elsewhere, every eleventh coordinate is no number."""
    key = F.col("c_custkey")
    rows = S.table(spark, sf_dir, "customer").select(
        F.element_at(F.array(F.lit("35"), F.lit("36"), F.lit("99")), (key % 3 + 1).cast("int")).alias("layer"),
        key.alias("registration"),
        F.when(F.col("c_nationkey") < 15, F.lit("D")).otherwise(F.lit("X")).alias("department"),
        F.lit("P").alias("province"),
        F.col("c_nationkey").alias("district"),
        F.when(key % 11 != 0, F.round("c_acctbal", 2).cast("string")).otherwise(F.lit("s/n")).alias("longitude"),
        key.cast("string").alias("latitude"),
    )
    built = reference.build_points(rows, ["35", "36"], "D", "P")
    return built.select("layer", "registration", "longitude", "latitude")


@query(
    "reference_coverage",
    """SELECT DISTINCT n_nationkey::INTEGER AS nationkey FROM nation
WHERE n_nationkey NOT IN (SELECT s_nationkey - s_nationkey % 3 FROM supplier)""",
)
def reference_coverage(spark, sf_dir):
    wanted = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"))
    have = S.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") - F.col("s_nationkey") % 3).alias("nationkey"))
    return reference.missing_references(wanted, have, ["nationkey"])


# --- samples ------------------------------------------------------------------------------------

_TARGETS = {"en": 150, "fr": 80, "de": 60, "es": None}


@query(
    "stratified_sample",
    """WITH d AS (SELECT doc_id, lang, coalesce(quality = 1, FALSE) AS reviewed, coalesce(toxic = 1 OR n_chars < 200, FALSE) AS risk
                 FROM documents LEFT JOIN labels USING (doc_id)),
m AS (SELECT *, CASE WHEN reviewed THEN 'reviewed' WHEN risk THEN 'risk' ELSE 'random' END AS drawn FROM d),
t(lang, target) AS (VALUES ('en', 150), ('fr', 80), ('de', 60), ('es', 100000000)),
q AS (SELECT m.lang, greatest(0, any_value(target) - count(*) FILTER (drawn = 'reviewed')) AS quota FROM m JOIN t ON t.lang = m.lang GROUP BY 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang, drawn ORDER BY sha256('salt|' || doc_id::VARCHAR)) AS rk FROM m)
SELECT doc_id::BIGINT AS doc_id, r.lang AS stratum, drawn FROM r LEFT JOIN q ON q.lang = r.lang
WHERE drawn <> 'random' OR rk <= quota""",
)
def stratified_sample(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("stratum"))
    no = F.lit(False)
    rows = docs.join(S.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id",
        "stratum",
        F.coalesce(F.col("quality") == 1, no).alias("reviewed"),
        F.coalesce((F.col("toxic") == 1) | (F.col("n_chars") < 200), no).alias("risk"),
    )
    return sampling.stratified_sample(rows, _TARGETS, "doc_id", "salt").select("doc_id", "stratum", "drawn")


@query(
    "systematic_sample",
    """WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n
                 FROM customer),
pick AS (SELECT DISTINCT floor(range * (SELECT count(*) FROM customer) / 37.0::DOUBLE)::BIGINT AS i FROM range(37))
SELECT c_custkey::BIGINT AS site_id FROM r WHERE i IN (SELECT i FROM pick)""",
)
def systematic_sample(spark, sf_dir):
    sites = S.sites(spark, sf_dir).select("site_id", "district", "acctbal")
    order = [F.col("district"), F.col("acctbal"), F.col("site_id")]
    return sampling.systematic_sample(sites, 37, order).select("site_id")


@query(
    "round_robin",
    """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 100) DESC, event_id) AS turn
                 FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type, event_id) AS k FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY turn, event_type) AS n FROM f WHERE k = 1)
SELECT user_id::BIGINT AS site_id, turn::INTEGER AS turn, event_type AS stratum, event_id::BIGINT AS id FROM p WHERE n <= 40""",
)
def round_robin(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("site_id"),
        F.col("event_type").alias("stratum"),
        (F.col("value") - 100).alias("difference"),
    )
    return sampling.round_robin(rows, 40).select("site_id", "turn", "stratum", "id")


@query(
    "price_diff_summary",
    f"""WITH {EFFECTIVE_SQL},
x AS (SELECT round(abs(live_price - price), 4) AS d, (obs_us - rep_us) / 3.6e9::DOUBLE AS hours FROM evaluated
      WHERE state = 'fresh' AND live_price IS NOT NULL),
s AS (SELECT 'all' AS scope, d FROM x UNION ALL SELECT 'recent', d FROM x WHERE hours <= 72),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n FROM s)
SELECT scope, any_value(n)::BIGINT AS n, count(*) FILTER (d = 0)::BIGINT AS equal,
       count(*) FILTER (d <= 0.1)::BIGINT AS within_ten_cents, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN d END)::DOUBLE AS median,
       max(CASE WHEN i = least(n - 1, floor(0.9 * n)) THEN d END)::DOUBLE AS p90, max(d)::DOUBLE AS maximum
FROM r GROUP BY 1""",
)
def price_diff_summary(spark, sf_dir):
    offers = S.offers(spark, sf_dir)
    state = pricing.evaluate(offers, NOW, CUTOFF).where("state = 'fresh'").select("id")
    rows = offers.join(state, "id", "left_semi").where("live_price IS NOT NULL")
    hours = (F.unix_micros("live_observed_at") - F.unix_micros("reported_at")) / 3.6e9
    return sampling.price_differences(
        rows.select(F.round(F.col("live_price") - F.col("price"), 4).alias("difference"), hours.alias("hours"))
    )
