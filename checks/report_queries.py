"""Report pipeline over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from pricewarden import reasons as R
from pricewarden.config import rules_frame
from pricewarden.functions.ids import offer_id, site_id
from pricewarden.operators import funnel, reports
from pricewarden.operators.quality import isolate_duplicates

LATEST_SQL = """
base AS (SELECT event_id, user_id, event_type, value, date_trunc('day', ts) AS day,
                (user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 7 AS territory FROM events),
ranked AS (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY day DESC) AS r FROM base),
latest AS (SELECT user_id, event_type, max(day) AS day, arg_min(event_id, event_id) AS id,
                  arg_min(value, event_id) AS price, arg_min(territory, event_id) AS territory,
                  count(DISTINCT value) > 1 AS price_conflict, count(DISTINCT territory) > 1 AS territory_conflict
           FROM ranked WHERE r = 1 GROUP BY user_id, event_type)
"""


def _latest(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        "event_type",
        F.date_trunc("day", "ts").alias("reported_at"),
        F.col("value").alias("price"),
        S.territory().alias("territory"),
    )
    return reports.latest_per_key(e, ["user_id", "event_type"], territory=["territory"])


@query(
    "latest_per_key",
    f"""WITH {LATEST_SQL}
SELECT user_id::BIGINT AS user_id, event_type, id::BIGINT AS id, epoch(day)::BIGINT AS reported_epoch,
       price::DOUBLE AS price, territory::BIGINT AS territory, price_conflict, territory_conflict,
       CASE WHEN day > TIMESTAMP '2024-01-28' THEN '{R.INVALID_REPORT}'
            WHEN price_conflict OR territory_conflict OR NOT price > 0 THEN '{R.CONFLICT}' END AS reason,
       day < TIMESTAMP '2024-01-28' - INTERVAL 30 DAYS AS expired
FROM latest""",
)
def latest_per_key(spark, sf_dir):
    latest = _latest(spark, sf_dir)
    state = reports.publishability(
        F.col("reported_at"), F.col("price"), F.col("price_conflict"), F.col("territory_conflict"), S.cutoff()
    )
    return latest.select(
        F.col("user_id").cast("long").alias("user_id"),
        "event_type",
        "id",
        F.unix_seconds("reported_at").alias("reported_epoch"),
        "price",
        F.col("territory").cast("long").alias("territory"),
        "price_conflict",
        "territory_conflict",
        state["unpublishable_reason"].alias("reason"),
        state["expired"].alias("expired"),
    )


@query(
    "latest_state_counts",
    f"""WITH {LATEST_SQL}
SELECT event_type,
       CASE WHEN day > TIMESTAMP '2024-01-28' THEN '{R.INVALID_REPORT}'
            WHEN price_conflict OR territory_conflict OR NOT price > 0 THEN '{R.CONFLICT}'
            WHEN day < TIMESTAMP '2024-01-28' - INTERVAL 30 DAYS THEN '{R.EXPIRED_REPORT}' ELSE 'fresh' END AS state,
       count(*)::BIGINT AS n
FROM latest GROUP BY 1, 2""",
)
def latest_state_counts(spark, sf_dir):
    state = reports.publishability(
        F.col("reported_at"), F.col("price"), F.col("price_conflict"), F.col("territory_conflict"), S.cutoff()
    )
    return (
        _latest(spark, sf_dir)
        .select("event_type", F.coalesce(state["not_fresh_reason"], F.lit("fresh")).alias("state"))
        .groupBy("event_type", "state")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- the whole funnel ---------------------------------------------------------------------------

REPORTS_SQL = """
rep AS (SELECT event_id AS id, event_type AS activity, user_id AS registration,
               CASE WHEN event_id % 13 = 0 THEN 'X' ELSE 'D' END AS department, 'P' AS province,
               (user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 7 AS district,
               date_trunc('day', ts) AS reported_at, value AS price,
               CASE WHEN event_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS product_name,
               CASE WHEN event_id % 17 = 0 THEN 'Kilos' ELSE 'Galones' END AS unit,
               CASE WHEN event_id % 5 = 0 THEN 'trade' ELSE 'final' END AS client_type FROM events),
rules(grp, product, canonical, activity, code, layer, client) AS (VALUES
  ('north','even','EVEN','click','01','35',NULL), ('north','even','EVEN','view','02','36',NULL),
  ('north','even','EVEN','purchase','02','36',NULL), ('south','odd','ODD','click','01','35','final'),
  ('south','odd','ODD','error','03','35','final'), ('south','odd','ODD','signup','03','35','final')),
cand AS (SELECT u.grp, u.product, u.code, u.layer, r.*,
                CASE WHEN r.unit <> 'Galones' THEN 'otra_unidad'
                     WHEN u.client IS NOT NULL AND r.client_type <> u.client THEN 'otro_tipo_de_cliente' END AS exclusion
         FROM rep r JOIN rules u ON r.activity = u.activity AND r.product_name = u.canonical)
"""
STAGED_SQL = (
    REPORTS_SQL
    + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY grp, product, registration, code ORDER BY reported_at DESC) AS rk
           FROM cand WHERE exclusion IS NULL),
latest AS (SELECT grp, product, registration, code, max(reported_at) AS reported_at, min(id) AS id,
                  arg_min(activity, id) AS activity, arg_min(layer, id) AS layer, arg_min(department, id) AS department,
                  arg_min(district, id) AS district, arg_min(price, id) AS price,
                  count(DISTINCT price) > 1 AS price_conflict,
                  count(DISTINCT department || '|' || district::VARCHAR) > 1 AS territory_conflict
           FROM ranked WHERE rk = 1 GROUP BY 1, 2, 3, 4),
flagged AS (SELECT *, department = 'D' AS in_scope,
                   CASE WHEN reported_at > TIMESTAMP '2024-01-28' THEN 'reporte_invalido'
                        WHEN price_conflict OR territory_conflict OR NOT price > 0
                        THEN 'conflicto_precio_o_territorio' END AS broken,
                   reported_at < TIMESTAMP '2024-01-28' - INTERVAL 30 DAYS AS expired FROM latest),
pub AS (SELECT *, in_scope AND broken IS NULL AS publishable FROM flagged),
licences AS (SELECT code, registration,
                    CASE WHEN registration % 11 = 0 THEN 'X' ELSE 'D' END AS department,
                    (registration + CASE WHEN registration % 6 = 0 THEN 1 ELSE 0 END) % 7 AS district
             FROM (SELECT unnest(['01','02','03']) AS code, c_custkey AS registration FROM customer
                   UNION ALL SELECT '02', n_nationkey FROM nation)),
reg AS (SELECT code, registration, count(*) AS n, min(department) AS department, min(district) AS district
        FROM licences GROUP BY 1, 2),
spots AS (SELECT layer, registration,
                 (registration + CASE WHEN registration % 10 = 9 THEN 1 ELSE 0 END) % 7 AS district,
                 registration % 8 = 5 AS outside
          FROM (SELECT unnest(['35','36']) AS layer, c_custkey AS registration FROM customer
                UNION ALL SELECT '35', r_regionkey FROM region)),
pts AS (SELECT layer, registration, count(*) AS n, min(district) AS district, bool_or(outside) AS outside
        FROM spots GROUP BY 1, 2),
registered AS (SELECT p.*, coalesce(r.n, 0) AS registry_matches,
                      p.publishable AND coalesce(r.n, 0) = 1 AND r.department = 'D' AND r.district = p.district
                        AS registered
               FROM pub p LEFT JOIN reg r ON r.code = p.code AND r.registration = p.registration),
located AS (SELECT g.*, coalesce(s.n, 0) AS point_matches,
                   coalesce(g.registered AND s.n = 1 AND s.district = g.district AND NOT s.outside, FALSE) AS located
            FROM registered g LEFT JOIN pts s ON s.layer = g.layer AND s.registration = g.registration),
raw AS (SELECT CASE WHEN o_orderkey > 0 AND o_orderkey % 23 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
               CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderpriority END AS legal_name FROM orders),
ident AS (SELECT id, count(*) AS n, min(legal_name) AS legal_name FROM raw GROUP BY id),
staged AS (SELECT l.* EXCLUDE (registered), coalesce(l.registered, FALSE) AS registered,
                  l.located AND coalesce(i.n > 1, FALSE) AS repeated,
                  l.located AND coalesce(i.n = 1 AND i.legal_name <> '', FALSE) AS ready
           FROM located l LEFT JOIN ident i ON i.id = l.id),
reasoned AS (SELECT *, CASE WHEN NOT publishable THEN coalesce(broken, CASE WHEN expired THEN 'reporte_vencido' END)
                            WHEN NOT registered THEN 'no_cruza_registro' WHEN NOT located THEN 'sin_gis_unico'
                            WHEN repeated THEN 'id_repetido_en_el_raw' WHEN NOT ready THEN 'sin_razon_social_o_direccion'
                            WHEN expired THEN 'publicada_sin_precio_vigente' ELSE 'publicada' END AS reason
             FROM staged)
"""
)


def _staged(spark, sf_dir):
    rules = rules_frame(spark, S.RULES)
    staged = reports.stage_reports(
        S.reports(spark, sf_dir), rules, S.registry(spark, sf_dir), S.points(spark, sf_dir), S.cutoff()
    )
    return reports.attach_identities(staged, S.raw_identities(spark, sf_dir))


@query(
    "source_max",
    "SELECT epoch(max(date_trunc('day', ts)))::BIGINT AS source_max_epoch, count(*)::BIGINT AS n FROM events",
)
def source_max(spark, sf_dir):
    r = S.reports(spark, sf_dir)
    return r.agg(
        F.unix_seconds(F.max("reported_at")).alias("source_max_epoch"), F.count(F.lit(1)).alias("n")
    )


@query(
    "exclusion_counts",
    f"""WITH {REPORTS_SQL}
SELECT grp AS "group", product, count(*) FILTER (exclusion IS NULL)::BIGINT AS source_rows,
       count(*) FILTER (exclusion = 'otra_unidad')::BIGINT AS other_unit,
       count(*) FILTER (exclusion = 'otro_tipo_de_cliente')::BIGINT AS other_client
FROM cand GROUP BY 1, 2""",
)
def exclusion_counts(spark, sf_dir):
    candidates = reports.select_candidates(S.reports(spark, sf_dir), rules_frame(spark, S.RULES))
    return reports.exclusion_counts(candidates)


@query(
    "multi_group_scan",
    f"""WITH {STAGED_SQL}
SELECT grp AS "group", product, registration::BIGINT AS registration, code, id::BIGINT AS id, in_scope, publishable,
       expired, registered, located, repeated, ready, registry_matches::BIGINT AS registry_matches,
       point_matches::BIGINT AS point_matches FROM staged""",
)
def multi_group_scan(spark, sf_dir):
    return _staged(spark, sf_dir).select(
        "group",
        "product",
        F.col("registration").cast("long").alias("registration"),
        "code",
        "id",
        "in_scope",
        "publishable",
        "expired",
        "registered",
        "located",
        "repeated",
        "ready",
        "registry_matches",
        "point_matches",
    )


_METRIC_STAGES = {
    "latest_offers": "TRUE",
    "latest_in_scope": "in_scope",
    "fresh": "publishable AND NOT expired",
    "registry_exact": "registered AND NOT expired",
    "gis_safe": "located AND NOT expired",
    "contract_ready": "ready AND NOT expired",
    "published": "ready",
    "silent": "ready AND expired",
}
_METRIC_SQL = ",\n       ".join(
    f"count(*) FILTER ({test})::BIGINT AS {name}_offers, "
    f"count(DISTINCT CASE WHEN {test} THEN district END)::BIGINT AS {name}_districts"
    for name, test in _METRIC_STAGES.items()
)


@query(
    "stage_metrics",
    f"""WITH {STAGED_SQL},
m AS (SELECT grp AS "group", product, {_METRIC_SQL},
       count(*) FILTER (in_scope AND price_conflict)::BIGINT AS latest_price_conflicts,
       count(*) FILTER (in_scope AND territory_conflict)::BIGINT AS latest_territory_conflicts,
       count(*) FILTER (publishable AND registry_matches > 1)::BIGINT AS registry_ambiguous,
       count(*) FILTER (registered AND point_matches > 1)::BIGINT AS gis_ambiguous,
       count(*) FILTER (repeated)::BIGINT AS raw_duplicate FROM staged GROUP BY 1, 2)
SELECT *, CASE WHEN fresh_offers > 0 THEN round(contract_ready_offers / fresh_offers::DOUBLE * 100, 3) ELSE 0 END::DOUBLE
           AS coverage_percent,
       (fresh_offers - registry_exact_offers)::BIGINT AS registry_excluded,
       (registry_exact_offers - gis_safe_offers)::BIGINT AS gis_excluded,
       (gis_safe_offers - contract_ready_offers)::BIGINT AS identity_excluded FROM m""",
)
def stage_metrics(spark, sf_dir):
    return funnel.stage_metrics(_staged(spark, sf_dir))


@query(
    "loss_funnel",
    f"""WITH {STAGED_SQL}
SELECT grp AS "group", product, district::BIGINT AS district, reason, count(*)::BIGINT AS n
FROM reasoned WHERE in_scope GROUP BY 1, 2, 3, 4""",
)
def loss_funnel(spark, sf_dir):
    return funnel.loss_funnel(_staged(spark, sf_dir)).withColumn("district", F.col("district").cast("long"))


@query(
    "district_funnel",
    f"""WITH {STAGED_SQL}
SELECT grp AS "group", product, district::BIGINT AS district, count(*)::BIGINT AS latest,
       count(*) FILTER (publishable AND NOT expired)::BIGINT AS fresh,
       count(*) FILTER (reason = 'publicada')::BIGINT AS contract_ready,
       count(*) FILTER (reason LIKE 'publicada%')::BIGINT AS published
FROM reasoned WHERE in_scope GROUP BY 1, 2, 3""",
)
def district_funnel(spark, sf_dir):
    return funnel.district_funnel(_staged(spark, sf_dir)).withColumn("district", F.col("district").cast("long"))


@query(
    "deepest_stage",
    f"""WITH {STAGED_SQL},
reach AS (SELECT grp, product, registration,
                 max(CASE WHEN ready THEN 5 WHEN repeated THEN 4 WHEN located THEN 3 WHEN registered THEN 2
                          WHEN publishable THEN 1 ELSE 0 END) AS depth,
                 arg_min(coalesce(broken, CASE WHEN expired THEN 'reporte_vencido' END), id)
                   FILTER (broken IS NOT NULL OR expired) AS why
          FROM staged WHERE in_scope GROUP BY 1, 2, 3),
universe AS (SELECT DISTINCT u.grp, u.product, l.registration FROM licences l JOIN rules u ON u.code = l.code)
SELECT u.grp AS "group", u.product, u.registration::BIGINT AS registration,
       CASE coalesce(depth, 0) WHEN 4 THEN 'id_repetido_en_el_raw' WHEN 3 THEN 'sin_razon_social_o_direccion'
            WHEN 2 THEN 'sin_gis_unico' WHEN 1 THEN 'no_cruza_registro'
            ELSE coalesce(why, 'sin_reporte_en_lima') END AS stage
FROM universe u LEFT JOIN reach r ON r.grp = u.grp AND r.product = u.product AND r.registration = u.registration
WHERE coalesce(depth, 0) < 5""",
)
def deepest_stage(spark, sf_dir):
    rules = rules_frame(spark, S.RULES)
    return funnel.deepest_stage(_staged(spark, sf_dir), S.registry(spark, sf_dir), rules)


# --- safe lookups -------------------------------------------------------------------------------


def _nation_lookup(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")
    )
    # Suppliers by every other customer key, some keys shared by two of them.
    dim = S.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 2 - F.col("s_suppkey") % 3).alias("custkey"), F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name")
    )
    return reports.safe_lookup(c, dim, ["custkey"], ["suppkey", "name"], "s_")


_LOOKUP_SQL = """
dim AS (SELECT s_suppkey * 2 - s_suppkey % 3 AS k, count(*) AS n, min(s_suppkey) AS suppkey, min(s_name) AS name
        FROM supplier GROUP BY 1),
found AS (SELECT c_custkey, c_nationkey, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN suppkey END AS suppkey,
                 CASE WHEN n = 1 THEN name END AS name
          FROM customer LEFT JOIN dim ON k = c_custkey)
"""


@query(
    "registry_lookup_safe",
    f"""WITH {_LOOKUP_SQL}
SELECT c_custkey::BIGINT AS custkey, c_nationkey::INTEGER AS nationkey, n::BIGINT AS s_matches,
       suppkey::BIGINT AS s_suppkey, name AS s_name FROM found""",
)
def registry_lookup_safe(spark, sf_dir):
    return _nation_lookup(spark, sf_dir)


@query(
    "registry_ambiguity",
    f"""WITH {_LOOKUP_SQL}
SELECT CASE WHEN n = 0 THEN 'lost' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, count(*)::BIGINT AS n
FROM found GROUP BY 1""",
)
def registry_ambiguity(spark, sf_dir):
    outcome = (
        F.when(F.col("s_matches") == 0, F.lit("lost"))
        .when(F.col("s_matches") == 1, F.lit("unique"))
        .otherwise(F.lit("ambiguous"))
    )
    return _nation_lookup(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- duplicates ---------------------------------------------------------------------------------


@query(
    "duplicate_id_guard",
    """SELECT o_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber,
       count(*) > 1 AS repeated,
       CASE WHEN count(*) = 1 THEN min(l_partkey) END::BIGINT AS l_partkey,
       CASE WHEN count(*) = 1 THEN min(l_extendedprice) END::DOUBLE AS l_extendedprice
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
)
def duplicate_id_guard(spark, sf_dir):
    raw = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    targets = (
        S.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    )
    return reports.guarded_identities(raw, targets, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice"])


@query(
    "duplicate_isolation",
    """SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber,
       min(l_partkey)::BIGINT AS l_partkey, min(l_extendedprice)::DOUBLE AS l_extendedprice
FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1""",
)
def duplicate_isolation(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return isolate_duplicates(rows, ["l_orderkey", "l_linenumber"])[0]


# --- identifiers --------------------------------------------------------------------------------


@query(
    "anchor_ids",
    """SELECT c_custkey::BIGINT AS c_custkey,
       'est_' || substr(sha256('demo|establishment|v1|' || c_custkey::VARCHAR), 1, 24) AS establishment_id,
       'g2_' || substr(sha256('demo|v2|snap-1|regular|' || c_custkey::VARCHAR || '|' || c_mktsegment), 1, 24) AS offer_id
FROM customer""",
)
def anchor_ids(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        site_id(F.col("c_custkey"), "demo|establishment|v1").alias("establishment_id"),
        offer_id("g2_", "demo|v2", "snap-1", "regular", F.col("c_custkey"), F.col("c_mktsegment")).alias("offer_id"),
    )
