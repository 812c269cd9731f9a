"""Live captures over events: units are (user_id % 43, event_type)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from pricewarden.operators import live
from pricewarden.operators.pricing import instant_lit
from pricewarden.session import cut_lineage

RUN_AT = datetime(2024, 1, 25, 6)
NOW = datetime(2024, 1, 30, 12)

# --- whole-unit acceptance ----------------------------------------------------------------------

_CAPTURE_SQL = """
cap AS (SELECT user_id % 43 AS d, event_type AS product, event_id AS ord, ts,
               CASE WHEN event_id % 1499 = 3 THEN 5 ELSE 6 END AS width,
               CASE WHEN event_id % 1201 = 7 THEN 'otro' ELSE 'Distrito ' || (user_id % 43)::VARCHAR END AS dtext,
               CASE WHEN event_id % 997 = 11 THEN 'Kilo' ELSE 'galones' END AS utext,
               CASE WHEN event_id % 701 = 13 THEN 'abc' ELSE 'S/ ' || round(value + 1, 2)::DECIMAL(12,2)::VARCHAR END
                 AS ptext FROM events),
bad AS (SELECT d, product, ord, CASE WHEN width <> 6 THEN 'fila_con_forma_inesperada'
                                     WHEN dtext = 'otro' THEN 'distrito_no_coincide'
                                     WHEN utext <> 'galones' THEN 'unidad_no_coincide'
                                     WHEN ptext = 'abc' THEN 'precio_ilegible' END AS reason FROM cap),
unit AS (SELECT c.d, c.product, count(*) AS n, max(ts) AS observed_at,
                arg_min(b.reason, c.ord) FILTER (b.reason IS NOT NULL) AS first_bad
         FROM cap c JOIN bad b ON b.ord = c.ord GROUP BY 1, 2)
"""


def _captured(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        (F.col("user_id") % 43).alias("district_code"),
        F.col("event_type").alias("product"),
        key.alias("row_ordinal"),
        "ts",
        F.when(key % 1499 == 3, F.lit(5)).otherwise(F.lit(6)).alias("width"),
        F.when(key % 1201 == 7, F.lit("otro"))
        .otherwise(F.concat(F.lit("Distrito "), (F.col("user_id") % 43).cast("string")))
        .alias("district_text"),
        F.when(key % 997 == 11, F.lit("Kilo")).otherwise(F.lit("galones")).alias("unit_text"),
        F.when(key % 701 == 13, F.lit("abc"))
        .otherwise(F.concat(F.lit("S/ "), F.round(F.col("value") + 1, 2).cast("decimal(12,2)").cast("string")))
        .alias("price_text"),
        F.concat(F.lit("Site "), F.col("user_id").cast("string")).alias("name_text"),
        F.col("props").alias("address_text"),
    )


def _captured_units(rows):
    d = F.col("district_code")
    return (
        rows.groupBy("district_code", "product")
        .agg(F.max("ts").alias("observed_at"), F.count(F.lit(1)).alias("_n"))
        .select(
            "district_code",
            "product",
            "observed_at",
            F.upper(F.concat(F.lit("distrito  "), d.cast("string"))).alias("district_name"),
            F.when(d % 20 == 19, F.lit("rechazo_http")).alias("rejection"),
            F.when(d % 20 == 18, F.lit("sin_tabla")).otherwise(F.lit("ok")).alias("state"),
            (d % 20 != 17).alias("product_ok"),
            (d % 20 != 16).alias("headers_ok"),
            (d % 20 != 15).alias("complete"),
            (F.col("_n") + (d % 20 == 14).cast("int")).alias("announced_total"),
        )
    )


@query(
    "unit_accept",
    f"""WITH {_CAPTURE_SQL}
SELECT d::BIGINT AS district_code, product, epoch_us(observed_at)::BIGINT AS observed_us, n::BIGINT AS rows_read,
       CASE WHEN d % 20 = 19 THEN 'rechazo_http' WHEN d % 20 = 18 THEN 'sin_tabla'
            WHEN d % 20 = 17 THEN 'producto_no_coincide' WHEN d % 20 = 16 THEN 'cabeceras_desconocidas'
            WHEN first_bad IS NOT NULL THEN first_bad WHEN d % 20 = 15 THEN 'extraccion_incompleta'
            WHEN d % 20 = 14 THEN 'total_no_coincide' ELSE 'ok' END AS status
FROM unit""",
)
def unit_accept(spark, sf_dir):
    rows = _captured(spark, sf_dir)
    judged = live.accept_units(_captured_units(rows), rows, width=6, unit_name="Galones")
    return judged.select(
        "district_code", "product", F.unix_micros("observed_at").alias("observed_us"), "rows_read", "status"
    )


@query(
    "unit_accepted_rows",
    f"""WITH {_CAPTURE_SQL}
SELECT c.d::BIGINT AS district_code, c.product, c.ord::BIGINT AS row_ordinal, substr(c.ptext, 4)::DOUBLE AS price,
       substr(sha256('link-v1|["SITE ' || e.user_id::VARCHAR || '",' || to_json(upper(e.props))::VARCHAR
              || ',"DISTRITO ' || c.d::VARCHAR || '"]'), 1, 32) AS key_hash
FROM cap c JOIN unit u ON u.d = c.d AND u.product = c.product JOIN events e ON e.event_id = c.ord
WHERE first_bad IS NULL AND c.d % 20 < 14""",
)
def unit_accepted_rows(spark, sf_dir):
    rows = _captured(spark, sf_dir)
    judged = live.accept_units(_captured_units(rows), rows, width=6, unit_name="Galones")
    return live.accepted_rows(rows, judged, S.LINK_SCHEME, keep=["row_ordinal"]).drop("observed_at")


# --- state --------------------------------------------------------------------------------------

_STATE_SQL = """
prev AS (SELECT user_id % 43 AS d, event_type AS product, max(ts) AS observed_at, count(*) AS total FROM events
         WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2 HAVING max(value) > 120),
att AS (SELECT user_id % 43 AS d, event_type AS product, day(ts) AS seq, max(ts) AS observed_at, count(*) AS total,
               CASE WHEN (user_id % 43 + day(ts)) % 4 = 0 THEN 'sin_tabla' ELSE 'ok' END AS status
        FROM events WHERE ts >= TIMESTAMP '2024-01-12' GROUP BY 1, 2, 3, 6),
good AS (SELECT *, row_number() OVER (PARTITION BY d, product ORDER BY observed_at DESC, seq) AS r
         FROM att WHERE status = 'ok'),
last AS (SELECT *, row_number() OVER (PARTITION BY d, product ORDER BY seq DESC) AS r FROM att),
merged AS (SELECT coalesce(p.d, l.d) AS d, coalesce(p.product, l.product) AS product, p.observed_at AS old_at,
                  p.total AS old_total, g.observed_at AS new_at, g.total AS new_total, g.seq AS new_seq,
                  l.status, l.seq AS last_seq
           FROM prev p FULL JOIN (SELECT * FROM last WHERE r = 1) l ON l.d = p.d AND l.product = p.product
           LEFT JOIN (SELECT * FROM good WHERE r = 1) g ON g.d = coalesce(p.d, l.d)
                AND g.product = coalesce(p.product, l.product)),
ruled AS (SELECT *, new_at IS NOT NULL AND (old_at IS NULL OR new_at > old_at) AS newer FROM merged),
state AS (SELECT d, product, CASE WHEN newer THEN new_at ELSE old_at END AS observed_at,
                 CASE WHEN newer THEN new_total ELSE old_total END AS announced_total,
                 CASE WHEN status IS NULL THEN 'ok' WHEN status <> 'ok' THEN status
                      WHEN newer AND new_seq = last_seq THEN 'ok' ELSE 'descartada_por_anterior' END AS attempt
          FROM ruled WHERE old_at IS NOT NULL OR newer)
"""


def _previous(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return (
        e.groupBy((F.col("user_id") % 43).alias("district_code"), F.col("event_type").alias("product"))
        .agg(
            F.max("ts").alias("observed_at"), F.count(F.lit(1)).alias("announced_total"), F.max("value").alias("_top")
        )
        .where("_top > 120")
        .select(
            "district_code",
            "product",
            "observed_at",
            "announced_total",
            F.lit(None).cast("timestamp").alias("last_attempt_at"),
            F.lit("ok").alias("last_attempt_status"),
        )
    )


def _attempts(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-12").cast("timestamp"))
    d = F.col("user_id") % 43
    return (
        e.groupBy(d.alias("district_code"), F.col("event_type").alias("product"), F.dayofmonth("ts").alias("seq"))
        .agg(F.max("ts").alias("observed_at"), F.count(F.lit(1)).alias("announced_total"))
        .withColumn(
            "status",
            F.when((F.col("district_code") + F.col("seq")) % 4 == 0, F.lit("sin_tabla")).otherwise(F.lit("ok")),
        )
    )


@query(
    "state_upsert",
    f"""WITH {_STATE_SQL}
SELECT d::BIGINT AS district_code, product, epoch_us(observed_at)::BIGINT AS observed_us,
       announced_total::BIGINT AS announced_total, attempt AS last_attempt_status FROM state""",
)
def state_upsert(spark, sf_dir):
    state = live.apply_run(_previous(spark, sf_dir), _attempts(spark, sf_dir), RUN_AT)
    return state.select(
        "district_code",
        "product",
        F.unix_micros("observed_at").alias("observed_us"),
        "announced_total",
        "last_attempt_status",
    )


@query(
    "run_counts",
    f"""WITH {_STATE_SQL},
t AS (SELECT product, count(*) FILTER (status = 'ok') AS fresh, count(*) FILTER (status <> 'ok') AS failed
      FROM att GROUP BY 1),
k AS (SELECT product, count(*) AS units, max(observed_at) AS newest FROM state GROUP BY 1)
SELECT coalesce(t.product, k.product) AS product, coalesce(fresh, 0)::BIGINT AS fresh, coalesce(failed, 0)::BIGINT AS failed,
       greatest(0, coalesce(units, 0) - coalesce(fresh, 0))::BIGINT AS reused, epoch_us(newest)::BIGINT AS newest_us
FROM t FULL JOIN k ON k.product = t.product""",
)
def run_counts(spark, sf_dir):
    attempts = _attempts(spark, sf_dir)
    state = live.apply_run(_previous(spark, sf_dir), attempts, RUN_AT)
    counts = live.run_counts(state, attempts)
    return counts.withColumn("newest_us", F.unix_micros("newest_observed_at")).drop("newest_observed_at")


@query(
    "state_for_products",
    f"""WITH {_STATE_SQL}
SELECT product, count(*)::BIGINT AS units, count(DISTINCT d)::BIGINT AS districts,
       epoch_us(max(observed_at))::BIGINT AS newest_us FROM state WHERE product IN ('click', 'view') GROUP BY 1""",
)
def state_for_products(spark, sf_dir):
    state = live.apply_run(_previous(spark, sf_dir), _attempts(spark, sf_dir), RUN_AT)
    mine = live.for_products(state, ["click", "view"])
    # A unit is one district of one product, so units and districts of a product are the same count.
    return mine.groupBy("product").agg(
        F.count(F.lit(1)).alias("units"),
        F.count(F.lit(1)).alias("districts"),
        F.unix_micros(F.max("observed_at")).alias("newest_us"),
    )


@query(
    "unit_regressions",
    """WITH pub AS (SELECT user_id % 43 AS d, event_type AS product, max(ts) AS at FROM events
                   WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
cand AS (SELECT user_id % 43 AS d, event_type AS product,
                max(CASE WHEN (user_id % 43) % 3 = 0 THEN ts - INTERVAL 15 DAY ELSE ts END) AS at FROM events
         WHERE (user_id % 43) % 7 <> 0 OR event_type <> 'view' GROUP BY 1, 2)
SELECT p.d::BIGINT AS district_code, p.product, epoch_us(p.at)::BIGINT AS published_us, epoch_us(c.at)::BIGINT AS candidate_us
FROM pub p LEFT JOIN cand c ON c.d = p.d AND c.product = p.product
WHERE p.product <> 'signup' AND (c.at IS NULL OR c.at < p.at)""",
)
def unit_regressions(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").withColumns(
        {"district_code": F.col("user_id") % 43, "product": F.col("event_type")}
    )
    newest = F.max("ts").alias("observed_at")
    published = e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy(*live.UNIT).agg(newest)
    # Every third district comes back fifteen days old, every seventh lacks a product.
    older = F.when(F.col("district_code") % 3 == 0, F.col("ts") - F.expr("INTERVAL 15 DAYS")).otherwise(F.col("ts"))
    there = e.where((F.col("district_code") % 7 != 0) | (F.col("product") != "view"))
    candidate = there.withColumn("ts", older).groupBy(*live.UNIT).agg(newest)
    found = live.unit_regressions(candidate, published, ["click", "error", "purchase", "view"])
    return found.select(
        *live.UNIT,
        F.unix_micros("published_at").alias("published_us"),
        F.unix_micros("candidate_at").alias("candidate_us"),
    )


# --- links --------------------------------------------------------------------------------------

_BLANK = "'[\\s\\x0b\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+'"


def _norm_sql(column: str) -> str:
    folded = f"upper(replace(strip_accents({column}), 'ß', 'SS'))"
    return f"trim(regexp_replace({folded}, {_BLANK}, ' ', 'g'), ' ')"


_LINK_SQL = f"""
texts AS (SELECT doc_id, lang, n_chars, {_norm_sql('text')} AS t, {_norm_sql('source')} AS s FROM documents),
keyed AS (SELECT doc_id, lang, n_chars,
                 CASE WHEN t <> '' AND s <> '' THEN substr(sha256('link-v1|' ||
                      to_json([t, s, upper(lang)])::VARCHAR), 1, 32) END AS key_hash FROM texts),
live AS (SELECT lang AS product, key_hash, count(*) AS n, min(n_chars) AS price FROM keyed
         WHERE key_hash IS NOT NULL AND n_chars > 0 AND doc_id % 30 <= 24 GROUP BY 1, 2),
offers AS (SELECT k.lang AS product, key_hash, count(*) AS n, min(k.doc_id) AS id FROM keyed k
           JOIN labels l ON l.doc_id = k.doc_id WHERE key_hash IS NOT NULL GROUP BY 1, 2),
links AS (SELECT v.product, v.key_hash, CASE WHEN v.n > 1 OR o.n > 1 THEN 'ambiguous' WHEN o.n IS NULL THEN 'unlinked'
                                             ELSE 'linked' END AS status, o.id, v.price
          FROM live v LEFT JOIN offers o ON o.product = v.product AND o.key_hash = v.key_hash)
"""


def _keyed(spark, sf_dir):
    """Documents as live rows, read up to 29 hours before the instant: those beyond 24 are expired."""
    docs = S.documents(spark, sf_dir, "doc_id", "lang", "source", "text", "n_chars")
    keyed = docs.select(  # keys are stored beside their rows, so whole texts are read once
        F.col("doc_id").alias("id"),
        F.col("lang").alias("product"),
        F.col("n_chars").cast("double").alias("price"),
        (instant_lit(NOW) - F.make_dt_interval(hours=(F.col("doc_id") % 30).cast("int"))).alias("observed_at"),
        F.col("source").alias("unit"),
        live.link_key(F.col("text"), F.col("source"), F.col("lang"), S.LINK_SCHEME).alias("key_hash"),
    )
    return cut_lineage(keyed)


def _links(spark, sf_dir, keyed):
    labelled = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    offers = keyed.join(labelled, "id", "left_semi").select("id", "product", "key_hash")
    return live.link_keys(keyed.drop("id", "unit"), offers, NOW)


@query(
    "link_unique",
    f"""WITH {_LINK_SQL}
SELECT product, key_hash, status, CASE WHEN status = 'linked' THEN id END::BIGINT AS id,
       CASE WHEN status = 'linked' THEN price END::DOUBLE AS live_price FROM links""",
)
def link_unique(spark, sf_dir):
    return _links(spark, sf_dir, _keyed(spark, sf_dir)).drop("live_observed_at")


@query(
    "link_counts",
    f"""WITH {_LINK_SQL},
k AS (SELECT product, count(*) FILTER (status = 'linked') AS linked, count(*) FILTER (status = 'ambiguous') AS ambiguous,
             count(*) FILTER (status = 'unlinked') AS unlinked FROM links GROUP BY 1),
u AS (SELECT lang, source, min(doc_id % 30) AS youngest FROM documents GROUP BY 1, 2),
x AS (SELECT lang AS product, count(*) FILTER (youngest > 24) AS expired FROM u GROUP BY 1),
r AS (SELECT lang AS product, count(*) FILTER (doc_id % 30 <= 24) AS n FROM documents GROUP BY 1)
SELECT r.product, r.n::BIGINT AS rows, coalesce(linked, 0)::BIGINT AS linked, coalesce(ambiguous, 0)::BIGINT AS ambiguous,
       coalesce(unlinked, 0)::BIGINT AS unlinked, expired::BIGINT AS expired_units
FROM r JOIN x ON x.product = r.product LEFT JOIN k ON k.product = r.product""",
)
def link_counts(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    units = keyed.groupBy("product", "unit").agg(F.max("observed_at").alias("observed_at"))
    return live.link_counts(_links(spark, sf_dir, keyed), keyed, units, NOW)
