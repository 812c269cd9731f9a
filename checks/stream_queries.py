"""Streams over the events file, and text features over documents."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from checks import standins as S
from checks.match_queries import SEGMENTS, STREETS, _pick
from checks.registry import query
from pricewarden import reasons as R
from pricewarden.functions import addresses
from pricewarden.functions.address_parts import PARTS, address_parts
from pricewarden.functions.skew import spread
from pricewarden.operators import directories
from pricewarden.operators.history import local_date
from pricewarden.session import checkpoint_root, cut_lineage
from pricewarden.streaming import daily, state

RUN_AT = datetime(2024, 1, 30, 12)


def _event_stream(spark, sf_dir):
    schema = S.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _attempts(batch):
    d = F.col("user_id") % 43
    return (
        batch.groupBy(d.alias("district_code"), F.col("event_type").alias("product"), F.dayofmonth("ts").alias("seq"))
        .agg(F.max("ts").alias("observed_at"), F.count(F.lit(1)).alias("announced_total"))
        .withColumn(
            "status",
            F.when((F.col("district_code") + F.col("seq")) % 4 == 0, F.lit("sin_tabla")).otherwise(F.lit("ok")),
        )
    )


@query(
    "streaming_state",
    """WITH att AS (SELECT user_id % 43 AS d, event_type AS product, day(ts) AS seq, max(ts) AS seen, count(*) AS total,
                        CASE WHEN (user_id % 43 + day(ts)) % 4 = 0 THEN 'sin_tabla' ELSE 'ok' END AS status
                 FROM events GROUP BY 1, 2, 3, 6),
w AS (SELECT d, product, max(seen) AS seen, arg_max(total, seen) AS total FROM att WHERE status = 'ok' GROUP BY 1, 2),
l AS (SELECT d, product, arg_max(status, seq) AS status FROM att GROUP BY 1, 2)
SELECT w.d::BIGINT AS district_code, w.product, epoch_us(seen)::BIGINT AS observed_us, total::BIGINT AS announced_total,
       l.status AS last_attempt_status FROM w JOIN l ON l.d = w.d AND l.product = w.product""",
)
def streaming_state(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    root = f"{checkpoint_root(spark)}/unit-state-{uuid.uuid4().hex}"
    state.start(stream, root, _attempts, RUN_AT).awaitTermination()
    return state.load_state(spark, root).select(
        "district_code",
        "product",
        F.unix_micros("observed_at").alias("observed_us"),
        "announced_total",
        "last_attempt_status",
    )


@query(
    "streaming_daily",
    """WITH e AS (SELECT event_type AS product, CAST(ts - INTERVAL 5 HOURS AS DATE) AS date, user_id AS site,
                   CASE WHEN user_id % 30 = 7 THEN value ELSE user_id % 50 + 1 END AS price FROM events),
s AS (SELECT product, date, site, min(price) AS price, max(price) AS top FROM e GROUP BY 1, 2, 3)
SELECT product, date, CASE WHEN bool_and(price = top) THEN round(avg(price), 4) END::DOUBLE AS mean, count(*)::BIGINT AS n,
       count(*) FILTER (price <> top)::BIGINT AS contradictions, CASE WHEN bool_and(price = top) THEN 'ok' ELSE 'invalid' END AS status
FROM s WHERE date < (SELECT CAST(max(ts) - INTERVAL 11 HOURS AS DATE) FROM events) GROUP BY 1, 2""",
)
def streaming_daily(spark, sf_dir):
    """Days the watermark has closed by the end of the file; later days stay open.

    A user is a site that repeats its own price, apart from some that name another one each time.
    """
    price = F.when(F.col("user_id") % 30 == 7, F.col("value")).otherwise((F.col("user_id") % 50 + 1).cast("double"))
    prices = _event_stream(spark, sf_dir).select(
        F.col("event_type").alias("product"), F.col("user_id").alias("site_id"), price.alias("price"), F.col("ts").alias("observed_at")
    )
    root = f"{checkpoint_root(spark)}/daily-{uuid.uuid4().hex}"
    written = (
        daily.daily_windows(prices)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/days")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    written.awaitTermination()
    return spark.read.parquet(f"{root}/days")


_LATE_SQL = """
e AS (SELECT event_type AS product, CAST(ts - INTERVAL 5 HOURS AS DATE) AS date, user_id AS site_id, ts,
             CASE WHEN user_id % 30 = 7 THEN value ELSE user_id % 50 + 1 END AS price,
             event_id % 10 = 3 OR (event_type = 'error' AND CAST(ts - INTERVAL 5 HOURS AS DATE) = DATE '2024-01-10') AS second FROM events),
edge AS (SELECT CAST(max(ts) FILTER (NOT second) - INTERVAL 11 HOURS AS DATE) AS first, CAST(max(ts) - INTERVAL 11 HOURS AS DATE) AS last FROM e),
r AS (SELECT product, date, site_id, min(price) AS lowest, max(price) AS highest FROM e, edge WHERE date < last GROUP BY 1, 2, 3),
s AS (SELECT product, date, site_id, min(price) AS lowest, max(price) AS highest FROM e, edge
      WHERE date < last AND (NOT second OR date >= first) GROUP BY 1, 2, 3)
"""


@query(
    "streaming_late",
    f"""WITH {_LATE_SQL}
SELECT r.product, r.date, r.site_id::BIGINT AS site_id, r.lowest::DOUBLE AS lowest, r.highest::DOUBLE AS highest,
       s.lowest::DOUBLE AS stored_lowest, s.highest::DOUBLE AS stored_highest
FROM r LEFT JOIN s ON s.product = r.product AND s.date = r.date AND s.site_id = r.site_id
WHERE s.lowest IS DISTINCT FROM r.lowest OR s.highest IS DISTINCT FROM r.highest""",
)
def streaming_late(spark, sf_dir):
    """What the stream of daily prices missed of a tenth of the rows, and of one product on one day, that came in a second delivery."""
    price = F.when(F.col("user_id") % 30 == 7, F.col("value")).otherwise((F.col("user_id") % 50 + 1).cast("double"))
    whole_day = (F.col("event_type") == "error") & (local_date(F.col("ts")) == F.lit("2024-01-10").cast("date"))
    events = S.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("product"), F.col("user_id").alias("site_id"), price.alias("price"), F.col("ts").alias("observed_at"),
        ((F.col("event_id") % 10 == 3) | whole_day).alias("second"),
    )
    root = f"{checkpoint_root(spark)}/late-{uuid.uuid4().hex}"
    for delivery in (~F.col("second"), F.col("second")):
        events.where(delivery).drop("second").write.mode("append").parquet(f"{root}/received")
        schema = events.drop("second").schema
        daily.store_site_days(spark.readStream.schema(schema).parquet(f"{root}/received"), root).awaitTermination()
    late = daily.late_sites(spark.read.parquet(f"{root}/sites"))
    return late.withColumnsRenamed({"counted_lowest": "stored_lowest", "counted_highest": "stored_highest"})


# --- text features ------------------------------------------------------------------------------


def _lines(spark, sf_dir, dealt=True):
    docs = S.documents(spark, sf_dir, "doc_id", "text", dealt=dealt).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return docs.where("text <> ''")


@query("address_features")
def address_features(spark, sf_dir):
    """How many parts of each kind every document's lines hold."""
    parts = _lines(spark, sf_dir).withColumn("parts", address_parts(F.col("text")))
    counts = [F.sum(F.size(F.col("parts")[name])).alias(name) for name in PARTS]
    return parts.groupBy("doc_id").agg(*counts)


_BLANKS = r"[ \t\n\x0B\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_NO_WORD = r"(?:[^\pL\pN]+|$)"


@query(
    "display_address",
    rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, (generate_subscripts(lines, 1) - 1)::INTEGER AS line, unnest(lines) AS raw FROM d),
a AS (SELECT doc_id, line, trim(regexp_replace(raw, '{_BLANKS}', ' ', 'g'), ' ') AS t FROM l WHERE raw <> ''),
b AS (SELECT doc_id, line, regexp_replace(t, '(?i)^[^\pL\pN]*(?:ESQUINA|ESQ|FRENTE[^\pL\pN]+A|ALTURA[^\pL\pN]+DE|INTERSECCION[^\pL\pN]+DE){_NO_WORD}(?:DE{_NO_WORD})?(?:(?:LA|EL|LOS|LAS){_NO_WORD})?', '') AS t FROM a),
c0 AS (SELECT *, rtrim(regexp_replace(t, '(?i)(?:,|\(|\b(?:ESQ|ESQUINA|URB|URBANIZACION|URBANIZACIÓN|ASOC|AA\.?HH|SUB ?LOTE|DENOMINADO|ANTES|SECTOR|ETAPA|COMITE|AGRUPAMIENTO|PARCELA|CON FRENTE|FRENTE A|CENTRO POBLADO)\b).*$', ''), ' ') AS kept FROM b),
c AS (SELECT doc_id, line, regexp_replace(regexp_replace(CASE WHEN length(kept) >= 6 THEN kept ELSE t END, '(?i)\b(?:N[°º¿]|NRO\.?) *', '', 'g'),
             '(?i)([0-9]+) *[-–] *[0-9A-Z]+(?: *[-–] *[0-9A-Z]+)*', '\1', 'g') AS t FROM c0),
e AS (SELECT doc_id, line, CASE WHEN regexp_matches(regexp_replace(t, '(?i)\b(?:MZ|LOTE|LT\b).*$', ''), '[0-9]') THEN rtrim(regexp_replace(t, '(?i)\b(?:MZ|MZA|LOTE|LT)\b.*$', ''), ' ') ELSE t END AS t FROM c),
f AS (SELECT doc_id, line, string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bKM\.? *', 'Km. '), '[-–.,; ]+$', ''), ' +', ' ', 'g'), ' ')), ' ') AS w FROM e),
g AS (SELECT doc_id, line, regexp_replace(array_to_string(list_transform(w, lambda x, i: CASE
        WHEN i > 1 AND x IN ('de', 'del', 'y', 'con', 'en', 'a') THEN x WHEN i > 1 AND w[i - 1] IN ('de', 'del') AND x IN ('la', 'las', 'los', 'el') THEN x
        WHEN regexp_full_match(x, 'aa\.?hh\.?') THEN 'AA.HH.' WHEN regexp_full_match(x, '(av|jr|mz|mza|lt|km|ca)\.?') THEN upper(left(x, 1)) || rtrim(substr(x, 2), '.') || '.'
        ELSE replace(upper(left(x, 1)), 'ẞ', 'SS') || substr(x, 2) END), ' '), '[-–.,; ]+$', '') AS t FROM f)
SELECT doc_id, line, nullif(CASE WHEN length(t) > 46 THEN regexp_replace(left(t, 45), '[ ,]+[^ ]*$', '') || '…' ELSE t END, '') AS address FROM g""",
)
def display_address(spark, sf_dir):
    return _lines(spark, sf_dir, dealt=False).select("doc_id", "line", addresses.display_address(F.col("text")).alias("address"))


_TELLING_SQL = r"""len(list_filter(string_split_regex({0}, '[\s.,()"]+'), lambda w: lower(w) NOT IN ('', 'grifo', 'grifos', 'estacion', 'estación', 'estaciones', 'servicio',
    'servicios', 'gasolinera', 'combustible', 'combustibles', 'gas', 'gnv', 'glp', 'de', 'del', 'la', 'el', 'y', 'ee.ss', 'eess')
    AND NOT regexp_matches(w, '(?i)^(s\.?a\.?c?\.?|e\.?i\.?r\.?l\.?|s\.?r\.?l\.?|ltda\.?)$'))) > 0"""


@query(
    "display_name",
    rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(source || ' ' || text || ' GLP', '{_BLANKS}', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, list_filter(['PRIMAX', 'REPSOL', 'PECSA', 'PETROPERU', 'TERPEL', 'COESTI'], lambda x: contains(upper(strip_accents(t)), x))[1] AS brand FROM a),
c0 AS (SELECT *, regexp_replace(trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '[\pL\pN]+|[^\pL\pN]'),
             lambda x: CASE WHEN upper(strip_accents(x)) = brand THEN ' ' ELSE x END), ''), ' +', ' ', 'g'), ' '), '^[-·,( ]+|[-·,( ]+$', '', 'g') AS rest FROM b),
c AS (SELECT doc_id, CASE WHEN brand IS NULL THEN t WHEN {_TELLING_SQL.format('rest')} THEN rest END AS t FROM c0),
d0 AS (SELECT *, regexp_replace(t, '(?i)(?:[ ·,-]*)(?:gnv|glp)$', '') AS kept, regexp_matches(t, '(?i)(^|[^\pL\pN])(gnv|glp)$') AS fuel FROM c),
d AS (SELECT doc_id, CASE WHEN fuel AND {_TELLING_SQL.format('kept')} THEN kept ELSE t END AS t FROM d0),
e AS (SELECT *, t = upper(t) AND regexp_matches(t, '[A-ZÁÉÍÓÚÑ]') AS loud, t = lower(t) AS quiet FROM d),
f AS (SELECT doc_id, CASE WHEN loud OR quiet THEN array_to_string(list_transform(list_filter(string_split(t, ' '), lambda x: x <> ''), lambda x, i: CASE
        WHEN regexp_matches(x, '(?i)^(s\.?a\.?c?\.?|e\.?i\.?r\.?l\.?|s\.?r\.?l\.?|ltda\.?)$') THEN upper(x)
        WHEN i > 1 AND lower(x) IN ('de', 'del', 'la', 'las', 'los', 'y', 'el', 'en', 'con', 'a') THEN lower(x)
        WHEN loud AND length(x) <= 4 AND NOT contains(x, '.') AND lower(x) NOT IN ('de', 'del', 'la', 'las', 'los', 'y', 'el', 'en', 'con', 'a') THEN x
        ELSE replace(upper(left(x, 1)), 'ẞ', 'SS') || lower(substr(x, 2)) END), ' ') ELSE t END AS t FROM e)
SELECT doc_id, nullif(CASE WHEN length(t) > 44 THEN regexp_replace(left(t, 43), '[\s,]+[^\s]*$', '') || '…' ELSE t END, '') AS public_site_name FROM f""",
)
def display_name(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit(" "), F.col("text"), F.lit(" GLP"))
    docs = S.documents(spark, sf_dir, "doc_id", "source", "text", dealt=False).where("text IS NOT NULL")
    return docs.select("doc_id", addresses.display_name(name, F.lit(False)).alias("public_site_name"))


# --- directories --------------------------------------------------------------------------------


def _entries(spark, sf_dir):
    key = F.col("place_id")
    digits = (key % 4 + 1).cast("int")

    def rounded(name):
        expr = F.col(name)
        for places in (1, 2, 3):
            expr = F.when(digits == places, F.round(F.col(name), places)).otherwise(expr)
        return F.when(digits == 4, F.round(F.col(name), 5)).otherwise(expr)

    return S.places(spark, sf_dir).select(
        F.concat(F.lit("d#"), key.cast("string")).alias("entry_key"),
        F.lit("d").alias("directory"),
        F.when(key % 2 == 0, F.lit("Primax")).otherwise(F.lit("Repsol")).alias("brand"),
        F.concat(F.lit("E/S "), _pick(SEGMENTS, key)).alias("name"),
        F.concat(F.lit("AV. "), _pick(STREETS, F.col("nation")), F.lit(" "), (key % 50 + 10).cast("string")).alias(
            "address"
        ),
        F.when(key % 3 == 0, F.concat(F.lit("Región "), (F.col("nation") % 5).cast("string")))
        .otherwise(F.lit(""))
        .alias("district"),
        rounded("latitude").alias("latitude"),
        rounded("longitude").alias("longitude"),
    )


def _directory_sites(spark, sf_dir):
    key = F.col("site_id")
    return S.sites(spark, sf_dir).select(
        "site_id",
        F.concat(F.lit("REGION "), (F.col("district") % 5).cast("string")).alias("district"),
        F.concat(
            F.lit("AVENIDA "), _pick(STREETS, F.col("district")), F.lit(" NRO. "), (key % 50 + 10).cast("string")
        ).alias("address"),
        F.when(key % 6 == 0, F.lit("REPSOL COMERCIAL")).otherwise(F.concat("segment", F.lit(" SAC"))).alias(
            "legal_name"
        ),
        "latitude",
        "longitude",
    )


_WINDOW_SQL = f"""
e AS (SELECT s_suppkey AS p, CASE s_suppkey % 4 + 1 WHEN 1 THEN round({S.PLACE_LAT_SQL}, 1) WHEN 2 THEN round({S.PLACE_LAT_SQL}, 2)
             WHEN 3 THEN round({S.PLACE_LAT_SQL}, 3) ELSE round({S.PLACE_LAT_SQL}, 5) END AS lat,
             CASE s_suppkey % 4 + 1 WHEN 1 THEN round({S.PLACE_LON_SQL}, 1) WHEN 2 THEN round({S.PLACE_LON_SQL}, 2)
             WHEN 3 THEN round({S.PLACE_LON_SQL}, 3) ELSE round({S.PLACE_LON_SQL}, 5) END AS lon FROM supplier),
txt AS (SELECT *, rtrim(lat::DECIMAL(38,18)::VARCHAR, '0') AS lt, rtrim(lon::DECIMAL(38,18)::VARCHAR, '0') AS ln FROM e),
dec AS (SELECT *, length(lt) - strpos(lt, '.') AS ld, length(ln) - strpos(ln, '.') AS nd FROM txt),
tol AS (SELECT *, CASE WHEN ld >= 4 THEN 200.0 WHEN ld = 3 THEN 300 WHEN ld = 2 THEN 1000 WHEN ld = 1 THEN 6000 END AS lat_m,
               CASE WHEN nd >= 4 THEN 200.0 WHEN nd = 3 THEN 300 WHEN nd = 2 THEN 1000 WHEN nd = 1 THEN 6000 END AS lon_m FROM dec),
s AS (SELECT c_custkey AS s, c_nationkey AS n, {S.SITE_LAT_SQL} AS slat, {S.SITE_LON_SQL} AS slon FROM customer),
w AS (SELECT p, s, n FROM tol, s WHERE CASE WHEN lat_m = 200 AND lon_m = 200
          THEN {S.distance_sql("lat", "lon", "slat", "slon", 6371008.8)} <= 200
          ELSE (lat_m IS NULL OR abs(lat - slat) * 111195.0::DOUBLE <= lat_m)
           AND (lon_m IS NULL OR abs(lon - slon) * 111195.0::DOUBLE * cos(radians(lat)) <= lon_m) END)
"""


# What the stand-ins share follows from their keys: street by nation, door and name by key, operator at every sixth site.
_DIRECTORY_SQL = f"""{_WINDOW_SQL},
seen AS (SELECT w.p, w.s, p2.s_nationkey % 5 = w.n % 5 AS street, w.p % 50 = w.s % 50 AS door,
                w.s % 6 <> 0 AND c.c_mktsegment = ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][w.p % 5 + 1] AS name,
                w.s % 6 = 0 AND w.p % 2 = 1 AS owner, w.p % 3 = 0 AS declared, w.s % 6 = 0 AND w.p % 2 = 0 AS clash,
                CASE WHEN w.p % 2 = 0 THEN 'PRIMAX' ELSE 'REPSOL' END AS brand, w.p % 3 <> 0 OR p2.s_nationkey % 5 = w.n % 5 AS own
         FROM w JOIN supplier p2 ON p2.s_suppkey = w.p JOIN customer c ON c.c_custkey = w.s),
good AS (SELECT *, 45 * door::INT + 35 * street::INT + 40 * name::INT + 10 * owner::INT + 10 * declared::INT AS score FROM seen
         WHERE own AND CASE WHEN declared THEN door OR street OR name ELSE (street AND (door OR name OR owner)) OR (door AND name) END),
placed AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, s) AS place FROM good),
top AS (SELECT a.p, a.s, a.score, a.brand, a.clash, a.score - b.score AS margin FROM placed a
        LEFT JOIN placed b ON b.p = a.p AND b.place = 2 WHERE a.place = 1),
claim AS (SELECT *, -score AS worse, 'd#' || p::VARCHAR AS entry FROM top WHERE margin IS NULL OR margin >= 15),
folded AS (SELECT s, min(brand) <> max(brand) AS several, bool_or(clash) AS clash, min((worse, entry)) AS best FROM claim GROUP BY 1),
settled AS (SELECT c.p, CASE WHEN several THEN '{R.DIRECTORY_CONFLICT}' WHEN f.clash THEN '{R.OPERATOR_CLASH}'
                             WHEN (c.worse, c.entry) = f.best THEN 'accredited' ELSE '{R.LOST_ASSIGNMENT}' END AS outcome
            FROM claim c JOIN folded f ON f.s = c.s),
present AS (SELECT p, bool_or(own) AS own FROM seen GROUP BY 1),
outcomes AS (SELECT e.s_suppkey AS p, CASE WHEN q.p IS NULL THEN '{R.NO_CANDIDATE}' WHEN NOT q.own THEN '{R.OTHER_DISTRICT}'
                    WHEN t.p IS NULL THEN '{R.NO_EVIDENCE}' WHEN z.p IS NULL THEN '{R.THIN_MARGIN}' ELSE z.outcome END AS outcome
             FROM supplier e LEFT JOIN present q ON q.p = e.s_suppkey LEFT JOIN top t ON t.p = e.s_suppkey LEFT JOIN settled z ON z.p = e.s_suppkey)
"""


@query(
    "directory_outcomes",
    f"""WITH {_DIRECTORY_SQL}
SELECT 'd' AS directory, outcome, count(*)::BIGINT AS n FROM outcomes GROUP BY 2""",
)
def directory_outcomes(spark, sf_dir):
    found = directories.match_directories(
        _entries(spark, sf_dir), _directory_sites(spark, sf_dir), ["Primax", "Repsol"]
    )
    return directories.directory_summary(found)


@query(
    "directory_evidence",
    f"""WITH {_DIRECTORY_SQL}
SELECT 'd#' || p::VARCHAR AS entry_key, s::BIGINT AS site_id, score::BIGINT AS score FROM good""",
)
def directory_evidence(spark, sf_dir):
    """Every confirmed pair of all windows, narrow and wide, with its score."""
    e, said = directories.entry_texts(_entries(spark, sf_dir))
    s, offered = directories.site_texts(_directory_sites(spark, sf_dir))
    found = directories.confirmed_pairs(e, s, cut_lineage(directories.judged_texts(said, offered)))
    return found.select("entry_key", "site_id", F.col("evidence_score").cast("long").alias("score"))


@query(
    "window_pairs",
    f"""WITH {_WINDOW_SQL}
SELECT 'd#' || w.p::VARCHAR AS entry_key, w.s::BIGINT AS site_id FROM w JOIN tol USING (p)
WHERE lat_m <= 1000 AND lon_m <= 1000""",
)
def window_pairs(spark, sf_dir):
    entries = cut_lineage(directories.entry_windows(_entries(spark, sf_dir)).drop("name", "address"))
    sites = cut_lineage(directories.site_spots(_directory_sites(spark, sf_dir)).drop("address", "legal_name"))
    return directories.window_pairs(entries, sites).select("entry_key", "site_id")


@query(
    "window_presence",
    f"""WITH {_WINDOW_SQL}
SELECT 'd#' || w.p::VARCHAR AS entry_key,
       bool_or(w.p % 3 <> 0 OR w.n % 5 = (SELECT s_nationkey FROM supplier WHERE s_suppkey = w.p) % 5) AS own
FROM w GROUP BY 1""",
)
def window_presence(spark, sf_dir):
    entries = cut_lineage(directories.entry_windows(_entries(spark, sf_dir)).drop("name", "address"))
    sites = cut_lineage(directories.site_spots(_directory_sites(spark, sf_dir)).drop("address", "legal_name"))
    return directories.window_presence(entries, sites)


# --- texts whose parts are known by key ----------------------------------------------------------

_WRITTEN_SQL = """
a AS (SELECT c_custkey AS k, (c_custkey * 7 % 8900 + 100)::VARCHAR AS door, ['JAVIER PRADO', 'TUPAC AMARU', 'UNIVERSITARIA', 'LA MARINA', 'BENAVIDES'][c_custkey % 5 + 1] AS street,
             c_mktsegment AS seg FROM customer)
"""


def _written(spark, sf_dir):
    key = F.col("c_custkey")
    door = (key * 7 % 8900 + 100).cast("string")
    street, seg = _pick(STREETS, key), F.col("c_mktsegment")
    letter = F.char(F.lit(65) + key % 20)
    address = (
        F.when(key % 5 == 0, F.concat(F.lit("Av. "), street, F.lit(" N° "), door, F.lit(", Urb. "), seg))
        .when(key % 5 == 1, F.concat(F.lit("CARRETERA CENTRAL KM. "), (key % 90 + 1).cast("string"), F.lit(".5 MZ. A LOTE 3")))
        .when(key % 5 == 2, F.concat(F.lit("MZ. "), letter, F.lit(" LOTE "), (key % 30 + 1).cast("string"), F.lit(" AA.HH. "), seg))
        .when(key % 5 == 3, F.concat(F.lit("Jr. 28 de Julio "), door, F.lit(" (frente al parque 300)")))
        .otherwise(F.concat(F.lit("ESQ. AV. "), street, F.lit(" CON JR. LIMA")))
    )
    name = (
        F.when(key % 3 == 0, F.concat(F.lit("GRIFO PRIMAX "), seg))
        .when(key % 3 == 1, F.concat(F.lit("grifo "), F.lower(seg), F.lit(" gnv")))
        .otherwise(F.lit("ESTACION DE SERVICIO PRIMAX"))
    )
    return spread(S.table(spark, sf_dir, "customer"), "c_custkey").select(key.alias("site_id"), address.alias("address"), name.alias("name"))


@query(
    "address_known",
    f"""WITH {_WRITTEN_SQL}
SELECT k::BIGINT AS site_id,
       CASE k % 5 WHEN 0 THEN array_to_string(list_sort(list_filter(string_split(street, ' '), lambda w: w <> 'LA')), ',') WHEN 3 THEN '28JULIO'
                  WHEN 4 THEN array_to_string(list_sort(list_append(list_filter(string_split(street, ' '), lambda w: w <> 'LA'), 'LIMA')), ',') ELSE '' END AS streets,
       CASE k % 5 WHEN 1 THEN 'CARRETERA,CENTRAL' ELSE '' END AS generics,
       CASE WHEN k % 5 IN (0, 2) THEN seg ELSE '' END AS locality,
       CASE WHEN k % 5 IN (0, 3) THEN door ELSE '' END AS doors,
       CASE k % 5 WHEN 1 THEN (k % 90 + 1)::VARCHAR || '.5' ELSE '' END AS km,
       CASE k % 5 WHEN 1 THEN 'A' WHEN 2 THEN chr((65 + k % 20)::INTEGER) ELSE '' END AS blocks,
       CASE k % 5 WHEN 1 THEN '3' WHEN 2 THEN (k % 30 + 1)::VARCHAR ELSE '' END AS lots FROM a""",
)
def address_known(spark, sf_dir):
    parts = _written(spark, sf_dir).withColumn("p", address_parts(F.col("address")))
    return parts.select("site_id", *[F.array_join(F.col("p")[name], ",").alias(name) for name in PARTS])


@query(
    "display_known",
    f"""WITH {_WRITTEN_SQL},
t AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Av. ' || street || ' ' || door WHEN 4 THEN 'Av. ' || street ELSE '' END AS raw FROM a),
c AS (SELECT *, array_to_string([CASE WHEN w = '' THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END for w in string_split(raw, ' ')], ' ') AS cased FROM t)
SELECT k::BIGINT AS site_id, CASE k % 5 WHEN 0 THEN cased WHEN 1 THEN 'Carretera Central Km. ' || (k % 90 + 1)::VARCHAR || '.5'
       WHEN 2 THEN 'Mz. ' || chr((65 + k % 20)::INTEGER) || ' Lote ' || (k % 30 + 1)::VARCHAR WHEN 3 THEN 'Jr. 28 de Julio ' || door
       ELSE cased || ' con Jr. Lima' END AS address,
       CASE k % 3 WHEN 2 THEN NULL ELSE 'Grifo ' || left(seg, 1) || lower(substr(seg, 2)) END AS name FROM c""",
)
def display_known(spark, sf_dir):
    return _written(spark, sf_dir).select(
        "site_id", addresses.display_address(F.col("address")).alias("address"), addresses.display_name(F.col("name"), F.lit(False)).alias("name")
    )
