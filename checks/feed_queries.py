"""Feeds, harvests and directories written from the given tables, read back under their contracts, up to a published version."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from checks.report_queries import STAGED_SQL
from pricewarden.config import rules_frame
from pricewarden.plans import observe, publish
from pricewarden.schemas import LPG
from pricewarden.session import checkpoint_root
from pricewarden.sources import delimited, places, versions

# The header as publishers write it; the reader normalises it.
HEADER = (
    "ID4", "ACTIVIDAD", "REGISTRO DE HIDROCARBUROS", "RUC", "RAZÓN SOCIAL", "DEPARTAMENTO", "PROVINCIA", "DISTRITO",
    "DIRECCIÓN", "FECHA DE REGISTRO", "PRODUCTO", "TIPO DE CLIENTE", "MARCA", "PRECIO DE VENTA (SOLES)", "UNIDAD",
)


def _root(spark, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _feed(spark, sf_dir) -> DataFrame:
    """Every event as a report; names hold separators, quotes and line feeds."""
    e = S.table(spark, sf_dir, "events")
    key = F.col("event_id").cast("string")
    name = F.concat(F.lit('GRIFO "'), key, F.lit('"; SAC'), F.when(F.col("event_id") % 4 == 0, F.lit("\n2")).otherwise(F.lit("")))
    return e.select(
        key, "event_type", F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("20123456789"), name, F.lit(" LIMA "), F.lit("LIMA"),
        F.lit("MIRAFLORES"), F.lit("AV. LARCO"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("GLP - G"), F.lit("Usuario Final"),
        F.lit("MARCA"), F.format_string("%.2f", "value"), F.lit("Galones"),
    ).toDF(*HEADER)


def _written(rows: DataFrame, path: str) -> str:
    rows.write.options(sep=";", header=True, quote='"', escape='"', encoding="UTF-8").csv(path)
    return path


@query(
    "feed_landing",
    """SELECT event_id::VARCHAR AS id, event_type AS activity, lpad(user_id::VARCHAR, 6, '0') AS registration, 'LIMA' AS department,
       (epoch_us(date_trunc('second', ts)) // 1000000 + 5 * 3600)::BIGINT AS reported_epoch, round(value, 2)::DOUBLE AS price,
       length('GRIFO "' || event_id::VARCHAR || '"; SAC') + CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS name_chars FROM events""",
)
def feed_landing(spark, sf_dir):
    root = _root(spark, "feed")
    done = delimited.land(spark, _written(_feed(spark, sf_dir), f"{root}/in"), LPG, f"{root}/out")
    rows = delimited.landed(spark, done.path, LPG)
    reports, names = delimited.as_reports(rows, LPG), delimited.as_identities(rows, LPG)
    return reports.join(names, "id").select(
        "id", "activity", "registration", "department", F.unix_seconds("reported_at").alias("reported_epoch"), "price",
        F.length("legal_name").cast("long").alias("name_chars"),
    )


@query(
    "feed_quarantine",
    """SELECT event_type AS activity, count(*) FILTER (event_id % 97 = 0)::BIGINT AS malformed, count(*) FILTER (event_id % 97 <> 0)::BIGINT AS sound
FROM events GROUP BY 1""",
)
def feed_quarantine(spark, sf_dir):
    """Every 97th line lacks its last cells: the landing fails, and the rows it leaves say which. One file for each type."""
    root = _root(spark, "quarantine")
    plain = _feed(spark, sf_dir).withColumn("RAZÓN SOCIAL", F.concat(F.lit("GRIFO "), F.col("ID4")))
    cells, key = [F.col(f"`{c}`") for c in HEADER], F.col("ID4").cast("long")
    line = F.when(key % 97 == 0, F.concat_ws(";", *cells[:9])).otherwise(F.concat_ws(";", *cells))
    lines = plain.select(F.col("ACTIVIDAD").alias("part"), key.alias("seq"), line.alias("value"))
    heads = lines.select("part").distinct().select("part", F.lit(-1).cast("long").alias("seq"), F.lit(";".join(HEADER)).alias("value"))
    placed = lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "seq")
    placed.select("part", "value").write.partitionBy("part").text(f"{root}/in")
    out = []
    for kind in sorted(r["part"] for r in heads.collect()):  # as many as types of event
        try:
            delimited.land(spark, f"{root}/in/part={kind}", LPG, f"{root}/out/{kind}")
        except delimited.ContractError:
            pass
        else:
            raise AssertionError("a malformed feed was accepted")
        rows = spark.read.parquet(f"{root}/out/{kind}/{delimited.ROWS}")
        out.append(rows.agg(F.lit(kind).alias("activity"), F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("sound")))
    return reduce(DataFrame.unionByName, out)


@query(
    "feed_profile",
    """SELECT event_type AS activity, (count(*) + 1 + count(*) FILTER (event_id % 4 = 0))::BIGINT AS lines, count(*)::BIGINT AS rows, 0::BIGINT AS malformed,
       (epoch_us(date_trunc('second', max(ts))) // 1000000 + 5 * 3600)::BIGINT AS newest_epoch, 'ID4;ACTIVIDAD' AS header FROM events GROUP BY 1""",
)
def feed_profile(spark, sf_dir):
    """One file for each type of event, profiled as it lies there."""
    root = _root(spark, "profile")
    rows = _feed(spark, sf_dir).withColumn("part", F.col("ACTIVIDAD")).repartition("part")
    rows.write.partitionBy("part").options(sep=";", header=True, quote='"', escape='"', encoding="UTF-8").csv(root)
    found = delimited.feed_profile(spark, f"{root}/part=*", LPG)
    return found.select(
        F.regexp_extract("file", "part=([a-z]+)", 1).alias("activity"),
        *[F.col(c).cast("long").alias(c) for c in ("lines", "rows", "malformed")],
        F.unix_seconds("newest").alias("newest_epoch"),
        F.substring("header", 1, 13).alias("header"),
    )


@query(
    "harvest_cards",
    """SELECT 'c' || s_suppkey::VARCHAR AS id, s_name AS name, 2::BIGINT AS lines, s_acctbal::DOUBLE AS latitude, s_nationkey::DOUBLE AS longitude
FROM supplier WHERE s_suppkey % 9 <> 0""",
)
def harvest_cards(spark, sf_dir):
    """Suppliers as place cards, one block of cards for each nation; every ninth card has no id."""
    root = _root(spark, "harvest")
    key = F.col("s_suppkey")
    card = F.struct(
        F.when(key % 9 != 0, F.concat(F.lit("c"), key.cast("string"))).otherwise(F.lit("")).alias("id"),
        F.col("s_name").alias("name"),
        F.array(F.lit("Grifo"), F.col("s_name")).alias("info"),
        F.col("s_acctbal").alias("lat"),
        F.col("s_nationkey").cast("double").alias("lng"),
    )
    S.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(card).alias("places")).select("places").write.json(root)
    return places.read_harvest(spark, root).select("id", "name", F.size("info").cast("long").alias("lines"), "latitude", "longitude")


@query(
    "directory_entries",
    """WITH p AS (SELECT s_suppkey AS k, s_name AS n, -12.6 + (s_suppkey % 100) / 90.0::DOUBLE AS y, -77.3 + (s_suppkey % 70) / 90.0::DOUBLE AS x FROM supplier)
SELECT 'primax#' || k::VARCHAR AS entry_key, 'Primax' AS brand, n AS name, '' AS district, round(y, 6)::DOUBLE AS latitude, round(x, 6)::DOUBLE AS longitude
FROM p WHERE y > -12.55 AND y < -11.6 AND x > -77.25 AND x < -76.55
UNION ALL SELECT 'ava#' || k::VARCHAR, 'AVA', n, 'D', round(y, 6)::DOUBLE, round(x, 6)::DOUBLE FROM p WHERE k % 4 <> 0""",
)
def directory_entries(spark, sf_dir):
    """Two directories in their own shapes: one bounded by coordinates, one by its region."""
    key = F.col("s_suppkey")
    rows = S.table(spark, sf_dir, "supplier").select(
        key.alias("entry_index"),
        F.col("s_name").alias("name"),
        F.lit("AV. UNO").alias("address"),
        (F.lit(-12.6) + (key % 100) / F.lit(90.0)).alias("y"),
        (F.lit(-77.3) + (key % 70) / F.lit(90.0)).alias("x"),
    )
    sources = {s.directory: s for s in places.DIRECTORY_SOURCES}
    region = F.when(F.col("entry_index") % 4 != 0, F.lit("Lima")).otherwise(F.lit("Ica"))
    shaped = rows.select(
        "entry_index", F.col("name").alias("nombre"), F.col("address").alias("direccion"), F.lit("D").alias("distrito"), region.alias("departamento"),
        F.lit("LIMA").alias("ciudad"), F.struct(F.col("y").alias("latitud"), F.col("x").alias("longitud")).alias("coordenadas"),
    )
    found = places.directory_entries(rows, sources["primax"]).unionByName(places.directory_entries(shaped, sources["ava"]))
    return found.select("entry_key", "brand", "name", "district", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(
    "version_write",
    "SELECT event_type AS product, count(*)::BIGINT AS rows, 1::BIGINT AS revisions, 0::BIGINT AS problems FROM events GROUP BY 1",
)
def version_write(spark, sf_dir):
    """A version is written, offered again, read back and compared with its manifest."""
    root = _root(spark, "version")
    offers = S.offers(spark, sf_dir)
    revision = versions.write_version(offers, root, "v-", "snap")
    if versions.write_version(offers.orderBy(F.desc("id")), root, "v-", "snap") != revision:
        raise AssertionError("the same content got another revision")
    manifest = versions.read_manifest(spark, root)
    read = versions.read_version(spark, root, revision).withColumn("revision_id", F.lit(revision))
    wrong = versions.manifest_errors(read, manifest).groupBy("product").agg(F.count(F.lit(1)).alias("problems"))
    counted = manifest.groupBy("product").agg(F.max("rows").alias("rows"), F.count_distinct("revision_id").alias("revisions"))
    return counted.join(wrong, "product", "left").select("product", F.col("rows").cast("long").alias("rows"), "revisions", F.coalesce("problems", F.lit(0)).cast("long").alias("problems"))


@query(
    "observation_run",
    """WITH s AS (SELECT event_type AS product, user_id AS site, max(event_id) % 97 + 1 AS price FROM events GROUP BY 1, 2)
SELECT product, DATE '2024-01-30' AS date, round(avg(price), 4)::DOUBLE AS mean, count(*)::BIGINT AS n FROM s GROUP BY 1""",
)
def observation_run(spark, sf_dir):
    """One offer of each user and type is measured, appended twice, and read as the last day of the window."""
    now = datetime(2024, 1, 30, 12)
    e = S.table(spark, sf_dir, "events")
    offers = e.groupBy(F.col("event_type").alias("product"), F.col("user_id").alias("establishment_id")).agg(
        F.min("event_id").cast("string").alias("id"), (F.max("event_id") % 97 + 1).cast("double").alias("price")
    ).withColumns({
        "reported_at": F.lit("2024-01-29 00:00:00").cast("timestamp"),
        "live_price": F.lit(None).cast("double"),
        "live_observed_at": F.lit(None).cast("timestamp"),
    })
    root, types = _root(spark, "observation"), sorted(r["event_type"] for r in e.select("event_type").distinct().collect())  # as many as products
    seen = observe.observation(offers, now, datetime(2024, 1, 29), "rev")
    if observe.append(seen, root, types) != len(types) or observe.append(seen, root, types) != 0:
        raise AssertionError("an observation must be appended once")
    return observe.summary(spark, root, now.date()).where("mean IS NOT NULL").select("product", "date", "mean", "n")


@query(
    "publish_run",
    f"""WITH {STAGED_SQL}
SELECT grp AS "group", product, count(*) FILTER (ready)::BIGINT AS offers, round(sum(price) FILTER (ready), 4)::DOUBLE AS total,
       count(*) FILTER (publishable AND NOT expired)::BIGINT AS fresh_offers FROM staged GROUP BY 1, 2 HAVING count(*) FILTER (ready) > 0""",
)
def publish_run(spark, sf_dir):
    """Select, locate, identify, link and write: the published version, read back, next to the metrics of the run."""
    rules = rules_frame(spark, S.RULES)
    built = publish.build_products(
        S.reports(spark, sf_dir), S.raw_identities(spark, sf_dir), S.registry(spark, sf_dir), S.points(spark, sf_dir), rules,
        cutoff_at=datetime(2024, 1, 28), snapshot_id="s1", names=publish.Namespaces("site", "offer", S.LINK_SCHEME),
    )
    entries = spark.createDataFrame([], "establishment_id string, brand string, public_site_name string, confidence string, link_status string, publication_status string")
    rows = spark.createDataFrame([], "product string, observed_at timestamp, key_hash string, price double")
    offers = publish.compose(built.offers, entries, rows, datetime(2024, 1, 28))
    root = _root(spark, "publish")
    revision = versions.write_version(offers, root, "all-", "s1")
    read = versions.read_version(spark, root, revision).groupBy("group", "product").agg(
        F.count(F.lit(1)).alias("offers"), F.round(F.sum("price"), 4).alias("total")
    )
    return read.join(built.metrics.select("group", "product", "fresh_offers"), ["group", "product"])
