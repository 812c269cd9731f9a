"""The given tables seen as the shapes the operators read. Plain projections, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewarden.config import GALLONS, ProductRule
from pricewarden.session import prepare

PRODUCTS = ("click", "error", "purchase", "signup", "view")
CUTOFF = "2024-01-28 00:00:00"
LINK_SCHEME = "link-v1"
SCOPE = {"department": "D", "province": "P"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str, dealt: bool = True) -> DataFrame:
    """Whole texts, as they lie in the table or, for queries that group them by it, dealt out by the first column."""
    found = table(spark, sf_dir, "documents").select(*columns)
    return found.repartition(columns[0]) if dealt else found


def cutoff():
    return F.lit(CUTOFF).cast("timestamp")


def territory():
    return F.pmod(F.col("user_id") + (F.col("event_id") % 11 == 0).cast("int"), F.lit(7))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price reports: one event is one report of a user's price for an event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("activity"),
        F.col("user_id").alias("registration"),
        F.when(F.col("event_id") % 13 == 0, F.lit("X")).otherwise(F.lit("D")).alias("department"),
        F.lit("P").alias("province"),
        territory().alias("district"),
        F.date_trunc("day", "ts").alias("reported_at"),
        F.col("value").alias("price"),
        F.when(F.col("event_id") % 2 == 0, F.lit("EVEN")).otherwise(F.lit("ODD")).alias("product_name"),
        F.when(F.col("event_id") % 17 == 0, F.lit("Kilos")).otherwise(F.lit(GALLONS)).alias("unit"),
        F.when(F.col("event_id") % 5 == 0, F.lit("trade")).otherwise(F.lit("final")).alias("client_type"),
    )


# Two groups over the same feed: different products, activities, client rule and layers.
RULES = (
    ProductRule(
        "north",
        "even",
        "EVEN",
        GALLONS,
        {"click": "01", "view": "02", "purchase": "02"},
        layers={"01": "35", "02": "36"},
        department="D",
        province="P",
    ),
    ProductRule(
        "south",
        "odd",
        "ODD",
        GALLONS,
        {"click": "01", "error": "03", "signup": "03"},
        client_type="final",
        department="D",
        province="P",
    ),
)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences: a customer holds one per code; keys that are also nation keys are listed twice."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("registration"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("registration"))
    codes = F.explode(F.array(F.lit("01"), F.lit("02"), F.lit("03")))
    listed = c.select(codes.alias("code"), "registration").unionByName(
        n.select(F.lit("02").alias("code"), "registration")
    )
    key = F.col("registration")
    return listed.select(
        "code",
        "registration",
        F.when(key % 11 == 0, F.lit("X")).otherwise(F.lit("D")).alias("department"),
        F.lit("P").alias("province"),
        F.pmod(key + (key % 6 == 0).cast("int"), F.lit(7)).alias("district"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two layers; some lie outside the published box, region keys occur twice in a layer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("registration"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("registration"))
    listed = c.select(F.explode(F.array(F.lit("35"), F.lit("36"))).alias("layer"), "registration").unionByName(
        r.select(F.lit("35").alias("layer"), "registration")
    )
    key = F.col("registration")
    return listed.select(
        "layer",
        "registration",
        F.lit("D").alias("department"),
        F.lit("P").alias("province"),
        F.pmod(key + (key % 10 == 9).cast("int"), F.lit(7)).alias("district"),
        F.when(key % 8 == 5, F.lit(-60.0)).otherwise(F.lit(-77.2) + (key * 91 % 1009) * F.lit(0.00006)).alias(
            "longitude"
        ),
        (F.lit(-12.4) + (key * 37 % 997) * F.lit(0.00008)).alias("latitude"),
    )


def raw_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private columns per report id. Orders stand in; some ids occur twice, some names are empty."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        (key - ((key > 0) & (key % 23 == 0)).cast("int")).alias("id"),
        F.when(key % 19 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("legal_name"),
        F.col("o_orderstatus").alias("address"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("site_id"),
        F.col("c_name").alias("site_name"),
        F.col("c_nationkey").alias("district"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"),
        (F.lit(-12.4) + (F.col("c_custkey") * 37 % 997) * F.lit(0.00008)).alias("latitude"),
        (F.lit(-77.2) + (F.col("c_custkey") * 91 % 1009) * F.lit(0.00006)).alias("longitude"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("place_id"),
        F.col("s_name").alias("place_name"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("acctbal"),
        (F.lit(-12.4) + ((k * 370 + 5) % 997) * F.lit(0.00008) + (k % 9) * F.lit(0.0001)).alias("latitude"),
        (F.lit(-77.2) + ((k * 910 + 3) % 1009) * F.lit(0.00006)).alias("longitude"),
    )


AS_OF = "2024-01-30 12:00:00"
# Fixed stand-in geometry, shared by the SQL twins.
SITE_LAT_SQL = "(-12.4::DOUBLE + ((c_custkey * 37) % 997) * 0.00008::DOUBLE)"
SITE_LON_SQL = "(-77.2::DOUBLE + ((c_custkey * 91) % 1009) * 0.00006::DOUBLE)"
PLACE_LAT_SQL = "(-12.4::DOUBLE + ((s_suppkey * 370 + 5) % 997) * 0.00008::DOUBLE + (s_suppkey % 9) * 0.0001::DOUBLE)"
PLACE_LON_SQL = "(-77.2::DOUBLE + ((s_suppkey * 910 + 3) % 1009) * 0.00006::DOUBLE)"


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371.0088) -> str:
    return (
        f"(2 * {radius} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


OFFERS_SQL = """
off AS (SELECT event_id AS id, user_id AS site_id, event_type AS product,
               CASE WHEN event_id % 29 = 0 THEN 0.0::DOUBLE ELSE value::DOUBLE END AS price,
               ts - to_days((event_id % 37)::INTEGER) AS reported_at,
               CASE WHEN event_id % 3 <> 0 THEN (value + 0.5)::DOUBLE END AS live_price,
               CASE WHEN event_id % 3 <> 0 THEN ts + to_hours((event_id % 41)::INTEGER) END AS live_observed_at
        FROM events)
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with a reported price up to 36 days old and, for two thirds, a price seen live."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    seen = key % 3 != 0
    return e.select(
        key.alias("id"),
        F.col("user_id").alias("site_id"),
        F.col("event_type").alias("product"),
        F.when(key % 29 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("price"),
        (F.col("ts") - F.make_dt_interval(days=(key % 37).cast("int"))).cast("timestamp").alias("reported_at"),
        F.when(seen, F.col("value") + 0.5).alias("live_price"),
        F.when(seen, F.col("ts") + F.make_dt_interval(hours=(key % 41).cast("int")))
        .cast("timestamp")
        .alias("live_observed_at"),
    )


def located_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = sites(spark, sf_dir).select("site_id", "site_name", "district", "latitude", "longitude")
    return offers(spark, sf_dir).join(site, "site_id")
