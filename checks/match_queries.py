"""Places (suppliers) matched to sites (customers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from pricewarden.operators import matching
from pricewarden.plans.identity import match_places
from pricewarden.session import cut_lineage

STREETS = ("JAVIER PRADO", "TUPAC AMARU", "UNIVERSITARIA", "LA MARINA", "BENAVIDES")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _places(spark, sf_dir):
    key = F.col("place_id")
    return S.places(spark, sf_dir).select(
        "place_id",
        "latitude",
        "longitude",
        F.concat(F.lit("AV. "), _pick(STREETS, F.col("nation")), F.lit(" "), (key % 50 + 10).cast("string")).alias(
            "place_address"
        ),
        F.concat(F.lit("Grifo "), _pick(SEGMENTS, key)).alias("place_name"),
        F.when(key % 4 == 0, F.lit("Repsol")).alias("place_brand"),
    )


def _sites(spark, sf_dir):
    key = F.col("site_id")
    return S.sites(spark, sf_dir).select(
        "site_id",
        "latitude",
        "longitude",
        F.concat(
            F.lit("Avenida "),
            _pick(STREETS, F.col("district")),
            F.lit(" Nro. "),
            (key % 50 + 10).cast("string"),
            F.lit(", Urb. Sol"),
        ).alias("site_address"),
        F.when(key % 6 == 0, F.lit("REPSOL COMERCIAL")).otherwise(F.concat("segment", F.lit(" SAC"))).alias(
            "legal_name"
        ),
    )


_PAIRS_SQL = f"""
p AS (SELECT s_suppkey AS p, s_nationkey AS pn, {S.PLACE_LAT_SQL} AS plat, {S.PLACE_LON_SQL} AS plon FROM supplier),
s AS (SELECT c_custkey AS s, c_nationkey AS sn, c_mktsegment AS seg, {S.SITE_LAT_SQL} AS slat, {S.SITE_LON_SQL} AS slon
      FROM customer),
pairs AS (SELECT *, {S.distance_sql("plat", "plon", "slat", "slon", 6371000.0)} AS d
          FROM p, s WHERE abs(plat - slat) < 0.002 AND abs(plon - slon) < 0.002),
near AS (SELECT * FROM pairs WHERE d <= 150),
sig AS (SELECT *, CASE WHEN p % 50 = s % 50 THEN 50 ELSE 0 END AS door,
               CASE WHEN pn % 5 = sn % 5 THEN CASE WHEN pn % 5 < 2 THEN 20 ELSE 8 END ELSE 0 END AS street,
               CASE WHEN s % 6 <> 0 AND seg = ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][(p % 5 + 1)::INTEGER]
                    THEN 45 ELSE 0 END AS nam,
               CASE WHEN p % 4 = 0 AND s % 6 = 0 THEN 25 ELSE 0 END AS brand FROM near),
scored AS (SELECT *, greatest(0, 100 - d / 2) + door + street + nam + brand AS score,
                  greatest(door, street, nam, brand) >= 25 AS confirmed FROM sig)
"""


@query(
    "spatial_pairs",
    f"""WITH {_PAIRS_SQL}
SELECT p::BIGINT AS place_id, s::BIGINT AS site_id, round(d, 6)::DOUBLE AS distance_m FROM near""",
)
def spatial_pairs(spark, sf_dir):
    found = matching.spatial_pairs(
        _places(spark, sf_dir).select("place_id", "latitude", "longitude"),
        _sites(spark, sf_dir).select("site_id", "latitude", "longitude"),
    )
    return found.select("place_id", "site_id", F.round("distance_m", 6).alias("distance_m"))


@query(
    "neighbour_count",
    f"""WITH s AS (SELECT c_custkey AS s, {S.SITE_LAT_SQL} AS lat, {S.SITE_LON_SQL} AS lon FROM customer)
SELECT a.s::BIGINT AS site_id, count(*)::BIGINT AS neighbours FROM s a, s b
WHERE abs(a.lat - b.lat) < 0.006 AND abs(a.lon - b.lon) < 0.006
  AND {S.distance_sql("a.lat", "a.lon", "b.lat", "b.lon", 6371000.0)} <= 500 GROUP BY 1""",
)
def neighbour_count(spark, sf_dir):
    return matching.neighbour_counts(S.sites(spark, sf_dir), 500.0)


def _scored(spark, sf_dir):
    return matching.scored_pairs(_places(spark, sf_dir), _sites(spark, sf_dir))


@query(
    "pair_scores",
    f"""WITH {_PAIRS_SQL}
SELECT p::BIGINT AS place_id, s::BIGINT AS site_id, door::INTEGER AS door_weight, street::INTEGER AS street_weight,
       nam::INTEGER AS name_weight, brand::INTEGER AS brand_weight, round(score, 6)::DOUBLE AS score, confirmed FROM scored""",
)
def pair_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "place_id",
        "site_id",
        "door_weight",
        "street_weight",
        "name_weight",
        "brand_weight",
        F.round("score", 6).alias("score"),
        "confirmed",
    )


_GREEDY_SQL = f"""
WITH RECURSIVE {_PAIRS_SQL},
ord AS (SELECT *, row_number() OVER (ORDER BY score DESC, d, p, s) AS i FROM scored),
walk(i, tp, ts, p, s, took) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, FALSE
  UNION ALL
  SELECT o.i, CASE WHEN list_contains(w.tp, o.p) OR list_contains(w.ts, o.s) THEN w.tp ELSE list_append(w.tp, o.p) END,
         CASE WHEN list_contains(w.tp, o.p) OR list_contains(w.ts, o.s) THEN w.ts ELSE list_append(w.ts, o.s) END,
         o.p, o.s, NOT (list_contains(w.tp, o.p) OR list_contains(w.ts, o.s))
  FROM walk w JOIN ord o ON o.i = w.i + 1),
taken AS (SELECT i, p, s FROM walk WHERE took)
"""


@query("match_assign", f"{_GREEDY_SQL} SELECT p::BIGINT AS place_id, s::BIGINT AS site_id FROM taken")
def match_assign(spark, sf_dir):
    return _taken(spark, sf_dir).select("place_id", "site_id")


def _taken(spark, sf_dir):
    places, sites = matching.place_features(_places(spark, sf_dir)), matching.site_features(_sites(spark, sf_dir))
    return matching.assign_nearby(cut_lineage(places), cut_lineage(sites))[0]


def _matches(spark, sf_dir):
    return match_places(_places(spark, sf_dir), _sites(spark, sf_dir))


@query(
    "match_status",
    f"""{_GREEDY_SQL},
rival AS (SELECT t.p, min(o.d) AS rd FROM taken t JOIN ord o ON o.p = t.p AND o.s <> t.s AND o.d <= 80
          LEFT JOIN taken u ON u.s = o.s WHERE u.i IS NULL OR u.i > t.i GROUP BY 1),
m AS (SELECT o.p, o.s, o.d, o.confirmed, r.rd - o.d AS margin FROM taken t JOIN ord o ON o.i = t.i
      LEFT JOIN rival r ON r.p = t.p)
SELECT p::BIGINT AS place_id, s::BIGINT AS site_id, round(margin, 6)::DOUBLE AS margin_m,
       CASE WHEN d <= 80 AND confirmed AND (margin IS NULL OR margin >= 100) THEN 'verified'
            WHEN margin < 100 THEN 'conflict' ELSE 'candidate' END AS status FROM m""",
)
def match_status(spark, sf_dir):
    return _matches(spark, sf_dir).select(
        "place_id", "site_id", F.round("margin_m", 6).alias("margin_m"), "status"
    )


@query(
    "unmatched_sites",
    f"""{_GREEDY_SQL} SELECT c_custkey::BIGINT AS site_id FROM customer WHERE c_custkey NOT IN (SELECT s FROM taken)""",
)
def unmatched_sites(spark, sf_dir):
    taken = _taken(spark, sf_dir)
    return matching.unmatched(S.sites(spark, sf_dir).select("site_id"), taken, "site_id")


@query(
    "last_wins",
    """SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INTEGER AS l_linenumber,
       max(l_partkey)::BIGINT AS l_partkey FROM lineitem GROUP BY 1, 2""",
)
def last_wins(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return matching.last_wins(rows, ["l_orderkey", "l_linenumber"], "l_partkey")
