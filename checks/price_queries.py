"""Effective prices, site rows and result lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import standins as S
from checks.registry import query
from pricewarden.operators import listing, pricing
from pricewarden.operators.listing import Origin
from pricewarden.plans import search

NOW = datetime(2024, 1, 30, 12)
CUTOFF = datetime(2024, 1, 28)
HERE = Origin(-12.36, -77.17)

EFFECTIVE_SQL = (
    S.OFFERS_SQL
    + """,
aged AS (SELECT *, epoch_us(TIMESTAMP '2024-01-30 12:00:00') AS now_us, epoch_us(reported_at) AS rep_us,
                epoch_us(live_observed_at) AS obs_us,
                CASE WHEN price > 0 THEN (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(reported_at))
                     / 86400000000.0::DOUBLE END AS csv_age,
                (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(live_observed_at)) / 86400000000.0::DOUBLE AS live_age
         FROM off),
judged AS (SELECT *, coalesce(csv_age BETWEEN 0 AND 30, FALSE) AS csv_ok,
                  coalesce(live_age >= 0 AND live_age * 24 <= 24, FALSE) AS live_ok FROM aged),
chosen AS (SELECT *, CASE WHEN csv_ok AND coalesce(rep_us > obs_us, FALSE) THEN 'csv_posterior_a_la_consulta'
                          WHEN live_ok THEN 'consulta_vigente' WHEN csv_ok THEN 'reporte_vigente'
                          WHEN csv_age < 0 THEN 'reporte_futuro' WHEN csv_age IS NOT NULL THEN 'reporte_vencido'
                          ELSE 'sin_precio_utilizable' END AS reason FROM judged),
priced AS (SELECT *, CASE WHEN reason = 'consulta_vigente' THEN 'live'
                          WHEN reason IN ('csv_posterior_a_la_consulta', 'reporte_vigente') THEN 'csv' END AS source,
                  (now_us - rep_us) / 86400000000.0::DOUBLE AS reported_age FROM chosen),
evaluated AS (SELECT *, CASE source WHEN 'live' THEN live_price WHEN 'csv' THEN price END AS eff_price,
                     CASE source WHEN 'live' THEN obs_us WHEN 'csv' THEN rep_us END AS eff_us,
                     CASE source WHEN 'live' THEN live_age WHEN 'csv' THEN csv_age END AS eff_age,
                     CASE WHEN source IS NOT NULL THEN 'fresh' WHEN reported_age > 30 THEN 'expired'
                          ELSE 'hidden' END AS state FROM priced)
"""
)


@query(
    "effective_price",
    f"""WITH {EFFECTIVE_SQL}
SELECT id::BIGINT AS id, eff_price::DOUBLE AS price, source, eff_us::BIGINT AS at_us, round(eff_age, 6)::DOUBLE AS age_days,
       reason FROM evaluated""",
)
def effective_price(spark, sf_dir):
    return pricing.effective_price(S.offers(spark, sf_dir), NOW).select(
        "id",
        F.col("effective_price").alias("price"),
        F.col("price_source").alias("source"),
        F.unix_micros("price_at").alias("at_us"),
        F.round("age_days", 6).alias("age_days"),
        F.col("price_reason").alias("reason"),
    )


@query(
    "fresh_expired",
    f"""WITH {EFFECTIVE_SQL}
SELECT id::BIGINT AS id, state, coalesce(eff_price, price)::DOUBLE AS price, source AS price_source,
       round(coalesce(eff_age, reported_age), 6)::DOUBLE AS age_days, round(reported_age, 6)::DOUBLE AS reported_age_days
FROM evaluated WHERE state <> 'hidden'""",
)
def fresh_expired(spark, sf_dir):
    rows = pricing.evaluate(S.offers(spark, sf_dir), NOW, CUTOFF)
    return rows.select(
        "id",
        "state",
        "price",
        "price_source",
        F.round("age_days", 6).alias("age_days"),
        F.round("reported_age_days", 6).alias("reported_age_days"),
    )


@query(
    "next_change",
    f"""WITH {EFFECTIVE_SQL},
due AS (SELECT CASE WHEN source = 'live' AND obs_us + 86400000000 > now_us THEN obs_us + 86400000000 END AS a,
               CASE WHEN rep_us <= now_us AND rep_us + 30 * 86400000000 > now_us THEN rep_us + 30 * 86400000000 END AS b
        FROM evaluated)
SELECT CASE WHEN min(a) IS NULL THEN min(b) WHEN min(b) IS NULL THEN min(a) WHEN min(a) < min(b) THEN min(a)
            ELSE min(b) END::BIGINT AS refresh_us FROM due""",
)
def next_change(spark, sf_dir):
    return pricing.next_change(S.offers(spark, sf_dir), NOW, CUTOFF).select(
        F.unix_micros("refresh_at").alias("refresh_us")
    )


@query(
    "effective_source_counts",
    f"""WITH {EFFECTIVE_SQL}
SELECT product, coalesce(source, 'none') AS source, count(*)::BIGINT AS n FROM evaluated GROUP BY 1, 2""",
)
def effective_source_counts(spark, sf_dir):
    return pricing.effective_source_counts(S.offers(spark, sf_dir), ["product"], NOW, CUTOFF)


SITES_SQL = (
    EFFECTIVE_SQL
    + f""",
located AS (SELECT e.*, c_name AS site_name, c_nationkey AS district, {S.SITE_LAT_SQL} AS latitude,
                   {S.SITE_LON_SQL} AS longitude,
                   list_position(['click', 'error', 'purchase', 'signup', 'view'], product) AS pos
            FROM evaluated e JOIN customer ON c_custkey = site_id WHERE state <> 'hidden'),
prices AS (SELECT site_id, product, arg_max(eff_price, id) AS price FROM located WHERE state = 'fresh' GROUP BY 1, 2),
site AS (SELECT l.site_id, any_value(site_name) AS site_name, any_value(district) AS district,
                any_value(latitude) AS latitude, any_value(longitude) AS longitude,
                min(eff_age) AS age_days,
                arg_min(source, (eff_age, pos, id)) FILTER (state = 'fresh') AS age_source,
                min(reported_age) AS silent_days, max(rep_us) AS last_reported_us, max(obs_us) AS last_observed_us,
                bool_or(state = 'fresh') AS has_price
         FROM located l GROUP BY l.site_id),
rows AS (SELECT s.*, p1.price AS price_click, p2.price AS price_error, p3.price AS price_purchase,
                p4.price AS price_signup, p5.price AS price_view
         FROM site s LEFT JOIN prices p1 ON p1.site_id = s.site_id AND p1.product = 'click'
         LEFT JOIN prices p2 ON p2.site_id = s.site_id AND p2.product = 'error'
         LEFT JOIN prices p3 ON p3.site_id = s.site_id AND p3.product = 'purchase'
         LEFT JOIN prices p4 ON p4.site_id = s.site_id AND p4.product = 'signup'
         LEFT JOIN prices p5 ON p5.site_id = s.site_id AND p5.product = 'view')
"""
)


def _rows(spark, sf_dir):
    return search.site_table(S.located_offers(spark, sf_dir), S.PRODUCTS, NOW, CUTOFF)


@query(
    "site_rows",
    f"""WITH {SITES_SQL}
SELECT site_id::BIGINT AS site_id, site_name, district::INTEGER AS district, price_click::DOUBLE AS price_click,
       price_error::DOUBLE AS price_error, price_purchase::DOUBLE AS price_purchase,
       price_signup::DOUBLE AS price_signup, price_view::DOUBLE AS price_view, round(age_days, 6)::DOUBLE AS age_days,
       age_source, round(silent_days, 6)::DOUBLE AS silent_days, last_reported_us::BIGINT AS last_reported_us,
       last_observed_us::BIGINT AS last_observed_us, has_price FROM rows""",
)
def site_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "site_id",
        "site_name",
        "district",
        *[F.col(f"price_{p}")["price"].alias(f"price_{p}") for p in S.PRODUCTS],
        F.round("age_days", 6).alias("age_days"),
        "age_source",
        F.round("silent_days", 6).alias("silent_days"),
        F.unix_micros("last_reported_at").alias("last_reported_us"),
        F.unix_micros("last_observed_at").alias("last_observed_us"),
        "has_price",
    )


_HERE_SQL = S.distance_sql("-12.36::DOUBLE", "-77.17::DOUBLE", "latitude", "longitude")


@query(
    "result_page",
    f"""WITH {SITES_SQL},
far AS (SELECT *, {_HERE_SQL} AS km FROM rows),
pool AS (SELECT *, count(*) OVER () AS total FROM far WHERE km <= 3.5),
ranked AS (SELECT *, row_number() OVER (ORDER BY price_click NULLS LAST, site_id) AS rank FROM pool),
page AS (SELECT *, CASE WHEN total - least(6, total) <= 4 THEN total ELSE 6 END AS size FROM ranked),
items AS (SELECT *, count(*) FILTER (has_price) OVER () AS comparable FROM page WHERE rank <= size),
best AS (SELECT site_id FROM pool WHERE price_click IS NOT NULL ORDER BY price_click, km, site_id LIMIT 1),
near AS (SELECT site_id FROM pool ORDER BY km, site_id LIMIT 1)
SELECT site_id::BIGINT AS site_id, price_click::DOUBLE AS price, round(km, 6)::DOUBLE AS distance_km,
       comparable > 1 AND coalesce(site_id = (SELECT site_id FROM best), FALSE) AS cheapest,
       comparable > 1 AND coalesce(site_id = (SELECT site_id FROM best), FALSE)
         AND (SELECT site_id FROM best) = (SELECT site_id FROM near) AS also_nearest,
       total::BIGINT AS total FROM items""",
)
def result_page(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    found = search.run(rows, search.Search(S.PRODUCTS, "click", HERE, radius_km=3.5, sort="price"))
    return found.items.select(
        "site_id",
        F.col("price_click")["price"].alias("price"),
        F.round("distance_km", 6).alias("distance_km"),
        "cheapest",
        "also_nearest",
        F.lit(found.summary["total"]).cast("long").alias("total"),
    )


@query(
    "district_page",
    f"""WITH {SITES_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY price_view NULLS LAST, site_id) AS rank, count(*) OVER () AS total
           FROM rows WHERE district = 3)
SELECT rank::INTEGER AS rank, site_id::BIGINT AS site_id, price_view::DOUBLE AS price FROM ranked
WHERE rank <= CASE WHEN total - least(6, total) <= 4 THEN total ELSE 6 END""",
)
def district_page(spark, sf_dir):
    found = search.run(_rows(spark, sf_dir), search.Search(S.PRODUCTS, "view", district=3))
    page = found.items.select("site_id", F.col("price_view")["price"].alias("price"))
    # The page is at most ten rows, so numbering it in one task is bounded.
    order = F.struct(F.col("price").isNull(), F.col("price"), F.col("site_id"))
    rows = page.agg(F.array_sort(F.collect_list(order)).alias("r")).select(F.posexplode("r").alias("pos", "row"))
    return rows.select(
        (F.col("pos") + 1).alias("rank"), F.col("row.site_id").alias("site_id"), F.col("row.price").alias("price")
    )


# --- lists straight over the site table ---------------------------------------------------------

_SITE_KM = S.distance_sql("-12.36::DOUBLE", "-77.17::DOUBLE", S.SITE_LAT_SQL, S.SITE_LON_SQL)


def _priced_sites(spark, sf_dir):
    price = F.when(F.col("acctbal") > 0, F.col("acctbal"))
    return S.sites(spark, sf_dir).withColumns({"price": price, "has_price": price.isNotNull()})


@query(
    "nearby_topk",
    f"""SELECT c_custkey::BIGINT AS site_id, round({_SITE_KM}, 6)::DOUBLE AS distance_km FROM customer
ORDER BY {_SITE_KM}, c_custkey LIMIT 6""",
)
def nearby_topk(spark, sf_dir):
    located = listing.with_distance(S.sites(spark, sf_dir).select("site_id", "latitude", "longitude"), HERE)
    page = located.orderBy(*listing.order_keys("distance")).limit(listing.PAGE_SIZE)
    return page.select("site_id", F.round("distance_km", 6).alias("distance_km"))


@query(
    "within_radius",
    f"""SELECT c_custkey::BIGINT AS site_id, round({_SITE_KM}, 6)::DOUBLE AS distance_km FROM customer
WHERE {_SITE_KM} <= 3.5""",
)
def within_radius(spark, sf_dir):
    near = listing.within_radius(S.sites(spark, sf_dir).select("site_id", "latitude", "longitude"), HERE, 3.5)
    return near.select("site_id", F.round("distance_km", 6).alias("distance_km"))


@query(
    "radius_order",
    f"""WITH pool AS (SELECT c_custkey AS site_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price
                     FROM customer WHERE {_SITE_KM} <= 1)
SELECT site_id::BIGINT AS site_id, price::DOUBLE AS price,
       lag(site_id) OVER (ORDER BY price NULLS LAST, site_id)::BIGINT AS after_site FROM pool""",
)
def radius_order(spark, sf_dir):
    """The price order itself, as each row's predecessor."""
    near = listing.within_radius(_priced_sites(spark, sf_dir), HERE, 1.0)
    return listing.predecessors(near.select("site_id", "price"), listing.order_keys("price", F.col("price")), "site_id")


@query(
    "initial_radius",
    f"""WITH near AS (SELECT {_SITE_KM} AS km FROM customer WHERE c_acctbal > 0 ORDER BY 1 LIMIT 6)
SELECT least(5.0, greatest(1.0, round(ceil(CASE WHEN count(*) >= 6 THEN max(km) ELSE 5 END / 0.5) * 0.5, 1)))::DOUBLE
         AS radius_km FROM near""",
)
def initial_radius(spark, sf_dir):
    return listing.initial_radius(listing.with_distance(_priced_sites(spark, sf_dir).where("has_price"), HERE))


@query(
    "radius_inert",
    f"""SELECT count(*) FILTER ({_SITE_KM} <= 1)::BIGINT AS near, count(*) FILTER ({_SITE_KM} <= 5)::BIGINT AS far,
       count(*) FILTER ({_SITE_KM} <= 1) = count(*) FILTER ({_SITE_KM} <= 5) AS inert FROM customer""",
)
def radius_inert(spark, sf_dir):
    return listing.radius_is_inert(listing.with_distance(S.sites(spark, sf_dir), HERE))


@query("district_list", "SELECT DISTINCT c_nationkey::INTEGER AS district FROM customer")
def district_list(spark, sf_dir):
    return listing.districts(S.sites(spark, sf_dir))


@query(
    "cheapest_tag",
    f"""WITH pool AS (SELECT c_custkey AS site_id, c_acctbal AS price, {_SITE_KM} AS km FROM customer
                     WHERE {_SITE_KM} <= 3.5),
best AS (SELECT * FROM pool WHERE price > 0 ORDER BY price, km, site_id LIMIT 1)
SELECT site_id::BIGINT AS site_id, price::DOUBLE AS price, round(km, 6)::DOUBLE AS distance_km,
       site_id = (SELECT site_id FROM pool ORDER BY km, site_id LIMIT 1) AS also_nearest FROM best""",
)
def cheapest_tag(spark, sf_dir):
    pool = listing.within_radius(_priced_sites(spark, sf_dir), HERE, 3.5)
    tag = listing.cheapest_tag(pool, F.col("price"))
    return tag.withColumn("distance_km", F.round("distance_km", 6))


@query(
    "merged_cutoff",
    """SELECT epoch(min(m))::BIGINT AS cutoff_epoch, CASE WHEN bool_or(n % 2 = 0) THEN 'saved' ELSE 'network' END AS data_mode
FROM (SELECT event_type, max(date_trunc('second', ts)) AS m, count(*) AS n FROM events GROUP BY 1)""",
)
def merged_cutoff(spark, sf_dir):
    mode = F.when(F.count(F.lit(1)) % 2 == 0, F.lit("saved")).otherwise(F.lit("network"))
    loaded = (
        S.table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.max(F.date_trunc("second", "ts")).alias("cutoff_at"), mode.alias("data_mode"))
    )
    return listing.merged_cutoff(loaded).select(F.unix_seconds("cutoff_at").alias("cutoff_epoch"), "data_mode")


# --- versions -----------------------------------------------------------------------------------

_VERSIONS_SQL = """
c AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS live_price
      FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN
             CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END END AS live_price,
             CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS seen
      FROM orders WHERE o_orderstatus <> 'O'),
d AS (SELECT coalesce(c.id, p.id) AS id, p.live_price AS old_price, c.live_price AS new_price, p.seen,
             p.id IS NOT NULL AS was_published,
             CASE WHEN c.id IS NULL THEN 'removed' WHEN p.live_price IS NOT DISTINCT FROM c.live_price THEN 'same'
                  WHEN p.live_price IS NULL THEN 'appears' WHEN c.live_price IS NULL THEN 'disappears'
                  ELSE 'changed' END AS change
      FROM c FULL JOIN p ON c.id = p.id)
"""


def _diff(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    low, plain = F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority") == "4-NOT SPECIFIED"
    candidate = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.when(~low, F.col("o_totalprice")).alias("live_price")
    )
    older = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    published = o.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("id"),
        F.when(~plain, older).alias("live_price"),
        F.when(~plain, F.col("o_orderdate")).alias("live_observed_at"),
    )
    return pricing.version_diff(candidate, published)


@query(
    "version_diff",
    f"""WITH {_VERSIONS_SQL}
SELECT id::BIGINT AS id, old_price::DOUBLE AS old_price, new_price::DOUBLE AS new_price, was_published, change
FROM d WHERE change <> 'same'""",
)
def version_diff(spark, sf_dir):
    return _diff(spark, sf_dir).where("change <> 'same'").drop("live_observed_at")


@query(
    "republish",
    f"""WITH {_VERSIONS_SQL},
t AS (SELECT count(*) FILTER (was_published) AS published, count(*) FILTER (change <> 'removed') AS candidates,
             count(*) FILTER (change <> 'same') AS changed, min(seen) AS oldest FROM d)
SELECT published = 0 OR changed > 0 OR coalesce(oldest < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 18 HOURS, FALSE)
         AS visible,
       CASE WHEN published = 0 THEN 'nothing_published' WHEN changed > 0 THEN 'effective_price_changes'
            WHEN oldest < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 18 HOURS THEN 'published_capture_ages'
            ELSE 'unchanged' END AS reason,
       CASE WHEN published = 0 THEN candidates ELSE changed END::BIGINT AS changed_offers FROM t""",
)
def republish(spark, sf_dir):
    return pricing.republish_decision(_diff(spark, sf_dir), NOW)
