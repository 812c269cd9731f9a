"""Daily history over the events table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from checks import standins as S
from checks.price_queries import CUTOFF, EFFECTIVE_SQL, NOW
from checks.registry import query
from pricewarden.operators import history

TODAY = date(2024, 1, 30)
LOCAL_SQL = "CAST(ts - INTERVAL 5 HOURS AS DATE)"


@query(
    "daily_mean",
    f"""WITH {EFFECTIVE_SQL},
fresh AS (SELECT *, first_value(eff_price) OVER w AS p0, first_value(rep_us) OVER w AS r0,
                 row_number() OVER w AS rn
          FROM evaluated WHERE state = 'fresh' WINDOW w AS (PARTITION BY product, site_id ORDER BY id)),
site AS (SELECT product, site_id, any_value(p0) AS price, count(*) FILTER (eff_price = p0 AND rep_us = r0) - 1 AS dup,
                count(*) FILTER (NOT (eff_price = p0 AND rep_us = r0)) AS bad FROM fresh GROUP BY 1, 2)
SELECT product, CASE WHEN sum(bad) = 0 THEN round(avg(price), 4)::DOUBLE END AS mean, count(*)::BIGINT AS n, sum(dup)::BIGINT AS duplicates_ignored,
       sum(bad)::BIGINT AS contradictions, 0::BIGINT AS problems,
       CASE WHEN sum(bad) > 0 THEN 'invalid' ELSE 'ok' END AS status FROM site GROUP BY 1""",
)
def daily_mean(spark, sf_dir):
    return history.measure(S.offers(spark, sf_dir), NOW, CUTOFF)


_STATES_SQL = """
o AS (SELECT event_id, event_type AS product, user_id AS site, user_id % 40 + 1 AS price,
             event_type = 'error' AND user_id % 9 = 0 AND event_id % 2 = 0 AS other, event_type = 'click' AND event_id % 5 = 0 AS lost FROM events),
s AS (SELECT product, site, arg_min(price + other::INT, event_id) AS price,
             count(*) AS n,
             arg_min(other::INT, event_id) AS first_other, count(*) FILTER (other) AS n_other
      FROM o WHERE NOT lost AND product <> 'signup' GROUP BY 1, 2),
v AS (SELECT product, sum(CASE WHEN first_other = 1 THEN n_other ELSE n - n_other END - 1) AS dup,
             sum(CASE WHEN first_other = 1 THEN n - n_other ELSE n_other END) AS bad, avg(price) AS mean, count(*) AS sites FROM s GROUP BY 1)
"""


@query(
    "daily_mean_states",
    f"""WITH {_STATES_SQL}
SELECT t.product, CASE WHEN bad = 0 THEN round(mean, 4) END::DOUBLE AS mean, coalesce(sites, 0)::BIGINT AS n, coalesce(dup, 0)::BIGINT AS duplicates_ignored,
       coalesce(bad, 0)::BIGINT AS contradictions, t.problems::BIGINT AS problems,
       CASE WHEN bad > 0 THEN 'invalid' WHEN bad IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT product, count(*) FILTER (lost) AS problems FROM o GROUP BY 1) t LEFT JOIN v ON v.product = t.product
UNION ALL SELECT DISTINCT product || '!', NULL::DOUBLE, 0, 0, 0, 0, 'blocked' FROM o""",
)
def daily_mean_states(spark, sf_dir):
    """Sites that repeat one price, some that contradict it, offers without a site, a product of old reports alone, a clock gone back."""
    e = S.table(spark, sf_dir, "events")
    user, key, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    price = user % 40 + 1 + ((kind == "error") & (user % 9 == 0) & (key % 2 == 0)).cast("int")
    offers = e.select(
        key.alias("id"),
        F.when((kind != "click") | (key % 5 != 0), user).alias("site_id"),
        kind.alias("product"),
        price.cast("double").alias("price"),
        F.when(kind == "signup", F.lit("2023-11-01 00:00:00")).otherwise(F.lit("2024-01-20 00:00:00")).cast("timestamp").alias("reported_at"),
        F.lit(None).cast("double").alias("live_price"),
        F.lit(None).cast("timestamp").alias("live_observed_at"),
    )
    before = offers.withColumn("product", F.concat("product", F.lit("!")))
    return history.measure(offers, NOW, CUTOFF).unionByName(history.measure(before, CUTOFF - timedelta(days=1), CUTOFF))


def _observations(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("product"),
        F.col("event_id").alias("observation_id"),
        F.col("ts").alias("observed_at"),
        "value",
    )


@query(
    "last_of_day",
    f"""WITH o AS (SELECT *, {LOCAL_SQL} AS d,
                         row_number() OVER (PARTITION BY event_type, {LOCAL_SQL} ORDER BY ts DESC, event_id DESC) AS r
                  FROM events)
SELECT event_type AS product, d AS local_date, event_id::BIGINT AS observation_id, epoch_us(ts)::BIGINT AS observed_us,
       value::DOUBLE AS value FROM o WHERE r = 1""",
)
def last_of_day(spark, sf_dir):
    last = history.last_of_day(_observations(spark, sf_dir), ["product"], "observation_id")
    return last.withColumn("observed_us", F.unix_micros("observed_at")).drop("observed_at")


# A user reports a type on some days only, so every series has gaps.
_DAILY_SQL = f"""
daily AS (SELECT event_type || '-' || user_id::VARCHAR AS product, {LOCAL_SQL} AS date, avg(value) AS mean, count(*) AS n, max(ts) AS observed_at,
                 max(event_id) AS observation_id
          FROM events GROUP BY 1, 2),
spine AS (SELECT p.product, d.date, x.mean, x.n, x.observed_at, x.observation_id
          FROM (SELECT DISTINCT product FROM daily) p
          CROSS JOIN (SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) d
          LEFT JOIN daily x ON x.product = p.product AND x.date = d.date),
framed AS (SELECT * FROM spine WHERE date > DATE '2024-01-30' - 21)
"""


def _series():
    return F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("product")


def _daily(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return e.groupBy(_series(), history.local_date(F.col("ts")).alias("date")).agg(
        F.avg("value").alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("observed_at"),
        F.max("event_id").alias("observation_id"),
    )


def _spine(spark, sf_dir):
    return history.daily_spine(_daily(spark, sf_dir), ["product"], TODAY)


def _framed(spark, sf_dir):
    return history.frame_window(_spine(spark, sf_dir), TODAY, 21)


@query(
    "daily_spine",
    f"""WITH {_DAILY_SQL}
SELECT product, date, round(mean, 6)::DOUBLE AS mean, n::BIGINT AS n FROM spine""",
)
def daily_spine(spark, sf_dir):
    return _spine(spark, sf_dir).select("product", "date", F.round("mean", 6).alias("mean"), "n")


@query(
    "frame_window",
    f"""WITH {_DAILY_SQL}
SELECT product, date, round(mean, 6)::DOUBLE AS mean, n::BIGINT AS n, (date - DATE '2024-01-10')::INTEGER AS index,
       date = DATE '2024-01-30' AS is_today FROM framed""",
)
def frame_window(spark, sf_dir):
    framed = _framed(spark, sf_dir)
    return framed.select("product", "date", F.round("mean", 6).alias("mean"), "n", "index", "is_today")


@query(
    "islands",
    f"""WITH {_DAILY_SQL},
m AS (SELECT product, date, sum(CASE WHEN mean IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY date) AS run,
             mean FROM framed)
SELECT product, min(date) AS first_date, max(date) AS last_date, count(*)::BIGINT AS days FROM m
WHERE mean IS NOT NULL GROUP BY product, run""",
)
def islands(spark, sf_dir):
    return history.islands(_framed(spark, sf_dir), ["product"])


@query(
    "last_point",
    f"""WITH {_DAILY_SQL}
SELECT product, max(date) AS date, round(arg_max(mean, date), 6)::DOUBLE AS mean, arg_max(n, date)::BIGINT AS n
FROM framed WHERE mean IS NOT NULL GROUP BY 1""",
)
def last_point(spark, sf_dir):
    return history.last_point(_framed(spark, sf_dir), ["product"]).withColumn("mean", F.round("mean", 6))


@query(
    "period_mean",
    f"""WITH {_DAILY_SQL}
SELECT product, round(avg(mean), 6)::DOUBLE AS mean, count(mean)::BIGINT AS k, count(*)::BIGINT AS "window"
FROM framed GROUP BY 1 HAVING count(mean) > 0""",
)
def period_mean(spark, sf_dir):
    return history.period_mean(_framed(spark, sf_dir), ["product"]).withColumn("mean", F.round("mean", 6))


@query(
    "stale_hours",
    f"""WITH {_DAILY_SQL},
h AS (SELECT product, CASE WHEN max(observed_at) IS NOT NULL THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-31 12:00:00')
      - epoch_us(max(observed_at))) / 3.6e9::DOUBLE) END AS h FROM framed GROUP BY 1)
SELECT product, round(h, 6)::DOUBLE AS stale_hours, coalesce(h >= 36, FALSE) AS stale FROM h""",
)
def stale_hours(spark, sf_dir):
    found = history.stale_hours(_framed(spark, sf_dir), ["product"], datetime(2024, 1, 31, 12))
    return found.withColumn("stale_hours", F.round("stale_hours", 6))


@query(
    "date_adjacency",
    f"""WITH {_DAILY_SQL},
s AS (SELECT product, date, lag(date) OVER (PARTITION BY product ORDER BY date) AS previous FROM daily)
SELECT product, date, previous FROM s WHERE date - previous <> 1""",
)
def date_adjacency(spark, sf_dir):
    return history.date_breaks(_daily(spark, sf_dir).select("product", "date"), ["product"])


# --- guards -------------------------------------------------------------------------------------

_GUARD_SQL = f"""
prev AS (SELECT event_type || '-' || user_id::VARCHAR AS product, {LOCAL_SQL} AS date, max(event_id) AS oid, max(value)::VARCHAR AS content
         FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
cand AS (SELECT event_type || '-' || user_id::VARCHAR AS product, {LOCAL_SQL} AS date,
                max(CASE WHEN event_type <> 'error' OR value > 240 THEN event_id END) AS oid, max(value)::VARCHAR AS content
         FROM events WHERE (event_type <> 'view' OR ts < TIMESTAMP '2024-01-20')
           AND (event_type <> 'click' OR ts < TIMESTAMP '2024-01-25') GROUP BY 1, 2),
b AS (SELECT coalesce(p.product, c.product) AS product, coalesce(p.date, c.date) AS date, p.oid AS po, c.oid AS co,
             p.content AS pc, c.content AS cc, p.product IS NOT NULL AS hp, c.product IS NOT NULL AS hc
      FROM prev p FULL JOIN cand c ON c.product = p.product AND c.date = p.date),
t AS (SELECT product, bool_or(hp) AS known, max(CASE WHEN hp THEN date END) AS pd, max(CASE WHEN hc THEN date END) AS cd,
             count(*) FILTER (hc AND po IS NOT NULL AND co IS NULL) AS lost,
             count(*) FILTER (NOT hp OR NOT hc OR pc IS DISTINCT FROM cc OR po IS DISTINCT FROM co) AS diffs
      FROM b GROUP BY 1)
"""


def _summaries(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    day = history.local_date(F.col("ts")).alias("date")
    product, content = _series(), F.max("value").cast("string").alias("content")
    previous = (
        e.where(F.col("ts") < F.lit("2024-01-25").cast("timestamp"))
        .groupBy(product, day)
        .agg(F.max("event_id").alias("observation_id"), content)
        .withColumn("generated_at", F.lit("2024-01-25 00:00:00").cast("timestamp"))
    )
    late, later = F.lit("2024-01-20").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")
    kept = ((F.col("event_type") != "view") | (F.col("ts") < late)) & (
        (F.col("event_type") != "click") | (F.col("ts") < later)
    )
    seen = F.when((F.col("event_type") != "error") | (F.col("value") > 240), F.col("event_id"))
    candidate = (
        e.where(kept)
        .groupBy(product, day)
        .agg(F.max(seen).alias("observation_id"), content)
        .withColumn("generated_at", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    )
    return previous, candidate


@query(
    "summary_guards",
    f"""WITH {_GUARD_SQL}
SELECT product, CASE WHEN known AND cd < pd THEN 'skipped_stale' WHEN known AND lost > 0 THEN 'blocked_missing_observations'
                     WHEN known AND diffs = 0 THEN 'skipped_unchanged' ELSE 'written' END AS write, lost::BIGINT AS lost
FROM t WHERE cd IS NOT NULL""",
)
def summary_guards(spark, sf_dir):
    return history.write_decision(*_summaries(spark, sf_dir), ["product"])


@query(
    "lost_dates",
    f"""WITH {_GUARD_SQL}
SELECT product, date FROM b WHERE hc AND po IS NOT NULL AND co IS NULL""",
)
def lost_dates(spark, sf_dir):
    return history.lost_dates(*_summaries(spark, sf_dir), ["product"])


@query(
    "observation_append",
    """WITH o AS (SELECT event_id, 'obs_' || substr(sha256('obs-v1' || chr(10) || epoch_us(ts)::VARCHAR || chr(10) ||
                          sha256(props) || chr(10) || 'daily-mean-2' || chr(10)), 1, 24) AS observation_id,
                   value, ts FROM events)
SELECT observation_id, value::DOUBLE AS value FROM o WHERE ts >= TIMESTAMP '2024-01-10'""",
)
def observation_append(spark, sf_dir):
    """Everything is offered again on top of the first days; only the rest is new."""
    e = S.table(spark, sf_dir, "events")
    key = history.observation_id(F.unix_micros("ts").cast("string"), F.sha2("props", 256))
    incoming = e.select(key.alias("observation_id"), "value", "ts")
    existing = incoming.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    return history.append_observations(existing, incoming).select("observation_id", "value")
