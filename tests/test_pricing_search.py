"""Effective price at its boundaries, site rows, and the search page."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.operators import listing, pricing
from pricewarden.operators.listing import Origin
from pricewarden.plans import search

NOW = datetime(2026, 9, 20, 14)
CUTOFF = datetime(2026, 9, 20, 12)
MS = timedelta(milliseconds=1)
OFFER = (
    "id string, site_id string, product string, price double, reported_at timestamp, live_price double, "
    "live_observed_at timestamp"
)


def utc(value):
    from datetime import timezone

    return None if value is None else value.replace(tzinfo=timezone.utc)


def offers(spark, *rows):
    return spark.createDataFrame(
        [(f"o{i}", "s", "regular", p, utc(at), lp, utc(lat)) for i, (p, at, lp, lat) in enumerate(rows)], OFFER
    )


def test_windows_are_inclusive(spark):
    day30, hour24 = NOW - timedelta(days=30), NOW - timedelta(hours=24)
    rows = offers(
        spark,
        (5.0, day30, None, None),
        (5.0, day30 - MS, None, None),
        (5.0, day30 - MS, 4.0, hour24),
        (5.0, day30 - MS, 4.0, hour24 - MS),
        (5.0, NOW - timedelta(hours=1), 4.0, NOW - timedelta(hours=2)),
        (5.0, NOW - timedelta(hours=3), 4.0, NOW - timedelta(hours=2)),
        (5.0, NOW + MS, None, None),
        (5.0, NOW + MS, 4.0, NOW),
        (0.0, NOW, None, None),
        (float("nan"), NOW, 4.0, NOW + MS),
        (5.0, None, 4.0, NOW),
    )
    got = pricing.effective_price(rows, NOW).select("effective_price", "price_source", "price_reason").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [
        (5.0, "csv", R.CSV_CURRENT),
        (None, None, R.CSV_EXPIRED),
        (4.0, "live", R.LIVE_CURRENT),
        (None, None, R.CSV_EXPIRED),
        (5.0, "csv", R.CSV_AFTER_LIVE),
        (4.0, "live", R.LIVE_CURRENT),
        (None, None, R.CSV_FUTURE),
        (4.0, "live", R.LIVE_CURRENT),
        (None, None, R.NO_PRICE),
        (None, None, R.NO_PRICE),
        (4.0, "live", R.LIVE_CURRENT),
    ]
    states = pricing.evaluate(rows, NOW, CUTOFF).groupBy("state").count().collect()
    assert {r[0]: r[1] for r in states} == {"fresh": 6, "expired": 2}


def test_clock_before_cutoff_is_an_error(spark):
    with pytest.raises(pricing.ClockError):
        pricing.evaluate(offers(spark, (5.0, NOW, None, None)), CUTOFF - MS, CUTOFF)


def test_next_change(spark):
    rows = offers(
        spark, (5.0, NOW - timedelta(days=29), None, None), (5.0, NOW - timedelta(days=40), 4.0, NOW - timedelta(hours=20))
    )
    found = pricing.next_change(rows, NOW, CUTOFF).select(F.unix_micros("refresh_at")).first()[0]
    assert found == int(utc(NOW + timedelta(hours=4)).timestamp() * 1e6)
    never = offers(spark, (5.0, NOW - timedelta(days=31), None, None), (5.0, NOW + MS, None, None))
    assert pricing.next_change(never, NOW, CUTOFF).first()[0] is None


def test_republish(spark):
    layer = "id string, live_price double, live_observed_at timestamp"
    old = spark.createDataFrame([("a", 4.0, utc(NOW - timedelta(hours=18))), ("b", None, None)], layer)
    decide = lambda new, now: pricing.republish_decision(pricing.version_diff(new, old), now).first()
    assert decide(old, NOW)["reason"] == "unchanged"
    assert decide(old, NOW + MS)["reason"] == "published_capture_ages"
    changed = decide(old.where("id = 'a'").withColumn("live_price", F.lit(5.0)), NOW)
    assert (changed["visible"], changed["reason"], changed["changed_offers"]) == (True, "effective_price_changes", 2)
    first = pricing.republish_decision(pricing.version_diff(old, old.where(F.lit(False))), NOW).first()
    assert (first["reason"], first["changed_offers"]) == ("nothing_published", 2)


# Thirteen sites on one meridian; prices as (regular, premium); one only live, one silent for forty days.
KM = {"a": 0.3, "b": 0.8, "c": 1.2, "d": 1.9, "e": 2.6, "f": 3.1, "g": 3.4, "h": 4.0, "i": 4.4, "j": 4.8, "k": 5.2, "l": 5.4, "m": 5.5}
HERE = Origin(-12.12, -77.03)


def site_table(spark):
    rows = []
    for i, (name, km) in enumerate(KM.items()):
        lat = HERE.latitude + math.degrees(km / 6371.0088)
        at = NOW - timedelta(days=40 if name == "b" else 2)
        rows.append((f"r{name}", name, "regular", 15.0 + i % 5, utc(at), 14.0 if name == "c" else None,
                     utc(NOW - timedelta(hours=3)) if name == "c" else None, "COMAS" if i < 7 else "ATE", lat, -77.03))
        if name in "adg":
            rows.append((f"p{name}", name, "premium", 18.0, utc(NOW - timedelta(days=1)), None, None,
                         "COMAS", lat, -77.03))
    frame = spark.createDataFrame(rows, OFFER + ", district string, latitude double, longitude double")
    return search.site_table(frame, ["regular", "premium"], NOW, CUTOFF)


def test_site_rows(spark):
    rows = {r["site_id"]: r for r in site_table(spark).collect()}
    assert len(rows) == 13
    assert not rows["b"]["has_price"] and rows["b"]["age_days"] is None and rows["b"]["silent_days"] == 40.0
    assert rows["c"]["price_regular"]["price"] == 14.0 and rows["c"]["age_source"] == "live"
    assert rows["a"]["price_premium"]["id"] == "pa" and rows["a"]["silent_days"] == 1.0


def test_search_page(spark):
    rows = site_table(spark).persist()
    begun = search.start(rows, search.Search(["regular", "premium"], "regular", HERE))
    assert begun.radius_km == 3.5
    by_distance = search.run(rows, begun)
    assert [r["site_id"] for r in by_distance.items.collect()] == list("abcdefg")
    assert by_distance.summary["total"] == 7 and by_distance.summary["remaining"] == 0
    from dataclasses import replace

    by_price = search.run(rows, replace(begun, sort="price"))
    items = by_price.items.collect()
    assert [r["site_id"] for r in items] == list("cafgdeb")
    assert [r["site_id"] for r in items if r["cheapest"]] == ["c"] and not any(r["also_nearest"] for r in items)
    assert by_price.summary["criterion"] == "price" and by_price.summary["sort_toggle"]
    assert by_price.summary["product_toggle"] and not by_price.summary["radius_inert"]
    wide = search.run(rows, replace(begun, radius_km=5.5))
    assert wide.summary["shown"] == 6 and wide.summary["remaining"] == 7 and wide.summary["next_visible"] == 13
    district = search.run(rows, search.Search(["regular"], "regular", district="ATE")).items.collect()
    assert [r["site_id"] for r in district] == list("klhmij")
    nothing = search.run(rows, search.Search(["regular"], "regular", district="NOWHERE"))
    assert nothing.summary["district_empty"]
    rows.unpersist()


def test_paging_and_errors(spark):
    assert [listing.shown(6, n) for n in (3, 10, 11)] == [3, 10, 6]
    assert [listing.next_visible(6, n) for n in (16, 17)] == [16, 12]
    with pytest.raises(ValueError):
        listing.order_keys("colour")
    with pytest.raises(ValueError):
        listing.within_radius(site_table(spark), HERE, 0)
    bad = spark.createDataFrame([(95.0, 0.0)], "latitude double, longitude double")
    with pytest.raises(Exception, match="coordinate out of range"):
        listing.with_distance(bad, HERE).collect()
