"""Live state batch by batch and as a stream; history guards and observation runs."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.operators import history, live
from pricewarden.plans import observe
from pricewarden.streaming import state as stream

T0 = datetime(2026, 9, 20, 6, tzinfo=timezone.utc)
ATTEMPT = "district_code long, product string, seq int, observed_at timestamp, announced_total long, status string"


def one_by_one(previous, attempts):
    units = dict(previous)
    for d, product, seq, at, total, status in attempts:
        old = units.get((d, product))
        if status != "ok":
            if old:
                units[d, product] = (*old[:2], status)
        elif old and at <= old[0]:
            units[d, product] = (*old[:2], R.ATTEMPT_STALE)
        else:
            units[d, product] = (at, total, "ok")
    return units


def as_dict(frame):
    rows = frame.withColumn("us", F.unix_micros("observed_at")).collect()
    return {
        (r["district_code"], r["product"]): (
            datetime.fromtimestamp(r["us"] / 1e6, timezone.utc), r["announced_total"], r["last_attempt_status"]
        )
        for r in rows
    }


def random_attempts(rng, n):
    return [
        (rng.randint(1, 6), rng.choice(["regular", "premium"]), seq, T0 + timedelta(hours=rng.randint(0, 30)),
         rng.randint(0, 9), rng.choice(["ok", "ok", "ok", "sin_tabla"]))
        for seq in range(n)
    ]


def test_runs_equal_one_by_one(spark):
    rng, units = random.Random(4), {}
    state = spark.createDataFrame([], stream.STATE_SCHEMA)
    for _ in range(3):
        attempts = random_attempts(rng, 40)
        units = one_by_one(units, attempts)
        following = live.apply_run(state, spark.createDataFrame(attempts, ATTEMPT), T0)
        state = spark.createDataFrame(following.collect(), stream.STATE_SCHEMA)
        assert as_dict(state) == units


def test_rows_follow_their_header(spark):
    units = spark.createDataFrame([(1, "regular", T0)], "district_code long, product string, observed_at timestamp")
    rows = spark.createDataFrame(
        [(1, "regular", T0, "k1"), (1, "regular", T0 - timedelta(hours=1), "k2"), (2, "regular", T0, "k3")],
        "district_code long, product string, observed_at timestamp, key_hash string",
    )
    assert [r["key_hash"] for r in live.current_rows(rows, units).collect()] == ["k1"]


def test_links_need_both_sides_unique(spark):
    now = datetime(2026, 9, 20, 15)
    fresh, old = T0 + timedelta(hours=3), T0 - timedelta(hours=16)
    rows = spark.createDataFrame(
        [("regular", fresh, "a", 5.0), ("regular", fresh, "b", 5.0), ("regular", fresh, "b", 6.0), ("regular", fresh, "c", 5.0),
         ("regular", fresh, "d", 5.0), ("regular", old, "e", 5.0), ("regular", fresh, "f", 0.0), ("regular", fresh, None, 5.0)],
        "product string, observed_at timestamp, key_hash string, price double",
    )
    offers = spark.createDataFrame(
        [("1", "regular", "a"), ("2", "regular", "b"), ("3", "regular", "c"), ("4", "regular", "c"), ("5", "regular", "e")],
        "id string, product string, key_hash string",
    )
    links = live.link_keys(rows, offers, now)
    assert {r["key_hash"]: (r["status"], r["id"]) for r in links.collect()} == {
        "a": ("linked", "1"), "b": ("ambiguous", None), "c": ("ambiguous", None), "d": ("unlinked", None)
    }
    priced = {r["id"]: r["live_price"] for r in live.attach_live(offers, links).collect()}
    assert priced == {"1": 5.0, "2": None, "3": None, "4": None, "5": None}
    units = rows.select("product", "observed_at").distinct()
    counts = live.link_counts(links, rows, units, now).first()
    assert (counts["rows"], counts["linked"], counts["ambiguous"], counts["unlinked"], counts["expired_units"]) == (7, 1, 2, 1, 1)


def test_regressions_are_per_unit(spark):
    schema = "district_code long, product string, observed_at timestamp"
    published = spark.createDataFrame([(1, "regular", T0), (2, "regular", T0), (3, "diesel", T0)], schema)
    candidate = spark.createDataFrame([(1, "regular", T0 + timedelta(hours=9)), (2, "regular", T0 - timedelta(hours=1))], schema)
    found = live.unit_regressions(candidate, published, ["regular"]).collect()
    assert [(r["district_code"], r["candidate_at"] is None) for r in found] == [(2, False)]
    assert live.unit_regressions(candidate, published).count() == 2


def test_stream_equals_batches_and_restarts(spark, tmp_path):
    rng = random.Random(8)
    source, root = tmp_path / "in", str(tmp_path / "out")
    units = {}
    for i in range(3):
        attempts = random_attempts(rng, 30)
        units = one_by_one(units, attempts)
        spark.createDataFrame(attempts, ATTEMPT).coalesce(1).write.parquet(str(source / f"{i:02d}"))
        captures = spark.readStream.schema(ATTEMPT).parquet(str(source / "*"))
        stream.start(captures, root, lambda batch: batch, datetime(2026, 9, 22)).awaitTermination()
        assert as_dict(stream.load_state(spark, root)) == units
    # A repeated batch starts from the state before it and writes the same folder again.
    last = spark.read.schema(ATTEMPT).parquet(str(source / "02"))
    stream.upsert(root, lambda batch: batch, datetime(2026, 9, 22))(last, 2)
    assert as_dict(stream.load_state(spark, root)) == units


def test_state_is_a_log_of_changes(spark, tmp_path):
    """Batches write the units they name; snapshots, repeated batches and lost folders in between."""
    rng, root, at = random.Random(5), str(tmp_path), datetime(2026, 9, 22)
    units, states = {}, []
    for i in range(9):
        attempts = random_attempts(rng, 12)
        run = stream.upsert(root, lambda batch: batch, at, compact=3)
        run(spark.createDataFrame(attempts, ATTEMPT), i)
        if i % 4 == 1:  # once more, as after a crash before the commit
            run(spark.createDataFrame(attempts, ATTEMPT), i)
        units = one_by_one(units, attempts)
        states.append(units)
        assert as_dict(stream.load_state(spark, root, compact=3)) == units
        written = spark.read.parquet(f"{root}/state/changes/batch={i}")
        assert {(r.district_code, r.product) for r in written.collect()} <= {(a[0], a[1]) for a in attempts}
    assert as_dict(stream.load_state(spark, root, before=8, compact=3)) == states[7]
    # The folders that are left are those of two snapshots.
    assert sorted(p.name for p in (tmp_path / "state" / "changes").iterdir()) == [f"batch={n}" for n in range(3, 9)]
    (tmp_path / "state" / "changes" / "batch=7" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError, match="batch=7"):
        stream.load_state(spark, root, before=8, compact=3)
    nothing = spark.createDataFrame([], ATTEMPT)
    stream.upsert(root, lambda batch: batch, at, compact=3)(nothing, 9)
    assert as_dict(stream.load_state(spark, root, compact=3)) == units


def test_daily_mean_contradictions(spark):
    rows = spark.createDataFrame(
        [("1", "a", "regular", 5.0, T0, "fresh"), ("2", "a", "regular", 5.0, T0, "fresh"), ("3", "b", "regular", 6.0, T0, "fresh"),
         ("1", "a", "premium", 5.0, T0, "fresh"), ("2", "a", "premium", 7.0, T0, "fresh"), ("3", None, "premium", 7.0, T0, "fresh"),
         ("1", "a", "diesel", 5.0, T0, "expired")],
        "id string, site_id string, product string, price double, reported_at timestamp, state string",
    )
    got = {r["product"]: r for r in history.daily_mean(rows).collect()}
    assert (got["regular"]["mean"], got["regular"]["n"], got["regular"]["duplicates_ignored"], got["regular"]["status"]) == (5.5, 2, 1, "ok")
    assert (got["premium"]["status"], got["premium"]["contradictions"], got["premium"]["problems"]) == ("invalid", 1, 1)
    assert (got["diesel"]["mean"], got["diesel"]["n"], got["diesel"]["status"]) == (None, 0, "empty")
    blocked = history.measure(rows, datetime(2026, 9, 1), datetime(2026, 9, 2)).collect()
    assert {r["status"] for r in blocked} == {"blocked"} and len(blocked) == 3


def summary(spark, days, generated):
    rows = [("p", date(2026, 9, d), o, c, generated) for d, o, c in days]
    return spark.createDataFrame(rows, "product string, date date, observation_id string, content string, generated_at timestamp")


def test_write_guards(spark):
    old = summary(spark, [(1, "a", "1"), (2, "b", "2"), (3, None, None)], T0)
    later = T0 + timedelta(days=1)
    decide = lambda new: history.write_decision(old, new, ["product"]).first()["write"]
    assert decide(summary(spark, [(1, "a", "1"), (2, "b", "2"), (3, None, None)], later)) == "skipped_unchanged"
    assert decide(summary(spark, [(1, "a", "1"), (2, "b", "2"), (3, "c", "3")], later)) == "written"
    assert decide(summary(spark, [(1, "a", "1"), (2, None, None), (3, "c", "3")], later)) == "blocked_missing_observations"
    assert decide(summary(spark, [(1, "a", "1"), (2, "b", "2")], later)) == "skipped_stale"
    assert decide(summary(spark, [(1, "a", "1"), (2, "b", "2"), (3, "c", "3")], T0 - timedelta(hours=1))) == "skipped_stale"
    # A date that left the window is not a loss.
    assert decide(summary(spark, [(2, "b", "2"), (3, "c", "3"), (4, None, None)], later)) == "written"


def test_append_is_idempotent_and_refuses_changes(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "observation_id string, v int")
    incoming = spark.createDataFrame([("b", 2), ("c", 3)], "observation_id string, v int")
    assert [r["observation_id"] for r in history.append_observations(stored, incoming).collect()] == ["c"]
    with pytest.raises(Exception, match="stored observation differs"):
        history.append_observations(stored, spark.createDataFrame([("b", 9)], "observation_id string, v int")).collect()


def test_observation_run(spark, tmp_path):
    offers = spark.createDataFrame(
        [("1", "a", "regular", 5.0, T0, None, None), ("2", "b", "regular", 6.0, T0, 6.5, T0)],
        "id string, establishment_id string, product string, price double, reported_at timestamp, live_price double, "
        "live_observed_at timestamp",
    )
    root, now = str(tmp_path / "h"), datetime(2026, 9, 21, 3)
    seen = observe.observation(offers, now, datetime(2026, 9, 20), "rev")
    assert observe.append(seen, root, ["regular"]) == 1 and observe.append(seen, root, ["regular"]) == 0
    with pytest.raises(ValueError, match="lacks premium"):
        observe.append(seen, root, ["premium", "regular"])
    # 03:00 UTC still belongs to the day before in the local calendar.
    later = observe.observation(offers, now + timedelta(hours=1), datetime(2026, 9, 20), "rev")
    observe.append(later, root, ["regular"])
    days = {r["date"]: r for r in observe.summary(spark, root, date(2026, 9, 21), 3).collect()}
    assert [days[d]["mean"] for d in sorted(days)] == [None, 5.75, None]
    assert days[date(2026, 9, 20)]["observation_id"] == later.first()["observation_id"]


def test_windows_are_bounded():
    with pytest.raises(ValueError):
        history.window_dates(date(2026, 1, 1), 31)
