"""Grid joins, hot keys, exact positions and one-to-one assignment against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pricewarden.functions import geo
from pricewarden.functions.ordering import global_index, predecessor
from pricewarden.functions.skew import split_join
from pricewarden.operators import matching, sampling
from pricewarden.session import cut_lineage

R = 6371000.0


def metres(a, b):
    f = math.radians
    h = math.sin(f(b[0] - a[0]) / 2) ** 2 + math.cos(f(a[0])) * math.cos(f(b[0])) * math.sin(f(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def cloud(rng, n, lat, lon, spread):
    points = []
    for _ in range(n):
        x = lon + rng.uniform(-spread, spread) / max(math.cos(math.radians(min(abs(lat), 89.0))), 0.02)
        points.append((max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (x + 180.0) % 360.0 - 180.0))
    return points


@pytest.mark.parametrize("lat, lon", [(-12.1, -77.0), (0.0, 0.0), (64.0, 179.9995), (-45.0, -179.9999), (89.95, 10.0)])
def test_pairs_equal_brute_force_anywhere(spark, lat, lon):
    rng = random.Random(f"{lat}{lon}")
    p, s = cloud(rng, 40, lat, lon, 0.004), cloud(rng, 60, lat, lon, 0.004)
    places = spark.createDataFrame([(i, *x) for i, x in enumerate(p)], "place_id int, latitude double, longitude double")
    sites = spark.createDataFrame([(i, *x) for i, x in enumerate(s)], "site_id int, latitude double, longitude double")
    got = {(r["place_id"], r["site_id"]) for r in matching.spatial_pairs(places, sites).collect()}
    expected = {(i, j) for i, a in enumerate(p) for j, b in enumerate(s) if metres(a, b) <= 150.0}
    assert got == expected and expected


def test_neighbours_in_a_dense_place(spark):
    rng = random.Random(9)
    points = cloud(rng, 600, -12.05, -77.03, 0.004)  # all within a few cells, most circles cut them
    sites = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "site_id int, latitude double, longitude double")
    got = {r["site_id"]: r["neighbours"] for r in matching.neighbour_counts(sites, 250.0).collect()}

    def metres(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_M_ROUND * math.asin(math.sqrt(h))

    assert got == {i: sum(metres(p, q) <= 250.0 for q in points) for i, p in enumerate(points)}


def test_neighbours_with_a_hot_spot(spark):
    rng = random.Random(3)
    points = cloud(rng, 120, -12.1, -77.0, 0.01) + [(-12.1, -77.0)] * 60
    sites = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "site_id int, latitude double, longitude double")
    got = {r["site_id"]: r["neighbours"] for r in matching.neighbour_counts(sites, 400.0).collect()}
    assert got == {i: sum(metres(a, b) <= 400.0 for b in points) for i, a in enumerate(points)}


def test_neighbour_centres_are_not_broadcast(spark, monkeypatch):
    """A centre is exploded to the cells around it, which the optimizer's sizes do not show."""
    plans = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    sites = spark.createDataFrame([(i, -12.05 + i * 1e-4, -77.03) for i in range(50)], "site_id int, latitude double, longitude double")
    assert matching.neighbour_counts(sites, 250.0).count() == 50
    met = [p for p in plans if "_cell_n" in p]
    assert met and all("BroadcastHashJoin" not in p and "SortMergeJoin" in p for p in met)


@pytest.mark.parametrize("spots", [1, 4, 10_000])
def test_neighbours_at_any_depth(spark, spots):
    """Cells quartered down to single spots, and not at all, count alike."""
    rng = random.Random(17)
    points = cloud(rng, 150, -12.05, -77.03, 0.003) + cloud(rng, 20, -12.05, -77.03, 0.05)
    sites = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "site_id int, latitude double, longitude double")
    got = {r["site_id"]: r["neighbours"] for r in matching.neighbour_counts(sites, 250.0, cell_spots=spots).collect()}
    assert got == {i: sum(metres(a, b) <= 250.0 for b in points) for i, a in enumerate(points)}


def test_split_join_finds_every_pair_once(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(50)], "k int, b int")
    plain = sorted((r["k"], r["a"], r["b"]) for r in left.join(right, "k").collect())
    split = sorted((r["k"], r["a"], r["b"]) for r in split_join(left, right, ["k"], ("a", "b"), hot_rows=4).collect())
    assert split == plain


def test_split_join_broadcasts_neither_side(spark):
    """A few rows exploded to many look small to the optimizer; the driver must not hold them."""
    left = spark.createDataFrame([(i,) for i in range(3)], "a int").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(999))))
    right = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.col("id").alias("b"))
    joined = split_join(left, right, ["k"], ("a", "b"))
    last = joined._jdf.queryExecution().executedPlan().toString().split("_ls#")[0]
    assert "SortMergeJoin [k" in last and joined.count() == 3000


def test_split_join_has_a_task_for_every_so_many_pairs(spark):
    """800 rows a side make 320,000 pairs; where bytes alone decide, they all meet in one task."""
    left = spark.range(800).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(800).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    joined = split_join(left, right, ["k"], ("a", "b"), hot_rows=100, task_pairs=20_000)
    held = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(held) == 320_000 and len(held) >= 8 and max(held) <= 100_000


def test_global_index_and_predecessor(spark):
    rng = random.Random(5)
    values = [(rng.randint(0, 9), i) for i in range(200)]
    frame = spark.createDataFrame(values, "v int, id int").repartition(7)
    order = [F.col("v"), F.col("id")]
    ranked = sorted(values)
    got = {r["id"]: (r["row_index"], r["row_total"]) for r in global_index(frame, order).collect()}
    assert got == {i: (n, 200) for n, (_, i) in enumerate(ranked)}
    before = {r["id"]: r["prev"] for r in predecessor(frame, order, "id", "prev").collect()}
    assert before == {i: (ranked[n - 1][1] if n else None) for n, (_, i) in enumerate(ranked)}
    weighted = global_index(frame.groupBy("v").count(), [F.col("v")], F.col("count")).collect()
    assert {r["v"]: r["row_index"] for r in weighted} == {
        v: sum(x < v for x, _ in values) for v in {x for x, _ in values}
    }


def pairs_frame(spark, rng, n_places, n_sites, density):
    rows = []
    for p in range(n_places):
        for s in range(n_sites):
            if rng.random() < density:
                rows.append((p, s, float(rng.randint(1, 149)), float(rng.randint(20, 60)), rng.random() < 0.5))
    return rows, spark.createDataFrame(
        rows, "place_id int, site_id int, distance_m double, score double, confirmed boolean"
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_one_by_one(spark, seed):
    """Scores repeat a lot, so ties and long chains of blocked pairs both occur."""
    rows, frame = pairs_frame(spark, random.Random(seed), 25, 25, 0.2)
    frame = frame.persist()
    taken = matching.greedy_assign(frame).persist()
    order = sorted(rows, key=lambda r: (-r[3], r[2], r[0], r[1]))
    places, sites, expected = set(), {}, {}
    for place, site, distance, _, confirmed in order:
        if place in places or site in sites:
            continue
        rivals = [d for p, s, d, _, _ in rows if p == place and s != site and s not in sites and d <= 80]
        margin = min(rivals) - distance if rivals else None
        wide = margin is None or margin >= 100
        status = "verified" if distance <= 80 and confirmed and wide else "conflict" if not wide else "candidate"
        places.add(place)
        sites[site] = place
        expected[place] = (site, margin, status)
    got = matching.match_status(matching.with_margin(frame, taken)).collect()
    assert {r["place_id"]: (r["site_id"], r["margin_m"], r["status"]) for r in got} == expected
    assert matching.greedy_assign(frame.where("score < 0")).count() == 0


@pytest.mark.parametrize("first, most", [(3, 200_000), (0, 200_000), (0, 3), (1, 12)])
def test_components_and_rounds_assign_alike(spark, first, most):
    rows, frame = pairs_frame(spark, random.Random(31), 30, 30, 0.08)
    taken, places, sites = set(), set(), set()
    for place, site, *_ in sorted(rows, key=lambda r: (-r[3], r[2], r[0], r[1])):
        if place not in places and site not in sites:
            places.add(place)
            sites.add(site)
            taken.add((place, site))
    got = matching.greedy_assign(frame, first, most).select("place_id", "site_id", "rank").collect()
    assert {(r.place_id, r.site_id) for r in got} == taken and len(got) == len(taken)
    assert all((r["rank"]["place"], r["rank"]["site"]) == (r.place_id, r.site_id) for r in got)


def test_a_long_chain_takes_few_jobs(spark):
    """Every pair but the best waits for the one before it: a round of mutual choices settles one of them."""
    n = 1000
    rows = [(f"p{i:04d}", f"s{i:04d}", 5.0, 2000.0 - 2 * i) for i in range(n)] + [(f"p{i + 1:04d}", f"s{i:04d}", 5.0, 1999.0 - 2 * i) for i in range(n - 1)]
    frame = spark.createDataFrame(rows, "place_id string, site_id string, distance_m double, score double")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {(r.place_id, r.site_id) for r in matching.greedy_assign(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {(f"p{i:04d}", f"s{i:04d}") for i in range(n)}
    assert jobs < 300


def test_circle_box_keeps_everything_inside(spark):
    rng = random.Random(9)
    points = cloud(rng, 300, -12.1, -77.0, 0.05)
    frame = spark.createDataFrame(points, "latitude double, longitude double")
    inside = frame.where(geo.box_around(F.col("latitude"), F.col("longitude"), -12.1, -77.0, 2.0)).collect()
    near = [x for x in points if metres((-12.1, -77.0), x) <= 2000.0]
    assert set(near) <= {(r[0], r[1]) for r in inside} and len(inside) < len(points)


def test_round_robin_skips_but_spends_turns(spark):
    rows = spark.createDataFrame(
        [("1", "x", "A", 9.0), ("2", "y", "A", 8.0), ("3", "x", "B", 7.0), ("4", "z", "B", 6.0), ("5", "w", "C", 1.0)],
        "id string, site_id string, stratum string, difference double",
    )
    got = sampling.round_robin(rows, 4).orderBy("turn", "stratum").collect()
    assert [(r["site_id"], r["turn"], r["stratum"]) for r in got] == [
        ("x", 1, "A"), ("w", 1, "C"), ("y", 2, "A"), ("z", 2, "B")
    ]
    skipped = sampling.round_robin(rows, 4, reviewed=rows.where("site_id = 'x'").select("site_id")).collect()
    assert {r["site_id"] for r in skipped} == {"w", "y", "z"}


def test_audit_sheet(spark):
    rows = [(f"v{i}", "verified", float(i), "D", float(i)) for i in range(100)]
    rows += [(f"c{i}", "conflict", float(i), "D", float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "site_id string, status string, margin_m double, district string, distance_m double")
    got = {r["site_id"]: r["reason"] for r in sampling.audit_sheet(frame, 40).collect()}
    expected = {f"v{math.floor(i * 100 / 25)}": "random_sample" for i in range(25)}
    expected |= {f"c{math.floor(i * 30 / 10)}": "risk_sample" for i in range(10)}
    expected |= {f"v{math.floor(i * 40 / 5)}": "risk_sample" for i in range(5)}
    assert got == expected


def test_price_differences_pick_elements(spark):
    rng = random.Random(11)
    rows = [(round(rng.choice([0.0, 0.0, 0.05, 0.1, 0.4, -0.3, 1.2]), 4), float(rng.choice([10, 100]))) for _ in range(57)]
    frame = spark.createDataFrame(rows, "difference double, hours double")
    got = {r["scope"]: r for r in sampling.price_differences(frame).collect()}
    for scope, chosen in (("all", rows), ("recent", [r for r in rows if r[1] <= 72])):
        d = sorted(abs(x) for x, _ in chosen)
        pick = lambda p: d[min(len(d) - 1, math.floor(p * len(d)))]
        assert (got[scope]["n"], got[scope]["median"], got[scope]["p90"], got[scope]["maximum"]) == (
            len(d), pick(0.5), pick(0.9), d[-1]
        )
        assert got[scope]["equal"] == sum(x == 0 for x in d)
        assert got[scope]["within_ten_cents"] == sum(x <= 0.1 for x in d)


def test_targets_are_cut_in_hash_order(spark):
    frame = spark.range(3000).selectExpr(
        "id", "if(id % 3 = 0, 'a', 'b') AS stratum", "id % 50 = 0 AS reviewed", "id % 70 = 1 AS risk"
    )
    by_prefix = sampling.stratified_sample(frame, {"a": 300, "b": 900}, "id", "x").select("id", "drawn").collect()
    hashed = lambda i: hashlib.sha256(f"x|{i}".encode()).hexdigest()
    expected = []
    for stratum, size in (("a", 300), ("b", 900)):
        own = [i for i in range(3000) if (i % 3 == 0) == (stratum == "a")]
        sure = {i: "reviewed" if i % 50 == 0 else "risk" for i in own if i % 50 == 0 or i % 70 == 1}
        quota = max(0, size - sum(v == "reviewed" for v in sure.values()))
        rest = sorted((i for i in own if i not in sure), key=hashed)[:quota]
        expected += [*sure.items(), *((i, "random") for i in rest)]
    assert sorted(map(tuple, by_prefix)) == sorted(expected)


def test_round_robin_takes_as_many_turns_as_it_needs(spark):
    # One site fills the first thousand turns of its stratum; the others come after it.
    rows = [(i, "x", "a", 5000.0 - i) for i in range(1000)] + [(1000 + i, f"s{i}", "a", 10.0 - i) for i in range(5)]
    frame = spark.createDataFrame(rows, "id int, site_id string, stratum string, difference double")
    got = sampling.round_robin(frame, 4).orderBy("turn").collect()
    assert [(r["site_id"], r["turn"]) for r in got] == [("x", 1), ("s0", 1001), ("s1", 1002), ("s2", 1003)]


def test_assign_nearby_is_the_assignment_of_all_pairs(spark):
    """Places crowd round a few sites and want the same ones, so lists cut to one or two sites run out and are made longer."""
    rng = random.Random(31)
    spot = lambda: (-12.1 + rng.uniform(0, 0.002), -77.0 + rng.uniform(0, 0.002))
    places = spark.createDataFrame(
        [(i, f"AV. LIMA {rng.choice([10, 11])}", "Grifo ALFA", rng.choice(["Repsol", None]), *spot()) for i in range(60)],
        "place_id long, place_address string, place_name string, place_brand string, latitude double, longitude double",
    )
    sites = spark.createDataFrame(
        [(i, f"AV. LIMA {rng.choice([10, 11, 12])}", rng.choice(["ALFA SAC", "REPSOL COMERCIAL"]), *spot()) for i in range(50)],
        "site_id long, site_address string, legal_name string, latitude double, longitude double",
    )
    pairs = cut_lineage(matching.scored_pairs(places, sites))
    whole = cut_lineage(matching.greedy_assign(pairs))
    expected = sorted((r["place_id"], r["site_id"]) for r in whole.collect())
    status = lambda margined: {r["place_id"]: (r["site_id"], r["margin_m"], r["status"]) for r in matching.match_status(margined).collect()}
    p, s = cut_lineage(matching.place_features(places)), cut_lineage(matching.site_features(sites))
    for choices in (1, 2, 16):
        taken, kept = matching.assign_nearby(p, s, choices)
        assert sorted((r["place_id"], r["site_id"]) for r in taken.collect()) == expected
        assert status(matching.with_nearby_margin(kept, taken, p, s)) == status(matching.with_margin(pairs, whole))
    assert kept.count() < pairs.count() and len(expected) > 30
