"""Feeds under contract, and the whole way from CSV to a published version."""

from __future__ import annotations

import gzip
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pricewarden import reasons as R
from pricewarden.config import RULES, rules_frame
from pricewarden.functions.parse import parse_captured_price, parse_instant, parse_price
from pricewarden.operators import funnel, reports
from pricewarden.plans import publish
from pricewarden.schemas import LIQUID, LPG
from pricewarden import session
from pricewarden.sources import delimited, places, reference, versions

HEADER = (
    "ID4;ACTIVIDAD;REGISTRO DE HIDROCARBUROS;RUC;RAZÓN SOCIAL;DEPARTAMENTO;PROVINCIA;DISTRITO;DIRECCIÓN;"
    "FECHA DE REGISTRO;PRODUCTO;TIPO DE CLIENTE;MARCA;PRECIO DE VENTA (SOLES);UNIDAD"
)
STATION = "ESTACIÓN DE SERVICIO CON GASOCENTRO DE GLP"
CENTRE = "GASOCENTROS DE GLP"
CENTRE_CNG = "GASOCENTRO DE GLP CON ESTABLECIMIENTO DE VENTA AL PUBLICO DE GNV"
CUTOFF = datetime(2026, 9, 24, tzinfo=timezone.utc)


def line(id_, registration, activity=STATION, price="7.49", date="2026-09-23 10:00:00", **other):
    v = {
        "department": "LIMA", "province": "LIMA", "district": "MIRAFLORES", "product": "GLP - G",
        "client": "Usuario Final", "unit": "Galones", "name": f"GRIFO {registration} SAC",
        "address": f"AV. LARCO N° {registration[-3:]}", **other,
    }
    return ";".join(
        [id_, activity, registration, "20123456789", v["name"], v["department"], v["province"], v["district"],
         v["address"], date, v["product"], v["client"], "MARCA", price, v["unit"]]
    )


def write(path, *lines, header=HEADER, bom=True):
    text = ("﻿" if bom else "") + "\r\n".join([header, *lines]) + "\r\n"
    if str(path).endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_header_and_cells_are_normalised(spark, tmp_path):
    path = write(tmp_path / "a.csv.gz", line("1", "0001", name=' "GRIFO ""EL SOL"" ;SAC" '.strip()))
    rows = delimited.read_feed(spark, path, LPG).collect()
    assert [r["RAZON_SOCIAL"] for r in rows] == ['GRIFO "EL SOL" ;SAC']
    assert rows[0]["UNIDAD"] == "Galones" and rows[0]["_corrupt"] is None


def test_other_header_is_rejected(spark, tmp_path):
    path = write(tmp_path / "a.csv", line("1", "0001"), header=HEADER.replace("MARCA", "BRAND"))
    with pytest.raises(delimited.ContractError):
        delimited.read_feed(spark, path, LPG)
    with pytest.raises(delimited.ContractError):
        delimited.read_feed(spark, path, LIQUID)


def test_second_file_with_other_header_fails(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", line("1", "0001"))
    write(folder / "b.csv", line("2", "0002"), header=HEADER.replace("UNIDAD", "MEDIDA"))
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_feed(spark, str(folder), LPG).collect()


def test_landing_counts_and_rejects_wrong_width(spark, tmp_path):
    good = write(tmp_path / "good.csv", line("1", "0001"), line("2", "0002", date="2026-09-24 01:00:00"))
    done = delimited.land(spark, good, LPG, str(tmp_path / "good"))
    assert done.rows == 2
    newest = delimited.as_reports(delimited.landed(spark, done.path, LPG), LPG).agg(F.max("reported_at")).first()[0]
    assert newest.isoformat() == "2026-09-24T06:00:00"
    bad = write(tmp_path / "bad.csv", line("1", "0001"), "2;only;three")
    with pytest.raises(delimited.ContractError, match="1 rows"):
        delimited.land(spark, bad, LPG, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad" / "rows" / "malformed=true")).count() == 1
    with pytest.raises(delimited.ContractError, match="no accepted landing"):
        delimited.landed(spark, str(tmp_path / "bad"), LPG)
    write(tmp_path / "bad.csv", line("1", "0001"))
    assert delimited.land(spark, bad, LPG, str(tmp_path / "bad")).rows == 1
    assert delimited.landed(spark, str(tmp_path / "bad"), LPG).count() == 1
    with pytest.raises(delimited.ContractError, match="landed"):
        delimited.land(spark, bad, LPG, str(tmp_path / "bad"))


def test_version_folder_with_other_content_fails(spark, tmp_path):
    rows = [(1, "regular", 5.0), (2, "premium", 6.0)]
    offers = spark.createDataFrame(rows, "id int, product string, price double")
    for held in (rows[:1], [*rows, (3, "diesel", 7.0)]):
        root = str(tmp_path / f"held{len(held)}")
        revision = versions.write_version(offers, str(tmp_path / f"scratch{len(held)}"), "p-", "s")
        spark.createDataFrame(held, offers.schema).write.parquet(f"{root}/offers/revision_id={revision}")
        with pytest.raises(ValueError, match="other content"):
            versions.write_version(offers, root, "p-", "s")
        assert not (tmp_path / f"held{len(held)}" / "manifest").exists()


def test_two_writers_commit_one_revision(spark, tmp_path, monkeypatch):
    """Both write the same content at once; each row of the manifest and of the version is there once."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    offers = spark.createDataFrame([(1, "regular", 5.0), (2, "premium", 6.0)], "id int, product string, price double")
    with ThreadPoolExecutor(4) as pool:
        found = set(pool.map(lambda _: versions.write_version(offers, root, "p-", "s"), range(4)))
    assert len(found) == 1
    revision = found.pop()
    assert versions.read_version(spark, root, revision).count() == 2
    manifest = versions.read_manifest(spark, root)
    assert manifest.count() == 2 and manifest.select("product").distinct().count() == 2
    assert [p.name for p in (tmp_path / "offers").iterdir()] == [f"revision_id={revision}"]
    # A writer that only comes to its commit when another has made it adds nothing.
    monkeypatch.setattr(versions, "exists", lambda spark, path: not path.endswith(".json") and session.exists(spark, path))
    assert versions.write_version(offers, root, "p-", "s") == revision
    assert versions.read_manifest(spark, root).count() == 2


def test_state_after_a_lost_batch_fails(spark, tmp_path):
    from pricewarden.streaming import state

    assert state.load_state(spark, str(tmp_path), before=0).isEmpty()
    with pytest.raises(Exception, match="(?i)path"):
        state.load_state(spark, str(tmp_path), before=7).count()


def test_minimised_feed_has_no_private_column(spark, tmp_path):
    rows = delimited.read_feed(spark, write(tmp_path / "a.csv", line("1", "0001")), LPG)
    kept = delimited.minimise(rows, LPG).columns
    assert kept[0] == "ID4" and not {"RUC", "RAZON_SOCIAL", "DIRECCION", "MARCA"} & set(kept) and len(kept) == 11


def test_profile_depends_on_content_only(spark, tmp_path):
    a = write(tmp_path / "a.csv", line("1", "0001"), line("2", "0002"))
    b = write(tmp_path / "b.csv", line("1", "0001"), line("2", "0002", price="7.50"))
    first, again, other = (delimited.profile(spark, p).first() for p in (a, a, b))
    assert first == again and first["lines"] == 3 and first["content_sha256"] != other["content_sha256"]


def test_prices_and_instants(spark):
    rows = spark.createDataFrame(
        [("7,49", "2026/09/23"), ("", "2026-02-30 10:00:00"), ("abc", "2026-02-32"), ("1e1", "23-09-2026"), ("1d", "")],
        "p string, t string",
    )
    got = rows.select(
        parse_price(F.col("p")).alias("p"), F.unix_seconds(parse_instant(F.col("t"))).alias("t")
    ).collect()
    assert [repr(r["p"]) for r in got] == ["7.49", "0.0", "nan", "10.0", "nan"]
    march = int(datetime(2026, 3, 2, 15, tzinfo=timezone.utc).timestamp())
    assert [r["t"] for r in got] == [int(datetime(2026, 9, 23, 5, tzinfo=timezone.utc).timestamp()), march, None, None, None]
    seen = spark.createDataFrame([("S/ 12,5",), ("12.34567",), ("S/12",), ("-3",)], "p string")
    assert [repr(r[0]) for r in seen.select(parse_captured_price(F.col("p"))).collect()] == ["12.5", "nan", "12.0", "nan"]


def build(spark, tmp_path, lines, registry=None, points=None):
    feed = delimited.read_feed(spark, write(tmp_path / "feed.csv", *lines), LPG)
    registry = registry or [("02", "0001"), ("15", "0002"), ("02", "0003")]
    points = points or [("35", "0001"), ("36", "0002"), ("35", "0003")]
    r = spark.createDataFrame(
        [(c, n, "LIMA", "LIMA", "MIRAFLORES") for c, n in registry],
        "code string, registration string, department string, province string, district string",
    )
    p = spark.createDataFrame(
        [(c, n, "LIMA", "LIMA", "MIRAFLORES", -77.03, -12.12) for c, n in points],
        "layer string, registration string, department string, province string, district string, "
        "longitude double, latitude double",
    )
    rules = rules_frame(spark, [rule for rule in RULES if rule.group == "glp"])
    return publish.build_products(
        delimited.as_reports(feed, LPG), delimited.as_identities(feed, LPG), r, p, rules,
        cutoff_at=CUTOFF, snapshot_id="s1", names=publish.Namespaces("ns|site", "ns|offer", "link-v1"),
    )


def reasons(built):
    return {r["registration"]: r["reason"] for r in built.staged.where("in_scope").select(
        "registration", funnel.loss_reason().alias("reason")).collect()}


def test_latest_is_chosen_before_scope_and_cutoff(spark, tmp_path):
    built = build(
        spark,
        tmp_path,
        [
            line("1", "0001"),
            line("2", "0001", date="2026-09-25 10:00:00"),  # a future report hides the good one
            line("3", "0003"),
            line("4", "0003", date="2026-09-23 11:00:00", province="CALLAO"),  # and so does one elsewhere
        ],
    )
    assert reasons(built) == {"0001": R.INVALID_REPORT}
    assert built.offers.count() == 0


def test_ties_conflicts_and_selection(spark, tmp_path):
    built = build(
        spark,
        tmp_path,
        [
            line("9", "0001"),
            line("5", "0001"),
            line("7", "0002", CENTRE),
            line("8", "0002", CENTRE, price="7.50"),
            line("6", "0003", price=""),
        ],
    )
    rows = {r["registration"]: r for r in built.staged.collect()}
    assert rows["0001"]["id"] == "5" and not rows["0001"]["price_conflict"]
    assert rows["0002"]["price_conflict"]
    assert reasons(built) == {"0001": R.PUBLISHED, "0002": R.CONFLICT, "0003": R.CONFLICT}


def test_two_labels_of_one_code_are_one_offer(spark, tmp_path):
    built = build(
        spark,
        tmp_path,
        [line("1", "0002", CENTRE), line("2", "0002", CENTRE_CNG, date="2026-09-23 12:00:00", price="8")],
    )
    offers = built.offers.collect()
    assert [(o["price"], o["product"]) for o in offers] == [(8.0, "glp")]
    assert offers[0]["id"].startswith("glp1_") and offers[0]["address"] == "Av. Larco 002"


def test_cardinality_is_never_resolved(spark, tmp_path):
    built = build(
        spark,
        tmp_path,
        [line("1", "0001"), line("2", "0002", CENTRE), line("3", "0003"), line("3", "0009", product="OTHER")],
        registry=[("02", "0001"), ("02", "0001"), ("15", "0002"), ("02", "0003")],
        points=[("36", "0002"), ("36", "0002"), ("35", "0003")],
    )
    assert reasons(built) == {"0001": R.NO_REGISTRY, "0002": R.NO_UNIQUE_POINT, "0003": R.REPEATED_ID}
    metrics = built.metrics.first()
    assert (metrics["registry_ambiguous"], metrics["gis_ambiguous"], metrics["raw_duplicate"]) == (1, 1, 1)
    assert sum(r["n"] for r in built.losses.collect()) == 3
    stages = {r["registration"]: r["stage"] for r in built.traces.collect()}
    assert stages == {"0001": R.NO_REGISTRY, "0002": R.NO_UNIQUE_POINT, "0003": R.REPEATED_ID}


def test_exclusions_and_expiry(spark, tmp_path):
    lines = [
        line("1", "0001", unit="Kilos"),
        line("2", "0002", CENTRE, client="Revendedor"),
        line("3", "0003", date="2026-08-24 18:59:59"),
    ]
    built = build(spark, tmp_path, lines)
    assert reasons(built) == {"0003": R.PUBLISHED_EXPIRED}
    feed = delimited.as_reports(delimited.read_feed(spark, str(tmp_path / "feed.csv"), LPG), LPG)
    rules = rules_frame(spark, [rule for rule in RULES if rule.group == "glp"])
    counts = reports.exclusion_counts(reports.select_candidates(feed, rules)).first()
    assert (counts["source_rows"], counts["other_unit"], counts["other_client"]) == (1, 1, 1)


def test_release_is_written_once_and_checked(spark, tmp_path):
    built = build(spark, tmp_path, [line("1", "0001"), line("2", "0002", CENTRE), line("3", "0003")])
    entries = spark.createDataFrame(
        [],
        "establishment_id string, brand string, public_site_name string, confidence string, link_status string, "
        "publication_status string",
    )
    rows = spark.createDataFrame([], "product string, observed_at timestamp, key_hash string, price double")
    offers = publish.compose(built.offers, entries, rows, CUTOFF)
    root = str(tmp_path / "out")
    options = {"prefix": "glp-", "snapshot_id": "s1", "id_pattern": r"^glp1_[a-f0-9]{24}$"}
    revision, problems = publish.release(offers, built.metrics, None, root, **options)
    assert revision.startswith("glp-s1-") and problems.count() == 0
    assert publish.release(offers, built.metrics, None, root, **options)[0] == revision
    manifest = versions.read_manifest(spark, root)
    assert manifest.count() == 1
    data = versions.read_version(spark, root, revision).withColumn("revision_id", F.lit(revision))
    assert versions.manifest_errors(data, manifest).count() == 0
    changed = data.withColumn("price", F.col("price") + 0.01)
    assert [r["problem"] for r in versions.manifest_errors(changed, manifest).collect()] == ["content_differs"]
    past = built.metrics.withColumn("fresh_offers", F.lit(100))
    blocked, why = publish.release(offers, built.metrics, past, root, **options)
    assert blocked is None and [r["reason"] for r in why.collect()] == ["offer_drop"]


def test_reference_checks(spark):
    registry = spark.createDataFrame(
        [("02", "1", "LIMA", "LIMA", "X"), ("02", "1", "LIMA", "LIMA", "X"), ("99", "2", "LIMA", "CALLAO", "")],
        "code string, registration string, department string, province string, district string",
    )
    points = spark.createDataFrame(
        [("35", "1", "LIMA", "LIMA", "X", -60.0, -12.0)],
        "layer string, registration string, department string, province string, district string, longitude double, "
        "latitude double",
    )
    found = reference.reference_errors(registry, points, ["02"], ["35"], "LIMA", "LIMA").collect()
    assert {(r["table"], r["rule"]): r["n"] for r in found} == {
        ("registry", "unique_key"): 1, ("registry", "texts"): 1, ("registry", "scope"): 1, ("registry", "code"): 1,
        ("points", "coordinates"): 1,
    }


def test_harvest_keeps_reading_order(spark, tmp_path):
    (tmp_path / "h.ndjson").write_text(
        '{"places":[{"id":"a","name":"Grifo Uno","info":["Gasolinera","Av. Grau 120"],"lat":-12.1,"lng":-77.0},{"id":""}]}\n'
        '{"places":[{"id":"a","name":"Grifo Dos Primax","info":["4,5","Abierto","Gasolinera","Jr. Lima"],"lat":-12.2,"lng":-77.0},'
        '{"id":"b","name":"Bodega","info":["Tienda"],"lat":-12.2,"lng":-77.0}]}\n'
    )
    from pricewarden.operators.matching import place_cards

    cards = place_cards(places.read_harvest(spark, str(tmp_path))).collect()
    assert [(c["place_id"], c["place_name"], c["brand"], c["address"]) for c in cards] == [
        ("a", "Grifo Dos Primax", "Primax", "Jr. Lima")
    ]


def test_directory_sources(spark):
    rows = spark.createDataFrame(
        [(0, "E1", "Av. 1", "SURCO", (-77.0, -12.0), "LIMA", "LIMA"), (1, "E2", "Av. 2", "X", (-77.0, -12.0), "ICA", "ICA")],
        "entry_index int, name string, address string, city string, location struct<lat: double, lng: double>, "
        "department string, state string",
    )
    entries = places.directory_entries(rows, places.DIRECTORY_SOURCES[0]).collect()
    assert [(e["entry_key"], e["latitude"], e["longitude"]) for e in entries] == [("repsol#0", -12.0, -77.0)]


def test_restricted_differences_count_repeats_in_tasks_of_bounded_rows(spark):
    """Both directions, repeats and missing values; 5,000 rows of few bytes are not compared in one task."""
    new = [("A", i) for i in range(3000)] + [("A", None)] * 3 + [("A", -1)] * 2500 + [("N", 7)]
    old = [("A", i) for i in range(5, 3010)] + [("A", None)] + [("A", -1)] * 100
    frame = lambda rows: spark.createDataFrame(rows, "code string, id int")
    found = reference.restricted_differences(frame(new), frame(old), F.col("code") != "N", task_rows=1000)
    got = {(r["difference"], r["id"]): r["n"] for r in found.groupBy("difference", "id").agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = {("added", i): 1 for i in range(5)} | {("lost", i): 1 for i in range(3000, 3010)} | {("added", None): 2, ("added", -1): 2400}
    assert got == expected and found.columns == ["difference", "code", "id"]
    assert found.rdd.getNumPartitions() == 9  # 8,608 rows of both
    same = reference.restricted_differences(frame(old), frame(old), F.lit(True))
    assert same.isEmpty()
