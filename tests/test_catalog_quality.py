"""Catalog building, evidence gates, contracts and scans."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pricewarden.config import baselines_frame
from pricewarden.functions import addresses as A
from pricewarden.functions.ids import brand_claim_sha256, name_claim_sha256, site_id
from pricewarden.functions.stats import wilson_lower_bound
from pricewarden.functions.text import canonical_region, link_key, link_text, repair_mojibake
from pricewarden.operators import catalog, quality
from pricewarden.plans.identity import build_entries

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
MATCH = "site_id string, place_id string, place_name string, legal_name string, status string, distance_m double"
VERDICT = "site_id string, brand string, result string, selection_reason string"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


# --- texts --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, shown",
    [
        ("AV. JAVIER PRADO ESTE N° 4350, URB. CAMACHO", "Av. Javier Prado Este 4350"),
        ("ESQ. AV. GRAU CON JR. LIMA", "Av. Grau con Jr. Lima"),
        ("FRENTE A LA AV. DE LA MARINA NRO. 3810-A", "Av. de la Marina 3810"),
        ("CARRETERA CENTRAL KM. 14.5 MZ. A LOTE 3", "Carretera Central Km. 14.5"),
        ("JR. UNO   (ALTURA PUENTE)", "Jr. Uno"),
        ("MZ. C LOTE 5 AA.HH. LOS OLIVOS", "Mz. C Lote 5"),
        ("   ", None),
        (None, None),
        ("AV. PROLONGACION INDEPENDENCIA DE LOS LIBERTADORES DEL NORTE 1200", "Av. Prolongacion Independencia de los…"),
        # Words glued to marks and numbers.
        ("AV. LIMA 100 MZ.A LT.5", "Av. Lima 100"),
        ("AV. LIMA 100 URB.SANTA ROSA", "Av. Lima 100"),
        ("JR. UNION 200(ALT. CDRA 2)", "Jr. Union 200"),
        ("JR. UNION 200,SUB LOTE 3", "Jr. Union 200"),
        ("FRENTE LA PLAZA 100", "Frente La Plaza 100"),
        ("FRENTE A PLAZA 100", "Plaza 100"),
        ("ALTURA DE LA PLAZA 100", "Plaza 100"),
        ("ALTURA PLAZA 100", "Altura Plaza 100"),
        ("ESQ.AV. GRAU/JR.LIMA", "Av. Grau/jr.lima"),
        ("ESQUIVEL 120", "Esquivel 120"),
        ("AV.GRAU Nº120-A-B", "Av.grau 120"),
        ("AV GRAU N°120 - 130 – C", "Av. Grau 120"),
        ("JR. X NRO.45", "Jr. X 45"),
        ("AA.HH. LOS OLIVOS", "AA.HH. Los Olivos"),
        ("AAHH LOS OLIVOS MZ A", "AA.HH. Los Olivos Mz. a"),
        ("AV. A AA.HH.LOS", "Av. a Aa.hh.los"),
        ("AV. GRANDE AA.HH.LOS", "Av. Grande"),
        ("KM14.5 CARRETERA CENTRAL-", "Km. 14.5 Carretera Central"),
        ("URB, X", "Urb, X"),
        ("CALLE DEL EL SOL DE ORO, Y MAS", "Calle del el Sol de Oro"),
        ("esquina", None),
        ("A" * 60, "A" + "a" * 44 + "…"),
        ("...", None),
    ],
)
def test_display_address(spark, raw, shown):
    assert one(spark, raw, A.display_address) == shown


@pytest.mark.parametrize(
    "raw, shown",
    [
        # Letters whose capitals are others, letters beyond U+FFFF, and marks that are letters in capitals only.
        ("LOS OLIVOS eſq UNION", "Los Olivos"),
        ("AV LIMA 12 İNTERSECCION 5 AſOC X", "Av. Lima 12 I\u0307nterseccion 5"),
        ("\U00010428URB LIMA 12", "\U00010400urb Lima 12"),
        ("LOS OLIVOS \U00010428LOTE 12", "Los Olivos \U00010400lote 12"),
        ("ESQ \u0345 DE LIMA", "De Lima"),
        ("FRENTEA LIMA 12", "Frentea Lima 12"),
        ("ESQºDE LIMA", "ºde Lima"),
        # Longer than what is shown: the end of the words kept is not the end of the text.
        ("X " + "AV LOS " * 30 + "AV", "X" + " Av. Los" * 5 + "…"),
        ("A" * 30 + "-" * 30 + "\x85.", "A" + "a" * 29 + "\x85"),
        ("AV " + "B" * 20 + " - " * 20 + "C", "Av. B" + "b" * 19 + " -" * 10 + "…"),
    ],
)
def test_display_address_of_odd_and_long_texts(spark, raw, shown):
    assert one(spark, raw, A.display_address) == shown


def test_display_address_makes_no_list_of_tokens(spark):
    """A value for every word, mark and blank of a line is dear by the byte; only the few words shown are a list."""
    plan = spark.range(1).select(A.display_address(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize(
    "raw, backed, shown",
    [
        ("GRIFO PRIMAX LOS OLIVOS", False, "Grifo los Olivos"),
        ("Primax Los Olivos", True, "Primax Los Olivos"),
        ("Estación de Servicio Petroperú", False, None),
        ("grifo san juan gnv", False, "Grifo San Juan"),
        ("GNV", False, "GNV"),
        ("Grifo Petroperu - La Molina (Petroperu)", False, "Grifo - La Molina"),
        ("INVERSIONES Y SERVICIOS GENERALES DEL NORTE GRANDE S.A.C.", False, "Inversiones y Servicios Generales del…"),
        # Letters and digits bound a brand, not blanks.
        ("Primax-Norte", False, "Norte"),
        ("Primax-Norte", True, "Primax-Norte"),
        ("PRIMAX/REPSOL SUR", False, "/repsol SUR"),
        ("El Cortijo-gnv", False, "El Cortijo"),
        ("El Cortijo · GNV , glp", False, "El Cortijo · GNV"),
        ("Primaxis Sur", False, "Primaxis Sur"),
        ("(PETROPERÚ) SAN JUAN, GLP", False, "SAN JUAN"),
        ("Los Andes (Primax)", False, "Los Andes"),
        ("Grifo GNV", False, "Grifo GNV"),
        ("GaSpetrol del Sur", False, "GaSpetrol del Sur"),
        ("B" * 60, True, "B" + "b" * 42 + "…"),
        ("   ", False, None),
        (None, True, None),
    ],
)
def test_display_name(spark, raw, backed, shown):
    assert one(spark, raw, lambda c: A.display_name(c, F.lit(backed))) == shown


def test_folding_and_keys(spark):
    assert one(spark, "  Ñandú \t del  Perú ﬁn ", link_text) == "NANDU DEL PERU FIN"
    assert one(spark, "ñ é", link_text) == "N E"
    assert one(spark, "Jesús MarÃ­a", repair_mojibake) == "Jesús María"
    assert one(spark, "Cercado  de Lima", canonical_region) == "LIMA"
    body = 'link-v1|' + json.dumps(["EL \"SOL\" SAC", "AV. LIMA 1/2", "ATE"], separators=(",", ":"))
    expected = hashlib.sha256(body.encode()).hexdigest()[:32]
    assert one(spark, 'El  "Sól" sac', lambda c: link_key(c, F.lit("av. lima 1/2"), F.lit("Ate"), "link-v1")) == expected
    assert one(spark, " ", lambda c: link_key(c, F.lit("a"), F.lit("b"), "link-v1")) is None
    assert one(spark, " 0001 ", lambda c: site_id(c, "ns")) == "est_" + hashlib.sha256(b"ns|0001").hexdigest()[:24]
    assert one(spark, " ", lambda c: site_id(c, "ns")) is None


def test_claim_hash_is_canonical(spark):
    row = spark.createDataFrame(
        [("est_1", None, "nearby", "Primax", None)],
        "establishment_id string, public_site_name string, confidence string, brand string, evidence_method string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("evidence_reference", "evidenced_at", "consulted_at")})
    got = row.select(name_claim_sha256().alias("n"), brand_claim_sha256().alias("b")).first()
    name = json.dumps({"confidence": "nearby", "establishment_id": "est_1", "public_site_name": None}, separators=(",", ":"))
    brand = json.dumps({"brand": "Primax", "brand_evidence": None, "establishment_id": "est_1"}, separators=(",", ":"))
    assert got["n"] == hashlib.sha256(name.encode()).hexdigest()
    assert got["b"] == hashlib.sha256(brand.encode()).hexdigest()


def test_wilson(spark):
    rows = spark.createDataFrame([(20, 20), (18, 20), (0, 5), (0, 0)], "k int, n int")
    got = [round(r[0], 3) for r in rows.select(wilson_lower_bound(F.col("k"), F.col("n"))).collect()]
    assert got == [0.839, 0.699, 0.0, 0.0]


# --- evidence and entries -----------------------------------------------------------------------


def matches(spark, *rows):
    return spark.createDataFrame([(s, f"place-{s}", name, legal, status, d) for s, name, legal, status, d in rows], MATCH)


def test_gates(spark):
    m = matches(
        spark,
        ("a", "Grifo Repsol", "X SAC", "verified", 10.0),
        ("b", "Grifo Repsol", "X SAC", "verified", 10.0),
        ("c", "Grifo Sol", "COESTI S.A.", "verified", 10.0),
        ("d", "Primax Sol", "X SAC", "verified", 10.0),
    )
    evidence = spark.createDataFrame(
        [(s, "Primax", "s1") for s in "abcd"] + [("e", "Primax", "s2"), ("f", "Primax", None)],
        "site_id string, brand string, stratum string",
    )
    verdicts = spark.createDataFrame(
        [("a", "Primax", "verified", "random_sample"), ("b", None, "incorrect", "risk_sample")], VERDICT
    )
    got = {r["site_id"]: r["withheld"] for r in catalog.gate_evidence(evidence, m, verdicts).collect()}
    assert got == {"a": None, "b": catalog.CLASH_REJECTED, "c": None, "d": None, "e": catalog.STRATUM_UNSAMPLED, "f": None}


def test_observed_signs(spark):
    m = matches(spark, *[(s, "Grifo", "X SAC", "verified", 10.0) for s in "abcdefgh"], ("i", "G", "X", "conflict", 10.0))
    seen = spark.createDataFrame(
        [(str(i), site, brand, month, T0, place) for i, (site, brand, month, place) in enumerate([
            ("a", "Marca Nueva", "2026-08", "place-a"), ("b", "PECSA", "2026-13", "place-b"), ("c", "Pecsa", "2025-01", "place-c"),
            ("d", "Pecsa", "2026-10", "place-d"), ("e", "Pecsa", "2026-08", "elsewhere"), ("i", "Pecsa", "2026-08", "place-i"),
            ("f", "Pecsa", "2026-08", "place-f"), ("g", "Pecsa", "2026-08", "place-g"), ("h", "Pecsa", "2026-08", "place-h"),
            ("a", "Pecsa", "2026-08", "place-a")])],
        "observation_id string, site_id string, brand string, image_month string, consulted_at timestamp, place_id string",
    )
    verdicts = spark.createDataFrame(
        [("f", "Pecsa", "incorrect", "risk_sample"), ("h", "pecsa", "verified", "risk_sample"), ("a", None, "verified", "x")],
        VERDICT,
    )
    known = spark.createDataFrame(
        [("h", "Primax", None, None, None)],
        "site_id string, evidence_brand string, base_brand string, pending_brand string, pending_reason string",
    )
    reviewed = datetime(2026, 9, 10, tzinfo=timezone.utc)
    got = catalog.judge_observations(seen, m, verdicts, known, reviewed).orderBy(F.col("observation_id").cast("int"))
    assert [r["outcome"] for r in got.collect()] == [
        "marca_desconocida", "sin_fecha_de_imagen", "imagen_de_mas_de_12_meses", "consulta_anterior_a_la_imagen",
        "ficha_de_otro_establecimiento", "identidad_sin_corroborar", "rechazada_en_revision", "sin_revision_independiente",
        "contradice_otra_evidencia", "incorporated",
    ]


def test_entries(spark):
    m = matches(
        spark,
        ("a", "GRIFO PRIMAX EL SOL", "COESTI S.A.", "verified", 60.0),  # the operator backs the brand
        ("b", "GRIFO PRIMAX LA LUNA", "X SAC", "verified", 60.0),  # nobody does
        ("c", "REPSOL EL MAR", "REPSOL COMERCIAL SAC", "candidate", 39.6),  # its directory is withheld as a clash
        ("d", "Estación Primax", "X SAC", "verified", 5.0),  # backed, but the name says nothing else
        ("e", "Grifo Lejano", "X SAC", "candidate", 41.0),  # too far to be nearby
        ("f", "Grifo Blanco", "X SAC", "verified", 5.0),  # the directory fills the blank
        ("g", "Grifo Rojo Primax", "COESTI S.A.", "verified", 5.0),  # a review found the brand wrong
        ("h", "Grifo Verde", "X SAC", "verified", 5.0),  # published under the same name with its brand
    )
    evidence = spark.createDataFrame(
        [("c", "Primax", None), ("d", "Primax", None), ("f", "Primax", None), ("z", "Repsol", None), ("h", "Repsol", None)],
        "site_id string, brand string, stratum string",
    )
    verdicts = spark.createDataFrame([("g", "Primax", "incorrect", "risk_sample")], VERDICT)
    base = spark.createDataFrame(
        [("h", "Repsol", "Repsol Grifo Verde"), ("c", "Pecsa", "El Mar"), ("a", None, "Otro Nombre")],
        "site_id string, base_brand string, base_name string",
    )
    entries, withheld = build_entries(m, evidence, verdicts, base)
    got = {r["site_id"]: r for r in entries.collect()}
    shown = {s: (r["brand"], r["public_site_name"], r["confidence"]) for s, r in got.items()}
    assert shown == {
        "a": ("Primax", "Grifo Primax el SOL", "verified"),
        "b": (None, "Grifo la LUNA", "verified"),
        "c": ("Repsol", "El Mar", "nearby"),
        "d": ("Primax", None, "verified"),
        "f": ("Primax", "Grifo Blanco", "verified"),
        "g": (None, "Grifo Rojo", "verified"),
        "h": ("Repsol", "Repsol Grifo Verde", "verified"),
        "z": ("Repsol", None, "verified"),
    }
    assert [r["site_id"] for r in withheld.collect()] == ["c"]
    assert got["g"]["brand_removed"] and got["a"]["name_changed"] and not got["h"]["name_changed"]


def test_inherited_verdicts(spark):
    schema = "site_id string, claim string, result string"
    old = spark.createDataFrame([("a", "brand", "incorrect"), ("b", "brand", "incorrect"), ("c", "brand", "incorrect"),
                                 ("d", "name", "incorrect")], schema)
    now = spark.createDataFrame([("b", "brand", "verified")], schema)
    entries = spark.createDataFrame([("a", None), ("b", None), ("c", "Primax")], "site_id string, brand string")
    assert [r["site_id"] for r in catalog.inherited_verdicts(old, now, entries).collect()] == ["a"]


def test_empty_registry_is_an_error(spark):
    frame = spark.createDataFrame([("x",)], "establishment_id string")
    with pytest.raises(ValueError):
        catalog.catalog_projection(frame, frame.where("false"), frame)


def test_verdict_outside_the_catalog_voids_the_audit(spark):
    entries = spark.createDataFrame(
        [("est_a", "Sol", "verified", "verified", "publishable", None)],
        "establishment_id string, public_site_name string, confidence string, link_status string, "
        "publication_status string, brand string",
    )
    tiers = spark.createDataFrame([("verified", 1, 0.9, 0.8)], "confidence string, population long, lower_bound_95 double, threshold double")
    verdicts = spark.createDataFrame([("est_z", "name", "verified", "0")], "establishment_id string, claim string, result string, entry_sha256 string")
    approved, problems = catalog.name_backing(entries, tiers, verdicts)
    assert approved.count() == 0 and problems.first()["reason"] == "audit_entry_outside_catalog"
    approved, problems = catalog.name_backing(entries, tiers, verdicts.where("false"))
    assert approved.count() == 1 and problems.count() == 0


# --- contracts ----------------------------------------------------------------------------------

GOOD = {
    "entry_index": 0, "establishment_id": "est_" + "a" * 24, "brand": "Primax", "public_site_name": "Sol",
    "confidence": "verified", "source_kind": "first_party", "acquisition_method": "first_party_publication",
    "source_description": "d", "source_responsible": "r", "observed_at": T0, "link_method": "official_establishment_id_exact",
    "link_status": "verified", "verified_at": T0, "identity_freshness": "current", "publication_status": "publishable",
    "reviewed_at": T0 + timedelta(days=300), "publication_responsible": "r", "evidence_method": "official_directory",
    "evidence_reference": "ref", "evidenced_at": T0, "consulted_at": T0,
}
CATALOG = ", ".join(
    f"{k} {'int' if k == 'entry_index' else 'timestamp' if k.endswith('_at') else 'string'}" for k in GOOD
)


def entries_frame(spark, *changes):
    rows = [tuple({**GOOD, "entry_index": i, "establishment_id": "est_" + f"{i:024x}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, CATALOG)


def test_catalog_contract(spark):
    same = {"establishment_id": "est_" + "f" * 24}
    frame = entries_frame(
        spark,
        {},
        {"establishment_id": "est_x"},
        {"brand": None, "public_site_name": None, "evidence_method": None},
        {"acquisition_method": "open_dataset"},
        {"link_status": "pending", "verified_at": None},
        {"verified_at": T0 - timedelta(days=1)},
        {"publication_status": "pending"},
        {"brand": None},
        {"reviewed_at": T0 + timedelta(days=366)},
        {"consulted_at": T0 - timedelta(seconds=1)},
        same,
        same,
    )
    good, broken = quality.isolate_catalog(frame)
    assert [r["entry_index"] for r in good.collect()] == [0]
    found = {}
    for r in broken.collect():
        found.setdefault(r["entry_index"], set()).add(r["rule"])
    assert found == {
        1: {"establishment_id"}, 2: {"brand_or_name"}, 3: {"acquisition_method"}, 4: {"publishable_is_verified"},
        5: {"verified_after_observed"}, 6: {"pending_has_no_review"}, 7: {"evidence_needs_brand"},
        8: {"evidence_within_a_year"}, 9: {"consulted_after_evidence"}, 10: {"duplicate"}, 11: {"duplicate"},
    }


def test_audit_contract(spark):
    tiers = spark.createDataFrame(
        [(1, 100, 20, 18, 0.699, 0.8), (2, 100, 19, 18, 0.754, 0.8), (3, 10, 20, 18, 0.699, 0.8), (4, 100, 20, 18, 0.9, 0.8)],
        "k int, population int, sampled int, correct int, lower_bound_95 double, threshold double",
    )
    got = {(r["k"], r["rule"]) for r in quality.violations(tiers, quality.tier_rules(), "k").collect()}
    assert got == {(2, "sampled"), (3, "sample_within_population"), (4, "bound_matches")}
    verdicts = spark.createDataFrame(
        [("est_" + "a" * 24, "b" * 64, "name", "verified", "random_sample", "verified", "me", T0),
         ("est_a", "b", "colour", "sure", "why", "maybe", "", None)],
        "establishment_id string, entry_sha256 string, claim string, confidence string, selection_reason string, "
        "result string, reviewer string, reviewed_at timestamp",
    )
    assert {r["rule"] for r in quality.violations(verdicts, quality.verdict_rules(), "establishment_id").collect()} == set(
        quality.verdict_rules()
    )


def test_summary_contract(spark):
    day = datetime(2026, 9, 1).date()
    sha = "a" * 64
    rows = [
        (day, "o1", T0, "r", sha, T0, T0, 5.0, 2),
        (day + timedelta(days=1), None, None, None, None, None, None, None, None),
        (day + timedelta(days=2), "o3", T0, "r", "zz", T0 + timedelta(hours=1), T0, None, 2),
    ]
    frame = spark.createDataFrame(
        rows,
        "date date, observation_id string, observed_at timestamp, revision_id string, archive_hash string, "
        "cutoff_at timestamp, source_max_reported_at timestamp, mean_regular double, n_regular int",
    )
    got = {r["rule"] for r in quality.violations(frame, quality.summary_day_rules(["regular"]), "date").collect()}
    assert got == {"observation", "observed_after_cutoff", "mean_with_n_regular"}
    stamp = F.lit("2026-09-04 04:59:59").cast("timestamp")
    whole = quality.summary_frame(frame, stamp, 3).first()
    assert (whole["declared_days"], whole["consecutive"], whole["ends_today"]) == (True, True, True)
    holed = quality.summary_frame(frame.where("observation_id IS NOT NULL"), stamp, 3).first()
    assert (holed["declared_days"], holed["consecutive"]) == (False, False)


def test_release_guards(spark):
    schema = (
        "product string, fresh_offers long, contract_ready_offers long, contract_ready_districts long, coverage_percent double, "
        "latest_price_conflicts long, latest_territory_conflicts long, published_districts long, source_max_reported_at timestamp"
    )
    good = ("regular", 80, 75, 10, 93.75, 0, 0, 41, T0)
    make = lambda *rows: spark.createDataFrame(rows, schema)
    past = make(("regular", 100, 99, 10, 98.75, 0, 0, 43, T0))
    reasons = lambda frame: {r["product"]: r["reasons"] for r in frame.collect()}
    assert reasons(quality.release_quality(make(good), past)) == {"regular": []}
    worse = ("regular", 79, 74, 10, 93.7, 1, 0, 40, T0 - timedelta(days=1))
    assert reasons(quality.release_quality(make(worse), past)) == {"regular": ["price_conflicts", "offer_drop", "coverage_drop"]}
    assert reasons(quality.first_release(make(good), past)) == {"regular": []}
    assert reasons(quality.first_release(make(worse), past))["regular"][-2:] == ["source_older_than_baseline", "district_loss"]
    none = make(("regular", 0, 0, 0, 0.0, 0, 0, 0, T0))
    assert reasons(quality.release_quality(none, past.where("false"))) == {
        "regular": ["no_fresh_offers", "no_ready_offers", "no_ready_districts", "invalid_coverage"]
    }
    later, same = F.lit(T0 + timedelta(days=1)), F.lit(T0)
    row = spark.range(1).select(
        quality.source_advance(later, same).alias("a"), quality.source_advance(same, same).alias("b"),
        quality.source_advance(same, same, True).alias("c"), quality.source_advance(same, later).alias("d"),
    ).first()
    assert tuple(row) == (None, "source_did_not_advance", None, "source_went_back")


def test_first_releases_start_from_the_audited_baselines(spark):
    baselines = baselines_frame(spark)
    same = baselines.withColumns({"latest_price_conflicts": F.lit(0), "latest_territory_conflicts": F.lit(0)})
    assert {r["product"]: r["reasons"] for r in quality.first_release(same, baselines).collect()} == {"diesel": [], "glp": [], "gnv": []}
    fewer = same.withColumn("fresh_offers", F.floor(F.col("fresh_offers") * 0.79)).withColumn("published_districts", F.lit(1).cast("long"))
    assert {tuple(r["reasons"]) for r in quality.first_release(fewer, baselines).collect()} == {("offer_drop", "district_loss")}


def test_older_formats_need_less():
    assert "live" not in quality.offer_rules("x", quality.flags_for("2.6.0"))
    assert set(quality.offer_rules("x", quality.flags_for("2.0.0"))) == {"id", "price", "reported_at", "district", "coordinates"}
    assert "identity" in quality.offer_rules("x", quality.flags_for("9.9.9"))


def test_sensitive_kinds(spark):
    texts = {
        "absolute_path": "see /home/me/x",
        "private_key": "-----BEGIN RSA PRIVATE " + "KEY-----",
        "cloud_key": "AKIA" + "ABCDEFGHIJKLMNOP",
        "bearer_token": "Authorization: Bearer abc.def",
        "assigned_secret": "api_key = 'abcdefgh1'",
        "email": "write to someone@example.test now",
        "tax_id": "RUC 20123456789.",
        "clean": "nothing here",
    }
    rows = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {(r["k"], r["kind"]) for r in quality.sensitive_scan(rows, "k", "t").collect()}
    assert got == {(k, k) for k in texts if k != "clean"}
    sized = quality.sensitive_scan(rows, "k", "t", max_bytes=25).where("kind = 'oversized'").collect()
    assert {r["k"] for r in sized} == {k for k, t in texts.items() if len(t) > 25}
