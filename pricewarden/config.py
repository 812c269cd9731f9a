"""What is published: products, the activities that may sell them, and the release guardrails.

Values are plain data. They become one small frame (a row per group, product and activity) that
every report operator joins, so all groups are computed from a single scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LAYER = "35"


@dataclass(frozen=True)
class ProductRule:
    group: str
    product: str
    canonical: str
    unit: str
    activities: dict[str, str]
    client_type: str | None = None
    layers: dict[str, str] = field(default_factory=dict)
    department: str = "LIMA"
    province: str = "LIMA"
    id_prefix: str = ""


@dataclass(frozen=True)
class Guardrails:
    max_offer_drop: float = 0.2
    max_coverage_drop_points: float = 5.0
    max_district_loss: int = 2


# Names as the feeds print them, and the registry code of every activity.
STATION_ACTIVITIES = {
    "ESTACIÓN DE SERVICIOS / GRIFOS": "01",
    "ESTACIÓN DE SERVICIO CON GASOCENTRO DE GLP": "02",
    "EE.SS con GNV": "05",
    "EE.SS con GLP y GNV": "06",
}
LPG_ACTIVITIES = {
    "ESTACIÓN DE SERVICIO CON GASOCENTRO DE GLP": "02",
    "EE.SS con GLP y GNV": "06",
    "GASOCENTROS DE GLP": "15",
    "GASOCENTRO DE GLP CON ESTABLECIMIENTO DE VENTA AL PUBLICO DE GNV": "15",
}
CNG_ACTIVITIES = {
    "EE.SS con GNV": "05",
    "EE.SS con GLP y GNV": "06",
    "GASOCENTRO DE GLP CON ESTABLECIMIENTO DE VENTA AL PUBLICO DE GNV": "15",
    "ESTABLECIMIENTO DE VENTA AL PUBLICO DE GNV": "59",
}
GALLONS = "Galones"
CUBIC_METRES = "Metros Cúbicos"

RULES = (
    ProductRule("gasolina", "regular", "GASOHOL REGULAR", GALLONS, STATION_ACTIVITIES, id_prefix="g2_"),
    ProductRule("gasolina", "premium", "GASOHOL PREMIUM", GALLONS, STATION_ACTIVITIES, id_prefix="g2_"),
    ProductRule("diesel", "diesel", "Diesel B5 S-50 UV", GALLONS, STATION_ACTIVITIES, id_prefix="d1_"),
    ProductRule(
        "glp",
        "glp",
        "GLP - G",
        GALLONS,
        LPG_ACTIVITIES,
        client_type="Usuario Final",
        layers={"02": "35", "06": "35", "15": "36"},
        id_prefix="glp1_",
    ),
    ProductRule(
        "gnv",
        "gnv",
        "GAS NATURAL VEHICULAR COMPRIMIDO",
        CUBIC_METRES,
        CNG_ACTIVITIES,
        layers={"05": "35", "06": "35", "15": "36", "59": "36"},
        id_prefix="gnv1_",
    ),
)
VIEWS = {"gasolina": ("regular", "premium"), "diesel": ("diesel",), "glp": ("glp",), "gnv": ("gnv",)}
# What each group's first release is measured against.
FIRST_RELEASE_BASELINES = (
    # product, source maximum, fresh offers, fresh districts, ready offers, ready districts, coverage, published
    ("diesel", "2026-09-24T04:59:31Z", 752, 43, 714, 43, 94.947, 732, 43),
    ("glp", "2026-09-24T04:59:31Z", 449, 41, 415, 41, 92.428, 425, 41),
    ("gnv", "2026-09-24T04:59:31Z", 238, 36, 212, 36, 89.076, 244, 36),
)

BASELINE_SCHEMA = (
    "product string, source_max_reported_at string, fresh_offers long, fresh_districts long, contract_ready_offers long, "
    "contract_ready_districts long, coverage_percent double, published_offers long, published_districts long"
)


def baselines_frame(spark: SparkSession) -> DataFrame:
    """One row per product whose first release is measured against an audited state."""
    rows = spark.createDataFrame(list(FIRST_RELEASE_BASELINES), BASELINE_SCHEMA)
    return rows.withColumn("source_max_reported_at", F.to_timestamp("source_max_reported_at"))


RULE_SCHEMA = (
    "group string, product string, canonical string, unit string, client_type string, activity string, "
    "code string, layer string, department string, province string, id_prefix string"
)


def rules_frame(spark: SparkSession, rules: Iterable[ProductRule] = RULES) -> DataFrame:
    """One row per (group, product, activity). Its size is the configuration's, never the data's."""
    rows = [
        (
            rule.group,
            rule.product,
            rule.canonical,
            rule.unit,
            rule.client_type,
            activity,
            code,
            rule.layers.get(code, DEFAULT_LAYER),
            rule.department,
            rule.province,
            rule.id_prefix,
        )
        for rule in rules
        for activity, code in rule.activities.items()
    ]
    for rule in rules:
        if not rule.canonical or rule.unit not in (GALLONS, CUBIC_METRES):
            raise ValueError(f"unusable product: {rule.product}")
    return spark.createDataFrame(rows, RULE_SCHEMA)
