"""Reference tables: licences and points cut to what the groups need, and checks on the cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewarden.operators import quality

REGISTRY_COLUMNS = ("code", "registration", "department", "province", "district")
POINT_COLUMNS = ("layer", "registration", "department", "province", "district", "longitude", "latitude")


def _scope(department: str, province: str) -> Column:
    return (F.col("department") == department) & (F.col("province") == province)


def build_registry(licences: DataFrame, codes: Sequence[str], department: str, province: str) -> DataFrame:
    kept = licences.where(F.col("code").isin(list(codes)) & _scope(department, province))
    return kept.select(*REGISTRY_COLUMNS)


def build_points(points: DataFrame, layers: Sequence[str], department: str, province: str) -> DataFrame:
    kept = points.where(F.col("layer").isin(list(layers)) & _scope(department, province))
    return kept.select(
        *POINT_COLUMNS[:5], *[F.col(c).try_cast("double").alias(c) for c in ("longitude", "latitude")]
    )


# Rows that a task is meant to compare, and copies of a row that are written at a time.
TASK_ROWS = 500_000
COPIES = 1_000


def restricted_differences(new: DataFrame, old: DataFrame, restriction: Column, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows by which the new table, restricted to what the old one covers, differs from the old one.

    Empty means the new reference only adds. Both directions count repeats, and both come from one count of every row. Keys of
    whole rows hardly fold and take far more room than their bytes in a shuffle, so there is a task for every `task_rows` rows.
    """
    columns = new.columns
    rows = new.where(restriction).withColumn("_n", F.lit(1)).unionByName(old.select(*columns, F.lit(-1).alias("_n")))
    tasks = rows.count() // task_rows + 1
    counted = rows.repartition(tasks, *columns).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    # Copies are written in batches, so that a row repeated without end is no long list.
    batches = counted.withColumn("_first", F.explode(F.sequence(F.lit(0), F.abs("_n") - 1, F.lit(COPIES))))
    copies = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.abs("_n") - F.col("_first"))))
    difference = F.when(F.col("_n") > 0, F.lit("added")).otherwise(F.lit("lost"))
    return batches.withColumn("_copy", copies).select(difference.alias("difference"), *columns)


def missing_references(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configured codes or layers that the reference does not hold at all."""
    return wanted.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti")


def reference_errors(
    registry: DataFrame,
    points: DataFrame,
    codes: Sequence[str],
    layers: Sequence[str],
    department: str,
    province: str,
) -> DataFrame:
    """Contract of both reference tables as counts per rule, repeated keys included."""
    parts = []
    for name, rows, rules, keys in (
        ("registry", registry, quality.registry_rules(codes, department, province), ["code", "registration"]),
        ("points", points, quality.point_rules(layers, department, province), ["layer", "registration"]),
    ):
        counted = quality.violation_counts(rows, rules)
        repeated = (
            rows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"))
            .where("_n > 1")
            .agg(F.lit("unique_key").alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
            .where("n > 0")
        )
        parts.append(counted.unionByName(repeated).select(F.lit(name).alias("table"), "rule", "n"))
    return parts[0].unionByName(parts[1])
