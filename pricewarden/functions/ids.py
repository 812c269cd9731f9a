"""Deterministic identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE_PREFIX = "est_"


def hex_digest(*parts: Column | str) -> Column:
    columns = [F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)


def site_id(registration: Column, namespace: str) -> Column:
    """Public id of a site, derived from its trimmed registration; null when there is none."""
    key = F.trim(registration.cast("string"))
    return F.when(key != "", F.concat(F.lit(SITE_PREFIX), F.substring(hex_digest(namespace, key), 1, 24)))


def offer_id(
    prefix: Column | str,
    namespace: Column | str,
    snapshot: Column | str,
    product: Column | str,
    registration: Column,
    activity: Column,
) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.substring(hex_digest(namespace, snapshot, product, registration, activity), 1, 24))


def canonical_json(**fields: Column) -> Column:
    """One JSON object with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def claim_sha256(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def name_claim_sha256() -> Column:
    return claim_sha256(
        establishment_id=F.col("establishment_id"),
        public_site_name=F.col("public_site_name"),
        confidence=F.col("confidence"),
    )


def brand_claim_sha256() -> Column:
    evidence = F.when(
        F.col("evidence_method").isNotNull(),
        F.struct(
            F.col("consulted_at").alias("consulted_at"),
            F.col("evidenced_at").alias("evidenced_at"),
            F.col("evidence_method").alias("method"),
            F.col("evidence_reference").alias("reference"),
        ),
    )
    return claim_sha256(
        establishment_id=F.col("establishment_id"), brand=F.col("brand"), brand_evidence=evidence
    )


# --- content of a whole table -------------------------------------------------------------------

LANES = 8


def row_sha256(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    fields = {name: F.col(name) for name in df.columns if name not in exclude}
    return F.sha2(canonical_json(**fields), 256)


def content_digest(df: DataFrame, by: list[str], digest: Column, rows: str = "rows") -> DataFrame:
    """Rows and hash of the content of each group, whatever its order and file layout.

    The eight 32-bit words of the row hashes are added up: a sum ignores order, counts repeats and
    leaves one row per task, so a table of any size needs no sort and no concatenation in one place.
    Words add up as longs within 256 buckets and only then as decimals, which keeps the pass over the
    rows in generated code and exact up to 2^31 rows per bucket; beyond that the sum fails, never wraps.
    """
    names = [f"_lane_{lane}" for lane in range(LANES)]
    words = [
        F.sum(F.conv(F.substring("_sha", 1 + 8 * lane, 8), 16, 10).cast("long")).alias(name)
        for lane, name in enumerate(names)
    ]
    bucketed = (
        df.withColumn("_sha", digest)
        .groupBy(*by, F.substring("_sha", 1, 2).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_rows"), *words)
    )
    totals = bucketed.groupBy(*by).agg(
        F.sum("_rows").alias(rows), *[F.sum(F.col(n).cast("decimal(28,0)")).alias(n) for n in names]
    )
    texts = [F.col(n).cast("decimal(38,0)").cast("string") for n in names]
    return totals.select(*by, rows, F.sha2(F.concat_ws("|", F.col(rows).cast("string"), *texts), 256).alias("sha256"))
