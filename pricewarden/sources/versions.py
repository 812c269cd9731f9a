"""Content-addressed versions: the revision is the content, and its commit comes last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewarden.functions.ids import content_digest, row_sha256
from pricewarden.session import cut_lineage, exists, move, put_if_absent, remove

MANIFEST = "manifest"
OFFERS = "offers"


def product_digests(offers: DataFrame, by: str = "product", exclude: tuple[str, ...] = ("revision_id",)) -> DataFrame:
    """Rows and content hash per product. Order and file layout do not matter; every value does."""
    return content_digest(offers, [by], row_sha256(offers, exclude))


def revision_id(digests: DataFrame, prefix: str, snapshot_id: str, by: str = "product") -> DataFrame:
    """One row with the revision of a version: twelve digits of the hash over its products in order.

    The list holds one element per published product, which the configuration bounds.
    """
    line = F.concat_ws(" ", F.col(by).cast("string"), F.col("sha256"), F.col("rows").cast("string"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    head = F.concat(F.lit(f"{prefix}{snapshot_id}-"), F.substring(F.sha2(body, 256), 1, 12))
    return digests.agg(head.alias("revision_id"))


def archive_hash(objects: DataFrame, prefix: str) -> DataFrame:
    """Hash over 'name sha bytes' lines in name order, independent of where and when they were read.

    One line per object of an archive: the published files of a release, one per product and kind, which
    the configuration bounds. For rows or documents use `product_digests`, which never gathers a group.
    """
    line = F.concat(
        F.col("name"), F.lit(" "), F.col("sha256"), F.lit(" "), F.col("bytes").cast("string"), F.lit("\n")
    )
    body = F.concat(F.lit(f"{prefix}\n"), F.array_join(F.array_sort(F.collect_list(line)), ""))
    return objects.agg(F.sha2(body, 256).alias("archive_hash"))


def write_version(offers: DataFrame, root: str, prefix: str, snapshot_id: str) -> str:
    """Write a version once. The same content gives the same revision and is not written again.

    Data first, the commit last. Each writer puts its rows into a folder of its own, which then takes the revision's name if no
    other has it; a folder of that name must hold exactly this content, product by product in both directions, or the
    write fails. The commit is one file per revision that only the first writer can create, and the manifest is what the commits
    say: however many writers meet, a revision is there once or not at all, and a lost executor never shows half of one.
    """
    spark = offers.sparkSession
    offers = cut_lineage(offers)
    digests = cut_lineage(product_digests(offers))
    revision = revision_id(digests, prefix, snapshot_id).first()["revision_id"]
    commit = f"{root}/{MANIFEST}/{revision}.json"
    if exists(spark, commit):
        return revision
    path, own = f"{root}/{OFFERS}/revision_id={revision}", f"{root}/{OFFERS}/_writing-{uuid.uuid4().hex}"
    if not exists(spark, path):
        offers.drop("revision_id").write.mode("errorifexists").parquet(own)
        if not move(spark, own, path):
            remove(spark, own)  # somebody else was first
    held = product_digests(spark.read.parquet(path))
    if not held.exceptAll(digests).isEmpty() or not digests.exceptAll(held).isEmpty():
        raise ValueError(f"{revision} exists with other content")
    # One line per published product, which the configuration bounds.
    lines = digests.select(F.to_json(F.struct(F.lit(revision).alias("revision_id"), F.lit(snapshot_id).alias("snapshot_id"), *digests.columns)).alias("line"))
    put_if_absent(spark, commit, "".join(f"{line}\n" for line in sorted(row["line"] for row in lines.collect())))
    return revision


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every committed product of every revision: revision_id, snapshot_id, product, rows, sha256."""
    schema = "revision_id string, snapshot_id string, product string, rows long, sha256 string"
    if not exists(spark, f"{root}/{MANIFEST}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/{MANIFEST}")


def read_version(spark: SparkSession, root: str, revision: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{OFFERS}/revision_id={revision}")


def manifest_errors(offers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Products whose data is not what the manifest says: missing, extra, or other rows or content.

    offers  revision_id, product, ...        manifest  revision_id, product, rows, sha256
    """
    digests = content_digest(offers, ["revision_id", "product"], row_sha256(offers, ("revision_id",)))
    actual = digests.withColumnsRenamed({"rows": "_rows", "sha256": "_actual"})
    joined = manifest.select("revision_id", "product", "rows", "sha256").join(
        actual, ["revision_id", "product"], "full"
    )
    problem = (
        F.when(F.col("_rows").isNull(), F.lit("missing"))
        .when(F.col("rows").isNull(), F.lit("undeclared"))
        .when((F.col("rows") != F.col("_rows")) | (F.col("sha256") != F.col("_actual")), F.lit("content_differs"))
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(
        "revision_id", "product", "problem"
    )


