"""Delimited feeds under a strict contract: exact columns, exact width, nothing inferred."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewarden.functions.ids import content_digest
from pricewarden.functions.parse import clean, parse_instant, parse_price
from pricewarden.schemas import Feed
from pricewarden.session import exists

CORRUPT = "_corrupt"
CSV_OPTIONS = {"sep": ";", "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


class ContractError(ValueError):
    """The input is not what the contract says, so none of it is used."""


def normalise_header(value: str) -> str:
    plain = unicodedata.normalize("NFD", value.replace("\r", "").strip().lstrip("﻿"))
    plain = "".join(c for c in plain if not 0x0300 <= ord(c) <= 0x036F)
    return re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").upper()


def check_header(names: list[str], feed: Feed) -> None:
    found = [normalise_header(name) for name in names]
    if found != list(feed.fields):
        raise ContractError(f"{feed.name}: header {found} instead of {list(feed.fields)}")


def read_feed(spark: SparkSession, path: str, feed: Feed, file_col: str | None = None) -> DataFrame:
    """Rows of a feed as cleaned text, plus `_corrupt`: the raw line where the width is wrong.

    `file_col` adds the path of each row's file under that name.

    The first file's header is normalised and compared here; Spark itself compares every other
    file's header with it, because the schema is not enforced over the header.
    """
    first = spark.read.options(header=True, **CSV_OPTIONS).csv(path)
    if not first.columns:
        raise ContractError(f"{feed.name}: empty input")
    check_header(first.columns, feed)
    schema = T.StructType(
        [T.StructField(name, T.StringType()) for name in first.columns] + [T.StructField(CORRUPT, T.StringType())]
    )
    rows = (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **CSV_OPTIONS)
        .csv(path)
    )
    cells = [clean(F.col(f"`{name}`")).alias(field) for name, field in zip(first.columns, feed.fields, strict=True)]
    return rows.select(*cells, CORRUPT, *([F.col("_metadata.file_path").alias(file_col)] if file_col else []))


ROWS, RECORD = "rows", "record"


@dataclass(frozen=True)
class Landed:
    path: str
    rows: int
    source_max_reported_at: datetime | None


def land(spark: SparkSession, path: str, feed: Feed, out: str, instant_field: str | None = "FECHA_DE_REGISTRO") -> Landed:
    """Read a feed once and write it as Parquet, with its counts taken on the way.

    Rows of the wrong width go to `malformed=true` and fail the landing. A compressed or quoted file
    cannot be split, so everything downstream reads the Parquet copy, spread over the cluster.

    The rows are written first and the record of the run last. Only a landing with its record can be read;
    one that failed has none, and landing again replaces its rows.
    """
    if exists(spark, f"{out}/{RECORD}"):
        raise ContractError(f"{feed.name}: landed at {out} before")
    rows = read_feed(spark, path, feed).withColumn("malformed", F.col(CORRUPT).isNotNull())
    newest = F.max(parse_instant(F.col(instant_field))) if instant_field else F.lit(None).cast("timestamp")
    seen = Observation(f"land-{feed.name}")
    counted = rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.count_if("malformed"), F.lit(0)).alias("malformed"),
        newest.alias("newest"),
    )
    # A round-robin spread: rows of one unsplittable file leave their single reading task.
    counted.repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").partitionBy(
        "malformed"
    ).parquet(f"{out}/{ROWS}")
    totals = seen.get
    if totals["malformed"]:
        raise ContractError(f"{feed.name}: {totals['malformed']} rows of the wrong width")
    if not totals["rows"]:
        raise ContractError(f"{feed.name}: no rows")
    record = spark.createDataFrame([(feed.name, totals["rows"], totals["newest"])], "feed string, rows long, newest timestamp")
    record.coalesce(1).write.mode("errorifexists").parquet(f"{out}/{RECORD}")
    return Landed(out, totals["rows"], totals["newest"])


def landed(spark: SparkSession, out: str, feed: Feed) -> DataFrame:
    """The accepted rows of a landing; without the record of its run there are none to read."""
    if not exists(spark, f"{out}/{RECORD}/_SUCCESS"):
        raise ContractError(f"{feed.name}: no accepted landing at {out}")
    return spark.read.parquet(f"{out}/{ROWS}/malformed=false").select(*feed.fields)


def minimise(rows: DataFrame, feed: Feed) -> DataFrame:
    """The feed without its private columns; the scan never reads them."""
    return rows.select(*feed.minimised)


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, lines and content hash of every file, without bringing a file together in one place."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value"
    )
    digests = content_digest(lines, ["file", "bytes"], F.sha2("value", 256), rows="lines")
    return digests.withColumnRenamed("sha256", "content_sha256")


def feed_profile(spark: SparkSession, path: str, feed: Feed, instant_field: str = "FECHA_DE_REGISTRO") -> DataFrame:
    """What `profile` says of every file of a feed, with its header, its rows of the right width and its newest instant.

    Rows may span lines, so they are counted by the reader of the feed; every file is folded to one row before it moves.
    """
    heads = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"), "value")
        .where("_start = 0")
        .groupBy("file")
        .agg(F.min_by("value", "_line").alias("header"))
    )
    rows = read_feed(spark, path, feed, "file").groupBy("file").agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("rows"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"),
        F.max(parse_instant(F.col(instant_field))).alias("newest"),
    )
    return profile(spark, path).join(heads, "file").join(rows, "file")


# --- typed views --------------------------------------------------------------------------------


def as_reports(rows: DataFrame, feed: Feed) -> DataFrame:
    """Price reports with parsed price and instant."""
    columns = {
        "id": F.col(feed.id_field),
        "activity": F.col("ACTIVIDAD"),
        "registration": F.col("REGISTRO_DE_HIDROCARBUROS"),
        "department": F.col("DEPARTAMENTO"),
        "province": F.col("PROVINCIA"),
        "district": F.col("DISTRITO"),
        "reported_at": parse_instant(F.col("FECHA_DE_REGISTRO")),
        "price": parse_price(F.col("PRECIO_DE_VENTA_SOLES")),
        "product_name": F.col("PRODUCTO"),
        "unit": F.col("UNIDAD"),
    }
    if "TIPO_DE_CLIENTE" in feed.fields:
        columns["client_type"] = F.col("TIPO_DE_CLIENTE")
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def as_identities(rows: DataFrame, feed: Feed) -> DataFrame:
    return rows.select(
        F.col(feed.id_field).alias("id"), F.col("RAZON_SOCIAL").alias("legal_name"), F.col("DIRECCION").alias("address")
    )


def as_registry(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("SOURCE_ACTIVITY").alias("code"),
        F.col("REGISTRO").alias("registration"),
        F.col("DEPARTAMENTO").alias("department"),
        F.col("PROVINCIA").alias("province"),
        F.col("DISTRITO").alias("district"),
    )


def as_points(rows: DataFrame) -> DataFrame:
    def degrees(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).try_cast("double").alias(name.lower())

    return rows.select(
        F.col("LAYER").alias("layer"),
        F.col("N").alias("registration"),
        F.col("DEPARTAMENTO").alias("department"),
        F.col("PROVINCIA").alias("province"),
        F.col("DISTRITO").alias("district"),
        degrees("LONGITUDE"),
        degrees("LATITUDE"),
    )
