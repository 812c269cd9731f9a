"""Harvested place cards and brand directories as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewarden.functions.geo import is_coordinate
from pricewarden.functions.text import plain_upper

HARVEST_SCHEMA = (
    "places array<struct<id: string, name: string, info: array<string>, lat: double, lng: double>>"
)


def read_harvest(spark: SparkSession, path: str) -> DataFrame:
    """Place cards of newline-delimited blocks, in reading order; cards without an id are skipped.

    The order is file, block within the file and position: what `last card wins` needs. It holds for
    any split of the files, because a block's rows stay together.
    """
    blocks = spark.read.schema(HARVEST_SCHEMA).json(path)
    placed = blocks.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        F.posexplode("places").alias("_at", "card"),
    )
    return placed.where(F.coalesce(F.col("card.id"), F.lit("")) != "").select(
        F.col("card.id").alias("id"),
        F.col("card.name").alias("name"),
        F.col("card.info").alias("info"),
        F.col("card.lat").alias("latitude"),
        F.col("card.lng").alias("longitude"),
        F.struct("_file", "_start", "_line", "_at").alias("ordinal"),
    )


@dataclass(frozen=True)
class DirectorySource:
    """How one brand's published directory maps to entries, and which rows are in scope."""

    directory: str
    brand: str
    name: str
    address: str
    district: str | None
    latitude: str
    longitude: str
    in_scope: Callable[[], Column]


def _equals(**wanted: str) -> Callable[[], Column]:
    def test() -> Column:
        found = F.lit(True)
        for column, value in wanted.items():
            found = found & (F.col(column.replace("__", ".")) == value)
        return found

    return test


# Column names of each directory. The first publishes latitude and longitude swapped.
DIRECTORY_SOURCES = (
    DirectorySource(
        "repsol", "Repsol", "name", "address", "city", "location.lng", "location.lat",
        _equals(department="LIMA", state="LIMA"),
    ),
    DirectorySource(
        "petroperu", "Petroperú", "title.rendered", "acf.address", "acf.district", "acf.lat", "acf.long",
        _equals(acf__department="LIMA", acf__province="LIMA"),
    ),
    DirectorySource(
        "ava", "AVA", "nombre", "direccion", "distrito", "coordenadas.latitud", "coordenadas.longitud",
        lambda: (plain_upper(F.col("departamento")) == "LIMA") & (plain_upper(F.col("ciudad")) == "LIMA"),
    ),
    DirectorySource(
        "primax", "Primax", "name", "address", None, "y", "x",
        lambda: (F.col("y") > -12.55) & (F.col("y") < -11.6) & (F.col("x") > -77.25) & (F.col("x") < -76.55),
    ),
)


def directory_entries(rows: DataFrame, source: DirectorySource, key: str = "entry_index") -> DataFrame:
    """Entries of one directory in the common shape; only rows in scope with a usable coordinate."""
    district = F.col(source.district) if source.district else F.lit("")
    entries = rows.where(source.in_scope()).select(
        F.concat_ws("#", F.lit(source.directory), F.col(key).cast("string")).alias("entry_key"),
        F.lit(source.directory).alias("directory"),
        F.lit(source.brand).alias("brand"),
        F.col(source.name).alias("name"),
        F.col(source.address).alias("address"),
        district.alias("district"),
        F.col(source.latitude).cast("string").try_cast("double").alias("latitude"),
        F.col(source.longitude).cast("string").try_cast("double").alias("longitude"),
    )
    return entries.where(is_coordinate(F.col("latitude"), F.col("longitude")))
