"""What the text operators share: input columns, tables in the shared folder, bound expressions, white space."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewarden.session import checkpoint_root

# White space inside and around words: blank and the five control characters from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
BLANKS = " \t\n\v\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash; a null text is empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table below the shared checkpoint folder and read it back.

    Cuts the lineage on reliable storage: losing an executor never repeats what stands before.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one aggregated number."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blocks_for(df: DataFrame, block_bytes: int, column: str = "text") -> int:
    """How many blocks of about `block_bytes` of text a table makes; grows with the table, so a block never does."""
    return max(1, -(-text_bytes(df, column) // block_bytes))
