"""Exact positions and neighbours in a global order, without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewarden.session import cut_lineage


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows range-partitioned by the order, with their partition number, on reliable storage.

    Partition numbers come from sampling, so they are written down once and only then used twice.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper 31 bits of this number are the partition's, the lower 33 the row's place in it.
    numbered = cut_lineage(placed.withColumn("_seq", F.monotonically_increasing_id()))
    return numbered.withColumn("_part", F.shiftright("_seq", 33))


def global_index(df: DataFrame, order: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """Add `row_index` (0-based) and `row_total` in the global order; the order must be total.

    With a weight the index counts the weights before the row, which is how pre-counted values keep
    the positions of the rows they stand for. Only one row per partition is ever brought together. Without
    one, a row's position in its partition is what the task that sorted it counted: rows move once.
    """
    ranged = _ranged(df.withColumn("_weight", F.lit(1) if weight is None else weight), order)
    sums = ranged.groupBy("_part").agg(F.sum("_weight").alias("_rows"))
    # One row per partition: a window without a key is bounded by the number of tasks.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(W.partitionBy()).alias("row_total"),
    )
    if weight is None:
        counted = ranged.withColumn("_before", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
    else:
        inside = W.partitionBy("_part").orderBy("_seq").rowsBetween(W.unboundedPreceding, -1)
        counted = ranged.withColumn("_before", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return (
        counted.join(F.broadcast(starts), "_part")
        .withColumn("row_index", (F.col("_start") + F.col("_before")).cast("long"))
        .withColumn("row_total", F.col("row_total").cast("long"))
        .drop("_part", "_seq", "_weight", "_start", "_before")
    )


def predecessor(df: DataFrame, order: Sequence[Column], key: str, name: str) -> DataFrame:
    """Add the key of the row just before each row in the global order."""
    ranged = _ranged(df, order)
    inside = W.partitionBy("_part").orderBy("_seq")
    last = ranged.groupBy("_part").agg(F.max_by(key, "_seq").alias("_last"))
    carried = last.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_carry"))
    return (
        ranged.withColumn("_inside", F.lag(key).over(inside))
        .join(F.broadcast(carried), "_part")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_part", "_seq", "_inside", "_carry")
    )
