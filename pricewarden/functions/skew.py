"""Equi-joins whose keys may be hot on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 20_000
# Pairs of rows that a task of the join is meant to meet.
TASK_PAIRS = 2_000_000


# Tasks a core gets when rows are dealt out by number.
TASKS_A_CORE = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key, or by position, to a number of tasks that does not follow their bytes, for work that is dear by the row.

    A table of few bytes would lie in one task or two, and a shuffle without a number is merged back to that by its size.
    """
    tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    if keys:
        return rows.repartition(tasks, *keys)
    return rows.withColumn("_position", F.monotonically_increasing_id()).repartition(tasks, "_position").drop("_position")


def _parts(own: str, other: str, hot_rows: int, task_pairs: int) -> Column:
    """Parts of one side of a key: enough for its rows, and its share of the cuts that keep a cell of the grid to `task_pairs`."""
    mine, theirs = F.col(own).cast("double"), F.col(other).cast("double")
    share = F.when(mine * theirs > task_pairs, mine / F.sqrt(F.lit(float(task_pairs)))).otherwise(F.lit(0.0))
    # Where the other side has too few rows to be cut as deep, this side takes the cuts alone.
    share = F.when(theirs * theirs < task_pairs, mine * theirs / task_pairs).otherwise(share)
    share = F.when(mine * mine < task_pairs, F.lit(1.0)).otherwise(share)
    return F.coalesce(F.ceil(F.greatest(F.lit(1.0), mine / hot_rows, share)), F.lit(1)).cast("int")


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: tuple[str, str], hot_rows: int = HOT_ROWS, task_pairs: int = TASK_PAIRS
) -> DataFrame:
    """Inner join in which no task meets more than `hot_rows` rows of a key on either side, nor many more than `task_pairs` pairs of one.

    Keys are counted first (a combined aggregation). A hot key is cut into a grid: each side's rows
    are dealt over its own parts by the hash of `spread` and repeated over the other side's, so every
    matching pair meets exactly once. Ordinary keys have one part and cost nothing extra. The table
    of hot keys has at most rows / hot_rows + pairs / task_pairs entries; the optimizer decides how to join it from its
    measured size. The counts also say how many pairs will meet: where few rows make many pairs, which sizes in bytes do
    not show, the join gets a task for every `task_pairs` of them. The driver sees that one number.
    """
    keys = list(keys)
    count = F.count(F.lit(1))
    l_rows, r_rows = left.groupBy(*keys).agg(count.alias("_ln")), right.groupBy(*keys).agg(count.alias("_rn"))
    met = l_rows.hint("merge").join(r_rows, keys, "full")
    parts = (_parts("_ln", "_rn", hot_rows, task_pairs).alias("_lp"), _parts("_rn", "_ln", hot_rows, task_pairs).alias("_rp"))
    hot = met.select(*keys, *parts).where("_lp > 1 OR _rp > 1")
    pairs = met.agg(F.sum(F.col("_ln").cast("double") * F.col("_rn"))).first()[0] or 0.0
    tasks = int(pairs // task_pairs) + 1

    def dealt(df: DataFrame, own: str, other: str, own_slot: str, other_slot: str, by: str) -> DataFrame:
        own_parts, other_parts = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        slots: Column = F.sequence(F.lit(0), other_parts - 1)
        return (
            df.join(hot, keys, "left")
            .withColumn(own_slot, F.pmod(F.xxhash64(by), own_parts).cast("int"))
            .withColumn(other_slot, F.explode(slots))
            .drop(own, other)
        )

    l = dealt(left, "_lp", "_rp", "_ls", "_rs", spread[0])
    r = dealt(right, "_rp", "_lp", "_rs", "_ls", spread[1])
    on = [*keys, "_ls", "_rs"]
    if tasks > left.sparkSession.sparkContext.defaultParallelism:
        l, r = l.repartition(tasks, *on), r.repartition(tasks, *on)
    # The optimizer's sizes do not see what an explode adds to either side, so neither is broadcast.
    return l.hint("merge").join(r, on).drop("_ls", "_rs")
