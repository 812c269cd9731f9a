"""Keyed unit state as a stream: every micro-batch of captures is one run over the stored headers.

State is a change log. A batch writes the headers of the units it changes and no others; every `COMPACT` batches the whole
state is written once as a snapshot. Reading merges the newest snapshot with the batches after it.

    state/changes/batch=<n>   headers of the units that batch n changed, as it left them
    state/snapshot/batch=<n>  headers of all units after batch n
    late/batch=<n>            attempts of batch n that are no newer than what was stored
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewarden.operators import live
from pricewarden.session import children, exists, remove

STATE_SCHEMA = (
    "district_code long, product string, observed_at timestamp, announced_total long, "
    "last_attempt_at timestamp, last_attempt_status string"
)
COMPACT = 16  # batches from one snapshot to the next; a root keeps the number it began with


def _changes(root: str, batch: int) -> str:
    return f"{root}/state/changes/batch={batch}"


def _snapshot(root: str, batch: int) -> str:
    return f"{root}/state/snapshot/batch={batch}"


def _newest(spark: SparkSession, root: str) -> int:
    """The newest batch that finished its changes; -1 before the first."""
    numbers = sorted((int(name.split("=")[1]) for name in children(spark, f"{root}/state/changes") if name.startswith("batch=")), reverse=True)
    return next((n for n in numbers if exists(spark, f"{_changes(root, n)}/_SUCCESS")), -1)


def load_state(spark: SparkSession, root: str, before: int | None = None, compact: int = COMPACT) -> DataFrame:
    """Headers as of the newest batch, or as the batch before a given one left them.

    Micro-batches are numbered without gaps and snapshots stand at fixed numbers, so the folders a state is made of are
    known: one snapshot and at most `compact` batches of changes. Only batch 0 starts from nothing: a batch of which a
    predecessor is lost fails, it never resets the units.
    """
    upto = _newest(spark, root) + 1 if before is None else before
    base = upto // compact * compact - 1  # the last batch before with a snapshot
    # A folder that a job did not finish is as good as lost.
    parts = [(base, _snapshot(root, base))] if base >= 0 else []
    parts += [(n, _changes(root, n)) for n in range(base + 1, upto)]
    state = spark.createDataFrame([], f"{STATE_SCHEMA}, _batch int")
    for n, path in parts:
        if not exists(spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"the path {path} is lost, which the state before batch {upto} is made of")
        state = state.unionByName(spark.read.parquet(path).withColumn("_batch", F.lit(n)))
    columns = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
    last = F.max_by(F.struct(*[c for c in columns if c not in live.UNIT]), "_batch").alias("_last")
    return state.groupBy(*live.UNIT).agg(last).select(*live.UNIT, "_last.*").select(*columns)


def upsert(root: str, to_attempts: Callable[[DataFrame], DataFrame], attempted_at: datetime, compact: int = COMPACT):
    """A foreachBatch function. The state before a batch is fixed by its number and the batch writes
    its own folders, so a repeated batch overwrites itself with the same result.

    What a batch writes follows the units it names, apart from the snapshots. State never expires here: an old unit is only
    skipped when it is read. Attempts older than what is stored never win; they are listed under `late`.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = load_state(spark, root, batch_id, compact)
        attempts = to_attempts(batch).persist()
        tried = attempts.select(*live.UNIT).distinct()
        held = previous.join(tried, list(live.UNIT), "left_semi").persist()
        live.apply_run(held, attempts, attempted_at).write.mode("overwrite").parquet(_changes(root, batch_id))
        known = held.select(*live.UNIT, F.col("observed_at").alias("held_at"))
        late = attempts.join(known, list(live.UNIT)).where(F.col("observed_at") <= F.col("held_at"))
        late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        attempts.unpersist()
        held.unpersist()
        if (batch_id + 1) % compact == 0:
            _compact(spark, root, batch_id, compact)
        # Nothing reads changes from before the newest snapshot but one, nor the snapshot before that.
        remove(spark, _changes(root, batch_id - 2 * compact))
        if batch_id % compact == 0:
            remove(spark, _snapshot(root, batch_id - 1 - 2 * compact))

    return run


def _compact(spark: SparkSession, root: str, batch_id: int, compact: int) -> None:
    """Write the state after a batch whole, from the snapshot before and the changes since."""
    parts = load_state(spark, root, batch_id, compact).withColumn("_batch", F.lit(0))
    own = spark.read.parquet(_changes(root, batch_id)).withColumn("_batch", F.lit(1))
    rest = [c for c in own.columns if c not in (*live.UNIT, "_batch")]
    last = F.max_by(F.struct(*rest), "_batch").alias("_last")
    whole = parts.unionByName(own).groupBy(*live.UNIT).agg(last).select(*live.UNIT, "_last.*")
    whole.write.mode("overwrite").parquet(_snapshot(root, batch_id))


def start(
    captures: DataFrame, root: str, to_attempts: Callable[[DataFrame], DataFrame], attempted_at: datetime, compact: int = COMPACT
) -> StreamingQuery:
    """Process what is available, then stop; call again to go on where it stopped."""
    return (
        captures.writeStream.foreachBatch(upsert(root, to_attempts, attempted_at, compact))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
