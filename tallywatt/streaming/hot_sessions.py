"""Telemetry building on streams where one session may dominate.

A stateful operator gives each session to one task. Here every micro-batch is
built with the segmented batch plan instead, which spreads a dominant session
over all tasks; the sessions' state between micro-batches is a log of changes.

A batch writes the state of the sessions that it touched; every few batches the
log is compacted into a base with one row per session, and what no repeat of a
batch can ask for any more is removed. Output and state are written per batch id
and overwritten when a batch is repeated after a failure, so restarts neither
lose nor repeat rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallywatt.functions import states as S
from tallywatt.operators.telemetry import COUNTERS, SESSION, scaled_delta, telemetry_columns
from tallywatt.plans.ranks import null_safe
from tallywatt.plans.segments import history_state, with_history
from tallywatt.plans.small import checked_small

READINGS = [counter for _, counter, _ in COUNTERS]
FREQ = "cpu_freq_mhz"


def build_batch(batch: DataFrame, state: DataFrame | None, keys: Sequence[str] = SESSION, on_reset: str = "keep",
                offset: int = 0, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Telemetry rows of one micro-batch and the state after it.

    A row older than its session's stored reading is late: no previous
    reading, counted after the batch's other rows.
    """
    flat = batch.select(
        *keys, "ts", "cpu_percent", FREQ, "mem_used", "mem_percent", "swap_used", *READINGS, "process_count",
        S.cpu_temp(F.col("sensors")).alias("__temp"), S.busiest_core(F.col("per_core")).alias("__core"),
        F.unix_micros("ts").alias("at_us"))
    before = {c: f"__prev_{c}" for c in READINGS}
    spans = {"low": {FREQ: "__low"}, "high": {FREQ: "__high"}, "index": "__index", "parts": parts}
    kept = {"last": READINGS, "low": [FREQ], "high": [FREQ]}
    if state is None:
        rows = with_history(flat, keys, "at_us", last=before, **spans).withColumn("late", F.lit(False))
        after = history_state(flat, keys, "at_us", **kept)
    else:
        seen = checked_small(state.select(*keys, F.col("__at").alias("__seen")))
        marked = null_safe(flat, seen, keys).withColumn("late", F.coalesce(F.col("at_us") < F.col("__seen"), F.lit(False)))
        fresh, late = (marked.filter(test).drop("__seen") for test in (~F.col("late"), F.col("late")))
        middle = history_state(fresh, keys, "at_us", **kept, initial=state)
        rows = with_history(fresh, keys, "at_us", last=before, **spans, initial=state)
        behind = with_history(late, keys, "at_us", **spans, initial=middle)
        rows = rows.unionByName(behind.withColumns({p: F.lit(None).cast("bigint") for p in before.values()}))
        after = history_state(late, keys, "at_us", **kept, initial=middle, late=True)
    deltas = {name: scaled_delta(F.col(c), F.col(before[c]), unit, on_reset) for name, c, unit in COUNTERS}
    low, high = F.round("__low", 2), F.round("__high", 2)
    out = rows.select(*keys, *telemetry_columns(
        deltas, low, high, F.col("__index") + F.lit(offset), F.col("__temp"), F.col("__core")), "late")
    return out, after


def last_base(batch_id: int, every: int) -> int:
    """The last batch up to ``batch_id`` after which the log is compacted, -1 if
    there is none."""
    return (batch_id + 1) // every * every - 1


def read_state(spark: SparkSession, folder: str, batch_id: int, keys: Sequence[str], every: int) -> DataFrame | None:
    """The state of all sessions after a batch: the newest row of each among the
    base and the changes since. A missing folder is an error."""
    if batch_id < 0:
        return None
    base = last_base(batch_id, every)
    paths = [f"{folder}/base={base}"] if base >= 0 else []
    paths += [f"{folder}/changes={b}" for b in range(base + 1, batch_id + 1)]
    return newest(spark.read.parquet(*paths), keys)


def newest(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per session, that of its last batch; combined in the tasks."""
    rest = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__state")).select(*keys, "__state.*")


def remove_before(spark: SparkSession, folder: str, batch_id: int, every: int) -> None:
    """Delete the state that the base of ``batch_id`` replaces, if that batch
    wrote one: no batch from the next one on reads it, repeated or not."""
    base = last_base(batch_id, every)
    if base != batch_id:
        return
    for name in [f"base={base - every}", *[f"changes={b}" for b in range(base - every + 1, base + 1)]]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_stream(samples: DataFrame, out: str, state: str, checkpoint: str, keys: Sequence[str] = SESSION,
                 on_reset: str = "keep", available_now: bool = False, interval: str = "1 minute",
                 compact_every: int = 20) -> StreamingQuery:
    """Append telemetry to ``out`` (one folder per batch). What is written to
    ``state`` follows the sessions of a batch, not all sessions seen; after every
    ``compact_every`` batches the base is written anew. The number must stay the
    same over restarts."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch starts after the commit of the one before
        remove_before(spark, state, batch_id - 1, compact_every)
        stored = read_state(spark, state, batch_id - 1, keys, compact_every)
        batch = batch.persist()
        touched = None
        if stored is not None:
            sessions = checked_small(batch.select(*keys).distinct())
            same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
            touched = stored.drop("__batch").alias("s").join(sessions.alias("b"), reduce(and_, same), "left_semi")
        rows, after = build_batch(batch, touched, keys, on_reset)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        changes = after.withColumn("__batch", F.lit(batch_id).cast("long"))
        if last_base(batch_id, compact_every) == batch_id:
            whole = changes if stored is None else newest(stored.unionByName(changes), keys)
            whole.write.mode("overwrite").parquet(f"{state}/base={batch_id}")
        else:
            changes.write.mode("overwrite").parquet(f"{state}/changes={batch_id}")
        batch.unpersist()

    writer = samples.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
