"""Telemetry building and profiling on streams.

The state of a session is its last counter readings, its frequency range and
its row count. Everything else is the batch code: the same column functions
run before and after the stateful step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywatt.functions import states as S
from tallywatt.operators.features import derive
from tallywatt.operators.telemetry import COUNTERS, SESSION, scaled_delta, telemetry_columns

READINGS = [counter for _, counter, _ in COUNTERS]
FREQ = "cpu_freq_mhz"

#: Sessions are dealt into so many groups by hash; a group's state is an Arrow table of its
#: sessions (keys, at, last readings, low, high, rows). The number must stay over restarts.
BUCKETS = 512
STATE = "sessions binary"
HISTORY = (
    [T.StructField(f"__prev_{c}", T.LongType()) for c in READINGS]
    + [T.StructField("__low", T.DoubleType()), T.StructField("__high", T.DoubleType()),
       T.StructField("__index", T.LongType()), T.StructField("late", T.BooleanType())]
)


def _nullable(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers and which of them are null (floats where some are)."""
    held = values.to_numpy(None if values.dtype.kind in "iu" else float)
    null = np.isnan(held)
    return np.where(null, 0, held).astype("int64"), null


def _sessions(keys: pd.DataFrame) -> np.ndarray:
    """Numbers of the sessions from 0 in order of appearance; a null key is a key."""
    return keys.groupby(list(keys.columns), dropna=False, sort=False).ngroup().to_numpy()


def session_history(keys: Sequence[str], columns: Sequence[str], whole: Sequence[str]):
    """Adds previous readings, running range and row index to the rows of a group
    of sessions (``columns``, those in ``whole`` being whole numbers).

    Rows of a micro-batch are put in time order. A row older than its session's
    stored reading is flagged late: it gets no previous reading and leaves the
    stored one alone, but counts for the range and the index.
    """
    keys = list(keys)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts), ignore_index=True)
        if pdf["at_us"].isna().any():
            raise ValueError("a sample has no time")
        known = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else pdf[keys].iloc[:0]
        named = pd.concat([known[keys], pdf[keys]], ignore_index=True) if len(known) else pdf[keys]
        code = _sessions(named)
        n, code = int(code.max()) + 1, code[len(known):]
        # known sessions come first, each once
        old = lambda c, none, kind: np.concatenate([known[c].fillna(none).to_numpy(kind) if len(known) else [], np.full(n - len(known), none)]).astype(kind)
        at, seen = old("at", np.iinfo("int64").min, "int64"), old("rows", 0, "int64")
        edge = {"low": old("low", np.nan, float), "high": old("high", np.nan, float)}

        order = np.lexsort((pdf["at_us"].to_numpy(), code))
        pdf, code = pdf.take(order), code[order]
        times = pdf["at_us"].to_numpy("int64")
        late = times < at[code]
        fresh = np.flatnonzero(~late)
        same = code[fresh][1:] == code[fresh][:-1]
        opens, ends = np.append([True], ~same)[:len(fresh)], np.append(~same, [True])[:len(fresh)]
        first, later, last = fresh[opens], fresh[~opens], fresh[ends]
        earlier = fresh[np.flatnonzero(~opens) - 1]
        out = {c: pdf[c].array for c in columns}
        for c in whole:  # rows of other groups follow: a null makes no float of theirs
            if out[c].dtype.kind == "f":
                out[c] = pd.arrays.IntegerArray(*_nullable(pdf[c]))
        kept = {}
        for c in READINGS:
            value, null = _nullable(pdf[c])
            if len(known):
                held, none = _nullable(known[c])
            else:
                held, none = np.zeros(0, "int64"), np.zeros(0, bool)
            held, none = np.append(held, np.zeros(n - len(held), "int64")), np.append(none, np.ones(n - len(none), bool))
            before, missing = np.zeros(len(pdf), "int64"), np.ones(len(pdf), bool)
            before[first], missing[first] = held[code[first]], none[code[first]]
            before[later], missing[later] = value[earlier], null[earlier]
            held[code[last]], none[code[last]] = value[last], null[last]
            out[f"__prev_{c}"] = pd.arrays.IntegerArray(before, missing)
            kept[c] = pa.array(held, mask=none)
        at[code[last]] = times[last]

        size = np.bincount(code, minlength=n)
        starts = (np.cumsum(size) - size)[code]
        ends = np.append(np.flatnonzero(code[1:] != code[:-1]), len(code) - 1)
        freq = pd.Series(pdf[FREQ].to_numpy(float))
        for name, none, run_of, pick in (("low", np.inf, "cummin", np.fmin), ("high", -np.inf, "cummax", np.fmax)):
            running = getattr(freq.fillna(none).groupby(code), run_of)().to_numpy()
            running = np.where(freq.notna().groupby(code).cumsum() > 0, running, np.nan)
            out[f"__{name}"] = pick(running, edge[name][code])
            edge[name][code[ends]] = out[f"__{name}"][ends]
        out["__index"] = seen[code] + np.arange(len(code)) - starts
        out["late"] = late

        table = pa.table({**{k: pa.array(named[k][~named.duplicated()], from_pandas=True) for k in keys}, "at": at, **kept,
                          **{c: pa.array(v, from_pandas=True) for c, v in edge.items()}, "rows": seen + size})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        yield pd.DataFrame(out, copy=False)

    return run


def stream_telemetry(samples: DataFrame, keys: Sequence[str] = SESSION, on_reset: str = "keep", offset: int = 0,
                     buckets: int = BUCKETS) -> DataFrame:
    """Streaming form of ``build_telemetry``: keys, the 24 columns and
    ``late``. Equal to the batch form for rows that arrive in order.

    Maps and arrays are reduced to scalars before the stateful step, so only
    flat columns travel to the Python workers (whose row tuples rename columns
    that start with an underscore). There may be very many sessions of few rows:
    those of one of the ``buckets`` groups are worked out at once.
    """
    flat = samples.select(
        *keys, "cpu_percent", FREQ, "mem_used", "mem_percent", "swap_used", *READINGS, "process_count",
        S.cpu_temp(F.col("sensors")).alias("temp_now"), S.busiest_core(F.col("per_core")).alias("core_now"),
        F.unix_micros("ts").alias("at_us"))
    whole = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.IntegralType)]
    schema = T.StructType([*flat.schema.fields, *HISTORY])
    dealt = flat.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rows = dealt.groupBy("bucket").applyInPandasWithState(
        session_history(keys, flat.columns, whole), schema, STATE, "append", GroupStateTimeout.NoTimeout)
    deltas = {
        name: scaled_delta(F.col(counter), F.col(f"__prev_{counter}"), unit, on_reset)
        for name, counter, unit in COUNTERS
    }
    low, high = (F.round(F.nanvl(c, F.lit(None)), 2) for c in ("__low", "__high"))
    return rows.withColumn("ts", F.timestamp_micros("at_us")).select(*keys, *telemetry_columns(
        deltas, low, high, F.col("__index") + offset, F.col("temp_now"), F.col("core_now")), "late")


def stream_dedup(telemetry: DataFrame, keys: Sequence[str] = (*SESSION, "sample_index"),
                 event_time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a key that arrive within the delay of each other."""
    return telemetry.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_features(telemetry: DataFrame, dtype: str = "double") -> DataFrame:
    """Casts and derived columns: stateless, the batch code unchanged."""
    return derive(telemetry, dtype)


def with_progress(df: DataFrame, name: str = "telemetry") -> DataFrame:
    """Row count and time range of every micro-batch, reported as an observed
    metric in the query's progress events."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"),
                      F.max("timestamp").alias("last"))


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False,
                  interval: str = "1 minute") -> StreamingQuery:
    """Append rows to a table folder; the checkpoint makes restarts exact."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if fmt == "csv":
        writer = writer.option("header", True)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


