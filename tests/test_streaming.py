from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallywatt.operators.telemetry import build_telemetry
from tallywatt.schema import TELEMETRY_COLUMNS
from tallywatt.sources import adapters as A
from tallywatt.sources.tables import events
from tallywatt.streaming import telemetry_stream as ST


def store_in_order(samples, path, parts=3):
    """One file per time slice, so that micro-batches arrive in order."""
    for i in range(parts):
        part = samples.filter(F.col("event_id").between(i * 400, i * 400 + 399)) if i < parts - 1 else (
            samples.filter(F.col("event_id") >= i * 400))
        part.coalesce(1).write.mode("append").parquet(path)


def drain(df, path, checkpoint):
    query = ST.append_stream(df, path, checkpoint, available_now=True)
    query.awaitTermination()
    return query


def as_rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_stream_equals_batch_in_order(spark, folder, sf_dir):
    samples = A.raw_samples_from_events(events(spark, sf_dir))
    store_in_order(samples, f"{folder}/in")
    stored = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = drain(ST.with_progress(ST.stream_telemetry(stream)), f"{folder}/out", f"{folder}/cp")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert sum(p["observedMetrics"]["telemetry"]["rows"] for p in query.recentProgress if "telemetry" in p["observedMetrics"]) == samples.count()
    got = spark.read.parquet(f"{folder}/out")
    assert got.filter("late").count() == 0
    cols = ["host", "session_id", *TELEMETRY_COLUMNS]
    assert as_rows(got, cols) == as_rows(build_telemetry(samples), cols)


def test_late_rows_are_flagged(spark, folder, sf_dir):
    samples = A.raw_samples_from_events(events(spark, sf_dir)).withColumn("host", F.lit("one"))
    later, earlier = samples.filter("event_id >= 500"), samples.filter("event_id < 500")
    later.coalesce(1).write.mode("append").parquet(f"{folder}/in/a")
    stream = spark.readStream.schema(samples.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    drain(ST.stream_telemetry(stream), f"{folder}/out", f"{folder}/cp")
    earlier.coalesce(1).write.mode("append").parquet(f"{folder}/in/b")
    drain(ST.stream_telemetry(stream), f"{folder}/out", f"{folder}/cp")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == samples.count()
    assert got.filter("late").count() == earlier.count()
    late = got.filter("late").agg(F.max("disk_read_mb"), F.count_distinct("sample_index")).first()
    assert late[0] == 0.0 and late[1] == earlier.count()


def test_stream_dedup_and_features(spark, folder, sf_dir):
    telemetry = A.telemetry_from_events(events(spark, sf_dir)).withColumn("host", F.lit("h"))
    A.with_repeats(telemetry).coalesce(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(telemetry.schema).parquet(f"{folder}/in")
    once = ST.stream_dedup(stream, ["host", "sample_index"], "timestamp", "30 days")
    drain(ST.stream_features(once), f"{folder}/out", f"{folder}/cp")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == telemetry.count() == got.select("sample_index").distinct().count()
    assert "disk_rw_balance" in got.columns


def test_hot_sessions_equal_batch_in_order(spark, folder, sf_dir):
    from tallywatt.streaming.hot_sessions import build_stream

    samples = A.raw_samples_from_events(events(spark, sf_dir)).withColumn(
        "host", F.when(F.col("event_id") % 3 > 0, F.lit("hot")).when(F.col("event_id") % 5 > 0, F.col("host")))
    store_in_order(samples, f"{folder}/in")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # a second start finds nothing new
        build_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/cp", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert got.filter("late").count() == 0
    cols = ["host", "session_id", *TELEMETRY_COLUMNS]
    assert as_rows(got, cols) == as_rows(build_telemetry(samples), cols)


def test_hot_sessions_state_follows_the_changed_sessions(spark, folder, sf_dir):
    """Batches of one session each between two of all: the log holds what was
    touched, compacting keeps one row per session and older folders go."""
    from tallywatt.streaming.hot_sessions import build_stream, read_state

    samples = A.raw_samples_from_events(events(spark, sf_dir)).withColumn(
        "host", F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("h"), F.col("event_id") % 4))).withColumn("session_id", F.lit(1))
    n = samples.count()
    slices = [(0, n // 2, None), *[(n // 2 + 50 * i, n // 2 + 50 * (i + 1), i % 4) for i in range(5)], (n // 2 + 250, n, None)]
    fed = None
    for i, (a, b, only) in enumerate(slices):
        part = samples.filter(F.col("event_id").between(a, b - 1))
        part = part if only is None else part.filter(F.col("event_id") % 4 == only)
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
        fed = part if fed is None else fed.unionByName(part)
    stream = (spark.readStream.schema(samples.schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    build_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/cp", available_now=True,
                 compact_every=3).awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    cols = ["host", "session_id", *TELEMETRY_COLUMNS]
    assert as_rows(got, cols) == as_rows(build_telemetry(fed), cols)
    assert sorted(p.name for p in Path(folder, "state").iterdir()) == ["base=5", "changes=6"]
    assert spark.read.parquet(f"{folder}/state/base=5").count() == 4
    now = read_state(spark, f"{folder}/state", 6, ["host", "session_id"], 3)
    assert now.count() == 4 and now.agg(F.sum("__n")).first()[0] == fed.count()


def test_hot_sessions_repeated_batch(spark, folder, sf_dir):
    """A batch that is run again after a failure gives the same rows and state."""
    from tallywatt.streaming.hot_sessions import build_stream, read_state

    samples = A.raw_samples_from_events(events(spark, sf_dir))
    store_in_order(samples, f"{folder}/in", 4)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start = lambda: build_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/cp", available_now=True,
                                 compact_every=2).awaitTermination()
    start()
    state = lambda: as_rows(read_state(spark, f"{folder}/state", 3, ["host", "session_id"], 2), ["host", "session_id", "__n", "__at"])
    before = as_rows(spark.read.parquet(f"{folder}/out"), TELEMETRY_COLUMNS), state()
    for name in ("3", ".3.crc"):  # the last commit is lost
        Path(folder, "cp", "commits", name).unlink(missing_ok=True)
    start()
    assert (as_rows(spark.read.parquet(f"{folder}/out"), TELEMETRY_COLUMNS), state()) == before


def test_hot_sessions_late_rows(spark, sf_dir):
    from tallywatt.streaming.hot_sessions import build_batch

    samples = A.raw_samples_from_events(events(spark, sf_dir)).withColumn("host", F.lit("one"))
    first, state = build_batch(samples.filter("event_id between 300 and 600"), None)
    assert first.count() == 301
    second, after = build_batch(samples.filter("event_id < 300 or event_id > 600"), state)
    late = second.filter("late")
    assert late.count() == 300 and late.agg(F.max("disk_read_mb")).first()[0] == 0.0
    both = first.unionByName(second)
    assert both.count() == samples.count() == after.first()["__n"]
    assert sorted(r[0] for r in both.select("sample_index").collect()) == list(range(samples.count()))
    whole = build_telemetry(samples.filter("event_id >= 300"))
    cols = [c for c in TELEMETRY_COLUMNS]
    assert as_rows(both.filter("not late"), cols) == as_rows(whole, cols)


def test_session_history_of_many_sessions_in_one_call():
    """Order, nulls, a null key, a late row, a session unseen for a batch, and whole numbers kept whole."""
    class State:
        exists, get, calls = False, None, 0

        def update(self, value):
            self.exists, self.get, self.calls = True, value, self.calls + 1

    columns = ["host", ST.FREQ, *ST.READINGS, "at_us"]
    run, state = ST.session_history(["host"], columns, [*ST.READINGS, "at_us"]), State()
    none = lambda values: [None if pd.isna(v) else v for v in values]

    def fed(rows):
        pdf = pd.DataFrame(rows, columns=["host", "at_us", ST.FREQ, "read_bytes"])
        for c in ST.READINGS[1:]:
            pdf[c] = 2 ** 53 + 1 + np.arange(len(pdf))
        out, = run((0,), iter([pdf.iloc[:1], pdf.iloc[1:]]), state)
        return lambda host: out[out["host"].isna()] if host is None else out[out["host"] == host]

    of = fed([("h", 30, np.nan, 7.0), (None, 5, np.nan, 4.0), ("h", 10, 5.0, 1.0), ("h", 20, 9.0, np.nan)])
    h = of("h")
    assert h["at_us"].tolist() == [10, 20, 30] and h["__index"].tolist() == [0, 1, 2] and not h["late"].any()
    assert none(h["__prev_read_bytes"]) == [None, 1, None]
    assert h["__prev_write_bytes"].tolist()[1:] == [2 ** 53 + 3, 2 ** 53 + 4]
    assert h["__low"].tolist() == [5.0] * 3 and h["__high"].tolist() == [5.0, 9.0, 9.0]
    assert none(of(None)["__low"]) == [None] == none(of(None)["__prev_read_bytes"])
    of = fed([("h", 25, 1.0, 3.0), ("new", 1, 2.0, 2.0), ("h", 40, 6.0, 8.0)])
    h = of("h")
    assert h["late"].tolist() == [True, False] and h["__index"].tolist() == [3, 4] and h["__low"].tolist() == [1.0, 1.0]
    assert none(h["__prev_read_bytes"]) == [None, 7] and none(of("new")["__index"]) == [0]
    of = fed([(None, 6, 3.0, 1.0), ("h", 39, 1.0, 1.0)])
    assert of(None)["__index"].tolist() == [1] and none(of(None)["__prev_read_bytes"]) == [4]
    assert of("h")["late"].tolist() == [True] and of("h")["__index"].tolist() == [5]
    assert state.calls == 3


def test_arriving_files_follow_the_rows(spark, folder, sf_dir, monkeypatch):
    """More rows, more tasks for each of the same micro-batches, and the same rows."""
    from tallywatt.catalog import registry, telemetry_queries as Q  # noqa: F401 (registry first)

    monkeypatch.setattr(Q, "ROWS_PER_FILE", 50)
    rows = events(spark, sf_dir)
    stream = Q.arriving(spark, sf_dir, folder)
    files = -(-rows.count() // 200)
    assert files > Q.FILES and len(list(Path(folder, "events").glob("*.parquet"))) == 4 * files
    query = drain(stream, f"{folder}/out", f"{folder}/cp")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert as_rows(spark.read.parquet(f"{folder}/out"), rows.columns) == as_rows(rows, rows.columns)
