import pytest
from pyspark.sql import functions as F

from tallywatt.operators import clean as C, design as D
from tallywatt.schema import PUBLISHED_LEVELS, RUN_COLUMNS
from tallywatt.sources import sinks, tables

SMALL = {"engine": ["e1", "e2"], "mode": ["single", "parallel"]}


def test_grid_and_filters(spark):
    assert D.design_grid(spark).count() == 128
    assert D.design_grid(spark, wanted={"engine": "duckdb, polars_lazy", "data_format": "csv"}).count() == 16
    row = D.design_grid(spark, SMALL).orderBy("config_id").first()
    assert row["config_id"] == "e1__parallel"


def test_level_order_is_declared_order(spark):
    got = D.level_order(spark).filter("factor = 'engine'").orderBy("position").collect()
    assert [r["level"] for r in got] == PUBLISHED_LEVELS["engine"]


def test_schedule_is_a_permutation_per_block(spark):
    grid = D.design_grid(spark)
    a = D.block_schedule(grid, 3, seed=1, parts=7)
    rows = a.select("block", "config_id", "position_in_block").collect()
    for b in (1, 2, 3):
        assert sorted(r["position_in_block"] for r in rows if r["block"] == b) == list(range(1, 129))
    again = D.block_schedule(grid.repartition(5), 3, seed=1).select("block", "config_id", "position_in_block").collect()
    assert sorted(rows) == sorted(again)
    order = lambda b: [r["config_id"] for r in sorted(rows, key=lambda r: r["position_in_block"]) if r["block"] == b]
    assert order(1) != order(2)
    with pytest.raises(ValueError):
        D.block_schedule(grid, 0)


def test_pending_and_latest(spark):
    schedule = D.block_schedule(D.design_grid(spark, SMALL), 2)
    log = spark.createDataFrame([(1, "e1__single", "error", "t1"), (1, "e1__single", "ok", "t0"), (2, "e2__single", "error", "t1")],
                                "block int, config_id string, status string, timestamp string")
    left = D.pending_runs(schedule, log)
    assert left.count() == 7 and left.filter("block = 1 and config_id = 'e1__single'").count() == 0
    best = {(r["block"], r["config_id"]): r["status"] for r in D.latest_state(log).collect()}
    assert best == {(1, "e1__single"): "ok", (2, "e2__single"): "error"}


def test_check_design_states(spark):
    rows = [(1, "e1__single"), (1, "e1__single"), (1, "e1__parallel"), (1, "e2__single"), (1, "other")]
    got = {r["config_id"]: (r["n"], r["state"]) for r in D.check_design(
        spark.createDataFrame(rows, "block int, config_id string"), SMALL, [1]).collect()}
    assert got == {"e1__single": (2, "duplicated"), "e1__parallel": (1, "ok"), "e2__single": (1, "ok"),
                   "e2__parallel": (0, "missing"), "other": (1, "unexpected")}


def test_check_workers(spark):
    df = spark.createDataFrame([("single", 1), ("single", 2), ("parallel", 4)], "execution_mode string, workers int")
    assert {r["execution_mode"]: r["passed"] for r in D.check_workers(df).collect()} == {"single": False, "parallel": True}


def test_samples(spark):
    df = spark.range(100).select(F.col("id").alias("sample_index"), (F.col("id") * 2).alias("v")).repartition(4)
    assert sorted(r["sample_index"] for r in D.first_n(df, 10).collect()) == list(range(10))
    assert D.first_n(df, 0).count() == 100 and D.first_n(df, 1000).count() == 100
    picked = sorted(r["sample_index"] for r in D.random_n(df, 30, seed=3).collect())
    assert len(set(picked)) == 30
    assert picked == sorted(r["sample_index"] for r in D.random_n(df.orderBy("v"), 30, seed=3).collect())
    assert picked != sorted(r["sample_index"] for r in D.random_n(df, 30, seed=4).collect())
    assert D.random_n(df, 500).count() == 100
    with pytest.raises(ValueError):
        D.first_n(df, -1)


@pytest.mark.parametrize("n", [1, 25, 60, 99, 100, 101])
def test_first_rows_with_nulls_and_ties(spark, n):
    rows = [(i, None if i % 3 == 0 else f"k{i % 7}", float(i % 5)) for i in range(100)] + [(7, "k0", 2.0)] * 3
    df = spark.createDataFrame(rows, "sample_index int, k string, v double").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or "", r[0], r[2])
    got = sorted((tuple(r) for r in D.first_n(df, n, order="k").collect()), key=key)
    assert got == sorted(rows, key=key)[:n]


def test_append_overwrite_and_convert(spark, folder):
    from tallywatt.schema import telemetry_schema

    values = ["2024-01-01T00:00:00.000", *[1.0] * 10, 5, *["x"] * 11, 0]
    df = spark.createDataFrame([values], telemetry_schema())
    for overwrite, want in ((False, 1), (False, 2), (True, 1)):
        sinks.append_rows(df, f"{folder}/t.csv", "csv", overwrite)
        assert tables.count_rows(tables.read_telemetry(spark, f"{folder}/t.csv", "csv")) == want
    sinks.csv_to_parquet(spark, f"{folder}/t.csv", f"{folder}/t.parquet")
    got = tables.read_telemetry(spark, f"{folder}/t.parquet")
    assert got.collect() == df.collect() and C.check_columns(got) == []
    with pytest.raises(Exception):
        sinks.csv_to_parquet(spark, f"{folder}/t.csv", f"{folder}/t.parquet")
    with pytest.raises(ValueError):
        tables.read_telemetry(spark, folder, "xls")


def test_run_log_round_trip(spark, folder):
    runs = spark.createDataFrame([(1, "e", "single", 2.5, "ok", "extra")],
                                 "block int, engine string, execution_mode string, energy_j double, status string, more string")
    for _ in range(2):
        sinks.append_runs(runs, f"{folder}/runs.csv")
    got = tables.read_runs(spark, f"{folder}/runs.csv")
    names = ["execution_mode" if name == "threading_mode" else name for name, _ in RUN_COLUMNS]
    assert got.columns == names and got.count() == 2 and C.normalise_runs(got).count() == 2
    row = got.first()
    assert (row["energy_j"], row["execution_mode"], row["runtime_s"]) == (2.5, "single", None)


def test_run_log_keeps_other_columns(spark, folder):
    runs = spark.createDataFrame([("x", 1.5, "single", "ok", "more")], "engine string, energy_j double, execution_mode string, status string, note string")
    runs.write.option("header", True).csv(f"{folder}/own.csv")
    row = tables.read_runs(spark, f"{folder}/own.csv").first()
    assert (row["note"], row["execution_mode"], row["energy_j"]) == ("more", "single", 1.5)


def test_optional_table(spark, folder):
    assert tables.read_if_exists(spark, f"{folder}/nothing") is None
    spark.range(3).write.parquet(f"{folder}/some")
    assert tables.read_if_exists(spark, f"{folder}/some").count() == 3


def test_stored_subset_follows_its_source(spark, folder):
    source = f"{folder}/source"
    spark.range(50).select(F.col("id").alias("sample_index")).write.parquet(source)
    read = lambda: spark.read.parquet(source)
    first = sinks.stored_subset(read(), folder, source, 5, "random", 1)
    again = sinks.stored_subset(read().limit(0), folder, source, 5, "random", 1)
    assert first["rows_used"] == again["rows_used"] == 5 and first["parquet_path"] == again["parquet_path"]
    assert spark.read.option("header", True).csv(first["csv_path"]).count() == 5
    assert sinks.stored_subset(read(), folder, source, 6, "random", 1)["rows_used"] == 6
    spark.range(50, 60).select(F.col("id").alias("sample_index")).write.mode("append").parquet(source)
    assert sinks.stored_subset(read(), folder, source, 5, "random", 1)["parquet_path"] != first["parquet_path"]
    with pytest.raises(ValueError, match="no rows"):
        sinks.stored_subset(read().limit(0), folder, source, 7)
    with pytest.raises(ValueError, match="selection"):
        sinks.stored_subset(read(), folder, source, 5, "best")


def test_metadata_and_results(spark, folder):
    runs = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "block int, config_id string")
    meta = sinks.run_metadata(runs, f"{folder}/meta.json", {"seed": 42, "filter": None})
    assert meta["configuration_count"] == 2 and meta["measured_run_count"] == 3
    assert spark.read.json(f"{folder}/meta.json").first()["seed"] == 42
    path = sinks.write_result(runs, folder, "table", order=["config_id", "block"])
    assert spark.read.option("header", True).csv(path).count() == 3
