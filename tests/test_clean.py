import pytest
from pyspark.sql import Row, functions as F

from tallywatt.functions import states as S
from tallywatt.operators import clean as C
from tallywatt.operators.features import derive
from tallywatt.schema import PUBLISHED_LEVELS, TELEMETRY_COLUMNS


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(spark, fn, values, kind="double"):
    return [r[0] for r in column(spark, values, kind).select(fn(F.col("x"))).collect()]


def test_bin_edges(spark):
    assert apply(spark, S.cpu_state, [19.99, 20.0, 49.99, 50.0, 79.99, 80.0, None]) == [
        "idle", "low", "low", "medium", "medium", "high", None]
    assert apply(spark, S.ram_state, [39.99, 40.0, 75.0]) == ["low", "medium", "high"]
    assert apply(spark, S.swap_state, [0.99, 1.0, 100.0]) == ["none", "low", "high"]
    assert apply(spark, S.process_load_tier, [99, 100, 299, 300], "bigint") == ["light", "normal", "normal", "heavy"]
    assert apply(spark, S.temp_state, [39.9, 40.0, 60.0, None]) == ["cool", "warm", "hot", "unknown"]
    assert apply(spark, lambda x: S.disk_activity(x, F.lit(0.0)), [-5.0, 0.09, 0.1, 10.0]) == ["idle", "idle", "light", "heavy"]
    assert apply(spark, lambda x: S.net_activity(x, F.lit(0.5)), [0.4, 0.5, 99.5]) == ["idle", "light", "heavy"]


def test_freq_tier(spark):
    rows = [(None, 1.0, 2.0), (1.0, 1.0, 1.0), (1.0, 1.0, 2.0), (1.5, 1.0, 2.0), (2.0, 1.0, 2.0), (1.0, None, None)]
    df = spark.createDataFrame(rows, "f double, lo double, hi double")
    got = [r[0] for r in df.select(S.freq_tier(F.col("f"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["unknown", "mid", "low", "mid", "high", "mid"]


def test_time_bins(spark):
    hours = [4, 5, 11, 12, 16, 17, 20, 21]
    df = spark.createDataFrame([(f"2024-01-06 {h:02d}:00:00",) for h in hours] + [("2024-01-08 00:00:00",)], "t string")
    got = df.select(S.time_period(F.to_timestamp("t")), S.weekday_type(F.to_timestamp("t"))).collect()
    assert [r[0] for r in got] == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night", "night"]
    assert [r[1] for r in got] == ["weekend"] * 8 + ["weekday"]


def test_busiest_core_ties_and_missing(spark):
    df = spark.createDataFrame([([1.0, 9.0, 9.0],), (None,), ([],)], "a array<double>")
    assert [r[0] for r in df.select(S.busiest_core(F.col("a"))).collect()] == ["core_1", "core_0", "core_0"]


def test_cpu_temp_preference(spark):
    e = lambda label, v: Row(label=label, current=v)
    rows = [
        ({"acpitz": [e("", 1.0)], "coretemp": [e("Core", 50.0), e("PACKAGE id", 60.126)]},),
        ({"k10temp": [e("a", 10.0), e("b", 20.0)]},),
        ({"zeta": [e("", 7.0)], "alpha": [e("", 8.0), e("", 9.0)]},),
        ({"coretemp": []},),
        ({},),
        (None,),
    ]
    df = spark.createDataFrame(rows, "s map<string,array<struct<label:string,current:double>>>")
    assert [r[0] for r in df.select(S.cpu_temp(F.col("s"))).collect()] == [60.13, 15.0, 8.0, None, None, None]


def test_check_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing"):
        C.check_columns(df, ["id", "other"])
    assert C.check_columns(df.withColumn("more", F.lit(1)), ["id"]) == ["more"]


def test_cast_numeric_nulls_bad_text_and_nan(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("abc", 2.0), (None, None)], "a string, b double")
    got = C.cast_numeric(df, "float", ["a", "b", "absent"])
    assert dict(got.dtypes) == {"a": "float", "b": "float"}
    assert [tuple(r) for r in got.collect()] == [(1.5, None), (None, 2.0), (None, None)]


def test_constant_columns_counts_null_as_value(spark):
    df = spark.createDataFrame([(1, None, "x", 1.0, None), (1, "x", "x", 2.0, None)],
                               "a int, b string, c string, d double, e double")
    assert C.constant_columns(df, ()) == ["a", "c", "e"]
    assert C.constant_columns(df, ("a",)) == ["c", "e"]


def test_constant_columns_beyond_the_probe(spark):
    df = spark.range(5000, numPartitions=3).select(F.lit(1).alias("one"), (F.col("id") == 4999).alias("late"))
    assert C.constant_columns(df, (), probe=10) == ["one"]


def test_constant_columns_empty(spark):
    assert C.constant_columns(spark.createDataFrame([], "a int, b string"), ()) == ["a", "b"]


def test_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x")], "a int, b string")
    assert C.dedup(df).count() == 2
    assert C.duplicate_rows(df).first()[0] == 1


def test_category_codes_round_trip(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", None, "a", "b", "missing", "z"])], "i int, v string")
    codes = C.category_codes(df, ["v"])
    assert sorted(codes.collect(), key=lambda r: r["code"]) == [
        ("v", "a", 0), ("v", "b", 1), ("v", "missing", 2), ("v", None, 3), ("v", "z", 4)]
    coded = C.encode_categories(df, ["v"])
    assert [r["v"] for r in coded.orderBy("i").collect()] == [1, 3, 0, 1, 2, 4]
    assert sorted(map(str, C.decode_categories(coded, codes, ["v"]).collect())) == sorted(map(str, df.collect()))


def test_derive_keeps_float32(spark):
    df = spark.createDataFrame([("2024-01-01 13:00:00", 30.0, 1.0, 3.0, 0.0, 0.0)],
                               "timestamp string, cpu_percent double, disk_read_mb double, disk_write_mb double, "
                               "net_sent_kb double, net_recv_kb double")
    got = derive(df, "float")
    kinds = dict(got.dtypes)
    assert {kinds[c] for c in ("cpu_headroom", "disk_rw_balance", "hour", "total_disk_throughput")} == {"float"}
    row = got.first()
    assert (row["cpu_headroom"], row["total_disk_throughput"], row["hour"], row["net_sr_balance"]) == (70.0, 4.0, 13.0, 0.0)
    assert abs(row["disk_rw_balance"] + 0.5) < 1e-6


def test_bad_timestamp_becomes_null(spark):
    df = spark.createDataFrame([("bad",), ("2024-01-01T05:06:07.123",)], "timestamp string")
    got = [r[0] for r in C.parse_timestamp(df).collect()]
    assert got[0] is None and got[1].microsecond == 123000


def test_normalise_runs(spark):
    from tallywatt.schema import REQUIRED_RUN_COLUMNS

    cols = ["threading_mode" if c == "execution_mode" else c for c in REQUIRED_RUN_COLUMNS]
    df = spark.createDataFrame([["ok"] * len(cols), ["error"] * len(cols)], ", ".join(f"{c} string" for c in cols))
    got = C.normalise_runs(df)
    assert got.count() == 1 and "execution_mode" in got.columns
    with pytest.raises(ValueError):
        C.normalise_runs(df.drop("block"))


def test_fixed_names():
    assert len(TELEMETRY_COLUMNS) == 24
    assert [len(v) for v in PUBLISHED_LEVELS.values()] == [8, 2, 2, 2, 2]
