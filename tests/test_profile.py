import math

import pytest
from pyspark.sql import functions as F

from tallywatt.operators import profile as P, quality as Q
from tallywatt.operators.features import derive
from tallywatt.sources import adapters as A
from tallywatt.sources.tables import events


@pytest.fixture(scope="module")
def telemetry(spark, sf_dir):
    return A.telemetry_from_events(events(spark, sf_dir)).persist()


def test_single_row_std_is_null_and_null_key_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0), (None, None)], "k string, x double")
    got = {r["k"]: r for r in P.profile(df, ["k"], ["x"]).collect()}
    assert got["a"]["x_std"] is None and got["a"]["x_count"] == 1
    assert got[None]["x_count"] == 2 and got[None]["x_mean"] == 3.0 and got[None]["x_std"] == math.sqrt(2)


def test_profile_shape(telemetry):
    got = P.telemetry_profile(telemetry)
    assert len(got.columns) == 3 + 17 * 5
    assert got.columns[3:8] == [f"cpu_freq_mhz_{s}" for s in ("count", "mean", "std", "min", "max")]


def test_constant_numeric_column_is_not_profiled(telemetry):
    got = P.telemetry_profile(A.with_constants(telemetry))
    assert "swap_used_mb_mean" not in got.columns and len(got.columns) == 3 + 16 * 5


def test_repeats_do_not_change_the_profile(telemetry):
    once = Q.fingerprint(P.telemetry_profile(telemetry)).first()
    twice = Q.fingerprint(P.telemetry_profile(A.with_repeats(telemetry))).first()
    assert once == twice


def test_fingerprint_ignores_order_and_sees_changes(telemetry):
    want = Q.fingerprint(telemetry).first()
    assert Q.fingerprint(telemetry.orderBy(F.rand(3)).repartition(7)).first() == want
    assert Q.fingerprint(telemetry.withColumn("core_id", F.lit("x"))).first() != want
    assert Q.fingerprint(A.with_repeats(telemetry)).first()["rows"] == want["rows"] + 20


def test_merge_equals_direct(telemetry):
    rows = derive(telemetry).withColumn("part", F.col("sample_index") % 5)
    merged = P.merge_profiles(P.partial_profile(rows, ["part", *P.PROFILE_KEYS]), P.PROFILE_KEYS)
    wide = P.profile(rows)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_count").cast("double").alias("count"),
                 *[F.col(f"{c}_{s}").cast("double").alias(s) for s in ("mean", "std", "min", "max")])
        for c in P.profiled_columns(rows)])
    direct = wide.select(*P.PROFILE_KEYS, F.inline(entries))
    named = [df.withColumnRenamed("column", "name") for df in (merged, direct)]
    cells = Q.equal_within(*named, [*P.PROFILE_KEYS, "name"], rtol=1e-9, atol=1e-9)
    assert cells.count() == direct.count() * 5 > 0
    assert cells.filter("not equal").count() == 0


def test_merge_keeps_digits_far_from_zero(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("part"), (F.lit(1e9) + F.col("id") % 10).alias("x"), F.lit("k").alias("k"))
    got = P.merge_profiles(P.partial_profile(df, ["part", "k"], ["x"]), ["k"]).first()
    want = df.agg(F.stddev_samp(F.col("x") - 1e9)).first()[0]
    assert abs(got["std"] - want) < 1e-6


def test_csv_and_parquet_give_equal_profiles(spark, telemetry, folder):
    from tallywatt.sources import sinks
    from tallywatt.sources.tables import read_telemetry

    text = telemetry.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    sinks.write_pair(text, folder)
    a = P.telemetry_profile(read_telemetry(spark, f"{folder}/subset.csv", "csv"))
    b = P.telemetry_profile(read_telemetry(spark, f"{folder}/subset.parquet"))
    dirty = P.telemetry_profile(read_telemetry(spark, f"{folder}/subset.csv", "csv", dirty=True))
    assert a.columns == b.columns == dirty.columns
    assert Q.fingerprint(a).first() == Q.fingerprint(b).first() == Q.fingerprint(dirty).first()


def test_float32_is_close_to_float64(telemetry):
    cells = Q.equal_within(P.telemetry_profile(telemetry), P.telemetry_profile(telemetry, "float"), P.PROFILE_KEYS, 1e-4, 1e-6)
    assert cells.filter("not equal").count() == 0
    assert cells.count() == 32 * 85


def test_equal_within_reports_one_sided_and_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1.0), (None, 2.0), ("y", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-7), (None, 2.5), ("y", None), ("z", 1.0), ("z", 1.0)], "k string, v double")
    got = {r["k"]: r["equal"] for r in Q.equal_within(a, b, ["k"]).collect()}
    assert got == {"x": True, None: False, "y": True, "z": False}


def test_validate_and_copies(spark, telemetry):
    report = {(r["check"], r["column"]): r["value"] for r in Q.validate_telemetry(
        telemetry.drop("core_id").withColumn("more", F.lit(1)), telemetry).collect()}
    assert report[("missing", "core_id")] == 1 and report[("extra", "more")] == 1
    assert report[("duplicate_rows", None)] == 0 and report[("constant", "more")] == 1
    assert report[("copy_same_row_count", None)] == 1 and report[("copy_same_column_order", None)] == 0
    assert report[("copy_only_in_first", None)] is None
