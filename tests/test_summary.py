import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatt.functions.values import carbon_grams, eta_label, finite
from tallywatt.operators import quality as Q, summary as S
from tallywatt.plans.small import checked_small

# Published values: mean energy (J) per implementation: overall, csv, parquet,
# object, category, float32, float64, single, parallel.
MATRIX = {
    "polars_eager": [14.58, 18.04, 11.13, 14.08, 15.09, 14.41, 14.75, 16.48, 12.68],
    "polars_lazy": [21.85, 27.76, 15.94, 21.80, 21.91, 21.68, 22.03, 24.80, 18.91],
    "duckdb": [22.72, 25.36, 20.08, 22.22, 23.23, 22.89, 22.56, 24.16, 21.29],
    "pandas_numpy": [30.88, 37.38, 24.38, 34.76, 27.00, 30.60, 31.16, 22.78, 38.98],
    "pandas_pyarrow": [31.80, 39.09, 24.51, 35.29, 28.31, 31.65, 31.95, 23.86, 39.74],
    "python_loops": [242.01, 208.14, 275.88, 234.77, 249.24, 250.12, 233.90, 236.91, 247.11],
    "dask_default": [309.15, 353.12, 265.17, 89.67, 528.63, 309.08, 309.21, 310.35, 307.95],
    "dask_pyarrow": [325.85, 371.98, 279.72, 93.98, 557.72, 327.90, 323.79, 325.47, 326.23],
}


def run_rows(values_by_config):
    rows = []
    for (engine, fmt), values in values_by_config.items():
        for block, y in enumerate(values, 1):
            rows.append((block, f"{engine}__{fmt}", engine, fmt, "float32", "object", "single", float(y), float(y) / 2, 100.0, "ok"))
    return rows


SCHEMA = ("block int, config_id string, engine string, data_format string, numeric_dtype string, categorical_dtype string, "
          "execution_mode string, energy_j double, runtime_s double, peak_rss_mb double, status string")


def test_published_level_means_average_to_overall(spark):
    levels = {"engine": list(MATRIX), "data_format": ["csv", "parquet"]}
    rows = [(e, f, m[1 + i]) for e, m in MATRIX.items() for i, f in enumerate(levels["data_format"])]
    df = spark.createDataFrame(rows, "engine string, data_format string, energy_j double")
    got = {r["engine"]: r for r in S.factor_level_matrix(df, levels).collect()}
    for e, m in MATRIX.items():
        assert abs(got[e]["overall"] - m[0]) < 0.011
        assert got[e]["data_format_csv"] == m[1]
    assert abs(df.agg(F.avg("energy_j")).first()[0] - 124.86) < 0.01


def test_published_carbon_and_ratios(spark):
    df = spark.createDataFrame([(8.98,), (31.49,), (124.86,), (637.88,)], "energy_j double")
    got = [r["co2_mg"] for r in S.with_carbon(df).collect()]
    assert [round(v, 2) for v in got] == [1.55, 5.42, 21.5, 109.86]
    total = spark.range(1).select(carbon_grams(F.lit(159_810.0))).first()[0]
    assert round(total, 2) == 27.52
    runs = spark.createDataFrame(run_rows({("polars_eager", "parquet"): [8.98] * 2, ("dask_pyarrow", "csv"): [637.88] * 2}), SCHEMA)
    row = S.best_worst(runs).first()
    assert (row["best_config"], row["worst_config"]) == ("polars_eager__parquet", "dask_pyarrow__csv")
    assert abs(row["energy_ratio"] - 71.03) < 0.01 and abs(row["energy_reduction_pct"] - 98.59) < 0.01


def test_eta_labels(spark):
    df = spark.createDataFrame([(0.14,), (0.065,), (0.01,), (0.0099,), (None,), (float("nan"),)], "e double")
    assert [r[0] for r in df.select(eta_label(F.col("e"))).collect()] == ["large", "medium", "small", "very small", "", ""]


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "e double")
    assert [r[0] for r in df.select(finite(F.col("e"))).collect()] == [1.0, None, None, None, None]


def test_config_summary_interval_and_single_run(spark):
    rng = np.random.default_rng(0)
    many = rng.normal(50, 3, 10)
    runs = spark.createDataFrame(run_rows({("a", "csv"): many, ("b", "csv"): [7.0]}), SCHEMA)
    got = {r["engine"]: r for r in S.config_summary(runs).collect()}
    a, b = got["a"], got["b"]
    assert (b["energy_rank"], a["energy_rank"], b["energy_sd"], b["t_crit_95"], b["energy_ci95_low"]) == (1, 2, None, None, None)
    half = 2.262157162798205 * many.std(ddof=1) / np.sqrt(10)
    assert abs(a["energy_ci95_low"] - (many.mean() - half)) < 1e-9
    assert abs(a["energy_ci95_high"] - (many.mean() + half)) < 1e-9
    assert a["energy_median"] == np.median(many) and abs(a["energy_cv_percent"] - 100 * many.std(ddof=1) / many.mean()) < 1e-9


def test_summarize_keeps_null_factors_and_ranks_nulls_last(spark):
    rows = run_rows({("a", "csv"): [3.0, 4.0]})
    rows.append((1, "n", None, "csv", "float32", "object", "single", None, None, None, "ok"))
    rows.append((1, "bad", "z", "csv", "float32", "object", "single", 1.0, 1.0, 1.0, "error"))
    got = {r["config_id"]: r for r in S.summarize_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"a__csv", "n"}
    assert got["n"]["energy_rank"] == 2 and got["n"]["engine"] is None and got["n"]["measured_runs"] == 1
    assert got["a__csv"]["energy_j_median"] == 3.5


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 10.0], [5.0, 5.0], list(np.linspace(0, 1, 77))])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    got = S.histogram(df, F.col("x"), 10).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=10)
    assert got["n"].tolist() == counts.tolist()
    assert np.allclose(got["bin_low"], edges[:-1]) and np.allclose(got["bin_high"], edges[1:])


def test_histogram_of_nothing(spark):
    assert S.histogram(spark.createDataFrame([], "x double"), F.col("x")).count() == 0


def test_describe_equals_pandas(spark):
    pdf = pd.DataFrame({"a": np.random.default_rng(1).normal(size=101)})
    got = S.describe(spark.createDataFrame(pdf), ["a"]).first()
    want = pdf["a"].describe()
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("median", "50%"), ("p75", "75%")):
        assert abs(got[mine] - want[theirs]) < 1e-12


def test_main_effects_equals_one_grouping_per_factor(spark):
    runs = spark.createDataFrame(run_rows({("a", "csv"): [1, 2, 3], ("a", "parquet"): [4, 5, 9], ("b", "csv"): [7, 8, 6]}), SCHEMA)
    got = {(r["factor"], r["level"]): r for r in S.main_effects(runs).collect()}
    assert len(got) == 5
    assert got[("data_format", "csv")]["energy_mean"] == 4.5 and got[("data_format", "parquet")]["energy_median"] == 5.0
    assert got[("numeric_dtype", "float32")]["n"] == 9


def test_unstable_hashes(spark):
    df = spark.createDataFrame([("a", 1, 1, "h"), ("a", 1, 1, "g"), ("b", 1, 1, "h"), ("b", 1, 2, "h")],
                               "config_id string, rows_in int, rows_out int, result_hash string")
    assert [r["config_id"] for r in S.unstable_hashes(df).collect()] == ["a"]
    audit = {r["config_id"]: r["n_unique_rows_out"] for r in S.functional_audit(df).collect()}
    assert audit == {"a": 1, "b": 2}


def test_power_handles_zero_runtime(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0)], "energy_j double, runtime_s double")
    assert [(r["avg_power_w"], r["edp_j_s"]) for r in S.with_power(df).collect()] == [(None, 0.0), (2.5, 40.0)]


def test_checked_small_keeps_large_tables_distributed(spark):
    df = spark.range(100)
    assert checked_small(df, 10) is df
    small = checked_small(df, 100)
    assert small is not df and small.count() == 100


def test_small_groups(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [tuple(r) for r in Q.small_groups(df, ["k"]).collect()] == [("b", 1)]
