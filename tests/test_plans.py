import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatt.operators import telemetry as B
from tallywatt.plans import ranks as K, segments as G, selection as S


def frame(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    host = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str))
    pdf = pd.DataFrame({"host": host, "t": rng.permutation(n).astype("int64"), "c": rng.integers(0, 1000, n).astype("int64"),
                        "f": np.where(rng.random(n) < 0.1, np.nan, rng.random(n))})
    return pdf


def to_spark(spark, pdf, schema):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema)


@pytest.mark.parametrize("parts", [1, 2, 37])
def test_history_equals_pandas(spark, parts):
    pdf = frame()
    df = to_spark(spark, pdf, "host string, t bigint, c bigint, f double").withColumn(
        "host", F.when(F.col("host") != "3", F.col("host")))  # one null key
    got = G.with_history(df, ["host"], "t", last={"c": "p"}, low={"f": "lo"}, high={"f": "hi"}, index="i", parts=parts)
    got = got.toPandas().sort_values("t").reset_index(drop=True)
    want = pdf.sort_values("t").reset_index(drop=True)
    by = want.groupby("host", dropna=False)
    assert got["i"].tolist() == by.cumcount().tolist()
    assert got["p"].fillna(-1).tolist() == by["c"].shift(1).fillna(-1).tolist()
    assert np.allclose(got["lo"].astype(float), by["f"].cummin().groupby(want["host"]).ffill().astype(float), equal_nan=True)
    assert np.allclose(got["hi"].astype(float), by["f"].cummax().groupby(want["host"]).ffill().astype(float), equal_nan=True)


def test_segments_bound_a_hot_key(spark):
    df = to_spark(spark, frame(), "host string, t bigint, c bigint, f double")
    parts = 20
    largest = G.segmented(df, "t", parts).groupBy("host", G.SEGMENT).count().agg(F.max("count")).first()[0]
    assert largest <= 1.6 * 3000 / parts


def test_history_of_nothing(spark):
    df = spark.createDataFrame([], "host string, t bigint, c bigint, f double")
    assert G.with_history(df, ["host"], "t", last={"c": "p"}, index="i").count() == 0


def test_counter_reset_modes_and_missing(spark):
    rows = [("h", "s", i, *[v] * 4) for i, v in enumerate([1_000_000, 3_000_000, 500_000, None, 700_000])]
    df = spark.createDataFrame(rows, "host string, session_id string, ts bigint, read_bytes bigint, write_bytes bigint, bytes_sent bigint, bytes_recv bigint")
    keep = [r["disk_read_mb"] for r in B.counter_delta(df).orderBy("ts").collect()]
    assert keep == [0.0, 2.0, -2.5, 0.0, 0.0]
    zero = [r["net_sent_kb"] for r in B.counter_delta(df, on_reset="zero").orderBy("ts").collect()]
    assert zero == [0.0, 2000.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        B.counter_delta(df, on_reset="other")


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_average_ranks_with_hot_ties(spark, parts):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(2000) < 0.35, 5.0, np.round(rng.normal(size=2000), 1))
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 2000), "x": x})
    got = K.value_ranks(spark.createDataFrame(pdf), "x", ["k"], parts).toPandas()
    pdf["avg"] = pdf.groupby("k")["x"].rank()
    pdf["low"] = pdf.groupby("k")["x"].rank(method="min")
    both = pdf.drop_duplicates(["k", "x"]).merge(got, left_on=["k", "x"], right_on=["k", "value"])
    assert len(both) == len(got)
    assert (both["avg"] == both["avg_rank"]).all() and (both["low"] == both["min_rank"]).all()


def test_ranks_spread_over_payloads(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 2.0, 1), ("a", None, 1)], "k string, value double, p int")
    got = sorted((r["value"], r["p"], r["avg_rank"]) for r in K.average_ranks(df, ["k"], ["p"], parts=4).collect())
    assert got == [(1.0, 1, 1.5), (1.0, 2, 1.5), (2.0, 1, 3.0)]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 20000])
@pytest.mark.parametrize("size", [S.SIZE, 64])
def test_exact_quantiles(spark, n, size):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "a": rng.normal(size=n), "b": np.round(rng.exponential(size=n), 1)})
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = S.exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], probs, ["g"], size=size).collect()
    assert len(got) == pdf["g"].nunique() * 2 * len(probs)
    for r in got:
        want = np.quantile(pdf.loc[pdf["g"] == r["g"], r["column"]], r["prob"])
        assert abs(r["quantile"] - want) < 1e-12


@pytest.mark.parametrize("size", [S.SIZE, 8])
def test_quantiles_skip_null_and_nan(spark, size):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "a double")
    assert S.exact_quantiles(df, ["a"], [0.5], size=size).first()["quantile"] == 2.0
    assert S.exact_quantiles(df.filter("a is null"), ["a"], [0.5], size=size).count() == 0


def test_quantiles_of_ties_and_null_groups(spark):
    """Positions on the edge between two values that fill the table, and a null key beside 'null'."""
    rows = [(k, v) for k in ("a", None, "null") for v in [1.0] * 700 + [2.0] * 700 + [3.0] * (k == "a") + [0.5] * (k is None)]
    table = S.medians(spark.createDataFrame(rows, "k string, v double"), ["v"], ["k"], extra=[F.count("*").alias("rows")], size=64)
    assert {r["k"]: (r["rows"], r["v_median"]) for r in table.collect()} == {"a": (1401, 2.0), None: (1401, 1.0), "null": (1400, 1.5)}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """With margins on the wrong side, positions lie outside their brackets time and again."""
    margins = iter([-0.3, -0.2, 0.05])
    monkeypatch.setattr(S, "_margin", lambda size: next(margins, 0.2))
    pdf = pd.DataFrame({"v": np.random.default_rng(3).permutation(5000).astype(float)})
    got = S.exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.1, 0.5, 0.9], size=64).collect()
    assert {r["prob"]: r["quantile"] for r in got} == {p: float(np.quantile(pdf["v"], p)) for p in (0.1, 0.5, 0.9)}


def test_selection_with_more_groups_than_a_driver_copy(spark, monkeypatch):
    monkeypatch.setattr(S, "LOCAL_ROWS", 3)
    df = spark.range(3000).selectExpr("id % 7 AS k", "CAST(id * id % 1009 AS DOUBLE) AS v")
    want = df.toPandas().groupby("k")["v"].median()
    got = S.medians(df, ["v"], ["k"], size=64).toPandas().set_index("k")["v_median"]
    assert (want.sort_index() == got.sort_index()).all()


def test_distinct_by_hash(spark, monkeypatch):
    from tallywatt.operators import clean

    once = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    hot = once.unionByName(spark.range(500).select(F.lit(7).cast("bigint").alias("id"), F.lit(7).cast("bigint").alias("v")))
    want = sorted(map(str, hot.distinct().collect()))
    assert sorted(map(str, clean.dedup_stored(hot).collect())) == want
    assert clean.dedup_stored(once) is once
    many = once.unionByName(once)
    assert sorted(map(str, clean.dedup_stored(many, max_repeated=10).collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_average_ranks_of_heavy_values(spark, parts):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.4, 2.0, rng.integers(0, 6, 3000) + (rng.random(3000) < 0.3) * rng.random(3000))
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 3000), "value": x, "p": rng.integers(0, 40, 3000)})
    got = K.average_ranks(spark.createDataFrame(pdf), ["k"], ["p"], parts).toPandas()
    assert got["n"].sum() == 3000
    pdf["want"] = pdf.groupby("k")["value"].rank()
    both = pdf.drop_duplicates(["k", "value", "p"]).merge(got, on=["k", "value", "p"])
    assert len(both) == len(got) and (both["want"] == both["avg_rank"]).all()
    assert (both["total"] == both["k"].map(pdf["k"].value_counts())).all()


def test_heavy_values_get_their_own_range(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0] + [5.0] * 30 + [7.0, 8.0, 9.0]], "value double")
    cuts, tasks = G.tied_cut_points(df, "value", 8)
    assert 5.0 in cuts and tasks[cuts.index(5.0) + 1] > 2 and len(tasks) == len(cuts) + 2
    assert cuts[cuts.index(5.0) + 1] == np.nextafter(5.0, 9)
