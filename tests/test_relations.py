import numpy as np
import pandas as pd
import pytest


from tallywatt.operators import relations as R
from tallywatt.plans.segments import add_segments, value_ranges


def dominated(values):
    """Quadratic reference: j <= i everywhere and < somewhere."""
    n = len(values)
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        le = np.all(values <= values[i], axis=1)
        lt = np.any(values < values[i], axis=1)
        out[i] = np.any(le & lt)
    return out


@pytest.mark.parametrize("d,kind,parts", [(2, "ties", 5), (2, "anti", 16), (3, "ties", 4), (3, "anti", 6), (4, "anti", 3), (3, "hot", 7), (3, "ten", 6), (4, "ten", 5), (2, "one", 6)])
def test_pareto_equals_brute_force(spark, d, kind, parts):
    rng = np.random.default_rng(d)
    n = 700
    if kind == "ties":
        v = rng.integers(0, 12, (n, d)).astype(float)
    elif kind == "anti":  # long fronts
        v = rng.random((n, d))
        v[:, -1] = np.round(2 - v[:, :-1].sum(axis=1) + 0.05 * rng.random(n), 3)
    elif kind in ("ten", "one"):  # an objective of few values before a long front
        v = rng.random((n, d))
        v[:, 0] = rng.integers(0, 10, n) / 10 if kind == "ten" else 0.5
        v[:, -1] = np.round(2 - v[:, :-1].sum(axis=1) + 0.05 * rng.random(n), 3)
    else:  # one leading value holds a third of the rows
        v = rng.random((n, d))
        v[rng.random(n) < 0.35, 0] = 0.2
    v[5, 0] = np.nan
    cols = [f"o{i}" for i in range(d)]
    pdf = pd.DataFrame(v, columns=cols).assign(i=range(n))
    got = R.pareto(spark.createDataFrame(pdf).repartition(6), cols, parts=parts).toPandas().sort_values("i")
    assert (got["pareto"].to_numpy() == ~dominated(v)).all()


@pytest.mark.parametrize("d", [2, 3, 4, 5])
@pytest.mark.parametrize("kinds", [3, 40, None])
def test_skyline_equals_brute_force(d, kinds):
    rng = np.random.default_rng(d)
    for n in (0, 1, 2, 63, 65, 900):
        v = rng.random((n, d)) if kinds is None else rng.integers(0, kinds, (n, d)).astype(float)
        if kinds is None and n:
            v[:, -1] = 2 - v[:, :-1].sum(axis=1) + 0.1 * rng.random(n)
        assert (R._skyline(v) == ~dominated(v)).all()


def test_strips_of_an_objective_of_ten_values_split(spark):
    """Every group that a task compares holds about one share of the front."""
    rng = np.random.default_rng(1)
    v = rng.random((6000, 3))
    v[:, 0] = rng.integers(0, 10, 6000) / 10
    v[:, 2] = 5 - v[:, 0] - v[:, 1]  # nothing dominates anything
    df = spark.createDataFrame(pd.DataFrame(v, columns=["a", "b", "c"])).repartition(6)
    assert R.pareto_front(df, ["a", "b", "c"], parts=20).count() == 6000
    ranges = value_ranges(df, ["a", "b"], 20)
    assert ranges["a"].single and not ranges["b"].single
    cut = add_segments(df, {c: ranges[c].cuts for c in ("a", "b")}, {"a": "ga", "b": "gb"})
    loose = ~cut["ga"].isin(ranges["a"].single)
    largest = [cut.filter(loose).groupBy("ga"), cut.filter(~loose).groupBy("ga", "gb"), cut.groupBy("gb")]
    assert max(r["count"] for g in largest for r in g.count().collect()) < 2 * 6000 / 20


def test_pareto_needs_two_objectives(spark):
    with pytest.raises(ValueError):
        R.pareto(spark.range(3), ["id"])


def test_pareto_nulls_and_equal_points(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (None, 9.0)], "a double, b double")
    got = sorted(map(str, ((r["a"], r["b"], r["pareto"]) for r in R.pareto(df, ["a", "b"]).collect())))
    assert got == ["(1.0, 1.0, True)", "(1.0, 1.0, True)", "(2.0, 1.0, False)", "(None, 9.0, True)"]


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(1500) < 0.4, 1.0, rng.normal(size=1500).round(1))
    pdf = pd.DataFrame({"x": x, "y": (x + rng.normal(size=1500)).round(1)})
    df = spark.createDataFrame(pdf)
    assert abs(R.pearson(df, "x", "y").first()["statistic"] - pdf.corr().iloc[0, 1]) < 1e-12
    assert abs(R.spearman(df, "x", "y").first()["statistic"] - pdf.corr("spearman").iloc[0, 1]) < 1e-12


def test_correlation_p(spark):
    from tallywatt.functions import dist

    df = spark.createDataFrame([(0.039, 1280), (1.0, 10)], "statistic double, n bigint")
    got = [r["p_value"] for r in R._with_p(df).orderBy("statistic").collect()]
    assert abs(got[0] - 0.163) < 0.002 and got[1] == 0.0
    assert abs(got[0] - dist.t_two_sided(0.039 * (1278 / (1 - 0.039 ** 2)) ** 0.5, 1278)) < 1e-12


def test_leave_one_block_out_with_a_missing_cell(spark):
    rows = [("a", b, 1.0 + b) for b in (1, 2, 3)] + [("b", b, 2.5) for b in (1, 3)] + [("c", b, 9.0) for b in (1, 2, 3)]
    df = spark.createDataFrame(rows, "config_id string, block int, energy_j double")
    got = {r["excluded_block"]: r for r in R.leave_one_block_out(df).collect()}
    pdf = pd.DataFrame(rows, columns=["c", "b", "y"])
    full = pdf.groupby("c")["y"].mean().sort_values().index[0]
    kept = 0
    for b in (1, 2, 3):
        means = pdf[pdf["b"] != b].groupby("c")["y"].mean().sort_values()
        assert got[b]["best_config_after_exclusion"] == means.index[0]
        assert got[b]["best_mean_energy_after_exclusion"] == means.iloc[0]
        assert got[b]["full_sample_best_config"] == full
        assert got[b]["rank_of_full_sample_best"] == means.rank(method="min")[full]
        kept += means.rank(method="min")[full] == 1
    assert R.best_stability(R.leave_one_block_out(df)).first().asDict() == {"kept_rank_1": kept, "exclusions": 3}


def test_position_drift(spark):
    df = spark.createDataFrame([(i, float(-i)) for i in range(10)], "position_in_block int, residual double")
    got = R.position_drift(df).first()
    assert got["n"] == 10 and abs(got["spearman_rho"] + 1) < 1e-12
    assert got["p_value"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_leave_one_out_of_sparse_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"c{c:02d}", int(b), float(rng.integers(1, 12))) for c in range(30)
            for b in rng.choice(12, rng.integers(1, 4), replace=False) for _ in range(rng.integers(1, 3))]
    pdf = pd.DataFrame(rows, columns=["config_id", "block", "energy_j"])
    full = pdf.groupby("config_id")["energy_j"].mean()
    first = min(full.index, key=lambda c: (full[c], c))
    got = {r["excluded_block"]: r for r in R.leave_one_block_out(spark.createDataFrame(pdf)).collect()}
    assert set(got) == set(pdf["block"])
    for block, r in got.items():
        rest = pdf[pdf["block"] != block].groupby("config_id")["energy_j"].mean()
        best = min(rest.index, key=lambda c: (round(rest[c], 9), c))
        assert r["best_config_after_exclusion"] == best and abs(r["best_mean_energy_after_exclusion"] - rest[best]) < 1e-9
        assert r["full_sample_best_config"] == first
        rank = 1 + sum(rest < rest[first] - 1e-9) if first in rest.index else 1 + len(rest)
        assert r["rank_of_full_sample_best"] == rank
