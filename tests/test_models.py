import math
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatt.functions import dist
from tallywatt.operators import anova, art, diagnostics as G

LEVELS = {"a": ["x", "y", "z"], "b": ["0", "1"], "c": ["p", "q"]}


def runs_frame(spark, blocks=4, drop=0.0, repeats=1, seed=0, effect=2.0):
    rng = np.random.default_rng(seed)
    rows = []
    for block, a, b, c in product(range(1, blocks + 1), *LEVELS.values()):
        for _ in range(repeats):
            y = 100 + effect * "xyz".index(a) + (b == "1") * (a == "y") + 0.7 * block + rng.normal()
            if rng.random() >= drop:
                rows.append((block, a, b, c, float(y)))
    pdf = pd.DataFrame(rows, columns=["block", "a", "b", "c", "y"])
    return pdf, spark.createDataFrame(pdf).withColumn("config_id", F.concat_ws("__", "a", "b", "c"))


def least_squares(pdf, block=True):
    """Sum-contrast design matrix built row by row; SS by dropping a term."""
    def coded(f):
        values = LEVELS[f]
        out = np.zeros((len(pdf), len(values) - 1))
        for i, v in enumerate(pdf[f]):
            k = values.index(v)
            out[i] = -1 if k == len(values) - 1 else np.eye(len(values) - 1)[k]
        return out

    design = anova.Design.of(LEVELS)
    parts = {"Intercept": np.ones((len(pdf), 1))}
    for t in design.terms():
        x = np.ones((len(pdf), 1))
        for f in t:
            x = np.einsum("ij,ik->ijk", x, coded(f)).reshape(len(pdf), -1)
        parts[":".join(t)] = x
    if block:
        ids = sorted(pdf["block"].unique())
        x = np.zeros((len(pdf), len(ids) - 1))
        for i, b in enumerate(pdf["block"]):
            k = ids.index(b)
            x[i] = -1 if k == len(ids) - 1 else np.eye(len(ids) - 1)[k]
        parts["block"] = x
    y = pdf["y"].to_numpy()

    def rss(names):
        x = np.hstack([parts[n] for n in names])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        return float(np.sum((y - x @ beta) ** 2)), x.shape[1], x @ beta

    full, width, fitted = rss(list(parts))
    ss = {n: rss([m for m in parts if m != n])[0] - full for n in parts}
    return ss, full, len(y) - width, fitted


@pytest.mark.parametrize("blocks,drop,repeats", [(4, 0.0, 1), (5, 0.1, 2), (3, 0.0, 3)])
def test_type3_equals_least_squares(spark, blocks, drop, repeats):
    pdf, df = runs_frame(spark, blocks, drop, repeats, seed=blocks)
    ss, rss, dof, _ = least_squares(pdf)
    got = {r["term"]: r for r in anova.type3_anova(df, ["y"], LEVELS).collect()}
    assert abs(got["Residual"]["sum_sq"] - rss) < 1e-7 and got["Residual"]["df"] == dof
    for name, value in ss.items():
        assert math.isclose(got[name]["sum_sq"], value, rel_tol=1e-7, abs_tol=1e-7), name
        f = value / got[name]["df"] / (rss / dof)
        assert math.isclose(got[name]["F"], f, rel_tol=1e-6, abs_tol=1e-7)
        assert got[name]["p_value"] == pytest.approx(dist.f_tail(f, got[name]["df"], dof), rel=1e-5, abs=1e-12)


def test_type3_without_block(spark):
    pdf, df = runs_frame(spark, 4, 0.15, 2, seed=9)
    ss, rss, dof, _ = least_squares(pdf, block=False)
    got = {r["term"]: r for r in anova.type3_anova(df, ["y"], LEVELS, block=None).collect()}
    assert "block" not in got and got["Residual"]["df"] == dof
    for name, value in ss.items():
        assert math.isclose(got[name]["sum_sq"], value, rel_tol=1e-7, abs_tol=1e-7), name


def test_many_tasks_give_the_same_solution(spark, monkeypatch):
    _, df = runs_frame(spark, 40, 0.05, 1, seed=3)
    want = anova.type3_anova(df, ["y"], LEVELS).collect()
    monkeypatch.setattr(anova, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(anova, "MERGE_WIDTH", 4)
    got = {r["term"]: r for r in anova.type3_anova(df, ["y"], LEVELS).collect()}
    for r in want:
        assert math.isclose(got[r["term"]]["sum_sq"], r["sum_sq"], rel_tol=1e-9, abs_tol=1e-9)


def test_residuals_equal_least_squares(spark):
    pdf, df = runs_frame(spark, 5, 0.1, 2, seed=5)
    _, _, _, fitted = least_squares(pdf)
    got = anova.residuals(df, "y", LEVELS).toPandas()
    a = np.sort(got["fitted"].to_numpy())
    assert np.allclose(a, np.sort(fitted), atol=1e-8)
    assert np.allclose(got["y"], got["fitted"] + got["residual"])


def test_empty_cells_are_named(spark):
    _, df = runs_frame(spark, 2)
    with pytest.raises(Exception, match="empty cells"):
        anova.type3_anova(df.filter("not (a = 'x' and b = '0' and c = 'q')"), ["y"], LEVELS).collect()


def test_terms_and_labels():
    design = anova.Design.of(LEVELS)
    assert design.cells == 12 and len(design.terms()) == 7
    assert design.label(0) == ("x", "0", "p") and design.label(11) == ("z", "1", "q")
    with pytest.raises(ValueError):
        anova.Design.of({"f": list(map(str, range(5000)))})


def test_ranked_effects_labels(spark):
    rows = [("a", 0.5), ("b", 0.065), ("c", 0.027), ("d", 0.005), ("Residual", None), ("e", None)]
    df = spark.createDataFrame(rows, "term string, partial_eta2 double")
    got = [(r["term"], r["eta2_interpretation"]) for r in anova.ranked_effects(df).collect()]
    assert got == [("a", "large"), ("b", "medium"), ("c", "small"), ("d", "very small"), ("e", "")]


def test_levene_by_hand(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"config_id": np.repeat(["a", "b", "c"], 30), "y": np.concatenate([rng.normal(0, s, 30) for s in (1, 2, 3)])})
    for center, fn in (("mean", np.mean), ("median", np.median)):
        z = [np.abs(g - fn(g)) for _, g in pdf.groupby("config_id")["y"]]
        every = np.concatenate(z)
        w = (sum(len(v) * (v.mean() - every.mean()) ** 2 for v in z) / 2) / (sum(((v - v.mean()) ** 2).sum() for v in z) / 87)
        got = G.levene(spark.createDataFrame(pdf), "y", center=center).first()
        assert math.isclose(got["statistic"], w, rel_tol=1e-10) and (got["df1"], got["df2"]) == (2, 87)
        assert math.isclose(got["p_value"], dist.f_tail(w, 2, 87), rel_tol=1e-9)


def test_shapiro_published_example(spark):
    # the weights example of Shapiro and Wilk (1965): W = 0.79 for n = 11
    data = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = G.shapiro_wilk(spark.createDataFrame([(float(v),) for v in data], "residual double")).first()
    assert abs(got["statistic"] - 0.79) < 0.005 and abs(got["p_value"] - 0.0067) < 0.0005 and got["n"] == 11


def brute_w(x):
    x = np.sort(x)
    n = len(x)
    m = dist.normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm, u = m @ m, 1 / math.sqrt(n)
    poly = np.polynomial.polynomial.polyval
    a = np.zeros(n)
    a[-1] = m[-1] / math.sqrt(mm) + poly(u, [0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
    a[-2] = m[-2] / math.sqrt(mm) + poly(u, [0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / math.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("n", [12, 500, 3000])
def test_shapiro_with_ties_and_chunks(spark, monkeypatch, n):
    monkeypatch.setattr(G, "POSITIONS_PER_CHUNK", 50)
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 1.0, np.round(rng.normal(size=n), 2)) + 1000
    got = G.shapiro_wilk(spark.createDataFrame(pd.DataFrame({"residual": x}))).first()
    assert math.isclose(got["statistic"], brute_w(x), rel_tol=1e-8)


def test_shapiro_small_and_constant(spark):
    one = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "residual double")
    assert G.shapiro_wilk(one).first()["statistic"] is None
    assert G.shapiro_wilk(one.limit(0)).first()["n"] == 0


def test_shapiro_accepts_normal_scores(spark):
    x = dist.normal_quantile((np.arange(1, 201) - 0.5) / 200)
    got = G.shapiro_wilk(spark.createDataFrame(pd.DataFrame({"residual": x}))).first()
    assert got["statistic"] > 0.99 and got["p_value"] > 0.9 and not got["beyond_range"]


def test_qq_points(spark, monkeypatch):
    monkeypatch.setattr(G, "POSITIONS_PER_CHUNK", 3)
    x = [5.0, 1.0, 5.0, 5.0, 5.0, 5.0, 2.0]
    got = G.qq_points(spark.createDataFrame([(v,) for v in x], "residual double")).orderBy("position").toPandas()
    want = np.sort(x)
    assert np.allclose(got["sample"], (want - want.mean()) / want.std())
    assert np.allclose(got["theoretical"], dist.normal_quantile(np.arange(1, 8) / 8))


def brute_art(pdf, target):
    """Aligned ranks of one term by plain group means."""
    y, cell = pdf["y"], ["a", "b", "c"]
    effect = 0
    for mask in product([0, 1], repeat=len(target)):
        sub = [f for f, m in zip(target, mask) if m]
        mean = pdf.groupby(sub)["y"].transform("mean") if sub else y.mean()
        effect = effect + (-1) ** (len(target) - len(sub)) * mean
    aligned = (y - pdf.groupby(cell)["y"].transform("mean") + effect).round(7)
    return pdf.assign(y=aligned.rank())


def test_art_equals_brute_force(spark):
    pdf, df = runs_frame(spark, 6, seed=11)
    got = {r["term"]: r for r in art.art_anova(df, "y", LEVELS).collect()}
    assert len(got) == 7
    for t in anova.Design.of(LEVELS).terms():
        ss, rss, dof, _ = least_squares(brute_art(pdf, t))
        name = ":".join(t)
        assert math.isclose(got[name]["F"], ss[name] / got[name]["df"] / (rss / dof), rel_tol=1e-6)


def test_art_alignment(spark):
    _, df = runs_frame(spark, 6, seed=12)
    got = art.art_alignment_check(df, "y", LEVELS).collect()
    assert len(got) == 7 and all(r["ok"] for r in got)


def test_art_pooled_has_more_residual_df(spark):
    _, df = runs_frame(spark, 6, seed=13)
    fixed = art.artc_pairwise(df, ["a"], "y", LEVELS).first()["df"]
    pooled = art.artc_pairwise(df, ["a"], "y", LEVELS, block_model="pooled").first()["df"]
    assert pooled - fixed == 5
    with pytest.raises(Exception, match="block_model"):
        art.artc_pairwise(df, ["a"], "y", LEVELS, block_model="other").collect()


def test_artc_pairs_and_within(spark):
    pdf, df = runs_frame(spark, 6, seed=14)
    pairs = art.artc_pairwise(df, ["a"], "y", LEVELS).collect()
    assert [r["contrast"] for r in pairs] == ["x - y", "x - z", "y - z"] or len(pairs) == 3
    aligned = (pdf["y"] - pdf.groupby(["a", "b", "c"])["y"].transform("mean") + pdf.groupby("a")["y"].transform("mean")).round(7)
    ranks = pdf.assign(y=aligned.rank())
    mean = ranks.groupby("a")["y"].mean()
    _, rss, dof, _ = least_squares(ranks)
    for r in pairs:
        left, right = r["left_level"][0], r["right_level"][0]
        assert math.isclose(r["estimate"], mean[left] - mean[right], rel_tol=1e-6)
        assert math.isclose(r["se"], math.sqrt(2 * rss / dof / 24), rel_tol=1e-6)
    within = art.artc_within(df, "b", "a", "y", LEVELS).collect()
    assert sorted(r["a"] for r in within) == ["x", "y", "z"]
    assert all(r["p_holm"] >= r["p_value"] for r in within)


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("f", p) for p in (0.01, 0.04, 0.03, 0.005)] + [("g", 0.6), ("g", 0.5), ("g", None)], "k string, p_value double")
    got = {(r["k"], r["p_value"]): r["p_holm"] for r in art.holm(df, family=["k"]).collect()}
    want = {("f", 0.005): 0.02, ("f", 0.01): 0.03, ("f", 0.03): 0.06, ("f", 0.04): 0.06, ("g", 0.5): 1.0, ("g", 0.6): 1.0}
    for key, value in want.items():
        assert math.isclose(got[key], value, rel_tol=1e-12)
    assert got[("g", None)] is None


def test_tails_against_a_second_library(spark):
    math3 = spark._jvm.org.apache.commons.math3.distribution
    for f, d1, d2 in [(0.3, 2, 7), (4.0, 3, 20), (12.5, 7, 1143), (55.0, 1, 30)]:
        assert math.isclose(dist.f_tail(f, d1, d2), 1 - math3.FDistribution(float(d1), float(d2)).cumulativeProbability(f), rel_tol=1e-6, abs_tol=1e-14)
    for t, d in [(0.5, 3), (2.26, 9), (4.0, 1143)]:
        assert math.isclose(dist.t_two_sided(t, d), 2 * math3.TDistribution(float(d)).cumulativeProbability(-t), rel_tol=1e-9)
    for p, d in [(0.975, 9), (0.9, 1), (0.025, 30), (0.999, 1143)]:
        assert math.isclose(dist.t_quantile(p, d), math3.TDistribution(float(d)).inverseCumulativeProbability(p), rel_tol=1e-7)
    for p in (1e-20, 1e-12, 1e-4, 0.07, 0.3, 0.5, 0.8, 0.95, 1 - 1e-6):
        assert math.isclose(float(dist.normal_quantile(p)), NormalDist().inv_cdf(p), rel_tol=1e-14, abs_tol=1e-14)


def test_tail_limits():
    assert dist.f_tail(0.0, 2, 3) == 1.0 and dist.f_tail(None, 2, 3) is None and dist.f_tail(1.0, 1, 0) is None
    assert 0 < dist.f_tail(50.0, 7, 1143) < 1e-60
    assert dist.t_two_sided(float("inf"), 5) == 0.0 and dist.t_quantile(0.5, 5) == 0.0
    assert abs(dist.t_quantile(0.975, 1) - math.tan(0.475 * math.pi)) < 1e-9


def test_assumption_rule(spark):
    _, df = runs_frame(spark, 6, seed=15)
    got = G.assumption_summary(df.withColumn("w", F.exp(F.col("y") - 100)), ["y", "w"], LEVELS).collect()
    assert len(got) == 6
    methods = {r["outcome"]: r["method"] for r in got}
    assert methods["w"] == "aligned rank transform"
    for r in got:
        assert r["rejected"] == (r["p_value"] < 0.05)


@pytest.mark.parametrize("rows_per_range", [100, 250_000])
def test_rank_moments_equal_brute_force(spark, monkeypatch, rows_per_range):
    """Ties, a value that fills many ranges, a null block, values without a rank."""
    monkeypatch.setattr(art, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(3)
    y = np.where(rng.random(3000) < 0.4, 2.0, rng.integers(0, 6, 3000) + (rng.random(3000) < 0.5) * rng.random(3000))
    blocks = [f"b{i}" if i else None for i in rng.integers(0, 40, 3000)]
    rows = list(zip(rng.integers(0, 4, 3000).tolist(), blocks, y.tolist())) + [(0, "b1", None), (1, "b2", float("nan"))]
    runs = spark.createDataFrame(rows, "cell int, block string, y double")
    shifts = np.array([[0.0, 0.0, 0.0, 0.0], [0.5, -3.0, 1.25, 1e-3], [1e3, 0.0, -1e3, 0.0]])
    got = art._rank_moments(art.Aligned(runs, ["same", "near", "far"], shifts, 1e6)).toPandas()
    pdf = pd.DataFrame(rows[:3000], columns=["cell", "block", "y"]).assign(block=lambda d: d["block"].fillna("none"))
    got = got.assign(block=got["block"].fillna("none")).set_index(["term", "cell", "block"])
    assert got.index.is_unique
    for name, shift in zip(["same", "near", "far"], shifts):
        pdf["r"] = (np.rint((pdf["y"] + shift[pdf["cell"]]) * 1e6) / 1e6).rank() - 3001 / 2
        want = pdf.groupby(["cell", "block"])["r"].agg(["size", "mean", lambda r: ((r - r.mean()) ** 2).sum()])
        own = got.loc[name].reindex(want.index)
        assert len(got.loc[name]) == len(want) and (own["n"] == want["size"]).all()
        assert np.allclose(own["mean"], want["mean"], atol=1e-6) and np.allclose(own["m2"], want.iloc[:, 2], rtol=1e-9, atol=1e-3)


def test_aligned_rows_are_sent_once_per_range():
    """Not once per target, where the targets' values lie close together."""
    shifts = np.random.default_rng(1).normal(0, 0.01, (31, 6))
    y, cell = np.linspace(0, 100, 10_001), np.arange(10_001) % 6
    cuts = np.arange(1.0, 100.0)
    row, at = art._ranges_met(art.Aligned(None, [str(i) for i in range(31)], shifts, 1e9), cuts, y, cell)
    assert len(row) < 1.1 * len(y)
    every = {(r, int(np.searchsorted(cuts, v, "right"))) for s in shifts for r, v in enumerate(np.rint((y + s[cell]) * 1e9) / 1e9)}
    assert set(zip(row.tolist(), at.tolist())) == every and len(row) == len(every)
