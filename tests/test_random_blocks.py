"""Aligned ranks with unbalanced logs and random blocks, against explicit matrices."""

import math

import numpy as np
import pytest
from test_models import LEVELS, brute_art, least_squares, runs_frame

from tallywatt.functions import dist
from tallywatt.operators import anova, art


def design_columns(pdf):
    """Constant and sum contrasts of every term, row by row."""
    design, parts = anova.Design.of(LEVELS), {"Intercept": np.ones((len(pdf), 1))}
    for t in design.terms():
        x = np.ones((len(pdf), 1))
        for f in t:
            values = LEVELS[f]
            coded = np.array([[-1.0] * (len(values) - 1) if v == values[-1] else [float(v == w) for w in values[:-1]] for v in pdf[f]])
            x = np.einsum("ij,ik->ijk", x, coded).reshape(len(pdf), -1)
        parts[":".join(t)] = x
    return parts


def kenward_roger(pdf):
    """term -> (F, denominator df) of the model with a random block: restricted
    likelihood by search, then the approximation from the full covariance matrix."""
    parts = design_columns(pdf)
    x = np.hstack(list(parts.values()))
    y = pdf["y"].to_numpy()
    z = np.equal.outer(pdf["block"].to_numpy(), np.sort(pdf["block"].unique())).astype(float)
    n, p = x.shape

    def fit(ratio):
        inv = np.linalg.inv(np.eye(n) + ratio * z @ z.T)
        phi = np.linalg.inv(x.T @ inv @ x)
        beta = phi @ x.T @ inv @ y
        rss = (y - x @ beta) @ inv @ (y - x @ beta)
        likelihood = -0.5 * ((n - p) * math.log(rss) - np.linalg.slogdet(inv)[1] - np.linalg.slogdet(phi)[1])
        return likelihood, rss / (n - p), beta

    low, high = -14.0, 6.0  # logs of the ratio of variances
    for _ in range(90):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if fit(math.exp(a))[0] < fit(math.exp(b))[0] else (low, b)
    ratio = math.exp(low)
    if fit(0.0)[0] >= fit(ratio)[0]:
        ratio = 0.0
    _, variance, beta = fit(ratio)
    v = np.linalg.inv(variance * (np.eye(n) + ratio * z @ z.T))
    g = [z @ z.T, np.eye(n)]
    phi = np.linalg.inv(x.T @ v @ x)
    pi = [-x.T @ v @ k @ v @ x for k in g]
    q = [[x.T @ v @ j @ v @ k @ v @ x for k in g] for j in g]
    info = np.array([[0.5 * (np.trace(v @ g[i] @ v @ g[j]) - 2 * np.trace(phi @ q[i][j]) + np.trace(phi @ pi[i] @ phi @ pi[j]))
                      for j in range(2)] for i in range(2)])
    w = np.linalg.inv(info)
    adjusted = phi + 2 * phi @ sum(w[i, j] * (q[i][j] - pi[i] @ phi @ pi[j]) for i in range(2) for j in range(2)) @ phi
    out, at = {}, 0
    for name, part in parts.items():
        k = part.shape[1]
        own = np.eye(p)[:, at:at + k]
        at += k
        theta = own @ np.linalg.inv(own.T @ phi @ own) @ own.T
        t = [theta @ phi @ m @ phi for m in pi]
        a1 = sum(w[i, j] * np.trace(t[i]) * np.trace(t[j]) for i in range(2) for j in range(2))
        a2 = sum(w[i, j] * np.trace(t[i] @ t[j]) for i in range(2) for j in range(2))
        b = (a1 + 6 * a2) / (2 * k)
        h = ((k + 1) * a1 - (k + 4) * a2) / ((k + 2) * a2)
        c = [c / (3 * k + 2 * (1 - h)) for c in (h, k - h, k + 2 - h)]
        mean, spread = 1 / (1 - a2 / k), 2 / k * (1 + c[0] * b) / ((1 - c[1] * b) ** 2 * (1 - c[2] * b))
        m = 4 + (k + 2) / (k * spread / (2 * mean ** 2) - 1)
        scale = m / (mean * (m - 2))
        e = own.T @ beta
        out[name] = (scale / k * e @ np.linalg.inv(own.T @ adjusted @ own) @ e, m)
    return out, ratio


@pytest.mark.parametrize("levelled", [False, True])
def test_mixed_equals_the_random_block_model(spark, levelled):
    pdf, df = runs_frame(spark, 6, seed=21)
    if levelled:  # blocks without differences: their variance is estimated as zero
        pdf["y"] += pdf["y"].mean() - pdf.groupby("block")["y"].transform("mean")
        df = spark.createDataFrame(pdf)
    got = {r["term"]: r for r in art.art_anova(df, "y", LEVELS, block_model="mixed").collect()}
    fixed = {r["term"]: r for r in art.art_anova(df, "y", LEVELS).collect()}
    zero = set()
    for t in anova.Design.of(LEVELS).terms():
        name = ":".join(t)
        told, ratio = kenward_roger(brute_art(pdf, t))
        zero.add(ratio == 0)
        f, dof = told[name]
        assert math.isclose(got[name]["F"], f, rel_tol=1e-5)
        assert got[name]["p_value"] == pytest.approx(dist.f_tail(f, got[name]["df"], dof), rel=1e-4)
        assert math.isclose(got[name]["F"], fixed[name]["F"], rel_tol=1e-9) == (ratio > 0)
    assert zero == {levelled}


def test_mixed_contrasts(spark):
    pdf, df = runs_frame(spark, 6, seed=22)
    same = [art.artc_pairwise(df, ["a"], "y", LEVELS, block_model=m).collect() for m in ("fixed", "mixed")]
    for one, two in zip(*same):  # blocks differ: both are the within-block solution
        assert math.isclose(one["se"], two["se"], rel_tol=1e-9) and one["df"] == two["df"]
    pdf["y"] += pdf["y"].mean() - pdf.groupby("block")["y"].transform("mean")
    level = spark.createDataFrame(pdf)
    pooled, mixed = (art.artc_pairwise(level, ["a"], "y", LEVELS, block_model=m).first() for m in ("pooled", "mixed"))
    assert math.isclose(pooled["se"], mixed["se"], rel_tol=1e-9) and pooled["df"] - mixed["df"] == 5
    with pytest.raises(Exception, match="as many runs"):
        art.art_anova(runs_frame(spark, 5, 0.1, 2, seed=5)[1], "y", LEVELS, block_model="mixed").collect()


def aligned_by_hand(pdf, target):
    """Ranks of what the least squares cell effects leave, plus the target's effect."""
    parts = design_columns(pdf)
    ids = sorted(pdf["block"].unique())
    blocks = np.array([[-1.0] * (len(ids) - 1) if b == ids[-1] else [float(b == w) for w in ids[:-1]] for b in pdf["block"]])
    x = np.hstack([*parts.values(), blocks])
    beta, *_ = np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)
    at, effects = 0, {}
    for name, part in parts.items():
        effects[name] = part @ beta[at:at + part.shape[1]]
        at += part.shape[1]
    left = pdf["y"].to_numpy() - sum(effects.values()) + effects[":".join(target)]
    return pdf.assign(y=left.round(6)).assign(y=lambda d: d["y"].rank())


def test_unbalanced_art_equals_least_squares(spark):
    pdf, df = runs_frame(spark, 5, 0.2, 2, seed=23)
    got = {r["term"]: r for r in art.art_anova(df, "y", LEVELS).collect()}
    for t in anova.Design.of(LEVELS).terms():
        ss, rss, dof, _ = least_squares(aligned_by_hand(pdf, t))
        name = ":".join(t)
        assert math.isclose(got[name]["F"], ss[name] / got[name]["df"] / (rss / dof), rel_tol=1e-6)


def test_unbalanced_alignment_leaves_only_the_target(spark):
    pdf, df = runs_frame(spark, 6, 0.3, 2, seed=24)
    got = art.art_alignment_check(df, "y", LEVELS).collect()
    assert len(got) == 7 and all(r["ok"] for r in got)
    assert all(r["target_sum_sq"] > 1e3 * r["largest_other_sum_sq"] for r in got)


def test_unbalanced_contrasts(spark):
    pdf, df = runs_frame(spark, 5, 0.2, 2, seed=25)
    for model in ("fixed", "pooled"):
        for r in art.artc_pairwise(df, ["a"], "y", LEVELS, block_model=model).collect():
            assert r["se"] > 0 and math.isclose(r["t_ratio"], r["estimate"] / r["se"], rel_tol=1e-12)
    # a main effect of one degree of freedom: the contrast's t is the root of its F
    term = {r["term"]: r for r in art.art_anova(df, "y", LEVELS).collect()}["b"]
    design = anova.Design.of(LEVELS)
    assert np.allclose(design.averaging(["b"]) - 1 / design.cells, design.effect(["b"]))
    pair = art.artc_pairwise(df, ["b"], "y", LEVELS).first()
    assert math.isclose(pair["t_ratio"] ** 2, term["F"], rel_tol=1e-6)


def test_disconnected_blocks_are_an_error(spark):
    pdf, df = runs_frame(spark, 2, seed=26)
    apart = df.filter("(a = 'x' and block = 1) or (a <> 'x' and block = 2)")
    with pytest.raises(Exception, match="cannot be told apart"):
        anova.type3_anova(apart, ["y"], LEVELS).collect()
