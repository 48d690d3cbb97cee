"""Tail and quantile functions of the F, t and normal distributions.

Used on result tables of a few rows, and for normal scores (vectorised).
"""

from __future__ import annotations

import math

import numpy as np


STEPS = 1_000_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta function at a={a}, b={b}, x={x} did not converge")


#: Beyond this the fraction's first terms cancel; the integral's do not.
LARGE = 1e5
_NODES, _WEIGHTS = np.polynomial.laguerre.laggauss(120)


def _beta_tail(a: float, b: float, x: float, rest: float) -> float:
    """a times the integral of t^(a-1) (1-t)^(b-1) up to x over x^a (1-x)^b: with
    t = x exp(-s / a) an integral of exp(-s) times a smooth function."""
    y = (rest - x * np.expm1(-_NODES / a)) / rest
    return float(_WEIGHTS @ y ** (b - 1.0)) / rest


def _stirling(z: float) -> float:
    """lgamma(z) less (z - 1/2) log z - z + log(2 pi) / 2, for z of 10 or more."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z


def log_beta(a: float, b: float) -> float:
    """log B(a, b) without the difference of large log-gammas."""
    a, b = max(a, b), min(a, b)
    if a < 10:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # log of gamma(a) / gamma(a + b)
    ratio = b - (a - 0.5) * math.log1p(b / a) - b * math.log(a + b) + _stirling(a) - _stirling(a + b)
    if b < 10:
        return math.lgamma(b) + ratio
    return (b - 0.5) * math.log(b) - b + 0.5 * math.log(2 * math.pi) + _stirling(b) + ratio


def beta_regularized(a: float, b: float, x: float, rest: float | None = None) -> float:
    """I_x(a, b); ``rest`` is 1 - x where the caller knows it more exactly."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_x = math.log1p(-rest) if rest < 0.5 else math.log(x)
    log_rest = math.log1p(-x) if x < 0.5 else math.log(rest)
    front = math.exp(a * log_x + b * log_rest - log_beta(a, b))
    if rest > (b + 1.0) / (a + b + 2.0):
        tail = _beta_tail(a, b, x, rest) if a > LARGE else _beta_fraction(a, b, x)
        return front * tail / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def f_tail(f: float | None, df1: float, df2: float) -> float | None:
    """P(F > f)."""
    if f is None or math.isnan(f) or df1 <= 0 or df2 <= 0:
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_regularized(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


def t_two_sided(t: float | None, df: float) -> float | None:
    """P(|T| > |t|)."""
    if t is None or math.isnan(t) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return beta_regularized(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_quantile(p: float, df: float) -> float | None:
    """t with P(T <= t) = p, by bisection on the tail."""
    if df is None or not df > 0:
        return None
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    tail = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# Coefficients of the public normal quantile approximation AS 241
# (constant term first).
_MID_NUM = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
            45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
_MID_DEN = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
            21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
_NEAR_NUM = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
             1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640]
_NEAR_DEN = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
             0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9]
_FAR_NUM = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
            0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_FAR_DEN = [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
            0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def normal_quantile(p) -> np.ndarray:
    """Vectorised inverse of the standard normal distribution function."""
    p = np.asarray(p, dtype=float)
    poly = np.polynomial.polynomial.polyval
    q = p - 0.5
    with np.errstate(all="ignore"):
        central = q * poly(0.180625 - q * q, _MID_NUM) / poly(0.180625 - q * q, _MID_DEN)
        r = np.sqrt(-np.log(np.where(q < 0, p, 1.0 - p)))
        near = poly(r - 1.6, _NEAR_NUM) / poly(r - 1.6, _NEAR_DEN)
        far = poly(r - 5.0, _FAR_NUM) / poly(r - 5.0, _FAR_DEN)
        outer = np.sign(q) * np.where(r <= 5.0, near, far)
    return np.where(np.abs(q) <= 0.425, central, outer)
