"""Tails and quantiles as SQL, by ways of their own: quadrature and AS 241."""

from __future__ import annotations

from tallywatt.functions import dist

STEPS = 4000


def f_tail(query: str, keep: str) -> str:
    """(keep, p): P(F > f) on d1 and d2 degrees of freedom for each row of a
    query with the columns of ``keep``, f, d1 and d2.

    The beta integral in the angle whose squared tangent is d1 f / d2, by
    Simpson's rule; far from its start the integrand is nothing.
    """
    # lgamma((d1 + d2) / 2) - lgamma(d2 / 2) without the difference of large numbers
    ratio = ("CASE WHEN d2 < 1e6 THEN lgamma((d1 + d2) / 2) - lgamma(d2 / 2) "
             "ELSE d1 / 2 * ln(d2 / 2) + d1 / 2 * (d1 / 2 - 1) / d2 END")
    angle = "(lo + i * h)"
    # log of the cosine; the series where the cosine is close to 1
    log_cos = (f"CASE WHEN {angle} < 2e-2 THEN -pow({angle}, 2) / 2 - pow({angle}, 4) / 12 - pow({angle}, 6) / 45 - 17 * pow({angle}, 8) / 2520 "
               f"ELSE ln(greatest(cos({angle}), 1e-300)) END")
    return f"""SELECT {keep}, sum(CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(c + (d2 - 1) * ({log_cos}) + (d1 - 1) * ln(greatest(sin({angle}), 1e-300)))) * any_value(h) / 3 AS p
FROM (SELECT *, least(pi() / 2 - lo, 14 / sqrt(d2)) / {STEPS} AS h, ln(2e0) - lgamma(d1 / 2) + {ratio} AS c
  FROM (SELECT *, atan(sqrt(d1 * f / d2)) AS lo FROM ({query}))), range(0, {STEPS + 1}) AS s(i) GROUP BY ALL"""


def normal_tail(z: str) -> str:
    """P(Z > z) of one value."""
    return f"""(SELECT CASE WHEN z < 0 THEN 1 - p ELSE p END FROM (SELECT any_value(z) AS z, sum(CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-pow(abs(z) + i * 12e0 / {STEPS}, 2) / 2)) * 12 / {STEPS} / 3 / sqrt(2 * pi()) AS p FROM (SELECT {z} AS z), range(0, {STEPS + 1}) AS s(i)))"""


def _ratio(x: str, top: list[float], bottom: list[float]) -> str:
    def horner(c: list[float]) -> str:
        out = f"{c[-1]!r}::DOUBLE"
        for v in reversed(c[:-1]):
            out = f"({out} * {x} + ({v!r}::DOUBLE))"
        return out

    return f"{horner(top)} / {horner(bottom)}"


def normal_quantile(p: str) -> str:
    q, tail = f"(({p}) - 0.5e0)", f"sqrt(-ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * " + _ratio(f"(0.180625e0 - {q} * {q})", dist._MID_NUM, dist._MID_DEN)
    near = _ratio(f"({tail} - 1.6e0)", dist._NEAR_NUM, dist._NEAR_DEN)
    far = _ratio(f"({tail} - 5e0)", dist._FAR_NUM, dist._FAR_DEN)
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {middle} ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {near} ELSE {far} END END"
