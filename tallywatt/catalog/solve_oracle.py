"""Least squares with blocks as SQL: normal equations as nested lists, swept in a recursion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations


class Columns:
    """Sum contrasts of every term as SQL over the factor columns; the outcome is the last column."""

    def __init__(self, levels: Mapping[str, Sequence[str]]) -> None:
        def coded(f: str) -> list[str]:
            *own, last = levels[f]
            return [f"(CASE {f} WHEN '{v}' THEN 1e0 WHEN '{last}' THEN -1e0 ELSE 0e0 END)" for v in own]

        self.terms, self.x = [], []
        for t in (t for k in range(1, len(levels) + 1) for t in combinations(levels, k)):
            parts = [""]
            for f in t:
                parts = [f"{p} * {c}" if p else c for p in parts for c in coded(f)]
            self.terms.append((":".join(t), len(self.x) + 1, len(parts)))
            self.x += parts
        self.y = len(self.x) + 1
        self.factors = ", ".join(levels)

    def swept(self, source: str, name: str = "") -> str:
        """CTEs over ``source`` (target, block, factors, y): ``fit{name}`` has per
        target the swept matrix m, the rows n, the blocks b, what the blocks' levels
        add up to (s1: by column, s0: 1 / rows) and the mean g taken off y. Recursive."""
        n, y = name, self.y
        return f"""mean{n} AS (SELECT target, avg(y) AS g FROM {source} GROUP BY target),
bc{n} AS (SELECT target, block, {self.factors}, count(*) AS n, avg(y - g) AS mean, var_pop(y - g) * count(*) AS ss FROM {source} JOIN mean{n} USING (target) GROUP BY ALL),
bx{n} AS (SELECT target, block, n, ss, [{', '.join(self.x)}, mean] AS x FROM bc{n}),
e{n} AS (SELECT target, i, j, sum(n * x[i] * x[j]) AS v, sum(ss) AS within FROM bx{n}, range(1, {y + 1}) a(i), range(1, {y + 1}) b(j) GROUP BY target, i, j),
s{n} AS (SELECT target, block, i, sum(n) AS nb, sum(n * x[i]) AS s FROM bx{n}, range(1, {y + 1}) a(i) GROUP BY target, block, i),
c{n} AS (SELECT p.target, p.i, q.i AS j, sum(p.s * q.s / p.nb) AS v FROM s{n} p JOIN s{n} q ON p.target = q.target AND p.block = q.block GROUP BY ALL),
mat{n} AS (SELECT target, i, list(e{n}.v - c{n}.v + CASE WHEN i = {y} AND j = {y} THEN within ELSE 0 END ORDER BY j) AS r FROM e{n} JOIN c{n} USING (target, i, j) GROUP BY target, i),
sweep{n} AS (SELECT target, 1 AS k, list(r ORDER BY i) AS m FROM mat{n} GROUP BY target
  UNION ALL SELECT target, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k AND j = k THEN -1 / m[k][k]
    WHEN i = k OR j = k THEN v / m[k][k] ELSE v - r[k] * m[k][j] / m[k][k] END)) FROM sweep{n} WHERE k < {y}),
level{n} AS (SELECT target, count(DISTINCT block) AS b, max(s0) AS s0, list(s1 ORDER BY i) AS s1 FROM
  (SELECT target, i, sum(s / nb) AS s1, sum(1e0 / nb) AS s0, any_value(block) AS block FROM s{n} GROUP BY target, i) GROUP BY target),
count{n} AS (SELECT target, sum(n) AS n, count(DISTINCT block) AS b, sum(cell) AS pure FROM
  (SELECT target, block, n, 0e0 AS cell FROM bc{n} UNION ALL SELECT target, NULL, 0, var_pop(y - g) * count(*) FROM {source} JOIN mean{n} USING (target)
    GROUP BY target, {self.factors}) GROUP BY target),
fit{n} AS (SELECT target, m, n, count{n}.b, pure, s0, s1, g FROM sweep{n} JOIN level{n} USING (target) JOIN count{n} USING (target) JOIN mean{n} USING (target) WHERE k = {y})"""

    @property
    def constant(self) -> str:
        """The model's constant, from the columns of a fit."""
        return f"((s1[{self.y}] - list_sum(list_transform(range(1, {self.y}), lambda i: s1[i] * m[i][{self.y}]))) / b + g)"

    def sums(self, fit: str, where: str = "true") -> str:
        """(target, term, df, ss, rss, rdf) of the terms, the constant and the blocks."""
        y, out = self.y, []
        head = f"m[{y}][{y}] AS rss, n - {y - 1} - b AS rdf FROM {fit}"
        for term, p, width in self.terms:
            if width == 1:
                ss = f"pow(m[{p}][{y}], 2) / -m[{p}][{p}]"
            else:
                b1, b2, i11, i22, i12 = f"m[{p}][{y}]", f"m[{p + 1}][{y}]", f"-m[{p}][{p}]", f"-m[{p + 1}][{p + 1}]", f"-m[{p}][{p + 1}]"
                ss = f"(pow({b1}, 2) * {i22} - 2 * {b1} * {b2} * {i12} + pow({b2}, 2) * {i11}) / ({i11} * {i22} - pow({i12}, 2))"
            out.append(f"SELECT target, '{term}' AS term, {width}e0 AS df, {ss} AS ss, {head} WHERE {where.format(term=term)}")
        if where == "true":
            inner = f"list_sum(list_transform(range(1, {y}), lambda i: s1[i] * list_sum(list_transform(range(1, {y}), lambda j: -m[i][j] * s1[j]))))"
            out.append(f"SELECT target, 'Intercept' AS term, 1e0 AS df, pow({self.constant}, 2) / ((s0 + {inner}) / (b * b)) AS ss, {head}")
            out.append(f"SELECT target, 'block' AS term, CAST(b - 1 AS DOUBLE) AS df, pure - m[{y}][{y}] AS ss, {head}")
        return " UNION ALL ".join(out)
