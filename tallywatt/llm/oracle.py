"""SQL twins (DuckDB) of the text queries that SQL can express on whole tables."""

from __future__ import annotations

from tallywatt.llm.quality import ENDLESS, POLICIES, RULES, UNSPACED

SQL: dict[str, str] = {}

WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

SQL["op2_substring_dedup"] = f"""WITH {WORDS},
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(ws[i:i + 34], ' '))) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM seen, range(0, 35) AS r(k) WHERE n > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM
  (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_names = [r.name for r in RULES]


def _fails(policy: tuple[str, int]) -> str:
    return " OR ".join(f"({RULES[_names.index(name)].fails})" for name in POLICIES[policy])


_unspaced = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED)
_bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << bit} ELSE 0 END" for bit, r in enumerate(RULES))
SQL["op5_quality_rules"] = rf"""WITH {WORDS},
triples AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM triples),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM seen, range(0, 3) AS r(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
  coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word, len(regexp_extract_all(text, '!')) AS n_exclaims,
  coalesce(list_sum(list_transform(ws, lambda x: CASE WHEN length(x) > {ENDLESS} THEN length(x) ELSE 0 END)), 0) AS endless_chars,
  len(regexp_extract_all(text, '[{_unspaced}]')) AS n_unspaced
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_fails(("base", 1))}) AS base_failed,
  NOT ({_fails(("clean", 3))}) AS kept, CAST({_bits} AS BIGINT) AS failed FROM m"""

SQL["op9_topk"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM p WHERE "rank" <= 5"""

SQL["op13_filter_audit"] = rf"""WITH {WORDS.replace("doc_id, ", "doc_id, coalesce(lang, '') AS part, ", 1)},
flags AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
  100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e FROM w LEFT JOIN flags USING (doc_id)),
fails AS (SELECT *, [a, b, c, d, e] AS x FROM f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest(range(1, 6)) AS i),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS o
  FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps AS (SELECT filter_order, o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
kinds AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM fails GROUP BY part, x),
told AS (SELECT part, filter_order, step, o[step] AS own, n, n_good, n_toxic, x[o[step]] AS fails,
  len(list_filter(o[:step - 1], lambda i: x[i])) = 0 AS reached, len(list_filter(x, lambda v: v)) AS n_fails FROM kinds, steps),
steps_told AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (reached AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (reached AND fails), 0) AS removed,
  coalesce(sum(n) FILTER (fails AND NOT reached), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
  coalesce(sum(n_good) FILTER (reached AND fails), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (reached AND fails), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM steps_told"""
