"""The pipeline's stages on awkward tables and on the given ones."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallywatt.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, carried string, `odd.name` int"


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def rows():
    passage = prose(77, 45)
    clean = [prose(k, 120) for k in range(8)]
    texts = [None, "", "few words", *clean, clean[0], clean[1] + " tail", clean[2] + "\n" + passage, clean[3] + " " + passage,
             "same line\n" * 60, "$$$ " * 80, prose(9, 90) + " password: hunter2hunter2 " + "0123456789abcdef" * 2]
    out = [(k, t, "en", "src0", len(t or ""), True, "x", k) for k, t in enumerate(texts)]
    return [*out, out[4], (None, clean[7], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def plain(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_every_stage_keeps_the_columns(spark, docs):
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
    assert P.STAGES[-1][1](spark, now, "").count() > 0


def test_quality_stage(spark, docs):
    kept = P.quality_rules(spark, docs, "")
    want = [r for r in rows() if len(brute.words(r[1])) >= 50 and not (r[1] or "").startswith(("same", "$$$"))]
    assert plain(kept) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_jaccard_stage_keeps_one_of_each_group(spark, docs):
    kept = P.ngram_jaccard_join(spark, docs, "").collect()
    _, groups = brute.near([(r[0], r[1]) for r in rows()])
    assert sorted(groups[brute.shingles(r["text"])] for r in kept) == sorted(set(groups.values()))


def test_substring_stage(spark, docs):
    got = {(r["doc_id"], r["odd.name"]): r for r in P.substring_dedup(spark, docs, "").collect()}
    told = brute.substring([(k, r[1]) for k, r in enumerate(rows())])
    for (k, n_words, n_removed, _), r in zip(told, rows()):
        found = got[(r[0], r[7])]
        if not n_removed:
            assert found["text"] == r[1] and found["n_chars"] == r[4]
        else:
            assert len(brute.words(found["text"])) == n_words - n_removed and found["n_chars"] == len(found["text"])


def test_secret_stage(spark, docs):
    got = P.secret_scans(spark, docs, "")
    assert got.count() == docs.count() and got.where("text like '%[SECRET]%'").count() == 1
    assert got.where("text is not null and n_chars != length(text)").count() == 0


def test_empty_table(spark, docs):
    now = docs.limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_run_packs_all_that_is_kept(spark, sf_dir):
    docs = Q.documents(spark, sf_dir)
    for _, stage in P.STAGES[:2]:
        docs = stage(spark, docs, sf_dir)
    pieces = P.run(spark, sf_dir)
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(
        r.doc_id for r in pieces.select("doc_id").distinct().collect())
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in sizes)
