"""Lattice likelihoods against sums over all segmentations, base scores against counting."""

import brute
import numpy as np
import pytest
from test_llm_operators import SCHEMA, awkward_rows

from tallywatt.llm import lattice, shared
from tallywatt.llm import queries as Q

EXACT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def compare(frame, docs, rounds=lattice.ROUNDS):
    found = [r.asDict() for r in frame.collect()]
    base, _ = brute.unigrams(docs)
    scores = brute.lattice_scores(docs, Q.PIECE_TOKENIZER, rounds, lattice.PRIOR)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6))
    got = sorted(((*[r[c] for c in EXACT], r["base_score"], r["score"]) for r in found), key=key)
    want = sorted(((*b, s) for b, s in zip(base, scores)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-7)


def short_words():
    """Awkward rows without words whose probability a plain sum cannot hold."""
    return [r for r in awkward_rows() if all(len(w) <= 64 for w in brute.words(r[1]))]


@pytest.mark.parametrize("shares", [4, 64, shared.SHARES])
def test_awkward_with_few_and_many_words_joined(spark, monkeypatch, shares):
    monkeypatch.setattr(lattice, "heavy", lambda *a: shared.heavy(*a, shares=shares))
    rows = short_words()
    frame = lattice.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), Q.PIECE_TOKENIZER)
    compare(frame, [(r[0], r[1]) for r in rows])


def test_given(spark, sf_dir):
    docs = [tuple(r) for r in Q.documents(spark, sf_dir).select("doc_id", "text").collect()]
    compare(Q.op11_lm_scoring(spark, sf_dir), docs)


def test_very_long_words(spark):
    rows = [(k, t, "", 0, 0, "") for k, t in enumerate(["ab" * 40000, "héllo" * 30 + " end", "plain words", "é" * 200])]
    found = {r.doc_id: r for r in lattice.lm_scores(spark.createDataFrame(rows, SCHEMA), Q.PIECE_TOKENIZER).collect()}
    assert len(found) == 4 and all(np.isfinite(r.score) and r.score < 0 for r in found.values())


def test_long_words_equal_words_side_by_side():
    of = lattice.entries(Q.PIECE_TOKENIZER)
    log_p = np.log(of.start)
    for word in ("a", "hello" * 20, "représentation", "日本語" * 9, "\x01\x02"):
        data = np.frombuffer(f" {word}".encode(), np.uint8)
        one = lattice.score_words(data, np.array([len(data)]), log_p, of, np.array([3.0]))
        two = lattice.score_long(data, log_p, of, 3.0)
        assert np.allclose(one.log_p, two.log_p) and np.allclose(one.expected, two.expected)


def test_marginal_is_a_probability():
    """Over all strings of one byte behind the space, and their continuations, mass stays below one."""
    of = lattice.entries(Q.PIECE_TOKENIZER)
    log_p = np.log(of.start)
    total = sum(np.exp(lattice.score_long(np.array([32, b], np.uint8), log_p, of).log_p[0]) for b in range(128))
    assert 0 < total < 1 and abs(of.start.sum() - 1) < 1e-12


def test_fitting_raises_the_likelihood_of_training_and_held_out_text(spark, sf_dir):
    def mean(rounds, held_out):
        rows = [r for r in lattice.lm_scores(Q.documents(spark, sf_dir), Q.PIECE_TOKENIZER, rounds).collect() if r.held_out == held_out]
        return sum(r.score for r in rows) / sum(r.n_tokens for r in rows)

    zero, one, three = ((mean(r, False), mean(r, True)) for r in (0, 1, 3))
    assert zero[0] < one[0] < three[0] and zero[1] < three[1]


def test_empty_and_untrained(spark):
    assert lattice.lm_scores(spark.createDataFrame([], SCHEMA), Q.PIECE_TOKENIZER).collect() == []
    held = next(i for i in range(100) if brute.unigrams([(i, "")])[0][0][1])
    docs = [(held, "only held out"), (held, None)]
    frame = spark.createDataFrame([(*d, "", 0, 0, "") for d in docs], SCHEMA)
    compare(lattice.lm_scores(frame, Q.PIECE_TOKENIZER), docs)
