"""Aligned tokens against comparing all byte ranges of whole texts."""

import random

import brute
import pyarrow as pa
import pytest
from test_llm_operators import SCHEMA, awkward_rows, same

from tallywatt.llm import alignment, shared
from tallywatt.llm import queries as Q

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PATHS = Q.BYTE_TOKENIZER, Q.PIECE_TOKENIZER
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "C.", "'s", "é", "1", "日本", "　", "\xa0", " ", " ", "\u0085", " ", "▁", "\x1c",
         "\x00", " the", " of", "﻿", "é", "😀", "<s>", "</s>", "<0x41>", "<|endoftext|>", "don't", " word"]


@pytest.mark.parametrize("shares", [8, 200, shared.SHARES])
def test_awkward_with_few_and_many_pairs_joined(spark, monkeypatch, shares):
    monkeypatch.setattr(alignment, "heavy", lambda *a: shared.heavy(*a, shares=shares))
    rows = awkward_rows()
    frame = spark.createDataFrame([(*r[:2], *r[2:]) for r in rows], SCHEMA).repartition(3)
    same(alignment.alignment_figures(frame, *PATHS), COLUMNS, brute.alignment([(r[0], r[1]) for r in rows], *PATHS))


def test_given(spark, sf_dir):
    docs = [tuple(r) for r in Q.documents(spark, sf_dir).select("doc_id", "text").collect()]
    same(Q.op12_alignment(spark, sf_dir), COLUMNS, brute.alignment(docs, *PATHS))


def test_random_texts(spark):
    rng = random.Random(11)
    docs = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for k in range(3000)]
    frame = spark.createDataFrame([(*d, "", 0, 0, "") for d in docs], SCHEMA)
    same(alignment.alignment_figures(frame, *PATHS), COLUMNS, brute.alignment(docs, *PATHS))


def test_units_lose_nothing():
    texts = [None, "", " ", "a b", " a  b  c d ", "x\n y", "ab" * 100000]
    codes, offsets, vocabulary = alignment.units_of(pa.array(texts, pa.string()))
    units = vocabulary.to_pylist()
    got = [b"".join(units[c] for c in codes[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [" " + t if t else "" for t in texts]


def test_long_white_space_and_one_long_word(spark):
    docs = [(1, "a" + " " * 200000 + "b"), (2, "\n" * 200000), (3, "ab" * 100000), (4, "x " * 50000)]
    frame = spark.createDataFrame([(*d, "", 0, 0, "") for d in docs], SCHEMA)
    found = {r.doc_id: r for r in alignment.alignment_figures(frame, *PATHS).collect()}
    tokenizers = alignment.Tokenizers(*PATHS)
    for i, t in docs:
        assert found[i].n_a == len(tokenizers.a.encode(" " + t, add_special_tokens=False).ids)
        assert found[i].n_b == len(tokenizers.b.encode(t)) and found[i].n_links >= max(found[i].n_a, found[i].n_b)


def test_a_small_cache_gives_the_same(monkeypatch):
    texts = pa.array([r[1] for r in awkward_rows()], pa.string())
    tokenizers, _ = alignment._of_worker(*PATHS)
    whole = alignment.align(texts, *PATHS)
    monkeypatch.setattr(alignment, "_of_worker", lambda *a: (tokenizers, alignment.UnitCache(2000)))
    assert alignment.align(texts, *PATHS).digests == whole.digests


def test_empty(spark):
    assert alignment.alignment_figures(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []
