"""The filter audit against applying every order step by step."""

import brute
import numpy as np
from test_llm_operators import PASSAGE, same

from tallywatt.llm import filter_audit
from tallywatt.llm import queries as Q

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DOCS = "doc_id long, text string, lang string, mask int, good string, spread int, n int"
LABELS = "doc_id long, quality int, toxic int, part string, good string"


def rows():
    """Null ids, texts, parts and labels, repeated rows and ids, texts that recur in other parts."""
    texts = [None, "", " ", "a", PASSAGE, PASSAGE + " " + " ".join(f"w{k}" for k in range(60)), "same " * 120,
             " ".join(f"U{k}PPER" for k in range(120)), " ".join(f"w{k}|" for k in range(120)), "LOUD # " * 200]
    out = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts)]
    out += [(20 + k, t, "en") for k, t in enumerate(texts)] + [out[5], out[5], (5, texts[6], "fr"), (None, texts[5], "en")]
    out += [(None, texts[5], "en"), (None, None, None), (-1, texts[7], "de"), (-1, texts[7], "de"), (99, "x " * 300000, "de")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 30)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (500, 1, 1), (None, 1, None)]
    return out, labels


def test_awkward(spark):
    docs, labels = rows()
    frame = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], DOCS).repartition(3)
    told = spark.createDataFrame([(*x, "p", "g") for x in labels], LABELS)
    same(filter_audit.audit(frame, told), COLUMNS, brute.filter_audit(docs, labels))


def test_given(spark, sf_dir):
    docs = [tuple(r) for r in Q.documents(spark, sf_dir).select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    same(Q.op13_filter_audit(spark, sf_dir), COLUMNS, brute.filter_audit(docs, labels))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", 0, "", 0, 0)], DOCS)
    found = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(found) == 600 and not any(r.good_lost or r.toxic_lost for r in found)


def test_every_order_removes_the_same_in_all():
    tensor = np.random.default_rng(1).integers(0, 50, [2] * 5)
    removed = filter_audit.contracted(tensor, "removed").reshape(120, 5)
    assert set(removed.sum(1)) == {tensor.sum() - tensor[0, 0, 0, 0, 0]}
    assert set(filter_audit.contracted(tensor, "kept").reshape(120, 5)[:, 4]) == {tensor[0, 0, 0, 0, 0]}
