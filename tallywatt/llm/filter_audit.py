"""How five filters interact, for every order in which they can be applied.

Every document gets one bit per filter. Counts of documents by part and bits form
a 2x2x2x2x2 tensor per part (axis: a filter, place 0: passes, 1: fails). Each
figure of a step is a contraction of that tensor: an axis is selected at "pass"
(filters before the step), at "fail" (the step's own) or summed (those behind).
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
#: Selectors of an axis: a tensor place is (passes, fails).
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
#: Rows without an id and hot ids are spread over so many join keys.
SPREAD = 1024

RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < 100
    repeated = F.size(F.array_distinct(words)) * 100 < F.size(words) * 80
    shouted = F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 10
    marked = text.rlike(r"[#$%&*|]")
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, repeated, shouted, marked))]
    return sum(bits[1:], bits[0]).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by failure bits.

    Filter E fails where any row with a smaller id holds the same text, in any
    part; rows that share the least id all pass. A null id is smaller than none
    and has none before it. Null texts count as empty, null parts as ''. A
    document is good or toxic if any of its label rows says so; labels of unknown
    or null ids count nowhere. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"))
    # rows without an id join nothing: they are dealt out, not sent to one task
    scattered = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(0)
    flags = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
             .where("good OR toxic").withColumn("spread", F.lit(0).cast("long")))
    told = facts.withColumn("spread", scattered.cast("long")).join(flags, ["doc_id", "spread"], "left")

    # equal texts: first by id, then what a group's least id holds, both combined in the tasks
    group = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    by_id = told.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    alike = by_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("unnamed"))
    kinds = F.struct("part", "mask", "good", "toxic", "n", "least", "unnamed")
    return _by_mask(alike.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.collect_list(kinds).alias("kinds")))


def _by_mask(texts: DataFrame) -> DataFrame:
    """A text's kinds are as many as its parts times its labels, not its copies."""
    each = texts.select("first", F.explode("kinds").alias("k")).select("first", "k.*")
    passing = F.coalesce(F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")), F.lit(0)) + F.coalesce("unnamed", F.lit(0))
    once = each.select("part", "mask", "good", "toxic", passing.alias("first_n"), (F.col("n") - passing).alias("later_n"))
    both = F.array(F.struct(F.col("mask"), F.col("first_n").alias("n")),
                   F.struct((F.col("mask") + 16).alias("mask"), F.col("later_n").alias("n")))
    rows = once.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.*").where("n > 0")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


@cache
def _selectors() -> dict[str, np.ndarray]:
    """For each (order, step) the selector of every axis: arrays [600, 2] by filter."""
    rows = [(order, step) for order in ORDERS for step in range(5)]
    kinds = {}
    for axis, name in enumerate(FILTERS):
        at = np.array([order.index(name) for order, _ in rows])
        step = np.array([step for _, step in rows])
        own, before = (at == step)[:, None], (at < step)[:, None]
        kinds["kept" + name] = np.where(own | before, PASS, ALL)
        kinds["removed" + name] = np.where(own, FAIL, np.where(before, PASS, ALL))
        kinds["failing" + name] = np.where(own, FAIL, ALL)
        kinds["unique" + name] = np.where(own, FAIL, PASS)
    return kinds


def contracted(tensor: np.ndarray, figure: str) -> np.ndarray:
    """The figure for all orders and steps: one einsum over a [2]*5 tensor of counts."""
    of = _selectors()
    return np.einsum("abcde,ra,rb,rc,rd,re->r", tensor, *[of[figure + name] for name in FILTERS], optimize=True)


def contract(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part: (mask, n, good, toxic), at most 32 rows."""
    def tensor(column: str) -> np.ndarray:
        flat = np.zeros(32, np.int64)
        np.add.at(flat, counts["mask"].to_numpy(), counts[column].to_numpy())
        return flat.reshape([2] * 5).transpose(4, 3, 2, 1, 0)  # bit 0 (A) varies fastest

    n = tensor("n")
    removed = contracted(n, "removed")
    name = np.array([order[step] for order in ORDERS for step in range(5)])
    shares = {f: int(removed[name == f].sum()) for f in FILTERS}
    return pd.DataFrame({
        "part": counts["part"].iloc[0], "filter_order": np.repeat(ORDERS, 5), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)),
        "kept": contracted(n, "kept"), "removed": removed, "redundant": contracted(n, "failing") - removed,
        "unique_fails": contracted(n, "unique"), "good_lost": contracted(tensor("good"), "removed"),
        "toxic_lost": contracted(tensor("toxic"), "removed"), "shapley": [shares[f] for f in name]})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order (120) and step (1 to 5): kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. An empty table gives no rows.
    Null, repeated and clashing input: see ``failure_counts``."""
    counts = failure_counts(docs, labels, id_col, text_col, part_col)
    return counts.groupBy("part").applyInPandas(contract, RESULT)
