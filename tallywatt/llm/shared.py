"""Figures of keys brought to the rows that use them.

Keys are split by weight. Those with more than a fixed share of the whole weight
are few whatever the corpus (shares add up to one), so they are broadcast and
looked up in the scan; hot keys are always among them. All others are joined: a
key that is left holds so little that its rows fit any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / SHARES of the whole weight is broadcast: fewer than SHARES keys.
SHARES = 1 << 18


def heavy(weight: Column, total: int, size: Column | None = None, shares: int = SHARES) -> Column:
    """Whether a key is broadcast. ``size`` (bytes of the key) raises the bar by
    one share for every 16 bytes, so that the broadcast keys have less than
    16 * shares bytes in all."""
    cost = F.lit(1) if size is None else 1 + size / 16
    return weight * F.lit(float(shares)) > cost * F.lit(float(total))


def with_joined(rows: DataFrame, keys: str, counts: str, figures: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (a stored table with a column ``row`` that tells them apart) with
    the columns ``sums`` increased by what the joined keys add.

    ``keys`` and ``counts`` are list columns of equal length: keys not broadcast
    and how often the row holds them. ``figures`` has one row per such ``key``;
    the expressions in ``sums`` are over its columns and ``times``.
    """
    held = rows.select("row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("times"))).alias("held"))
    added = (held.select("row", "held.key", "held.times").join(figures, "key")
             .select("row", *[c.alias(name) for name, c in sums.items()]))
    fixed = [c for c in rows.columns if c not in (keys, counts, "row", *sums)]
    own = rows.select("row", F.struct(*fixed).alias("own"), *sums)
    none = F.lit(None).cast(own.schema["own"].dataType).alias("own")
    both = own.unionByName(added.select("row", none, *sums))
    told = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), *[F.sum(c).alias(c) for c in sums])
    return told.select("own.*", *sums)
