"""Near duplicates by MinHash bands with exact verification.

A document is the set of its five-word shingles; documents with equal sets form a
class, and only classes go on. Every class has a label in each of several trees.
Fixed bands stand in for an LSH forest: all labels are cut to one prefix length,
the longest at which a pair at the threshold meets with the target recall, and
equal prefixes are grouped by their hash; none is shortened by bucket. Classes that
share a prefix meet in a bucket; there a net of pivots, by similarity of the
signatures, ties together everything that can be linked without listing pairs.
What is tied together is verified on the whole shingle sets, block by block, and
each class gets its number of links and its group.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, row_key, slices, stored, words_of
from tallywatt.llm.components import components
from tallywatt.llm.sketch import Sketch, cell_bits, repeated_cells
from tallywatt.llm.substring import window_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
TARGET_RECALL = 0.9999
#: Hashes that a signature keeps for estimates, one byte each.
SIGNATURE = 128
#: A class whose estimate with every pivot is below NEAR becomes a pivot; it is
#: tied to all pivots from ``tied_from(threshold)`` on.
NEAR = 0.8
#: Room for the errors of the two estimates, in standard errors, and the least
#: similarity that tells classes from unrelated ones.
ERRORS, LEAST_TIED = 3, 0.1
#: Classes of one verified block; two of them meet in a task.
BLOCK = 512
BROADCAST_BYTES = 32 << 20


def stop_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The fixed prefix length: the longest at which a pair at the threshold
    shares a prefix in some tree with the target recall."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold ** length) ** trees >= target:
            return length
    return 1


def tied_from(threshold: float) -> float:
    """The estimate from which a class is tied to a pivot. A class linked to one
    within NEAR of a pivot is at least threshold + NEAR - 1 similar to it, as one
    less the similarity is a metric; from that goes the room for the errors of
    both estimates. A ValueError where no such estimate tells related classes."""
    least = threshold + NEAR - 1
    room = ERRORS * ((NEAR * (1 - NEAR) + least * (1 - least)) / SIGNATURE) ** 0.5
    if least - room < LEAST_TIED:
        raise ValueError(f"threshold {threshold} is too low for signatures of {SIGNATURE} hashes")
    return least - room


class Shingles(NamedTuple):
    """``hashes[offsets[i]:offsets[i + 1]]``: the distinct shingles of text i, ascending."""

    hashes: np.ndarray
    offsets: np.ndarray


def shingles_of(texts: pa.Array, size: int = SHINGLE) -> Shingles:
    """Shingles of ``size`` words; a shorter text with words is one shingle, one
    without words has none."""
    words = words_of(texts)
    vocabulary = words.vocabulary.to_pylist()
    windows = window_hashes(words.codes, words.offsets, vocabulary, size)
    at = np.searchsorted(windows.text, np.arange(len(texts) + 1))
    n_words = np.diff(words.offsets)
    sets = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if a < b:
            own = np.sort(windows.h1[a:b])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n_words[i]:
            short = " ".join(vocabulary[c] for c in words.codes[words.offsets[i]:words.offsets[i + 1]].tolist())
            sets.append(np.array([xxhash.xxh3_64_intdigest(short, seed=int(n_words[i]))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return Shingles(np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)]))


def _minima(shingles: Shingles, count: int) -> np.ndarray:
    """(texts with shingles) x count minima of seeded permutations of 32 bits."""
    full = np.flatnonzero(np.diff(shingles.offsets))
    rng = np.random.default_rng(5)
    factors = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(full), count), np.uint32)
    step = 1 << 17  # shingles at once, so that they stay in the cache
    at = 0
    while at < len(full):
        begin = shingles.offsets[full[at]]
        to = max(at + 1, int(np.searchsorted(shingles.offsets[full + 1], begin + step, "right")))
        x = shingles.hashes[begin:shingles.offsets[full[to - 1] + 1]]
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = shingles.offsets[full[at:to]] - begin
        mixed = np.empty_like(x)
        for k in range(count):
            np.multiply(x, factors[k], out=mixed)
            np.add(mixed, shifts[k], out=mixed)
            mixed ^= mixed >> np.uint32(15)
            out[at:to, k] = np.minimum.reduceat(mixed, starts)
        at = to
    return out


def _keys(minima: np.ndarray, trees: int, depth: int, length: int) -> np.ndarray:
    """One key per text and tree: the hash of the label's prefix."""
    labels = minima.reshape(len(minima), trees, depth)[:, :, :length].astype(np.uint64)
    factors = np.random.default_rng(9).integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (labels * factors).sum(axis=2, dtype=np.uint64) + np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH,
           length: int | None = None) -> DataFrame:
    """doc_id, row, class (16 bytes, of the set), signature and the trees' keys."""
    length = length or stop_depth(trees=trees, depth=depth)
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("class", pa.binary()), ("signature", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in slices(batches, "text"):
            sets = shingles_of(batch.column("text"))
            bounds = sets.offsets.tolist()
            names = [xxhash.xxh3_128_digest(sets.hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            minima = _minima(sets, trees * depth)
            keys = _keys(minima, trees, depth, length).view(np.int64)
            has = np.diff(sets.offsets) > 0
            signatures: list = [b""] * len(names)
            for i, own in zip(np.flatnonzero(has).tolist(), minima[:, :SIGNATURE].astype(np.uint8)):
                signatures[i] = own.tobytes()
            ends = np.concatenate([[0], np.cumsum(has * trees)])
            yield batch_of(schema, batch.column("doc_id"), batch.column("row"), names, signatures,
                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())))

    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"),
                         F.col(text_col).alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, row long, class binary, signature binary, keys array<long>")


def candidate_edges(classes: DataFrame, trees: int = TREES, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v): classes tied together in some bucket, by way of the pivots near
    them; everything that can be linked is connected by them."""
    n = classes.count()
    least = tied_from(threshold)

    def keys(batches):
        for batch in batches:
            own = batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield own, own

    keyed = classes.select("keys")
    told = classes.sparkSession.sparkContext.broadcast(tuple(repeated_cells(keyed, keys, cell_bits(n * trees), rows=2)))
    entry = pa.schema([("key", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def entries(batches):
        for batch in batches:
            lists = batch.column("keys")
            own = lists.flatten().to_numpy(zero_copy_only=False)
            left = Sketch(*told.value).repeated(own.view(np.uint64), own.view(np.uint64))
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[left]
            for at in range(0, len(left), 1 << 16):
                part = slice(at, at + (1 << 16))
                place = pa.array(text[part])
                yield batch_of(entry, own[left[part]], batch.column("class").take(place), batch.column("signature").take(place))

    edge = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def tied(batches):
        """The classes of a bucket in ascending order: each is tied to the first
        class of what its pivots belong to, so ties never outnumber classes."""
        key, pivots, names, group = None, np.zeros((0, SIGNATURE), np.uint8), [], np.zeros(0, np.int64)
        for batch in batches:
            us, vs = [], []
            signatures = batch.column("signature").to_pylist()
            for own_key, name, told_signature in zip(batch.column("key").to_pylist(), batch.column("class").to_pylist(), signatures):
                own = np.frombuffer(told_signature, np.uint8)
                if own_key != key:
                    key, pivots, names, group = own_key, own[None], [name], np.zeros(1, np.int64)
                    continue
                alike = (pivots == own).mean(axis=1)
                met_groups = np.unique(group[alike >= least])
                if len(met_groups):
                    for other in [name, *[names[g] for g in met_groups[1:].tolist()]]:
                        us.append(other)
                        vs.append(names[met_groups[0]])
                    group[np.isin(group, met_groups)] = met_groups[0]
                if alike.max() < NEAR:
                    group = np.append(group, met_groups[0] if len(met_groups) else len(names))
                    pivots, names = np.vstack([pivots, own]), [*names, name]
            yield batch_of(edge, us, vs)

    met = (classes.select("class", "signature", "keys").mapInArrow(entries, "key long, class binary, signature binary")
           .repartition(F.col("key")).sortWithinPartitions("key", "class"))
    return met.mapInArrow(tied, "u binary, v binary").distinct()


def _verified(units: DataFrame, share: Fraction) -> DataFrame:
    """(class, target, links) per class and unit: its links in the unit, and the
    smallest class that links lead to there."""
    schema = pa.schema([("class", pa.binary()), ("target", pa.binary()), ("links", pa.int64())])

    def linked(unit: tuple, held: list) -> pa.RecordBatch:
        held = list({name: (block, text) for name, block, text in held}.items())
        names = [name for name, _ in held]
        blocks = np.array([block for _, (block, _) in held])
        sets = shingles_of(pa.array([text for _, (_, text) in held], pa.string()))
        sizes = np.diff(sets.offsets)
        _, place = np.unique(sets.hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(names)), sizes)
        shared = np.zeros((len(names), len(names)))
        kinds = int(place.max()) + 1 if len(place) else 0
        step = max(256, (1 << 23) // len(names))
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for at in range(0, kinds, step):
            a, b = np.searchsorted(place, [at, at + step])
            has = np.zeros((len(names), min(step, kinds - at)), np.float32)
            has[owner[a:b], place[a:b] - at] = 1
            shared += has @ has.T
        union = sizes[:, None] + sizes[None] - shared
        link = (shared * share.denominator >= union * share.numerator) & (shared > 0)
        np.fill_diagonal(link, False)
        if unit[1] != unit[2]:
            link &= blocks[:, None] != blocks[None]
        target = _least_linked(link, names)
        return batch_of(schema, names, target, link.sum(axis=1).astype(np.int64))

    def rows(batches):
        unit, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = row["root"], row["low"], row["high"]
                if own != unit:
                    if held:
                        yield linked(unit, held)
                    unit, held = own, []
                held.append((row["class"], row["block"], row["text"]))
        if held:
            yield linked(unit, held)

    return units.mapInArrow(rows, "class binary, target binary, links long")


def _least_linked(link: np.ndarray, names: list[bytes]) -> list[bytes]:
    """For each place the smallest name that it reaches."""
    order = sorted(range(len(names)), key=names.__getitem__)
    target: list = [None] * len(names)
    for start in order:
        if target[start] is not None:
            continue
        reached = np.zeros(len(names), bool)
        front = np.array([start])
        while len(front):
            reached[front] = True
            front = np.flatnonzero(link[front].any(axis=0) & ~reached)
        for i in np.flatnonzero(reached).tolist():
            target[i] = names[start]
    return target


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                    trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, row (hash of id and text), class_id (the
    smallest doc_id of the documents that links of at least ``threshold`` lead
    to), copy_of (the smallest doc_id with the same shingles), n_links (other
    classes it is linked to) and kept (it is its group's first document).

    Texts without words, null ones included, are copies of one another. Rows
    equal in id and text share one ``row`` and are both marked as their group's
    first. A null id comes after all others. An empty table gives no rows; other
    columns are ignored. A threshold below about 0.47 is an error (``tied_from``).
    """
    length = stop_depth(threshold, trees, depth, target)
    signs = stored(signed(docs, id_col, text_col, trees, depth, length), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = stored(signs.groupBy("class").agg(first.alias("first"), F.first("signature").alias("signature"),
                                                F.first("keys").alias("keys")), "classes")
    tied = components(candidate_edges(classes.where(F.size("keys") > 0), trees, threshold))
    parts = tied.select(F.col("node").alias("class"), "root").union(tied.select(F.col("root").alias("class"), "root").distinct())
    sizes = parts.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    parts = parts.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parts = stored(parts.join(classes.select("class", F.col("first.row").alias("row")), "class"), "tied")

    texts = bounded(docs).select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    if 96 * parts.count() <= BROADCAST_BYTES:
        parts = F.broadcast(parts)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = (texts.join(parts, "row").withColumn("other", other)
             .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "class", "block", "text"))
    units = units.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    links = stored(_verified(units, Fraction(str(threshold))), "links")
    groups = components(links.select(F.col("class").alias("u"), F.col("target").alias("v")))
    counts = links.groupBy("class").agg(F.sum("links").alias("n_links"))
    told = (classes.select("class", "first").join(groups.withColumnRenamed("node", "class"), "class", "left")
            .join(counts, "class", "left")
            .select("class", "first", F.coalesce("root", "class").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    heads = told.groupBy("root").agg(F.min("first").alias("head"))
    told = told.join(heads, "root").select("class", "first", "head", "n_links")
    return (signs.select("doc_id", "row", "class").join(told, "class")
            .select("doc_id", "row", F.col("head.doc_id").alias("class_id"), F.col("first.doc_id").alias("copy_of"),
                    "n_links", ((F.col("row") == F.col("head.row")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))).alias("kept")))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that ``near_duplicates`` does not keep: one of
    each group stays, with all its columns, of repeated rows one too."""
    name = "kept_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    kept = stored(found.where("kept").groupBy(F.col("row").alias(name)).agg(F.count("*").alias("times")), "kept")
    repeated = not kept.where("times > 1").isEmpty()
    rows = kept.select(name)
    if 32 * kept.count() <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    left = docs.join(rows, row_key(id_col, text_col) == F.col(name), "left_semi")
    if not repeated:
        return left
    return left.dropDuplicates([id_col, text_col])
