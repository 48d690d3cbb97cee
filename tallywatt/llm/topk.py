"""Exact k best inner products by columnar branch and bound.

Vectors lie dimension by dimension. A block of candidates is scored against a tile
of queries over the first blocks of dimensions; what the remaining dimensions can
still add is bounded by the product of the two remaining lengths. Pairs whose upper
bound is below the k-th best score that the query has found so far go, the others
are scored on block by block and bounded again after each.

Packed blocks meet in a grid of cells, a group of candidates against a group of
queries each. A cell keeps its queries' best as its candidates pass, so a row
travels once per group of the other side, not once per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, stored

#: Dimensions that are accumulated between two bounds.
DIMENSIONS = 8
#: Candidates of a block and queries of a tile at most.
CANDIDATES, QUERIES = 4096, 256
#: Bytes of a block as 64-bit numbers, and of the blocks that a task fills at once.
BLOCK_BYTES, HELD_BYTES = 2 << 20, 16 << 20
#: Bytes of a group of queries as 32-bit numbers, candidates of a group; cells at
#: least, as far as there are blocks.
GROUP_BYTES, GROUP_CANDIDATES, LEAST_CELLS = 64 << 20, 1 << 20, 64
#: Candidates that a query's first k best come from; from then on twice as many.
FIRST = 512
#: Pairs that wait until they are sorted into the best of their queries.
WAITING = 1 << 19
#: What a pair costs that passes the first bound, in products of one dimension.
PASSED = 3000
#: Queries on which the depth of the first bound is tried.
TRIED = 64

_PACKED = "dims int, width int, n long, q long, ids binary, vectors binary"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dims, v) of the vectors that take part: floor(scale * x) of each
    component as double; null ones, and those that hold null, NaN or an infinite
    component, do not."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
            .select("id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")))


def best_in_block(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all candidates that can be among the k best.

    columns: dimensions x candidates, integers; rest[j]: length of each
    candidate's vector from dimension j * DIMENSIONS on; own: places that are not
    candidates.
    """
    dims, n = columns.shape
    left = np.ones(n, bool)
    left[own] = False
    left = np.flatnonzero(left)
    score = np.zeros(len(left), np.int64)
    for j, at in enumerate(range(0, dims, DIMENSIONS)):
        block = slice(at, at + DIMENSIONS)
        whole = len(left) == n
        score = score + query[block] @ (columns[block] if whole else columns[block][:, left])
        if len(left) <= k:
            continue
        mine = np.sqrt(float((query[at + DIMENSIONS:].astype(np.float64) ** 2).sum()))
        # the bound is rounded up: floats may be off in the last places
        slack = mine * rest[j + 1][left] * (1 + 1e-9) + 1e-6
        low = score - slack
        kept = score + slack >= np.partition(low, -k)[-k]
        if not kept.all():
            left, score = left[kept], score[kept]
    return left, score


def remaining(vectors: np.ndarray) -> np.ndarray:
    """[j, i]: length of row i from dimension j * DIMENSIONS on, rounded up."""
    dims = vectors.shape[1]
    squares = vectors.astype(np.float64) ** 2
    parts = [squares[:, at:at + DIMENSIONS].sum(axis=1) for at in range(0, dims, DIMENSIONS)] + [np.zeros(len(vectors))]
    return np.sqrt(np.cumsum(parts[::-1], axis=0)[::-1]) * (1 + 1e-9)


def _set(flags: np.ndarray) -> np.ndarray:
    """Places of the few flags that are set: eight at a time are looked at first."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64))
    inner = np.flatnonzero(flags[:whole].reshape(-1, 8)[some])
    return np.concatenate([8 * some[inner >> 3] + (inner & 7), whole + np.flatnonzero(flags[whole:])])


class Best:
    """The k best of a group of queries over the candidates seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.dims = vectors.shape[1]
        self.rest = remaining(vectors)
        self.length = float(self.rest[0].max())
        self.found = np.zeros(len(ids), np.int64)
        self.score, self.id = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        #: Score from which on a pair matters; ties go by id.
        self.least = np.full(len(ids), -np.inf)
        self.depth = -(-3 * self.dims // 4 // DIMENSIONS) * DIMENSIONS
        self._waiting, self._count = [], 0
        self._made, self._rooms = (), {}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        at, size = 0, len(ids)
        while at < size:
            # scores that grow with what is known: the first step fills the k best
            step = min(size - at, max(FIRST, self.seen)) if self.seen < CANDIDATES else size - at
            self._add(ids[at:at + step], vectors[at:at + step])
            at += step
            self.seen += step

    seen = 0

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rest = remaining(vectors)
        # every sum of some of a pair's products is below the product of the lengths
        most = self.length * float(rest[0].max())
        if most >= 2 ** 53:
            self._add_long(ids, vectors, rest)
        else:
            kind = np.float32 if most < 2 ** 24 else np.float64
            columns = np.ascontiguousarray(vectors.T, kind)
            slack = 1 + 4 * (self.dims + 2) * float(np.finfo(kind).eps) * most
            if len(self.ids) >= 8 * TRIED and self.found.min() == self.k:
                self.depth = self._tried(columns, rest, slack)
            bounding = self._bounding(columns, rest, self.depth)
            for a in range(0, len(self.ids), QUERIES):
                self._tile(a, min(a + QUERIES, len(self.ids)), ids, vectors, columns, bounding, rest, slack)
        self._settle()

    def _queries(self, kind: type, depth: int) -> np.ndarray:
        """The first ``depth`` dimensions and, if some remain, their length."""
        if not self._made or self._made[:2] != (kind, depth):
            self._made = (kind, depth, self._cut(slice(None), kind, depth))
        return self._made[2]

    def _cut(self, rows, kind: type, depth: int) -> np.ndarray:
        own = self.vectors[rows, :depth].astype(kind)
        return own if depth >= self.dims else np.concatenate([own, self.rest[depth // DIMENSIONS][rows, None].astype(kind)], axis=1)

    def _bounding(self, columns: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
        return columns if depth >= self.dims else np.concatenate([columns[:depth], rest[None, depth // DIMENSIONS].astype(columns.dtype)])

    def _room(self, kind: type, *shape: int) -> np.ndarray:
        """An array that the next call with this ``kind`` writes over."""
        size = shape[0] * shape[1]
        if len(self._rooms.get(kind, ())) < size:
            self._rooms[kind] = np.empty(size, kind)
        return self._rooms[kind][:size].reshape(shape)

    def _tried(self, columns: np.ndarray, rest: np.ndarray, slack: float) -> int:
        """The cheapest depth beside the present one, by some of the queries."""
        rows = np.linspace(0, len(self.ids) - 1, TRIED).astype(np.int64)
        costs = []
        for depth in {min(max(self.depth + d, min(DIMENSIONS, self.dims)), -(-self.dims // DIMENSIONS) * DIMENSIONS)
                      for d in (-DIMENSIONS, 0, DIMENSIONS)}:
            upper = self._cut(rows, columns.dtype.type, depth) @ self._bounding(columns, rest, depth)
            costs.append((depth + PASSED * np.count_nonzero(upper >= (self.least[rows] - slack)[:, None]) / upper.size, depth))
        return min(costs)[1]

    def _tile(self, a: int, b: int, ids: np.ndarray, vectors: np.ndarray, columns: np.ndarray, bounding: np.ndarray, rest: np.ndarray,
              slack: float) -> None:
        least, kind = self.least[a:b], columns.dtype.type
        if np.isinf(least).any():
            # no k best yet: from whole scores
            depth = self.dims
            upper = self._cut(slice(a, b), kind, depth) @ columns
            upper[ids[None, :] == self.ids[a:b, None]] = -np.inf
            if len(ids) >= self.k:
                least = np.maximum(least, np.partition(upper, -self.k, axis=1)[:, -self.k])
        else:
            depth = self.depth
            upper = np.matmul(self._queries(kind, depth)[a:b], bounding, out=self._room(kind, b - a, len(ids)))
            if depth < self.dims:
                least = least - slack
        passed = np.greater_equal(upper, least[:, None].astype(kind), out=self._room(bool, b - a, len(ids)))
        query, place = np.divmod(_set(passed.ravel()), len(ids))
        query += a
        other = ids[place] != self.ids[query]
        query, place = query[other], place[other]
        # lists of pairs: the remaining dimensions block by block
        score = np.zeros(len(query), np.int64)
        for at in range(0, self.dims, DIMENSIONS):
            block = slice(at, at + DIMENSIONS)
            score = score + np.einsum("ij,ij->i", self.vectors[query, block], vectors[place, block], dtype=np.int64)
            if depth <= at + DIMENSIONS < self.dims:
                j = at // DIMENSIONS + 1
                kept = score + self.rest[j][query] * rest[j][place] + slack >= self.least[query]
                query, place, score = query[kept], place[kept], score[kept]
        kept = score >= self.least[query]
        self._wait(query[kept], ids[place[kept]], score[kept])

    def _add_long(self, ids: np.ndarray, vectors: np.ndarray, rest: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors.T, np.int64)
        for at, query in enumerate(self.vectors):
            own = np.flatnonzero(ids == self.ids[at])
            place, score = best_in_block(query.astype(np.int64), columns, rest, own, self.k)
            self._wait(np.full(len(place), at), ids[place], score)

    def _wait(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self._waiting.append((query, ids, score))
        self._count += len(query)
        if self._count >= WAITING:
            self._settle()

    def _settle(self) -> None:
        if not self._count:
            self._waiting = []
            return
        query, ids, score = (np.concatenate(c) for c in zip(*self._waiting))
        self._waiting, self._count = [], 0
        touched = np.unique(query)
        known = np.arange(self.k) < self.found[touched][:, None]
        query = np.concatenate([np.repeat(touched, self.found[touched]), query])
        ids = np.concatenate([self.id[touched][known], ids])
        score = np.concatenate([self.score[touched][known], score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        self.score[query[best], rank[best]], self.id[query[best], rank[best]] = score[best], ids[best]
        self.found[touched] = np.minimum(np.searchsorted(query, touched, "right") - np.searchsorted(query, touched), self.k)
        full = touched[self.found[touched] == self.k]
        self.least[full] = self.score[full, -1]

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.arange(self.k) < self.found[:, None]
        return np.repeat(self.ids, self.found), self.id[known], self.score[known]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` highest integer
    inner products over every other row: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; fewer rows are returned where there are fewer
    candidates. Rows that share a query's id are its own. Vectors are compared
    with vectors of their own length only. Rows without an id or a sound vector
    take no part; scores must fit 64 bits. An empty table gives no rows.
    """
    base = stored(_packed(quantized(vectors, id_col, vector_col, scale), every), "vectors")
    told = base.agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum(F.col("q") * F.col("dims") * 4).alias("q")).first()
    query_groups = -(-(told["q"] or 0) // GROUP_BYTES) or 1
    groups = max(-(-(told["n"] or 0) // GROUP_CANDIDATES), min(-(-LEAST_CELLS // query_groups), told["blocks"])) or 1

    def queries(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = _unpacked(row)
                own = ids % every == 0
                yield _block(ids[own], v[own], every)

    def dealt(frame: DataFrame, kind: int, own: int, others: int) -> DataFrame:
        return (frame.withColumn("kind", F.lit(kind)).withColumn("own", F.pmod(F.xxhash64("ids"), F.lit(own)).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    asked = dealt(bounded(base).where("q > 0").mapInArrow(queries, _PACKED), 0, query_groups, groups)
    cells = (asked.withColumn("cell", F.col("other") * query_groups + F.col("own"))
             .union(dealt(base, 1, groups, query_groups).withColumn("cell", F.col("own") * query_groups + F.col("other")))
             .drop("own", "other").repartitionById(groups * query_groups, F.col("cell")).sortWithinPartitions("cell", "kind"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def scored(batches):
        held, best = {}, {}
        for batch in batches:
            for row in batch.to_pylist():  # a task has one cell, its queries come first
                if row["kind"] == 0:
                    held.setdefault(row["dims"], []).append(_unpacked(row))
                    continue
                if row["dims"] in held:
                    ids, v = (np.concatenate(c) for c in zip(*held.pop(row["dims"])))
                    best[row["dims"]] = Best(ids, v, k)
                if row["dims"] in best:
                    best[row["dims"]].add(*_unpacked(row))
        for own in best.values():
            ids, others, score = own.told()
            for at in range(0, len(ids), 1 << 16):
                yield batch_of(schema, *(c[at:at + (1 << 16)] for c in (ids, others, score)))

    parts = cells.mapInArrow(scored, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _packed(rows: DataFrame, every: int) -> DataFrame:
    """Rows of one vector length as blocks of two binaries."""

    def blocks(batches):
        held, count = {}, 0

        def out(dims: int, whole: bool):
            ids, v = (np.concatenate(c) for c in zip(*held.pop(dims)))
            limit = max(1, min(CANDIDATES, BLOCK_BYTES // (8 * max(dims, 1))))
            ends = len(ids) if whole else len(ids) // limit * limit
            for at in range(0, ends, limit):
                yield _block(ids[at:min(at + limit, ends)], v[at:min(at + limit, ends)], every)
            if ends < len(ids):
                held[dims] = [(ids[ends:], v[ends:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column("id").to_numpy(), batch.column("v")
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            order = np.argsort(size, kind="stable")
            cut = np.flatnonzero(np.append(True, size[order][1:] != size[order][:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
                rows = order[a:b]
                dims = int(size[rows[0]])
                held.setdefault(dims, []).append((ids[rows], flat[bounds[rows][:, None] + np.arange(dims)]))
            count += ids.nbytes + flat.nbytes
            if count >= HELD_BYTES:
                for dims in list(held):
                    yield from out(dims, len(held) > 1)
                count = 0
        for dims in list(held):
            yield from out(dims, True)

    return bounded(rows).mapInArrow(blocks, _PACKED)


def _block(ids: np.ndarray, v: np.ndarray, every: int) -> pa.RecordBatch:
    """One row: the vectors as numbers of ``width`` bytes, as few as do."""
    schema = pa.schema([("dims", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("q", pa.int64()),
                        ("ids", pa.binary()), ("vectors", pa.binary())])
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return batch_of(schema, [v.shape[1]], [width], [len(ids)], [int(np.count_nonzero(ids % every == 0))],
                    [ids.astype("<i8").tobytes()], [v.astype(f"<i{width}").tobytes()])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(ids), row["dims"])
