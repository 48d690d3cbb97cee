"""Lexical retrieval packing.

Documents are encoded once, and terms are counted over all of them. By BM25
weights from these counts each document names its heaviest shared terms; those
that most documents name order the documents, and the order is cut into shards of
near equal size, which one task works on at once. So alike documents meet wherever
they lay in the input, and a term that very many name fills several shards, by its
documents' second term and then by a hash. A shard has an inverted index over
token ids. Each seed document fills its window with the unused documents of its
shard that score highest for its heaviest terms; when none fits any more, the best
one that is left is cut, and its rest is the next seed. Only the end of a shard is
short: it is written as sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, slices, stored
from tallywatt.llm.tokens import Encoded, encode, largest_id

WINDOW = 2048
END_ID = 1
#: Ids of one shard (about 8 MB of text): the reach of a seed's retrieval.
SHARD_IDS = 3 << 20
#: A document's heaviest shared terms, of which the most named ones route it.
ROUTE_TERMS = 16
#: Documents drawn per shard; the driver holds shards x draws of them.
DRAWS = 64
#: Terms of a seed's first query, the heaviest by BM25 weight; each further one has twice as many.
QUERY_TERMS = 32
# The usual parameters of BM25.
K1, B = 1.2, 0.75


class Counts(NamedTuple):
    """Of all documents: how many, their mean length, and by term how many hold it."""

    n: int
    mean: float
    df: np.ndarray


class Weighted(NamedTuple):
    """The distinct terms of documents, by document and term, with BM25 weights."""

    doc: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def weighted(encoded: Encoded, counts: Counts) -> Weighted:
    doc, term, tf = _distinct(encoded)
    idf = np.log1p((counts.n - counts.df + 0.5) / (counts.df + 0.5))
    length = np.diff(encoded.offsets)
    return Weighted(doc, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(1.0, counts.mean))))


def _distinct(encoded: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of each distinct term of each document."""
    ids, offsets = encoded
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bits = int(ids.max(initial=0)).bit_length()
    keys = doc << bits | ids
    if len(offsets) << bits <= 1 << 32:  # short keys sort in half the time
        keys = keys.astype(np.uint32)
    keys, tf = np.unique(keys, return_counts=True)
    keys = keys.astype(np.int64)
    return keys >> bits, keys & (1 << bits) - 1, tf


def _leading(doc: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of each document's places in ``order``, which goes by document."""
    return order[_ranks(doc[order]) < most]


def _ranks(doc: np.ndarray) -> np.ndarray:
    """How many places before lie in the same document."""
    return np.arange(len(doc)) - np.concatenate([[0], np.cumsum(np.bincount(doc))])[doc]


def heaviest(encoded: Encoded, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the ROUTE_TERMS heaviest terms that other documents hold too."""
    w = weighted(encoded, counts)
    shared = np.flatnonzero(counts.df[w.term] > 1)
    doc, term = w.doc[shared], w.term[shared]
    kept = _leading(doc, np.lexsort((-w.weight[shared], doc)), ROUTE_TERMS)
    return doc[kept], term[kept]


def route_keys(doc: np.ndarray, term: np.ndarray, votes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each of the documents 0 to len(places) - 1 with these heaviest
    terms: the two most named ones, then a hash, so that no key is too hot to be cut."""
    out = np.full((len(places), 2), 0xFFFFF, np.int64)
    order = _leading(doc, np.lexsort((term, -votes[term], doc)), 2)
    own = doc[order]
    out[own, _ranks(own)] = term[order] & 0xFFFFF
    return out[:, 0] << 43 | out[:, 1] << 23 | (_hash(places) >> np.uint64(41)).astype(np.int64)


def _hash(places: np.ndarray) -> np.ndarray:
    mixed = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


class Bm25:
    """Inverted index of a shard: for each term the documents that hold it and
    their weights, by the counts over all documents."""

    def __init__(self, encoded: Encoded, counts: Counts) -> None:
        doc, term, weight = weighted(encoded, counts)
        self.n = len(encoded.offsets) - 1
        self.doc_terms = term, np.searchsorted(doc, np.arange(self.n + 1))
        self.doc_weights = weight
        order = np.argsort(term.astype(np.min_scalar_type(len(counts.df))), kind="stable")
        self.posting_docs, self.posting_weights = doc[order], weight[order]
        self.postings = np.searchsorted(term[order], np.arange(len(counts.df) + 1))
        # a term that all documents hold, as the end id, makes none alike
        self.telling = (np.diff(self.postings) > 1) & (counts.df < counts.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """Unused documents that share a term with the seed, best first: by its
        heaviest terms, then by the next ones, until all are used."""
        terms, bounds = self.doc_terms
        own = slice(bounds[seed], bounds[seed + 1])
        shared = np.flatnonzero(self.telling[terms[own]])
        shared = shared[np.argsort(-self.doc_weights[own][shared], kind="stable")]
        at, size = 0, QUERY_TERMS
        while at < len(shared) and unused.any():
            lists = [slice(self.postings[t], self.postings[t + 1]) for t in terms[own][shared[at:at + size]].tolist()]
            docs = np.concatenate([self.posting_docs[s] for s in lists])
            score = np.bincount(docs, np.concatenate([self.posting_weights[s] for s in lists]), self.n)
            score[~unused] = 0
            found = np.flatnonzero(score)
            yield found[np.argsort(-score[found], kind="stable")]
            at, size = at + size, 2 * size


def plan(encoded: Encoded, window: int, counts: Counts) -> list[tuple[int, int, int, int, int]]:
    """Pieces (sequence, offset, document, start, length) of a shard. Every
    document needs one id at least."""
    index = Bm25(encoded, counts)
    length = np.diff(encoded.offsets)
    unused = np.ones(index.n, bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, at, waiting = 0, 0, None
    next_doc = 0

    def put(doc: int, start: int) -> int:
        """As much of the document as the window takes; where it was cut."""
        nonlocal at
        take = min(window - at, int(length[doc]) - start)
        pieces.append((sequence, at, doc, start, take))
        at += take
        return start + take

    def close() -> None:
        nonlocal sequence, at
        sequence, at = sequence + 1, 0

    while True:
        if waiting is None:
            while next_doc < index.n and not unused[next_doc]:
                next_doc += 1
            if next_doc == index.n:
                break
            waiting = next_doc, 0
            unused[next_doc] = False
        seed, start = waiting
        waiting = None
        start = put(seed, start)
        while start < length[seed]:
            close()
            start = put(seed, start)
        if at < window:
            for found in index.neighbours(seed, unused):
                while at < window and len(found):
                    fits = found[length[found] <= window - at]
                    best = int(fits[0] if len(fits) else found[0])
                    unused[best] = False
                    found = found[found != best]
                    cut = put(best, 0)
                    if cut < length[best]:
                        waiting = best, cut
                if at == window:
                    break
        if at == window:
            close()
        elif waiting is None:  # nothing alike is left: any document goes on
            continue
    return _powers_of_two(pieces, sequence, at)


def _powers_of_two(pieces: list, sequence: int, held: int) -> list:
    """The last, short sequence as sequences whose lengths are powers of two."""
    if not held:
        return pieces
    last = [p for p in pieces if p[0] == sequence]
    out = pieces[:len(pieces) - len(last)]
    room, at = 1 << (held.bit_length() - 1), 0
    for _, _, doc, start, length in last:
        while length:
            take = min(length, room - at)
            out.append((sequence, at, doc, start, take))
            start, length, at, held = start + take, length - take, at + take, held - take
            if at == room and held:
                sequence, at, room = sequence + 1, 0, 1 << (held.bit_length() - 1)
    return out


def _encoded(docs: DataFrame, path: str, end_id: int, kind: str, remembered: int | None) -> DataFrame:
    """Stored: doc_id, place (names the row), size and ids (of ``kind``); each
    task's last row has no place but its counts: terms, and how many hold each."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()),
                        ("terms", pa.binary()), ("df", pa.binary())])

    def rows(batches):
        place, df = TaskContext.get().partitionId() << 40, np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            ids, offsets = encode(batch.column("text"), path, remembered)
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(batch.num_rows + 1)
            df = _added(df, np.bincount(_distinct(Encoded(ids, offsets))[1]))
            data = ids.astype(kind)
            held = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            none = [None] * len(held)
            yield batch_of(schema, batch.column("doc_id"), place + np.arange(len(held)), np.diff(offsets), held, none, none)
            place += len(held)
        terms = np.flatnonzero(df)
        if len(terms):
            yield batch_of(schema, [None], [None], [None], [None], [terms.astype("<i8").tobytes()], [df[terms].tobytes()])

    return stored(docs.mapInArrow(rows, "doc_id long, place long, size long, ids binary, terms binary, df binary"), "encoded")


def _added(sums: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(sums), len(more)), np.int64)
    out[:len(sums)] = sums
    out[:len(more)] += more
    return out


def _by_term(told: DataFrame) -> np.ndarray:
    """Sums of the rows (term, n) by term: as many as the tokenizer has ids."""
    told = told.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(told["term"].max()) + 1 if len(told) else 0, np.int64)
    out[told["term"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    return out


def _counted(held: DataFrame) -> DataFrame:
    """(term, n) of each task over the counts in its rows."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def rows(batches):
        df = np.zeros(0, np.int64)
        for batch in batches:
            for terms, many in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
                df = _added(df, np.bincount(np.frombuffer(terms, "<i8"), np.frombuffer(many, "<i8")).astype(np.int64))
        terms = np.flatnonzero(df)
        yield batch_of(schema, terms, df[terms])

    return held.where("terms is not null").select("terms", "df").mapInArrow(rows, "term long, n long")


def _ids_of(batch: pa.RecordBatch, kind: str) -> Encoded:
    held = batch.column("ids")
    ends = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])
    data = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, held.offset * 4)
    return Encoded(np.frombuffer(held.buffers()[2], np.uint8)[data[0]:data[-1]].view(kind), ends)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, with_ids: bool = True, remembered: int | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` token ids.

    One row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (little-endian 32-bit ids), doc_tokens (with the end id),
    sequence_id, offset (in the sequence, gapless from 0) and, ``with_ids``, ids.
    ``remembered`` bounds the word pieces whose ids a worker keeps (memory, not results).
    Each document ends with ``end_id``; null and empty texts are that id alone.
    Each id lies in exactly one piece. Repeated rows are packed each for itself;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(largest_id(path), end_id) < 1 << 16 else "<u4"
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = _encoded(narrow, path, end_id, kind, remembered)
    held = encoded.where("place is not null").select("doc_id", "place", "size", "ids")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counts = spark.sparkContext.broadcast(tuple(Counts(n, total / max(1, n), _by_term(_counted(encoded)))))
    shards = max(1, -(-total // SHARD_IDS))

    told = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def named(batches):
        """Votes for terms, and terms of documents drawn in proportion to their size."""
        known, votes = Counts(*counts.value), np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            doc, term = heaviest(_ids_of(batch, kind), known)
            votes = _added(votes, np.bincount(term))
            places = batch.column("place").to_numpy()
            expected = batch.column("size").to_numpy() * (shards * DRAWS / total)
            times = np.floor(expected + (_hash(_hash(places)) >> np.uint64(11)) / 2.0 ** 53).astype(np.int64)
            drawn = np.flatnonzero(times)
            bounds = np.searchsorted(doc, [drawn, drawn + 1]).T.tolist()
            yield batch_of(told, [None] * len(drawn), times[drawn], places[drawn], [term[a:b] for a, b in bounds])
        term = np.flatnonzero(votes)
        yield batch_of(told, term, votes[term], [None] * len(term), [None] * len(term))

    votes, splitters = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if shards > 1:
        names = stored(held.select("place", "size", "ids").mapInArrow(named, "term long, n long, place long, terms array<long>"), "named")
        votes = _by_term(names.where("term is not null"))
        drawn = names.where("term is null").select("n", "place", "terms").toPandas()  # shards x draws rows expected
        doc = np.repeat(np.arange(len(drawn)), drawn["terms"].map(len).to_numpy())
        term = np.concatenate([np.zeros(0, np.int64), *drawn["terms"]]).astype(np.int64)
        keys = route_keys(doc, term, votes, drawn["place"].to_numpy(np.int64))
        order = np.argsort(keys)
        at = np.cumsum(drawn["n"].to_numpy()[order])
        splitters = keys[order][np.searchsorted(at, np.arange(1, shards) * at[-1] / shards)]
    routes = spark.sparkContext.broadcast((votes, splitters))
    routed = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("place", pa.int64()),
                        ("key", pa.int64()), ("shard", pa.int32())])

    def route(batches):
        known, (votes, splitters) = Counts(*counts.value), routes.value
        for batch in slices(batches, "ids"):
            places = batch.column("place").to_numpy()
            keys = np.zeros(len(places), np.int64)
            if len(splitters):
                keys = route_keys(*heaviest(_ids_of(batch, kind), known), votes, places)
            yield batch_of(routed, *[batch.column(c) for c in ("doc_id", "size", "ids", "place")], keys,
                           np.searchsorted(splitters, keys))

    met = held.mapInArrow(route, "doc_id long, size long, ids binary, place long, key long, shard int")
    met = met.repartitionById(shards, F.col("shard")).sortWithinPartitions("key", "place").select("doc_id", "size", "ids")

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(batches):
        sequences = TaskContext.get().partitionId() << 40
        for doc_ids, ids, offsets in _shards(batches, kind):
            pieces = plan(Encoded(ids, offsets), window, Counts(*counts.value))
            sequence, at, doc, start, length = np.array(pieces, np.int64).reshape(-1, 5).T
            begin = offsets[doc] + start
            for k in range(0, len(doc), 1 << 12):  # rows go on in batches bounded in ids
                part = slice(k, k + (1 << 12))
                a, size = begin[part], length[part]
                sums = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(a.tolist(), (a + size).tolist())]
                columns = [doc_ids.take(pa.array(doc[part])), start[part], size, sums, np.diff(offsets)[doc[part]],
                           sequences + sequence[part], at[part]]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)])
                    order = np.repeat(a - ends[:-1], size) + np.arange(ends[-1])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[order].astype(np.int32))))
                yield batch_of(schema, *columns)
            sequences += int(sequence[-1]) + 1

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return met.mapInArrow(rows, out + ", ids array<int>" * with_ids)


def _shards(batches, kind: str):
    """(document ids, ids, offsets) of a task's documents; what is twice as large
    as a shard should be is cut."""
    names, parts, sizes, count = [], [], [], 0

    def one():
        ids = np.concatenate(parts).astype(np.int32)
        return pa.concat_arrays(names), ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    for batch in slices(batches, "ids"):
        ids, offsets = _ids_of(batch, kind)
        names.append(batch.column("doc_id"))
        parts.append(ids.copy())
        sizes.append(np.diff(offsets))
        count += len(ids)
        if count >= 2 * SHARD_IDS:
            yield one()
            names, parts, sizes, count = [], [], [], 0
    if count:
        yield one()
