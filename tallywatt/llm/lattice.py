"""Marginal likelihood of texts under a subword unigram model.

The vocabulary is an existing one (a ``sentencepiece`` file); its scores are the
start of the model. A word is a lattice: nodes are places between its bytes,
edges are the vocabulary's entries that lie there, and every segmentation is a
path. The log-space forward recursion adds up all paths, so a word's probability
is that of all its segmentations together. The entries' probabilities are fitted
to the words of the training documents by expected counts (forward and backward),
over one row per distinct word.

A text is its words, each with a space before it, and an end. Entries never span
words, so a text's marginal probability is the product of its words' and the end's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, of_process, slices, stored, text_bytes, words_of
from tallywatt.llm.shared import heavy, with_joined

#: Rounds of fitting by expected counts.
ROUNDS = 3
#: Observations that the start's probabilities count for, per entry on average.
PRIOR = 0.1
#: Bytes of words in one matrix step; longer words go one by one in windows.
STEP_BYTES, LONG_WORD = 1 << 18, 128
FOLDS, HELD_OUT = 7, 2


class Entries(NamedTuple):
    """The vocabulary as a trie in arrays: ``step[state * width + kind[byte]]`` is
    the next state (0: none), ``entry[state]`` the entry that ends there (-1: none)."""

    kind: np.ndarray
    width: int
    step: np.ndarray
    entry: np.ndarray
    start: np.ndarray  # the entries' first probabilities, adding up to one
    longest: int


def entries(path: str) -> Entries:
    """Entries of a vocabulary file in the form they have in lower-case words:
    A-Z lowered, the space mark as a space in front, all 256 single bytes.
    Entries that no word can hold are left out. Built once per worker."""
    kept = of_process("entries")
    if path not in kept:
        kept[path] = _entries(path)
    return kept[path]


def _entries(path: str) -> Entries:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # the file's scores fall by one with each rank; weights fall with the rank as word frequencies do
    score = {bytes([b]): float(-model.get_piece_size()) for b in range(256)}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode().lower()
        if b" " not in piece[1:] and not any(9 <= b <= 13 for b in piece):
            score[piece] = max(model.get_score(k), score.get(piece, -np.inf))
    pieces = sorted(score)
    weight = 1 / (2 - np.array([min(score[p], 0.0) for p in pieces]))
    alphabet = sorted({b for p in pieces for b in p})
    kind = np.zeros(256, np.int64)
    kind[alphabet] = np.arange(len(alphabet))
    states: dict[tuple[int, int], int] = {}
    ends = []
    for piece in pieces:
        at = 0
        for b in piece:
            at = states.setdefault((at, int(kind[b])), len(states) + 1)
        ends.append(at)
    step = np.zeros((len(states) + 1) * len(alphabet), np.int32)
    for (at, k), to in states.items():
        step[at * len(alphabet) + k] = to
    entry = np.full(len(states) + 1, -1, np.int32)
    entry[ends] = np.arange(len(pieces))
    return Entries(kind, len(alphabet), step, entry, weight / weight.sum(), max(map(len, pieces)))


class Edges(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    entry: np.ndarray


def edges(data: np.ndarray, stops: np.ndarray, at: np.ndarray, of: Entries) -> Edges:
    """All entries that lie in ``data`` from the places ``at`` on and end at or
    before ``stops``, the ends of the places' words."""
    kinds = of.kind[data]
    state, here, starts, ends, found = np.zeros(len(at), np.int32), at, [], [], []
    for length in range(of.longest):
        inside = here + length < stops
        here, stops, state = here[inside], stops[inside], state[inside]
        state = of.step[state.astype(np.int64) * of.width + kinds[here + length]]
        alive = state > 0
        here, stops, state = here[alive], stops[alive], state[alive]
        if not len(here):
            break
        entry = of.entry[state]
        hit = entry >= 0
        starts.append(here[hit])
        ends.append(here[hit] + length + 1)
        found.append(entry[hit])
    return Edges(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, found)))


def _log_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log of the sum of exp(values) between the bounds."""
    top = np.maximum.reduceat(values, bounds)
    size = np.diff(np.append(bounds, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size)), bounds))


def _recursion(source: np.ndarray, target: np.ndarray, gain: np.ndarray, depth: np.ndarray, out: np.ndarray) -> None:
    """out[target] = log sum of out[source] + gain, depth by depth; ``depth`` is
    that of the target, sources are of smaller depth."""
    order = np.lexsort((target, depth))
    source, target, gain, depth = source[order], target[order], gain[order], depth[order]
    level = np.flatnonzero(np.diff(depth, prepend=-1))
    for a, b in zip(level.tolist(), np.append(level[1:], len(depth)).tolist()):
        bounds = np.flatnonzero(np.diff(target[a:b], prepend=-1))
        out[target[a:b][bounds]] = _log_sums(out[source[a:b]] + gain[a:b], bounds)


class Scored(NamedTuple):
    log_p: np.ndarray  # natural log of each word's marginal probability
    expected: np.ndarray | None  # expected count of every entry, weighted


def score_words(data: np.ndarray, ends: np.ndarray, log_p: np.ndarray, of: Entries, times: np.ndarray | None = None) -> Scored:
    """Forward recursion over words side by side: word i is data[ends[i-1]:ends[i]].
    With ``times`` also backward, for the expected counts of the entries."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    word = np.repeat(np.arange(len(ends)), size)
    at = np.arange(len(data))
    found = edges(data, ends[word], at, of)
    # nodes: a word of n bytes has n + 1
    source, target = found.start + word[found.start], found.end + word[found.start]
    first, last = starts + np.arange(len(ends)), ends + np.arange(len(ends))
    gain = log_p[found.entry]
    alpha = np.zeros(len(data) + len(ends))
    _recursion(source, target, gain, target - first[word[found.start]], alpha)
    total = alpha[last]
    if times is None:
        return Scored(total, None)
    beta = np.zeros(len(alpha))
    _recursion(target, source, gain, last[word[found.start]] - source, beta)
    share = np.exp(alpha[source] + gain + beta[target] - total[word[found.start]]) * times[word[found.start]]
    return Scored(total, np.bincount(found.entry, share, len(log_p)))


def score_long(data: np.ndarray, log_p: np.ndarray, of: Entries, times: float | None = None) -> Scored:
    """The same for one word of any length, in windows: two values per byte are held."""
    n = len(data)
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    windows = range(0, n, 1 << 14)

    def within(a: int) -> Edges:
        here = np.arange(a, min(a + (1 << 14), n))
        return edges(data, np.full(len(here), n), here, of)

    for a in windows:
        found = within(a)
        order = np.lexsort((found.end, found.start))
        _push(found.start[order], found.end[order], log_p[found.entry[order]], alpha)
    if times is None:
        return Scored(alpha[n:], None)
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0.0
    expected = np.zeros(len(log_p))
    for a in reversed(windows):
        found = within(a)
        order = np.lexsort((found.start, -found.end))
        order = order[np.argsort(-found.start[order], kind="stable")]
        start, end, entry = found.start[order], found.end[order], found.entry[order]
        bounds = np.flatnonzero(np.diff(start, prepend=-1))
        for x, y in zip(bounds.tolist(), np.append(bounds[1:], len(start)).tolist()):
            beta[start[x]] = np.logaddexp.reduce(beta[end[x:y]] + log_p[entry[x:y]])
        expected += np.bincount(entry, np.exp(alpha[start] + log_p[entry] + beta[end] - alpha[n]), len(log_p))
    return Scored(alpha[n:], expected * times)


def _push(start: np.ndarray, end: np.ndarray, gain: np.ndarray, alpha: np.ndarray) -> None:
    """Edges in order of their start, from which all that ends there is known."""
    bounds = np.flatnonzero(np.diff(start, prepend=-1))
    for x, y in zip(bounds.tolist(), np.append(bounds[1:], len(start)).tolist()):
        to = end[x:y]  # distinct
        alpha[to] = np.logaddexp(alpha[to], alpha[start[x]] + gain[x:y])


def _scored(batch: pa.RecordBatch, log_p: np.ndarray, of: Entries, times: np.ndarray | None) -> Scored:
    """Marginals of the batch's words, each with a space before it."""
    data, offsets = text_bytes(batch.column("word"))
    n = len(offsets) - 1
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(n + 1)
    size = np.diff(offsets)
    out, expected = np.zeros(n), np.zeros(len(log_p))
    # words of like length side by side: few recursion steps for many words
    order = np.argsort(size, kind="stable")
    short = order[:np.searchsorted(size[order], LONG_WORD, "right")]
    cuts = np.flatnonzero(np.diff(np.cumsum(size[short]) // STEP_BYTES)) + 1
    for part in np.split(short, cuts):
        if not len(part):
            continue
        ends = np.cumsum(size[part])
        took = np.arange(ends[-1]) + np.repeat(offsets[part] - (ends - size[part]), size[part])
        told = score_words(data[took], ends, log_p, of, None if times is None else times[part])
        out[part] = told.log_p
        if times is not None:
            expected += told.expected
    for k in order[len(short):].tolist():
        told = score_long(data[offsets[k]:offsets[k + 1]], log_p, of, None if times is None else times[k])
        out[k] = told.log_p[0]
        if times is not None:
            expected += told.expected
    return Scored(out, expected)


def lexicon(docs: DataFrame) -> DataFrame:
    """(word, n_train, n_all) over the columns ``text`` and ``train``: words are
    lowered (A-Z) and counted in the tasks first; the null word is the end."""
    schema = pa.schema([("word", pa.string()), ("n_train", pa.int64()), ("n_all", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(pc.ascii_lower(batch.column("text")))
            train = batch.column("train").to_numpy(zero_copy_only=False)
            in_train = np.repeat(train, np.diff(words.offsets))
            n = len(words.vocabulary)
            yield batch_of(schema, words.vocabulary, np.bincount(words.codes[in_train], minlength=n), np.bincount(words.codes, minlength=n))
            yield batch_of(schema, pa.array([None], pa.string()), [int(train.sum())], [len(train)])

    told = docs.mapInArrow(counts, "word string, n_train long, n_all long")
    return told.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")).where("n_all > 0")


def fitted(words: DataFrame, path: str, end_times: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural logs of the entries' probabilities and of the end's. What comes to
    the driver is one number per entry and group of tasks; the vocabulary bounds it."""
    of = entries(path)
    entry_n = len(of.start)
    schema = pa.schema([("entry", pa.int32()), ("expected", pa.float64())])
    p = of.start
    trained = bounded(words.where("n_train > 0 AND word IS NOT NULL").select("word", "n_train"))
    for _ in range(rounds):
        log_p = np.log(p)

        def expected(batches, log_p=log_p):
            own, of = np.zeros(entry_n), entries(path)
            for batch in slices(batches, "word"):
                own += _scored(batch, log_p, of, batch.column("n_train").to_numpy().astype(np.float64)).expected
            hit = np.flatnonzero(own)
            yield batch_of(schema, hit.astype(np.int32), own[hit])

        told = (trained.mapInArrow(expected, "entry int, expected double")
                .groupBy("entry").agg(F.sum("expected").alias("expected")).toPandas())  # at most one row per entry
        seen = np.zeros(entry_n)
        seen[told["entry"].to_numpy(np.int64)] = told["expected"].to_numpy(np.float64)
        p = (seen + PRIOR * entry_n * of.start) / (seen.sum() + PRIOR * entry_n)
    end = (end_times + 1) / (end_times + 1 + (seen.sum() if rounds else 0) + PRIOR * entry_n)
    return np.log(p * (1 - end)), float(np.log(end))


def lm_scores(docs: DataFrame, path: str, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams of words) and score (log10 of the text's marginal
    probability under the subword model).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered, and one end a text. Both models
    learn from the documents whose crc32 of the id as text is not 2 modulo 7 (null
    id: of the empty text), over all of them. Null and empty texts are an end alone.
    Repeated rows count and are scored each. An empty table gives no rows; without
    training documents the model is its start. Other columns are ignored.
    """
    spark = docs.sparkSession
    of_id = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                  (of_id != HELD_OUT).alias("train"))
    words = stored(lexicon(narrow.select("text", "train")), "words")
    total = words.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in {
        "tokens": F.sum("n_train"), "distinct": F.count(F.when(F.col("n_train") > 0, 1)), "all": F.sum("n_all"),
        "ends": F.max(F.when(F.col("word").isNull(), F.col("n_train")))}.items()]).first()
    log_p, log_end = fitted(words, path, total["ends"], rounds)
    scored = stored(_word_figures(words.where("word IS NOT NULL"), path, log_p), "word-scores")

    is_heavy = heavy(F.col("n_all"), total["all"], F.octet_length("word"))
    near = scored.where(is_heavy).select("word", "n_train", "score").toArrow().combine_chunks()  # bounded, see heavy()
    lookup = spark.sparkContext.broadcast(near)
    tokens, end_train = total["tokens"], total["ends"]
    per_token, end_base, end_score = np.log10(tokens + total["distinct"] + 1), np.log10(end_train + 1), log_end / np.log(10)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                        ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def partly(batches):
        row = TaskContext.get().partitionId() << 40
        table = lookup.value
        known, figures = table.column("word").combine_chunks(), [table.column(c).to_numpy() for c in ("n_train", "score")]
        for batch in slices(batches, "text"):
            words = words_of(pc.ascii_lower(batch.column("text")))
            place = pc.fill_null(pc.index_in(words.vocabulary, known), -1).to_numpy()
            n, size = batch.num_rows, np.diff(words.offsets)
            here = place[words.codes]
            near, text = here >= 0, np.repeat(np.arange(n), size)
            n_train, score = (f[here[near]] for f in figures)
            keys, times, ends = _distinct(text[~near], words.codes[~near], n, len(words.vocabulary))
            far = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.vocabulary.take(pa.array(keys)))
            yield batch_of(
                schema, row + np.arange(n), batch.column("doc_id"), pc.invert(batch.column("train")), size + 1,
                np.bincount(text[near], n_train > 0, n).astype(np.int64) + int(end_train > 0),
                np.bincount(text[near], np.log10(n_train + 1.0), n) + end_base,
                np.bincount(text[near], score, n) + end_score,
                far, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times)))
            row += n

    rows = stored(narrow.mapInArrow(partly, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                            "base double, score double, words array<string>, times array<long>"), "scored")
    far = scored.where(~is_heavy).withColumnRenamed("word", "key").withColumnRenamed("score", "of_word")
    times = F.col("times")
    told = with_joined(rows, "words", "times", far, {
        "n_known": F.when(F.col("n_train") > 0, times).otherwise(0), "base": F.log10(F.col("n_train") + 1.0) * times,
        "score": F.col("of_word") * times})
    base = F.col("base") - F.col("n_tokens") * F.lit(float(per_token))
    return told.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                       base.alias("base_score"), "score")


def _word_figures(words: DataFrame, path: str, log_p: np.ndarray) -> DataFrame:
    """(word, n_train, n_all, score): log10 of each distinct word's marginal."""
    schema = pa.schema([("word", pa.string()), ("n_train", pa.int64()), ("n_all", pa.int64()), ("score", pa.float64())])

    def figures(batches):
        of = entries(path)
        for batch in slices(batches, "word"):
            told = _scored(batch, log_p, of, None)
            yield batch_of(schema, *[batch.column(c) for c in schema.names[:3]], told.log_p / np.log(10))

    return bounded(words).select("word", "n_train", "n_all").mapInArrow(figures, "word string, n_train long, n_all long, score double")


def _distinct(text: np.ndarray, codes: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, times, ends): the distinct codes of each text and how often they occur."""
    keys, times = np.unique(text * np.int64(max(width, 1)) + codes, return_counts=True)
    owner, own = keys // max(width, 1), keys % max(width, 1)
    return own, times, np.searchsorted(owner, np.arange(n + 1))
