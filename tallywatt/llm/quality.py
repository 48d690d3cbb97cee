"""Quality rules as a ledger of bits.

One pass measures every text and evaluates every rule once; the ledger keeps the
measurements and one bit per failed rule. A policy is a named, versioned set of
rules: applying it, or asking what each of its rules does, is bit arithmetic on
the ledger and reads no text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywatt.llm.common import bounded, carried, slices, text_bytes, words_of

REPEAT_WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word", "n_exclaims",
            "endless_chars", "n_unspaced")
#: A word of more characters is endless: encoded data, no language.
ENDLESS = 1000


class Rule(NamedTuple):
    name: str
    fails: str  # SQL over the measurements


# The bit of a rule is its place here, so rules are only appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("endless_word", "longest_word > 1000"),
    Rule("shouting", "n_exclaims > n_words"),
    Rule("long_spaced_words", "word_chars > 20 * n_words AND 10 * n_unspaced < 3 * word_chars"),
    Rule("mostly_endless", "2 * endless_chars > word_chars AND 10 * n_unspaced < 3 * word_chars"),
)
#: Policies by name and version: the rules that reject a document.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("clean", 1): ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    ("clean", 2): ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words",
                   "endless_word", "shouting"),
    # one endless word does not reject a long text, nor does a script without spaces
    ("clean", 3): ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_spaced_words",
                   "mostly_endless", "shouting"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(name) for name in rules)


def rejects(policy: tuple[str, int], failed: Column | None = None) -> Column:
    """Whether the policy rejects a document with these failure bits."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) != 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements, ``failed`` (bit i: RULES[i] fails) and, as
    struct ``carried``, the columns named in ``carry``; one row per document.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text; null and empty texts measure
    0 everywhere and fail ``few_words``. Equal rows give equal rows; an empty
    table gives none.
    """
    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         carried(carry))
    zeros = [F.lit(0).cast("long").alias(m) for m in MEASURES]
    result = narrow.select("doc_id", "carried", *zeros).schema
    schema = to_arrow_schema(result)

    def rows(batches):
        for batch in slices(batches, "text"):
            told = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("carried"), *[pa.array(told[m], pa.int64()) for m in MEASURES]],
                schema=schema)

    measured = narrow.mapInArrow(rows, result)
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES):
        failed = failed + F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(F.lit(0))
    return measured.withColumn("failed", failed)


def ablations(table: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """What each rule of a policy does: rule, n_failed (documents that fail it),
    n_alone (rejected by it alone, so kept without it) and n_kept (kept by the
    whole policy). From the counts per bit pattern, 2^rules rows at most."""
    mask = mask_of(POLICIES[policy])
    patterns = table.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in RULES]
    told = [F.struct(F.lit(name).alias("rule"), F.lit(1 << names.index(name)).alias("bit")) for name in POLICIES[policy]]
    each = patterns.withColumn("of", F.explode(F.array(*told)))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy(F.col("of.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("of.bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("of.bit")).alias("n_alone"),
        total(F.col("bits") == 0).alias("n_kept"))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    texts = pc.fill_null(texts, "")
    words = words_of(texts)
    data, bounds = text_bytes(texts)
    sizes = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    length = sizes[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    n_lines, n_dup_lines = _lines(texts)
    return {
        "n_words": np.diff(words.offsets),
        "word_chars": _sums(length, words.offsets),
        "n_symbols": _sums(_SYMBOL[data], bounds),
        "n_exclaims": _sums(data == 33, bounds),
        "endless_chars": _sums(np.where(length > ENDLESS, length, 0), words.offsets),
        "n_unspaced": _sums(_unspaced(data), bounds),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _repeated(words.codes.astype(np.int64), words.offsets, len(sizes)),
        "n_lines": n_lines,
        "longest_word": np.array([length[a:b].max(initial=0) for a, b in zip(words.offsets[:-1], words.offsets[1:])], np.int64),
    }


# The characters that count as symbols.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


# First and last code point of the scripts that are written without
# spaces between words: Thai and Lao, Myanmar, Khmer, kana, Han, Han of the second plane.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FFFF))


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of every character of a script without spaces."""
    marks = np.zeros(len(data), bool)
    for lead, size in ((0xE0, 3), (0xF0, 4)):  # characters of three and of four bytes
        at = np.flatnonzero((data >= lead) & (data < lead + (1 << 7 - size)))
        if not len(at):
            continue
        point = data[at].astype(np.int64) & ((1 << 7 - size) - 1)
        for k in range(1, size):
            point = point << 6 | data[at + k] & 0x3F
        marks[at] = np.any([(point >= a) & (point <= b) for a, b in UNSPACED], axis=0)
    return marks


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wordy = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    kept = wordy[codes] if len(codes) else np.zeros(0, bool)
    text, codes = text[kept], codes[kept]
    n = np.bincount(text, minlength=len(texts))
    distinct = np.unique(text * max(1, len(wordy)) + codes) // max(1, len(wordy))
    return n, n - np.bincount(distinct, minlength=len(texts))


def _repeated(codes: np.ndarray, offsets: np.ndarray, kinds: int) -> np.ndarray:
    """Words that lie in a window of REPEAT_WINDOW words which the text holds twice."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(codes) < REPEAT_WINDOW:
        return out
    pairs = codes[:-1] * kinds + codes[1:]
    if kinds > 1 << 20:  # three codes would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * kinds + codes[2:]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = windows[a:b - REPEAT_WINDOW + 1] if b - a >= REPEAT_WINDOW else ()
        if len(own) < 2:
            continue
        ordered = np.sort(own)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            hit = np.zeros(b - a + 1, np.int64)
            place = np.flatnonzero(np.isin(own, again))
            hit[place] += 1
            hit[place + REPEAT_WINDOW] -= 1
            out[i] = np.count_nonzero(np.cumsum(hit[:-1]))
    return out
