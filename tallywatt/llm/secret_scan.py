"""Secrets in texts: keyword automaton, anchored expressions, checksums.

An Aho-Corasick automaton finds every keyword in one pass. A kind's expression
is tried only where one of its keywords begins, from the end of the kind's last
match on, which gives the leftmost non-overlapping matches of the whole text.
Kinds with a checksum or an inner structure are kept only if it holds. Runs of
hexadecimal digits have no keyword; their hits are the runs that are long enough.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatt.llm.common import batch_of, bounded, of_process, slices


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# Kinds in the order in which they are listed, their keywords
# (lower case) and the expression that must match where a keyword begins.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[opusr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
}
_RUN = re.compile(r"[A-Za-z0-9_-]*")
HEX_LENGTH = 24
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


def _long_group(match: re.Match) -> bool:
    return len(match[1]) >= 6


def _long_match(match: re.Match) -> bool:
    return len(match[0]) >= 20


def _crc_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of those behind the prefix, in base 62."""
    body = match[0].partition("_")[2]
    value, digits = zlib.crc32(body[:-6].encode()), ""
    while value:
        value, rest = divmod(value, 62)
        digits = _BASE62[rest] + digits
    return digits.rjust(6, "0") == body[-6:]


def _is_header(match: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    part = match[0].partition(".")[0]
    try:
        told = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(told, dict) and "alg" in told


CHECKS = {"assign": _long_group, "access": _long_match, "github": _crc_holds, "npm": _crc_holds, "jwt": _is_header}
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)


def _automaton():
    kept = of_process("secret_keywords")
    if "automaton" not in kept:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                automaton.add_word(word, (kind, len(word)))
        automaton.make_automaton()
        kept["automaton"] = automaton
    return kept["automaton"]


def spans_of(text: str | None, may_have_hex: bool = True) -> list[Span]:
    """All spans of a whole text (code points, end exclusive), by start, then
    kind as listed; null and empty have none."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a character whose small form is longer
        low = text.translate(_LOWER)
    spans, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - length, kind) for end, (kind, length) in _automaton().iter(low))
    for at, kind in hits:
        if at < ends[kind]:
            continue
        match = PATTERNS[kind].match(text, at)
        if match:
            ends[kind] = match.end()
            if kind not in CHECKS or CHECKS[kind](match):
                spans.append(Span(match.start(), match.end(), kind))
        elif kind == "jwt" and text.startswith("eyJ", at):
            ends[kind] = _RUN.match(text, at).end()  # what follows the run fails for its later hits too
    if may_have_hex:
        spans += [Span(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def _with_long_hex(texts: pa.Array) -> np.ndarray:
    """Texts that hold a run of HEX_LENGTH hexadecimal digits."""
    return pc.match_substring_regex(pc.fill_null(texts, ""), "[0-9a-f]{%d}" % HEX_LENGTH).to_numpy(zero_copy_only=False)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and
    spans (``kind:start:end`` joined by commas; base_sha256 takes the first three
    kinds only).

    Null and empty texts have no span. Equal rows give equal rows, other columns
    are ignored, an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            counts, digests, told = [], [], []
            for text, long_hex in zip(texts.to_pylist(), _with_long_hex(texts).tolist()):
                spans = spans_of(text, long_hex)
                base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in BASE_KINDS)
                counts.append([sum(s.kind == kind for s in spans) for kind in BASE_KINDS])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                told.append(",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans))
            counts = np.array(counts, np.int64)
            yield batch_of(schema, batch.column("doc_id"), *counts.T, digests, told)

    narrow = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their texts (overlapping ones as one) replaced
    by ``mask``. All columns stay; null stays null."""
    @F.pandas_udf("string")
    def masked(texts):
        def one(text):
            spans = spans_of(text)
            if not spans:
                return text
            out, at = [], 0
            for span in spans:
                if span.start >= at:
                    out += [text[at:span.start], mask]
                at = max(at, span.end)
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    return bounded(docs).withColumn(text_col, masked(F.col(text_col)))
