"""From documents to packed training sequences, stage by stage.

Every stage takes all that its predecessor kept and, but for the last, returns
the columns of ``documents``. Columns that a stage does not know pass unchanged;
null and empty texts count as texts without words. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatt.llm import jaccard, packing, quality, secret_scan, substring
from tallywatt.llm.common import documents, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
POLICY = ("clean", 3)
#: Word pieces a worker remembers; the earlier stages have left it less memory.
REMEMBERED = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    told = quality.ledger(docs, carry=tuple(docs.columns))
    return told.where(~quality.rejects(POLICY)).select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs, jaccard.near_duplicates(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur anywhere else too lose their words.
    A document that loses none keeps its text as it is."""
    found = substring.remove_repeated_windows(docs, carry=tuple(docs.columns))
    changed, kept = F.col("n_removed") > 0, F.col("kept")
    new = {"text": kept, "n_chars": F.length(kept)}

    def column(field):
        old = F.col("carried").getField(field.name)
        if field.name in new:
            old = F.when(changed, new[field.name].cast(field.dataType)).otherwise(old)
        return old.alias(field.name)

    return found.select(*map(column, docs.schema))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(length.isNull(), F.col("n_chars")).otherwise(length))


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that make up each sequence, with their ids."""
    return packing.pack_documents(docs, TOKENIZER, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", lexical_packing),
]
#: SQL cannot express hashing into signatures, tokenizers or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each but the last is
    written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
