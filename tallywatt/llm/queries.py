"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallywatt.llm import alignment, bpe, filter_audit, jaccard, lattice, packing, quality, secret_scan, sharding, substring, suffix, token_files, topk
from tallywatt.llm.common import documents, run_folder
from tallywatt.llm.oracle import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER, with_ids=False)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeated_windows(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir), BYTE_TOKENIZER)


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_earlier_strings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.ledger(documents(spark, sf_dir))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.rejects(("base", 1)).alias("base_failed"), (~quality.rejects(("clean", 3))).alias("kept"),
                       "failed")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), folder, WORD_TOKENIZER)
    return token_files.checksums(token_files.read_token_files(spark, folder))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).drop("row")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(documents(spark, sf_dir))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 8)


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_scores(documents(spark, sf_dir), PIECE_TOKENIZER)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_figures(documents(spark, sf_dir), BYTE_TOKENIZER, PIECE_TOKENIZER)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
