"""The operators' queries over whole tables, by the names the driver calls."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import bpe, decontaminate, html_text, line_dedup, ngram_join, quality, secret_scan, span_dedup, sql, token_counts, token_files

# Fixed values of the contracts.
LINE_MIN_DOCS = 10
NGRAM, NGRAM_SHARE = 3, 90
SPAN_WORDS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_section(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digest(docs, line_dedup.keep_bitmaps(docs, LINE_MIN_DOCS)).drop("keep")


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove(table(spark, sf_dir, "documents"), SPAN_WORDS).drop("kept_text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), NGRAM, NGRAM_SHARE)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_html_text,
        op3_secret_scan,
        op4_token_files,
        op5_quality_rules,
        op6_token_counts,
        op7_line_dedup,
        op8_span_dedup,
        op9_byte_bpe,
        op10_ngram_join,
    )
}
#: The other contracts need a tokenizer, positions of matches or a parser, which SQL lacks.
ORACLE_SQL = {"op5_quality_rules": sql.OP5, "op7_line_dedup": sql.OP7, "op8_span_dedup": sql.OP8, "op10_ngram_join": sql.OP10}
