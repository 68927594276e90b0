"""Nulls, empty texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from linkloom.llm import bpe, decontaminate, html_text, line_dedup, ngram_join, quality, secret_scan, span_dedup, token_counts, token_files

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def empty(df):
    return df.limit(0)


def test_rows_in_rows_out(spark, odd):
    n = odd.count()
    results = [
        secret_scan.scan(odd),
        token_files.digest(spark, odd, VOCABULARY),
        quality.statistics(odd),
        quality.cascade(odd),
        line_dedup.digest(odd, line_dedup.keep_bitmaps(odd, 2)),
        line_dedup.apply(odd, line_dedup.keep_bitmaps(odd, 2)),
        span_dedup.remove(odd, 2),
        bpe.digests(odd, RANKS, PATTERN),
        ngram_join.classes(odd),
    ]
    for df in results:
        assert df.count() == n
        assert sum(r.doc_id is None for r in df.collect()) == 2


def test_repeated_ids_and_nulls(odd):
    dropped = sorted(((r.doc_id is not None, r.doc_id), r.n_dropped) for r in line_dedup.digest(odd, line_dedup.keep_bitmaps(odd, 2)).collect())
    assert all(n == 0 for _, n in dropped)  # rows with one id are one document
    assert [r.component_id for r in ngram_join.classes(odd).where("doc_id is null").collect()] == [None, None]
    assert {r.doc_id: r.component_id for r in ngram_join.classes(odd).where("doc_id is not null").collect()} == {1: 1, 2: 2, 3: 3}
    assert all(r.n_removed == 0 for r in span_dedup.remove(odd, 50).collect())
    counts = token_counts.by_section(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN).collect()
    assert sum(r.n_tokens for r in counts if r.doc_id in (1, 2)) == 0


def test_empty_tables(spark, odd):
    none = empty(odd)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (
        secret_scan.scan(none),
        token_files.digest(spark, none, VOCABULARY),
        quality.statistics(none),
        line_dedup.digest(none, line_dedup.keep_bitmaps(none)),
        span_dedup.remove(none),
        bpe.digests(none, RANKS, PATTERN),
        ngram_join.classes(none),
        decontaminate.leaks(none, benchmark),
        decontaminate.leaks(odd, benchmark),
        html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        token_counts.by_section(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN),
    ):
        assert df.count() == 0
    assert ngram_join.one_of_each(odd).count() == odd.count()
    assert decontaminate.clean(odd, benchmark).count() == odd.count()


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    folder = f"{tmp_path}/sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    own = docs.first()
    spark.createDataFrame([(1, " ".join(docs.where("doc_id = 10").first().text.split()[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == docs.columns == list(own.asDict())
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    assert 10 in kept["quality rules"] and 10 not in kept["benchmark decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, at, folder)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(last, RANKS).collect()}
    assert decoded == kept["benchmark decontamination"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(decoded)


@pytest.mark.parametrize("order", [0, 1])
def test_repeated_rows_in_ties(spark, order):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    df = spark.createDataFrame(rows[::-1] if order else rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in span_dedup.remove(df, 3).collect()) == [(1, 0), (1, 0), (2, 7)]
    assert sorted((r.doc_id, r.start) for r in token_files.digest(spark, df, VOCABULARY).collect())[0] == (1, 0)
