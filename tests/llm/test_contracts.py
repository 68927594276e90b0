"""Every contract against a plain version of it."""

import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from linkloom.llm import arrow, bpe, line_dedup, ngram_join, quality, secret_scan, segments, span_dedup, sql, token_files
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=segments.ranks(RANKS), special_tokens={})


def test_secrets(docs, rows):
    found = secret_scan.scan(docs)
    assert collected(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(r[:5] for r in brute.op3(rows))
    base = {r[0]: r[5] for r in brute.op3(rows)}
    for r in found.collect():
        assert {x for x in r.spans.split(",") if not x.startswith("opaque")} - {""} == set(base[r.doc_id].split(",")) - {""}


def test_opaque_strings_of_one_owner_are_reported_and_copied_ones_are_not(spark):
    live, copied = "x-zQ81mN5kVw2Tb7Ra9Lc4Xe6Yh0Pd", "y-aB93nM5lWx2Uc7Sb9Md4Yf6Zi0Qe"
    docs = spark.createDataFrame([(1, f"a {live} b", "o1/r")] + [(10 + i, f"a {copied} b", f"o{i}/r") for i in range(5)], "doc_id long, text string, source string")
    found = {r.doc_id: (r.spans, r.n_live) for r in secret_scan.scan(docs).collect()}
    assert found[1] == (f"opaque:2:{2 + len(live)}", 1)
    assert all(found[10 + i] == ("", 0) for i in range(5))


def test_verdicts_by_owners_and_repositories(spark):
    value = lambda k: f"zQ81mN5kVw2Tb7Ra9Lc4Xe6Yh0Pd{k}"
    sources = {"a": ["o1/r1", "o1/r2", "o2/r1"], "b": ["o1/r", "o2/r", "o3/r"], "c": [f"o1/r{i}" for i in range(21)], "d": [f"o1/r{i}" for i in range(20)], "e": [None] * 3, "f": [None, None], "g": ["o1", "o1", "o2"], "h": ["o1/r", None, None], "i": [None, "o1/r"]}
    docs = spark.createDataFrame([(k, f"token={value(k)} {value(k)}x", s) for k, some in sources.items() for s in some], "doc_id string, text string, source string")
    found = secret_scan.scan(docs).collect()
    live = {"a": True, "b": False, "c": False, "d": True, "e": False, "f": True, "g": True, "h": False, "i": True}
    assert {(r.doc_id, r.n_live, r.n_copied, "opaque" in r.spans) for r in found} == {(k, 2, 0, True) if x else (k, 0, 1, False) for k, x in live.items()}
    assert len(found) == sum(map(len, sources.values()))


def test_token_files(spark, docs, rows, tokenizer):
    found = token_files.digest(spark, docs, VOCABULARY)
    assert collected(found, "doc_id", "start", "n_tokens", "ids_crc32") == brute.op4(rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def test_strings_of_special_tokens_are_what_the_library_takes_them_for(spark, tokenizer):
    mark = "<|endoftext|>"
    texts = [mark, f"hello {mark} world", f"{mark}{mark}", f"a{mark}b", f"a {mark}", f" {mark}  {mark} x", f"{mark}\n\n {mark}\t", f"<|endof text|> {mark[:-1]} >", f"{mark}'s {mark} 's"]
    pick = random.Random(4)
    texts += ["".join(pick.choice([mark, " ", "  ", "\n", "a", "bc", "<|", "|>", "'s", "\u00a0", "\u4e2d", "1"]) for _ in range(pick.randint(1, 12))) for _ in range(3000)]
    rows = list(enumerate(texts))
    found = token_files.digest(spark, spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY)
    assert collected(found, "doc_id", "start", "n_tokens", "ids_crc32") == brute.op4(rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def test_token_files_have_the_encodings_and_indexes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_GROUP_BYTES", 200_000)
    monkeypatch.setattr(token_files, "PAGE_ROWS", 500)
    pick = random.Random(6)
    docs = spark.createDataFrame([(n, " ".join(str(pick.randrange(10**6)) for _ in range(40))) for n in range(6000)], "doc_id long, text string").coalesce(1)
    token_files.write(docs, f"file://{tmp_path}/tokens", VOCABULARY)
    footers = [pq.ParquetFile(f).metadata for f in sorted(tmp_path.glob("tokens/*.parquet"))]
    assert sum(m.num_rows for m in footers) == 6000 and max(m.num_row_groups for m in footers) > 1
    for m in footers:
        for g in range(m.num_row_groups):
            columns = {(c := m.row_group(g).column(k)).path_in_schema.split(".")[0]: c for k in range(m.num_columns)}
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings and not columns[c].has_dictionary_page for c in ("doc_id", "row", "n_tokens"))
            assert columns["ids"].has_dictionary_page and "RLE_DICTIONARY" in columns["ids"].encodings
            assert all(columns[c].has_column_index and columns[c].has_offset_index for c in ("doc_id", "row", "n_tokens", "ids"))
            assert all(c.compression == "ZSTD" for c in columns.values())
            assert columns["doc_id"].is_stats_set


def test_token_files_are_read_selectively(spark, docs, tmp_path, tokenizer, rows):
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs, path, VOCABULARY)
    some = token_files.read(spark, path, 10, 12)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan
    assert "ids" not in token_files.read(spark, path, ids=False)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    text = dict(rows)
    for r in some.collect():
        assert r.ids == [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2]


def test_quality(docs, rows):
    found = quality.statistics(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(found, *columns) == sorted(brute.op5(rows))
    assert all(not r.kept for r in found.where("base_failed").collect())
    assert found.where("kept").count() > 50
    assert collected(found, "doc_id", "kept") == sorted((d, brute.op5_kept(t)) for d, t in rows)


PROSE = "in this town there were many who had never seen the sea but some of them could tell long stories about its ships and men and the birds that follow them far out to where no land is seen for days on end while others only laughed at such tales".split()
JUNK = {
    "symbols": PROSE + ["##"] * 4,
    "repeated_lines": [" ".join(PROSE)] + ["\nred fish blue"[: 9 + k // 4] for k in range(12)],
    "word_length": PROSE + ["abcdefghijklmnopqrstuvwxyz" * 9 + str(k) for k in range(4)],
    "bullets": [f"\n - {a} {b}" for a, b in zip(PROSE, PROSE[9:] + PROSE[:9])],
    "ellipses": [f"\n{a} {b}..." if k % 2 else f"\n{a} {b} " for k, (a, b) in enumerate(zip(PROSE, PROSE[9:] + PROSE[:9]))],
    "letters": PROSE + [str(k * 7919) for k in range(30)],
    "long_word": PROSE + ["é" * 1001],
    "placeholder": PROSE + ["Lorem ipsum dolor"],
    "top_run": PROSE[:40] + ["one two three four"] * 2 + PROSE[40:] + ["one two three four"] * 2,
    "repeated_runs": PROSE + [f"v{k}" for k in range(12)] + PROSE[:20],
}


def test_each_rule_rejects_what_it_is_for_and_prose_stays(spark):
    texts = {"prose": " ".join(PROSE), **{k: " ".join(v) for k, v in JUNK.items()}}
    assert quality.verdict(quality.Document(texts["prose"]), quality.DEFAULT_RULES) is None
    by_rule = {r.name: r for r in quality.MORE_RULES}
    assert set(JUNK) == set(by_rule)
    for name, rule in by_rule.items():
        assert quality.verdict(quality.Document(texts[name]), quality.BASE_RULES) is None, name
        assert rule.rejects(quality.Document(texts[name])), name
    assert {k: brute.op5_kept(t) for k, t in texts.items()} == {k: k == "prose" for k in texts}
    rule = quality.stop_words({"en": ["the", "of", "and"], "de": ["der", "und"]})
    assert [rule.rejects(quality.Document(t)) for t in ("The and x", "the der", "x und y Der", "")] == [False, True, False, True]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts) + 2)), "text": [*texts.values(), None, ""]}))
    assert dict(con.execute(f"SELECT doc_id, kept FROM ({sql.OP5})").fetchall()) == {k: k == 0 for k in range(len(texts) + 2)}


def test_a_rejected_document_computes_nothing_for_later_rules(docs, rows):
    by_rule = {r.name: r for r in quality.MORE_RULES}
    d = quality.Document(" ".join(JUNK["symbols"]))
    assert quality.verdict(d, (by_rule["symbols"], by_rule["repeated_runs"], by_rule["letters"])) == "symbols"
    assert not {"repeated_run_chars", "n_letter_words", "lines"} & set(d.__dict__)
    asked = []
    costly = quality.Rule("costly", lambda d: asked.append(d.text) or False)
    texts = [t for _, t in rows]
    order = quality.ordered((costly, *quality.DEFAULT_RULES), [("costly", 1.0, 0.0), *((r.name, 1e-6, 0.1) for r in quality.DEFAULT_RULES)])
    kept = [t for t in texts if quality.verdict(quality.Document(t), order) is None]
    assert asked == kept and len(kept) < len(texts)


def test_the_cascade_is_ordered_on_a_sample_of_every_partition(docs):
    found = {name: (seconds, share) for name, seconds, share in quality.measure(docs, given=("n_words",))}
    assert set(found) == {r.name for r in quality.DEFAULT_RULES} and all(s >= 0 and 0 <= x <= 1 for s, x in found.values())
    assert found["few_words"][1] > 0 and found["few_words"][0] < found["repeated_runs"][0]
    assert quality.measure(docs.limit(0)) == []
    past = quality.measure(docs, quality.MORE_RULES, past=quality.BASE_RULES)
    assert {n for n, *_ in past} == {r.name for r in quality.MORE_RULES}


def test_cascade_verdict_does_not_depend_on_order(docs):
    one = collected(quality.cascade(docs), "doc_id", "kept")
    assert one == collected(quality.cascade(docs, tuple(reversed(quality.DEFAULT_RULES)), sample=3), "doc_id", "kept")
    assert [d for d, kept in one if kept] == sorted(r.doc_id for r in quality.keep(docs).collect())
    cheap, dear = quality.Rule("cheap", lambda d: True), quality.Rule("dear", lambda d: False)
    assert quality.ordered((dear, cheap), [("cheap", 1.0, 0.5), ("dear", 1.0, 0.1)]) == (cheap, dear)


def test_lines(docs, rows):
    found = line_dedup.digest(docs, line_dedup.keep_bitmaps(docs, 5))
    assert collected(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.op7(rows, 5))
    kept = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, 5), chars_col="n_chars")
    assert sorted((r.doc_id, brute.sha(r.text), r.n_chars - len(r.text)) for r in kept.collect()) == [(d, s, 0) for d, _, _, s in sorted(brute.op7(rows, 5))]


def test_first_lines_stay(docs, rows):
    seen, want = set(), []
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            key = line_dedup.line_key(line.encode())
            if not key or key not in seen:
                kept.append(line)
            seen.add(key)
        want.append((doc_id, brute.sha("\n".join(kept))))
    assert collected(line_dedup.digest(docs, line_dedup.keep_bitmaps(docs, keep="first")), "doc_id", "kept_sha256") == want


@pytest.mark.parametrize("window", [50, 12, 3])
def test_spans(docs, rows, window):
    found = span_dedup.remove(docs, window)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op8(rows, window))


def test_bpe(docs, rows, coder):
    found = bpe.digests(docs, RANKS, public_tokenizers.PATTERN)
    assert collected(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.op9(rows, coder))
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()} == {d: t.encode() for d, t in rows}


@pytest.mark.parametrize(("n", "share"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_join(docs, rows, n, share, monkeypatch):
    plain = brute.shingles
    monkeypatch.setattr(brute, "shingles", lambda t: plain(t, n))
    assert collected(ngram_join.classes(docs, n, share), "doc_id", "n_shingles", "component_id") == sorted(brute.op10(rows, share))


def test_ngram_join_in_many_blocks_and_by_joined_ids(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert collected(ngram_join.classes(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op10(rows))


def test_ngram_join_of_rows_cut_into_blocks_and_of_pieces_merged_in_rounds(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROW_CELLS", 20)
    monkeypatch.setattr(ngram_join, "PIECES", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 5000)
    met = ngram_join._met
    monkeypatch.setattr(ngram_join, "_met", lambda matrix, pieces: met(matrix, 9))
    monkeypatch.setattr(arrow, "SLICE_ROWS", 16)
    for n, share in ((3, 90), (2, 60)):
        plain = [(d, brute.shingles(t, n)) for d, t in rows]
        found = collected(ngram_join.classes(docs, n, share), "doc_id", "n_shingles", "component_id")
        assert [r[1] for r in found] == [len(s) for _, s in sorted(plain, key=lambda x: x[0])]
        with monkeypatch.context() as own:
            own.setattr(brute, "shingles", lambda t, of=dict(plain), texts={t: d for d, t in rows}: of[texts[t]])
            assert found == sorted(brute.op10(rows, share))


def test_one_of_each_group_stays(docs, rows):
    want = [d for d, _, c in sorted(brute.op10(rows)) if d == c]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == want
