"""The pipeline against a plain version of all its stages."""

import re

import public_tokenizers

import corpus_pipeline
from linkloom.llm import bpe
from tests.llm import brute, fixtures

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")


def plain_lines(rows, least):
    key = lambda x: brute.ascii_lower(x.strip(brute.SPACE))
    where = {}
    for d, t in rows:
        for line in t.split("\n"):
            where.setdefault(key(line), set()).add(d)
    return [(d, "\n".join(x for x in t.split("\n") if not key(x) or len(where[key(x)]) < least)) for d, t in rows]


def plain_score(item, text):
    a, b = (PUNCTUATION.sub(" ", x.lower()).split() for x in (item, text))
    above, best = [0] * (len(b) + 1), 0
    for w in a:
        here = [0]
        for j, v in enumerate(b):
            here.append(max(0, above[j] + (2 if v == w else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, max(here)), here
    return best / (2 * len(a))


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "LINE_MIN_DOCS", 5)
    rows = fixtures.documents(150, seed=11)
    long = [t for _, t, *_ in rows if len(t.split()) > 120]
    items = [" ".join(long[0].split()[10:40]), " ".join("changed" if k % 9 == 4 else w for k, w in enumerate(long[3].split()[20:60])), "words that no document has at all but that make an item"]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [(d, t) for d, t, *_ in rows if brute.op5_kept(t)]
    kept = plain_lines(kept, 5)
    plain = brute.shingles
    monkeypatch.setattr(brute, "shingles", lambda t: plain(t, 5))
    lead = {d for d, _, c in brute.op10(kept, 80) if d == c}
    assert 0 < len(lead) < len(kept) < len(rows)
    kept = [(d, t) for d, t in kept if d in lead]
    clean = {d: t for d, t in kept if all(plain_score(i, t) < 0.5 for i in items)}
    assert 0 < len(clean) < len(kept)

    found = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(found, RANKS).collect()} == clean
    assert all(r.n_tokens == len(r.ids) for r in found.collect())
