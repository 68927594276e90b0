import random

import pytest

from linkloom.llm import automata


def test_matching_statistics_are_those_of_all_substrings():
    pick = random.Random(4)
    for _ in range(150):
        passages = [[pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randint(0, 12))] for _ in range(pick.randint(1, 4))]
        own = automata.SuffixAutomaton()
        for p in passages:
            own.add(p)
        subs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        text = [pick.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        want = [max(k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in subs) for i in range(len(text))]
        assert own.matches(text).tolist() == want


@pytest.mark.parametrize("shard", [20, 10_000])
def test_reference_spans_go(spark, docs, rows, shard):
    reference = [t for d, t in rows if d % 6 == 3 and d < 60] + [None, ""]
    window, seen = 12, set()
    for t in reference:
        w = (t or "").encode().split()
        seen |= {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
    want = {}
    for d, t in rows:
        w = t.encode().split()
        gone = {k for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in seen for k in range(i, i + window)}
        want[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    found = automata.remove_reference(docs, spark.createDataFrame([(t,) for t in reference], "text string"), window, shard_words=shard)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()} == want
    assert automata.remove_reference(docs.limit(0), spark.createDataFrame([], "text string")).count() == 0
