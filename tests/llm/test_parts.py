"""Parts of the operators, and those without a contract."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from linkloom.llm import bpe, decontaminate, html_text, runs, segments, token_counts
from linkloom.llm.components import components

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["\n", " ", "  ", "\t", "a", "aa", "aaa", "é", "1", "'s", ".", "\x1c", "\x85", " word", "\r\n", "\x0b", "ſ", "中", "😀", "aaaaaaa", "==", "ing", "́"]


def test_segments_join_to_the_text_and_encode_alone():
    pick = random.Random(3)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=segments.ranks(MULTI), special_tokens={})
    texts = ["".join(pick.choice(ODD) for _ in range(pick.randint(0, 14))) for _ in range(4000)]
    own = bpe.Codec(bpe.MergeTable(segments.ranks(MULTI)), public_tokenizers.PATTERN, limit=500)
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        assert ["".join(segments.segments(t)) for t in part] == part
        ids, bounds = own.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [coder.encode_ordinary(t) for t in part]


def test_replay_follows_each_pieces_own_order_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 280, b"cd": 310, b"bc": 320}
    table = bpe.MergeTable(ranks)
    pieces = [b"abcd", b"ababc", b"bcd", b"", b"aaaa"]
    ids, counts = bpe.replay(pieces, table)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [table.one(p) for p in pieces]


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("at_least", [2, 4])
def test_runs_over_partition_edges(spark, partitions, at_least):
    pick = random.Random(partitions)
    rows = [(pick.randrange(6) if pick.random() < 0.5 else pick.randrange(400), pick.randrange(30)) for _ in range(600)] + [(7, i) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, v long").repartition(4)
        items, least = {}, {}
        for k, v in rows:
            items.setdefault(k, set()).add(v)
            least[k] = min(least.get(k, v), v)
        got = lambda d, *c: sorted(tuple(r[x] for x in c) for r in d.collect())
        assert got(runs.scan(df, ["k"], "v", at_least=at_least), "k", "v") == sorted((k, v) for k, v in rows if len(items[k]) >= at_least)
        assert got(runs.scan(df, ["k"], "v", later=True), "k", "v") == sorted((k, v) for k, v in rows if v != least[k])
        assert got(runs.scan(df, ["k"], "v", flag=True), "k", "v", "_later") == sorted((k, v, v != least[k]) for k, v in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components(spark):
    pick = random.Random(5)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(600, i) for i in range(601, 700)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_alignment_against_the_plain_recurrence():
    pick = random.Random(1)
    for _ in range(60):
        a, b = (np.array([pick.randrange(4) for _ in range(pick.randint(1, 15))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                same = decontaminate.MATCH if a[i] == b[j] else decontaminate.MISMATCH
                h[i + 1, j + 1] = max(0, h[i, j] + same, h[i, j + 1] + decontaminate.GAP, h[i + 1, j] + decontaminate.GAP)
        assert decontaminate.align(a, b)[0] == h.max()


def test_leaks_are_found_edited_or_not_and_clean_documents_are_left(spark):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [pick.choice(words) for _ in range(n)]
    items = [text(30) for _ in range(20)]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    edited = [w if k % 7 else "changed" for k, w in enumerate(items[3])]
    rows = [(0, " ".join(text(50) + items[0] + text(50))), (1, " ".join(text(20) + edited + text(20))), (2, " ".join(items[5][:22]).upper() + "!")] + [(10 + i, " ".join(text(200))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 0), (1, 3), (2, 5)]
    exact = next(r for r in found if r.doc_id == 0)
    assert (exact.score, exact.first_word, exact.end_word, exact.passage) == (1.0, 50, 80, " ".join(items[0]))
    assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark).collect()) == list(range(10, 70))
    passes = decontaminate.leaks(docs, benchmark, pass_words=100)
    assert sorted((r.doc_id, r.item_id) for r in passes.collect()) == [(0, 0), (1, 3), (2, 5)]


def plain_points(item, text):
    """The best local alignment, by the plain recurrence over the whole document."""
    above, best = [0] * (len(text) + 1), 0
    for w in item:
        here = [0]
        for j, v in enumerate(text):
            here.append(max(0, above[j] + (2 if v == w else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, max(here)), here
    return best


def test_leaks_against_all_alignments_of_all_documents_and_items(spark):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [pick.choice(words) for _ in range(n)]

    def edited(item, rate):
        out = []
        for w in item:
            out += {0: [], 1: [pick.choice(words)], 2: [w, pick.choice(words)]}.get(pick.randrange(3) if pick.random() < rate else 9, [w])
        return out

    items = [(i, text(pick.choice([1, 2, 3, 8, 15, 40, 90]))) for i in range(24)] + [(None, text(12)), (5, text(20))]
    items.append(items[3])  # the same row twice
    docs = []
    for d in range(140):
        item = pick.choice(items)[1]
        part = item[len(item) // 3 :][: pick.randint(1, 60)] if pick.random() < 0.3 else item
        docs.append((None if d % 50 == 7 else d, text(pick.randint(0, 40)) + edited(part, pick.choice([0, 0.1, 0.2, 0.4])) + text(pick.randint(0, 40))))
    docs += [docs[0], (200, []), (201, None)]
    benchmark = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in items] + [(77, None), (78, " ,. ")], "item_id long, text string")
    frame = spark.createDataFrame([(d, None if t is None else ", ".join(t)) for d, t in docs], "doc_id long, text string")
    found = decontaminate.leaks(frame, benchmark).collect()
    known = {(i, tuple(t)) for i, t in items}
    trigrams = lambda t: set(zip(*(t[k:] for k in range(3))))
    want, unseeded = [], 0
    for d, t in docs:
        for i, item in known:
            points = plain_points(item, t or [])
            if points >= len(item) or points >= 50:
                if len(item) < 3 or trigrams(item) & trigrams(t):
                    want.append((d is None, d or 0, i is None, i or 0, round(points / (2 * len(item)), 9)))
                else:
                    unseeded += 1
    assert 10 * unseeded < len(want)  # no three words in a row are left of these
    got = [(r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0, round(r.score, 9)) for r in found]
    exact = [x for x in want if x[4] == 1.0]
    assert sorted(x for x in got if x[4] == 1.0) == sorted(exact)
    long = {i for i, t in known if len(t) >= 3}
    assert sorted(x for x in got if (None if x[2] else x[3]) in long) == sorted(x for x in want if (None if x[2] else x[3]) in long)
    for r in found:
        assert r.end_word - r.first_word == len(r.passage.split())
        assert any(round(plain_points(t, r.passage.split()) / (2 * len(t)), 9) == round(r.score, 9) for i, t in known if i == r.item_id)
    leaking = {(d, " ".join(t)) for d, t in docs if t and any(plain_points(i, t) >= min(len(i), 50) and trigrams(i) & trigrams(t) for _, i in known if len(i) >= 3)}
    kept = decontaminate.clean(frame, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted((d is None, d or 0, ", ".join(t or [])) for d, t in docs if (d, " ".join(t or [])) not in leaking)
    few = decontaminate.clean(frame, benchmark, pass_words=60).count()
    assert few == len(kept)


RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_allocation(coder, text, sections, rule):
    """Tokens of each ``(start, end)`` in code points, none of which overlap, and those that reach out of it; byte by byte."""
    byte = [0]
    for c in text:
        byte.append(byte[-1] + len(c.encode()))
    owner = [None] * byte[-1]
    for k, (a, b) in enumerate(sections):
        owner[byte[a] : byte[b]] = [k] * (byte[b] - byte[a])
    # what lies between sections is a section of its own here
    gap = 0
    for i, o in enumerate(owner):
        if o is None:
            owner[i] = -1 - gap
        elif i + 1 < len(owner) and owner[i + 1] is None:
            gap += 1
    counts, crossing, at = {}, {}, 0
    for n in coder.encode_ordinary(text):
        end = at + len(coder.decode_single_token_bytes(n))
        own = owner[at:end]
        k = own[0] if rule == "first" else own[-1] if rule == "last" else max(dict.fromkeys(own), key=own.count)
        k2 = max(k, -1)
        counts[k2] = counts.get(k2, 0) + 1
        crossing[k2] = crossing.get(k2, 0) + (len(set(own)) > 1)
        at = end
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_lines(spark, docs, rows, rule):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=segments.ranks(RANKS_50K), special_tokens={})
    more = [(1000, "a\n\n\n\nb  \n \n中\n\n\n"), (1001, "\n"), (1002, ""), (1002, ""), (None, "x\n\n\ny"), (1003, None), (1003, "\n\n  \n\n")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for doc_id, text in rows + more:
        cuts = (text or "").split("\n")
        spans = [x + "\n" for x in cuts[:-1]] + ([cuts[-1]] if cuts[-1] or len(cuts) == 1 else [])
        ends = np.cumsum([len(x) for x in spans]).tolist()
        counts, crossing = plain_allocation(coder, text or "", list(zip([0, *ends[:-1]], ends)), rule)
        want += [(doc_id or -1, k, b - len(x), len(x), counts.get(k, 0), crossing.get(k, 0)) for k, (x, b) in enumerate(zip(spans, ends))]
    found = token_counts.by_section(df, RANKS_50K, public_tokenizers.PATTERN, rule).collect()
    assert sorted((r.doc_id or -1, *r[1:]) for r in found) == sorted(want)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_given_sections_and_fields(spark, rule):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=segments.ranks(RANKS_50K), special_tokens={})
    pick = random.Random(9)
    texts = ["".join(pick.choice([*ODD, "longerword", "  ", "the"]) for _ in range(pick.randint(0, 40))) for _ in range(200)]
    spans, want = [], []
    for d, text in enumerate(texts):
        ends = sorted(pick.sample(range(len(text) + 1), min(len(text) + 1, 2 * pick.randint(0, 4)) // 2 * 2))
        own = list(zip(ends[::2], ends[1::2]))
        spans += [(d, f"s{k}", a, b) for k, (a, b) in enumerate(own)]
        counts, crossing = plain_allocation(coder, text, own, rule)
        want += [(d, f"s{k}", a, b - a, counts.get(k, 0), crossing.get(k, 0)) for k, (a, b) in enumerate(own)]
        outside = len(text) - sum(b - a for a, b in own)
        if outside or not text:
            want.append((d, "", None, outside, counts.get(-1, 0), crossing.get(-1, 0)))
    spans += [(None, "x", 0, 1), (9999, "x", 0, 1), (3, "x", None, 1)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in enumerate(texts)], "doc_id long, text string, given string")
    sections = spark.createDataFrame(spans, "doc_id long, section string, start_char long, end_char long")
    found = token_counts.by_given_sections(docs, sections, RANKS_50K, public_tokenizers.PATTERN, rule).collect()
    assert sorted((r.doc_id, r.section or "", r.start_char if r.section else -1, *r[3:]) for r in found) == sorted((d, s, -1 if a is None else a, *x) for d, s, a, *x in want)
    assert token_counts.tiles([(0, 5), (3, 9), (3, 4), (20, 30)], 12) == ([0, 3, 4, 12], [0, 2, -1])
    fields = token_counts.by_field(spark.createDataFrame([(1, "a title", "the body of it"), (2, None, ""), (None, "x", None)], "doc_id long, title string, body string"), ["title", "body"], RANKS_50K, public_tokenizers.PATTERN, rule)
    assert sorted((r.doc_id or 0, r.section, r.start_char, r.n_chars, r.n_tokens) for r in fields.collect()) == [(0, "body", 2, 0, 0), (0, "title", 0, 2, 2), (1, "body", 8, 14, 4), (1, "title", 0, 8, 3), (2, "body", 1, 0, 0), (2, "title", 0, 1, 1)]
    assert token_counts.by_given_sections(docs.limit(0), sections, RANKS_50K, public_tokenizers.PATTERN).count() == 0


def test_allocation_rules():
    starts, ends, cuts = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert [token_counts.allocate(starts, ends, cuts, r)[0].tolist() for r in token_counts.RULES] == [[0, 0, 1], [0, 1, 1], [0, 1, 1]]
    assert token_counts.allocate(starts, ends, cuts)[1].tolist() == [False, True, False]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="x">
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="wrap-{n}"><div class="sidebar"><p>side {filler}</p></div><div class="post post-{n}"><h1>Title &amp; more</h1><p>First <b>bold</b>ly
 written <i>text</i>.<br>{filler}<p>Second &eacute;&#33; {filler}</p><ul><li>one<li>two</ul>
<form><input><label>mail</label></form><div class="ad">buy</div><section class="comments"><p>reader says {filler}</p></section></div></div><footer>&copy; us</footer></body></html>"""


def test_pages_by_the_hosts_path(spark):
    filler = "several words that make a long paragraph of an article"
    pages = [(n, f"https://a.example/{n}", PAGE.format(n=n, filler=filler)) for n in range(6)]
    pages += [(10, "https://b.example/", "<article><h1>T</h1><p>alpha</p><aside>no</aside><p>beta</article>"), (11, None, None), (12, "x", ""), (13, "https://c.example/", "<nav>only a menu</nav>"), (13, "https://c.example/", "<nav>only a menu</nav>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = f"Title & more First boldly written text. {filler} Second é! {filler} one two"
    for limit in (html_text.BROADCAST_HOSTS, 0):
        found = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df, broadcast_hosts=limit).collect())
        assert found == [*((n, want, len(want)) for n in range(6)), (10, "T alpha beta", 12), (11, "", 0), (12, "", 0), (13, "", 0), (13, "", 0)]


def texts_of(spark, *pages):
    df = spark.createDataFrame([(n, "https://one.example/", html) for n, html in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(df).orderBy("page_id").collect()]


def test_an_article_is_its_whole_subtree(spark):
    post = "<body><div class=post><p>Alpha one.</p><blockquote>Beta two three.</blockquote><div class=more><p>Gamma four five six.</p></div><table><tr><td>Delta seven eight nine ten.</td></tr></table></div></body>"
    halves = "<body><div class=story><div class=upper>Upper half of it.</div><div class=lower>Lower half, a little longer.</div></div><div class=other>x</div></body>"
    assert texts_of(spark, post) == ["Alpha one. Beta two three. Gamma four five six. Delta seven eight nine ten."]
    assert texts_of(spark, "<main><h1>Title</h1><article>The text of it.</article></main>") == ["Title The text of it."]
    assert texts_of(spark, halves) == ["Upper half of it. Lower half, a little longer."]


def test_a_page_keeps_its_own_article(spark):
    usual = "<body><div class=post>%s</div></body>" % ("usual text of this host " * 4)
    other = "<body><div class=post>brief</div><div class=special>%s</div></body>" % ("another article " * 20)
    linked = '<body><div class=post><a href="/a">only links here</a></div></body>'
    found = texts_of(spark, usual, usual, other, linked)
    assert found[0] == found[1] == ("usual text of this host " * 4).strip()
    assert found[2:] == [("another article " * 20).strip(), "only links here"]


def test_the_subtree_holds_below_any_depth(spark):
    deep = "<div class=post>Start here, a long first paragraph." + "<div>" * 30 + "Deep inside." + "</div>" * 30 + "</div>"
    assert texts_of(spark, deep) == ["Start here, a long first paragraph. Deep inside."]


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="layout has-sidebar">', '<div id="content" class="no-sidebar">', '<div class="post comments-open">', '<div class="search-layout">', '<div id="social" class="menu-page"><div class="alert">', '<div class="header">'],
)
def test_names_of_a_wrapper_do_not_drop_the_article(wrapper):
    rest = '<div class="sidebar">At the side.</div><section class="comments"><article>A reader says far more than the article does.</article></section>'
    for inner, want in (("<article>The article.</article>" + rest, "The article."), ("<p>" + "A long text without the element. " * 9 + '</p><div class="sidebar">At the side.</div>', ("A long text without the element. " * 9).strip())):
        assert html_text.main_text(html_text.blocks(f"<body><nav>menu</nav>{wrapper}{inner}</body>"), []) == want


def test_what_is_not_the_article_is_still_dropped():
    page = '<body><article>Short.</article><div class="comments">Readers write far more than the article has.</div><div id="cookie-notice">We use cookies</div><div class="site-footnav">x</div></body>'
    assert [text for _, text, _ in html_text.blocks(page).blocks] == ["Short."]
    assert [text for _, text, _ in html_text.blocks('<p>One wo<span class="share">tell</span>rd.').blocks] == ["One word."]


def test_hashed_segments_keep_their_own_ids():
    def encode(parts):
        raw = [p.encode() for p in parts]
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.array([len(x) for x in raw], np.int64)

    own = segments.HashedEncoder(encode, limit=40)
    rng = random.Random(7)
    for _ in range(30):
        texts = ["".join(rng.choice(["a", "\0", "b", " ", "é", "\n"]) for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 17, 300]))) for _ in range(20)]
        texts += ["a" * n + "\0" * k for n in (1, 7, 8, 2047, 2048, 2049) for k in (0, 1, 8)]
        ids, bounds = own.encode(texts)
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(bounds[:-1], bounds[1:])] == texts
