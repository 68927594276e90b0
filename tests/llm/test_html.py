"""Main text against a walk of the tree that each page is written from."""

import random
import time

import pytest

from linkloom.llm import html_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa it's a&b x<y été 中文".split()
OPEN = {"p": "<p>%s</p>", "quote": "<blockquote>%s</blockquote>", "div": "<div class=part>%s</div>", "list": "<ul><li>%s</li></ul>", "cell": "<table><tr><td>%s</td></tr></table>", "section": "<section class='related work'>%s</section>", "head": "<h2 title=it's>%s</h2>"}
JUNK = ["<div class=ad>buy %s</div>", "<aside>%s</aside>", "<form><input><label>%s</label></form>", "<script>var t='<p>%s';</script>", "<!-- %s -->", "<section class=comments><p>%s</p></section>", "<div class='related'><a href=/x>%s</a></div>", "<style>%s</style>", "<div id=cookie-notice>%s</div>", "<div hidden>%s</div>"]


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;")


def inline(pick):
    """Markup and text of a run without blocks."""
    words = [pick.choice(WORDS) for _ in range(pick.randint(3, 12))]
    marked = [f"<{t}>{escaped(w)}</{t}>" if (t := pick.choice(["", "", "", "b", "i", "em"])) else escaped(w) for w in words]
    return pick.choice([" ", "\n  ", " \t"]).join(marked), " ".join(words)


def tree(pick, depth):
    """Markup of some blocks, nested at random, and the texts of its blocks in page order."""
    html, texts = [], []
    for _ in range(pick.randint(1, 4)):
        if depth and pick.random() < 0.5:
            kind = pick.choice(["div", "quote", "list", "cell", "section"])
            inner, own = tree(pick, depth - 1)
        else:
            kind = pick.choice(list(OPEN))
            inner, own = inline(pick)
            own = [own]
        html.append(OPEN[kind] % inner)
        texts += own
        if pick.random() < 0.3:
            html.append(pick.choice(JUNK) % " ".join(pick.choice(WORDS[:10]) for _ in range(9)))
    return "".join(html), texts


@pytest.mark.parametrize("templates", [1, 12])
def test_articles_of_hosts_with_several_templates(spark, templates):
    pick, pages, want = random.Random(templates), [], {}
    for n in range(60):
        host, k = n % 2, pick.randrange(templates)
        html, texts = tree(pick, 4)
        more, others = tree(pick, 3)
        wrap = ["<div class='post t%s'>%%s</div>", "<article class=%s>%%s</article>", "<main id=%s>%%s</main>", "<section class='story s-%s'>%%s</section>"][k % 4] % "abcdefghijkl"[k]
        page = f"<html><body><nav><a href=/>home</a></nav><div class='sidebar'>at the side</div><div class=page-{'abcdefghijkl'[k]}>{wrap % (html + more)}</div><footer>the foot</footer></body></html>"
        pages.append((n, f"https://h{host}.example/{n}", page))
        want[n] = " ".join(texts + others)
    found = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def test_the_hosts_votes_settle_what_a_page_leaves_open(spark):
    page = "<body><div class=lead-%d><p>%s</p></div><div class=column><p>%s</p></div></body>"
    pages = [(n, "https://a.example/x", page % (n, "the article " * 30, "aside " * 8)) for n in range(6)]
    pages += [(6, "https://a.example/y", page % (6, "a short one " * 5, "aside " * 8)), (7, "https://b.example/", page % (7, "a short one " * 5, "aside " * 8))]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[0] == ("the article " * 30).strip() and found[6] == ("a short one " * 5).strip()
    assert found[7] == ("a short one " * 5 + "aside " * 8).strip()  # nothing tells which of the two is the article


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p title=it's>Hello this text</p><p>don't lose me</p></article>", "Hello this text don't lose me"),
        ("<div class=content><p>First</p><blockquote>Quoted</blockquote><p>Third</p></div>", "First Quoted Third"),
        ('<article><p>Alpha.</p><section class="related work"><p>Ours differs.</p></section><div class="search-results-discussion">They agree.</div></article>', "Alpha. Ours differs. They agree."),
        ('<article><p>Alpha.</p><div class="related"><a href="/a">Another article</a></div></article>', "Alpha."),
        ('<article><p title="a>b" data-x=\'"\'>Quoted signs.</p></article>', "Quoted signs."),
        ('<article><p title="open>Not closed.</p></article>', "Not closed."),
        ("<article><p>a < b and c<d> e</p><!--> <p>after a comment</p></article>", "a < b and c e after a comment"),
        ("<article><p>kept</p><a href='never closed", "kept"),
    ],
)
def test_markup_as_it_is_found(html, want):
    assert html_text.main_text(html_text.blocks(html), []) == want


@pytest.mark.parametrize("unit", ['<a "', "<div>", "<p><span>", "<h1>", "<!", "<script ", "<td>", '<p title="a', "</x>", "<li>x<ul>", "&", "<div class='"])
def test_time_is_in_proportion_to_the_page(unit):
    began = time.process_time()
    html_text.main_text(html_text.blocks(unit * (1_000_000 // len(unit))), [])
    assert time.process_time() - began < 8


def test_paths_stay_short_and_apart():
    containers = html_text.blocks("".join(f"<div class=c{chr(97 + n % 7)}{'x' * n}>" for n in range(200)) + "text").containers
    assert len({c.path for c in containers}) == len(containers)
    assert max(len(c.path) for c in containers) <= html_text.PATH_CHARS + html_text.NAME_CHARS + 20
