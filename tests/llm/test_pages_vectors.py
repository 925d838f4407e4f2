"""Operators on pages and vectors against brute force, and their defined results on odd input."""

import collections
import math
import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm.htmltext import LEAST_IMPORTANCE, Page, extract, style_tree, unimportant, weigh
from cellarium.llm.neighbours import VantageTree, nearest
from cellarium.llm.urls import filter_urls

VOCABULARY = [f"term{i}" for i in range(200)]

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/x", "allow"), (None, "/", "block"), ("org", None, "block"), ("tie.io", "/", "allow"), ("tie.io", "/", "block"), ("com", "/", "allow")]
URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/1?x#y", "http://a.b.example.com/en/", "http://example.com/de/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/x?q", "http://xnet/fr/", "http://x.net", "http://x.com", "http://x.com/", "no scheme", "", None, "a://b://c/d", "http://tie.io/", "http://.../en/", "http://x.net/" + "es/" * 9000, "http://" + "a." * 3000 + "net/fr/", "http://x.net/fr/x", "http://x.net/fr/x"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v", "s") for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]], "page_id long, url string, host string, path string, rule string, verdict string, short string")
    rules = spark.createDataFrame([(*r, "x") for r in RULES], "host string, path string, verdict string, url string")
    got = collections.Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules).collect())
    assert got == collections.Counter((i, u, *brute_url(u)) for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])])
    assert {r.verdict for r in filter_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    assert filter_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a <b>b\n c</b></p><p>d&amp;amp;&nbsp;e", "a b c\n\nd&amp; e"),
        ("<article><h1>T</h1><p>x<br>y<p>z</article><footer>f</footer>", "T\n\nx y\n\nz"),
        ("<header>h</header><nav><ul><li>m</ul></nav><main><header><h1>T</h1></header><div>b</div></main><aside>s</aside>", "T\n\nb"),
        ("<body><div class='cookie-notice'>c</div><div>keep</div><div id=comments><p>no</p></div><form>f</form><div class=ad>a</div>", "keep"),
        ("<article>a<script>var x='</p>'</script>b<style>p{}</style><!-- c --></article>", "ab"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\n\ny\n\n1\n\n2"),
        ("<div hidden>h</div><p aria-hidden=true>i</p><p>k</p></div></span>", "k"),
        ("<p>unclosed <a href='x>", "unclosed"),
    ],
)
def test_page_text(html, text):
    assert (Page("h").read(html).text() if html else "") == text


def test_style_tree_cuts_what_recurs(spark):
    rnd = random.Random(1)
    notes = ["Buy two take three", "All rights kept", "Read this as well"]
    pages = []
    for i in range(60):
        body = "".join(f"<p>{' '.join(rnd.choices('abcdefghij', k=12))} {i}</p>" for _ in range(3))
        pages.append((i, "http://one.example/x", f"<html><body><div class='box{i}'>{notes[i % 3]}</div><div class=story>{body}</div></body></html>", "t", "h"))
    pages += [(100, "http://two.example/", "<div class='box1'>Buy two take three</div><div>own</div>", "t", "h"), (101, None, "<p>x</p>", "t", "h"), (102, "http://one.example/", None, "t", "h"), (103, "http://one.example/", "<p>" + "long " * 50000, "t", "h"), (103, "http://one.example/", "<p>r", "t", "h"), (103, "http://one.example/", "<p>r", "t", "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, host string").repartition(3)
    got = collections.defaultdict(list)
    for r in extract(df).collect():
        got[r.page_id].append(r.text)
    for i in range(60):
        assert got[i][0].count("\n\n") == 2 and not any(n in got[i][0] for n in notes)
    assert got[100] == ["Buy two take three\n\nown"] and got[101] == ["x"] and got[102] == [""]
    assert sorted(map(len, got[103])) == [1, 1, 249999]
    tree = style_tree(df).filter("pages >= 20").collect()
    assert min(r.importance for r in tree) < LEAST_IMPORTANCE < max(r.importance for r in tree)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("pages", [1_000, 1_000_000])
def test_unique_content_is_never_unimportant(spark, pages):
    page = spark.range(pages)
    own = page.selectExpr("7L AS node", "0 AS kind", "id AS value").union(page.selectExpr("7L", "1", "id % 20"))
    notice = page.selectExpr("8L", "0", "id % 3").union(page.selectExpr("8L", "1", "0L"))
    tree = weigh(own.union(notice).groupBy("node", "kind", "value").agg(F.count("*").alias("n")))
    assert [r.node for r in unimportant(tree).collect()] == [8]
    assert tree.filter("node = 7").collect()[0].content == 1


@pytest.mark.parametrize("around", ["div", "article"])
def test_regular_bodies_keep_their_text(spark, around):
    sizes = [3] * 540 + list(range(4, 64))
    pages = [(i, "http://one.example/x", f"<{around}><h1>T{i}</h1><div class=body>{''.join(f'<p>text {i} {k}</p>' for k in range(n))}</div></{around}>") for i, n in enumerate(sizes)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join([f"T{i}", *(f"text {i} {k}" for k in range(n))]) for i, n in enumerate(sizes)}


def test_the_tree_alone_cuts_nothing_in_an_article(spark):
    source = "<{0}><div class=note>Read this as well</div><p>{1}</p></{2}>"
    for around in ("article", "main", "div role=main"):
        pages = [(i, "http://one.example/x", source.format(around, i, around.split()[0])) for i in range(40)]
        got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert got == {i: f"Read this as well\n\n{i}" for i in range(40)}


@pytest.mark.parametrize("pages", [3, 6, 19])
def test_style_tree_of_a_small_host(spark, pages):
    rows = [(i, "http://one.example/x", f"<div class=box>same</div><div class=story>text {i * 7919}</div>") for i in range(pages)]
    rows += [(100 + i, "http://two.example/x", f"<div class=box>same</div><div class=story>text {i}</div>") for i in range(2)]
    rows += [(200 + i, "http://copies.example/x", "<div class=box>same</div><div class=story>copy</div>") for i in range(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(pages)] == [f"text {i * 7919}" for i in range(pages)]
    assert [got[100], got[101]] == ["text 0", "text 1"]
    assert {got[200 + i] for i in range(pages)} == {"same\n\ncopy"}


def test_text_outside_articles_is_judged_by_the_tree(spark):
    source = "<div class=box>same</div><div class=story>text {0}</div><article>teaser {0}</article>"
    pages = [(i, "http://one.example/x", source.format(i * 7919)) for i in range(40)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i * 7919}\n\nteaser {i * 7919}" for i in range(40)}


def test_style_tree_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("cellarium.llm.htmltext.BROADCAST_NODES", 0)
    pages = spark.createDataFrame([(i, "http://one.example/x", f"<div class=box>same</div><div class=story>text {i * 7919}</div>") for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in extract(pages).collect()} == {f"text {i * 7919}" for i in range(40)}


def brute_nearest(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 8]
    out = {}
    for q, v in good:
        if q in queries:
            scores = sorted((-round(float((v * u).sum() / (np.sqrt((v * v).sum()) * np.sqrt((u * u).sum()))), 12), i) for i, u in good if i != q)
            out[q] = list(dict.fromkeys(scores))[:k]
    return out


@pytest.mark.parametrize("factor", [1.0, 0.18])
def test_neighbours_against_brute_force(spark, monkeypatch, factor):
    monkeypatch.setattr("cellarium.llm.neighbours.PIVOT_VECTORS", 100)
    monkeypatch.setattr("cellarium.llm.neighbours.SHARD_VECTORS", 60)
    monkeypatch.setattr("cellarium.llm.neighbours.BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 8)).astype(np.float32))]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (None, [1.0] * 8), (2004, [1.0, 2.0]), (2005, []), (7, rows[7][1]), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    got = collections.defaultdict(list)
    for r in nearest(df, df.filter("vec_id % 20 = 0 OR vec_id >= 2000"), 5, factor).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
    want = brute_nearest(rows, {i for i, _ in rows if i is not None and (i % 20 == 0 or i >= 2000)}, 5)
    assert got.keys() == want.keys()
    if factor == 1.0:
        assert got == want
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    three = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], schema)
    assert [(r.rank, r.vec_id) for r in nearest(three, three.filter("vec_id = 0"), 5, 1.0).collect()] == [(1, 1), (2, 2)]


def test_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(700, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[100:200] = unit[5]
    sims, places, compared = VantageTree(unit).search(unit[:40], np.full(40, 2.0), 6, 1.0)
    full = np.round(unit[:40] @ unit.T, 12)
    want = np.lexsort((np.broadcast_to(np.arange(700), full.shape), -full), axis=-1)[:, :6]
    assert (places == want).all() and compared <= 40 * 700


def test_tree_prunes_what_lies_in_clusters():
    rng = np.random.default_rng(2)
    unit = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.05 * rng.normal(size=(4000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    _, places, compared = VantageTree(unit).search(unit[::50], np.full(80, 2.0), 6, 1.0)
    want = np.argsort(-np.round(unit[::50] @ unit.T, 12), axis=1, kind="stable")[:, :6]
    assert (places == want).all() and compared < 0.2 * 80 * 4000


def test_neighbours_of_doubles_and_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4 + i % 2) * 1e60).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest(df, df.filter("vec_id < 10"), 5, 1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(10):
        mine = [(i, np.array(v)) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        v = np.array(rows[q][1])
        assert got[q] == [i for i, u in sorted(mine, key=lambda x: -(v / np.linalg.norm(v)) @ (x[1] / np.linalg.norm(x[1])))[:5]]


def brute_extract(pages):
    """Texts by style trees alone, from well-formed pages: nodes are spelled out as tuples."""
    shown, seen = {}, collections.defaultdict(lambda: [collections.Counter(), collections.Counter()])
    for i, host, source in pages:
        blocks = []

        def walk(e, around, host=host, blocks=blocks):
            order = tuple(c.tag for c in e)
            mine = [*around, (e.tag, order)]
            if e.text:
                blocks.append((e.text, mine))
            for k, c in enumerate(e):
                walk(c, [*around, (e.tag, order, k)])

        walk(ElementTree.fromstring(source), [])
        shown[i] = blocks = [(t, [tuple((*x[:2], *(x[2:] if j < at else ())) for j, x in enumerate(way[: at + 1])) for at in range(2, len(way))]) for t, way in blocks]
        found = {(tree, node, 0, t) for t, nodes in blocks for node in nodes for tree in (host, None)} | {(tree, node, 1, node[-1][1]) for _, nodes in blocks for node in nodes for tree in (host, None)}
        for tree, node, kind, value in found:
            seen[tree, node][kind][value] += 1
    gone = set()
    for node, (texts, orders) in seen.items():
        m = sum(orders.values())
        style = content = 1.0
        if m > 1:
            style = -sum(n / m * math.log(n / m, m) for n in orders.values())
            content = 1 - sum(math.log(n, m) for n in texts.values()) / len(texts)
        damp = 0.9 ** len(orders)
        worth = max((1 - damp) * style + damp * content, content)
        if 1 - (1 - worth) * (1 - 1 / m) < LEAST_IMPORTANCE:
            gone.add(node)
    out = {}
    for i, host, _ in pages:
        left = [t for t, nodes in shown[i] if not any((tree, n) in gone for n in nodes for tree in (host, None))]
        out[i] = "\n\n".join(left or [t for t, _ in shown[i]])
    return out


def test_style_tree_equals_brute_force(spark):
    rnd = random.Random(4)
    pages = []
    for i in range(120):
        notes = f"<div>{rnd.choice('abcd')} note</div>" * (i % 5 != 0)
        menu = "<ul>" + "".join(f"<li>m{rnd.randrange(1 + i % 3)}</li>" for _ in range(3)) + "</ul>"
        body = "".join(f"<p>{rnd.random() if rnd.random() < 0.9 else 'often'}</p>" for _ in range(rnd.randint(1, 4)))
        pages.append((i, f"h{i % 4 if i < 110 else i}.example", f"<html><body>{menu}{notes}<div><div>{body}</div><dl>end {i % 7}</dl></div></body></html>"))
    df = spark.createDataFrame([(i, f"http://{h}/x", s) for i, h, s in pages], "page_id long, url string, html string")
    want = brute_extract(pages)
    assert {r.page_id: r.text for r in extract(df, by_kind=False).collect()} == want
    assert not any("note" in t or "m0" in t for t in want.values()) and all("0." in t or "often" in t for t in want.values())


def test_extract_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, None, "<p>x</p>", 2, "k", "t")], "page_id long, url string, html string, _host long, _cut string, TEXT2 string")
    assert extract(df).collect()[0].asDict() == {"page_id": 1, "url": None, "html": "<p>x</p>", "_host": 2, "_cut": "k", "TEXT2": "t", "text": "x"}


def test_very_deep_pages(spark):
    source = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>flat</p>" * 3
    df = spark.createDataFrame([(i, "http://a.example/", source + f"<p>{i}</p>") for i in range(3)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: str(i) for i in range(3)}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>one</p><style-guide>x</style-guide><p>two</p>", "one\n\nx\n\ntwo"),
        ("<p>one</p><title-bar>x</title-bar><template-x>y</template-x><script-x>z</script-x><p>two</p>", "one\n\nxyz\n\ntwo"),
        ("<p>one</p><style>p{}</style ><script\n>var a='</p>';</script/><p>two</p>", "one\n\ntwo"),
        ("<script>never closed <p>x</p>", ""),
        ("<p title=it's>Hello</p><p>don't</p>", "Hello\n\ndon't"),
        ("<p title='it's'>Hello</p><a href=/a/b/>link</a><p>x</p>", "Hello\n\nlink\n\nx"),
        ('<p title="never closed>Hello</p><p>two</p>', "Hello\n\ntwo"),
        ('<p title="x>Hello</p><p class="a">two</p>', "two"),
        ("<p a = 'x>y' b=\"<i>\" c>Hello</p><p", "Hello"),
        ("<!-->a<!--->b<!-- c -- > d --!>e<!-- f", "abe"),
        ("<div data-class=nav>kept</div><div class=nav>gone</div><p =x>y</p>", "kept\n\ny"),
        ("<div/>a<p>b", "a\n\nb"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<article><div class=related-work>a</div><div class=share-holders>b</div><p class=ad-hoc>c</p><li class=menu-item>d</li><div class='share'>e</div><div class=comment-list>f</div><nav>g</nav></article>", "a\n\nb\n\nc\n\nd"),
        ("<div class=related-work>a</div><p>b</p>", "b"),
    ],
)
def test_tags_are_read_as_html_says(source, text):
    assert Page("h").read(source).text() == text


def test_class_words_in_articles_need_the_tree(spark):
    """In an article a branch of a suspicious class goes where it recurs, and stays where it doesn't."""
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(n))
    pages, want = [], {}
    for i in range(60):
        body, own = say(30), say(12)
        pages.append((i, f"http://h{i % 2}.example/", f"<article><p>{body}</p><div class=related-stories><p>Read our other stories too</p></div><div class=related-work><p>{own}</p></div></article>"))
        want[i] = f"{body}\n\n{own}"
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == want


def test_deep_pages_are_judged_as_wholes(spark):
    """A branch below the fortieth level is a branch like any other."""
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(n))
    pages = [(i, "http://a.example/", "<div>" * 45 + f"<section><ul><li>home</li><li>all news</li></ul></section><div class=story>{(body := say(20))}</div>" + "</div>" * 45, body) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, body string")
    assert all(r.text == r.body for r in extract(df, by_kind=False).collect())
