"""Wrapper induction: the matcher against brute force, hosts without telling markup, odd pages."""

import random
import time
from functools import lru_cache

import pytest

from cohortlab.llm import html_extract as h
from cohortlab.llm.html_extract import Matcher, Node, Tree, aligned, judged_blocks, main_texts, parse, reshape, tree_of, tree_text

WORDS = "river stone cloud window market letter garden winter summer bridge".split()


def pages(spark, rows):
    full = [(i, u, t, "x", 7) for i, u, t in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, _host string, _constant int")


def draw(rng, depth):
    node = Node(rng.choice("ab"))
    node.kids = [draw(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)]
    return node


def brute(a, b):
    """The largest match over all order-preserving pairings of kids."""

    @lru_cache(None)
    def size(x, y):
        if x.tag != y.tag:
            return 0

        @lru_cache(None)
        def lists(i, j):
            if i == len(x.kids) or j == len(y.kids):
                return 0
            return max(lists(i + 1, j), lists(i, j + 1), size(x.kids[i], y.kids[j]) + lists(i + 1, j + 1))

        return 1 + lists(0, 0)

    return size(a, b)


def shaped(a, b):
    for node in (a, b):
        stack, order = [node], []
        while stack:
            n = stack.pop()
            order.append(n)
            stack += n.kids
        for n in reversed(order):
            n.size = 1 + sum(k.size for k in n.kids)
    shapes = {}
    reshape(a, shapes)
    reshape(b, shapes)


def test_matcher_equals_brute_force_on_random_trees():
    rng = random.Random(9)
    for _ in range(400):
        a, b = draw(rng, 4), draw(rng, 4)
        a.tag = b.tag = "a"
        shaped(a, b)
        total, kids = Matcher().pairs(a, b)
        assert total == brute(a, b)
        assert all(x < y and p < q for (x, p), (y, q) in zip(kids, kids[1:]))
        assert all(a.kids[x].tag == b.kids[p].tag for x, p in kids)
        assert len(aligned(a, b)) == total


def test_tree_text_round_trip():
    rng = random.Random(4)
    for _ in range(100):
        a = draw(rng, 5)
        assert tree_text(tree_of(tree_text(a))) == tree_text(a)
    assert tree_of("").kids == []


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + str(rng.random())


def plain_host(n=12, seed=1):
    """Pages with neither article nor telling names: banner, links, body, legal lines."""
    rng, out = random.Random(seed), []
    for i in range(n):
        body = [sentence(rng) for _ in range(3 + i % 3)]
        html = (
            "<html><body><div class='r1'><div>Welcome to the paper of the town</div><ul><li>Home</li><li>Archive</li></ul></div>"
            f"<div class='r2'><h1>{sentence(rng, 4)}</h1>{''.join(f'<p>{b}</p>' for b in body)}<p>Read our rules before you write to us.</p></div>"
            "<div class='r3'><p>All texts by the paper.</p><p>Set in Garamond.</p></div></body></html>"
        )
        out.append((i, f"http://plain.example/{i}", html, body))
    return out


TEMPLATE = ("Welcome", "Home", "Archive", "All texts", "Garamond")


def test_a_host_without_telling_markup(spark):
    rows = plain_host()
    table = pages(spark, [r[:3] for r in rows])
    on = {r.page_id: r for r in main_texts(table).collect()}
    off = {r.page_id: r for r in main_texts(table, support=10**9).collect()}
    for i, _, html, body in rows:
        title = html.split("<h1>")[1].split("</h1>")[0]
        text = on[i].text
        assert text.split("\n\n")[: 1 + len(body)] == [title, *body]
        assert not any(t in text for t in TEMPLATE)
        assert all(t in off[i].text for t in TEMPLATE)  # alignment, and nothing else, takes them out
        assert on[i].n_template >= 5 and off[i].n_template == 0
        assert on[i].n_chars == len(text)
    rules = {r.rule: r["count"] for r in judged_blocks(table).selectExpr("inline(blocks)").groupBy("rule").count().collect()}
    assert set(rules) == {"template", "content"}


def test_constant_slots_inside_an_article_go(spark):
    rng = random.Random(2)
    rows = []
    for i in range(9):
        html = f"<article><h1>{sentence(rng, 3)}</h1><p>{sentence(rng, 30)}</p><p>Sign up for our letter today.</p></article><footer>(c)</footer>"
        rows.append((i, "//in.example/a", html))
    got = main_texts(pages(spark, rows)).collect()
    assert all("Sign up" not in r.text and len(r.text.split("\n\n")) == 2 for r in got)


def test_copies_are_no_template(spark):
    """A host of which most pages are the same article: it stays."""
    rng = random.Random(3)
    same = sentence(rng, 60)
    rows = [(i, "//copy.example/", f"<article><h1>One title</h1><p>{same}</p></article><p>{sentence(rng)}</p>") for i in range(8)]
    rows += [(20 + i, "//copy.example/", f"<article><h1>{sentence(rng, 3)}</h1><p>{sentence(rng, 30)}</p></article>") for i in range(2)]
    got = {r.page_id: r.text for r in main_texts(pages(spark, rows)).collect()}
    assert all(got[i] == f"One title\n\n{same}" for i in range(8))


def test_texts_beyond_the_sixteenth_have_slots_of_their_own():
    inner = "".join(f"text {i}<p></p>" for i in range(40))
    page = parse(f"<div>{inner}</div>")
    found = h.blocks(page, aligned(page, tree_of(tree_text(page))))
    assert len({b[0] for b in found}) == 40


@pytest.mark.parametrize("depth", [800, 5000])
def test_deep_pages(spark, depth):
    deep = [(i, "//deep.example/", "<div>" * (depth + i % 2) + f"own {i}" + "<p>x</p>" * (i % 3) + "</div>" * depth) for i in range(4)]
    got = {r.page_id: r.text for r in main_texts(pages(spark, deep)).collect()}
    assert all(f"own {i}" in got[i] for i in range(4))


def test_a_page_of_many_megabytes(spark):
    rng = random.Random(6)
    body = "".join(f"<p>{sentence(rng, 40)}</p><ul><li>{i}</li></ul>" if i % 3 else f"<h2>{i}</h2>" for i in range(34_000))
    assert len(body) > 6_000_000
    rows = [(0, "//long.example/", body)] + [(i, "//long.example/", f"<h2>a</h2><p>{sentence(rng)}</p>") for i in range(1, 4)]
    start = time.time()
    got = {r.page_id: r for r in main_texts(pages(spark, rows)).collect()}
    assert time.time() - start < 120
    assert got[0].n_chars > 5_000_000 and got[1].text.startswith("a")


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "//x.example/", "no markup at all"), (3, "//x.example/", "no markup at all"), (None, "//x.example/", "<p>a &amp; b&nbsp;c"),
            (4, "//x.example/", "<<<>>></p></div><p"), (5, "mailto:me", "<nav>n</nav><p>t\x00u</p>")]
    got = main_texts(pages(spark, rows)).collect()
    assert len(got) == 7 and sorted(got[0].asDict()) == ["n_chars", "n_template", "page_id", "text", "url"]
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "no markup at all" and by[None] == "a & b c"
    assert main_texts(pages(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["BROADCAST_BYTES", "BROADCAST_ROWS"])
def test_joined_instead_of_broadcast(spark, monkeypatch, name):
    """Beyond the size that is broadcast, the same texts come by joins."""
    rows = [r[:3] for r in plain_host(9)] + [(50 + i, f"//h{i}.example/", "<p>alone</p>") for i in range(5)]
    want = sorted(map(tuple, main_texts(pages(spark, rows)).collect()))
    monkeypatch.setattr(h, name, 0)
    assert sorted(map(tuple, main_texts(pages(spark, rows)).collect())) == want


def test_markup_of_a_page_is_closed_where_html_says():
    root = Tree("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f</table>").root
    assert [k.tag for k in root.kids][:3] == ["ul", "p", "p"] and len(root.kids[0].kids) == 2
