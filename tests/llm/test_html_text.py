from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest

from shelfmark.llm import dom
from shelfmark.llm import html_text as op
from shelfmark.llm.dom import Page

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return op.trained(spark.read.parquet(f"{ROOT}/pages.parquet"))


def expected(source):
    """The article of the test tables' template."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " " , re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_query_gives_the_articles(spark):
    rows = op.op8_html_extraction(spark, ROOT).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{ROOT}/pages.parquet").collect()}
    assert len(rows) == len(sources)
    wrong = [r["page_id"] for r in rows if r["text"] != expected(sources[r["page_id"]])]
    assert not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def read(model, source):
    page = Page(source)
    nodes = op.nodes_of([page], {})
    return op.texts_of([page], model.content(nodes), nodes.first)[0]


def test_messages_equal_enumeration():
    random = np.random.default_rng(2)
    for _ in range(20):
        n = 7
        parent = np.array([-1, *(int(random.integers(0, k)) for k in range(1, n))])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        inline = random.random(n) < 0.5
        own, pair = random.normal(size=n), random.normal(size=(2, 2, 2))
        chance, joint = op.marginals(own, op.Nodes(parent, depth, inline, [], [0]), pair)
        total, exact, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for bits in range(1 << n):
            x = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(own[k] * x[k] for k in range(n)) + sum(pair[int(inline[k]), x[parent[k]], x[k]] for k in range(1, n)))
            total += w
            exact += w * np.array(x)
            for k in range(1, n):
                both[k, x[parent[k]], x[k]] += w
        assert np.allclose(chance, exact / total)
        assert np.allclose(joint[1:], both[1:] / total)


def test_held_out_layouts(model):
    made = op.layouts(["A sentence of some words, and more of them.", "It is told here what happened on that day.", "Nobody knew."], 150, seed=99)
    right = wrong = missed = 0
    for source in made:
        page = Page(source)
        label = op.labels_of(page, lambda p, k: "data-kept" in p.attrs[k])
        page.attrs = [a.replace("data-kept", "") for a in page.attrs]
        chance = model.content(op.nodes_of([page], {}))
        for element, text in zip(page.text_of, page.text, strict=True):
            got, want = chance[element] > 0.5, label[element] == 1
            right += len(text) * (got and want)
            wrong += len(text) * (got and not want)
            missed += len(text) * (want and not got)
    assert right / (right + wrong) > 0.9
    assert right / (right + missed) > 0.9


def test_tree_and_blocks(model):
    page = Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<b>f<p>g<br>h<table><tr><td>i<td>j<tr><td>k</table>l")
    assert page.text == ["a", "b", "c", "d", "e", "f", "g ", "h", "i", "j", "k", "l"]
    assert [page.tag[k] for k in page.text_of] == ["li", "li", "li", "li", "p", "b", "p", "p", "td", "td", "td", "#page"]
    blocks = page.block_of
    assert blocks[4] == blocks[5] and blocks[6] == blocks[7] and len(set(blocks)) == 10
    words = "Some words stand here, and they say what happened on that day. "
    source = (
        f"<body><nav><a href=1>Menu</a></nav><article><p>{words * 3}&amp;&nbsp;<b>x</b>y\n z</p><script>if (a<b) {{}}</script>"
        f"<!-- no --><p>{words * 2}</p></article><div class=comments><p>{words}</p></div><footer>f</footer>"
    )
    assert read(model, source) == f"{words * 3}& xy z\n\n{(words * 2).strip()}"


def test_odd_rows(spark, model):
    words = "Some words stand here, and they say what happened on that day. "
    odd = spark.createDataFrame(
        [
            (1, "u", f"<article><p>{words}</p></article>", "x"),
            (1, "u", f"<article><p>{words}</p></article>", "x"),
            (None, None, "", "x"),
            (2, "u", None, "x"),
            (3, "u", "<p", "x"),
            (4, "u", "<" * 2000 + "a='" * 2000, "x"),
            (5, "u", "<div>" * 3000 + f"<p>{words * 2000}", "x"),
            (6, "u", "<article><p>" + words * 4 + "</p><script>never closed", "x"),
        ],
        "page_id long, url string, html string, text string",
    )
    rows = op.extracted(odd, model).collect()
    assert len(rows) == 8
    by_id = {r["page_id"]: r["text"] for r in rows}
    assert by_id[1] == words.strip() and by_id[None] == by_id[2] == by_id[3] == ""
    assert by_id[6] == (words * 4).strip()
    assert op.extracted(odd.limit(0), model).count() == 0
    assert op.trained(odd.limit(0)).weights


def walked(page, tags, walls):
    """What a start tag closes, by a walk over all open elements."""
    for at in range(len(page._open) - 1, 0, -1):
        tag = page.tag[page._open[at]]
        if tag in tags:
            while at > 1 and page.tag[page._open[at - 1]] in tags:
                at -= 1
            return at
        if tag in walls:
            return None
    return None


def test_closing_equals_a_walk_over_open_elements(monkeypatch):
    rnd = random.Random(8)
    inner, seen = dom.Page._end_open, []

    def checked(page, tags, walls):
        expected = walked(page, tags, walls)
        before = len(page._open)
        inner(page, tags, walls)
        assert len(page._open) == (before if expected is None else expected)
        seen.append(expected)
        for tag, places in page._places.items():
            assert [page.tag[page._open[k]] for k in places] == [tag] * len(places)

    monkeypatch.setattr(dom.Page, "_end_open", checked)
    tags = ["p", "li", "ul", "td", "tr", "table", "dd", "dt", "dl", "div", "b", "button", "option", "select", "tbody", "th"]
    for _ in range(300):
        dom.Page("".join(f"<{rnd.choice(['', '', '/'])}{rnd.choice(tags)}>x" for _ in range(60)))
    assert sum(e is not None for e in seen) > 500


def test_deep_nesting_takes_seconds():
    source = "<div>" * 100_000 + "<p>Some text stands here, deep below.</p>" + "</div>" * 100_000
    start = time.perf_counter()
    page = dom.Page(source)
    nodes = op.nodes_of([page], {})
    chance, _ = op.marginals(np.zeros(len(page.tag)), nodes, np.zeros((2, 2, 2)))
    assert op.article_labels(page).sum() == 0
    assert len(chance) == 100_002 and time.perf_counter() - start < 30
