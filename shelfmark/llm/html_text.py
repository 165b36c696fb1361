"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is content or not. Its own evidence (tag, names in class, id and
role, size and link share of its text) and a potential for each parent-child
pair make a tree model. Sum-product messages run from the leaves up and from
the root down, for all pages of a batch at once and level by level, and give
each element's exact chance to be content. A text is kept where its element's
chance is over a half.

The model is trained by gradient on the exact likelihood, on labelled pages: a
bounded sample (``SAMPLE_PAGES``) of pages whose markup names the article, and
pages of the same sentences in other layouts, where the label is known because
the layout put the sentence there.

Nothing is shuffled: each page is read where it lies.

Defined cases: null or empty html has no text; cut-off pages are read to their
end; a table without a page that names its article is trained on the layouts
alone; repeated rows get equal results.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches
from shelfmark.llm.dom import INLINE, RAW, Page, names

SAMPLE_PAGES = 200
SAMPLE_CHARS = 200_000
LAYOUT_PAGES = 600
STEPS = 250
RIDGE = 1e-6
HASHES = 1 << 20
SEED = 7

# Names that layouts give to their parts, in the order of the task's list of what is not the article.
CONTENT_NAMES = "content article post entry story main body text page-content post-body entry-content article-body".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumbs breadcrumb main-menu toc links".split(),
    "header": "header masthead site-header banner top logo branding".split(),
    "footer": "footer site-footer copyright bottom colophon legal".split(),
    "sidebar": "sidebar side aside widget related popular recommended trending secondary tags".split(),
    "notice": "cookie notice consent gdpr alert popup modal cookie-banner privacy overlay".split(),
    "advert": "ad ads advert advertisement sponsored promo ad-slot sponsor teaser".split(),
    "form": "form newsletter subscribe search login signup subscription search-box".split(),
    "share": "share social sharing share-buttons follow".split(),
    "comment": "comments comment reply replies discussion respond comment-list disqus".split(),
}
OTHER_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comment": "section"}


@dataclass
class Nodes:
    """All elements of some pages: for each the page's own, the parent, depth and feature names."""

    parent: np.ndarray
    depth: np.ndarray
    inline: np.ndarray
    features: list[list[str]]
    first: list[int]


def _bucket(value: np.ndarray) -> list[int]:
    return np.minimum(np.log2(value + 1).astype(int), 12).tolist()


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The elements of each depth, from 0 on."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def nodes_of(pages: list[Page], cache: dict) -> Nodes:
    """Elements of all pages in one numbering, with the features of each."""
    sizes = [len(page.tag) for page in pages]
    first = np.cumsum([0, *sizes])[:-1].tolist()
    own_parents = [np.array(page.parent) for page in pages]
    parent = np.concatenate([np.where(p < 0, -1, p + f) for p, f in zip(own_parents, first, strict=True)])
    depth = np.concatenate([np.array(page.depth) for page in pages])
    tags = [tag for page in pages for tag in page.tag]
    attrs = [attr for page in pages for attr in page.attrs]
    chars, linked, stops = (np.zeros(len(parent)) for _ in range(3))
    for page, offset in zip(pages, first, strict=True):
        for element, text in zip(page.text_of, page.text, strict=True):
            chars[element + offset] += len(text)
            stops[element + offset] += text.count(".") + text.count(",")
    link = np.array([tag == "a" for tag in tags])
    linked[link] = chars[link]
    own = chars.copy()
    inline = np.array([tag in INLINE for tag in tags])
    for at in reversed(by_depth(depth)[1:]):
        for total in (chars, linked, stops):
            np.add.at(total, parent[at], total[at])
        spread = at[inline[at]]
        np.add.at(own, parent[spread], own[spread])
    share = (4 * linked / np.maximum(chars, 1)).astype(int).tolist()
    rate = np.minimum(100 * stops / np.maximum(chars, 1), 5).astype(int).tolist()
    size, direct = _bucket(chars), _bucket(own)
    features = []
    for k, (tag, attr) in enumerate(zip(tags, attrs, strict=True)):
        fixed = cache.get((tag, attr))
        if fixed is None:
            if len(cache) > 50_000:
                cache.clear()
            fixed = cache[tag, attr] = [f"tag {tag}", *(f"name {name}" for name in names(attr))]
        features.append([*fixed, f"size {size[k]}", f"direct {direct[k]}", f"links {share[k]}", f"stops {rate[k]}"])
    return Nodes(parent, depth, inline, features, first)


def marginals(own: np.ndarray, nodes: Nodes, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content of every element, and of each (parent, own) state pair.

    ``own`` is the log odds of each element by itself; ``pair[inline]`` is the
    2 x 2 log potential of (parent state, own state).
    """
    n = len(own)
    evidence = np.zeros((n, 2))
    evidence[:, 1] = own
    potential = pair[nodes.inline.astype(int)]
    levels = by_depth(nodes.depth)
    up = np.zeros((n, 2))
    for at in reversed(levels[1:]):
        # To the parent: over the own state, evidence and what came from below.
        up[at] = np.logaddexp.reduce(potential[at] + evidence[at][:, None, :], axis=2)
        np.add.at(evidence, nodes.parent[at], up[at])
    belief = evidence.copy()
    joint = np.zeros((n, 2, 2))
    for at in levels[1:]:
        # From the parent: its belief without what this element told it.
        above = belief[nodes.parent[at]] - up[at]
        both = above[:, :, None] + potential[at] + evidence[at][:, None, :]
        belief[at] = np.logaddexp.reduce(both, axis=1)
        both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
        joint[at] = np.exp(both)
    chance = np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1]))
    return chance, joint


@dataclass
class Model:
    weights: dict[str, float]
    pair: np.ndarray

    def content(self, nodes: Nodes) -> np.ndarray:
        weight = self.weights.get
        own = np.array([sum(weight(name, 0.0) for name in features) for features in nodes.features])
        return marginals(own, nodes, self.pair)[0]


def fitted(nodes: Nodes, label: np.ndarray) -> Model:
    """Weights and pair potentials of greatest likelihood: observed against expected counts."""
    vocabulary: dict[str, int] = {}
    columns = np.array([vocabulary.setdefault(f, len(vocabulary)) for fs in nodes.features for f in fs], np.int64)
    rows = np.repeat(np.arange(len(label)), [len(fs) for fs in nodes.features])
    below = np.flatnonzero(nodes.parent >= 0)
    kind = nodes.inline[below].astype(int)
    observed_pair = np.zeros((2, 2, 2))
    np.add.at(observed_pair, (kind, label[nodes.parent[below]], label[below]), 1)
    weights, pair = np.zeros(len(vocabulary)), np.zeros((2, 2, 2))
    mean, square = np.zeros(len(weights) + 8), np.zeros(len(weights) + 8)
    for step in range(1, STEPS + 1):
        chance, joint = marginals(np.bincount(rows, weights[columns], len(label)), nodes, pair)
        by_weight = np.bincount(columns, (chance - label)[rows], len(weights)) / len(label) + RIDGE * weights
        expected = np.stack([joint[below][kind == k].sum(axis=0) for k in (0, 1)])
        slope = np.concatenate((by_weight, ((expected - observed_pair) / len(label) + RIDGE * pair).ravel()))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights = weights - move[:-8]
        pair = pair - move[-8:].reshape(2, 2, 2)
    return Model({name: float(weights[k]) for name, k in vocabulary.items()}, pair)


def layouts(sentences: list[str], count: int, seed: int = SEED) -> list[str]:
    """Pages in many layouts; elements of the article carry the attribute ``data-kept``."""
    choose = random.Random(seed)
    say = lambda most: " ".join(choose.choices(sentences, k=choose.randint(1, most)))
    short = lambda: " ".join(choose.choice(sentences).split()[: choose.randint(1, 4)]).strip(".,")

    def named(kind_names: list[str], chance: float) -> str:
        if choose.random() > chance:
            return ""
        return f' {choose.choice(["class", "id"])}="{choose.choice(kind_names)}"'

    def other(kind: str) -> str:
        own_tag = OTHER_TAGS.get(kind)
        tag = own_tag if own_tag and choose.random() < 0.5 else choose.choice(["div", "div", "section"])
        if tag == own_tag and tag != "section":
            chance = 0.5
        else:
            # Without a tag of its own a part is told by its name, or else by what it holds.
            chance = 0.97 if kind in ("comment", "notice", "advert", "sidebar") else 0.8
        attrs = named(OTHER_NAMES[kind], chance)
        links = [f'<a href="/{k}">{short()}</a>' for k in range(choose.randint(2, 8))]
        if kind == "menu" or (kind in ("header", "footer", "sidebar", "share") and choose.random() < 0.6):
            inside = "".join(f"<li>{x}</li>" for x in links) if choose.random() < 0.6 else " | ".join(links)
            inside = f"<ul>{inside}</ul>" if inside.startswith("<li>") else inside
        elif kind == "form":
            inside = f"<label>{short()}</label><input name=q><button>{short()}</button>"
        elif kind == "comment":
            said = range(choose.randint(1, 5))
            own = ["comment", "reply", "comment-body"]
            inside = "".join(f"<div{named(own, 0.7)}><b>{short()}</b><p>{say(4)}</p></div>" for _ in said)
        else:
            inside = choose.choice(
                [
                    f"<p>{say(2)}</p>",
                    say(2),
                    f"<h3>{short()}</h3><p>{say(2)}</p>",
                    f"&copy; {short()} &middot; {short()}",
                ]
            )
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def block() -> str:
        kind = choose.random()
        if kind < 0.1:
            return f"<h2 data-kept>{short()}</h2>"
        if kind < 0.18:
            items = "".join(f"<li data-kept>{say(1)}</li>" for _ in range(choose.randint(2, 5)))
            return f"<ul data-kept>{items}</ul>"
        if kind < 0.24:
            return f"<blockquote data-kept><p data-kept>{say(3)}</p></blockquote>"
        if kind < 0.3:
            return f"<pre data-kept>{say(2)}</pre>"
        if kind < 0.36:
            cell = "<td data-kept>"
            lines = "".join(f"<tr data-kept>{cell}{short()}</td>{cell}{say(1)}</td></tr>" for _ in range(3))
            return f"<table data-kept>{lines}</table>"
        inside = say(6)
        if choose.random() < 0.4:
            inside += f' <a data-kept href="/x">{short()}</a> <b data-kept>{short()}</b> {say(2)}'
        tag = choose.choice(["p", "p", "p", "p", "div"])
        return f"<{tag} data-kept>{inside}</{tag}>"

    pages = []
    for _ in range(count):
        kinds = list(OTHER_NAMES)
        # A quarter of the pages are little more than a short article.
        bare = choose.random() < 0.25
        around = [0, 0, 0, 1] if bare else [0, 1, 2, 3, 4]
        before = "".join(other(k) for k in choose.sample(kinds, choose.choice(around)))
        after = "".join(other(k) for k in choose.sample(kinds, choose.choice(around)))
        blocks = [block() for _ in range(choose.randint(1, 3 if bare else 9))]
        if not bare and choose.random() < 0.4:
            place = choose.randint(0, len(blocks))
            blocks.insert(place, other(choose.choice(["advert", "share", "sidebar", "form", "comment"])))
        tag = choose.choice(["article", "main", "div", "div", "section"])
        attrs = named(CONTENT_NAMES, 0.5 if tag in ("article", "main") else 0.8)
        title = f"<h1 data-kept>{short()}</h1>" if choose.random() < 0.7 else ""
        body = f"<{tag}{attrs} data-kept>{title}{''.join(blocks)}</{tag}>"
        if choose.random() < 0.5:
            body = f'<div{named(["wrapper", "container", "page", "layout", "wrap"], 0.8)}>{body}{after}</div>'
            after = ""
        page = f"{before}{body}{after}"
        if choose.random() < 0.8:
            page = f"<html><head><title>{short()}</title></head><body>{page}</body></html>"
        pages.append(page)
    return pages


def labels_of(page: Page, rule) -> np.ndarray:
    return np.array([rule(page, k) for k in range(len(page.tag))], np.int64)


def article_labels(page: Page) -> np.ndarray:
    """Inside an article or main element, and not in a part of it that the standard sets apart."""
    apart = {"nav", "footer", "aside", "form", "button"} | RAW
    found, left = [False], [False]
    # A parent comes before its children.
    for tag, parent in zip(page.tag[1:], page.parent[1:], strict=True):
        found.append(found[parent] or tag in ("article", "main"))
        left.append(left[parent] or tag in apart)
    return np.array([f and not a for f, a in zip(found, left, strict=True)], np.int64)


def trained(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """A model from a sample of ``pages`` that name their article, and from layouts of their sentences.

    At most ``sample_pages`` pages of fewer than ``SAMPLE_CHARS`` characters are learned from.
    """
    total = pages.count()
    share = min(HASHES, 4 * HASHES * sample_pages // max(total, 1))
    rows = (
        pages.select("page_id", "html")
        .where(F.pmod(F.xxhash64("page_id"), F.lit(HASHES)) < share)
        .where(F.col("html").rlike("(?i)<(?:article|main)[ >]") & (F.length("html") < SAMPLE_CHARS))
        .orderBy(F.xxhash64("page_id", "html"), "html")
        .limit(sample_pages)
        .collect()
    )
    marked = [Page(row["html"]) for row in rows]
    labels = [article_labels(page) for page in marked]
    sentences = sorted(
        {" ".join(t.split()) for page in marked for t in page.text if 20 < len(t) < 300}
    ) or ["Some words make a sentence, and more words follow.", "Another one stands here.", "It ends, at last, with this."]
    made = [Page(source) for source in layouts(sentences, LAYOUT_PAGES)]
    labels += [labels_of(page, lambda p, k: "data-kept" in p.attrs[k]) for page in made]
    return fitted(nodes_of([*marked, *made], {}), np.concatenate(labels))


def texts_of(pages: list[Page], content: np.ndarray, first: list[int]) -> list[str]:
    """The kept texts of each page: blocks joined by an empty line."""
    out = []
    for page, offset in zip(pages, first, strict=True):
        blocks: dict[int, list[str]] = {}
        for element, block, text in zip(page.text_of, page.block_of, page.text, strict=True):
            if content[element + offset] > 0.5:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        out.append("\n\n".join(text for text in joined if text))
    return out


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url and text (the main text, empty if none) of every row."""
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.select("page_id", "url", "html")
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType())])

    def extract(batches):
        cache: dict = {}
        for batch in batches:
            out: list[str] = []
            if batch.num_rows:
                read = [Page(source or "") for source in batch.column(2).to_pylist()]
                nodes = nodes_of(read, cache)
                out = texts_of(read, sent.value.content(nodes), nodes.first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=schema.names)

    return source.mapInArrow(extract, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, trained(pages)).withColumn("n_chars", F.length("text").cast("long"))
