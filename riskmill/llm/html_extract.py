"""Operator 12: main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

Method: a page is read into block elements and text runs (``dom``). Every node has features: text, word,
link and punctuation density of its subtree, what its tag and the words of its class, id and role
say by themselves and along its ancestors, depth, place on the page, and how it compares with its
siblings. Boosted trees give each node log-odds that main text lies in it. Decoding then takes the set of
nodes of greatest total log-odds in which every kept node has a kept parent and every kept element a kept
child, by one pass up and one down the tree, so no choice of a node contradicts its ancestors or descendants.

Learning: pages have no labels. A bounded sample of them (the ``SAMPLE`` pages of least hash of page_id,
among those of at most ``LONGEST`` signs) is marked by their own semantic elements, and their texts are
dressed again in many layouts that name menus, adverts, notices, comments and articles differently or not at all;
at most ``NODES`` nodes are learned from. Extraction covers every page and its whole html.

Output: kept runs in page order, one a line. White space (any that Unicode names so) inside a run is one
space; a line break element is white space; references are decoded as HTML does, unclosed ones included. Null and empty html
give an empty text, repeated rows one row each, an empty table no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm import boosting
from riskmill.llm.dom import Nodes, read

SAMPLE, LONGEST, NODES, LAYOUTS = 240, 100_000, 60_000, 4
RARE = 3
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# --- features ------------------------------------------------------------------------------


def learned_words(nodes: Nodes, keep: np.ndarray) -> dict[str, float]:
    """Log-odds of keeping, for every tag and every word of an attribute that is not rare."""
    counts: dict[str, list[int]] = {}
    for tag, names, kept in zip(nodes.tag, nodes.names, keep.tolist()):
        if tag != "#text":
            for word in (f"<{tag}", *names):
                counts.setdefault(word, [0, 0])[kept] += 1
    return {w: math.log((k + 1) / (d + 1)) for w, (d, k) in counts.items() if d + k >= RARE}


def _said(nodes: Nodes, words: dict[str, float]) -> np.ndarray:
    """Log-odds of the tag, and least and greatest of the attribute words, of every node."""
    known: dict[tuple, tuple] = {}
    out = []
    for tag, names in zip(nodes.tag, nodes.names):
        key = (tag, names)
        if key not in known:
            own = [words[n] for n in names if n in words] or [0.0]
            known[key] = (words.get(f"<{tag}", 0.0), min(min(own), 0.0), max(max(own), 0.0))
        out.append(known[key])
    return np.array(out, np.float64).reshape(-1, 3)


class Shape:
    """Who is whose parent, level by level."""

    def __init__(self, nodes: Nodes):
        self.parent = np.array(nodes.parent, np.int64)
        self.depth = np.array(nodes.depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(bounds, bounds[1:])]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray, join) -> np.ndarray:
        """``join`` over all proper ancestors; zero at a root."""
        out = np.zeros_like(values)
        for level in self.levels[1:]:
            above = self.parent[level]
            out[level] = join(out[above], values[above])
        return out


def features(nodes: Nodes, words: dict[str, float], shape: Shape) -> np.ndarray:
    """Nodes x features."""
    n, parent = len(nodes.page), shape.parent
    texts = nodes.text
    is_text = np.array([t is not None for t in texts])
    counted = {
        "chars": [len(t) if t else 0 for t in texts],
        "words": [t.count(" ") + 1 if t else 0 for t in texts],
        "stops": [t.count(".") + t.count("!") + t.count("?") if t else 0 for t in texts],
        "commas": [t.count(",") if t else 0 for t in texts],
        "signs": [t.count("©") + t.count("|") + t.count("·") + t.count("»") if t else 0 for t in texts],
        "links": nodes.links,
        "inline": nodes.inline,
        "images": nodes.images,
        "inputs": nodes.inputs,
        "runs": is_text,
        "elements": ~is_text,
        "paragraphs": [t == "p" for t in nodes.tag],
        "items": [t in ("li", "option") for t in nodes.tag],
        "headings": [t in _HEADINGS for t in nodes.tag],
    }
    total = {k: shape.up(np.array(v, np.float64)) for k, v in counted.items()}
    chars, page = total["chars"], np.array(nodes.page)
    first = np.flatnonzero(parent < 0)
    whole = chars[first[np.searchsorted(page[first], page)]] if n else chars
    own = np.array(counted["chars"], np.float64)
    before = np.cumsum(own) - own
    before -= before[first[np.searchsorted(page[first], page)]] if n else 0
    said = _said(nodes, words)
    up_least = shape.down(said.min(axis=1), np.minimum)
    up_most = shape.down(said.max(axis=1), np.maximum)
    up_sum = shape.down(said.sum(axis=1), np.add)
    above = np.where(parent < 0, 0, parent)
    # siblings in page order
    order = np.lexsort((np.arange(n), parent))
    same = np.zeros(n, bool)
    same[1:] = parent[order][1:] == parent[order][:-1]
    previous, following = np.full(n, -1), np.full(n, -1)
    previous[order[1:][same[1:]]] = order[:-1][same[1:]]
    following[order[:-1][same[1:]]] = order[1:][same[1:]]
    siblings = np.bincount(above, minlength=n)[above]
    starts = np.flatnonzero(~same)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    rank = np.empty(n)
    rank[order] = place
    kinds = {t: i for i, t in enumerate(dict.fromkeys(nodes.tag))}
    pair = above * len(kinds) + np.array([kinds[t] for t in nodes.tag], np.int64)
    _, inverse, alike = np.unique(pair, return_inverse=True, return_counts=True)
    link = total["links"] / np.maximum(chars, 1)
    beside = np.where(previous < 0, 0, previous), np.where(following < 0, 0, following)
    columns = [
        is_text,
        shape.depth,
        np.log1p(chars),
        np.log1p(total["words"]),
        link,
        np.log1p(chars / (total["elements"] + total["inline"] + 1)),
        np.log1p(chars / np.maximum(total["runs"], 1)),
        total["stops"] / np.maximum(total["words"], 1),
        total["commas"] / np.maximum(total["words"], 1),
        total["signs"] / np.maximum(total["runs"], 1),
        chars / np.maximum(whole, 1),
        before / np.maximum(whole, 1),
        1 - (before + chars) / np.maximum(whole, 1),
        total["images"],
        total["inputs"],
        total["paragraphs"],
        total["items"],
        total["headings"],
        chars / np.maximum(total["words"], 1),
        *said.T,
        up_least,
        up_most,
        up_sum,
        *said[above].T,
        *said[above[above]].T,
        link[above],
        chars / np.maximum(chars[above], 1),
        np.log1p(chars[above]),
        np.minimum(siblings, 24),
        np.minimum(rank, 24),
        alike[inverse] / np.maximum(siblings, 1),
        np.where(previous < 0, -1, np.log1p(chars[beside[0]])),
        np.where(following < 0, -1, np.log1p(chars[beside[1]])),
        np.where(previous < 0, -1, link[beside[0]]),
        np.where(following < 0, -1, link[beside[1]]),
        total["inputs"][above],
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1).reshape(n, -1)


def decode(odds: np.ndarray, is_text: np.ndarray, shape: Shape) -> np.ndarray:
    """The kept nodes: greatest sum of log-odds with no kept node under a dropped one and no kept element without a kept child."""
    value = odds.astype(np.float64)
    gain, best = np.zeros(len(odds)), np.full(len(odds), -np.inf)
    for level in shape.levels[::-1]:
        inner = level[~is_text[level]]
        value[inner] += np.where(best[inner] > 0, gain[inner], best[inner])
        above = shape.parent[level]
        own = above >= 0
        np.add.at(gain, above[own], np.maximum(value[level[own]], 0))
        np.maximum.at(best, above[own], value[level[own]])
    keep = np.zeros(len(odds), bool)
    for i, level in enumerate(shape.levels):
        if i == 0:
            keep[level] = value[level] > 0
            continue
        above = shape.parent[level]
        # where no child has gain by itself, the best one (the first of equals) stays for its parent
        forced = (best[above] <= 0) & (value[level] == best[above])
        seen, at = np.unique(above[forced], return_index=True)
        only = np.zeros(len(level), bool)
        only[np.flatnonzero(forced)[at]] = True
        keep[level] = keep[above] & ((value[level] > 0) | only) & (value[level] > -np.inf)
    return keep


# --- learning ------------------------------------------------------------------------------

#: Words by which training layouts name what is not the article, and the article itself.
CHROME = {
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination pager tabs toc links",
    "header": "header masthead site-header page-header top topbar branding banner-top logo",
    "footer": "footer site-footer page-footer bottom colophon copyright legal footer-links",
    "ad": "ad ads advert advertisement ad-slot adsbygoogle sponsor sponsored promo promotion banner teaser-ad",
    "notice": "notice cookie-notice cookie consent gdpr alert announcement message popup modal privacy-notice warning overlay",
    "sidebar": "sidebar side side-bar widget widgets related secondary right-column recommended trending popular rail aside more-stories",
    "comments": "comments comment-list comment discussion replies reply responses disqus user-comments comment-thread feedback",
    "form": "form login search newsletter subscribe signup contact search-form registration",
    "share": "share social social-links tags share-buttons follow",
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "ad": "ins", "notice": "aside", "sidebar": "aside", "comments": "section", "form": "form", "share": "ul"}
ARTICLE = "content post entry entry-content article article-body story story-body text main-content post-body post-content body-text page-content blog-post news-article".split()
WRAPPERS = "container wrapper page row layout wrap site inner column col grid main-wrap content-area outer".split()


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def layout(rng: random.Random, title: str, blocks: list[str], chrome: list[str]) -> str:
    """A page that dresses ``blocks`` as an article among menus, adverts, notices and comments made of ``chrome``."""
    named = rng.random() < 0.7  # whether the layout has classes at all
    semantic = rng.random() < 0.5 or not named

    def words(low: int, high: int) -> str:
        source = (rng.choice(chrome) if chrome else "more here").split()
        start = rng.randrange(len(source)) if source else 0
        return _escaped(" ".join(source[start : start + rng.randrange(low, high)]) or "more")

    def prose() -> str:
        source = rng.choice(blocks or chrome or ["nothing else to say here."])
        at = rng.randrange(max(len(source) - 200, 1))
        return _escaped(source[at : at + rng.randrange(20, 300)])

    def box(kind: str, inner: str, class_: bool = True) -> str:
        words_of = CHROME[kind].split()
        tag = TAGS[kind] if semantic and rng.random() < 0.8 else rng.choice(["div", "div", "section"])
        name = rng.choice(words_of)
        given = f' class="{name}"' if rng.random() < 0.75 else f' id="{name}"'
        bare = tag in ("nav", "footer", "header", "aside", "form") and rng.random() < 0.5
        return f"<{tag}{'' if bare or not (named or tag in ('div', 'section', 'ul', 'ins')) else given} data-keep=\"0\">{inner}</{tag}>"

    def links(n: int, high: int = 4) -> str:
        shape = rng.choice(["<ul>{}</ul>", "{}", "<ol>{}</ol>"])
        one = "<li><a href=\"/x\">{}</a></li>" if "l>" in shape else rng.choice(["<a href=\"/x\">{}</a> | ", "<div><a href=\"/x\">{}</a></div>", "<a href='/x'>{}</a> "])
        return shape.format("".join(one.format(words(1, high)) for _ in range(n)))

    def advert() -> str:
        return box("ad", rng.choice([words(3, 25), f"<p>{words(4, 30)}</p>", f"<a href='/buy'><img src=x>{words(2, 8)}</a>", f"<span>{words(1, 3)}</span><p>{prose()}</p>"]))

    def form() -> str:
        fields = "".join(f"<label>{words(1, 3)}</label><input name=a>" for _ in range(rng.randrange(1, 4)))
        return box("form", f"<p>{words(2, 12)}</p>{fields}<button>{words(1, 3)}</button>")

    def comments() -> str:
        one = rng.choice(["<div class=\"comment\"><p>{}</p><p>{}</p></div>", "<li><b>{}</b><p>{}</p></li>", "<p>{}: {}</p>"])
        head = rng.choice(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{rng.randrange(40)} {words(1, 2)}</h3>"])
        return box("comments", head + "".join(one.format(words(1, 3), prose()) for _ in range(rng.randrange(1, 6))))

    def sidebar() -> str:
        inner = rng.choice([links(rng.randrange(2, 8), 9), f"<h3>{words(1, 4)}</h3><p>{prose()}</p>", f"<h3>{words(1, 3)}</h3>{links(4, 12)}", f"<p>{words(5, 40)}</p>"])
        return box("sidebar", inner)

    def notice() -> str:
        return box("notice", rng.choice([f"<p>{words(5, 40)}</p><button>{words(1, 2)}</button>", words(5, 30), f"<p>{prose()}</p>"]))

    def paragraph(text: str) -> str:
        text, roll = _escaped(text), rng.random()
        cut = text.find(" ", len(text) // 2)
        if roll < 0.7 or cut < 0:
            return f"<p>{text}</p>"
        if roll < 0.76:
            return f"<p>{text[:cut]}<a href='/l'>{text[cut:]}</a></p>"
        if roll < 0.82:
            kind = rng.choice(["ul", "ol"])
            return f"<{kind}><li>{text[:cut]}</li><li>{text[cut:]}</li></{kind}>"
        if roll < 0.86:
            return f"<blockquote><p>{text}</p></blockquote>"
        if roll < 0.90:
            kind = rng.choice(["h2", "h2", "h3", "h4"])
            return f"<{kind}>{' '.join(text.split()[:5])}</{kind}><p>{text}"
        if roll < 0.93:
            return f"<table><tr><td>{text[:cut]}<td>{text[cut:]}</table>"
        if roll < 0.96:
            return f"<div>{text}</div>"
        return rng.choice([f"<figure><img src=y><figcaption>{text[:cut]}</figcaption></figure>", f"<pre>{text}</pre>", f"<p><b>{text}<br><p>", f"{text}<br>"])

    head = f"<h1>{_escaped(title)}</h1>" if rng.random() < 0.85 else ""
    if head and rng.random() < 0.2:
        head = f"<header>{head}</header>" if semantic else f'<div class="title">{head}</div>'
    inner = [head, *(paragraph(b) for b in blocks)]
    for make, odds in ((advert, 0.4), (sidebar, 0.12), (form, 0.12), (notice, 0.12), (comments, 0.2), (lambda: box("share", links(3)), 0.25)):
        if rng.random() < odds:
            inner.insert(rng.randrange(1, len(inner) + 1) if make is not comments else len(inner), make())
    tag = rng.choice(["article", "main", "article"]) if semantic else rng.choice(["div", "div", "section", "td"])
    body = "".join(inner)
    given = f' class="{rng.choice(ARTICLE)}"' if named and rng.random() < 0.6 else f' id="{rng.choice(ARTICLE)}"' if named and rng.random() < 0.3 else ""
    body = f'<{tag}{given} data-keep="1">{body}</{tag}>'
    if tag == "td":
        body = f"<table><tr>{body}</tr></table>"
    parts = [body]
    if rng.random() < 0.45:
        parts.append(comments())
    if rng.random() < 0.45:
        parts.insert(rng.randrange(len(parts) + 1), sidebar())
    if rng.random() < 0.2:
        parts.append(form())
    inside = "".join(parts)
    for _ in range(rng.randrange(0, 4)):
        wrap = rng.choice(["div", "div", "section", "main"])
        inside = f"<{wrap}{f' class={chr(34)}{rng.choice(WRAPPERS)}{chr(34)}' if named else ''}>{inside}</{wrap}>"
    outer = [
        box("header", rng.choice([f"<h1>{words(1, 5)}</h1>", f"<a href='/'>{words(1, 4)}</a><p>{words(2, 12)}</p>", f"<div>{words(1, 4)}</div>"])) if rng.random() < 0.45 else "",
        box("menu", links(rng.randrange(2, 12))) if rng.random() < 0.85 else "",
        notice() if rng.random() < 0.35 else "",
        advert() if rng.random() < 0.6 else "",
    ]
    rng.shuffle(outer)
    tail = [
        advert() if rng.random() < 0.25 else "",
        notice() if rng.random() < 0.15 else "",
        box("footer", rng.choice([f"&copy; {words(1, 4)} &middot; {words(4, 20)}", f"<p>{words(3, 25)}</p>", links(4) + words(2, 10), f"<p>&copy; {words(2, 8)}</p>"])) if rng.random() < 0.85 else "",
    ]
    return f'<html><head><title>{_escaped(title)}</title></head><body data-keep="0">{"".join(outer)}{inside}{"".join(tail)}</body></html>'


def _marked(html: str) -> str:
    """A page that marks its article by itself, with training marks."""
    for tag, keep in (("article", 1), ("nav", 0), ("aside", 0), ("footer", 0), ("form", 0)):
        html = html.replace(f"<{tag}", f'<{tag} data-keep="{keep}"')
    return html


def training_nodes(pages: list[str]) -> Nodes:
    """Nodes of the sampled pages and of their texts in other layouts; ``keep`` is what to learn."""
    rng, nodes, count = random.Random(12), Nodes(), 0
    texts = []
    for html in pages:
        plain = Nodes()
        read(_marked(html) if "data-keep" not in html else html, 0, plain)
        runs = [(t, k) for t, k in zip(plain.text, plain.keep) if t]
        if any(k for _, k in runs):
            texts.append(([t for t, k in runs if k], [t for t, k in runs if not k]))
            read(_marked(html) if "data-keep" not in html else html, count, nodes)
            count += 1
        elif runs:
            texts.append(([t for t, _ in runs if len(t) > 80], [t for t, _ in runs if len(t) <= 80]))
    every = [t for _, chrome in texts for t in chrome] + ["all about this site", "read more"]
    texts = texts or [(["a page without any text of its own.", "and one more line to learn from, here."], [])]
    for turn in range(LAYOUTS):
        for blocks, chrome in texts:
            some = blocks[1:] if len(blocks) > 1 else blocks
            if rng.random() < 0.25:
                some = [" ".join(rng.choice(every).split()[:12]) for _ in range(rng.randrange(1, 4))]  # a short article
            elif rng.random() < 0.06:  # a long article of short paragraphs
                some = [" ".join(b.split()[k : k + 9]) for b in some * 40 for k in (0, 9)][: rng.randrange(60, 400)]
            mixed = [*chrome, *rng.sample(every, min(len(every), 8))]
            read(layout(rng, (blocks or ["untitled"])[0][:120], some[:400], mixed), count, nodes)
            count += 1
    return nodes


def learn(pages: list[str], most: int = NODES) -> tuple[dict[str, float], boosting.Trees]:
    """The words and trees, from at most ``most`` nodes."""
    nodes = training_nodes(pages)
    shape = Shape(nodes)
    is_text = np.array([t is not None for t in nodes.text])
    target = shape.up(np.array(nodes.keep) & is_text) > 0
    words = learned_words(nodes, target)
    with_text = shape.up(is_text) > 0
    rows = np.flatnonzero(with_text)
    if len(rows) > most:
        rows = np.sort(np.random.default_rng(12).permutation(rows)[:most])
    return words, boosting.fit(features(nodes, words, shape)[rows], target[rows].astype(np.float64))


# --- extraction ----------------------------------------------------------------------------


def extract(pages: list[str], model: tuple[dict[str, float], boosting.Trees]) -> list[str]:
    words, trees = model
    nodes = Nodes()
    for i, html in enumerate(pages):
        read(html, i, nodes)
    if not pages:
        return []
    shape = Shape(nodes)
    is_text = np.array([t is not None for t in nodes.text])
    keep = decode(trees.margin(features(nodes, words, shape)), is_text, shape)
    out: list[list[str]] = [[] for _ in pages]
    for at in np.flatnonzero(keep & is_text).tolist():
        out[nodes.page[at]].append(nodes.text[at])
    return ["\n".join(lines) for lines in out]


def sample(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """The html of at most ``n`` pages of at most LONGEST signs, those of least hash of page_id.

    A bound on the hash, from the number of pages, leaves about ``8 * n`` of them before anything is
    sorted or sent, whatever the table's size.
    """
    rows = pages.select(F.xxhash64("page_id").alias("h"), "html")
    share = min(1.0, 8 * n / max(rows.count(), 1))
    few = rows.where(F.col("h") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else rows
    few = few.where(F.length("html").between(1, LONGEST)).orderBy("h", F.xxhash64("html")).limit(n)
    return [r["html"] for r in few.collect()]  # at most n * LONGEST signs


def main_texts(pages: DataFrame, model: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html")
    shared = rows.sparkSession.sparkContext.broadcast(model or learn(sample(rows)))  # NODES bounds the words, depth the trees

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                run, size, hi = [], 0, lo
                while hi < batch.num_rows and size < 1 << 20:
                    run.append(batch.column(2)[hi].as_py() or "")
                    size += len(run[-1])
                    hi += 1
                found = extract(run, shared.value)
                columns = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )
                lo = hi

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(texts, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
