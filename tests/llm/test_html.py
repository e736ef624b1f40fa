"""Main text extraction: the reader, the trees, the decoding, and pages of layouts not learned from."""

import html as entities
import itertools
import random
import re

import numpy as np
import pytest
from riskmill.llm import boosting
from riskmill.llm import html_extract as op
from riskmill.llm.dom import Nodes, read

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, text string, n_chars int, page int"


def runs(html):
    nodes = Nodes()
    read(html, 0, nodes)
    return [t for t in nodes.text if t is not None]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a &amp b &eacute;&#x41;&am <b>c</b>d<br>e\n\t f&nbsp;g", ["a & b éA&am cd e f g"]),
        ("<p>one<p>two<li>three<li>four</ul>five", ["one", "two", "three", "four", "five"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style>yes<!-- <p>no --><!doctype x>", ["yes"]),
        ("<title>no</title><div>a<div>b</div>c", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("1 < 2 <3 <p class=\"x>y\">q</p", ["1 < 2 <3", "q"]),
        ("<div title='never closed>a<p>b</div>c", ["a", "b", "c"]),
        ("<textarea><p>x</textarea><svg><text>no</svg><x-y>z</x-y>", ["<p>x", "z"]),
        ("</p></div><b>a</i></b>", ["a"]),
        ("<script>open", []),
        ("", []),
    ],
)
def test_reader(html, want):
    assert runs(html) == want


def test_reader_takes_deep_and_long_pages():
    assert runs("<div>" * 30000 + "deep") == ["deep"]
    assert len(runs("<p>x" * 50000)) == 50000
    assert runs("<a b=\"" * 20000) == []
    assert len(runs("<object>a<p>" * 20000)) > 0


def test_trees_learn_a_rule_of_two_features():
    x = np.random.default_rng(1).random((3000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97
    assert boosting.fit(x[:0], y[:0]).margin(x).shape == (3000,)


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(3)
    for _ in range(60):
        nodes = Nodes()
        read("".join(rng.choice(["<div>", "<ul>", "</div>", "t", "<p>u</p>"]) for _ in range(rng.randrange(1, 9))), 0, nodes)
        n = len(nodes.page)
        odds, is_text = np.array([rng.choice([-2.0, -1.0, 0.5, 1.0, 2.5]) + k / 1000 for k in range(n)]), np.array([t is not None for t in nodes.text])
        best, top = 0.0, [False] * n
        for pick in itertools.product([False, True], repeat=n):
            fits = all(
                not on or ((p < 0 or pick[p]) and (is_text[v] or any(pick[c] for c in range(n) if nodes.parent[c] == v)))
                for v, (on, p) in enumerate(zip(pick, nodes.parent))
            )
            if fits and sum(o for o, on in zip(odds, pick) if on) > best + 1e-12:
                best, top = sum(o for o, on in zip(odds, pick) if on), list(pick)
        assert op.decode(odds, is_text, op.Shape(nodes)).tolist() == top


def prose(rng, n):
    words = [rng.choice("river stone cloud under walking seldom bright market paper window carried slowly".split()) for _ in range(n)]
    return " ".join(w.capitalize() if i % 11 == 0 else w + "." if i % 11 == 10 else w for i, w in enumerate(words)) + "."


def strange_page(rng):
    """A page whose words of class and order of parts are not those of the training layouts, and its text."""
    paragraphs = [prose(rng, rng.randrange(15, 70)) for _ in range(rng.randrange(2, 8))]
    title = prose(rng, 6)
    links = "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(rng.randrange(3, 9)))
    advert = f'<div class="ad">{prose(rng, 9)}</div>'
    replies = "".join(f'<div class="comment"><p class="who">Ann</p><p>{prose(rng, 25)}</p></div>' for _ in range(rng.randrange(1, 5)))
    inner = [f"<h1>{title}</h1>", *(f"<p>{p}</p>" for p in paragraphs)]
    inner.insert(rng.randrange(2, len(inner) + 1), rng.choice([advert, "", f'<aside class="related-box"><h3>More</h3><ul>{links}</ul></aside>']))
    body = "".join(inner)
    body = rng.choice(['<article class="hentry">{}</article>', '<main id="main">{}</main>', '<div class="post-content clearfix">{}</div>', "<article>{}</article>"]).format(body)
    after = rng.choice(["", f'<section id="comments"><h2>Replies</h2>{replies}</section>', f'<div class="comments-area">{replies}</div>'])
    side = rng.choice(["", f'<div class="sidebar-right"><h4>Popular</h4><ul>{links}</ul></div>', f"<aside><p>{prose(rng, 14)}</p></aside>"])
    top = rng.choice([f"<nav><ul>{links}</ul></nav>", f'<div id="top-menu"><ul>{links}</ul></div>', f'<header class="site-header"><a href="/">Home</a><nav>{links}</nav></header>'])
    note = rng.choice(["", f'<div class="cookie-banner"><p>{prose(rng, 12)}</p><button>OK</button></div>'])
    form = rng.choice(["", '<form action="/s"><label>Mail</label><input name="m"><button>Send</button></form>'])
    end = rng.choice(["<footer><p>&copy; 2020 Somebody &middot; All rights kept.</p></footer>", '<div class="footer-bottom">&copy; Somebody</div>'])
    return f"<html><head><title>{title}</title></head><body>{top}{note}<div class=\"wrap\">{body}{after}{side}</div>{form}{end}</body></html>", "\n".join([title, *paragraphs])


@pytest.fixture(scope="module")
def sampled(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


@pytest.fixture(scope="module")
def model(sampled):
    return op.learn(sampled)


def test_layouts_not_learned_from(model):
    rng = random.Random(8)
    pages = [strange_page(rng) for _ in range(300)]
    found = op.extract([h for h, _ in pages], model)
    assert sum(f == t for f, (_, t) in zip(found, pages)) >= 285
    lines = [set(f.split("\n")) for f in found], [set(t.split("\n")) for _, t in pages]
    shared = sum(len(a & b) for a, b in zip(*lines))
    assert shared / sum(map(len, lines[0])) > 0.97 and shared / sum(map(len, lines[1])) > 0.97


def article(html):
    """The marked article of the given tables' pages, read by patterns."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S).group(1).replace("<br>", " ")
    pieces = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in pieces if p)


def test_query_extracts_every_article_whole(spark):
    html = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op.op12_html_extraction(spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == {k: (u, article(h), len(article(h))) for k, (u, h) in html.items()}
    assert len(found) == len(html)


def test_odd_rows(spark, model, sampled):
    long = "<article>" + "".join(f"<p>{i} was the number of it, and so on.</p>" for i in range(20000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "  \n"), (None, "u", sampled[0]), (5, "v", sampled[0]), (5, "v", sampled[0]), (6, "w", long)]
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], PAGES)
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in op.main_texts(df, model).collect())
    text = article(sampled[0])
    assert found[0] == (0, text, len(text)) and [f[1:] for f in found[1:4]] == [("", 0)] * 3 and found[4:6] == [(5, text, len(text))] * 2
    assert found[6][1].count("\n") == 19999
    nothing = spark.createDataFrame([], PAGES)
    assert op.main_texts(nothing).collect() == []
    assert op.extract(["<p>Some words that nobody marked.</p>"], op.learn([])) is not None
