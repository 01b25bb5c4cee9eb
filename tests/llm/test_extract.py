"""Main text: reading of blocks, training, and pages whose text is known."""

import html
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import extract

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def texts(page):
    return [b.text for b in extract.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a<b>b</b>c<br>d</p>", ["abc d"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<p>x &amp; y&nbsp;&lt;z &#233;&am", ["x & y <z é&am"]), ("<script>if (a<b) '</p>'</script><p>t</p><STYLE>p{}</style>", ["t"]), ("<p>a<!-- <p>no</p> -->b</p><!-- open", ["ab"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<p title=\"a>b\" class='c'>t</p>", ["t"]), ("a < b and c", ["a < b and c"]), ("<head><title>no</title></head><p>t", ["t"]),
        ("<textarea>no<p></textarea><p>t", ["t"]), ("<p>  a \n\t b  </p>", ["a b"]), ("</p></div>a</b>", ["a"]), ("<script>never closed <p>x", []), ("<tr><td>a<td>b<tr><td>c", ["a", "b", "c"]), ("<p>a<", ["a<"]),
    ],
)
def test_blocks(page, wanted):
    assert texts(page) == wanted


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<head><title>no</title><meta charset=x><body><p>a<p>b", ["a", "b"]), ("<head><title>no</title><style>p{}</style><p>a", ["a"]), ("<head><title>no</title><body>a<header>b</header>c", ["a", "b", "c"]),
        ("<HEAD><link rel=x><script>no</script></HEAD><p>t", ["t"]), ("<p>a<noscript>b<p>c", ["a b", "c"]), ("<p>a</p><button>b<p>c", ["a", "b", "c"]), ("<object><p>a<svg>b", ["a b"]),
        ("<p>a<select></selected>b</select>c", ["a c"]), ("<svg><text>no</text></SVG ><p>t", ["t"]), ("<style>no</styles></style><p>t", ["t"]), ("<p>a<style>no<p>b", ["a"]),
        ("<p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z</p>", ["x y=2 z"]), ("<p>a <math><mi>b</mi><p>c", ["a b", "c"]), ("<button>" * 3 + "a</button>b", ["b"]), ("<button>a<p>b<button>no</button>c", ["a", "b c"]),
    ],
)
def test_ends_left_out(page, wanted):
    """Elements without end tags take no text with them, end tags go by whole names, and math is text."""
    assert texts(page) == wanted


def test_many_without_end_tags():
    assert len(texts("<object><p>a" * 50_000)) == 50_000


def test_paths():
    block = extract.blocks_of('<div class="Main Post" id=top><ul><li><a href="/">x</a> y</ul></div>')[0]
    items = ["t div", "n main", "n post", "n top", "t ul", "t li", "in li"]
    assert block.path == {extract._slot(x) for x in items} and block.linked == 1


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<html><head><title>t</title><body><p>one</p><p>two</p></body></html>", ["one", "two"]), ("<head><meta x><body><header><p>menu</p></header><article><p>one", ["menu", "one"]),
        ("<article><p>a</p><button>x<p>b</p><p>c</p></article>", ["a", "x", "b", "c"]), ("<article><button>x<p>b</p></article><p>c<button>no</button>d", ["x", "b", "c d"]),
        ("<div>a<svg><g>x</div>b<object>no<p>no</object>c", ["a", "x", "b c"]), ("<svg><svg>no</svg>no</svg>a", ["a"]), ("<div><template><div>no</div>no</template>a</div>", ["a"]),
        ('<a href="x>text <p class="y">more', ["text", "more"]), ('<img alt="a > b < c">x', ["x"]), ("<a title='1 > 2'class=\"k\">x", ["x"]), ('<a "x>y"<b', ['y"<b']), ("<!-->a--><!--->b<!-- <p> --!>c", ["a-->bc"]),
        ("<p>a <button>no</p>no</button> b", ["a b"]), ("<iframe><p>no</iframe>a", ["a"]), ("<select><option>no<select><option>no</select>a", ["no a"]),
    ],
)
def test_nothing_is_lost(page, wanted):
    assert texts(page) == wanted


@pytest.mark.parametrize("name", sorted(extract.OUT | {"title", "textarea"}))
def test_unclosed_elements_keep_what_follows(name):
    assert texts(f"<p>a</p><div><{name} x=1><p>b</p></div><p>c</p>") == ["a", "b", "c"]
    assert "".join(texts(f"<{name}>x</{name}><p>a<{name}><p>b<p>c")) == "abc"


@pytest.mark.parametrize("part", ['<a "', "<a '", '<a ="', "<a x='\"", '<a "x>', "<div>", "<p class=x>t</p>", "<svg>", "<svg></svg>", "<button>", "</div>", "<", "<!", "<!--", "<title>", "&amp", "plain words and more ", "<li>", "<ul><li>a", "<div class='a b c'>x", "<a b='>", "a<b = "])
@pytest.mark.parametrize("end", ["", ">", '"', "'>"])
def test_time_grows_with_the_page(part, end):
    for size in (1_000_000,):
        began = time.process_time()
        blocks = extract.blocks_of(part * (size // len(part)) + end)
        assert time.process_time() - began < 10
        assert sum(len(b.path) for b in blocks) <= 20 * size


class Plain(HTMLParser):
    """Every text outside the elements that are left out, for pages whose elements are closed."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in extract.OUT | extract.RAW

    def handle_endtag(self, tag):
        self.depth -= tag in extract.OUT | extract.RAW

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


names = st.sampled_from(["div", "p", "ul", "li", "b", "section", "svg", "button", "select", "template", "object", "iframe", "noscript", "span", "td", "h1", "title", "textarea"])
trees = st.recursive(st.text("xyz& \n", min_size=1, max_size=6).map(lambda t: t.replace("&", "&amp;")), lambda inner: st.tuples(names, st.sampled_from(["", ' class="a > b"', " id='c'", " hidden"]), st.lists(inner, max_size=4)), max_leaves=25)


def written(tree, around=()):
    if isinstance(tree, str):
        return tree
    name, attributes, inner = tree
    if name in around and name in extract.SINGLE:  # none holds another of its name
        return "".join(written(x, around) for x in inner)
    if name in ("title", "textarea", "iframe", "noscript"):
        inner = [x for x in inner if isinstance(x, str)]
    return f"<{name}{attributes}>{''.join(written(x, (*around, name)) for x in inner)}</{name}>"


@given(st.lists(trees, max_size=6))
@settings(max_examples=400, deadline=None)
def test_texts_are_kept_once_and_in_order(made):
    page = "".join(map(written, made))
    twin = Plain()
    twin.feed(page)
    twin.close()
    assert "".join("".join(texts(page)).split()) == "".join("".join(twin.out).split())


def test_forward_pass_by_its_definition():
    """Page by page and block by block, without batches and padding."""
    made = extract.generated(12, 23)
    slots, paths = extract._Slots(), {}
    pages = [extract.numbered(b, slots, paths) for b, _ in made]
    net = extract.Labeller(5)
    w, n = net.weights, extract.HIDDEN
    for (blocks, _), page, got in zip(made, pages, net.label(pages)):
        x = []
        for i, b in enumerate(blocks):
            found = extract._WORD.findall(b.text)
            path, word = sum((w["path"][s] for s in b.path), np.zeros(extract.EMBED)), sum((w["word"][slots[t]] for t in found), np.zeros(extract.EMBED))
            x.append(np.concatenate([path, word / max(1, len(found)), page.measures[i]]))
        sides = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c = np.zeros(n), np.zeros(n)
            for i in order:
                z = x[i] @ w[f"x{d}"] + h @ w[f"h{d}"] + w[f"c{d}"]
                gate = 1 / (1 + np.exp(-z))
                c = gate[n : 2 * n] * c + gate[:n] * np.tanh(z[2 * n : 3 * n])
                h = gate[3 * n :] * np.tanh(c)
                sides[d, i] = h
        z = np.array([np.concatenate([sides["f", i], sides["b", i], x[i]]) @ w["out"] + w["bias"][0] for i in range(len(x))])
        sure = abs(z) > 1e-9
        assert ((z > 0) == got)[sure].all()


def test_kept_weights_are_those_that_training_gives():
    kept, learned = extract.kept_labeller(), extract.trained()
    assert all(np.allclose(kept.weights[k], learned.weights[k], atol=1e-6) for k in learned.weights) and sorted(kept.weights) == sorted(learned.weights)


def test_gradients_are_the_slopes():
    made = extract.generated(3, 17)
    slots, paths = extract._Slots(), {}
    pages, labels = [extract.numbered(b, slots, paths) for b, _ in made], [y for _, y in made]
    net = extract.Labeller(2)

    def loss():
        x, mask = net._padded(pages)
        z = np.concatenate([net._run(x, mask, d, False)[0] for d in "fb"] + [x], 2) @ net.weights["out"] + net.weights["bias"]
        y = np.zeros(mask.shape)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        return (np.where(mask, np.logaddexp(0, z) - y * z, 0)).sum() / mask.sum()

    grads = net.gradients(pages, labels)
    rng = np.random.default_rng(1)
    for name, w in net.weights.items():
        used = np.argwhere(np.abs(grads[name]) > 1e-9)
        for at in map(tuple, used[rng.permutation(len(used))[:4]]):
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            w[at] = kept
            assert abs(slope - grads[name][at]) < 1e-6 + 1e-3 * abs(slope)


def test_generated_pages_not_seen_in_training():
    net, slots, paths = extract.trained(), extract._Slots(), {}
    made = extract.generated(200, 1234)
    got = net.label([extract.numbered(b, slots, paths) for b, _ in made])
    wrong = sum(int((p != y).sum()) for p, (_, y) in zip(got, made))
    assert wrong < 0.01 * sum(len(y) for _, y in made)


def article_of(page):
    """The article of the tables' pages, by their template."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    plain = ("".join(html.unescape(x) if not x.startswith("<") else " " * (x == "<br>") for x in re.split(r"(<[^>]*>)", b)) for b in blocks)
    return " ".join(x for x in (" ".join(b.split()) for b in plain) if x)


def test_tables_pages(spark):
    rows = extract.op6(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    exact = sum(r["text"] == article_of(r["html"]) for r in rows)
    assert exact >= 0.99 * len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


LAYOUT = """<body><header class="site-header"><h2>Site name</h2></header><div id="cookie-banner">We use cookies. Accept all.</div><div class="menu"><a href="/a">Home</a> <a href="/b">About</a></div>
<div class="content"><h1>A title of the story</h1><p>First paragraph of the story, which goes on for a while &amp; ends.</p><p>Second one.</p></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=x>One two</a></li></ul></aside><form action="/s"><p>Subscribe: your email</p></form>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>Great post, thanks for this!</p></div></div><div class="footer">Copyright 2024. All rights reserved</div></body>"""


def test_other_layouts(spark):
    rows = [(1, "u", LAYOUT), (1, "u", LAYOUT), (None, None, LAYOUT), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + "long words go here. " * 20_000), (5, "u", "<nav><a href=/>Home</a></nav>")]
    df = spark.createDataFrame([(*r, "t", None) for r in rows], SCHEMA)
    got = extract.op6(df).collect()
    assert len(got) == len(rows) and extract.op6(df.limit(0)).count() == 0
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == by_id[None] == "A title of the story First paragraph of the story, which goes on for a while & ends. Second one."
    assert by_id[2] == by_id[3] == by_id[5] == "" and len(by_id[4]) == len("long words go here. " * 20_000) - 1
