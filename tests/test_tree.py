"""Trees of HTML against the standard library's XML parser on well-formed pages, and by hand on what isn't."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from parapet.functions import tree as H


def outline(page):
    """name(children) of the body, without attributes."""
    nodes = H.build(page)["nodes"]

    def show(i):
        inner = "".join(show(n["pre"]) for n in nodes if n["parent"] == i)
        return nodes[i]["name"] + (f"({inner})" if inner else "") + ";"

    body = next(n["pre"] for n in nodes if n["name"] == "body")
    return show(body)[:-1]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a<p>b", "body(p;p;)"),
        ("<p><b>a<br><p>c", "body(p(b(br;););p;)"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "body(ul(li;li(ul(li;););li;);)"),
        ("<table><tr><td>a<td>b<tr><td>c</table>x", "body(table(tr(td;td;);tr(td;););)"),
        ("<div><span>a</div>b</span><i>c</i>", "body(div(span;);i;)"),
        ("<a href=x>1<a href=y>2</a>", "body(a;a;)"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "body(dl(dt;dd;dt;);)"),
        ("<p>x<div>y</div>", "body(p;div;)"),
        ("<b><div>x</b>y</div>", "body(b(div;);)"),
        ("<script>if (a<b) '</p>'</script><p>x", "body(p;)"),
        ("text only", "body"),
        ("<html><head><title>t &lt; u</title></head><body class=c><p>x</body></html>after<i>y</i>", "body(p(i;);)"),
        ("< p>no tag</ p><!-- <p> --><br/>", "body(br;)"),
    ],
)
def test_soup(page, want):
    assert outline(page) == want


def made(rng, depth=0):
    name = rng.choice("div section article span em".split())
    inner = "".join(made(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else f"t{rng.randint(0, 99)} " for _ in range(rng.randint(0, 4)))
    return f'<{name} class="{rng.choice("xy")}">{inner}</{name}>'


def test_axes_agree_with_well_formed_trees(spark):
    rng = random.Random(3)
    pages = [f"<html><body>{''.join(made(rng) for _ in range(4))}</body></html>" for _ in range(12)]
    t, col = F.col("t"), F.col
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").repartition(3).withColumn("t", H.tree("html"))
    spans, divs = H.pick(t, "span"), H.pick(t, "div", test=lambda n: n["attributes"]["class"] == "x")
    df = df.select("i", "t", spans.alias("spans"), divs.alias("divs"))
    steps = {axis: H.pick(t, "*", col("divs"), axis) for axis in H.AXES}
    got = df.select("i", F.transform("divs", lambda n: n["pre"]).alias("context"), H.inner_text(t, col("divs")).alias("texts"), *[F.transform(s, lambda n: n["pre"]).alias(a) for a, s in steps.items()], F.transform(H.pick(t, "span", test=lambda n: n["nth"] == 2), lambda n: n["pre"]).alias("second"))
    for r in got.collect():
        root = ET.fromstring(pages[r.i])
        order = list(root.iter())
        number = {e: k for k, e in enumerate(order)}
        parent = {c: p for p in order for c in p}
        under = {e: {number[x] for x in e.iter()} for e in order}
        context = [e for e in order if e.tag == "div" and e.get("class") == "x"]
        assert r.context == [number[e] for e in context]
        assert [x.split() for x in r.texts] == ["".join(e.itertext()).split() for e in context]
        ups = {e: set() for e in order}
        for e in order:
            ups[e] = {number[parent[e]], *ups[parent[e]]} if e in parent else set()
        siblings = lambda e: {number[x] for x in parent[e]} - {number[e]} if e in parent else set()
        want = {
            "child": lambda e: {number[x] for x in e}, "parent": lambda e: {number[parent[e]]}, "self": lambda e: {number[e]}, "descendant": lambda e: under[e] - {number[e]}, "descendant-or-self": lambda e: under[e],
            "ancestor": lambda e: ups[e], "ancestor-or-self": lambda e: ups[e] | {number[e]}, "following": lambda e: {k for k in number.values() if k > max(under[e])},
            "preceding": lambda e: {k for k in number.values() if k < number[e]} - ups[e], "following-sibling": lambda e: {k for k in siblings(e) if k > number[e]}, "preceding-sibling": lambda e: {k for k in siblings(e) if k < number[e]},
        }
        for axis, of in want.items():
            assert r[axis] == sorted(set().union(*map(of, context))), axis
        assert r.second == sorted(number[x[1]] for x in ([c for c in e if c.tag == "span"] for e in order) if len(x) > 1)


def test_texts_and_links(spark):
    page = '<html><head><title>T</title></head><body><h2>Head &amp; <i>ing</i></h2><div><p>one</p><p style="display: none">two <b>deep</b></p><td>x<td>y</div><script>no</script><p><a href=" https://evil.test/x?a=1 ">Click<br>here</a><a>nowhere</a></body></html>'
    t = F.col("t")
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string").withColumn("t", H.tree("html"))
    of = lambda *names: H.details(t, F.col("html"), F.flatten(F.array(*[H.pick(t, n) for n in names])))
    first, null, empty = df.select(of("h2", "div", "b", "body", "a", "title").alias("d")).collect()
    h2, div, b, body, a, nowhere, title = first.d
    assert (h2.raw, h2.inner_text) == ("<h2>Head &amp; <i>ing</i></h2>", "Head & ing")
    assert (div.inner_text, div.display_text) == ("one\ntwo deep\nx y", "one\nx y")
    assert (b.inner_text, b.display_text) == ("deep", "deep")  # asked for itself, it isn't inside what hides it
    assert title.inner_text == ""
    assert body.display_text == "Head & ing\none\nx y\nClick\nherenowhere"
    assert [(x.href, x.url.domain.root_domain, x.text) for x in body.links] == [("https://evil.test/x?a=1", "evil.test", "Click\nhere")] == [(x.href, x.url.domain.root_domain, x.text) for x in a.links]
    assert nowhere.links == [] and null.d is None and empty.d == []


def test_broken_pages_end():
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<div", ">", "</", "<li>", "</ul>", "<table>", "<td>", "</table>", "<a href='", "'>", "</a>", "<!--", "-->", "<script>", "</script>", "x", "&amp", "<body>", "</body>", "<html>", "<head>", "</head>", "<title>", "\x00", '"']
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        found = H.build(page)["nodes"]
        for n in found:
            assert n["pre"] <= n["end"] < len(found) and (n["parent"] < n["pre"]) and n["start"] <= n["stop"] <= len(page)
            assert n["parent"] < 0 or n["end"] <= found[n["parent"]]["end"]


def test_a_batch_of_pages_is_held_in_parts(monkeypatch):
    import gc
    import weakref

    import pyarrow as pa

    class Tree(dict):
        pass

    alive, most, real = weakref.WeakSet(), 0, H.build

    class Seen:
        __hash__ = object.__hash__

    def build(page):
        nonlocal most
        out, seen = Tree(real(page)), Seen()
        out.seen = seen
        alive.add(seen)
        most = max(most, len(alive))
        return out

    monkeypatch.setattr(H, "build", build)
    pages = pa.array(["<p>one</p>" + "x" * 90, None, ""] * 400)
    out = H._trees(pages, held=1000)
    gc.collect()
    assert most <= 40 and len(out) == 1200
    assert out.to_pylist()[:3] == pa.array([real("<p>one</p>" + "x" * 90), None, real("")], H._TREE).to_pylist()
