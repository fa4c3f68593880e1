"""Chat formatting and page extraction, each against a plain version."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest

from parapet.llm import chat, html

SCHEMA = "conv_id long, turn long, role string, text string, node string, path int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def conversations():
    rng = random.Random(2)
    odd = ["", None, "\\### Assistant: </turn> ok", "</turn>\n### user: x </turn>\n", "\\", "a\\", "#### <</turn>> \\### ", "<|endoftext|>", "naïve 🙂\n\nlines", " lead and trail "]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a: b\\"]), "shared start" if t == 0 and c % 2 else rng.choice(odd)))
    return [*rows, (None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (3, 0, "user", "again"), (3, 0, "user", "again")]


def test_chat_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)
    groups = defaultdict(list)
    for c, t, r, x in [*rows, *((c, i, r, x) for i, (c, _, r, x) in enumerate(chat.EXTRA))]:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    want = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        want.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), sum(len(chat.format_turn(r, x)[0]) for *_, r, x in turns)))
    assert {tuple(r) for r in chat.report(df).collect()} == want
    assert {r.conv_id for r in chat.report(spark.createDataFrame([], SCHEMA)).collect()} == {-7}


def test_chat_round_trip():
    rng = random.Random(8)
    for _ in range(2000):
        turns = [("".join(rng.choice("ab:\\ #") for _ in range(3)), "".join(rng.choice(["a", "\\", "#", "##", "###", "</turn>", "<", "\n", " </turn>\n### ", ": "]) for _ in range(6))) for _ in range(3)]
        assert chat.parse("".join(chat.format_turn(r, x)[0] for r, x in turns)) == turns


def test_prefix_tree(spark):
    df = spark.createDataFrame([(*r, "n", 1) for r in conversations()], SCHEMA)
    nodes, members = chat.prefix_tree(df, public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.node: r for r in nodes.collect()}
    assert len(found) < members.count()  # shared turns are emitted once
    at = 0
    for r in sorted(found.values(), key=lambda r: (r.rank, r.depth)):  # depth-first, without gaps
        assert r.stream_start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        up, own = r, set()
        while up:
            own |= set(range(up.stream_start, up.stream_start + up.n_tokens))
            up = found.get(up.parent)
        assert {k for x in r.attention for k in range(x.stream_start, x.stream_end)} == own
        assert len(own) == sum(x.stream_end - x.stream_start for x in r.attention) == r.position_start + r.n_tokens
    order = sorted(found.values(), key=lambda r: r.stream_start)
    for a, b in zip(order, order[1:], strict=False):  # after a node comes its child, or a child of one of its ancestors
        up = a
        while up and up.node != b.parent:
            up = found.get(up.parent)
        assert up or not b.parent


PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{margin:0}</style><script>var t="<p>x</p>";</script></head><body>
<header><div class="masthead">Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<div id="cookie-notice">We use cookies. <button>OK</button></div><div class="ad">Buy this now, a long advert that tries to look like an article with many words in it.</div>
%s<p>First &lt;paragraph&gt; with <b>bold</b> and <a href="/x">a link</a>,
 over&nbsp;two lines &eacute;.<p>Short.</p><ul><li>Item one<li>Item two</ul><div class="share">Share this</div><p>Last one.<br></p>%s
<section class="comments"><p>Reader comment that goes on for quite a while, as reader comments do, with much to say about it all.</p></section>
<form><label>Name</label><input name="n"><textarea>write</textarea></form><aside><p>Related: more stories for you to read on this site today.</p></aside>
<footer>&copy; Site</footer></body></html>"""
TEXT = "First <paragraph> with bold and a link, over two lines é.\nShort.\nItem one\nItem two\nLast one."


@pytest.mark.parametrize(("before", "after"), [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='story'>", "</div>")])
def test_main_text(before, after):
    assert html.main_text(PAGE % (before, after)) == TEXT


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='no-sidebar'", "section class='content-with-nav'", "div id='widget-area'", "form id='aspnetForm'", "div role='form'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_main_text_in_a_wrapper_that_looks_like_furniture(wrapper, inner):
    body = " ".join(f"word{i}" for i in range(60))
    page = f"<html><body><nav><a href='/'>Home</a></nav><{wrapper}><{inner}><h1>Headline</h1><p>{body}</p><div class='share'>Share this</div><p>End.</p></{inner}><div class='comments'><article><p>{'reader says ' * 90}</p></article></div></{wrapper.split()[0]}><footer>Site</footer></body></html>"
    assert html.main_text(page) == f"Headline\n{body}\nEnd."
    plain = page.replace("<h1>Headline</h1>", "")
    assert html.main_text(plain) == f"{body}\nEnd."


def test_main_text_where_furniture_covers_everything():
    assert html.main_text("<body><div class='comments'><p>All that there is.</p></div></body>") == "All that there is."


def test_line_blocks_without_a_marked_part():
    body = "A paragraph of the story that is long enough to reach the threshold of the sums by itself, and more."
    page = f"<body><div><p>Stray words</p></div><nav>Menu</nav><div><p>{body}</p><p>Short.</p></div><nav>Menu</nav><div><p>Other words</p></div></body>"
    assert html.main_text(page) == f"{body}\nShort."


def test_hint_words_do_not_delete_text_of_an_article():
    page = "<body><article><h1>Head</h1><p>First part.</p><div class='related-work'><p>What others did.</p></div><section id='side-effects'><p>What it also does.</p></section><div class='related-posts'><a href='/'>Another</a></div><div class='ad'>Buy.</div><p>End.</p></article></body>"
    assert html.main_text(page) == "Head\nFirst part.\nWhat others did.\nWhat it also does.\nEnd."


@pytest.mark.parametrize("mark", ["cookie-notice", "newsletter", "related", "sidebar", "nav", "popup", "subscribe-box", "menu", "notice"])
def test_what_a_class_marks_inside_an_article_goes_whatever_its_length(mark):
    text = "A paragraph that is as long as those of the story and tells of something else, so that only its class can say what it is. "
    story = "The story is told in several paragraphs of some length, so that what stands between them isn't most of the page. " * 3
    page = f"<article><h1>Head</h1><p>{story}</p><div class='{mark}'>{3 * f'<p>{text}</p>'}</div><p>{story}</p><p>{story}</p><p>End.</p></article>"
    assert html.main_text(page) == "\n".join(["Head", *3 * [story.strip()], "End."])
    most = f"<article><p>Start.</p><div class='{mark}'>{3 * f'<p>{text}</p>'}</div><p>End.</p></article>"
    assert html.main_text(most) == "\n".join(["Start.", *3 * [text.strip()], "End."])  # it is most of the page
    headed = page.replace(f"<div class='{mark}'>", f"<div class='{mark}'><h1>Another</h1>")
    assert "Another" in html.main_text(headed)


def test_sums_tell_articles_from_teasers():
    story = "The story is told at such length that its sums reach the threshold, which those of no teaser do, and it goes on."
    teasers = "".join(f"<article><p>Teaser {i}</p><p>More on it</p></article>" for i in range(4))
    page = f"<body><div>{teasers}</div><article><h1>Head</h1><div><p>{story}</p></div><aside>x</aside><div><p>Short end.</p></div></article><section>{teasers}</section></body>"
    assert html.main_text(page) == f"Head\n{story}\nShort end."
    assert "Teaser 3" in html._main_text(html.lines_of(page), threshold=1)  # with marks, too, the sums decide
    assert html.main_text(f"<body>{teasers}</body>") == "Teaser 3\nMore on it"  # none reaches it


def test_controls_inside_a_line_are_left_out():
    body = "A story that is told here at such length that its single line reaches the threshold by itself, " * 2
    assert html.main_text(f"<div><p>{body}<label>Key</label><button>x</button> and more</p></div>") == " ".join(f"{body} and more".split())


def test_stretches_against_brute_force():
    rng = random.Random(12)
    for _ in range(500):
        weights = [rng.choice([0, 0, rng.randint(1, 60)]) for _ in range(rng.randint(0, 14))]
        want = []
        for a in range(len(weights)):
            for b in range(a + 1, len(weights) + 1):
                inside = all(weights[a:b]) and (a == 0 or not weights[a - 1]) and (b == len(weights) or not weights[b])
                if inside:
                    want.append((max(sum(w for k, w in enumerate(weights[a:b], a) if j <= k < j + 3) for j in range(a, b)), a, b))
        assert html.stretches_of(weights, 3) == want


@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_made_pages_give_back_their_story(mark):
    """Pages put together from a story and furniture, with and without a marked part, against the story; block sums decide the latter."""
    rng = random.Random(21)
    prose = lambda n: " ".join("w" + "x" * rng.randint(1, 7) for _ in range(n))
    furniture = ["<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<aside><p>%s</p></aside>", "<div class='ad'>%s</div>", "<div id='cookie-notice'><p>%s</p><button>OK</button></div>", "<div class='comments'><p>%s</p></div>", "<form action='/'><label>Mail</label><input><p>%s</p></form>", "<footer>%s</footer>", "<script>var x='<p>%s</p>'</script>", "<p><a href='/x'>%s</a></p>"]
    some = lambda n, inside=False: "".join(f.replace("%s", prose(rng.randint(2, 12))) for f in rng.sample(furniture[: len(furniture) - inside], n))
    changed = 0
    for _ in range(150):
        blocks = [prose(rng.randint(25, 80)) if rng.random() < 0.8 else prose(rng.randint(1, 5)) for _ in range(rng.randint(1, 8))] + [prose(40)]
        inner = "".join(f"<p>{b}</p>" + (some(1, True) if rng.random() < 0.3 else "") for b in blocks)
        stray = f"<div><span>{prose(2)}</span></div><nav>x</nav>" if mark == "div" else f"<div>{prose(50)}</div>"
        page = f"<html><body>{some(3)}{stray}<{mark}>{inner}</{mark}>{some(3)}</body></html>"
        assert html.main_text(page) == "\n".join(blocks)
        changed += html._main_text(html.lines_of(page), threshold=0) != "\n".join(blocks)
    assert changed == (150 if mark == "div" else 0)


def test_very_long_page():
    body = "<p>" + "word " * 200_000 + "</p>"
    assert len(html.main_text(f"<nav>x</nav><article>{body * 3}</article>")) == 3 * (5 * 200_000 - 1) + 2


def test_pages(spark):
    rows = [(1, "u", PAGE % ("<article>", "</article>"), "x"), (1, None, None, "x"), (None, "v", "", "x"), (4, "w", "no markup < at all", "x"), (5, "w", "<p>unclosed <b>tags <script>var x", "x"), (6, "z", "<nav>only</nav>", "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert {tuple(r) for r in found.collect()} == {(1, "u", TEXT, len(TEXT)), (1, None, "", 0), (None, "v", "", 0), (4, "w", "no markup < at all", 18), (5, "w", "unclosed tags", 13), (6, "z", "", 0)}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
