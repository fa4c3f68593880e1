"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order. Each line has a weight: the length of its text; nothing if it is
page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments: by element, by class, id or role, or because most
of the line is links). Where a page marks its article, or else its main part, lines outside weigh nothing and those inside
`THRESHOLD` more than their text. Weights are summed over a sliding window of lines. A surge point is where lines with weight begin,
its dive point where the next line without weight follows; the text between is kept whole, short lines included, if its sums reach
the threshold. On a page without marks, a stretch below it is kept if it stands in the container of a kept one (it follows a gap
inside the text). If nothing reaches the threshold, the stretch with the largest sum is taken.

A form, or an element that only its class, id or role makes furniture, is judged by what it holds: it stays if that is the main part, the
first article, a headline with text, or most of the text of the page (adverts and comments: only the first or the third). Inside the
marked part a form also stays if its own sums reach three times the threshold; what a class, id or role makes furniture goes there
whatever its length. A class or id counts if all of its
parts are words of furniture or layout: `related-posts` does, `related-work` doesn't. If furniture covers everything, such elements stay.

A null page has no text, nor has one without any. Rows are taken each on its own; page_id and url are passed on, null or repeated. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm._shared import texts_of

#: Element names of HTML by their part in a page.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg canvas object select".split())
FURNITURE = set("nav footer aside button head dialog menu label noscript".split())
FORMS = {"form", "fieldset"}
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: Words of class and id names: of furniture, of page furniture that an article may have too, of lists beside the text, of layout.
HINTS = set("banner cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager related recommended share sharing social newsletter subscribe subscription signup login search popup modal overlay notice notices alert widget skip".split())
PAGE_HINTS = set("toolbar topbar masthead header footer foot copyright".split())
LISTS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus respond replies".split())
LAYOUT = set("area article articles bar block bottom box btn button buttons col column container content desktop div field first footer form global group head header icon icons id inner item items js last left line link links list main mobile module more news outer page panel post posts primary recent right row section site slot stories story text thread title to top unit wrap wrapper zone".split())
NAME_PARTS = re.compile(r"[A-Za-z]+")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CONTAINERS = {"div", "section", "td", "body", "article", "main"}
WINDOW, THRESHOLD, LINKS = 3, 80, 0.6


HARD, MAYBE, LISTING, FORM = 1, 2, 3, 4


def _is_furniture(name: str, attributes: str, inside: bool) -> int:
    """0, HARD, or what the element's content must confirm: MAYBE, LISTING, FORM."""
    if name in FURNITURE or (name == "header" and not inside):
        return HARD
    form = FORM * (name in FORMS)
    if not attributes or name in ("html", "body", "main"):
        return form
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return HARD
    names = [{w.lower() for w in NAME_PARTS.findall(x)} for a in ("class", "id") for x in found.get(a, "").split()]
    if any(x & LISTS and x <= LISTS | HINTS | PAGE_HINTS | LAYOUT for x in names):
        return LISTING
    words = HINTS if inside else HINTS | PAGE_HINTS
    hinted = found.get("role", "").lower() in ROLES or any(x & words and x <= HINTS | PAGE_HINTS | LAYOUT for x in names)
    return MAYBE if hinted else form


def _confirmed(lines: list, kinds: list[int], holds: list[set[str]], marked: list[bool]) -> set[int]:
    """Which of the elements in doubt are furniture, by what they hold; marked: those that lie in the marked part."""
    sizes, peaks = [0] * len(kinds), [0] * len(kinds)
    for i, (text, hard, within, *_) in enumerate(lines):
        for e in within:
            if not hard:
                sizes[e] += len(text)
            if marked[e]:
                peaks[e] = max(peaks[e], sum(len(x[0]) for x in lines[i : i + WINDOW] if not x[1] and e in x[2]))
    out = {e for e, h in enumerate(holds) if not ("main" in h or ("h1" in h and sizes[e] >= THRESHOLD) or (kinds[e] == FORM and peaks[e] >= 3 * THRESHOLD))}
    listings = {e for e in out if kinds[e] == LISTING}
    total = sum(len(x[0]) for x in lines if not x[1] and listings.isdisjoint(x[2]))
    return {e for e in out if e in listings or not ("article" in holds[e] or 2 * sizes[e] > total)}


def lines_of(page: str, doubts: bool = True) -> list[tuple[str, bool, bool, bool, int]]:
    """(text, furniture, in an article, in the main part, where the enclosing container starts) of each block; without doubts only
    sure furniture counts."""
    out: list[tuple[str, bool, tuple[int, ...], bool, bool, int]] = []
    stack: list[tuple[str, int]] = []
    containers = [0]
    parts: list[tuple[str, bool, bool]] = []  # text, in furniture, in a link
    counts = {"furniture": 0, "article": 0, "main": 0, "a": 0}
    kinds: list[int] = []
    holds: list[set[str]] = []
    marked: list[bool] = []
    within: list[int] = []
    articles, top = 0, 0  # top: where the outermost open article starts

    def close_line() -> None:
        hard = all(f for t, f, _ in parts if t.strip())
        own = [(t, k) for t, f, k in parts if hard or not f]  # furniture in the middle of a line is left out of it
        text = " ".join(entities.unescape("".join(t for t, _ in own)).split())
        if text:
            linked = sum(len(t) for t, k in own if k)
            out.append((text, hard or (counts["article"] + counts["main"] == 0 and linked > LINKS * len(text)), tuple(within), counts["article"] > 0, counts["main"] > 0, top if counts["article"] else containers[-1]))
        parts.clear()

    def shift(name: str, furniture: int, by: int) -> None:
        counts["furniture"] += by * (furniture == HARD)
        if name in ("article", "main", "a"):
            counts[name] += by

    def pop() -> str:
        name, furniture = stack.pop()
        shift(name, furniture, -1)
        if furniture > HARD:
            within.pop()
        if name in CONTAINERS:
            containers.pop()
        return name

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            if not m[0].startswith(("<!", "<?")):
                parts.append((m[0], counts["furniture"] > 0, counts["a"] > 0))
            continue
        block = name in BLOCKS
        if block:
            close_line()
        elif name == "br":
            parts.append((" ", counts["furniture"] > 0, False))
        if m[1]:
            if any(n == name for n, _ in stack):
                while pop() != name:
                    pass
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if name == "a":
            while counts["a"] and stack and stack[-1][0] == "a":
                pop()
        if block and name == "p":  # an open paragraph ends here even below inline elements
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if depth >= 0 and stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        furniture = _is_furniture(name, m[3], counts["article"] + counts["main"] > 0)
        stack.append((name, furniture))
        if name in CONTAINERS:
            containers.append(at)
        top = at if name == "article" and not counts["article"] else top
        shift(name, furniture, 1)
        if furniture > HARD:
            within.append(len(kinds))
            kinds.append(furniture)
            holds.append(set())
            marked.append(counts["article"] + counts["main"] > (name in ("article", "main")))
        if counts["furniture"] == 0 and (name in ("main", "h1") or (name == "article" and not articles)):
            for e in within:
                holds[e].add(name)
        articles += name == "article" and not any(kinds[e] == LISTING for e in within)
    close_line()
    gone = _confirmed(out, kinds, holds, marked) if doubts else set()
    return [(text, hard or not gone.isdisjoint(inside), *rest) for text, hard, inside, *rest in out]


def main_text(page: str) -> str:
    return _main_text(lines_of(page)) or _main_text(lines_of(page, doubts=False))


def weights_of(lines: list[tuple[str, bool, bool, bool, int]]) -> list[int]:
    for place in (2, 3):
        if any(x[place] and not x[1] for x in lines):
            return [0 if x[1] or not x[place] else len(x[0]) for x in lines]
    return [0 if x[1] else len(x[0]) for x in lines]


def stretches_of(weights: list[int], window: int, parts: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(largest sum, surge, dive) of each stretch of lines with weight, and of one part; a window ends with its stretch."""
    out, start = [], None
    for i, w in enumerate([*weights, 0]):
        if start is not None and (not w or (parts and parts[i] != parts[start])):
            out.append((max(sum(weights[j : min(j + window, i)]) for j in range(start, i)), start, i))
            start = None
        if w and start is None:
            start = i
    return out


def _main_text(lines: list[tuple[str, bool, bool, bool, int]], window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    stretches = stretches_of(weights_of(lines), window, [x[4] if x[2] else -1 for x in lines])
    if not stretches:
        return ""
    kept = [s for s in stretches if s[0] >= threshold] or [max(stretches)]
    held = {lines[i][4] for _, a, b in kept for i in range(a, b)}
    kept = [s for s in stretches if s in kept or any(lines[i][4] in held for i in range(s[1], s[2]))]
    return "\n".join(lines[i][0] for _, a, b in kept for i in range(a, b))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x) for x in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
