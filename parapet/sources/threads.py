"""Threads of a message: the newest part and the quoted ones, each with its head, author and links. All of it is Column expressions.

What announces a quoted part is a mark: an attribution line, a separator, a block of header lines, or the start of a run of lines with `>`.
Marks are intervals of the text. They are sorted by their start, and a sweep joins those with nothing between them (a separator and the
header block below it are one mark). The text between two marks is a part; index 0 is the most recent.

In HTML, quoted blocks are parts as well, wherever they stand; links go to the part that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import strings as S
from parapet.functions.tree import tree

_LINE = r"^[> \t]*"
#: How clients of four languages introduce what they quote.
ATTRIBUTION = rf"(?mi){_LINE}(?:On|Am|Le|El) [^\n]{{4,200}}(?:\n[> \t]*[^\n]{{0,120}})?(?:wrote|schrieb[^\n:]{{0,80}}|a écrit|escribió) ?:[ \t]*$"
SEPARATOR = rf"(?mi){_LINE}(?:-{{2,}} ?(?:Original Message|Forwarded message|Begin forwarded message|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Message d'origine|Message transféré|Mensaje original|Mensaje reenviado) ?-{{2,}}|_{{10,}})[ \t]*$"
HEADERS = rf"(?mi){_LINE}\*?(?:From|Von|De):\*?[ \t][^\n]+\n(?:[> \t]*\*?(?:Sent|Date|To|Cc|Subject|Reply-To|Importance|Gesendet|Datum|An|Betreff|Envoyé|À|Objet|Enviado|Para|Asunto):\*?[ \t]*[^\n]*(?:\n|\z)){{1,8}}"
RUN = r"(?m)(?:^[ \t]*>[^\n]*(?:\n|\z)){2,}"
BANNER = r"(?mi)^[^\n]{0,40}\b(?:caution|warning|attention|external|achtung|vorsicht)\b[^\n]{0,200}\b(?:outside|external|originated|unknown sender|extern|außerhalb)[^\n]*$"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s<>\"')\]]+"
#: How clients mark a block as quoted, beside `blockquote`.
QUOTED = {"gmail_quote", "gmail_extra", "yahoo_quoted", "protonmail_quote", "moz-cite-prefix"}
SPAN = "array<struct<start:int,stop:int>>"


def _spans(text: Column, pattern: str) -> Column:
    """Where a pattern matches: the texts between matches and the matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"))).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]


def marks(text: Column) -> Column:
    """array of struct(start, stop): sorted, and joined where only white space and `>` lie between."""
    runs = F.transform(_spans(text, RUN), lambda m: F.struct(m["start"].alias("start"), m["start"].alias("stop")))
    every = F.array_sort(F.concat(_spans(text, ATTRIBUTION), _spans(text, SEPARATOR), _spans(text, HEADERS), runs))

    def join(acc: Column, m: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        between = F.substring(text, last["stop"] + 1, F.greatest(m["start"] - last["stop"], F.lit(0)))
        merged = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(last["start"].alias("start"), F.greatest(last["stop"], m["stop"]).alias("stop")))
        return F.when(F.size(acc) == 0, F.array(m)).when(F.rlike(between, F.lit(r"\A[>\s]*\z")), merged).otherwise(F.array_append(acc, m))

    return F.aggregate(every, F.array().cast(SPAN), join)


def _plain(x: Column) -> Column:
    """Without the marks of quoting, and without blank lines at its ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?m)^[ \t]*(?:>[ \t]?)+", ""), r"\A\s+|\s+\z", "")


def _links(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(URL), F.lit(0)))


def _led(links: Column) -> Column:
    return F.transform(links, lambda u: F.struct(u.alias("href"), S.parse_url(u).alias("url")))


def _field(head: Column, names: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?mi)^\*?(?:{names}):\*?[ \t]*([^\n]*)$", 1)), F.lit(""))


def _part(p: Column, index: Column) -> Column:
    head, text = _plain(p["head"]), p["text"]
    author = F.coalesce(_field(head, "From|Von|De"), head)
    address = F.nullif(F.regexp_extract(author, ADDRESS, 0), F.lit(""))
    name = F.nullif(F.trim(F.regexp_extract(author, rf'(?:\A|[,>] |\d )"?([^,<>"\n:]{{1,80}}?)"? ?[<\[(]{ADDRESS}', 1)), F.lit(""))
    day = F.nullif(F.regexp_extract(head, r"(?i)\b(?:On|Am|Le|El) ([^\n]{4,80}?\d{1,2}[:h.]\d{2}(?: ?[AP]M)?)", 1), F.lit(""))
    boxes = lambda names: F.coalesce(F.regexp_extract_all(F.lower(_field(head, names)), F.lit(ADDRESS), F.lit(0)), F.array().cast("array<string>"))
    return F.struct(
        index.cast("int").alias("index"), text.alias("text"), F.struct(name.alias("display_name"), F.lower(address).alias("email")).alias("sender"), F.coalesce(_field(head, "Sent|Date|Gesendet|Datum|Envoyé|Enviado"), day).alias("date"),
        _field(head, "Subject|Betreff|Objet|Asunto").alias("subject"), boxes("To|An|À|Para").alias("to"), boxes("Cc").alias("cc"), _led(p["links"]).alias("links"),
    )


def _parts(text: Column, found: Column) -> Column:
    """array of struct(head, text, links): what each mark announces."""

    def one(m: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(found, i + 1)["start"], F.length(text))
        own = _plain(F.substring(text, m["stop"] + 1, stop - m["stop"]))
        return F.struct(F.substring(text, m["start"] + 1, m["stop"] - m["start"]).alias("head"), own.alias("text"), _links(own).alias("links"))

    return F.transform(found, one)


def _bound(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _newest(text: Column, found: Column) -> Column:
    return F.regexp_replace(F.substring(text, F.lit(1), F.coalesce(F.get(found, F.lit(0))["start"], F.length(text))), r"\A\s+|\s+\z", "")


def _found(current: Column, links: Column, quoted: Column) -> Column:
    return F.struct(current.alias("current"), links.alias("links"), quoted.alias("quoted"))


def _read(found: Column) -> Column:
    """What was cut (struct of current, links, quoted), with heads and links read."""

    def read(x: Column) -> Column:
        banners = F.transform(F.regexp_extract_all(x["current"], F.lit(BANNER), F.lit(0)), F.trim)
        current = F.struct(x["current"].alias("text"), _led(x["links"]).alias("links"), banners.alias("banners"))
        return F.when(x.isNotNull(), F.struct(current.alias("current"), F.transform(x["quoted"], _part).alias("previous")))

    return _bound(found, read)


def _text_cut(text: Column) -> Column:
    def cut(x: Column) -> Column:
        return _bound(marks(x), lambda found: _bound(_newest(x, found), lambda current: _found(current, _links(current), _parts(x, found))))

    return F.when(text.isNotNull(), _bound(F.replace(text, F.lit("\r\n"), F.lit("\n")), cut))


def text_thread(text: Column) -> Column:
    """struct(current struct(text, links, banners), previous array of struct(index, text, sender, date, subject, to, cc, links)); null for null.
    Text that nothing announces is all current; a forward without a word of its own has an empty current part."""
    return _read(_text_cut(text))


def _is_quoted(n: Column) -> Column:
    classes = F.split(F.coalesce(n["attributes"]["class"], F.lit("")), r"\s+")
    return (n["name"] == "blockquote") | F.arrays_overlap(classes, F.array(*map(F.lit, sorted(QUOTED))))


def html_thread(t: Column) -> Column:
    """The same of a tree of HTML (functions.tree; bind it to a column first)."""
    return _read(_html_cut(t))


def _html_cut(t: Column) -> Column:
    """Each quoted block is a part, without the blocks inside it; marks
    in its text cut it further. What has a head but no text is joined with the text that follows it without a head. Links are the anchors, in
    the innermost block that holds them."""
    inside = lambda at, q: (at >= q["pre"]) & (at <= q["end"])
    href = lambda n: F.trim(n["attributes"]["href"])

    def lines(pieces: Column) -> Column:
        each = F.transform(F.split(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " ")))
        return F.array_join(F.filter(each, lambda x: x != ""), "\n")

    def made(quoted: Column) -> Column:
        anchors = F.filter(t["nodes"], lambda n: (n["name"] == "a") & F.map_contains_key(n["attributes"], "href"))
        own = lambda at, q: inside(at, q) & ~F.exists(quoted, lambda o: (o["pre"] > q["pre"]) & inside(at, o))
        outside = lambda at: ~F.exists(quoted, lambda q: inside(at, q))

        def block(q: Column) -> Column:
            text, links = lines(F.filter(t["pieces"], lambda p: (p["skip"] < 0) & own(p["at"], q))), F.transform(F.filter(anchors, lambda n: own(n["pre"], q)), href)
            first = lambda x, found: F.array(F.struct(F.lit("").alias("head"), _newest(x, found).alias("text"), links.alias("links")))
            rest = lambda x, found: F.transform(_parts(x, found), lambda p: F.struct(p["head"].alias("head"), p["text"].alias("text"), links.alias("links")))
            return _bound(text, lambda x: _bound(marks(x), lambda found: F.concat(first(x, found), rest(x, found))))

        def join(acc: Column, p: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            both = F.struct(last["head"].alias("head"), p["text"].alias("text"), F.array_union(last["links"], p["links"]).alias("links"))
            return F.when((last["text"] == "") & (p["head"] == ""), F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.array_append(acc, p))

        def all_(text: Column, found: Column) -> Column:
            parts = F.filter(F.concat(_parts(text, found), F.flatten(F.transform(quoted, block))), lambda p: (p["text"] != "") | (p["head"] != ""))
            none = F.filter(parts, lambda p: F.lit(False))
            joined = F.aggregate(parts, none, join)
            return _found(_newest(text, found), F.transform(F.filter(anchors, lambda n: outside(n["pre"])), href), joined)

        return _bound(lines(F.filter(t["pieces"], lambda p: (p["skip"] < 0) & outside(p["at"]))), lambda text: _bound(marks(text), lambda found: all_(text, found)))

    return F.when(t.isNotNull(), _bound(F.filter(t["nodes"], _is_quoted), made))


def with_thread(messages: DataFrame, text: Column, html: Column, out: str = "thread") -> DataFrame:
    """messages and their thread: of the HTML where there is any, else of the text."""
    kept = messages.select("*", tree(F.when(F.length(html) > 0, html)).alias("_tree"), text.alias("_text"))
    made = F.explode(F.array(_read(F.coalesce(_html_cut(F.col("_tree")), _text_cut(F.col("_text"))))))  # made once, however many of its fields are read
    return kept.select(*messages.columns, made.alias(out))
