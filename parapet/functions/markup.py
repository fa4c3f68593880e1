"""Text and links of HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character references that mail uses most.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&euro;": "€", "&amp;": "&"}
HIDDEN = r"""(?is)<(\w+)\b[^>]*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|\shidden[\s>=])[^>]*>.*?</\1>"""


def _plain(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)<(script|style|head|title|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n"), r"<[^>]*>", "")
    for ref, char in REFERENCES.items():
        x = F.replace(x, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\xa0\r]+", " "), r"\s*\n\s*", "\n"))


def parse_html(x: Column) -> Column:
    """struct(raw, inner_text, display_text (without hidden elements), links array of struct(href, text)); null stays null."""
    anchor = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(x, F.lit(anchor), F.lit(2)).alias("text"))
    links = F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.trim(F.regexp_replace(p["text"], r"<[^>]*>", "")).alias("text")))
    return F.when(x.isNotNull(), F.struct(x.alias("raw"), _plain(x).alias("inner_text"), _plain(F.regexp_replace(x, HIDDEN, " ")).alias("display_text"), links.alias("links")))


def xpath_texts(x: Column, path: str) -> Column:
    """Texts that an XPath names, with Spark's own XPath; for well-formed markup."""
    return F.xpath(x, F.lit(path))
