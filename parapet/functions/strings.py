"""String functions. A null source, or needles that are all null, gives null; null needles beside others are ignored."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.functions.suffixes import suffix_labels


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(None).cast("boolean")


def contains(x: Column, *needles: str, fold: bool = False) -> Column:
    x = F.lower(x) if fold else x
    return _any([F.contains(x, F.lit(n.lower() if fold else n)) for n in needles if n is not None])


def starts_with(x: Column, *needles: str, fold: bool = False) -> Column:
    x = F.lower(x) if fold else x
    return _any([F.startswith(x, F.lit(n.lower() if fold else n)) for n in needles if n is not None])


def ends_with(x: Column, *needles: str, fold: bool = False) -> Column:
    x = F.lower(x) if fold else x
    return _any([F.endswith(x, F.lit(n.lower() if fold else n)) for n in needles if n is not None])


def glob(x: Column, *patterns: str, fold: bool = False) -> Column:
    """Whole-string match with * and ?; no escapes."""
    turned = ["(?s)" + ("(?iu)" if fold else "") + r"\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + r"\z" for p in patterns if p is not None]
    return _any([F.rlike(x, F.lit(t)) for t in turned])


def count(x: Column, needle: str, fold: bool = False) -> Column:
    """Non-overlapping occurrences; an empty needle has none."""
    if not needle:
        return F.when(x.isNotNull(), F.lit(0))
    x, needle = (F.lower(x), needle.lower()) if fold else (x, needle)
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def distance(a: Column, b: Column, fold: bool = False) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b)) if fold else F.levenshtein(a, b)


def slice_text(x: Column, low: int, high: int) -> Column:
    """Code points low..high-1, bounds clamped."""
    return F.substring(x, F.lit(max(low, 0) + 1), F.lit(max(high - max(low, 0), 0)))


#: Letters of other scripts and forms that look like Latin ones, and dashes (from Unicode's confusables), and what they look like.
CONFUSABLE = "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικ" + "ıɡɑᴏѵⅰⅴⅹⅼⅽⅾⅿ" + "‐‑‒–—―−"
LOOKS_LIKE = "aeopcyxijsdqwhlABEKMHOPCTXISJABEZHIKMNOPTYXavopik" + "igaovivxlcdm" + "-------"


def replace_confusables(x: Column) -> Column:
    """Look-alike letters to Latin, full-width forms to ASCII."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    return F.translate(x, CONFUSABLE + wide, LOOKS_LIKE + "".join(chr(c) for c in range(0x21, 0x7F)))


def parse_float(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def parse_json(x: Column) -> Column:
    return F.try_parse_json(x)


def json_path(x: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(x), path, kind)


def json_values(x: Column, path: str) -> Column:
    """array of text: what a path with any number of `[*]` finds in JSON text, in order; an array within the row is opened for each wildcard, so
    no row moves. What isn't there, or is no array where one is opened, gives nothing; text that is no JSON gives null."""
    *opened, last = [p if p.startswith("$") else "$" + p for p in path.split("[*]")]
    none = F.array().cast("array<variant>")
    found = F.array(F.try_parse_json(x))

    def items(part: str):
        return lambda v: F.coalesce(F.try_variant_get(v, part, "array<variant>"), none)

    for part in opened:
        found = F.flatten(F.transform(found, items(part)))
    return F.when(F.try_parse_json(x).isNotNull(), F.filter(F.transform(found, lambda v: F.try_variant_get(v, last, "string")), lambda s: s.isNotNull()))


def decode_hex(x: Column) -> Column:
    return F.try_to_binary(x, F.lit("hex")).try_cast("string")


def decode_base64(x: Column, url: bool = False) -> Column:
    """Padding may be left out; text that isn't base64 gives null."""
    plain = F.translate(x, "-_", "+/") if url else x
    padded = F.rpad(F.rtrim(plain), (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).try_cast("string")


def scan_base64(x: Column) -> Column:
    """Decoded runs of at least 16 base64 characters that are mostly printable."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9+/]{16,}={0,2}"), F.lit(0)), lambda run: decode_base64(run))
    printable = lambda s: F.length(F.regexp_replace(s, r"[^\x20-\x7e\n\r\t]", "")) > 0.85 * F.length(s)
    return F.filter(found, lambda s: s.isNotNull() & printable(s))


concat = F.concat
sha256, sha1, md5 = (lambda x: F.sha2(x, 256)), F.sha1, F.md5


def parse_email(x: Column) -> Column:
    """struct(email, local_part, domain): lower-cased, cut at the last @; without one only the local part."""
    low = F.lower(F.trim(x))
    at = F.contains(low, F.lit("@"))
    domain = F.when(at, F.substring_index(low, "@", -1))
    local = F.when(at, F.substring(low, F.lit(1), F.length(low) - F.length(domain) - 1)).otherwise(low)
    return F.when(x.isNotNull(), F.struct(F.when(at, low).alias("email"), local.alias("local_part"), domain.alias("domain")))


#: Two-label public suffixes that are known without a list of rules; the default rule takes the last label.
SUFFIXES = "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au co.nz co.jp or.jp ne.jp com.br com.mx com.cn com.tr co.in co.za co.kr com.sg com.hk com.tw com.ar".split()


def parse_domain(x: Column, rules: list[str] | None = None) -> Column:
    """struct(domain, tld, sld, root_domain, subdomain, punycode); null for text with a space, / or @. rules: public suffixes as
    sources.tables.read_suffixes gives them. A host that is a suffix itself has neither sld nor root domain."""
    low = F.lower(F.rtrim(x, F.lit(".")))
    labels = F.split(low, r"\.")
    if rules is None:
        taken = F.when(F.substring_index(low, ".", -2).isin(*SUFFIXES), 2).otherwise(1)
    else:
        taken = suffix_labels(low, rules)
    tld = F.array_join(F.slice(labels, F.greatest(F.size(labels) - taken + 1, F.lit(1)), taken), ".")
    sld = F.get(labels, F.size(labels) - 1 - taken)
    root = F.when(sld.isNotNull(), F.concat(sld, F.lit("."), tld))
    sub = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1 - taken, F.lit(0))), ".")
    valid = x.isNotNull() & ~F.rlike(x, F.lit(r"[\s/@]")) & (F.length(x) > 0)
    return F.when(valid, F.struct(low.alias("domain"), tld.alias("tld"), sld.alias("sld"), root.alias("root_domain"), sub.alias("subdomain"), F.contains(low, F.lit("xn--")).alias("punycode")))


URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/@:?#]*)(?::([^/@?#]*))?@)?(\[[^\]]*\]|[^/:?#]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parse_url(x: Column, rules: list[str] | None = None) -> Column:
    """struct(scheme, username, password, host, port, path, query_params, fragment, ip, domain); null if it is no URL. A host that is
    an address is in `ip`, not in `domain`. rules: as of parse_domain."""
    part = lambda i: F.nullif(F.regexp_extract(x, URL, i), F.lit(""))
    host = F.lower(part(4))
    ip = F.when(F.rlike(host, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")), host)
    return F.when(F.rlike(x, F.lit(URL)), F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("username"), part(3).alias("password"), host.alias("host"), part(5).try_cast("int").alias("port"), part(6).alias("path"), part(7).alias("query_params"), part(8).alias("fragment"), ip.alias("ip"), F.when(ip.isNull(), parse_domain(host, rules)).alias("domain")))


def query_map(query: Column) -> Column:
    """map of decoded name -> array of decoded values, from a query string."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    parts = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    names = F.array_distinct(F.transform(parts, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(parts, lambda p: p["k"] == n), lambda p: p["v"])))
