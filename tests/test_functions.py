"""Null rules and edge cases of the functions."""

import pytest
from pyspark.sql import functions as F

from parapet.functions import arrays as A
from parapet.functions import logic as L
from parapet.functions import network as N
from parapet.functions import regex as R
from parapet.functions import strings as S
from parapet.operators import scoring, sensitive

def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_three_values(spark):
    T, X, N0 = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert values(spark, (L.answer(X) & N0).value, (L.answer(T) & N0).value, (L.answer(T) | N0).value, (L.answer(X) | N0).value, (~L.answer(N0)).value) == (False, None, True, None, None)
    of = lambda n, *p: L.at_least(n, *p).value
    assert values(spark, of(1, T, N0), of(2, T, N0), of(1, X, N0), of(1, X, X), of(2, T, T, N0), L.none_of(X, N0).value, L.all_of(T, T).value) == (True, None, None, False, True, None, True)
    null = F.lit(None).cast("int")
    assert values(spark, L.between(null, F.lit(5), F.lit(1)), L.between(F.lit(1), F.lit(5), F.lit(5)), L.in_array(F.lit(1), F.array(F.lit(2), null)), L.in_array(F.lit(2), F.array(F.lit(2), null))) == (None, True, None, True)
    assert values(spark, L.int_div(F.lit(-5), F.lit(2)), L.int_div(F.lit(5), F.lit(0)), L.int_mod(F.lit(7), F.lit(3)), L.int_mod(F.lit(7), F.lit(0))) == (-2, None, 1, None)


def test_missing_evidence(spark):
    T, X = F.lit(True), F.lit(False)
    gone = L.unavailable("whois")
    row = lambda a: (a.verdict, a.names)
    assert values(spark, *row(gone & X)) == ("indeterminate", ["whois"])  # asked before it was decided
    assert values(spark, *row(L.answer(X) & gone)) == ("no-match", [])  # not asked
    assert values(spark, *row(gone | T)) == ("match", ["whois"])
    assert values(spark, *row(L.answer(T) | gone)) == ("match", [])
    assert values(spark, *row(L.at_least(1, T, gone))) == ("match", [])
    assert values(spark, *row(L.at_least(2, T, gone, X))) == ("indeterminate", ["whois"])
    assert values(spark, *row(L.in_list(F.lit("a"), None, "vips"))) == ("indeterminate", ["$vips"])
    assert values(spark, L.in_list(F.lit("A"), ["a"], "x").value, L.in_list(F.lit(None).cast("string"), ["a"], "x").value) == (True, False)
    evidence = F.create_map(F.lit("k"), F.struct(F.lit("12").alias("value"), F.lit(False).alias("unavailable")))
    hit, miss = L.replayed(evidence, "k", "whois", "int"), L.replayed(evidence, "other", "whois", "int")
    assert values(spark, hit.value, hit.names, miss.value, miss.names) == (12, [], None, ["whois"])


def test_arrays(spark):
    null, empty, some = F.lit(None).cast("array<int>"), F.array().cast("array<int>"), F.array(F.lit(3), F.lit(None), F.lit(1), F.lit(3))
    big = lambda x: x > 2
    assert values(spark, *[A.any_item(a, big) for a in (null, empty, some)]) == (None, False, True)
    assert values(spark, *[A.all_items(a, big) for a in (null, empty, some)]) == (True, True, False)
    assert values(spark, *[A.keep(a, big, "array<int>") for a in (null, empty, some)]) == ([], [], [3, 3])
    assert values(spark, *[A.unique(a, "array<int>") for a in (null, empty, some)]) == ([], [], [3, None, 1])
    assert values(spark, A.unique(F.array(F.lit("a1"), F.lit("b1"), F.lit("a2")), "array<string>", lambda x: F.substring(x, 1, 1))) == (["a1", "b1"],)
    assert values(spark, *[A.total(a) for a in (null, empty, some)]) == (0, 0, 7)
    assert values(spark, *[A.share(a, big) for a in (null, empty, some)]) == (None, None, 0.5)
    assert values(spark, *[A.length(a) for a in (null, empty, some)]) == (None, 0, 4)
    assert values(spark, A.item(some, -1), A.item(some, 9), A.item(some, 0), A.cut(some, 2, 99), A.cut(some, 9, 20)) == (None, None, 3, [1, 3], [])
    nested = F.array(F.array(F.lit(1)), F.lit(None).cast("array<int>"), F.array(F.lit(2)))
    assert values(spark, A.flat(nested, "array<int>"), A.flat(F.lit(None).cast("array<array<int>>"), "array<int>")) == ([1, 2], [])
    m = F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))
    assert values(spark, A.keys(m), A.values(m), A.keys(F.lit(None).cast("map<string,int>"))) == (["a", "b"], [1, 2], [])


def test_strings(spark):
    x = F.lit("Hello, Wörld. hello")
    assert values(spark, S.contains(x, "HELLO", fold=True), S.contains(x, "zzz", None), S.count(x, "hello", fold=True), S.count(x, ""), S.glob(x, "H*.?hello"), S.glob(x, "Hello"), S.slice_text(x, 7, 12), S.slice_text(x, 99, 200)) == (True, False, 2, 0, True, False, "Wörld", "")
    assert values(spark, S.contains(F.lit(None).cast("string"), "a"), S.concat(x, F.lit(None))) == (None, None)
    assert values(spark, S.replace_confusables(F.lit("раураl ｈｉ")), S.parse_float(F.lit(" 1.5 ")), S.parse_float(F.lit("x"))) == ("paypal hi", 1.5, None)
    assert values(spark, S.decode_hex(F.lit("6869")), S.decode_hex(F.lit("zz")), S.decode_base64(F.lit("aGk")), S.decode_base64(F.lit("!!")), S.decode_base64(F.lit("Pz8_"), url=True)) == ("hi", None, "hi", None, "???")
    assert values(spark, S.scan_base64(F.lit("x aGVsbG8gd29ybGQhIQ== y"))) == (["hello world!!"],)
    e, bare = S.parse_email(F.lit("A@b@Example.COM")), S.parse_email(F.lit("nobody"))
    assert values(spark, e["local_part"], e["domain"], bare["local_part"], bare["domain"]) == ("a@b", "example.com", "nobody", None)
    d = S.parse_domain(F.lit("mail.Shop.example.co.uk"))
    assert values(spark, d["root_domain"], d["sld"], d["tld"], d["subdomain"], S.parse_domain(F.lit("a b"))) == ("example.co.uk", "example", "co.uk", "mail.shop", None)
    assert values(spark, S.parse_domain(F.lit("mail.evil.test"))["root_domain"]) == ("evil.test",)
    u = S.parse_url(F.lit("HTTPS://u:p@Sub.Example.org:8443/a/b?x=1&y=%20z&x=2#frag"))
    assert values(spark, u["scheme"], u["username"], u["host"], u["port"], u["path"], u["fragment"], u["domain"]["root_domain"]) == ("https", "u", "sub.example.org", 8443, "/a/b", "frag", "example.org")
    assert values(spark, S.query_map(u["query_params"])) == ({"x": ["1", "2"], "y": [" z"]},)
    ip = S.parse_url(F.lit("http://10.0.0.1/x"))
    assert values(spark, ip["ip"], ip["domain"], S.parse_url(F.lit("no url"))) == ("10.0.0.1", None, None)


def test_regexes(spark):
    assert values(spark, R.search(F.lit("abc\n"), "abc$"), R.search(F.lit("É"), "é", fold=True), R.match(F.lit("a\rb"), "a.b"), R.match(F.lit("xabc"), "abc"), R.count(F.lit("aXbXc"), "[[:upper:]]")) == (False, True, True, False, 2)
    got = values(spark, R.extract(F.lit("k=1, j="), r"(?P<key>\w+)=(\d+)?"))[0]
    assert [(r.full_match, list(r.groups)) for r in got] == [("k=1", ["k", "1"]), ("j=", ["j", ""])]
    for bad in (r"(a)\1", "a(?=b)", "a++", "(?<!x)y"):
        with pytest.raises(ValueError):
            R.java(bad)


def test_addresses(spark):
    inside = lambda ip: N.ip_in(F.lit(ip), "10.0.0.0/8", "192.168.1.0/24", "nonsense")
    assert values(spark, inside("10.255.0.1"), inside("192.168.2.1"), inside("::ffff:10.0.0.1"), inside("bad")) == (True, False, True, None)


def test_sensitive(spark):
    text = "mail a.b@x.org ssn 078-05-1120 000-12-3456 card 4111 1111 1111 1111 or 4111 1111 1111 1112 iban GB82WEST12345698765432 GB82WEST12345698765433 aba 021000021 021000022"
    found = values(spark, sensitive.elements(F.lit(text)))[0]
    checked = {("email", "a.b@x.org"), ("social_security_number", "078-05-1120"), ("credit_card_number", "4111 1111 1111 1111"), ("iban_code", "GB82WEST12345698765432"), ("us_aba_routing_number", "021000021")}
    assert {(e.type, e.value) for e in found} == checked | {("canadian_sin", "021000021")}  # the nine digits pass that check as well


def test_scores(spark):
    scores = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    c, d = scoring.confidence(scores(a=0.6, b=0.2, c=0.2)), scoring.confidence(scores(a=0.5, b=0.4))
    assert values(spark, c["label"], c["confidence"], d["confidence"]) == ("a", "high", "medium")
    assert values(spark, scoring.level_of(F.lit(0.2))) == ("low",)
    assert values(spark, scoring.language(F.lit("der Hund und die Katze")), scoring.language(F.lit("xyz"))) == ("de", None)


def test_json_values(spark):
    rows = ['{"a":[{"b":[{"c":"x"},{"c":2},{"d":1}]},{"b":"no array"},{"b":[{"c":null},{"c":"x"}]}]}', "[1]", "{bad", None, '{"a":{}}', '[{"b":[{"c":"r"}]}]']
    df = spark.createDataFrame([(x,) for x in rows], "j string")
    got = [tuple(r) for r in df.select(S.json_values(F.col("j"), "$.a[*].b[*].c"), S.json_values(F.col("j"), "$[*].b[*].c"), S.json_values(F.col("j"), "$.a[1].b")).collect()]
    assert got == [(["x", "2", "x"], [], ["no array"]), ([], [], []), (None,) * 3, (None,) * 3, ([], [], []), ([], ["r"], [])]
