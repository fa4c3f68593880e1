"""Public suffixes: the published vectors for each kind of rule, and the rules' file."""

import pytest
from pyspark.sql import functions as F

from parapet.functions import strings as S
from parapet.functions import suffixes
from parapet.sources import tables

LIST = """// ===BEGIN ICANN DOMAINS===
com  // a note
biz
uk.com
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp

*.ck
!www.ck
us
ak.us
k12.ak.us
com.cn
公司.cn
cn
"""
#: host -> registrable domain, as the list's publishers test it
VECTORS = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", "example": None, "example.example": "example.example", "b.example.example": "example.example",
    "biz": None, "domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "uk.com": None, "example.uk.com": "example.uk.com", "a.b.example.uk.com": "example.uk.com",
    "jp": None, "test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp", "kyoto.jp": None, "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp",
    "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck",
    "us": None, "test.us": "test.us", "ak.us": None, "test.ak.us": "test.ak.us", "k12.ak.us": None, "www.test.k12.ak.us": "test.k12.ak.us",
    "食狮.com.cn": "食狮.com.cn", "食狮.公司.cn": "食狮.公司.cn", "www.食狮.公司.cn": "食狮.公司.cn", "shishi.公司.cn": "shishi.公司.cn", "公司.cn": None, "xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn", "xn--55qx5d.cn": None,
}


def test_published_vectors(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST, encoding="utf-8")
    rules = tables.read_suffixes(spark, str(tmp_path / "list.dat"))
    assert len(rules) == 17 and "com" in rules and "!www.ck" in rules
    with pytest.raises(ValueError):
        tables.read_suffixes(spark, str(tmp_path / "list.dat"), most=16)
    df = spark.createDataFrame([(k,) for k in VECTORS] + [(None,), ("bad host",), ("",), ("evil.test.",)], "host string")
    got = {r.host: r.d for r in df.select("host", S.parse_domain(F.col("host"), rules).alias("d")).collect()}
    assert {k: got[k].root_domain for k in VECTORS} == VECTORS
    assert got[None] is None and got["bad host"] is None and got[""] is None and got["evil.test."].root_domain == "evil.test"
    d = got["a.b.c.kobe.jp"]
    assert (d.tld, d.sld, d.subdomain) == ("c.kobe.jp", "b", "a")
    url = spark.range(1).select(S.parse_url(F.lit("https://u:p@a.www.ck:8/x?y#z"), rules)["domain"]["root_domain"]).first()[0]
    assert url == "www.ck"


def test_the_longest_rule_wins():
    root = suffixes.trie(["a", "*.a", "c.b.a", "!x.b.a"])
    assert [suffixes.labels_of_suffix(root, h) for h in ("a", "b.a", "z.b.a", "c.b.a", "d.c.b.a", "x.b.a", "q", "y.q")] == [1, 2, 2, 3, 3, 2, 1, 1]
