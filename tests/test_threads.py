"""Threads of messages: replies of several clients, forwards, quotes without a head, HTML, and what is no quote."""

import pytest
from pyspark.sql import functions as F

from parapet.functions import tree as H
from parapet.sources import threads

GMAIL = "Thanks, that works for me.\n\nOn Mon, 2 Jan 2023 at 15:04, Bob Jones <bob@example.com> wrote:\n> Can we move the meeting to Tuesday?\n>\n> Bob\n"
OUTLOOK = "I've approved it.\n\nFrom: Bob Jones <bob@example.com>\nSent: Monday, January 2, 2023 3:04 PM\nTo: Alice Smith <alice@sender.test>\nCc: Carol <carol@example.com>\nSubject: Invoice approval\n\nPlease approve the attached invoice.\n"
ORIGINAL = "See below.\r\n\r\n-----Original Message-----\r\nFrom: Bob <bob@example.com>\r\nSent: Monday, January 2, 2023 3:04 PM\r\nSubject: Payment details\r\n\r\nOur bank details have changed.\r\n"
DEEP = "Latest reply from Alice.\n\nOn Wed, 4 Jan 2023 at 10:00, Bob <bob@example.com> wrote:\n> Second message from Bob.\n>\n> On Tue, 3 Jan 2023 at 09:00, Carol <carol@partner.test> wrote:\n> > First message from Carol.\n"
CASES = {
    "plain": "Hello Bob,\n\nHere is the invoice you asked for.\n\nAlice\n",
    "gmail": GMAIL, "outlook": OUTLOOK, "original": ORIGINAL, "deep": DEEP,
    "bare": "Agreed.\n\n> The contract is attached.\n> Let me know.\n",
    "inline": "You wrote:\n\n> the invoice\n\nand I agree, please send it to the new account.\n",
    "prose": "As I wrote: the deadline is Friday, and we should confirm it today.\n",
    "forward": "---------- Forwarded message ---------\nFrom: Bob <bob@example.com>\nSubject: Invoice\n\nPlease pay this.\n",
    "banner": "CAUTION: This email originated from outside of the organization.\n\nPlease review the attached invoice.\n",
    "links": "Here is the new one: https://current.test/a\n\nOn Mon, 2 Jan 2023 at 15:04, Bob <bob@example.com> wrote:\n> The old link was https://previous.test/b\n",
    "wrapped": "Ja.\n\nAm Mo., 2. Jan. 2023 um 15:04 Uhr schrieb Bob <\nbob@example.com>:\n> Geht das?\n",
    "german": "Ja.\n\nAm 2. Jan. 2023 um 15:04 schrieb Bob <bob@example.com>:\n> Geht das?\n",
    "from prose": "From: here to there is far.\nWe walked.\n",
    "empty": "",
    "null": None,
}
HTML = {
    "gmail": '<html><body><div>Approved, thanks. <a href="https://current.test/a">x</a></div><div class="gmail_quote"><div>On Mon, 2 Jan 2023 at 15:04, Bob &lt;bob@example.com&gt; wrote:</div><blockquote><div>Please approve the invoice.</div> <a href="https://previous.test/b">y</a></blockquote></div></body></html>',
    "bare": "<p>Agreed.</p><blockquote>The contract</blockquote><p>Also this.</p>",
    "outlook": "<p>I've approved it.</p><div><b>From:</b> Bob &lt;bob@example.com&gt;<br><b>Sent:</b> Monday<br><b>Subject:</b> Approval</div><p>Please approve.</p>",
    "nested": "<div>top</div><blockquote>On Wed, 4 Jan 2023 at 10:00, Bob &lt;bob@example.com&gt; wrote:<br>second<blockquote>On Tue, 3 Jan 2023 at 09:00, Carol &lt;carol@partner.test&gt; wrote:<br>first</blockquote></blockquote>",
    "plain": "<p>Hello</p>",
    "null": None,
}


@pytest.fixture(scope="module")
def text(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "k string, t string").repartition(2)
    return {r.k: r.x for r in df.select("k", threads.text_thread(F.col("t")).alias("x")).collect()}


@pytest.fixture(scope="module")
def html(spark):
    df = spark.createDataFrame([(k, v) for k, v in HTML.items()], "k string, h string").withColumn("t", H.tree("h"))
    return {r.k: r.x for r in df.select("k", threads.html_thread(F.col("t")).alias("x")).collect()}


def test_replies(text):
    g = text["gmail"]
    assert g.current.text == "Thanks, that works for me." and len(g.previous) == 1
    p = g.previous[0]
    assert (p["index"], p.text, p.sender.display_name, p.sender.email, p.date) == (0, "Can we move the meeting to Tuesday?\n\nBob", "Bob Jones", "bob@example.com", "Mon, 2 Jan 2023 at 15:04")
    o = text["outlook"]
    assert o.current.text == "I've approved it." and len(o.previous) == 1
    p = o.previous[0]
    assert (p.text, p.sender.display_name, p.sender.email, p.subject, p.to, p.cc, p.date) == ("Please approve the attached invoice.", "Bob Jones", "bob@example.com", "Invoice approval", ["alice@sender.test"], ["carol@example.com"], "Monday, January 2, 2023 3:04 PM")
    x = text["original"]
    assert x.current.text == "See below." and [(p.text, p.subject) for p in x.previous] == [("Our bank details have changed.", "Payment details")]
    assert [(p.text, p.sender.email) for p in text["german"].previous] == [("Geht das?", "bob@example.com")]


def test_deep_threads(text, html):
    for found in (text["deep"], html["nested"]):
        assert [p["index"] for p in found.previous] == [0, 1]
        assert [p.sender.email for p in found.previous] == ["bob@example.com", "carol@partner.test"]
    assert text["deep"].current.text == "Latest reply from Alice."
    assert [p.text for p in text["deep"].previous] == ["Second message from Bob.", "First message from Carol."]
    assert [p.text for p in html["nested"].previous] == ["second", "first"] and html["nested"].current.text == "top"


def test_what_is_a_quote(text):
    assert text["bare"].current.text == "Agreed." and [p.text for p in text["bare"].previous] == ["The contract is attached.\nLet me know."]
    for k in ("inline", "prose", "plain", "from prose"):
        assert text[k].previous == [] and text[k].current.text == CASES[k].strip()
    assert text["forward"].current.text == "" and [(p.text, p.subject) for p in text["forward"].previous] == [("Please pay this.", "Invoice")]
    assert text["empty"].current.text == "" and text["empty"].previous == [] and text["null"] is None
    assert text["banner"].current.banners == ["CAUTION: This email originated from outside of the organization."] and text["plain"].current.banners == []


def test_links_go_to_their_part(text, html):
    for found in (text["links"], html["gmail"]):
        assert [x.url.host for x in found.current.links] == ["current.test"]
        assert [x.url.host for x in found.previous[0].links] == ["previous.test"]


def test_html(html):
    g = html["gmail"]
    assert g.current.text == "Approved, thanks. x" and [(p.text, p.sender.email) for p in g.previous] == [("Please approve the invoice.\ny", "bob@example.com")]
    assert html["bare"].current.text == "Agreed.\nAlso this." and [p.text for p in html["bare"].previous] == ["The contract"]
    o = html["outlook"]
    assert o.current.text == "I've approved it." and [(p.text, p.subject) for p in o.previous] == [("Please approve.", "Approval")]
    assert html["plain"].previous == [] and html["null"] is None
