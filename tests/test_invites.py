from pyspark.sql import functions as F

from parapet.sources.invites import calendar

FILE = """BEGIN:VCALENDAR
METHOD:request
BEGIN:VEVENT
UID:1@x.test
SUMMARY;LANGUAGE=en:Pay\\, now\\; or \\\\never
DESCRIPTION:first\\nsec
 ond
DTSTART;TZID="a:b":20240102T030405
ORGANIZER;CN="Boss: big":MAILTO:Boss@X.test
ATTENDEE:mailto:a@x.test
ATTENDEE;ROLE=CHAIR:mailto:b@x.test
ATTENDEE:mailto:A@x.test
BEGIN:VALARM
LOCATION:alarm
END:VALARM
END:VEVENT
BEGIN:VEVENT
END:VEVENT
BEGIN:VEVENT
UID:cut off
"""


def test_calendar(spark):
    texts = [(0, FILE), (1, FILE.replace("\n", "\r\n")), (2, "no calendar"), (3, None), (4, ""), (5, "BEGIN:VCALENDAR\nEND:VCALENDAR\n")]
    got = {r.id: r.c for r in spark.createDataFrame(texts, "id int, t string").select("id", calendar(F.col("t")).alias("c")).collect()}
    for i in (0, 1):
        assert got[i].method == "REQUEST" and len(got[i].events) == 2
        e, bare = got[i].events
        assert (e.uid, e.summary, e.description, e.starts, e.ends, e.location) == ("1@x.test", "Pay, now; or \\never", "first\nsecond", "20240102T030405", None, None)
        assert (e.organizer, e.attendees) == ("boss@x.test", ["a@x.test", "b@x.test"])
        assert bare.uid is None and bare.attendees == []
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[5].method is None and got[5].events == []
