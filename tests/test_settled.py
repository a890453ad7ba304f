"""Costly columns are worked out once: no filter is pushed below them, and nothing of a whole feed is worked out for every event."""
from noticeboard.catalog.extract_queries import FIXED, _registry
from noticeboard.functions.markup import _by_mark, _compile, _fields_of, _matches, _tree
from noticeboard.operators.extract import ical, jsonld
from noticeboard.schema import CAPTURE, conform


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _captures(spark, body):
    return conform(spark.createDataFrame([("shop", 0, "https://shop.example.org/", 200, body)], "source_name string, seq int, url string, status int, body string"), CAPTURE)


def test_a_node_is_parsed_once(spark):
    body = """<script type='application/ld+json'>{"@type": "Event", "name": "One night", "startDate": "2026-10-06T19:00"}</script>"""
    found = jsonld.jsonld(_captures(spark, body), _registry(spark, "jsonld"), FIXED)
    assert _plan(found).count("parseJson") == 1
    assert [r["title"] for r in found.collect()] == ["One night"]


def test_a_calendars_zone_is_read_once_a_feed(spark):
    event = "BEGIN:VEVENT\r\nSUMMARY:a\r\nEND:VEVENT\r\n"
    found = ical.components(_captures(spark, "BEGIN:VCALENDAR\r\nX-WR-TIMEZONE:Etc/GMT+8\r\n" + event * 3 + "END:VCALENDAR"))
    above = _plan(found).split("Generate posexplode")[0]
    assert "X-WR-TIMEZONE" not in above and "VTIMEZONE" not in above
    assert [r["cal_zone"] for r in found.select("cal_zone").collect()] == ["Etc/GMT+8"] * 3


def test_marked_fields_are_those_that_match():
    selectors = {n: _compile(s) for n, s in {"a": "a.x[href], .y b", "id": "#k", "any": "*", "attr": "[data-d^=q]", "tag": "i", "none": "p.x.z", "deep": "div .y i"}.items()}
    marks = _by_mark(selectors)
    root = _tree("<div><a class='x w' href='u'>1</a><p class='y'><b id='k' data-d='qq'>2</b><i>3</i></p><p class='x'>4</p><a class='x'>5</a></div>")
    for node in root.walk():
        assert _fields_of(node, marks, root) == {n for n, s in selectors.items() if _matches(node, s, root)}


def test_plain_rules_need_no_parser():
    """Dates of rules that add days or weeks are what dateutil finds, at the edges of the window too; anything else is left to it."""
    import random
    from datetime import datetime, timedelta
    from dateutil.rrule import rrulestr
    from noticeboard.operators.extract.ical import _plain_rule, dates_between
    r = random.Random(3)
    for i in range(400):
        rule = f"FREQ={r.choice(['DAILY', 'WEEKLY'])}" + r.choice(["", ";INTERVAL=2", ";INTERVAL=11"]) + r.choice(["", ";COUNT=1", ";COUNT=9", ";UNTIL=20240310", ";UNTIL=20240310T193000"]) + r.choice(["", ";WKST=SU"])
        start = datetime(2024, 1, 1, 19, 30) + timedelta(days=r.randrange(-90, 90), microseconds=r.choice([0, 5]))
        lo = datetime(2024, 2, 1, 19, 30) + timedelta(days=r.randrange(-30, 30), hours=r.choice([0, 5]))
        hi = lo + timedelta(days=r.choice([-1, 0, 1, 40, 400]))
        assert _plain_rule(rule) is not None and dates_between(rule, start, lo, hi) == rrulestr(rule, dtstart=start).between(lo, hi, inc=True), (rule, start, lo, hi)
    for odd in ("FREQ=WEEKLY;BYDAY=MO", "FREQ=MONTHLY", "FREQ=DAILY;COUNT=0", "FREQ=DAILY;INTERVAL=0", "freq=daily", "FREQ=DAILY;", "FREQ=DAILY;COUNT=2;COUNT=3", "FREQ=DAILY;UNTIL=20240231", "FREQ=DAILY;COUNT=3;UNTIL=20240301",
                "RRULE:FREQ=DAILY", "COUNT=3", "FREQ=DAILY;UNTIL=20240301T000000Z"):
        assert _plain_rule(odd) is None


def test_calendar_fields_are_worked_out_once_an_event(spark, capsys):
    from noticeboard.operators.extract.ical import ical
    from noticeboard.schema import CAPTURE, conform
    from noticeboard.sources.registry import registry_frame
    body = "BEGIN:VCALENDAR\r\n" + "\r\n".join(
        f"BEGIN:VEVENT\r\nUID:{i}\r\nDTSTAMP:20240101T000000Z\r\nDTSTART:20240105T190000\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nSUMMARY:Show {i}\r\nLOCATION:Hall {i}\\, 6 Elm St\\, Oakland\\, CA 94607\r\nEND:VEVENT" for i in range(2)) + "\r\nEND:VCALENDAR"
    captures = conform(spark.createDataFrame([("shop", 0, "https://shop.example.org/p", 200, body)], "source_name string, seq int, url string, status int, body string"), CAPTURE)
    found = ical(captures, registry_frame(spark, [{"name": "shop", "adapter": "ical", "url": "https://shop.example.org/events"}]))
    assert sorted((r["title"], str(r["start_datetime"]), r["venue_name"], r["city"]) for r in found.collect()) == sorted(
        (f"Show {i}", f"2024-01-{d:02d} 19:00:00", f"Hall {i}", "Oakland") for i in range(2) for d in (5, 12, 19))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    above = plan[:plan.index("explode(starts")]
    assert "ArrowEvalPython" not in above and "regexp_" not in above.lower()
