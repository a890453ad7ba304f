import json
from datetime import datetime

from noticeboard.operators.extract import checks, detect, html_pages, ical, json_feeds, jsonld, text_listing
from noticeboard.schema import CAPTURE
from noticeboard.settings import Settings
from noticeboard.sources.registry import registry_frame
from noticeboard.sources.submissions import pending_submissions

EAST = Settings(zone="America/New_York", state="MA")
VENUE = {"name": "Home Hall", "street": "1 Home St", "city": "Cambridge", "zip": "02139"}


def run(spark, job, adapter, bodies, params=None, **kw):
    reg = registry_frame(spark, [{"name": "S", "adapter": adapter, "url": "https://s.example.org/events", "venue": VENUE, "params": params or {}, "module": "m", "class": "c"}])
    rows = [("r", "S", i, f"https://s.example.org/p{i}", None, 200, "", None, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    caps = spark.createDataFrame(rows, CAPTURE)
    args = (caps, reg, kw["as_of"], EAST) if "as_of" in kw else (caps, reg, EAST)
    return {r["title"]: r for r in job(*args).collect()}


def test_tribe(spark):
    base = {"status": "publish", "url": "https://x/1", "timezone": "America/New_York", "start_date": "2026-10-08 19:30:00", "utc_start_date": "2026-10-08 23:30:00",
            "venue": {"venue": "Club", "address": "5 Elm", "city": "Boston", "state": "MA"}, "image": False, "categories": [{"name": "Jazz &amp; Blues"}],
            "description": "<p>[vc_row]An evening of songs &#038; stories[/vc_row]</p>", "cost": "$10"}
    events = [dict(base, title="Good &#8211; Show"), dict(base, title="Disagrees", start_date="2026-10-08 18:30:00"), dict(base, title="CANCELLED: Gone"),
              dict(base, title="Elsewhere", timezone="UTC-5", start_date="2026-10-08 18:30:00", url="https://x/2"), dict(base, title="Whole Day", all_day=True, venue=[], url="https://x/3"),
              dict(base, title="[Virtual] Talk", venue=False, url="https://x/4")]
    got = run(spark, json_feeds.tribe, "tribe", [{"events": events, "total_pages": 1}])
    assert set(got) == {"Good – Show", "Elsewhere", "Whole Day", "[Virtual] Talk"}
    g = got["Good – Show"]
    assert (g.start_datetime, g.venue_name, g.city, g.state, g.tags, g.cost) == (datetime(2026, 10, 8, 19, 30), "Club", "Boston", "MA", ["Jazz & Blues"], "$10")
    assert g.description == "An evening of songs & stories" and got["Elsewhere"].start_datetime == datetime(2026, 10, 8, 19, 30)
    assert got["Whole Day"].all_day and got["Whole Day"].venue_name == "Home Hall" and got["[Virtual] Talk"].venue_name == "Online"


def test_squarespace(spark):
    ms = 1791590400000
    items = [{"title": "Open Mic", "fullUrl": "/e/1", "startDate": ms, "endDate": ms + 3600000, "body": "<div class='sqs-html-content'><p>Songs and more songs tonight $10 at the door</p></div>",
              "location": {"addressTitle": "Club", "addressLine1": "5 Elm", "addressLine2": "Boston, MA, 02139", "markerLat": 42.1, "markerLng": -71.2}},
             {"title": "Rescheduled: X", "startDate": ms}, {"title": "Closed Night", "startDate": ms, "excerpt": "private party here tonight"}]
    got = run(spark, json_feeds.squarespace, "squarespace", [{"upcoming": items}])
    r = got["Open Mic"]
    assert set(got) == {"Open Mic"} and (r.start_datetime, r.cost, r.city, r.state, r.zip_code, r.latitude, r.source_url) == (
        datetime(2026, 10, 9, 20, 0), "$10", "Boston", "MA", "02139", 42.1, "https://s.example.org/e/1")


def test_localist(spark):
    def ev(title, **kw):
        return {"event": {"title": title, "localist_url": "https://l/1", "filters": {"event_audience": [{"name": "Public"}], "event_types": [{"name": "Lecture"}]}, "description_text": "A talk about many things.",
                          "location_name": "Building 2", "room_number": "449", "geo": {"city": "Cambridge"}, "event_instances": [{"event_instance": {"start": "2026-10-06T19:00:00-04:00", "end": "2026-10-06T20:00:00-04:00", "all_day": False}},
                          {"event_instance": {"start": "2026-10-07T00:00:00-04:00", "all_day": True}}, {"event_instance": {"start": "2026-10-08T19:00:30-04:00"}}], **kw}}
    got = run(spark, json_feeds.localist, "localist", [{"events": [ev("Public Talk", ticket_cost="0"), ev("Insiders", description_text="Open to the MIT community only"), ev("Holiday", filters={"event_types": [{"name": "Holidays"}]}),
                                                                  ev("Prose", filters={}, description_text="This is open to the public. Come along."), ev("Nobody", filters={})]}])
    assert set(got) == {"Public Talk", "Prose"} and got["Public Talk"].venue_name == "Building 2, Room 449" and got["Public Talk"].cost == "Free"


ICS = """BEGIN:VCALENDAR
X-WR-TIMEZONE:America/New_York
BEGIN:VTIMEZONE
DTSTART:19700101T000000
END:VTIMEZONE
BEGIN:VEVENT
UID:weekly
DTSTAMP:20261020T120000Z
DTSTART;TZID=America/New_York:20261020T190000
DTEND;TZID=America/New_York:20261020T203000
RRULE:FREQ=WEEKLY;UNTIL=20261118T045959Z
EXDATE;TZID=America/New_York:20261027T190000
RDATE;TZID=America/New_York:20261021T190000
SUMMARY:Weekly Run\\, again
LOCATION:Unity Hall\\, 6 William St\\, Somerville\\, MA 02144\\, USA
DESCRIPTION:A long description that
  is folded here.
BEGIN:VALARM
DTSTART:20200101T000000
END:VALARM
END:VEVENT
BEGIN:VEVENT
UID:weekly
RECURRENCE-ID;TZID=America/New_York:20261103T190000
DTSTAMP:20261020T120000Z
DTSTART;TZID=America/New_York:20261103T200000
SUMMARY:Moved Run
END:VEVENT
BEGIN:VEVENT
UID:day
DTSTART;VALUE=DATE:20261101
SUMMARY:Whole Day
END:VEVENT
BEGIN:VEVENT
UID:bad
DTSTART;TZID=Mars/Olympus:20261101T190000
SUMMARY:Nowhere
END:VEVENT
BEGIN:VEVENT
UID:win
DTSTART;TZID="Pacific Standard Time":20261101T190000
DURATION:PT45M
SUMMARY:West
STATUS:CONFIRMED
END:VEVENT
END:VCALENDAR
"""


def test_ical(spark):
    reg = registry_frame(spark, [{"name": "S", "adapter": "ical", "url": "https://s.example.org/f.ics", "venue": VENUE}])
    caps = spark.createDataFrame([("r", "S", 0, "u", None, 200, "", None, ICS.replace("\n", "\r\n"))], CAPTURE)
    rows = ical.ical(caps, reg, EAST).collect()
    runs = sorted(r.start_datetime for r in rows if r.title == "Weekly Run, again")
    assert runs == [datetime(2026, 10, 20, 19), datetime(2026, 10, 21, 19), datetime(2026, 11, 10, 19), datetime(2026, 11, 17, 19)]
    by = {r.title: r for r in rows}
    assert set(by) == {"Weekly Run, again", "Moved Run", "Whole Day", "West"}
    w = by["Weekly Run, again"]
    assert (w.venue_name, w.street_address, w.city, w.state, w.zip_code) == ("Unity Hall", "6 William St", "Somerville", "MA", "02144")
    assert w.description == "A long description that is folded here." and (w.end_datetime - w.start_datetime).seconds == 5400
    assert by["West"].start_datetime == datetime(2026, 11, 1, 22) and by["West"].end_datetime == datetime(2026, 11, 1, 22, 45) and by["Whole Day"].all_day


def test_jsonld(spark):
    def page(*nodes):
        return "<html><script type='application/ld+json'>" + json.dumps({"@graph": list(nodes)}).replace("Line", "Line\n") + "</script></html>"
    n = {"@type": "MusicEvent", "name": "Jazz", "startDate": "2026-10-22T21:30:00-04:00", "endDate": "2026-10-22T23:00:00-04:00", "url": "/e/1", "description": "Line of text with raw breaks",
         "location": [{"@type": "VirtualLocation", "url": "x"}, {"@type": "Place", "name": "Club", "address": "5 Elm St, Cambridge, MA 02138"}],
         "offers": [{"lowPrice": "10", "highPrice": "20"}], "performer": {"image": {"url": "https://i/1.jpg"}}}
    got = run(spark, jsonld.jsonld, "jsonld", [page(n, dict(n, name="Wrong Offset", startDate="2026-10-22T21:30:00-07:00"), dict(n, name="Gone", eventStatus="https://schema.org/EventCancelled"),
                                                 dict(n, name="Dated", startDate="2026-10-22", offers={"price": 0}), {"@type": "EventSeries", "name": "Series", "subEvent": dict(n, name="Inner")})])
    assert set(got) == {"Jazz", "Dated", "Inner"}
    j = got["Jazz"]
    assert (j.start_datetime, j.end_datetime, j.category, j.cost, j.venue_name, j.street_address, j.city, j.image_url, j.source_url) == (
        datetime(2026, 10, 22, 21, 30), datetime(2026, 10, 22, 23), "music", "$10 - $20", "Club", "5 Elm St", "Cambridge", "https://i/1.jpg", "https://s.example.org/e/1")
    assert got["Dated"].all_day and got["Dated"].cost == "Free"


def test_eventon_needs_both_renderings(spark):
    def card(title, seconds, wall, shown="8:00 pm"):
        ld = json.dumps({"@type": "Event", "startDate": wall, "description": title, "location": [{"name": "Stage"}]})
        return f"<div class='eventon_list_event' data-time='{seconds}-{seconds + 3600}'><a class='evcal_list_a' href='https://t/{seconds}'><span class='evcal_event_title'>{title}</span><em class='evcal_time'>{shown}</em></a><script type='application/ld+json'>{ld}</script></div>"
    ok = 1791590400      # 2026-10-10T00:00Z, 20:00 in the zone
    got = run(spark, html_pages.eventon, "eventon", [card("Jazz Concert", ok, "2026-10-9T20:00-5:00") + card("Split", ok, "2026-10-9T21:00-4:00") + card("Day Out", ok, "2026-10-9", "All Day")])
    assert set(got) == {"Jazz Concert", "Day Out"} and got["Jazz Concert"].start_datetime == datetime(2026, 10, 9, 20) and got["Jazz Concert"].category == "music" and got["Day Out"].all_day


def test_assabet(spark):
    def card(u, day, time, extra=""):
        return f"<div class='listing-event category-storytimes'><h3><a href='{u}'>x</a></h3><span class='event-day'>{day}</span><span class='event-time'>{time}</span><span class='event-location-branch'>East</span><span class='event-location-address'>79 Highland Ave, Somerville , MA, 02143</span></div>"
    def ld(u, name, door):
        return "<script type='application/ld+json'>" + json.dumps({"@type": "Event", "url": u, "name": name, "startDate": "2026-10-05", "doorTime": door, "duration": "PT3600S", "description": "Fun stuff &lt;b&gt;here&lt;/b&gt; Learn More"}) + "</script>"
    body = ld("u1", "Tales", "18:00:00") + ld("u2", "Off", "19:00:00") + card("u1", "Monday, October 5", "6:00—7:00 PM") + card("u2", "Monday, October 5", "6:00 PM") + card("u3", "x", "y")
    got = run(spark, html_pages.assabet, "assabet", [body])
    t = got["Tales"]
    assert set(got) == {"Tales"} and (t.start_datetime, t.end_datetime, t.venue_name, t.city, t.zip_code, t.family_friendly, t.category, t.description) == (
        datetime(2026, 10, 5, 18), datetime(2026, 10, 5, 19), "Home Hall – East", "Somerville", "02143", True, "arts and culture", "Fun stuff here")


def test_drupal_rows_and_details(spark):
    row = lambda t, attr, text, href: f"<div class='views-row'><span class='views-field-title'><a href='{href}'>{t}</a></span><time datetime='{attr}'>{text}</time><div class='views-field-body'>short</div></div>"
    page = row("Yoga", "2026-10-05T22:00:00Z", "October 5, 2026 6:00 pm", "/p1") + row("Off", "2026-10-05T22:00:00Z", "October 5, 2026 7:00 pm", "/p9") + row("Day", "2026-10-05", "Oct 5, 2026", "/p8") + row("Holiday: Closed", "2026-10-05", "Oct 5, 2026", "/p7")
    detail = "<main><div class='address'><span class='organization'>Armory</span><span class='address-line1'>191 Highland</span><span class='locality'>Somerville</span></div><div class='field--name-body'>a much longer description</div></main>"
    got = run(spark, html_pages.drupal_listing, "drupal_listing", [page, detail])
    assert set(got) == {"Yoga", "Day"} and got["Yoga"].start_datetime == datetime(2026, 10, 5, 18) and got["Day"].all_day
    assert (got["Yoga"].venue_name, got["Yoga"].description, got["Yoga"].category) == ("Armory", "a much longer description", "sports")


def test_indiecommerce(spark):
    def item(title, start, date, time):
        return {"title": f"<span>{title}</span><template><div class='event-teaser__details'><dl><dt>Date:</dt><dd>{date}</dd><dt>Time:</dt><dd>{time}</dd></dl></div></template>", "start": start, "url": "/e/1", "des": "<span>Free</span><span>Kids</span>"}
    options = json.dumps({"events": [item("Reading", "2026-10-05T19:00:00-04:00", "10/5/2026", "7:00pm"), item("Off", "2026-10-05T19:00:00-04:00", "10/6/2026", "7:00pm")]})
    body = "<script type='application/json' data-drupal-selector='drupal-settings-json'>" + json.dumps({"fullCalendarView": [{"calendar_options": options}]}) + "</script>"
    got = run(spark, html_pages.indiecommerce, "indiecommerce", [body])
    r = got["Reading"]
    assert set(got) == {"Reading"} and (r.start_datetime, r.cost, r.category, r.venue_name, r.source_url) == (datetime(2026, 10, 5, 19), "Free", "arts and culture", "Home Hall", "https://s.example.org/e/1")


def test_text_listing_dates_and_times(spark):
    cases = {"7:30 PM": (19, 30), "6:00 - 8:00 PM": (18, 0), "11 - 1 pm": (11, 0), "Doors 7:00 PM / Show 8:30 PM": (20, 30), "19:30": (19, 30), "7:30": None, "noon": (12, 0), "TBA": "untimed",
             "6 - 8 PM": (18, 0), "Doors 7 PM": (19, 0), "13:00 PM": None, "afternoon": None, "": "untimed"}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.r for r in frame.select("t", text_listing.read_time("t").alias("r")).collect()}
    for t, want in cases.items():
        hour, minute, status = got[t]
        assert (want if isinstance(want, str) else (want and "timed") or "unreadable") == status and (not isinstance(want, tuple) or (hour, minute) == want), t
    card = lambda t, d, c: f"<article class='event'><h3 class='event-title'><a href='/e'>{t}</a></h3><p class='event-date'>{d}</p><p class='event-time'>{c}</p></article>"
    got = run(spark, text_listing.text_listing, "custom", [card("A", "Fri, Oct 9", "8 pm") + card("B", "Oct 9", "8 pm") + card("C", "Thu, October 9, 2026", "8 pm") + card("D", "October 9, 2026", "")], as_of="2026-10-01")
    assert set(got) == {"A", "D"} and got["A"].start_datetime == datetime(2026, 10, 9, 20) and got["D"].all_day


def test_submissions(spark):
    sheet = spark.createDataFrame([("", "Fair", "Oct 9, 2026", "7pm", "The Fillmore, 1805 Geary Blvd, SF", "", "theatre", "", "Yes", "", "", "bad-mail", "", "", 0),
                                   ("", "No Year", "Oct 9", "", "", "", "", "", "", "", "", "", "", "", 1), ("", "Done", "2026-01-01", "", "", "", "", "", "", "", "", "", "", "Yes - x", 2)],
                                  "timestamp string, event_name string, date string, time string, address string, description string, category string, cost string, family_friendly string, event_url string, image_url string, contact_email string, approved string, uploaded string, pos long")
    rows = text_listing.submissions(pending_submissions(sheet, position="pos")).collect()
    r = rows[0]
    assert len(rows) == 1 and (r.start_datetime, r.venue_name, r.street_address, r.category, r.family_friendly, r.contact_email, r.row_index) == (
        datetime(2026, 10, 9, 19), "The Fillmore", "1805 Geary Blvd, SF", "theater", True, None, 2)


def test_detection_and_checks(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x", "<a href='/cal.ics'>c</a> tribe-events-view"), (2, "https://b.org", "<title>Just a moment...</title>")], "page_id long, url string, html string")
    got = {(r.page_id, r.platform): r.score for r in detect.detect(pages).collect()}
    assert got == {(1, "ical"): 0.59, (1, "tribe"): 0.38, (2, "blocked"): 1.0}
    rows = spark.createDataFrame([("S", 0, "a"), ("S", 1, "b"), ("S", 2, "a"), ("S", 3, "c")], "source_name string, seq int, k string")
    assert sorted(r.k for r in checks.before_repeat(rows, ["k"]).collect()) == ["a", "b"]


def test_cards_are_made_a_few_pages_at_a_time(spark):
    import pandas as pd
    from pyspark.sql import functions as F
    from noticeboard.functions.markup import PIECE, card_fields, in_pieces
    pieces = list(in_pieces(iter([pd.Series(range(3 * PIECE + 1)), pd.Series(range(2))]), lambda x: x + 1))
    assert max(map(len, pieces)) <= PIECE and pd.concat(pieces).tolist() == [*range(1, 3 * PIECE + 2), 1, 2]
    pages = [(i, f"<article class='c'><b>{i}</b></article>" * (i % 3)) for i in range(3 * PIECE + 1)]
    got = spark.createDataFrame(pages, "i long, body string").coalesce(1).select("i", F.transform(card_fields(F.col("body"), "article.c", {"b": "b"}), lambda c: c["b"][0]["text"]).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: [str(i)] * (i % 3) for i, _ in pages}


def test_text_of_fragments_is_made_one_at_a_time():
    import tracemalloc
    import pandas as pd
    from noticeboard.functions.text import strip_html
    words = " ".join(f"word{i}" for i in range(5000))
    texts = pd.Series([f"<p>{words}</p>"] * 60)
    tracemalloc.start()
    got = strip_html.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {words} and peak < 34_000_000        # with all words of the batch it is 42 MB
