"""Parts of the daily run: row identity from captures to merged listings, failed sources, the write guard."""
import json
from datetime import datetime

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from noticeboard.operators import dedup, places, quality
from noticeboard.plans import daily
from noticeboard.schema import CAPTURE, FINGERPRINT, LISTING, conform
from noticeboard.settings import Settings
from noticeboard.sources import stored as st
from noticeboard.sources.registry import registry_frame

EAST = Settings(zone="America/New_York", state="MA")
AS_OF = "2026-10-01 09:00:00"
SERIES = """BEGIN:VCALENDAR
X-WR-TIMEZONE:America/New_York
BEGIN:VEVENT
UID:weekly
DTSTAMP:20260920T120000Z
DTSTART;TZID=America/New_York:20261006T190000
DTEND;TZID=America/New_York:20261006T203000
RRULE:FREQ=WEEKLY;COUNT=5
SUMMARY:Weekly Run Around The Pond
LOCATION:Unity Hall\\, 6 William St\\, Somerville\\, MA 02144\\, USA
DESCRIPTION:A long description of a run that comes back every week.
END:VEVENT
END:VCALENDAR"""


def captures(spark, feed=None):
    show = {"status": "publish", "title": "Songs and Stories", "url": "https://x/1", "timezone": "America/New_York", "start_date": "2026-10-08 19:30:00", "utc_start_date": "2026-10-08 23:30:00",
            "venue": {"venue": "Club", "address": "5 Elm", "city": "Boston", "state": "MA"}, "image": False, "categories": [], "description": "<p>An evening of songs and stories for all.</p>"}
    card = "<article class='event'><h3 class='event-title'><a href='/e'>Printed Evening</a></h3><p class='event-date'>Fri, Oct 9</p><p class='event-time'>Doors 7 PM / Show 8:30 PM</p><p class='event-summary'>An evening that was printed on a card.</p></article>"
    rows = [("r", "Series", 0, SERIES), ("r", "Shows", 0, feed or json.dumps({"events": [show], "total_pages": 1})), ("r", "Cards", 0, card)]
    return spark.createDataFrame([(r, s, q, f"https://{s.lower()}.example.org/p", None, 200, "", None, b) for r, s, q, b in rows], CAPTURE)


@pytest.fixture(scope="module")
def world(spark):
    venue = {"name": "Home Hall", "street": "1 Home St", "city": "Cambridge", "zip": "02139"}
    reg = registry_frame(spark, [{"name": n, "adapter": a, "url": f"https://{n.lower()}.example.org/p", "venue": venue, "params": {}, "module": "m", "class": "c"}
                                 for n, a in (("Series", "ical"), ("Shows", "tribe"), ("Cards", "custom"))])
    none = spark.createDataFrame([], "key string, hit boolean, lat double, lng double, city string")
    return reg, places.gazetteer(spark, [{"name": "Club", "lat": 42.3, "lng": -71.1, "city": "Boston"}]), none


def test_every_occurrence_of_a_series_stays(spark, world):
    from noticeboard.operators import dedup
    from noticeboard.operators.extract import extract_all
    reg = world[0]
    found = dedup.keep(extract_all(captures(spark), reg, EAST, AS_OF))
    assert found.select("arrival_ix").distinct().count() == found.count() == 7
    rows = dedup.deduplicate(found, reg).collect()
    weekly = sorted(r["start_datetime"] for r in rows if r["title"] == "Weekly Run Around The Pond")
    assert weekly == [datetime(2026, 10, d, 19) for d in (6, 13, 20, 27)] + [datetime(2026, 11, 3, 19)]
    assert next(r["start_datetime"] for r in rows if r["title"] == "Printed Evening") == datetime(2026, 10, 9, 20, 30)


def test_stored_rows_are_numbered(spark, tmp_path):
    rows = [{"id": str(i), "title": f"t{i}", "start_datetime": "2026-10-08T19:30:00", "source_name": "S"} for i in range(20)]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    back = st.read_listings_json(spark, str(tmp_path / "x.json"), lines=True)
    assert back.select("arrival_ix").distinct().count() == 20
    from noticeboard.operators import publish
    assert {r["change"] for r in publish.diff_snapshots(back, back).collect()} == {"unchanged"}


def test_malformed_feed_fails_its_source(spark, world):
    from noticeboard.operators.extract import checks, extract_all
    from noticeboard.operators.extract.json_feeds import failed_sources
    reg = world[0]
    caps = captures(spark, feed="<html>not a feed</html>")
    outcomes = {r["source"]: r for r in checks.source_outcomes(caps, extract_all(caps, reg, EAST, AS_OF), failed_sources(caps, reg)).collect()}
    assert outcomes["Shows"]["status"] == "failed" and "malformed" in outcomes["Shows"]["error"] and outcomes["Cards"]["status"] == "ok"


def test_guard_refuses_error_findings(spark, tmp_path):
    findings = spark.createDataFrame([("future", "error"), ("x", "warning")], "rule string, severity string")
    rows = spark.createDataFrame([], LISTING)
    with pytest.raises(daily.Refused, match="future x1"):
        daily.guarded_write(rows, findings, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """A handful of rows through very wide plans: compiling them takes longer than reading them."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


STORED = [  # (id, source, title, start, venue)
    ("old-1", "Shows", "Songs and Stories", "2026-10-08T19:30:00", "Club"),                # read again today
    ("old-2", "Silent", "Lecture On Rivers", "2026-10-12T18:00:00", "Hall B"),             # its source produced nothing: rescued
    ("old-3", "Silent", "Lecture On Lakes", "2026-09-12T18:00:00", "Hall B"),              # past: not rescued
    ("old-4", "User Submitted", "Neighbours Meet", "2026-10-03T12:00:00", "Corner"),       # always stays
    ("old-5", "Series", "Weekly Run Around The Pond", "2026-09-29T19:00:00", "Unity Hall")]


def stored(spark, tmp_path, rows=STORED):
    data = [{"id": i, "source_name": s, "title": t, "start_datetime": d, "venue_name": v, "description": f"A description of {t}.", "source_url": f"https://x/{i}", "scraped_at": "2026-09-30T09:00:00",
             "last_updated": "2026-09-30T09:00:00"} for i, s, t, d, v in rows]
    (tmp_path / "stored.json").write_text(json.dumps({"events": data}))
    return dedup.keep(conform(st.read_listings_json(spark, str(tmp_path / "stored.json")), LISTING))


@pytest.fixture(scope="module")
def wide(spark, world):
    """The registry with a source that no capture comes from."""
    extra = registry_frame(spark, [{"name": "Silent", "adapter": "tribe", "url": "https://silent.example.org"}]).filter("name = 'Silent'")
    return world[0].unionByName(extra), *world[1:]


def run_of(spark, wide, tmp_path, **kw):
    history = spark.createDataFrame([], StructType([*FINGERPRINT.fields, StructField("run_id", StringType())]))
    return daily.daily_run(kw.pop("captures", None) or captures(spark), *wide, kw.pop("stored", None) or stored(spark, tmp_path), history, AS_OF, AS_OF, settings=EAST, **kw), history


def test_daily_run_publishes_and_records(spark, wide, tmp_path):
    run, history = run_of(spark, wide, tmp_path)
    rows = {(r["source_name"], r["title"], r["start_datetime"]): r for r in run.publish_set.collect()}
    assert ("Silent", "Lecture On Rivers", datetime(2026, 10, 12, 18)) in rows and ("User Submitted", "Neighbours Meet", datetime(2026, 10, 3, 12)) in rows
    assert not any(t == "Lecture On Lakes" for _, t, _ in rows)
    assert sum(t == "Weekly Run Around The Pond" for _, t, _ in rows) == 5 and sum(t == "Songs and Stories" for _, t, _ in rows) == 1
    assert rows[("Shows", "Songs and Stories", datetime(2026, 10, 8, 19, 30))]["id"] != "old-1"
    assert {r["stage"]: r["rows"] for r in run.stages.collect()} == {"scraped": 7, "validated": 7, "deduplicated": 7, "final": 9}
    assert {r["change"]: r["n"] for r in run.diff.groupBy("change").count().withColumnRenamed("count", "n").collect()} == {"added": 7, "removed": 3, "unchanged": 2}
    paths = [str(tmp_path / x) for x in ("listings", "history", "quarantine", "runs")]
    assert daily.commit_run(run, history, "r1", *paths) and not (tmp_path / "quarantine").exists()
    assert st.read_listings(spark, paths[0]).count() == 9
    assert {r["source"] for r in spark.read.parquet(paths[1]).filter("run_id = 'r1'").collect()} == {"Shows", "Series", "Cards", "Silent", "User Submitted"}
    record = spark.read.parquet(paths[3]).first()
    assert (record["run_id"], record["gate"]["decision"], record["counts"]["final"], record["counts"]["scraped"]) == ("r1", "pass", 9, 7)
    assert {s["source"]: s["status"] for s in record["scrapers"]} == {"Shows": "ok", "Series": "ok", "Cards": "ok"} and record["diff"]["added"] == 7
    picks = spark.createDataFrame([("Songs and Stories", "Shows"), ("Lecture On Lakes", "Silent")], "title string, source_name string")
    volumes = spark.createDataFrame([("r0", "Shows", 40), ("r0", "Silent", 1)], "run_id string, source string, events long")
    after = daily.after_run(run.publish_set, picks, volumes, wide[0], "r1", AS_OF, AS_OF)
    assert [r["title"] for r in after.picks.collect()] == ["Songs and Stories"]
    assert {(r["source"], r["severity"]) for r in after.volume.collect()} == {("Shows", "WARNING")} and after.volumes.count() == 5
    assert {r["state"] for r in after.freshness.filter("source = 'Shows'").collect()} == {"healthy"}


def test_blocked_run_is_quarantined_with_all_its_findings(spark, wide, tmp_path):
    """A feed that stamps every row with one start must not reach readers, nor the history."""
    show = lambda i: {"status": "publish", "title": f"Show Number {i}", "url": f"https://x/{i}", "timezone": "America/New_York", "start_date": "2026-10-08 19:30:00", "utc_start_date": "2026-10-08 23:30:00",
                      "venue": {"venue": f"Room {i}"}, "image": False, "categories": [], "description": f"<p>An evening with number {i} for everyone.</p>"}
    feed = json.dumps({"events": [show(i) for i in range(25)], "total_pages": 4})
    run, history = run_of(spark, wide, tmp_path, captures=captures(spark, feed))
    paths = [str(tmp_path / x) for x in ("listings", "history", "quarantine", "runs")]
    assert not daily.commit_run(run, history, "r2", *paths)
    assert not (tmp_path / "listings").exists() and not (tmp_path / "history").exists()
    at = f"{paths[2]}/run_id=r2"
    assert spark.read.parquet(f"{at}/rows").count() == run.publish_set.count()
    assert [(r["rule"], r["source"], r["count"]) for r in spark.read.parquet(f"{at}/findings").collect()] == [("timestamp_pileup", "Shows", 25)]
    report = "\n".join(r["value"] for r in spark.read.text(f"{at}/report").collect())
    assert "Gate: BLOCKED" in report and "Shows: 25 events share one exact start (limit 20)" in report
    record = spark.read.parquet(paths[3]).first()
    assert record["gate"]["decision"] == "block" and next(s["error"] for s in record["scrapers"] if s["source"] == "Shows") == "read 1 of 4 announced pages"
    forced = quality.gate(run.publish_set, run.findings, run.drifts, force=True).first()
    assert forced["passed"] and not forced["blocking"] and "overridden by force" in forced["reasons"]
    many = STORED + [(f"m{i}", "Shows", f"Show {i}", f"2026-10-{2 + i % 28:02d}T18:00:00", "Club") for i in range(120)]
    collapsed = quality.gate(run.publish_set, run.findings.limit(0), run.drifts, stored(spark, tmp_path, many)).first()
    assert collapsed["blocking"] and any("event count collapsed" in r for r in collapsed["reasons"])


def test_repair_and_refresh_write_through_the_guard(spark, wide, tmp_path):
    from noticeboard.operators.extract import extract_all
    old = stored(spark, tmp_path)
    found = dedup.keep(extract_all(captures(spark), wide[0], EAST, AS_OF))
    fixed = daily.repair(found, "Shows", *wide, old, AS_OF, AS_OF, EAST)
    assert fixed.write(str(tmp_path / "repaired")) == 5
    assert {r["source_name"] for r in st.read_listings(spark, str(tmp_path / "repaired")).collect()} == {"Shows", "Silent", "User Submitted", "Series"}
    assert {r["change"]: r["count"] for r in fixed.diff.groupBy("change").count().collect()} == {"added": 1, "removed": 1, "unchanged": 4}
    local = daily.refresh_local(found, *wide, old, AS_OF, AS_OF, EAST)
    assert local.write(str(tmp_path / "refreshed")) == 7 + 3
    from pyspark.sql import functions as F
    stamped = found.withColumn("start_datetime", F.col("start_datetime") + F.expr("INTERVAL 3000 DAYS"))
    late = daily.Checked(stamped, quality.check_invariants(stamped, AS_OF), fixed.diff)
    with pytest.raises(daily.Refused, match="date_out_of_range"):
        late.write(str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()
