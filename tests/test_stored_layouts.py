"""Tables laid out for what reads them: the search index, bucketed snapshots, captures by platform, calendar files."""
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import search_index, serve, snapshots
from noticeboard.operators.publish import diff_snapshots
from noticeboard.schema import CAPTURE, LISTING, conform
from noticeboard.sources import captures as cap
from noticeboard.sources.registry import registry_frame

WORDS = "Jazz night the Oakland hall Café O'Neil story-time, kids free music monday club oak klam".split()


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def listings(spark):
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randrange(n + 1))) or None
    rows = [(str(i), i * 3_000_017, some(4), some(12), some(2), some(1), some(1), some(1), some(1), datetime(2026, 10, 1 + i % 28, 19)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, arrival_ix long, title string, description string, venue_name string, category string, city string, source_name string, cost string, start_datetime timestamp_ntz")
    return conform(df, LISTING)


def test_index_search_equals_the_scan(spark, listings, tmp_path):
    at = search_index.build_index(listings, str(tmp_path / "ix"), parts=8)
    for query in ("oak hall", "k", "Monday JAZZ o'neil", "nothing here", "café", "free free"):
        got = [(r["id"], r["match_score"]) for r in search_index.weighted_search(listings, at, query).collect()]
        assert got == [(r["id"], r["match_score"]) for r in serve.weighted_search(listings, query).collect()]
    for phrase in ("the oak", "k the", "zz night t", " the ", ""):
        assert [r["id"] for r in search_index.search(listings, at, phrase, 60).collect()] == [r["id"] for r in serve.search(listings, phrase, 60).collect()]


def test_index_search_reads_only_its_parts(spark, listings, tmp_path):
    at = search_index.build_index(listings, str(tmp_path / "ix"), parts=8)
    plan = plan_of(search_index.matches(spark, at, "jazz"))
    read = [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "part#" in x]
    assert read and all(len(re.findall(r"[ (,](\d+)(?=[,)])", x)) <= 3 for x in read), read
    assert search_index.weighted_search(listings, at, "  ").count() == 300
    empty = search_index.build_index(listings.limit(0), str(tmp_path / "none"), parts=2)
    assert search_index.weighted_search(listings.limit(0), empty, "jazz").count() == 0


def test_bucketed_snapshots_diff_without_a_shuffle(spark, listings):
    ids = F.col("id").cast("int")
    later = listings.filter(ids % 10 != 3).withColumn("title", F.when(ids % 10 == 4, F.concat(F.coalesce("title", F.lit("")), F.lit("*"))).otherwise(F.col("title")))
    later = later.unionByName(listings.filter(ids % 50 == 7).withColumn("id", F.concat("id", F.lit("n")))).unionByName(listings.limit(3).withColumn("id", F.lit(None).cast("string")))
    a, b = snapshots.store(listings, parts=4, buckets=4), snapshots.store(later, parts=4, buckets=4)
    found = snapshots.diff(a, b)
    key = lambda df: sorted((r["id"], r["change"], r["title"], r["source_name"], r["fields"]) for r in df.collect())
    want = diff_snapshots(listings, later)
    assert key(found) == key(want.filter("change <> 'unchanged'")) and found.count() == 30 + 30 + 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = plan.split("== Initial Plan ==")[0]
    assert "Exchange" not in first and first.count("Bucketed: true") == 2, first
    assert snapshots.unchanged(a, b, found).first()[0] == want.filter("change = 'unchanged'").count()


def test_equal_parts_are_not_read(spark, listings):
    one = listings.filter("id <> '5'")
    a, b = snapshots.store(listings, parts=4, buckets=2), snapshots.store(one, parts=4, buckets=2)
    assert len(snapshots.changed_parts(a, b)) == 1 and snapshots.changed_parts(a, a) == []
    assert [(r["id"], r["change"]) for r in snapshots.diff(a, b).collect()] == [("5", "removed")] and snapshots.diff(a, a).count() == 0
    with pytest.raises(ValueError, match="layouts"):
        snapshots.diff(a, snapshots.store(one, parts=2, buckets=2))


def test_captures_are_read_by_platform(spark, tmp_path):
    reg = registry_frame(spark, [{"name": "A", "adapter": "tribe"}, {"name": "B", "adapter": "ical"}])
    rows = [(run, s, i, f"u{i}", None, 200, "", None, f"body {run} {s} {i}") for run in ("r1", "r2") for s in ("A", "B", "stranger") for i in range(3)]
    frame = spark.createDataFrame(rows, CAPTURE)
    cap.store_captures(frame, reg, str(tmp_path / "caps"))
    back = cap.read_stored_captures(spark, str(tmp_path / "caps"), "r2")
    from noticeboard.operators.extract.common import responses
    mine = responses(back, reg, "ical")
    assert sorted(r["body"] for r in mine.collect()) == [f"body r2 B {i}" for i in range(3)]
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(mine) and "(adapter" in plan_of(mine)
    assert back.filter("adapter = 'none'").count() == 3
    again = cap.by_platform(frame.filter("run_id = 'r1'"), reg)
    assert again.count() == 6 and cap.by_platform(again, reg) is again


def test_landed_captures_are_stored_once_by_platform(spark, tmp_path):
    from noticeboard.streaming.captures import ingest
    reg = registry_frame(spark, [{"name": "A", "adapter": "tribe"}])
    row = lambda i: [("r1", "A", i, f"u{i}", None, 200, "", None, f"body {i}")]
    landing, table, mark = (str(tmp_path / x) for x in ("landing", "table", "mark"))
    for i in range(2):
        spark.createDataFrame(row(i), CAPTURE).write.mode("append").parquet(landing)
        ingest(spark, landing, table, mark, reg).awaitTermination()
        assert cap.read_stored_captures(spark, table, "r1").filter("adapter = 'tribe'").count() == i + 1


def test_recorded_folder(spark, tmp_path):
    import json
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "a.txt").write_text("first body")
    (tmp_path / "bodies" / "b.txt").write_text("second\nbody")
    lines = [{"url": f"https://x/{i}", "file": f, "status": 200, "content_type": "text/html"} for i, f in enumerate(("b.txt", "a.txt", "b.txt", "gone.txt"))]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = cap.read_capture_folder(spark, str(tmp_path), "S", "r").orderBy("seq").collect()
    assert [(r["seq"], r["url"], r["body"]) for r in got] == [(0, "https://x/0", "second\nbody"), (1, "https://x/1", "first body"), (2, "https://x/2", "second\nbody"), (3, "https://x/3", None)]


def test_a_large_calendar_file_is_read_by_many_tasks(spark, tmp_path):
    from noticeboard.operators.extract import ical
    from noticeboard.settings import Settings
    folder = tmp_path / "source_name=Big"
    folder.mkdir()
    event = lambda i: (f"BEGIN:VEVENT\r\nUID:{i}\r\nDTSTAMP:20261001T000000Z\r\nDTSTART;TZID=Europe/London:20261{i % 2}{10 + i % 18}T1900{i % 60:02d}\r\nSUMMARY:Event Number {i}\r\n"  # noqa: E731
                       f"DESCRIPTION:text with a line\\nBEGIN:VEVENT and a fol\r\n ded one {'x' * 200}\r\nEND:VEVENT\r\n")
    body = "BEGIN:VCALENDAR\r\nX-WR-TIMEZONE:Europe/London\r\nBEGIN:VTIMEZONE\r\nTZID:Nowhere\r\nEND:VTIMEZONE\r\n" + "".join(event(i) for i in range(2000)) + "END:VCALENDAR\r\n"
    (folder / "feed.ics").write_bytes(body.encode())
    reg = registry_frame(spark, [{"name": "Big", "adapter": "ical", "url": "https://big.example.org"}])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = ical.file_components(spark, str(tmp_path), reg)
        raw = spark.read.option("lineSep", "\nBEGIN:VEVENT").text(str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 6
        found = rows.select("pos", "seq", "cal_zone", ical.value("UID").alias("uid"), ical.value("DESCRIPTION").alias("d")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["uid"] for r in found] == [str(i) for i in range(2000)] and [r["pos"] for r in found] == list(range(2000))
    assert {r["cal_zone"] for r in found} == {"Europe/London"} and all("folded one" in r["d"] for r in found)
    listed = ical.ical_files(spark, str(tmp_path), reg, Settings(zone="Europe/London"))
    assert listed.count() == 2000 and listed.filter("hour(start_datetime) = 19").count() == 2000


def test_gazetteer_keys_and_faults(spark):
    from noticeboard.operators import places
    rows = [{"name": "Club  One", "aliases": ["The Club", "Café’s"], "lat": 37.8, "lng": -122.3, "city": "Oakland"}, {"name": "Hall", "city": ""}, {"name": "the club", "lat": 37.7, "lng": -122.2}]
    got = {r["key"]: r for r in places.gazetteer(spark, rows).collect()}
    assert set(got) == {"club one", "the club", "café's", "hall"} and got["the club"]["name"] == "the club" and got["the club"]["lat"] == 37.7
    assert got["hall"]["city"] is None and got["the club"]["key_ix"] < got["hall"]["key_ix"]
    for bad, says in (({"name": "Half", "lat": 1.0}, "Half: one coordinate"), ({"name": "Off", "lat": 95.0, "lng": 10.0}, "Off: no such place as 95.0"), ({"name": " "}, "no name")):
        with pytest.raises(ValueError, match=says):
            places.gazetteer(spark, [*rows, bad])
    away = spark.createDataFrame([("Far", None, 1.0, 2.0, None, 0)], places.PINNED)
    assert [(r["fault"], r["fatal"]) for r in places.gazetteer_faults(away).collect()] == [("outside the region", False)] and places.gazetteer_keys(away).count() == 1
    assert places.gazetteer(spark, []).count() == 0


def test_a_pattern_that_cannot_be_read_names_its_source(spark):
    with pytest.raises(ValueError, match=r"B: `exclude` has a pattern .*\(open"):
        registry_frame(spark, [{"name": "A", "adapter": "ical", "params": {"exclude": ["^fine$"]}}, {"name": "B", "adapter": "ical", "params": {"exclude": ["(open"]}}])


def test_stored_rows_are_numbered_however_files_are_split(spark, tmp_path):
    import json
    from noticeboard.sources.stored import read_listings_json
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"id": f"{name}{i:04d}", "title": "t" * 200, "source_name": "S"}) for i in range(400)))
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("10m", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({r["id"]: r["arrival_ix"] for r in read_listings_json(spark, str(tmp_path), lines=True).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == {f"{n}{i:04d}": k * 400 + i for k, n in enumerate("ab") for i in range(400)}
