"""Extraction over captures that Spark derives from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators.extract import checks, detect, extract_all, html_pages, ical, json_feeds, jsonld, text_listing
from ..schema import CAPTURE, conform
from ..session import scratch_folder
from ..settings import Settings
from ..sources import captures as cap
from ..sources.registry import registry_frame
from ..sources.submissions import pending_submissions
from .views import table

FIXED = Settings(zone="Etc/GMT+8")          # eight hours behind UTC all year
PER = 50                                     # rows per made-up response


def _registry(spark, adapter, name="shop", **params):
    return registry_frame(spark, [{"name": name, "adapter": adapter, "url": "https://shop.example.org/events", "params": params, "module": "m", "class": "c",
                                   "venue": {"name": "Home Hall", "street": "1 Home St", "city": "Oakland", "zip": "94607"}}])


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("at", (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 12 + 8).cast("int"))).cast("timestamp_ntz")) \
        .withColumn("off", F.col("o_orderkey") % 7 == 0).withColumn("title", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).withColumn("page", F.expr(f"o_orderkey div {PER}"))


O_SQL = "o AS (SELECT *, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 12 + 8)::INT AS tm, o_orderkey % 7 = 0 AS off, 'Order ' || o_orderkey AS title FROM orders)"


def _captures(df, body, source="shop"):
    """One capture per page; ``body`` builds it from the page's rows (at most fifty)."""
    # parsing is heavy for the bytes: keep the partition count, as files on disk would
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = df.repartition(parts, "page").groupBy("page").agg(body.alias("body"))
    return conform(pages.select(F.lit(source).alias("source_name"), F.col("page").cast("int").alias("seq"), F.concat(F.lit("https://shop.example.org/p/"), F.col("page").cast("string")).alias("url"),
                                F.lit(200).alias("status"), "body"), CAPTURE)


def _listed(parts):
    return F.array_join(F.array_sort(F.collect_list(F.concat(*parts))), "\n")


def fmt(c, p):
    return F.date_format(c, p)


def tribe_body():
    local = F.col("at") - F.when(F.col("off"), F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    e = F.struct("title", F.concat(F.lit("https://t/"), "o_orderkey").alias("url"), F.lit("UTC-5").alias("timezone"), fmt(local, "yyyy-MM-dd HH:mm:ss").alias("start_date"),
                 fmt(F.col("at") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("utc_start_date"), F.concat(F.lit("<p>priority &amp; status "), "o_orderpriority", F.lit("</p>")).alias("description"),
                 F.struct(F.concat(F.lit("Room "), F.col("o_custkey") % 10).alias("venue")).alias("venue"))
    return F.to_json(F.struct(F.array_sort(F.collect_list(e)).alias("events")))


def tribe(spark, sf):
    caps = _captures(_orders(spark, sf), tribe_body())
    return json_feeds.tribe(caps, _registry(spark, "tribe"), FIXED).select("title", "start_datetime", "venue_name", "description")


def squarespace_body():
    e = F.struct("title", F.concat(F.lit("/e/"), "o_orderkey").alias("fullUrl"), (F.unix_millis(F.col("at").cast("timestamp"))).alias("startDate"), F.concat(F.lit("Tickets are $"), F.col("o_custkey") % 40, F.lit(" each.")).alias("excerpt"))
    return F.to_json(F.struct(F.array_sort(F.collect_list(e)).alias("upcoming")))


def squarespace(spark, sf):
    caps = _captures(_orders(spark, sf), squarespace_body())
    return json_feeds.squarespace(caps, _registry(spark, "squarespace"), FIXED).select("title", "start_datetime", "cost", "source_url")


def localist_body():
    inst = lambda h: F.struct(F.struct(F.concat(fmt(F.col("at") + F.expr(f"INTERVAL {h} HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00")).alias("start"), F.lit(False).alias("all_day")).alias("event_instance"))
    public = F.when(F.col("o_orderstatus") == "F", "Staff").otherwise("Public")
    e = F.struct(F.struct("title", F.concat(F.lit("https://l/"), "o_orderkey").alias("localist_url"), F.struct(F.array(F.struct(public.alias("name"))).alias("event_audience")).alias("filters"),
                          F.array(inst(0), inst(24)).alias("event_instances"), F.lit(True).alias("free")).alias("event"))
    return F.to_json(F.struct(F.array_sort(F.collect_list(e)).alias("events")))


def localist(spark, sf):
    caps = _captures(_orders(spark, sf), localist_body())
    return json_feeds.localist(caps, _registry(spark, "localist"), FIXED).select("title", "start_datetime", "cost")


def ical_feed_body():
    day = fmt("at", "yyyyMMdd'T'HHmmss")
    third = fmt(F.col("at") + F.expr("INTERVAL 14 DAYS"), "yyyyMMdd'T'HHmmss")
    body = [F.lit("BEGIN:VEVENT\r\nUID:"), "o_orderkey", F.lit("\r\nDTSTAMP:19920102T000000Z\r\nDTSTART:"), day, F.lit("\r\nDURATION:PT90M\r\nRRULE:FREQ=WEEKLY;COUNT=5\r\n"),
            F.when(F.col("off"), F.concat(F.lit("EXDATE:"), third, F.lit("\r\n"))).otherwise(""), F.lit("SUMMARY:"), "title", F.lit("\r\nLOCATION:Hall\\, 6 Elm St\\, Oak\r\n land\\, CA 94607\r\nEND:VEVENT")]
    return F.concat(F.lit("BEGIN:VCALENDAR\r\n"), _listed(body), F.lit("\r\nEND:VCALENDAR"))


def ical_feed(spark, sf):
    caps = _captures(_orders(spark, sf), ical_feed_body())
    return ical.ical(caps, _registry(spark, "ical", days="20000"), FIXED).select("title", "start_datetime", "end_datetime", "city")


def jsonld_pages_body():
    zone = F.when(F.col("off"), "-05:00").otherwise("-08:00")
    node = F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.col("title").alias("name"), F.concat(fmt("at", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("startDate"), F.concat(F.lit("/e/"), "o_orderkey").alias("url"),
                              F.struct(F.lit("Offer").alias("@type"), F.col("o_custkey").cast("string").alias("price")).alias("offers")))
    return _listed([F.lit("<script type='application/ld+json'>"), node, F.lit("</script>")])


def jsonld_pages(spark, sf):
    caps = _captures(_orders(spark, sf), jsonld_pages_body())
    return jsonld.jsonld(caps, _registry(spark, "jsonld"), FIXED).select("title", "start_datetime", "category", "cost", "source_url")


def drupal_body():
    shown = fmt(F.col("at") + F.when(F.col("off"), F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR")), "MMMM d, yyyy h:mm a")
    row = [F.lit("<div class='views-row'><b class='views-field-title'><a href='/n/"), "o_orderkey", F.lit("'>"), "title", F.lit("</a></b><time datetime='"), fmt(F.col("at") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z'>"), shown, F.lit("</time></div>")]
    return _listed(row)


def drupal(spark, sf):
    caps = _captures(_orders(spark, sf), drupal_body())
    return html_pages.drupal_listing(caps, _registry(spark, "drupal_listing"), FIXED).select("title", "start_datetime", "source_url", "category")


def eventon_body():
    ld = F.to_json(F.struct(F.lit("Event").alias("@type"), F.concat(fmt(F.col("at") + F.when(F.col("off"), F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR")), "yyyy-M-d'T'HH:mm"), F.lit("-4:00")).alias("startDate")))
    sec = F.unix_seconds(F.col("at").cast("timestamp")) + 28800
    row = [F.lit("<div class='eventon_list_event' data-time='"), sec.cast("string"), F.lit("-"), (sec + 3600).cast("string"), F.lit("'><a class='evcal_list_a' href='https://t/"), "o_orderkey", F.lit("'><span class='evcal_event_title'>"), "title",
           F.lit(" jazz</span></a><script type='application/ld+json'>"), ld, F.lit("</script></div>")]
    return _listed(row)


def eventon(spark, sf):
    caps = _captures(_orders(spark, sf), eventon_body())
    return html_pages.eventon(caps, _registry(spark, "eventon"), FIXED).select("title", "start_datetime", "end_datetime", "category")


def text_cards(spark, sf):
    o = _orders(spark, sf)
    year = F.year("at") + F.when(F.col("off"), 1).otherwise(0)
    row = [F.lit("<article class='event'><h3 class='event-title'><a href='/e/"), "o_orderkey", F.lit("'>"), "title", F.lit("</a></h3><p class='event-date'>"), fmt("at", "EEE, MMMM d, "), year.cast("string"),
           F.lit("</p><p class='event-time'>Doors 7 am / Show "), fmt("at", "h:mm a"), F.lit("</p></article>")]
    return text_listing.text_listing(_captures(o, _listed(row)), _registry(spark, "custom"), "1998-01-01", FIXED).select("title", "start_datetime", "source_url")


def submitted(spark, sf):
    o = _orders(spark, sf)
    sheet = o.select(F.col("title").alias("event_name"), F.when(F.col("off"), fmt("at", "MMM d")).otherwise(fmt("at", "MMM d, yyyy")).alias("date"), fmt("at", "h:mm a").alias("time"),
                     F.concat(F.lit("Hall "), F.col("o_custkey").cast("string"), F.lit(", 5 Elm St")).alias("address"), F.when(F.col("o_orderstatus") == "F", "Yes - done").otherwise("").alias("uploaded"), (F.col("o_orderkey") + 2).alias("row_index"))
    return text_listing.submissions(pending_submissions(sheet), FIXED).select("title", "start_datetime", "venue_name", "street_address", "row_index")


def calendar_files(spark, sf):
    """Feeds as files, one a priority of the orders: series in a zone of their own, whole days, a moved occurrence, and instants in UTC."""
    o = _orders(spark, sf).withColumn("k", F.col("o_orderkey") % 4).withColumn("source_name", F.concat(F.lit("cal "), F.substring("o_orderpriority", 1, 1)))
    at = lambda h, d=0: fmt(F.col("at") + F.expr(f"INTERVAL {h} HOURS") + F.expr(f"INTERVAL {d} DAYS"), "yyyyMMdd'T'HHmmss")
    day = fmt("at", "yyyyMMdd")
    head = F.concat(F.lit("UID:"), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTAMP:19920102T000000Z\r\nSUMMARY:"), F.col("title"), F.lit("\r\nDESCRIPTION:a line that is fol\r\n ded\\nBEGIN:VEVENT\r\n"))
    event = lambda *c: F.concat(F.lit("BEGIN:VEVENT\r\n"), head, *c, F.lit("\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nEND:VALARM\r\nEND:VEVENT"))
    own = event(F.lit("DTSTART;TZID=Etc/GMT+5:"), at(3), F.lit("\r\nRRULE:FREQ=WEEKLY;COUNT=3"))
    days = event(F.lit("DTSTART;VALUE=DATE:"), day, F.lit("\r\nRRULE:FREQ=DAILY;COUNT=2"))
    moved = F.concat(event(F.lit("DTSTART:"), at(0), F.lit("\r\nRRULE:FREQ=WEEKLY;COUNT=4")), F.lit("\r\n"),
                     event(F.lit("RECURRENCE-ID:"), at(0, 7), F.lit("\r\nDTSTART:"), at(2, 7)))
    instant = event(F.lit("DTSTART:"), at(8), F.lit("Z\r\nDTEND:"), at(10), F.lit("Z"))
    text = F.when(F.col("k") == 0, own).when(F.col("k") == 1, days).when(F.col("k") == 2, moved).otherwise(instant)
    rows = o.select("source_name", F.col("o_orderkey").alias("turn"), text.alias("value"))
    names = rows.select("source_name").distinct()
    rows = rows.union(names.select("source_name", F.lit(-1).cast("long"), F.lit("BEGIN:VCALENDAR\r\nX-WR-TIMEZONE:Etc/GMT+8"))).union(names.select("source_name", F.lit(1 << 60), F.lit("END:VCALENDAR")))
    path = scratch_folder(spark)
    rows.repartition("source_name").sortWithinPartitions("source_name", "turn").select("source_name", "value").write.partitionBy("source_name").option("lineSep", "\r\n").text(path)
    reg = None
    for i in range(1, 6):
        one = _registry(spark, "ical", f"cal {i}", days="20000").filter(F.col("name") == f"cal {i}")
        reg = one if reg is None else reg.unionByName(one)
    return ical.ical_files(spark, path, reg, FIXED).select("source_name", "title", "start_datetime", "end_datetime", "all_day")


CALENDAR_SQL = f"""WITH {O_SQL}, k AS (SELECT 'cal ' || substring(o_orderpriority, 1, 1) AS source_name, o_orderkey % 4 AS k, title, tm FROM o), w AS (SELECT unnest(range(4))::INT AS i)
 SELECT source_name, title, tm + INTERVAL 7 DAY * i AS start_datetime, NULL::TIMESTAMP AS end_datetime, false AS all_day FROM k, w WHERE k = 0 AND i < 3
 UNION ALL SELECT source_name, title, date_trunc('day', tm) + INTERVAL 1 DAY * i, NULL, true FROM k, w WHERE k = 1 AND i < 2
 UNION ALL SELECT source_name, title, tm + INTERVAL 7 DAY * i + CASE WHEN i = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, NULL, false FROM k, w WHERE k = 2
 UNION ALL SELECT source_name, title, tm, tm + INTERVAL 2 HOUR, false FROM k WHERE k = 3"""


# platform -> its responses; all of them together make the captures of one run
MIXED = {"tribe": tribe_body, "squarespace": squarespace_body, "localist": localist_body, "ical": ical_feed_body, "jsonld": jsonld_pages_body, "drupal_listing": drupal_body, "eventon": eventon_body}


def mixed(spark, sf):
    """Captures of seven sources, one a platform, and their registry."""
    o, caps, reg = _orders(spark, sf), None, None
    for adapter, body in MIXED.items():
        one = _captures(o, body(), f"shop {adapter}")
        record = _registry(spark, adapter, f"shop {adapter}", **({"days": "20000"} if adapter == "ical" else {})).filter(F.col("name") == f"shop {adapter}")
        caps, reg = (one, record) if caps is None else (caps.unionByName(one), reg.unionByName(record))
    return caps, reg


def all_platforms(spark, sf):
    caps, reg = mixed(spark, sf)
    return extract_all(caps, reg, FIXED).select("source_name", "title", "start_datetime")


MIXED_SQL = f"""WITH {O_SQL}, w AS (SELECT unnest(range(5)) AS i)
 SELECT 'shop tribe' AS source_name, title, tm - INTERVAL 3 HOUR AS start_datetime FROM o WHERE NOT off
 UNION ALL SELECT 'shop squarespace', title, tm - INTERVAL 8 HOUR FROM o
 UNION ALL SELECT 'shop localist', title, tm + INTERVAL 24 HOUR * i::INT FROM o, (VALUES (0), (1)) t(i) WHERE o_orderstatus <> 'F'
 UNION ALL SELECT 'shop ical', title, tm + INTERVAL 7 DAY * i::INT FROM o, w WHERE NOT (off AND i = 2)
 UNION ALL SELECT 'shop jsonld', title, tm FROM o WHERE NOT off
 UNION ALL SELECT 'shop drupal_listing', title, tm FROM o WHERE NOT off
 UNION ALL SELECT 'shop eventon', title || ' jazz', tm FROM o WHERE NOT off"""


def _scores_sql():
    parts = []
    for name, words in detect.SIGNATURES.items():
        tests = [f"contains(lower(html), '{w.lower()}')" for w in words] + [f"regexp_matches(html, '{p}')".replace("[\"']", "[\"'']").replace("[^\"']", "[^\"'']") for p in detect.SIGNATURE_PATTERNS.get(name, ())]
        parts.append(f"SELECT page_id, '{name}' AS platform, {name in detect.GENERIC} AS g, round(0.5::DOUBLE * (({' + '.join(t + '::INT' for t in tests)}) / {float(len(tests))}::DOUBLE), 2) AS score FROM m")
    return " UNION ALL ".join(parts)


def marked(spark, sf):
    """Pages, some carrying a platform's marks."""
    mark = (F.when(F.col("page_id") % 5 == 0, '<i class="tribe-events-view tribe-events-calendar"></i>').when(F.col("page_id") % 5 == 1, "static1.squarespace.com eventlist-event")
            .when(F.col("page_id") % 5 == 2, 'views-row drupal-settings-json pager__item <a href="/x.ics">c</a> webcal://a').otherwise(""))
    return table(spark, sf, "pages").withColumn("html", F.concat("html", mark))


MARKED = """m AS (SELECT page_id, url, html || CASE page_id % 5 WHEN 0 THEN '<i class="tribe-events-view tribe-events-calendar"></i>' WHEN 1 THEN 'static1.squarespace.com eventlist-event'
 WHEN 2 THEN 'views-row drupal-settings-json pager__item <a href="/x.ics">c</a> webcal://a' ELSE '' END AS html FROM pages)"""


def _paged(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.concat(F.lit("s"), F.col("l_suppkey") % 10).alias("source_name"), (F.col("l_orderkey") % 40).cast("int").alias("seq"), F.col("l_partkey").alias("k"), F.col("l_linenumber"))


def _outcomes(spark, sf):
    l = _paged(spark, sf)
    caps = l.groupBy("source_name", "seq").agg(F.when(F.min("k") % 3 == 0, 403).otherwise(200).alias("status")).withColumn("url", F.concat(F.lit("u"), "seq"))
    return checks.source_outcomes(caps, l.filter("source_name IN ('s1', 's2', 's3')")).drop("error")


HREFS = ("../x.html", "../../y?a=../b", "./z/./w", "?q=1", "#part", "/r/../s/", "../../../../../t/..")


def _links(spark, sf):
    href = F.element_at(F.array(*(F.lit(h) for h in HREFS)), (F.col("page_id") % len(HREFS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", x.absolute_url(F.col("url"), href).alias("link"))


# written out per form of link; ``dirs`` are the folders of the page's path, the first one empty
LINKS_SQL = """WITH p AS (SELECT page_id, page_id % 7 AS k, regexp_replace(url, '#.*$', '') AS whole, regexp_replace(url, '[?#].*$', '') AS path, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root FROM pages),
 d AS (SELECT *, list_slice(string_split(CASE WHEN substr(path, length(root) + 1) = '' THEN '/' ELSE substr(path, length(root) + 1) END, '/'), 1, -2) AS dirs FROM p)
 SELECT page_id, CASE k WHEN 0 THEN root || array_to_string(list_slice(dirs, 1, greatest(1, len(dirs) - 1)), '/') || '/x.html' WHEN 1 THEN root || array_to_string(list_slice(dirs, 1, greatest(1, len(dirs) - 2)), '/') || '/y?a=../b'
  WHEN 2 THEN root || array_to_string(dirs, '/') || '/z/w' WHEN 3 THEN path || '?q=1' WHEN 4 THEN whole || '#part' WHEN 5 THEN root || '/s/' ELSE root || array_to_string(list_slice(dirs, 1, greatest(1, len(dirs) - 5)), '/') || '/' END AS link FROM d"""


QUERIES = {
    "calendar_files": (calendar_files, CALENDAR_SQL),
    "extract_all": (all_platforms, MIXED_SQL),
    "resolved_links": (_links, LINKS_SQL),
    "feed_tribe": (tribe, f"WITH {O_SQL} SELECT title, tm - INTERVAL 3 HOUR AS start_datetime, 'Room ' || (o_custkey % 10) AS venue_name, 'priority & status ' || o_orderpriority AS description FROM o WHERE NOT off"),
    "feed_squarespace": (squarespace, f"WITH {O_SQL} SELECT title, tm - INTERVAL 8 HOUR AS start_datetime, '$' || (o_custkey % 40) AS cost, 'https://shop.example.org/e/' || o_orderkey AS source_url FROM o"),
    "feed_localist": (localist, f"WITH {O_SQL} SELECT title, tm + INTERVAL 24 HOUR * i::INT AS start_datetime, 'Free' AS cost FROM o, (VALUES (0), (1)) t(i) WHERE o_orderstatus <> 'F'"),
    "feed_ical_weekly": (ical_feed, f"WITH {O_SQL} SELECT title, tm + INTERVAL 7 DAY * i::INT AS start_datetime, tm + INTERVAL 7 DAY * i::INT + INTERVAL 90 MINUTE AS end_datetime, 'Oakland' AS city FROM o, (SELECT unnest(range(5)) AS i) WHERE NOT (off AND i = 2)"),
    "page_jsonld": (jsonld_pages, f"WITH {O_SQL} SELECT title, tm AS start_datetime, 'music' AS category, CASE WHEN o_custkey = 0 THEN 'Free' ELSE '$' || o_custkey END AS cost, 'https://shop.example.org/e/' || o_orderkey AS source_url FROM o WHERE NOT off"),
    "page_drupal_rows": (drupal, f"WITH {O_SQL} SELECT title, tm AS start_datetime, 'https://shop.example.org/n/' || o_orderkey AS source_url, 'community' AS category FROM o WHERE NOT off"),
    "page_eventon": (eventon, f"WITH {O_SQL} SELECT title || ' jazz' AS title, tm AS start_datetime, tm + INTERVAL 1 HOUR AS end_datetime, 'music' AS category FROM o WHERE NOT off"),
    "page_text_cards": (text_cards, f"WITH {O_SQL} SELECT title, tm AS start_datetime, 'https://shop.example.org/e/' || o_orderkey AS source_url FROM o WHERE NOT off"),
    "submission_rows": (submitted, f"WITH {O_SQL} SELECT title, tm AS start_datetime, 'Hall ' || o_custkey AS venue_name, '5 Elm St' AS street_address, o_orderkey + 2 AS row_index FROM o WHERE NOT off AND o_orderstatus <> 'F'"),
    "page_platform_scores": (lambda s, d: detect.detect(marked(s, d), use_evidence=False).select("page_id", "platform", "score", "position"),
                             f"WITH {MARKED}, z AS ({_scores_sql()}) SELECT page_id, platform, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, g, platform)::INT AS position FROM z WHERE score >= 0.2"),
    "page_platforms": (lambda s, d: detect.detect(marked(s, d)), None),
    "page_evidence": (lambda s, d: detect.evidence(marked(s, d)).select("page_id", F.array_join("feeds", " ").alias("feeds"), F.col("events").cast("int").alias("events")),
                      f"WITH {MARKED} SELECT page_id, CASE WHEN page_id % 5 = 2 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/x.ics' ELSE '' END AS feeds, 0 AS events FROM m"),
    "page_blocked": (lambda s, d: table(s, d, "pages").withColumn("status", F.when(F.col("page_id") % 9 == 0, 403).otherwise(200)).filter(checks.challenged(F.col("status"), F.col("html"))).select("page_id"),
                     "SELECT page_id FROM pages WHERE page_id % 9 = 0 OR regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '" + "|".join(checks.CHALLENGE_TITLES) + "')"),
    "page_text": (lambda s, d: table(s, d, "pages").select("page_id", F.length(x.strip_html(F.col("html"))).alias("n")), None),
    "page_images": (lambda s, d: checks.page_images(table(s, d, "pages")), None),
    "url_keys": (lambda s, d: table(s, d, "pages").select("page_id", x.url_key(F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("a=2026-10-06"))).alias("key")),
                 r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages) SELECT page_id, lower(regexp_extract(b, '^([^/?]*//[^/?]*)', 1)) || regexp_extract(b, '^[^/?]*//[^/?]*([^?]*)', 1) || '?' ||
                 array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1) || '&a=%3Cdate%3E', '&'), lambda p: p <> '')), '&') AS key FROM u"""),
    "capture_lookup": (lambda s, d: cap.find_capture(
        table(s, d, "pages").select(F.col("url").alias("wanted_url")).distinct(),
        table(s, d, "pages").select("url", F.col("url").alias("final_url"), F.col("page_id").cast("int").alias("seq"), F.lit(200).alias("status"), F.col("html").alias("body"))).select("wanted_url", "url", "seq"),
        "SELECT url AS wanted_url, url, min(page_id)::INT AS seq FROM pages GROUP BY url"),
    "completeness": (lambda s, d: checks.completeness(_paged(s, d).select("source_name", F.col("seq").alias("page"), F.lit(41).alias("total_pages"))),
                     "WITH l AS (SELECT 's' || (l_suppkey % 10) AS source_name, l_orderkey % 40 AS page FROM lineitem) SELECT source_name, 41 AS announced, count(DISTINCT page) AS captured, 41 - count(DISTINCT page) AS pages_missing FROM l GROUP BY ALL"),
    "paging_stop": (lambda s, d: checks.before_repeat(_paged(s, d), ["k"]).groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_page")),
                    """WITH l AS (SELECT 's' || (l_suppkey % 10) AS source_name, (l_orderkey % 40)::INT AS seq, l_partkey AS k FROM lineitem), f AS (SELECT source_name, k, min(seq) seq FROM l GROUP BY ALL),
                    st AS (SELECT source_name, min(seq) stop FROM (SELECT DISTINCT source_name, seq FROM l EXCEPT SELECT source_name, seq FROM f) GROUP BY ALL)
                    SELECT source_name, count(*) AS rows, max(seq) AS last_page FROM l LEFT JOIN st USING (source_name) WHERE stop IS NULL OR seq < stop GROUP BY ALL"""),
    "source_outcomes": (_outcomes, """WITH l AS (SELECT 's' || (l_suppkey % 10) AS source_name, l_orderkey % 40 AS seq, l_partkey k FROM lineitem), c AS (SELECT source_name, seq, min(k) % 3 = 0 AS bad FROM l GROUP BY ALL),
        r AS (SELECT source_name, count(*) n FROM l WHERE source_name IN ('s1', 's2', 's3') GROUP BY ALL)
        SELECT source_name AS source, CASE WHEN any_value(n) IS NULL AND bool_or(bad) THEN 'failed' ELSE 'ok' END AS status, coalesce(any_value(n), 0) AS returned FROM c LEFT JOIN r USING (source_name) GROUP BY source_name"""),
}
