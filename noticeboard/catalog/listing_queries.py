"""Normalising, rules, places, identity, publish set, diffs, duplicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text as x, times
from ..operators import dedup, normalise as n, places, publish as pub
from ..schema import CANDIDATE, LISTING, USER_SUBMITTED, conform
from ..operators.normalise import number_rows
from ..sources import registry as reg
from ..sources.stored import canonical_order
from .views import AS_OF, DV, LV, REG, doc_listings, full_listings, listings, registry, table

L = full_listings


def esc(p):
    return p.replace("'", "''")


def clean_sql(c):
    return (rf"trim(regexp_replace(regexp_replace(trim(regexp_replace({c}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ', 'g')), '&[a-z]+;', ' ', 'g'), '([!?.]){{2,}}', '\1', 'g'))")


def fold_sql(c):
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_\p{{Pc}}\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


WB, WE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
FAMILY = f"{WB}(?:{'|'.join(rules.FAMILY_WORDS)}){WE}|{rules.any_of(rules.FAMILY_PHRASES)}"
FAM_SQL = (f"(regexp_matches(lower(title || ' ' || description), '{esc(FAMILY)}') AND (hour(start_datetime) < 19 OR regexp_matches(lower(title || ' ' || description), '{esc(rules.any_of(rules.EXPLICIT_FAMILY))}')))")
FOODT = f"{WB}(?:{'|'.join(rules.FOOD_VENUE_TYPES)}){WE}"
FOOD_SQL = (f"(NOT regexp_matches(lower(coalesce(venue_name, '')), '{rules.any_of(rules.FOOD_EXCLUDED_VENUES)}') AND (regexp_matches(lower(coalesce(venue_name, '')) || chr(10) || lower(source_name), '{rules.any_of(rules.FOOD_VENUE_NAMES)}') "
            f"OR regexp_matches(lower(coalesce(venue_name, '')), '{FOODT}') OR regexp_matches(lower(source_name), '{FOODT}') OR regexp_matches(lower(title || ' ' || description), '{esc(rules.any_of(rules.FOOD_KEYWORDS))}')))")
LOWQ = (rf"(length(trim(lower(title))) < 3 OR regexp_matches(trim(lower(title)), '^[0-9/\-\s:]+$') OR regexp_matches(trim(lower(title)), '{rules.LOW_QUALITY_MONTH}') "
        f"OR trim(lower(title)) IN {rules.GENERIC_TITLES} OR regexp_matches(lower(title), '{rules.any_of(rules.INTERFACE_TEXT)}'))")


def reason_sql(now, start="start_datetime"):
    t = f"TIMESTAMP '{now}'"
    r = n.REASONS
    return (f"CASE WHEN length(trim(title)) < 3 THEN '{r[0]}' WHEN length(trim(description)) < 10 THEN '{r[1]}' WHEN {start} IS NULL THEN '{r[2]}' WHEN {start} <> date_trunc('minute', {start}) THEN '{r[3]}' "
            f"WHEN {start} < {t} - INTERVAL 30 DAY THEN '{r[4]}' WHEN {start} > {t} + INTERVAL 730 DAY THEN '{r[5]}' WHEN {LOWQ} THEN '{r[6]}' END")


NOW = "2024-02-05 12:00:00"


def mixed(spark, sf):
    """Candidates with every defect: some raw (sub-minute) starts, some without, some far away."""
    k = F.col("k")
    return listings(spark, sf).withColumn("start_datetime", F.when(k % 17 == 0, F.col("raw_start")).when(k % 19 != 0, F.col("start_datetime"))) \
        .withColumn("start_datetime", F.when(k % 23 == 0, F.col("start_datetime") + F.expr("INTERVAL 800 DAYS")).otherwise(F.col("start_datetime")))


MIXED = LV + """, m0 AS (SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN raw_start WHEN k % 19 <> 0 THEN start_datetime END AS start_datetime) FROM lv),
 mx AS (SELECT * REPLACE (CASE WHEN k % 23 = 0 THEN start_datetime + INTERVAL 800 DAY ELSE start_datetime END AS start_datetime) FROM m0)"""


def rules_sql(rule_set, text, default="NULL"):
    whens = " ".join(f"WHEN regexp_matches({text}, '{esc(rules.any_of(words))}') THEN '{cat}'" for cat, words in rule_set)
    return f"CASE {whens} ELSE {default} END"


# a gazetteer grown from the supplier and nation tables, and names that contain its keys
def venues(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    base = s.select(F.lower(F.concat(F.lit("room "), F.col("s_suppkey").cast("string"), F.lit(" n"), F.col("s_nationkey").cast("string"))).alias("key"), F.col("s_name").alias("name"),
                    F.col("s_nationkey") + F.lit(0.25), F.col("s_nationkey") - F.lit(0.5), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("City "), F.col("n_name"))).alias("city"), F.col("s_suppkey").alias("key_ix"))
    return base.toDF("key", "name", "lat", "lng", "city", "key_ix")


def addressed(spark, sf):
    """Customers as candidate places: names around a key, and addresses naming a city."""
    c, m = table(spark, sf, "customer"), table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("m"))
    c = c.join(F.broadcast(m)).join(table(spark, sf, "supplier").select(F.col("s_suppkey"), F.col("s_nationkey")), F.col("c_custkey") % F.col("m") == F.col("s_suppkey"))
    key = F.concat(F.lit("Room "), F.col("s_suppkey").cast("string"), F.lit(" N"), F.col("s_nationkey").cast("string"))
    name = (F.when(F.col("c_custkey") % 4 == 0, key).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("The "), key, F.lit(", Upstairs")))
            .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Hall "), F.col("c_custkey").cast("string"))))
    street = (F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("12 Elm St, City NATION_"), F.col("c_nationkey").cast("string"), F.lit(", CA 94110")))
              .when(F.col("c_custkey") % 5 == 1, F.lit("4 Oak, San Jose")).when(F.col("c_custkey") % 5 == 2, F.lit("San Jose Ave")))
    return c.select(F.col("c_custkey").alias("arrival_ix"), name.alias("venue_name"), street.alias("street_address"))


PLACES = """ven AS (SELECT 'room ' || s_suppkey || ' n' || s_nationkey AS key, s_nationkey + 0.25::DOUBLE AS lat, s_nationkey - 0.5::DOUBLE AS lng, CASE WHEN s_suppkey % 3 <> 0 THEN 'City NATION_' || s_nationkey END AS city, s_suppkey AS ix FROM supplier),
 adr AS (SELECT c_custkey AS arrival_ix, CASE c_custkey % 4 WHEN 0 THEN 'Room ' || s_suppkey || ' N' || s_nationkey WHEN 1 THEN 'The Room ' || s_suppkey || ' N' || s_nationkey || ', Upstairs' WHEN 2 THEN 'Hall ' || c_custkey END AS venue_name,
  CASE c_custkey % 5 WHEN 0 THEN '12 Elm St, City NATION_' || c_nationkey || ', CA 94110' WHEN 1 THEN '4 Oak, San Jose' WHEN 2 THEN 'San Jose Ave' END AS street_address
  FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey),
 nm AS (SELECT DISTINCT lower(venue_name) AS name_key FROM adr WHERE venue_name IS NOT NULL),
 hit AS (SELECT name_key, key, name_key = key AS ex, length(key) AS n, ix FROM nm, ven WHERE name_key = key OR regexp_matches(name_key, '(?:^|[^\\p{L}\\p{N}_])' || key || '(?:$|[^\\p{L}\\p{N}_])') OR regexp_matches(key, '(?:^|[^\\p{L}\\p{N}_])' || name_key || '(?:$|[^\\p{L}\\p{N}_])')),
 gm AS (SELECT name_key, key FROM hit QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY ex DESC, n DESC, ix) = 1)""".replace("\\\\", "\\")


def snapshots(spark, sf):
    """The listing view, and a later snapshot of it: rows gone, rows new, fields changed."""
    a = L(spark, sf)
    b = (a.filter("arrival_ix % 10 <> 3").withColumn("title", F.when(F.col("arrival_ix") % 10 == 4, F.concat("title", F.lit(" *"))).otherwise(F.col("title")))
         .withColumn("cost", F.when(F.col("arrival_ix") % 20 == 4, F.lit(None)).when(F.col("arrival_ix") % 10 == 5, F.lit("$9")).otherwise(F.col("cost"))))
    new = a.filter("arrival_ix % 10 = 6").withColumn("id", F.concat(F.lit("n"), "id"))
    return a, b.unionByName(new)


SNAP = LV + """, a AS (SELECT id, arrival_ix, title, source_name, start_datetime, cost FROM lv),
 b AS (SELECT id, CASE WHEN arrival_ix % 10 = 4 THEN title || ' *' ELSE title END AS title, source_name, start_datetime, CASE WHEN arrival_ix % 20 = 4 THEN NULL WHEN arrival_ix % 10 = 5 THEN '$9' ELSE cost END AS cost FROM a WHERE arrival_ix % 10 <> 3
   UNION ALL SELECT 'n' || id, title, source_name, start_datetime, cost FROM a WHERE arrival_ix % 10 = 6),
 d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title OR a.cost IS DISTINCT FROM b.cost THEN 'changed' ELSE 'unchanged' END AS change,
   coalesce(b.title, a.title) AS title, coalesce(b.source_name, a.source_name) AS source_name,
   CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL AND (a.title IS DISTINCT FROM b.title OR a.cost IS DISTINCT FROM b.cost) THEN concat_ws(',', CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN a.cost IS DISTINCT FROM b.cost THEN 'cost' END) END AS fields
   FROM a FULL JOIN b ON a.id = b.id)"""


def near_rows(spark, sf):
    """Candidates with real near copies: document titles spread over two sources and a few start times."""
    d = doc_listings(spark, sf)
    rows = d.withColumn("venue_name", F.when(F.col("d3") > 0, F.concat(F.lit("Hall "), F.col("d3").cast("string"))))
    again = rows.withColumn("arrival_ix", F.col("arrival_ix") + 10_000_000_000).withColumn("source_name", F.lit("purchase")) \
        .withColumn("title", F.concat(F.lit("Live: "), "title")).withColumn("start_datetime", F.col("start_datetime") + F.expr("INTERVAL 30 MINUTES"))
    return conform(rows.unionByName(again), CANDIDATE)


def _reconcile(spark, sf):
    rows = near_rows(spark, sf)
    fresh, old = pub.reconcile(rows.filter("arrival_ix < 10000000000"), rows.filter("arrival_ix >= 10000000000"), registry(spark))
    return fresh.select(F.lit("fresh").alias("side"), "arrival_ix").union(old.select(F.lit("preserved"), "arrival_ix"))


def _preserve(spark, sf):
    stored = L(spark, sf)
    produced = stored.filter("source_name IN ('click', 'view')").select("source_name").distinct()
    ran = reg.run_order(registry(spark), is_ci=True).select("name")
    return pub.preserved_rows(stored, registry(spark), reg.skipped_in_ci(registry(spark)), produced, ran, "2024-01-20 09:00:00").select("id", "source_name")


def _submitted(spark, sf):
    rows = L(spark, sf).withColumn("source_name", F.lit(USER_SUBMITTED))
    return pub.new_submissions(rows.filter("arrival_ix % 2 = 0"), rows.filter("arrival_ix % 6 = 1")).select("id")


def _backfill(spark, sf):
    rows = doc_listings(spark, sf).withColumn("category", F.when(F.col("d3") == 0, "other").when(F.col("d3") == 1, F.lit("music"))).withColumn("venue_name", F.col("source_name"))
    work = n.category_worklist(rows)
    labels = table(spark, sf, "labels").join(work, F.col("doc_id") == F.col("arrival_ix")).select("batch", "position", F.when(F.col("quality") == 1, "lectures").otherwise("nonsense").alias("word"))
    replies = labels.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("position").cast("string"), F.lit(": "), "word"))), "\n").alias("reply"))
    return n.apply_categories(rows, work, n.parse_replies(replies)).select("arrival_ix", "category")


QUERIES = {
    "identity_title": (lambda s, d: doc_listings(s, d).select("arrival_ix", x.identity_title(F.col("title")).alias("folded")), f"WITH {DV} SELECT arrival_ix, {fold_sql('title')} AS folded FROM dv"),
    "content_id": (lambda s, d: listings(s, d).select("arrival_ix", pub.content_id(F.col("source_name"), F.col("source_url"), F.col("raw_start"), F.col("title")).alias("cid")),
                   f"WITH {LV} SELECT arrival_ix, substring(sha256(source_name || '|' || source_url || '|' || strftime(raw_start, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', raw_start)::BIGINT % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(date_part('microsecond', raw_start)::BIGINT % 1000000 AS VARCHAR), 6, '0') END || '|' || {fold_sql('title')}), 1, 32) AS cid FROM lv"),
    "promote_listings": (lambda s, d: pub.promote(conform(listings(s, d), CANDIDATE), AS_OF)[0].select("id", "source_name", "title", "scraped_at"),
                         f"WITH {LV} SELECT substring(sha256(source_name || '|' || source_url || '|' || strftime(start_datetime, '%Y-%m-%dT%H:%M:%S') || '|' || {fold_sql('title')}), 1, 32) AS id, source_name, title, TIMESTAMP '{AS_OF}' AS scraped_at FROM lv"),
    "promote_over_limit": (lambda s, d: pub.promote(conform(doc_listings(s, d), CANDIDATE), AS_OF)[1].select("arrival_ix", "over_limit"), f"WITH {DV} SELECT arrival_ix, 'description' AS over_limit FROM dv WHERE length(description) > 2000"),
    "clean_text": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(x.clean_text(F.col("text"))).alias("h"), F.length(x.clean_text(F.col("text"))).alias("n")),
                   f"SELECT doc_id, md5({clean_sql('text')}) AS h, length({clean_sql('text')}) AS n FROM documents"),
    "low_quality_title": (lambda s, d: listings(s, d).filter(rules.low_quality_title(F.col("title"))).select("id", "title"), f"WITH {LV} SELECT id, title FROM lv WHERE {LOWQ}"),
    "reject_reason": (lambda s, d: mixed(s, d).select("id", n.reject_reason(NOW).alias("reject_reason")), f"WITH {MIXED} SELECT id, {reason_sql(NOW)} AS reject_reason FROM mx"),
    "reject_tally": (lambda s, d: n.validate(mixed(s, d), NOW)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows")),
                     f"WITH {MIXED}, r AS (SELECT {reason_sql(NOW)} AS reject_reason FROM mx) SELECT reject_reason, count(*) AS rows FROM r WHERE reject_reason IS NOT NULL GROUP BY ALL"),
    "reject_reason_documents": (lambda s, d: doc_listings(s, d).select("arrival_ix", n.reject_reason(NOW).alias("reject_reason")), f"WITH {DV} SELECT arrival_ix, {reason_sql(NOW)} AS reject_reason FROM dv"),
    "family_rule": (lambda s, d: listings(s, d).filter(rules.family_friendly(F.col("title"), F.col("description"), F.col("start_datetime"))).select("id"), f"WITH {LV} SELECT id FROM lv WHERE {FAM_SQL}"),
    "food_rule": (lambda s, d: listings(s, d).filter(rules.food_and_drink(F.col("venue_name"), F.col("source_name"), F.col("title"), F.col("description"))).select("id"), f"WITH {LV} SELECT id FROM lv WHERE {FOOD_SQL}"),
    "family_rule_documents": (lambda s, d: doc_listings(s, d).filter(rules.family_friendly(F.col("title"), F.col("description"), F.col("start_datetime"))).select("arrival_ix"), f"WITH {DV} SELECT arrival_ix FROM dv WHERE {FAM_SQL}"),
    "platform_category_rules": (lambda s, d: table(s, d, "documents").select("doc_id", rules.first_rule(F.col("text"), rules.CIVIC_RULES, "community").alias("civic"), rules.first_rule(F.col("text"), rules.EVENTON_RULES).alias("eventon"), rules.first_rule(F.col("text"), rules.BOOKSHOP_RULES, "lectures").alias("bookshop")),
                                f"SELECT doc_id, {rules_sql(rules.CIVIC_RULES, 'lower(text)', chr(39) + 'community' + chr(39))} AS civic, {rules_sql(rules.EVENTON_RULES, 'lower(text)')} AS eventon, {rules_sql(rules.BOOKSHOP_RULES, 'lower(text)', chr(39) + 'lectures' + chr(39))} AS bookshop FROM documents"),
    "platform_category_titles": (lambda s, d: listings(s, d).select("id", rules.first_rule(F.concat_ws(" ", "title", "description"), rules.CIVIC_RULES, "community").alias("category")),
                                 f"WITH {LV} SELECT id, {rules_sql(rules.CIVIC_RULES, 'lower(title || chr(32) || description)', chr(39) + 'community' + chr(39))} AS category FROM lv"),
    "gazetteer_match": (lambda s, d: places.match_gazetteer(addressed(s, d).select(x.place_key(F.col("venue_name")).alias("name_key")), venues(s, d)), f"WITH {PLACES} SELECT name_key, key FROM gm"),
    "named_city": (lambda s, d: places.named_city(addressed(s, d).select(F.col("street_address").alias("text")), places.known_cities(venues(s, d))),
                   f"""WITH {PLACES}, kc AS (SELECT unnest(['San Francisco', 'Oakland', 'San Jose', 'Berkeley']) AS city UNION SELECT city FROM ven WHERE city IS NOT NULL), tx AS (SELECT DISTINCT street_address AS text FROM adr WHERE street_address IS NOT NULL)
                   SELECT text, city AS named_city FROM tx, kc WHERE regexp_matches(text, '(?:^|[,\\s])(?i:' || city || ')(?:\\s*,|\\s+[A-Z]{{2}}(?:[^\\p{{L}}\\p{{N}}_]|$)|\\s+[0-9]{{5}}(?:[^0-9]|$)|\\s*$)') QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(city) DESC, city DESC) = 1""".replace("\\\\", "\\")),
    "resolve_places": (lambda s, d: places.resolve_places(addressed(s, d), venues(s, d), addressed(s, d).filter("arrival_ix % 4 = 2").select(places.geocode_key(F.col("venue_name"), F.col("street_address")).alias("key"), (F.col("arrival_ix") % 3 == 0).alias("hit"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"), F.lit("Cache Town").alias("city")).dropDuplicates(["key"]).filter("key LIKE 'name:%'")).select("arrival_ix", "place_city", "place_lat", "place_lng"),
                       f"""WITH {PLACES}, kc AS (SELECT unnest(['San Francisco', 'Oakland', 'San Jose', 'Berkeley']) AS city UNION SELECT city FROM ven WHERE city IS NOT NULL), tx AS (SELECT DISTINCT street_address AS text FROM adr WHERE street_address IS NOT NULL),
                       nc AS (SELECT text, city FROM tx, kc WHERE regexp_matches(text, '(?:^|[,\\s])(?i:' || city || ')(?:\\s*,|\\s+[A-Z]{{2}}(?:[^\\p{{L}}\\p{{N}}_]|$)|\\s+[0-9]{{5}}(?:[^0-9]|$)|\\s*$)') QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(city) DESC) = 1)
                       SELECT adr.arrival_ix, coalesce(ven.city, nc.city, CASE WHEN gm.key IS NULL AND adr.arrival_ix % 4 = 2 AND adr.arrival_ix % 3 = 0 AND NOT regexp_matches(coalesce(street_address, ''), '[0-9]') THEN 'Cache Town' END) AS place_city,
                       CASE WHEN gm.key IS NOT NULL THEN ven.lat WHEN adr.arrival_ix % 4 = 2 AND adr.arrival_ix % 3 = 0 AND NOT regexp_matches(coalesce(street_address, ''), '[0-9]') THEN 1.5::DOUBLE END AS place_lat,
                       CASE WHEN gm.key IS NOT NULL THEN ven.lng WHEN adr.arrival_ix % 4 = 2 AND adr.arrival_ix % 3 = 0 AND NOT regexp_matches(coalesce(street_address, ''), '[0-9]') THEN 2.5::DOUBLE END AS place_lng
                       FROM adr LEFT JOIN gm ON lower(venue_name) = name_key LEFT JOIN ven USING (key) LEFT JOIN nc ON street_address = text""".replace("\\\\", "\\")),
    "region_box": (lambda s, d: listings(s, d).filter(places.in_region(F.col("latitude") + F.col("k") / F.lit(20.0), F.col("longitude"))).select("id"),
                   f"WITH {LV} SELECT id FROM lv WHERE latitude + k / 20.0::DOUBLE BETWEEN 37.80 - 150 / 111.0::DOUBLE AND 37.80 + 150 / 111.0::DOUBLE AND longitude BETWEEN -122.27 - 150 / (111.0::DOUBLE * cos(radians(37.80))) AND -122.27 + 150 / (111.0::DOUBLE * cos(radians(37.80)))"),
    "geocode_keys": (lambda s, d: listings(s, d).select("id", places.geocode_key(F.col("venue_name"), F.col("street_address")).alias("key")),
                     f"WITH {LV} SELECT id, CASE WHEN regexp_matches(coalesce(street_address, ''), '[0-9]') THEN 'address:' || lower(street_address) WHEN venue_name IS NOT NULL THEN 'name:' || lower(venue_name) END AS key FROM lv"),
    "enhance_and_validate": (lambda s, d: n.validate(n.enhance(conform(listings(s, d), CANDIDATE), venues(s, d), s.createDataFrame([], "key string, hit boolean, lat double, lng double, city string")), NOW)[0].select("arrival_ix", "title", "city", "category", "family_friendly"), None),
    "snapshot_diff": (lambda s, d: pub.diff_snapshots(*snapshots(s, d)).withColumn("fields", F.array_join("fields", ",")), f"WITH {SNAP} SELECT * FROM d"),
    "diff_counts": (lambda s, d: pub.diff_counts(pub.diff_snapshots(*snapshots(s, d))), f"WITH {SNAP} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged FROM d"),
    "diff_by_source": (lambda s, d: pub.diff_by_source(pub.diff_snapshots(*snapshots(s, d))), f"WITH {SNAP} SELECT source_name, count(*) AS rows FROM d WHERE change IN ('added', 'removed') GROUP BY ALL ORDER BY rows DESC, source_name LIMIT 8"),
    "order_snapshot_diff": (lambda s, d: _order_diff(s, d), """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 40 <> 1)
        SELECT CAST(a.o_orderkey AS VARCHAR) AS id, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus <> b.st THEN 'changed' ELSE 'unchanged' END AS change FROM orders a LEFT JOIN b USING (o_orderkey)"""),
    "preserve_and_rescue": (_preserve, f"WITH {LV} SELECT id, source_name FROM lv WHERE source_name = 'error' OR (source_name IN ('purchase', 'signup') AND start_datetime >= DATE '2024-01-20')"),
    "replace_sources": (lambda s, d: pub.replace_sources(L(s, d), L(s, d).filter("k = 1 AND source_name <> 'view'")).select("id"), f"WITH {LV} SELECT id FROM lv WHERE source_name NOT IN (SELECT source_name FROM lv WHERE k = 1 AND source_name <> 'view')"),
    "new_submissions": (_submitted, f"""WITH {LV}, a AS (SELECT *, lower(title) t, CAST(start_datetime AS DATE) dd FROM lv) SELECT id FROM a WHERE arrival_ix % 2 = 0 AND (t, dd) NOT IN (SELECT (t, dd) FROM a WHERE arrival_ix % 6 = 1) QUALIFY row_number() OVER (PARTITION BY t, dd ORDER BY arrival_ix) = 1"""),
    "canonical_order": (lambda s, d: number_rows(canonical_order(L(s, d)).withColumn("_o", F.struct("start_datetime", "id")), "_o").select("id", "start_datetime", F.col("n").cast("bigint").alias("position")), f"WITH {LV} SELECT id, start_datetime, row_number() OVER (ORDER BY start_datetime, id) - 1 AS position FROM lv"),
    "first_wins": (lambda s, d: dedup.first_wins(listings(s, d), ["source_url", "title"]).select("id"), f"WITH {LV} SELECT id FROM lv QUALIFY row_number() OVER (PARTITION BY source_url, title ORDER BY arrival_ix) = 1"),
    "same_source_duplicates": (lambda s, d: dedup.same_source_pairs(listings(s, d).withColumn("start_datetime", F.date_trunc("day", "start_datetime").cast("timestamp_ntz"))).groupBy("src").agg(F.sum("row_pairs").cast("bigint").alias("row_pairs")),
                               f"WITH {LV}, z AS (SELECT *, date_trunc('day', start_datetime) st, coalesce(lower(venue_name), '') v, {fold_sql('title')} t FROM lv) SELECT a.source_name AS src, count(*) AS row_pairs FROM z a JOIN z b ON a.source_name = b.source_name AND a.st = b.st AND a.t = b.t AND a.arrival_ix < b.arrival_ix WHERE a.v = '' OR b.v = '' OR a.v = b.v GROUP BY ALL"),
    "interval_pairs": (lambda s, d: dedup.interval_pair_counts(listings(s, d)).groupBy(F.expr("sec div 86400").alias("day_no")).agg(F.sum("pairs").cast("bigint").alias("pairs")),
                       f"WITH {LV}, z AS (SELECT arrival_ix, CAST(epoch(start_datetime) AS BIGINT) s FROM lv) SELECT a.s // 86400 AS day_no, count(*) AS pairs FROM z a JOIN z b ON b.s BETWEEN a.s AND a.s + 3600 AND (a.s < b.s OR a.arrival_ix < b.arrival_ix) GROUP BY ALL"),
    "duplicate_groups": (lambda s, d: dedup.assign_groups(near_rows(s, d)).filter("group_size > 1").select("arrival_ix", "group_ix", "group_size"), None),
    "merged_listings": (lambda s, d: dedup.deduplicate(near_rows(s, d), registry(s)).select("arrival_ix", "source_name", "title", "venue_name", "start_datetime"), None),
    "second_pass": (lambda s, d: pub.second_pass(near_rows(s, d), registry(s)).select("arrival_ix", "source_name", "title"), None),
    "reconcile": (_reconcile, None),
    "category_worklist": (lambda s, d: n.category_worklist(doc_listings(s, d).withColumn("category", F.when(F.col("d3") == 0, "other").when(F.col("d3") == 1, F.lit("music"))).withColumn("venue_name", F.col("source_name"))).select("arrival_ix", "batch", "position"),
                          f"WITH {DV}, z AS (SELECT arrival_ix, row_number() OVER (ORDER BY arrival_ix) - 1 AS q FROM dv WHERE d3 <> 1) SELECT arrival_ix, q // 25 AS batch, (q % 25)::INT AS position FROM z"),
    "category_backfill": (_backfill, f"WITH {DV} SELECT arrival_ix, CASE WHEN d3 <> 1 AND quality = 1 THEN 'lectures' WHEN d3 = 0 THEN 'other' WHEN d3 = 1 THEN 'music' END AS category FROM dv LEFT JOIN labels ON doc_id = arrival_ix"),
    "family_backfill": (lambda s, d: n.apply_family(L(s, d), n.family_worklist(L(s, d), ("Hall 1", "Hall 2")).filter("arrival_ix % 2 = 0")).filter("family_friendly").select("id"),
                        f"WITH {LV} SELECT id FROM lv WHERE family_friendly OR (venue_name IN ('Hall 1', 'Hall 2') AND arrival_ix % 2 = 0)"),
    "known_cities": (lambda s, d: places.known_cities(venues(s, d)), f"WITH {PLACES} SELECT unnest(['San Francisco', 'Oakland', 'San Jose', 'Berkeley']) AS city UNION SELECT city FROM ven WHERE city IS NOT NULL"),
    "source_ranks": (lambda s, d: reg.with_source_rank(L(s, d), registry(s)).select("id", "source_rank", "source_manual"), f"WITH {LV}, {REG} SELECT id, coalesce(rnk, 2)::INT AS source_rank, coalesce(manual, false) AS source_manual FROM lv LEFT JOIN reg ON name = source_name"),
    "wall_clock_to_offset": (lambda s, d: listings(s, d).select("id", times.iso_with_offset(F.col("start_datetime") + F.expr("INTERVAL 50 DAYS"), "America/Los_Angeles").alias("iso")),
                             f"WITH {LV}, z AS (SELECT id, start_datetime + INTERVAL 50 DAY t FROM lv) SELECT id, strftime(t, '%Y-%m-%dT%H:%M:00') || CASE WHEN t >= TIMESTAMP '2024-03-10 02:00:00' THEN '-07:00' ELSE '-08:00' END AS iso FROM z"),
}


def _order_diff(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("arrival_ix"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("source_name"), F.col("o_orderdate").alias("start_datetime"))
    full = lambda df: conform(df, LISTING)
    later = o.filter("arrival_ix % 40 <> 1").withColumn("title", F.when(F.col("arrival_ix") % 50 == 7, "X").otherwise(F.col("title")))
    return pub.diff_snapshots(full(o), full(later)).select("id", "change")
