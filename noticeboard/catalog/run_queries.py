"""What a run reports about itself: stages, errors, completeness, disagreements; referential checks; captured geocoder answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import list_phrase
from ..operators import monitors, normalise as n, places, referential as r, search_index, serve, snapshots
from ..operators.extract import checks, jobs
from ..operators.extract.common import agree
from ..operators.extract.json_feeds import announced_pages
from ..sources.registry import registry_frame
from .listing_queries import MIXED, NOW, SNAP, mixed, reason_sql, snapshots as listing_snapshots
from .serving_queries import QUERIES as SERVING
from .views import AS_OF, LV, REG, full_listings, listings, registry, table


def _stages(spark, sf):
    rows = mixed(spark, sf)
    accepted, _ = n.validate(rows, NOW)
    return monitors.stage_counts(scraped=rows, validated=accepted, final=accepted.filter(F.col("start_datetime") >= AS_OF))


def _errors(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("s", F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")))
    caps = l.groupBy(F.col("s").alias("source_name"), (F.col("l_orderkey") % 40).cast("int").alias("seq")).agg(F.when(F.min("l_partkey") % 3 == 0, 403).otherwise(200).alias("status")) \
        .withColumn("url", F.concat(F.lit("u"), "seq"))
    rows = l.filter("s < 's4'").select(F.col("s").alias("source_name"))
    cut = checks.completeness(l.select(F.col("s").alias("source_name"), (F.col("l_orderkey") % 40).alias("page"), F.lit(45).alias("total_pages")))
    out = monitors.run_errors(checks.source_outcomes(caps, rows, cut=cut.filter("source_name < 's4'")), "run-1")
    return out.select("run_id", F.array_join(F.transform("scrapers", lambda s: F.concat_ws("|", s["source"], s["status"], s["returned"].cast("string"), s["error"])), "\n").alias("scrapers"))


ERRORS_SQL = """WITH l AS (SELECT 's' || (l_suppkey % 10) AS s, (l_orderkey % 40)::INT AS seq, l_partkey AS k FROM lineitem), c AS (SELECT s, seq, min(k) % 3 = 0 AS bad FROM l GROUP BY ALL),
 f AS (SELECT s, bool_or(bad) AS bad, min(seq) FILTER (bad) AS first, count(*) AS pages FROM c GROUP BY s), n AS (SELECT s, count(*) AS n FROM l WHERE s < 's4' GROUP BY s),
 o AS (SELECT s, coalesce(n, 0) AS n, CASE WHEN n IS NULL AND bad THEN 'failed' ELSE 'ok' END AS st, CASE WHEN n IS NULL AND bad THEN '0 rows after HTTP 403 from u' || first WHEN s < 's4' AND pages < 45 THEN 'read ' || pages || ' of 45 announced pages' END AS e
   FROM f LEFT JOIN n USING (s))
 SELECT 'run-1' AS run_id, string_agg(concat_ws('|', s, st, n, e), chr(10) ORDER BY s) AS scrapers FROM o"""


def _announced(spark, sf):
    """Responses of ten feeds that announce more pages than were read, on two platforms."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("s"), F.expr("o_orderkey % 37").cast("int").alias("seq")).distinct()
    body = F.when(F.col("s") % 2 == 0, F.concat(F.lit('{"events": [], "total_pages": '), (F.col("s") + 33).cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"events": [], "page": {"total": '), (F.col("s") + 33).cast("string"), F.lit("}}")))
    caps = o.select(F.concat(F.lit("feed "), F.col("s").cast("string")).alias("source_name"), "seq", F.lit(200).alias("status"), body.alias("body"))
    reg = registry_frame(spark, [{"name": f"feed {i}", "adapter": "tribe" if i % 2 == 0 else "localist", "url": "https://x.example.org"} for i in range(10)])
    return checks.completeness(announced_pages(caps, reg))


def _agree(spark, sf):
    """Two statements of one day that should agree."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("source_name"), F.date_trunc("month", "l_shipdate").alias("a"), F.date_trunc("month", "o_orderdate").alias("b"))
    return agree(l, "a", "b")[1]


def _answers(spark, sf):
    """Captured geocoder answers: every fourth key by address, results out of the region, of the wrong kind, or fine."""
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    one = lambda i, lat, cat, kind, town: F.struct(lat.cast("string").alias("lat"), F.lit("-122.270001").alias("lon"), cat.alias("category"), kind.alias("type"),
                                                   F.create_map(F.lit("town"), town).alias("address"))
    word = lambda col: col if not isinstance(col, str) else F.lit(col)
    results = F.array(one(0, F.when(F.col("k") % 3 == 0, F.lit(60.0)).otherwise(F.lit(37.5)), F.when(F.col("k") % 5 == 0, word("highway")).otherwise(word("amenity")), word("cafe"), F.concat(F.lit("A"), F.col("k").cast("string"))),
                      one(1, F.lit(37.25), F.when(F.col("k") % 7 == 0, word("place")).otherwise(word("building")), word("town"), F.concat(F.lit("B"), F.col("k").cast("string"))))
    key = F.concat(F.when(F.col("k") % 4 == 0, "address:").otherwise("name:"), F.col("k").cast("string"))
    return places.pick_answers(c.select(key.alias("key"), results.alias("results")))


ANSWERS_SQL = """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS addr FROM customer),
 p AS (SELECT *, k % 3 <> 0 AND (addr OR k % 5 <> 0) AS one, addr OR k % 7 <> 0 AS two FROM c)
 SELECT CASE WHEN addr THEN 'address:' ELSE 'name:' END || k AS key, one OR two AS hit, CASE WHEN one THEN 37.5 WHEN two THEN 37.25 END::DOUBLE AS lat, CASE WHEN one OR two THEN -122.270001 END::DOUBLE AS lng,
  CASE WHEN one THEN 'A' || k WHEN two THEN 'B' || k END AS city FROM p"""


def _phrases(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(list_phrase(F.array_sort(F.collect_set(F.when(F.col("o_orderkey") % 5 != 0, F.trim("o_orderpriority")).otherwise("")))).alias("phrase"))


PHRASE_SQL = """WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(trim(o_orderpriority)) FILTER (o_orderkey % 5 <> 0))) AS p FROM orders GROUP BY o_custkey)
 SELECT o_custkey, CASE WHEN coalesce(len(p), 0) <= 1 THEN coalesce(p[1], '') ELSE array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] END AS phrase FROM g"""


def _references(spark, sf):
    df = full_listings(spark, sf).withColumn("category", F.when(F.col("arrival_ix") % 50 == 3, F.concat(F.lit("odd "), (F.col("arrival_ix") % 4).cast("string"))).otherwise(F.col("category")))
    monitored = registry(spark).filter("name <> 'quiet'").select("name")
    return r.violations(r.listing_constraints(df, registry(spark), monitored, [*jobs(), "custom"]))


REFERENCES_SQL = f"""WITH {LV}, {REG}, c AS (SELECT *, CASE WHEN arrival_ix % 50 = 3 THEN 'odd ' || (arrival_ix % 4) ELSE category END AS cat FROM lv)
 SELECT 'unregistered_source' AS rule, source_name AS subject, count(*) AS rows, arg_min(id, arrival_ix) AS example FROM lv WHERE source_name NOT IN (SELECT name FROM reg) GROUP BY source_name
 UNION ALL SELECT 'unmonitored_source', 'quiet', 1, NULL
 UNION ALL SELECT 'unknown_category', cat, count(*), arg_min(id, arrival_ix) FROM c WHERE cat NOT IN ('music', 'arts and culture', 'food and drink', 'theater', 'lectures', 'sports', 'community', 'other') GROUP BY cat"""


def _offset_bounds(spark, sf):
    rows = serve.filter_listings(full_listings(spark, sf), AS_OF, start="2024-01-16T02:00:00-05:00", end="2024-01-18T12:30:00Z", zone="America/Los_Angeles")
    return rows.select("id")


QUERIES = {
    "stage_counts": (_stages, f"""WITH {MIXED}, r AS (SELECT *, {reason_sql(NOW)} AS why FROM mx) SELECT 'scraped' AS stage, count(*) AS rows FROM r
        UNION ALL SELECT 'validated', count(*) FILTER (why IS NULL) FROM r UNION ALL SELECT 'final', count(*) FILTER (why IS NULL AND start_datetime >= TIMESTAMP '{AS_OF}') FROM r"""),
    "run_errors": (_errors, ERRORS_SQL),
    "announced_pages": (_announced, """WITH o AS (SELECT DISTINCT o_custkey % 10 AS s, o_orderkey % 37 AS seq FROM orders)
        SELECT 'feed ' || s AS source_name, (s + 33)::INT AS announced, count(*) AS captured, greatest(s + 33 - count(*), 0)::BIGINT AS pages_missing FROM o GROUP BY s"""),
    "disagreements": (_agree, "SELECT o_orderpriority AS source_name, count(*) FILTER (date_trunc('month', l_shipdate) <> date_trunc('month', o_orderdate)) AS disagreements, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"),
    "geocoder_answers": (_answers, ANSWERS_SQL),
    "list_phrases": (_phrases, PHRASE_SQL),
    "referential_violations": (_references, REFERENCES_SQL),
    # 02:00 in New York is 23:00 the evening before in Los Angeles, 12:30 UTC is 04:30 there
    "filter_offset_bounds": (_offset_bounds, f"WITH {LV} SELECT id FROM lv WHERE start_datetime BETWEEN TIMESTAMP '2024-01-15 23:00:00' AND TIMESTAMP '2024-01-18 04:30:00'"),
}


def _index_search(spark, sf, run):
    rows = full_listings(spark, sf)
    return run(rows, search_index.build_index(rows, parts=8))


def _snapshot(spark, sf):
    a, b = listing_snapshots(spark, sf)
    return snapshots.diff(snapshots.store(a, parts=8, buckets=8), snapshots.store(b, parts=8, buckets=8)).withColumn("fields", F.array_join("fields", ","))


QUERIES |= {
    "weighted_search_index": (lambda s, d: _index_search(s, d, lambda rows, at: search_index.weighted_search(rows, at, "click oak mon")).select("id", "match_score"), SERVING["weighted_search"][1]),
    "search_index": (lambda s, d: _index_search(s, d, lambda rows, at: search_index.search(rows, at, "Night 4", 120)).select("id", "title_hit"), SERVING["search"][1]),
    "snapshot_diff_bucketed": (_snapshot, f"WITH {SNAP} SELECT * FROM d WHERE change <> 'unchanged'"),
}
