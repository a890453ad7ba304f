"""Listing views over the given tables, in Spark and, word for word, in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import LISTING, conform
from ..sources.registry import registry_frame

AS_OF = "2024-01-15 00:00:00"

# a projection both engines read alike; ``events`` is the given table
LISTING_SELECT = """
SELECT event_id AS arrival_ix, CAST(event_id AS {str}) AS id, event_type AS source_name, ts AS raw_start, ts AS scraped_at,
  CASE k WHEN 7 THEN 'Read more' WHEN 8 THEN '12/25 - 3' WHEN 9 THEN 'Dec25' WHEN 10 THEN 'ab' WHEN 12 THEN 'Show'
    ELSE concat(event_type, ' night ', k) END AS title,
  CASE WHEN k = 11 THEN 'short' ELSE concat(event_type, ' ', k, ' with guest ', user_id,
    CASE k % 10 WHEN 0 THEN ', craft beer tasting' WHEN 1 THEN ', story time for kids' WHEN 2 THEN ', lecture on ships!!'
      WHEN 3 THEN ', all ages welcome' WHEN 4 THEN ', cocktail hour' WHEN 5 THEN ', family fun &amp; games' ELSE '' END, '.') END AS description,
  CASE WHEN k % 9 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END AS start_datetime,
  CASE WHEN k % 9 = 0 AND event_id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL '2' DAY
    WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) + INTERVAL '2' HOUR END AS end_datetime,
  k % 9 = 0 AS all_day,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 20 = 5 THEN 'Portico Brewing' WHEN user_id % 20 = 6 THEN 'West Branch Library'
    WHEN user_id % 20 = 7 THEN 'The Sinclair Bar' ELSE concat('Hall ', user_id % 20) END AS venue_name,
  CASE user_id % 5 WHEN 0 THEN '12 Main St, Oakland, CA 94607' WHEN 1 THEN '9 San Jose Ave' WHEN 2 THEN '500 Elm, Berkeley' WHEN 3 THEN '' END AS street_address,
  CASE user_id % 6 WHEN 0 THEN 'San Francisco' WHEN 1 THEN 'Oakland' WHEN 2 THEN 'San Jose' WHEN 3 THEN 'Berkeley' WHEN 4 THEN 'Daly City' END AS city,
  'CA' AS state,
  CASE WHEN event_id % 5 <> 0 THEN 37.5 + (user_id % 10) / 8.0E0 END AS latitude,
  CASE WHEN event_id % 5 <> 0 THEN -122.5 + (user_id % 10) / 8.0E0 END AS longitude,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CASE k % 8 WHEN 0 THEN 'music' WHEN 1 THEN 'arts and culture' WHEN 2 THEN 'food and drink'
    WHEN 3 THEN 'theater' WHEN 4 THEN 'lectures' WHEN 5 THEN 'sports' WHEN 6 THEN 'community' ELSE 'other' END END AS category,
  k % 5 = 0 AS family_friendly,
  CASE WHEN value < 5 THEN 'Free' WHEN value < 10 THEN '$0' WHEN value < 15 THEN ' free ' WHEN value < 60 THEN concat('$', k) END AS cost,
  concat('https://', event_type, '.example.org/e/', event_id % 1000) AS source_url,
  CASE WHEN event_id % 4 <> 0 THEN concat('https://img.example.org/', user_id % 30, '.jpg') END AS image_url,
  event_id % 997 = 0 AS featured, ts AS last_updated, k, user_id, value
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

LV = "lv AS (" + LISTING_SELECT.format(str="VARCHAR") + ")"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    # the row mark keeps the optimiser from writing the pattern out at every use of k
    events = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    events = events.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0").drop("_row")
    sql = LISTING_SELECT.format(str="STRING").replace("(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)", "{events}")
    return spark.sql(sql, events=events)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """The listing view with helper columns (``raw_start, k, user_id, value``)."""
    view = _events(spark, sf)
    for name in ("start_datetime", "end_datetime"):
        view = view.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return view.withColumn("tags", F.array().cast("array<string>"))


def full_listings(spark: SparkSession, sf: str) -> DataFrame:
    return conform(listings(spark, sf), LISTING)


REGISTRY_RECORDS = (
    {"name": "click", "adapter": "tribe"}, {"name": "error", "adapter": "ical", "runs_in_ci": False},
    {"name": "purchase", "kind": "aggregator", "adapter": "jsonld"}, {"name": "signup", "adapter": "localist", "status": "blocked"},
    {"name": "quiet", "adapter": "tribe"}, {"name": "gone", "adapter": "tribe", "status": "retired"})
# the same registry in SQL: name, rank, manual, scraped, in ci, status
REG = ("reg(name, rnk, manual, scraped, ci, status) AS (VALUES ('click',0,false,true,true,'active'),('error',0,false,true,false,'active'),"
       "('purchase',2,false,true,true,'active'),('signup',0,false,false,true,'blocked'),('quiet',0,false,true,true,'active'),"
       "('gone',0,false,false,true,'retired'),('User Submitted',3,true,false,true,'active'))")


def registry(spark: SparkSession) -> DataFrame:
    return registry_frame(spark, REGISTRY_RECORDS)


# documents as listings: the first line is the title, the whole text the description
DOC_SELECT = """
SELECT doc_id AS arrival_ix, source AS source_name, substring(split_part(text, chr(10), 1), 1, 200) AS title, text AS description,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 720 AS INT) AS start_datetime,
  concat('https://docs.example.org/', doc_id) AS source_url, lang AS category, doc_id % 3 AS d3
FROM documents
"""
DV = "dv AS (" + DOC_SELECT + ")"


def doc_listings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    hour = F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
    return docs.select(
        F.col("doc_id").alias("arrival_ix"), F.col("source").alias("source_name"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 200).alias("title"), F.col("text").alias("description"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hour).alias("start_datetime"),
        F.concat(F.lit("https://docs.example.org/"), "doc_id").alias("source_url"), F.col("lang").alias("category"),
        (F.col("doc_id") % 3).alias("d3"))
