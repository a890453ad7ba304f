"""Exports and page tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, text as x
from ..operators import pages as pg, serve
from .serving_queries import FACETS, L, T, facet_sql
from .views import AS_OF, LV, table

SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(venue_name, '^\\s*the\\s+', '', 'i')), '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
ICS = r"""'BEGIN:VCALENDAR' || e || 'VERSION:2.0' || e || 'PRODID:-//Town Listings//Events//EN' || e || 'CALSCALE:GREGORIAN' || e || 'METHOD:PUBLISH' || e || 'BEGIN:VEVENT' || e || 'UID:' || id || '@listings.example.org' || e || 'DTSTAMP:20240115T000000Z' || e ||
 CASE WHEN all_day THEN 'DTSTART;VALUE=DATE:' || strftime(start_datetime, '%Y%m%d') || e || 'DTEND;VALUE=DATE:' || strftime(CAST(coalesce(end_datetime, start_datetime) AS DATE) + 1, '%Y%m%d')
  ELSE 'DTSTART:' || strftime(start_datetime, '%Y%m%dT%H%M%S') || e || 'DTEND:' || strftime(coalesce(end_datetime, start_datetime + INTERVAL 2 HOUR), '%Y%m%dT%H%M%S') END || e ||
 'SUMMARY:' || title || e || 'DESCRIPTION:' || replace(replace(description, ';', '\;'), ',', '\,') || '\n\nMore info: ' || source_url || e || 'LOCATION:' || replace(loc, ',', '\,') || e ||
 'URL:' || source_url || e || 'END:VEVENT' || e || 'END:VCALENDAR' || e"""
UPV = f"up AS (SELECT *, {SLUG} AS slug FROM lv WHERE start_datetime >= {T} AND venue_name IS NOT NULL)"
VENUE = f"""{LV}, {UPV}, sp AS (SELECT slug, venue_name, count(*) n, min((start_datetime, arrival_ix)) seen FROM up GROUP BY ALL),
 vp AS (SELECT slug, count(*) AS events, coalesce(first(city ORDER BY start_datetime, arrival_ix), 'San Francisco') || ', CA' AS city FROM up GROUP BY slug HAVING count(*) >= 4),
 vn AS (SELECT slug, venue_name AS name FROM sp QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, seen) = 1)"""


def _sitemap(spark, sf):
    rows = L(spark, sf)
    return pg.sitemap(pg.event_pages(rows, AS_OF), pg.facet_pages(rows, FACETS, AS_OF), pg.venue_pages(rows, AS_OF))


SITEMAP = f"""{VENUE}, {facet_sql()}, sm AS (SELECT 'https://listings.example.org/' AS loc, NULL::VARCHAR AS lastmod, 'daily' AS changefreq, '1.0' AS priority
 UNION ALL SELECT 'https://listings.example.org/event/' || id, strftime(last_updated, '%Y-%m-%d'), 'weekly', '0.6' FROM lv WHERE start_datetime >= {T}
 UNION ALL SELECT DISTINCT 'https://listings.example.org/' || facet, NULL, 'daily', '0.8' FROM fx WHERE start_datetime >= {T}
 UNION ALL SELECT 'https://listings.example.org/venue/' || slug, NULL, 'daily', '0.7' FROM vp)"""

QUERIES = {
    "venue_pages": (lambda s, d: pg.venue_pages(L(s, d), AS_OF), f"WITH {VENUE} SELECT slug, name, events, city FROM vp JOIN vn USING (slug)"),
    "past_panels": (lambda s, d: pg.past_panels(L(s, d), AS_OF).select("id", "slug", "position", "next_id"),
                    f"""WITH {LV}, {UPV}, b AS (SELECT slug, id, row_number() OVER (PARTITION BY slug ORDER BY start_datetime, arrival_ix) AS position FROM up QUALIFY position <= 10),
                    p AS (SELECT id, {SLUG} AS slug FROM lv WHERE start_datetime < {T} AND venue_name IS NOT NULL) SELECT p.id, slug, position, b.id AS next_id FROM p JOIN b USING (slug)"""),
    "sitemap_rows": (_sitemap, f"WITH {SITEMAP} SELECT * FROM sm"),
    "sitemap_duplicates": (lambda s, d: pg.duplicate_locs(_sitemap(s, d).unionByName(_sitemap(s, d).filter("priority = '0.7'"))), f"WITH {SITEMAP} SELECT loc, 2::BIGINT AS pages FROM sm WHERE priority = '0.7'"),
    "sitemap_xml": (lambda s, d: pg.sitemap_xml(_sitemap(s, d)), f"WITH {SITEMAP} SELECT '<url><loc>' || loc || '</loc>' || CASE WHEN lastmod IS NULL THEN '' ELSE '<lastmod>' || lastmod || '</lastmod>' END || '<changefreq>' || changefreq || '</changefreq><priority>' || priority || '</priority></url>' AS value FROM sm"),
    "facet_pages": (lambda s, d: pg.facet_pages(L(s, d), FACETS, AS_OF), f"WITH {LV}, {facet_sql()} SELECT facet, count(*) AS events, arg_min(image_url, (start_datetime, arrival_ix)) FILTER (image_url IS NOT NULL) AS image_url FROM fx WHERE start_datetime >= {T} GROUP BY facet"),
    "page_items": (lambda s, d: pg.page_items(L(s, d), FACETS, AS_OF).select("facet", "position", "id"), f"WITH {LV}, {facet_sql()} SELECT facet, row_number() OVER (PARTITION BY facet ORDER BY start_datetime, arrival_ix) AS position, id FROM fx WHERE start_datetime >= {T} QUALIFY position <= 60"),
    "home_page": (lambda s, d: pg.home_page(L(s, d), AS_OF).select("id"), f"WITH {LV} SELECT id FROM lv WHERE start_datetime >= {T} AND start_datetime < DATE '2024-01-22'"),
    "event_pages": (lambda s, d: pg.event_pages(L(s, d), AS_OF), None),
    "ics_export": (lambda s, d: pg.ics_files(L(s, d).withColumn("latitude", F.lit(None).cast("double")), AS_OF).select("id", "filename", F.md5("ics").alias("ics")),
                   f"WITH {LV}, z AS (SELECT *, chr(13) || chr(10) AS e, concat_ws(', ', venue_name, nullif(street_address, ''), city, state) AS loc FROM lv) SELECT id, coalesce(nullif(replace(trim(substring(regexp_replace(title, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), 1, 50)), ' ', '_'), ''), 'event') || '.ics' AS filename, md5({ICS}) AS ics FROM z"),
    "ics_export_placed": (lambda s, d: pg.ics_files(L(s, d).filter("latitude IS NOT NULL"), AS_OF), None),
    "geojson": (lambda s, d: pg.geojson(L(s, d), {"music": "#aa0000"}, "#888888"), None),
    "schema_org": (lambda s, d: pg.schema_org(L(s, d)), None),
    "street_only": (lambda s, d: L(s, d).select("id", addresses.street_only(F.col("street_address"), F.col("city"), "CA").alias("street"), addresses.location_line(F.col("venue_name"), F.col("street_address"), F.col("city"), F.col("state"), "CA").alias("line")),
                    f"""WITH {LV}, z AS (SELECT id, venue_name, city, CASE user_id % 5 WHEN 0 THEN '12 Main St' || CASE WHEN city = 'Oakland' THEN '' ELSE ', Oakland' END WHEN 1 THEN '9 San Jose Ave' WHEN 2 THEN '500 Elm' || CASE WHEN city = 'Berkeley' THEN '' ELSE ', Berkeley' END ELSE '' END AS street FROM lv)
                    SELECT id, street, concat_ws(', ', venue_name, nullif(street, ''), city, 'CA') AS line FROM z"""),
    "venue_slugs": (lambda s, d: L(s, d).filter("venue_name IS NOT NULL").select("venue_name").distinct().select("venue_name", x.slugify(F.col("venue_name")).alias("slug")), f"WITH {LV} SELECT DISTINCT venue_name, {SLUG} AS slug FROM lv WHERE venue_name IS NOT NULL"),
    "truncated_text": (lambda s, d: table(s, d, "documents").select("doc_id", F.length(x.truncate_words(F.col("text"), 300)).alias("n")).filter("n > 300"), "SELECT doc_id, 0 AS n FROM documents WHERE false"),
    "digest_text": (lambda s, d: serve.digest(L(s, d), AS_OF).groupBy("day").agg(F.count(F.lit(1)).alias("lines")), None),
}
