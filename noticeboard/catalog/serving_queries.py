"""Read side: filters, ranking, search, roll-ups, digests, picks, facets."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import serve as s
from ..settings import DEFAULT
from .views import AS_OF, LV, full_listings, listings, table

L = full_listings
T = f"TIMESTAMP '{AS_OF}'"
UP = f"(start_datetime >= {T} OR (all_day AND CAST(coalesce(end_datetime, start_datetime) AS DATE) >= DATE '2024-01-15'))"
STILL = "(all_day AND CAST(coalesce(end_datetime, start_datetime) AS DATE) >= DATE '2024-01-15')"
FREE = "coalesce(lower(trim(cost)) IN ('free', '$free', '0', '$0', 'free admission'), false)"
STRICT = r"regexp_matches(coalesce(cost, ''), '^\s*(free|\$?0(\.00)?)\s*$', 'i')"
CONTENT = ("(coalesce(CASE category WHEN 'music' THEN 1.2::DOUBLE WHEN 'theater' THEN 1.1 WHEN 'arts and culture' THEN 1.1 WHEN 'food and drink' THEN 1.0 WHEN 'sports' THEN 1.0 "
           f"WHEN 'lectures' THEN 0.9 WHEN 'community' THEN 0.9 WHEN 'other' THEN 0.8 END, 1.0::DOUBLE) * CASE WHEN {FREE} THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN featured THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)")
DAYS = f"(epoch_us(start_datetime) - epoch_us({T})) / 1000000.0::DOUBLE / 3600.0::DOUBLE / 24.0::DOUBLE"
BOOST = (f"CASE WHEN {STILL} AND start_datetime < {T} THEN 1.0::DOUBLE WHEN {DAYS} <= 0 THEN 0.1::DOUBLE WHEN {DAYS} > 30 THEN 1.0::DOUBLE "
         f"WHEN {DAYS} <= 7 THEN least(2.0::DOUBLE + 3.0::DOUBLE / ({DAYS} + 1), 5.0::DOUBLE) ELSE greatest(1.0::DOUBLE, 2.4::DOUBLE - 1.4::DOUBLE * ({DAYS} - 7) / 23.0::DOUBLE) END")
WIN = {"today": ("2024-01-15", "2024-01-16"), "tomorrow": ("2024-01-16", "2024-01-17"), "week": ("2024-01-15", "2024-01-22"), "weekend": ("2024-01-19", "2024-01-22")}
CARD = ["id", "title", "start_datetime", "source_name"]
IDS = ["id", "source_name"]


def _ids(fn, cols=IDS):
    return lambda sp, sf: fn(sp, sf).select(*cols)


def win_sql(w):
    return f"start_datetime >= DATE '{WIN[w][0]}' AND start_datetime < DATE '{WIN[w][1]}'"


def sql(where, cols="id, source_name", tail=""):
    return f"WITH {LV} SELECT {cols} FROM lv WHERE {where} {tail}"


def picks(spark, sf):
    """Picks derived from the listings: some live, some gone, one with an empty source."""
    df = L(spark, sf)
    return (df.filter("arrival_ix % 1499 = 3").select("title", "source_name")
            .union(df.filter("start_datetime < '2024-01-02' AND arrival_ix % 5 = 0").select(F.concat("title", F.lit("?")), "source_name"))).distinct()


PICKS = "picks AS (SELECT DISTINCT title, source_name FROM (SELECT title, source_name FROM lv WHERE arrival_ix % 1499 = 3 UNION ALL SELECT title || '?', source_name FROM lv WHERE start_datetime < TIMESTAMP '2024-01-02' AND arrival_ix % 5 = 0))"

FACETS = s.facet_rows(DEFAULT)


def facet_sql():
    parts = []
    for slug, _, window, free, family, category, city in FACETS:
        t = ["true"]
        if category:
            t.append(f"lower(coalesce(category, '')) = '{category}'")
        if city:
            t.append(f"lower(coalesce(city, '')) = '{city.lower()}'")
        if free:
            t.append(STRICT)
        if family:
            t.append("family_friendly")
        if window:
            t.append(win_sql(window))
        parts.append(f"SELECT *, '{slug}' AS facet FROM lv WHERE {' AND '.join(t)}")
    return "fx AS (" + " UNION ALL ".join(parts) + ")"


DAYKEY = f"CASE WHEN CAST(start_datetime AS DATE) >= DATE '2024-01-15' THEN CAST(start_datetime AS DATE) WHEN {STILL} THEN DATE '2024-01-15' END"
DIGEST = f"""{LV}, filed AS (SELECT *, {DAYKEY} AS day, CASE WHEN all_day OR hour(start_datetime) < 12 THEN 0 WHEN hour(start_datetime) < 17 THEN 1 ELSE 2 END AS part, {CONTENT} AS content FROM lv),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, part ORDER BY content DESC, start_datetime, id) AS position FROM filed WHERE day IS NOT NULL) WHERE position <= 7),
 dn AS (SELECT day, count(*) n FROM best GROUP BY day ORDER BY day LIMIT 30),
 db AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM dn),
 lines AS (SELECT best.*, b + row_number() OVER (PARTITION BY day ORDER BY part, position) AS line_no FROM best JOIN db USING (day) WHERE b < 500)"""
WHEN = """CASE WHEN all_day THEN strftime(start_datetime, '%a %b %-d') || CASE WHEN CAST(end_datetime AS DATE) > CAST(start_datetime AS DATE) THEN ' to ' || strftime(end_datetime, '%a %b %-d') ELSE '' END || ' (all day)'
 ELSE strftime(start_datetime, '%a %b %-d, %-I') || CASE WHEN minute(start_datetime) <> 0 THEN strftime(start_datetime, ':%M') ELSE '' END || strftime(start_datetime, ' %p') END"""
LINE = f"""'- ' || substring(title, 1, 80) || ' | ' || {WHEN} || ' | ' || CASE WHEN coalesce(nullif(substring(venue_name, 1, 40), ''), city) IS NULL THEN 'venue not listed' ELSE concat_ws(', ', substring(venue_name, 1, 40), city) END
 || ' | ' || coalesce(category, '') || CASE WHEN family_friendly THEN ' [F]' ELSE '' END || ' | ' || source_url"""

WDAY = "strftime(start_datetime, '%A')"
FIELDS = [("title", 4), ("venue_name", 3), ("category", 2), ("city", 2), (WDAY, 1), ("source_name", 1), ("cost", 1)]


def term_sql(term):
    return "CASE " + " ".join(f"WHEN contains(lower(coalesce({f}, '')), '{term}') THEN {w}" for f, w in FIELDS) + " ELSE 0 END"


SLIM = ("id, title, start_datetime, end_datetime, all_day, venue_name, city, latitude, longitude, category, family_friendly, image_url, source_url, source_name, cost, featured")

QUERIES = {
    "upcoming": (_ids(lambda p, f: L(p, f).filter(s.upcoming(AS_OF))), sql(UP)),
    "filter_category_city_dates": (_ids(lambda p, f: s.filter_listings(L(p, f), AS_OF, upcoming_only=True, category="music", city="OAKLAND", start="2024-01-16 00:00:00", end="2024-01-28 12:00:00")),
                                   sql(f"{UP} AND category = 'music' AND lower(city) = 'oakland' AND start_datetime BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-28 12:00:00'")),
    "filter_source_family": (_ids(lambda p, f: s.filter_listings(L(p, f), AS_OF, source="Click", family=True)), sql("lower(source_name) = 'click' AND family_friendly")),
    "free_api": (_ids(lambda p, f: L(p, f).filter(rules.free_api(F.col("cost")))), sql(FREE)),
    "free_strict": (_ids(lambda p, f: L(p, f).filter(rules.free_strict(F.col("cost")))), sql(STRICT)),
    "fee_filter_free": (_ids(lambda p, f: s.filter_board(L(p, f), AS_OF, fee="free")), sql("coalesce(cost, '') IN ('', 'Free')")),
    "fee_filter_paid": (_ids(lambda p, f: s.filter_board(L(p, f), AS_OF, fee="paid")), sql("coalesce(cost, '') NOT IN ('', 'Free')")),
    "multi_select": (_ids(lambda p, f: s.filter_board(L(p, f), AS_OF, categories=("music", "sports"), sources=("click", "view"), all_sources=5, date="2024-01-20")),
                     sql("category IN ('music', 'sports') AND source_name IN ('click', 'view') AND CAST(start_datetime AS DATE) = DATE '2024-01-20'")),
    "map_scope_today": (_ids(lambda p, f: s.filter_board(L(p, f), AS_OF, for_map=True)), sql("CAST(start_datetime AS DATE) = DATE '2024-01-15'")),
    **{f"window_{w}": (_ids(lambda p, f, w=w: L(p, f).filter(s.in_window(w, AS_OF))), sql(win_sql(w))) for w in WIN},
    "window_weekend_begun": (_ids(lambda p, f: L(p, f).filter(s.in_window("weekend", "2024-01-21 10:00:00"))), sql("start_datetime >= DATE '2024-01-21' AND start_datetime < DATE '2024-01-22'")),
    "recently_past": (_ids(lambda p, f: L(p, f).filter(s.recently_past(AS_OF, 9))), sql(f"start_datetime < {T} AND start_datetime >= {T} - INTERVAL 9 DAY")),
    "facet_match": (_ids(lambda p, f: s.match_facets(L(p, f).filter(F.col("start_datetime") >= AS_OF), FACETS, AS_OF), ["facet", "id"]), f"WITH {LV}, {facet_sql()} SELECT facet, id FROM fx WHERE start_datetime >= {T}"),
    "venue_filter": (_ids(lambda p, f: s.at_venue(L(p, f), "sinclair-bar")), sql("venue_name = 'The Sinclair Bar'")),
    "ranked_page": (lambda p, f: s.page(s.ranked(s.filter_listings(L(p, f), AS_OF, upcoming_only=True), AS_OF), 200, 40).select("id", F.round("score", 6).alias("score")),
                    f"WITH {LV} SELECT id, round({CONTENT} * {BOOST}, 6) AS score FROM lv WHERE {UP} ORDER BY {CONTENT} * {BOOST} DESC, arrival_ix LIMIT 200 OFFSET 40"),
    "relevance_all": (lambda p, f: L(p, f).select("id", F.round(s.scores.relevance(AS_OF), 6).alias("score")), f"WITH {LV} SELECT id, round({CONTENT} * {BOOST}, 6) AS score FROM lv"),
    "slim_ranked": (lambda p, f: s.slim(s.page(s.ranked(s.filter_listings(L(p, f), AS_OF, upcoming_only=True, free_only=True), AS_OF), 300)),
                    f"WITH {LV} SELECT {SLIM}, round({CONTENT} * {BOOST}, 3) AS score FROM lv WHERE {UP} AND {FREE} ORDER BY {CONTENT} * {BOOST} DESC, arrival_ix LIMIT 300"),
    "date_order_page": (_ids(lambda p, f: s.page(s.by_date(L(p, f), descending=True), 150, 30), CARD), sql("true", ", ".join(CARD), "ORDER BY start_datetime DESC, arrival_ix LIMIT 150 OFFSET 30")),
    "page_count": (lambda p, f: s.page_count(L(p, f), 50), f"WITH {LV} SELECT CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM lv"),
    "point_lookup": (_ids(lambda p, f: s.by_id(L(p, f), "77"), CARD), sql("id = '77'", ", ".join(CARD))),
    "search": (lambda p, f: s.search(L(p, f), "Night 4", 120).select("id", "title_hit"),
               f"WITH {LV} SELECT id, contains(lower(title), 'night 4') AS title_hit FROM lv WHERE contains(lower(title), 'night 4') OR contains(lower(description), 'night 4') ORDER BY 2 DESC, start_datetime, arrival_ix LIMIT 120"),
    "search_documents": (lambda p, f: table(p, f, "documents").filter(F.lower("text").contains("license")).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')"),
    "weighted_search": (lambda p, f: s.weighted_search(L(p, f), "click oak mon").select("id", "match_score"),
                        f"WITH {LV} SELECT id, ({term_sql('click')} + {term_sql('oak')} + {term_sql('mon')})::INT AS match_score FROM lv WHERE {term_sql('click')} > 0 AND {term_sql('oak')} > 0 AND {term_sql('mon')} > 0"),
    "source_counts": (lambda p, f: s.source_counts(L(p, f)), f"WITH {LV} SELECT source_name, count(*) AS events FROM lv GROUP BY ALL"),
    "stats": (lambda p, f: s.stats(L(p, f)),
              f"""WITH {LV} SELECT 'category' AS facet, category AS value, count(*) AS events, min(start_datetime) AS earliest, max(start_datetime) AS latest FROM lv WHERE category IS NOT NULL GROUP BY category
              UNION ALL SELECT 'source', source_name, count(*), min(start_datetime), max(start_datetime) FROM lv GROUP BY source_name
              UNION ALL SELECT 'city', city, count(*), min(start_datetime), max(start_datetime) FROM lv WHERE city IS NOT NULL GROUP BY city
              UNION ALL SELECT 'all', NULL, count(*), min(start_datetime), max(start_datetime) FROM lv"""),
    "categories": (lambda p, f: L(p, f).filter("category IS NOT NULL").select("category").distinct(), f"WITH {LV} SELECT DISTINCT category FROM lv WHERE category IS NOT NULL"),
    "health": (lambda p, f: s.health(L(p, f)), f"WITH {LV} SELECT count(*) AS total_events, max(last_updated) AS last_updated FROM lv"),
    "digest_lines": (lambda p, f: s.digest(L(p, f), AS_OF).select("line_no", "day", "part", "position", "id", s.digest_line().alias("line")),
                     f"WITH {DIGEST} SELECT line_no::BIGINT AS line_no, day, part, position, id, {LINE} AS line FROM lines WHERE line_no <= 500"),
    "digest_top7": (lambda p, f: s.top_per(L(p, f).withColumn("day", F.to_date("start_datetime")).withColumn("content", s.scores.content_score(F.col("category"), F.col("cost"), F.col("featured"))), ["day"], [F.col("content").desc(), "start_datetime", "id"], 7).select("day", "position", "id"),
                    f"WITH {LV} SELECT CAST(start_datetime AS DATE) AS day, row_number() OVER (PARTITION BY CAST(start_datetime AS DATE) ORDER BY {CONTENT} DESC, start_datetime, id) AS position, id FROM lv QUALIFY position <= 7"),
    "conversation_trim": (lambda p, f: s.trim_conversations(table(p, f, "conversations")),
                          r"""WITH u AS (SELECT conv_id, turn, role, regexp_replace(text, '^ +| +$', '', 'g') AS content FROM conversations WHERE role IN ('user', 'assistant')),
                          l AS (SELECT * FROM u WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)
                          SELECT conv_id, turn, role, substring(content, 1, 4000) AS content FROM l QUALIFY max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1"""),
    "featured_strip": (_ids(lambda p, f: s.featured_strip(L(p, f))), sql("featured", tail="ORDER BY arrival_ix LIMIT 4")),
    "featured_strip_fallback": (_ids(lambda p, f: s.featured_strip(L(p, f).withColumn("featured", F.lit(False)))), sql("image_url IS NOT NULL", tail="ORDER BY arrival_ix LIMIT 4")),
    "picks_flag": (lambda p, f: s.flag_picks(L(p, f), picks(p, f)).filter("featured").select("id"), f"WITH {LV}, {PICKS} SELECT id FROM lv WHERE featured OR (title, source_name) IN (SELECT (title, source_name) FROM picks)"),
    "picks_prune": (lambda p, f: s.prune_picks(picks(p, f), L(p, f), AS_OF), f"WITH {LV}, {PICKS} SELECT title, source_name FROM picks WHERE (title, source_name) IN (SELECT (title, source_name) FROM lv WHERE {UP})"),
    "picks_prune_by_day": (lambda p, f: s.prune_picks(picks(p, f), L(p, f), "2024-01-28 23:00:00", by_day=True), f"WITH {LV}, {PICKS} SELECT title, source_name FROM picks WHERE (title, source_name) IN (SELECT (title, source_name) FROM lv WHERE start_datetime >= DATE '2024-01-28')"),
    "picks_add": (lambda p, f: s.add_pick(picks(p, f), L(p, f), "901", AS_OF), f"WITH {LV}, {PICKS} SELECT title, source_name FROM picks WHERE (title, source_name) IN (SELECT (title, source_name) FROM lv WHERE {UP}) UNION SELECT title, source_name FROM lv WHERE id = '901'"),
    "picks_remove": (lambda p, f: s.remove_pick(picks(p, f), L(p, f), "3", AS_OF), f"WITH {LV}, {PICKS} SELECT title, source_name FROM picks WHERE (title, source_name) IN (SELECT (title, source_name) FROM lv WHERE {UP}) AND (title, source_name) NOT IN (SELECT (title, source_name) FROM lv WHERE id = '3')"),
    "display_cards": (lambda p, f: s.display(L(p, f)).select("id", "title", "day", "date", "date_label", "time", "location", "address", "fee", "type", F.array_join("coordinates", ",").isNotNull().alias("placed")),
                      f"""WITH {LV} SELECT id, title, {WDAY} AS day, strftime(start_datetime, '%Y-%m-%d') AS date, strftime(start_datetime, '%b %-d') AS date_label, CASE WHEN all_day THEN '' ELSE strftime(start_datetime, '%-I:%M %p') END AS time,
                      coalesce(venue_name, 'Location TBD') AS location, coalesce(city, 'Location TBD') AS address, coalesce(cost, '') AS fee, coalesce(category, 'other') AS type, latitude IS NOT NULL AS placed FROM lv"""),
}
