"""Which platform a page runs on: shares of its signatures, and what the page itself proves."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ...functions.markup import card_fields
from ...functions.text import absolute_url
from ...settings import DEFAULT, Settings
from .checks import challenged
from .html_pages import time_element
from .jsonld import event_nodes, islands

# --- fixed values ----------------------------------------------------------
SIGNATURES = {
    "tribe": ("/wp-content/plugins/the-events-calendar/", "tribe/events/v1", "tribe-events-calendar", "tribe-events-view"),
    "squarespace": ("<!-- This is Squarespace. -->", "static1.squarespace.com", "Static.SQUARESPACE_CONTEXT", "eventlist-event"),
    "localist": ("Powered by Localist", "localist.com", "localist-widget", "/api/2/events"),
    "ical": ("BEGIN:VCALENDAR", 'type="text/calendar"', "webcal://", "calendar.google.com/calendar/embed"),
    "jsonld": (),
    "eventon": ("evo_general_params", "ajde_evcal_calendar", "evo_cal_data", "eventon"),
    "assabet": ("assabetinteractive.com", "Assabet Interactive", "listing-event", "event-listing"),
    "drupal_listing": ("drupal-settings-json", "views-row", "<time datetime=", "pager__item"),
    "indiecommerce": ("indiecommerce", "fullCalendarView", "calander_view", "event-teaser__details", "/events/calendar")}
SIGNATURE_PATTERNS = {
    "ical": (r"""(?i)href=["'][^"']*\.ics\b""",),
    "jsonld": (r'"@type"\s*:\s*\[?\s*"(?:https?://schema\.org/)?[A-Za-z]*(?:Event|Festival)"',)}
GENERIC = ("jsonld", "ical", "drupal_listing")
MIN_SCORE = 0.2
# ---------------------------------------------------------------------------


def shares(html: Column) -> dict[str, Column]:
    """Share of each platform's signatures present in a page, one expression per platform."""
    low, out = F.lower(html), {}
    for name, words in SIGNATURES.items():
        tests = [low.contains(w.lower()) for w in words] + [html.rlike(p) for p in SIGNATURE_PATTERNS.get(name, ())]
        total = F.lit(0)
        for t in tests:
            total = total + t.cast("int")
        out[name] = total / F.lit(float(len(tests)))
    return out


def _score(name: str, share: Column, status: Column) -> Column:
    sure = 0.55 if name in GENERIC else 0.8
    value = (F.when(status == "confirmed", sure + 0.2 * share).when(status == "refuted", 0.2 * share)
             .when(status == "hint", 0.3 + 0.3 * share).otherwise(0.5 * share))
    return F.round(F.least(F.lit(1.0), value), 2)


def evidence(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What the page alone proves: linked feeds, JSON-LD events, calendar settings, agreeing dated rows."""
    html, low = F.col("html"), F.lower("html")
    got = pages.withColumn("c", card_fields(html, None, {"a": "a[href], link[href]", "frame": "iframe[src]", "gen": "meta[name=generator]", "cards": "div.listing-event"})[0])
    got = got.withColumn("events", F.size(event_nodes(islands(html))))
    got = got.withColumn("rows", card_fields(html, ".views-row", {"time": "time[datetime]"}))
    href = lambda e: F.trim(F.try_element_at(e["attrs"], F.lit("href")))
    feedish = lambda h: F.lower(h).rlike(r"^webcal:|\.ics(\?|$)|ical=1") & ~F.lower(h).contains("calendar.google.com/calendar/render")
    calendar = lambda e: F.lower(F.coalesce(F.try_element_at(e["attrs"], F.lit("type")), F.lit(""))) == "text/calendar"
    links = F.transform(F.filter(F.col("c")["a"], lambda e: feedish(href(e)) | calendar(e)),
                        lambda e: absolute_url(F.col("url"), F.regexp_replace(href(e), "(?i)^webcal:", "https:")))
    src = lambda e: F.try_element_at(e["attrs"], F.lit("src"))
    embeds = F.flatten(F.transform(F.filter(F.col("c")["frame"], lambda e: F.lower(src(e)).contains("google.com/calendar/embed")), lambda e: F.transform(
        F.regexp_extract_all(src(e), F.lit(r"[?&]src=([^&]+)"), 1),
        lambda s: F.concat(F.lit("https://calendar.google.com/calendar/ical/"), F.url_encode(F.url_decode(s)), F.lit("/public/basic.ics")))))
    feeds = F.array_distinct(F.concat(links, embeds))
    dated = F.filter("rows", lambda r: F.size(r["time"]) > 0)
    agreeing = F.filter(dated, lambda r: time_element(F.try_element_at(r["time"][0]["attrs"], F.lit("datetime")), r["time"][0]["text"], settings.zone).isNotNull())
    gen = F.coalesce(F.try_element_at(F.try_element_at(F.col("c")["gen"], F.lit(1))["attrs"], F.lit("content")), F.lit(""))
    drupal = (low.contains("drupal-settings-json") | low.contains('content="drupal')) & low.contains("<time")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]+)", 1))
    status = {
        "tribe": F.when(low.rlike(r"tribe-events|tribe_events|the-events-calendar|tribe\\?/events\\?/v1"), "hint"),
        "squarespace": F.when(low.contains("squarespace"), "hint"), "localist": F.when(low.contains("localist"), "hint"),
        "ical": F.when(F.size(feeds) > 0, "confirmed"), "jsonld": F.when(F.col("events") > 0, "confirmed"),
        "eventon": F.when(html.contains("evo_general_params") & html.rlike(r"(?s)evo_cal_data[^>]*data-sc="), "confirmed").when(low.contains("eventon"), "hint"),
        "assabet": F.when(host.endswith("assabetinteractive.com") | F.lower(gen).contains("assabet"), "confirmed").when(low.rlike(r"https?://[a-z0-9-]+\.assabetinteractive\.com"), "hint"),
        "drupal_listing": F.when(drupal & (F.size(dated) > 0), F.when(F.size(agreeing) > 0, "confirmed").otherwise("hint")),
        "indiecommerce": F.when(low.contains("fullcalendarview") & low.contains("indiecommerce"), "confirmed").when(low.contains("indiecommerce"), "hint")}
    facts = F.array(*[F.struct(F.lit(n).alias("platform"), F.coalesce(s, F.lit("none")).alias("status")) for n, s in status.items()])
    return got.select("page_id", "url", "html", feeds.alias("feeds"), "events", facts.alias("facts"))


def detect(pages: DataFrame, settings: Settings = DEFAULT, use_evidence: bool = True) -> DataFrame:
    """``page_id, platform, score, position`` per page, best first; a refused page is one row ``blocked``.

    The platforms are a short fixed list, so each page scores them all in one
    projection: no join. Generic readers rank below a platform with the same score.
    """
    status = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")
    judged = pages.withColumn("_blocked", challenged(status, F.col("html")))
    base = evidence(judged.filter("NOT _blocked"), settings) if use_evidence else judged.filter("NOT _blocked").withColumn("facts", F.array(*[
        F.struct(F.lit(n).alias("platform"), F.lit("none").alias("status")) for n in SIGNATURES]))
    found = shares(F.col("html"))
    scored = F.array(*[F.struct(_score(n, s, F.col("facts")[i]["status"]).alias("score"), F.lit(n).alias("platform"), F.lit(n in GENERIC).alias("generic"))
                       for i, (n, s) in enumerate(found.items())])
    ordered = F.array_sort(F.filter(F.transform(scored, lambda x: F.struct((-x["score"]).alias("neg"), x["generic"].alias("generic"), x["platform"].alias("platform"))),
                                    lambda x: -x["neg"] >= MIN_SCORE))
    rows = base.select("page_id", F.posexplode(ordered).alias("p", "m")).select("page_id", F.col("m.platform").alias("platform"), (-F.col("m.neg")).alias("score"), (F.col("p") + 1).alias("position"))
    blocked = judged.filter("_blocked").select("page_id", F.lit("blocked").alias("platform"), F.lit(1.0).alias("score"), F.lit(1).alias("position"))
    return rows.unionByName(blocked)


