"""Exports and page tables: iCalendar, GeoJSON, schema.org, event, facet and venue pages, the sitemap."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.addresses import location_line, street_only
from ..functions.rules import free_strict
from ..functions.text import escape_html, escape_ics, file_stem, ics_param, place_name, slugify, truncate_words
from ..functions.times import iso_with_offset, ntz
from ..schema import missing
from ..settings import DEFAULT, Settings
from . import serve

# --- fixed values ----------------------------------------------------------
MIN_VENUE_PAGE = 4
LIST_CAP, PANEL_CAP = 60, 10
TITLE_CHARS, PAGE_CHARS, SCHEMA_CHARS = 70, 300, 900
CATEGORY_LABEL = {"music": "Music", "arts and culture": "Arts & Culture", "food and drink": "Food & Drink", "theater": "Theater",
                  "lectures": "Talks & Lectures", "sports": "Sports", "community": "Community", "other": "Events"}
# ---------------------------------------------------------------------------

_c = F.col
_blank = lambda c: F.when(c != "", c)


def ics_files(df: DataFrame, stamp_utc, settings: Settings = DEFAULT) -> DataFrame:
    """One calendar file per listing: ``id, filename, ics`` (CRLF line ends)."""
    day = lambda t: F.date_format(t, "yyyyMMdd")
    sec = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    s, e = _c("start_datetime"), _c("end_datetime")
    location = F.concat_ws(", ", *[_blank(_c(c)) for c in ("venue_name", "street_address", "city", "state")])
    description = F.concat(F.coalesce("description", F.lit("")),
                           F.when(~missing(_c("source_url")), F.concat(F.lit("\n\nMore info: "), _c("source_url"))).otherwise(""))
    starts = F.when(_c("all_day"), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(s))).otherwise(F.concat(F.lit("DTSTART:"), sec(s)))
    ends = F.when(_c("all_day"), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(F.to_date(F.coalesce(e, s)), 1)))) \
        .otherwise(F.concat(F.lit("DTEND:"), sec(F.coalesce(e, s + F.expr("INTERVAL 2 HOURS")))))
    placed = _c("latitude").isNotNull() & _c("longitude").isNotNull()
    lat, lng = _c("latitude").cast("string"), _c("longitude").cast("string")
    label = F.coalesce(_blank(_c("venue_name")), _blank(location), _c("title"))
    lines = [F.lit(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{settings.site_name}//Events//EN",
                                "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "BEGIN:VEVENT")] + [
        F.concat(F.lit("UID:"), "id", F.lit(f"@{settings.ics_domain}")),
        F.concat(F.lit("DTSTAMP:"), sec(ntz(stamp_utc)), F.lit("Z")), starts, ends,
        F.concat(F.lit("SUMMARY:"), escape_ics(_c("title"))), F.concat(F.lit("DESCRIPTION:"), escape_ics(description)),
        F.concat(F.lit("LOCATION:"), escape_ics(location)),
        F.when(placed, F.concat(F.lit("GEO:"), lat, F.lit(";"), lng)),
        F.when(placed, F.concat(F.lit('X-APPLE-STRUCTURED-LOCATION;VALUE=URI;X-ADDRESS="'), ics_param(location),
                                F.lit('";X-APPLE-RADIUS=100;X-TITLE="'), ics_param(label), F.lit('":geo:'), lat, F.lit(","), lng)),
        F.concat(F.lit("URL:"), F.coalesce("source_url", F.lit(""))), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"), F.lit("")]
    return df.select("id", F.concat(file_stem(_c("title")), F.lit(".ics")).alias("filename"), F.concat_ws("\r\n", *lines).alias("ics"))


def geojson(df: DataFrame, colours: dict[str, str], default: str) -> DataFrame:
    """One GeoJSON feature per placed listing, as a JSON string."""
    table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]) if colours else F.create_map(F.lit("other"), F.lit(default))
    d = serve.display(df.filter(_c("latitude").isNotNull() & _c("longitude").isNotNull()))
    props = F.struct("id", "title", "day", _c("date_label").alias("date"), "time", "location", "fee", _c("type"),
                     _c("source_url").alias("sourceUrl"), F.coalesce(F.try_element_at(table, _c("type")), F.lit(default)).alias("color"))
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(F.lit("Point").alias("type"), _c("coordinates")).alias("geometry"), props.alias("properties"))
    return d.select("id", F.to_json(feature).alias("feature"))


def when_long(start: Column, all_day: Column) -> Column:
    day = F.date_format(start, "EEEE, MMMM d, yyyy")
    return F.when(all_day, day).otherwise(F.concat(day, F.lit(" at "), F.date_format(start, "h:mm a")))


def schema_org(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``id, schema``: the listing as schema.org JSON; absent parts are left out, a described cost is not called free."""
    z = settings.zone
    moment = lambda t: F.when(_c("all_day"), F.date_format(t, "yyyy-MM-dd")).otherwise(iso_with_offset(t, z))
    k = lambda text, name: F.lit(text).alias(name)
    url = F.concat(F.lit(f"{settings.site_url}/event/"), _c("id"))
    address = F.struct(k("PostalAddress", "@type"), F.coalesce(_blank(_c("city")), F.lit(settings.default_city)).alias("addressLocality"),
                       k("US", "addressCountry"), F.coalesce(_blank(_c("state")), F.lit(settings.state or None)).alias("addressRegion"),
                       _blank(street_only(_c("street_address"), _c("city"), settings.state)).alias("streetAddress"),
                       _blank(_c("zip_code")).alias("postalCode"))
    placed = (_c("latitude") != 0) & (_c("longitude") != 0)
    place = F.struct(k("Place", "@type"), F.coalesce(_blank(_c("venue_name")), place_name(F.lit(settings.default_city), F.lit(settings.state))).alias("name"),
                     address.alias("address"),
                     F.when(placed, F.struct(k("GeoCoordinates", "@type"), "latitude", "longitude")).alias("geo"))
    free, priced = free_strict(_c("cost")), ~missing(_c("cost"))
    link = F.coalesce(_blank(_c("source_url")), url)
    offer = F.struct(k("Offer", "@type"), F.when(free, "0").alias("price"), k("USD", "priceCurrency"),
                     k("https://schema.org/InStock", "availability"), link.alias("url"), F.when(~free, _c("cost")).alias("description"))
    doc = F.struct(
        k("https://schema.org", "@context"), k("Event", "@type"), _c("title").alias("name"), moment(_c("start_datetime")).alias("startDate"),
        k("https://schema.org/EventScheduled", "eventStatus"), k("https://schema.org/OfflineEventAttendanceMode", "eventAttendanceMode"),
        place.alias("location"), url.alias("url"), moment(_c("end_datetime")).alias("endDate"),
        _blank(truncate_words(_c("description"), SCHEMA_CHARS)).alias("description"),
        F.when(~missing(_c("image_url")), F.array("image_url")).alias("image"),
        F.when(~missing(_c("source_name")), F.struct(k("Organization", "@type"), _c("source_name").alias("name"))).alias("organizer"),
        F.when(free, F.lit(True)).alias("isAccessibleForFree"), F.when(free | priced, offer).alias("offers"))
    return df.select("id", F.to_json(doc).alias("schema"))


def venue_pages(listings: DataFrame, as_of, settings: Settings = DEFAULT) -> DataFrame:
    """Venues with at least four upcoming rows, by slug; named by the most used spelling, first seen on ties.

    Folded to (slug, spelling) first, so a popular venue is a handful of rows.
    """
    up = listings.filter(_c("start_datetime") >= ntz(as_of)).filter(~missing(_c("venue_name")))
    # one kernel call per distinct spelling, not per row
    slugs = up.select("venue_name").distinct().withColumn("slug", slugify(_c("venue_name"))).filter("slug <> ''")
    spelling = (up.groupBy("venue_name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_datetime", "arrival_ix")).alias("seen"),
                                             F.min_by("city", F.struct("start_datetime", "arrival_ix")).alias("city"))
                .join(slugs, "venue_name"))
    page = spelling.groupBy("slug").agg(F.max_by("venue_name", F.struct(_c("n"), F.lit(0))).alias("_any"), F.sum("n").alias("events"),
                                        F.max("n").alias("top"), F.min_by("city", "seen").alias("city"))
    name = spelling.join(page.select("slug", "top"), "slug").filter("n = top").groupBy("slug").agg(F.min_by("venue_name", "seen").alias("name"))
    city = F.coalesce(_blank(_c("city")), F.lit(settings.default_city))
    return (page.filter(_c("events") >= MIN_VENUE_PAGE).join(name, "slug")
            .select("slug", "name", "events", place_name(city, F.lit(settings.state)).alias("city")))


def past_panels(listings: DataFrame, as_of) -> DataFrame:
    """For each recently past listing with a venue: up to ten upcoming ones at that venue, earliest first.

    The ten per venue are chosen before the join, so a past row meets at most ten.
    """
    slugs = listings.select("venue_name").distinct().withColumn("slug", slugify(_c("venue_name"))).filter("slug <> ''")
    up = listings.filter(_c("start_datetime") >= ntz(as_of)).join(slugs, "venue_name")
    best = serve.top_per(up, "slug", ["start_datetime", "arrival_ix"], PANEL_CAP).select(
        "slug", "position", F.col("id").alias("next_id"), F.col("title").alias("next_title"), F.col("start_datetime").alias("next_start"))
    past = listings.filter(serve.recently_past(as_of)).join(slugs, "venue_name").select("id", "slug")
    # an upcoming id is never a past one unless ids repeat; drop such a row
    return past.join(best, "slug").filter(_c("id") != _c("next_id"))


def event_pages(listings: DataFrame, as_of, settings: Settings = DEFAULT) -> DataFrame:
    """Page row per upcoming or recently past listing: url, title, description, noindex, lastmod."""
    past = _c("start_datetime") < ntz(as_of)
    rows = listings.filter((_c("start_datetime") >= ntz(as_of)) | serve.recently_past(as_of))
    slugs = rows.select("venue_name").distinct().withColumn("slug", slugify(_c("venue_name")))
    busy = (rows.filter(~past).join(slugs.filter("slug <> ''"), "venue_name").select("slug").distinct().withColumn("_busy", F.lit(True)))
    rows = rows.join(slugs, "venue_name", "left").join(busy, "slug", "left")
    city = F.coalesce(_blank(_c("city")), F.lit(settings.default_city))
    where = F.coalesce(_blank(_c("venue_name")), city)
    heading = F.when(~missing(_c("venue_name")), F.concat("title", F.lit(" — "), "venue_name", F.lit(", "), place_name(city, F.lit(settings.state)))).otherwise(_c("title"))
    when = when_long(_c("start_datetime"), _c("all_day"))
    gone = F.concat("title", F.lit(" took place at "), where, F.lit(" on "), when, F.lit("."),
                    F.when(_c("_busy"), F.concat(F.lit(" See what is coming up at "), "venue_name", F.lit("."))).otherwise(""))
    ahead = F.coalesce(_blank(truncate_words(_c("description"), PAGE_CHARS)), F.concat("title", F.lit(" at "), where, F.lit(" on "), when, F.lit(".")))
    return rows.select(
        F.concat(F.lit("/event/"), "id").alias("url"),
        truncate_words(F.when(past, F.concat(heading, F.lit(" (past event)"))).otherwise(heading), TITLE_CHARS).alias("title"),
        F.when(past, gone).otherwise(ahead).alias("description"), "image_url", past.alias("noindex"),
        F.when(~past, F.date_format(F.coalesce("last_updated", "scraped_at"), "yyyy-MM-dd")).alias("lastmod"),
        location_line(_c("venue_name"), _c("street_address"), _c("city"), _c("state"), settings.state).alias("location"))


def facet_pages(listings: DataFrame, facets: list[tuple], as_of) -> DataFrame:
    """Landing pages with at least one upcoming listing: slug, rows, first image."""
    up = listings.filter(_c("start_datetime") >= ntz(as_of))
    return serve.match_facets(up, facets, as_of).groupBy("facet").agg(
        F.count(F.lit(1)).alias("events"),
        F.min_by("image_url", F.when(~missing(_c("image_url")), F.struct("start_datetime", "arrival_ix"))).alias("image_url"))


def page_items(listings: DataFrame, facets: list[tuple], as_of) -> DataFrame:
    """The first sixty rows of every landing page, in date order."""
    up = listings.filter(_c("start_datetime") >= ntz(as_of))
    return serve.top_per(serve.match_facets(up, facets, as_of), "facet", ["start_datetime", "arrival_ix"], LIST_CAP)


def home_page(listings: DataFrame, as_of) -> DataFrame:
    """This week's upcoming rows, for the start page."""
    return listings.filter((_c("start_datetime") >= ntz(as_of)) & serve.in_window("week", as_of))


def sitemap(events: DataFrame, facets: DataFrame, venues: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``loc, lastmod, changefreq, priority`` of every page worth indexing."""
    site = F.lit(settings.site_url)
    row = lambda df, loc, lastmod, freq, priority: df.select(
        F.concat(site, loc).alias("loc"), lastmod.alias("lastmod"), F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"))
    none = F.lit(None).cast("string")
    home = events.sparkSession.range(1)
    return (row(home, F.lit("/"), none, "daily", "1.0")
            .unionByName(row(events.filter(~_c("noindex")), _c("url"), _c("lastmod"), "weekly", "0.6"))
            .unionByName(row(facets, F.concat(F.lit("/"), "facet"), none, "daily", "0.8"))
            .unionByName(row(venues, F.concat(F.lit("/venue/"), "slug"), none, "daily", "0.7")))


def duplicate_locs(rows: DataFrame) -> DataFrame:
    """Pages that would overwrite each other; any row here is fatal to a build."""
    return rows.groupBy("loc").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")


def sitemap_xml(rows: DataFrame) -> DataFrame:
    """One ``<url>`` element per row, for a text sink."""
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")))
    return rows.select(F.concat(F.lit("<url>"), F.concat_ws("", tag("loc", escape_html(_c("loc"))), tag("lastmod", _c("lastmod")),
                                                            tag("changefreq", _c("changefreq")), tag("priority", _c("priority"))), F.lit("</url>")).alias("value"))
