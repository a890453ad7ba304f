"""Listing pages. The HTML kernel yields cards and fields; agreement of the two printed starts is decided natively."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.markup import card_fields, first_attr, first_text
from ...functions.rules import (BOOKSHOP_RULES, CIVIC_RULES, EVENTON_RULES, LIBRARY_TEXT_RULES, first_rule)
from ...functions.text import CANCELLED, absolute_url, image_link, strip_html, unescape
from ...functions.times import from_epoch_seconds, let, make_day, month_number, offset_minutes, on_the_minute, utc_to_wall
from ...session import settled
from ...settings import DEFAULT, Settings
from .common import arrival, described, finish, nonblank, param, place, responses
from .json_feeds import get, text
from .jsonld import event_nodes, islands

# --- fixed values ----------------------------------------------------------
ALL_DAY = r"(?i)\ball[\s-]*day\b"
VISIBLE_TIME = r"(?i)(\d{1,2}):(\d{2})\s*([AP]\.?M\.?)?(?:\s*[—–-]\s*\d{1,2}:\d{2}\s*([AP]\.?M\.?))?"
LIBRARY_ADDRESS = r"^(.+?),\s*([^,]+?)\s*,\s*([A-Z]{2}),?\s*(\d{5})?$"
COMMUNITY_KINDS, STAGE_KINDS, ARTS_KINDS = ("esl", "us-citizenship", "social-work"), ("music-movies",), ("storytimes", "hands-on", "book-clubs")
MUSIC_WORDS = "music|concert|sing"
FAMILY_CATEGORIES = ("children", "storytimes", "all-ages", "kids", "family", "families")
DRUPAL_EXCLUDE = (r"^holiday:", r"executive session", r"^example .*event$")
CLOCK = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?\s*m\.?(?![a-z])"
MONTH_DATE = r"([A-Z][a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})"
NUMERIC_DATE = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
# ---------------------------------------------------------------------------


def _cards(rows: DataFrame, card: str | None, fields: dict) -> DataFrame:
    return rows.select("*", F.posexplode(card_fields(F.col("body"), card, fields)).alias("pos", "c")).drop("body")


def _f(name: str) -> Column:
    return F.try_element_at("c", F.lit(name))


def hour24(hour: Column, meridiem: Column) -> Column:
    """A 12-hour reading with its am/pm letter as an hour of the day."""
    return hour.try_cast("int") % 12 + F.when(F.lower(meridiem).startswith("p"), 12).otherwise(0)


def at_clock(day: Column, hour: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour.cast("int"), mins=minute.cast("int"))


def shown_date(t: Column) -> Column:
    """A printed date: a month name with day and year, else month/day/year."""
    m = lambda n: F.regexp_extract(t, MONTH_DATE, n)
    n = lambda k: F.regexp_extract(t, NUMERIC_DATE, k)
    return F.coalesce(make_day(m(3), month_number(m(1)), m(2)), make_day(n(3), n(1), n(2)))


# --- EventON ------------------------------------------------------------------------------

def eventon(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cards with an epoch pair and a schema wall clock that must agree; the schema's offset is not read."""
    rows = responses(captures, registry, "eventon")
    inner = get(F.try_parse_json("body"), "$.html")
    rows = rows.withColumn("body", F.coalesce(inner, "body"))
    rows = _cards(rows, ".eventon_list_event", {"": "", "title": ".evcal_event_title", "ld": "script[type=application/ld+json]", "time": ".evcal_time",
                                                "start": "[itemprop=startDate]", "link": "a.evcal_list_a", "any": "a[href]", "url": "[itemprop=url]",
                                                "img": "[itemprop=image]", "data": "[data-img]", "loc": ".evoet_data[data-d]"})
    klass = F.coalesce(first_attr(_f(""), "class"), F.lit(""))
    rows = rows.filter(~klass.rlike(r"(^|\s)no_events(\s|$)"))
    node = F.try_element_at(event_nodes(F.array(F.coalesce(first_text(_f("ld")), F.lit("")))), F.lit(1))
    rows = settled(rows.withColumn("v", F.try_parse_json(node)).withColumn("title", unescape(F.try_element_at(_f("title"), F.lit(1))["joined"])))
    v = F.col("v")
    rows = rows.filter((F.length("title") >= 3) & ~klass.rlike(r"(^|\s)cancelled(\s|$)") & ~F.coalesce(get(v, "$.eventStatus"), F.lit("")).endswith("EventCancelled") & ~F.col("title").rlike(CANCELLED))
    epoch = lambda n: F.regexp_extract(F.coalesce(first_attr(_f(""), "data-time"), F.lit("")), r"^(\d*)-?(\d*)", n)
    local = lambda n: on_the_minute(utc_to_wall(from_epoch_seconds(epoch(n).try_cast("bigint")), settings.zone))
    raw = F.coalesce(nonblank(text(v, "$.startDate")), first_attr(_f("start"), "content"), F.lit(""))
    pat = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2}):(\d{2}))?"
    g = lambda n: F.regexp_extract(raw, pat, n)
    day = make_day(g(1), g(2), g(3))
    rows = (rows.withColumn("_i", local(1)).withColumn("_day", day)
            .withColumn("_s", F.when(g(4) != "", at_clock(day, g(4).try_cast("int"), g(5).try_cast("int"))))
            .withColumn("all_day", F.coalesce(first_text(_f("time")), F.lit("")).rlike(ALL_DAY)))
    dates_agree = F.coalesce(F.to_date("_i") == F.col("_day"), F.lit(True))
    start = F.when(F.col("all_day"), F.when(dates_agree, F.coalesce(F.to_date("_i"), "_day").cast("timestamp_ntz"))) \
        .when(F.col("_i").isNotNull() & F.col("_s").isNotNull() & (F.col("_i") != F.col("_s")), F.lit(None)).otherwise(F.coalesce("_i", "_s"))
    end = local(2)
    rows = rows.withColumn("start_datetime", start).withColumn("end_datetime", F.when(~F.col("all_day") & (F.date_format(end, "HH:mm") != "23:59"), end))
    loc = F.coalesce(get(v, "$.location[0]", "variant"), get(v, "$.location", "variant"))
    name = F.coalesce(nonblank(unescape(text(loc, "$.name"))), nonblank(unescape(F.get_json_object(first_attr(_f("loc"), "data-d"), "$['loc.n']"))))
    part = lambda leaf: nonblank(unescape(text(loc, f"$.address.{leaf}")))
    rows = rows.withColumns(place(name, F.coalesce(part("streetAddress"), nonblank(unescape(text(loc, "$.address")))), part("addressLocality"), part("postalCode"), part("addressRegion")))
    story = strip_html(text(v, "$.description"))
    same = F.regexp_replace(F.lower(story), "[^a-z0-9]+", " ") == F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")
    link = F.coalesce(*[F.when(u.startswith("http"), u) for u in (
        F.trim(F.coalesce(first_attr(_f("link"), "href"), first_attr(_f("any"), "href"))), text(v, "$.url"), first_attr(_f("url"), "href"))], F.col("reg.url"))
    image = F.coalesce(text(v, "$.image"), text(v, "$.image[0]"), first_attr(_f("img"), "content"), first_attr(_f("data"), "data-img"))
    rows = (rows.withColumn("description", described(F.when(~same, story), F.col("title"), F.coalesce("venue_name", "reg.venue.name")))
            .withColumn("source_url", link).withColumn("image_url", F.when(image.startswith("http"), image))
            .withColumn("category", F.coalesce(param("category"), first_rule(F.col("title"), EVENTON_RULES))).withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows, ["title", "start_datetime"])


# --- Assabet --------------------------------------------------------------------------------

def assabet(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Month cards joined to the page's structured data by URL; the printed day and time must say the same."""
    pages = responses(captures, registry, "assabet")
    nodes = (pages.select("source_name", "seq", F.explode(event_nodes(islands(F.col("body")))).alias("node")).withColumn("v", F.try_parse_json("node"))
             .withColumn("link", get(F.col("v"), "$.url")).filter("link IS NOT NULL"))
    nodes = nodes.groupBy("source_name", "seq", "link").agg(F.max("node").alias("node")).withColumn("v", F.try_parse_json("node"))
    cards = _cards(pages, "div.listing-event", {"": "", "link": "h3 a[href]", "day": ".event-day", "time": ".event-time", "branch": ".event-location-branch",
                                                "room": ".event-location-location", "addr": ".event-location-address"}).withColumn("link", first_attr(_f("link"), "href"))
    rows = cards.join(nodes, ["source_name", "seq", "link"])
    v = F.col("v")
    rows = settled(rows.withColumn("title", strip_html(text(v, "$.name"))))
    rows = rows.filter((F.length("title") >= 3) & ~F.coalesce(get(v, "$.eventStatus"), F.lit("")).endswith("EventCancelled") & ~F.col("title").rlike(CANCELLED))
    day = F.substring(get(v, "$.startDate"), 1, 10).try_cast("date")
    printed = F.coalesce(first_text(_f("day")), F.lit(""))
    rows = rows.filter(day.isNotNull() & F.contains(printed, F.date_format(day, "MMMM d")))
    shown, door = F.coalesce(first_text(_f("time")), F.lit("")), F.coalesce(get(v, "$.doorTime"), F.lit(""))
    dated = shown.rlike(ALL_DAY) & ((door == "") | door.startswith("00:00"))
    structured = F.concat(get(v, "$.startDate"), F.lit(" "), door).try_cast("timestamp_ntz")
    g = lambda n: F.regexp_extract(shown, VISIBLE_TIME, n)
    mark = F.coalesce(nonblank(g(3)), nonblank(g(4)))
    same = (F.hour(structured) == hour24(g(1), mark)) & (F.minute(structured) == g(2).try_cast("int")) & mark.isNotNull()
    rows = rows.withColumn("all_day", dated).withColumn("start_datetime", F.when(dated, day.cast("timestamp_ntz")).when(same, structured))
    length = F.regexp_extract(F.coalesce(get(v, "$.duration"), F.lit("")), r"^PT(\d+)S$", 1).try_cast("bigint")
    rows = rows.withColumn("end_datetime", F.when(~F.col("all_day"), F.col("start_datetime") + F.make_dt_interval(secs=length)))
    branch, room, address = (nonblank(first_text(_f(n))) for n in ("branch", "room", "addr"))
    online = F.coalesce(get(v, "$.eventAttendanceMode"), F.lit("")).endswith("OnlineEventAttendanceMode") | (
        F.coalesce(F.lower(F.coalesce(branch, room)).isin("zoom", "virtual", "online"), F.lit(False)) & address.isNull())
    prefix = F.coalesce(param("branch_prefix"), F.col("reg.venue.name"), F.col("source_name"))
    name = F.when(branch.isNotNull(), F.concat(prefix, F.lit(" – "), branch)).otherwise(room)
    a = lambda n: nonblank(F.trim(F.regexp_extract(address, LIBRARY_ADDRESS, n)))
    street = F.coalesce(a(1), address)
    at = place(F.when(online, "Online").otherwise(name), F.when(~online, street), F.when(~online, a(2)), F.when(~online, a(4)), F.when(~online, a(3)))
    at["city"] = F.when(online, F.lit(None)).otherwise(F.coalesce(at["city"], F.col("reg.venue.city")))
    rows = rows.withColumns(at)
    kinds = F.transform(F.filter(F.split(F.coalesce(first_attr(_f(""), "class"), F.lit("")), r"\s+"), lambda k: k.startswith("category-")), lambda k: F.substring(k, 10, 100))
    story = F.trim(F.regexp_replace(strip_html(text(v, "$.description")), r"\s*Learn More\s*$", ""))
    story = F.coalesce(nonblank(story), F.concat("title", F.lit(" at "), F.coalesce("venue_name", prefix), F.lit(".")))
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    rows = rows.withColumn("description", story)
    said = F.lower(F.concat("title", F.lit(" "), "description"))
    own = (F.when(has(*COMMUNITY_KINDS), "community")
           .when(has(*STAGE_KINDS), F.when(said.rlike(MUSIC_WORDS), "music").otherwise("arts and culture"))
           .when(has(*ARTS_KINDS), "arts and culture").otherwise(first_rule(said, LIBRARY_TEXT_RULES, "community")))
    rows = (rows.withColumn("family_friendly", has(*FAMILY_CATEGORIES)).withColumn("category", F.coalesce(param("category"), own))
            .withColumn("source_url", F.col("link")).withColumn("image_url", nonblank(text(v, "$.image"))).withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows, ["source_url", "start_datetime"])


# --- Drupal Views ---------------------------------------------------------------------------

def time_element(attr: Column, shown: Column, home: str) -> Column:
    """struct(at, all_day) of a ``<time>`` whose attribute and text agree, else null."""
    c = lambda n: F.regexp_extract(shown, CLOCK, n)
    clocked = shown.rlike(CLOCK)
    at = lambda t, d: F.struct(t.cast("timestamp_ntz").alias("at"), F.lit(d).alias("all_day"))
    day = F.when(attr.rlike(r"^\d{4}-\d{2}-\d{2}$"), attr.try_cast("date"))
    off = F.regexp_extract(attr, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    wall = F.regexp_replace(attr, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    moved = let(wall, lambda w: on_the_minute(F.when(off == "", w).otherwise(utc_to_wall(w - F.make_dt_interval(mins=offset_minutes(off)), home))))

    def judged(x):
        instant, printed, whole = x["instant"], x["printed"], x["day"]
        same_clock = (F.hour(instant) == hour24(c(1), c(3))) & (F.minute(instant) == F.coalesce(c(2).try_cast("int"), F.lit(0)))
        midnight = (F.hour(instant) == 0) & (F.minute(instant) == 0)
        return (F.when(whole.isNotNull(), F.when(~clocked & (whole == printed), at(whole, True)))
                .when(F.to_date(instant) == printed, F.when(clocked & same_clock, at(instant, False)).when(~clocked & midnight, at(instant, True))))

    return let(F.struct(moved.alias("instant"), shown_date(shown).alias("printed"), day.alias("day")), judged)


def drupal_listing(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of a View, then place and a fuller description from each row's own page; never a date from there.

    Captures of detail pages are told apart by a ``views-row`` being absent and their URL being linked.
    """
    pages = responses(captures, registry, "drupal_listing")
    rows = _cards(pages, ".views-row", {"title": ".views-field-title", "link": ".views-field-title a[href]", "time": "time[datetime]",
                                        "body": ".views-field-body", "img": "img[src]"})
    rows = settled(rows.filter(F.size(_f("time")) > 0).withColumn("title", unescape(first_text(_f("title")))))
    extra = F.from_json(param("exclude", "[]"), "array<string>")
    unwanted = F.col("title").rlike("(?i)" + "|".join(DRUPAL_EXCLUDE)) | F.exists(extra, lambda x: F.regexp_like("title", F.concat(F.lit("(?i)"), x)))
    rows = rows.filter((F.length("title") >= 3) & ~unwanted & ~F.col("title").rlike(CANCELLED))
    nth = lambda n: F.try_element_at(_f("time"), F.lit(n))
    # the attribute and text of a time are asked for many times: columns of their own, worked out once
    rows = settled(rows.withColumns({f"_{part}{n}": c for n in (1, 2) for part, c in (("attr", F.trim(F.try_element_at(nth(n)["attrs"], F.lit("datetime")))), ("shown", nth(n)["text"]))}))
    moment = lambda n: time_element(F.col(f"_attr{n}"), F.col(f"_shown{n}"), settings.zone)
    rows = settled(rows.withColumn("_s", moment(1)).withColumn("_e", moment(2)))
    rows = rows.withColumn("start_datetime", F.col("_s.at")).withColumn("all_day", F.col("_s.all_day")).withColumn("end_datetime", F.when(~F.col("all_day"), F.col("_e.at")))
    online = F.col("title").rlike(r"(?i)\b(virtual|zoom)\b")
    at = place(F.when(online, "Online"), None, None)
    rows = settled(rows.withColumns(at).withColumn("_href", first_attr(_f("link"), "href")))
    href = F.col("_href")
    listing = F.regexp_replace("reg.url", r"([?&])page=[^&]*&?", "$1")
    fallback = F.concat(listing, F.when(F.contains(listing, F.lit("?")), "&").otherwise("?"), F.lit("event_date="), F.date_format("start_datetime", "yyyy-MM-dd"))
    rows = settled(rows.withColumn("_story", unescape(first_text(_f("body")))))
    story = F.col("_story")
    where = F.coalesce("venue_name", "reg.venue.name", "source_name")
    rows = (rows.withColumn("source_url", F.when(nonblank(href).isNotNull(), absolute_url(F.col("reg.url"), href)).otherwise(fallback))
            .withColumn("category", F.coalesce(param("category"), first_rule(F.concat_ws(" ", "title", story), CIVIC_RULES, "community")))
            .withColumn("description", F.coalesce(nonblank(story), F.concat("title", F.lit(" - "), where, F.lit("."))))
            .withColumn("image_url", image_link(F.col("reg.url"), first_attr(_f("img"), "src"))).withColumn("arrival_ix", arrival(F.col("pos"))))
    return _with_details(finish(rows, ["source_url", "start_datetime"]), pages)


def _with_details(rows: DataFrame, pages: DataFrame) -> DataFrame:
    details = pages.filter(~F.contains("body", F.lit("views-row"))).select(F.col("url").alias("source_url"), F.explode(card_fields(F.col("body"), None, {
        "addr": ".address", "org": ".address .organization", "l1": ".address .address-line1", "l2": ".address .address-line2", "city": ".address .locality",
        "state": ".address .administrative-area", "zip": ".address .postal-code", "body": ".field--name-body"})).alias("c"))
    g = lambda n: nonblank(unescape(first_text(_f(n))))
    street = nonblank(F.concat_ws(", ", g("l1"), g("l2")))
    details = details.select("source_url", F.coalesce(g("org"), street).alias("n"), street.alias("s"), g("city").alias("ci"), g("state").alias("st"), g("zip").alias("z"), g("body").alias("b"))
    details = details.groupBy("source_url").agg(F.max(F.struct("n", "s", "ci", "st", "z", "b")).alias("d"))
    out = rows.join(details, "source_url", "left")
    found = F.col("d.n").isNotNull()
    for name, leaf in (("venue_name", "n"), ("street_address", "s"), ("city", "ci"), ("state", "st"), ("zip_code", "z")):
        out = out.withColumn(name, F.when(found, F.col(f"d.{leaf}")).otherwise(F.col(name)))
    longer = F.length("d.b") > F.length("description")
    return out.withColumn("description", F.when(longer, F.substring("d.b", 1, 2000)).otherwise(F.col("description"))).select(*rows.columns)


# --- IndieCommerce --------------------------------------------------------------------------

def indiecommerce(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A month's calendar JSON; the printed date (and time) in each teaser must say what the start says."""
    pages = responses(captures, registry, "indiecommerce")
    raw = F.regexp_extract("body", r'(?is)<script[^>]*data-drupal-selector=["\']drupal-settings-json["\'][^>]*>(.*?)</script>', 1)
    pages = pages.withColumn("_o", get(F.try_parse_json(raw), "$.fullCalendarView[0].calendar_options", "variant"))
    events = F.coalesce(get(F.col("_o"), "$.events", "array<variant>"), get(F.try_parse_json(text(F.col("_o"), "$")), "$.events", "array<variant>"))
    rows = pages.select("*", F.posexplode(events).alias("pos", "item")).drop("_o", "body")
    i = F.col("item")
    # a template's content is parsed like any other markup once its tags are opened up
    markup = F.regexp_replace(F.coalesce(text(i, "$.title"), F.lit("")), r"(?i)</?template[^>]*>", "")
    plain = F.regexp_replace(F.coalesce(text(i, "$.title"), F.lit("")), r"(?is)<template[^>]*>.*?</template>", "")
    rows = rows.withColumn("c", card_fields(markup, None, {
        "dt": ".event-teaser__details dt", "dd": ".event-teaser__details dd", "img": "img[src]", "loc": ".event-teaser__details-location", "addr": ".event-teaser__details-location .address",
        "org": ".event-teaser__details-location .organization", "l1": ".event-teaser__details-location .address-line1", "l2": ".event-teaser__details-location .address-line2",
        "city": ".event-teaser__details-location .locality", "state": ".event-teaser__details-location .administrative-area", "zip": ".event-teaser__details-location .postal-code"})[0])
    head = card_fields(plain, None, {"span": "span", "": ""})[0]
    rows = rows.withColumn("_h", head).withColumn("title", unescape(F.coalesce(F.try_element_at(F.col("_h")["span"], F.lit(1))["joined"], F.try_element_at(F.col("_h")[""], F.lit(1))["joined"])))
    rows = rows.filter((F.length("title") >= 3) & ~F.col("title").rlike(CANCELLED))
    labels = F.transform(_f("dt"), lambda e: F.lower(F.regexp_replace(e["text"], r":\s*$", "")))
    detail = lambda name: F.coalesce(F.try_element_at(_f("dd"), F.nullif(F.array_position(labels, F.lit(name)).cast("int"), F.lit(0)))["text"], F.lit(""))
    start, end = F.coalesce(text(i, "$.start"), F.lit("")), text(i, "$.end")
    off = r"(Z|[+-]\d{2}:?\d{2})$"
    wall = F.regexp_replace(start, off, "").try_cast("timestamp_ntz")

    def moved(t):
        o = F.regexp_extract(t, off, 1)
        w = F.regexp_replace(t, off, "").try_cast("timestamp_ntz")
        return on_the_minute(F.when(o == "", w).otherwise(utc_to_wall(w - F.make_dt_interval(mins=offset_minutes(o)), settings.zone)))

    d = lambda n: F.regexp_extract(detail("date"), NUMERIC_DATE, n)
    clock = r"(?i)(\d{1,2}):(\d{2})\s*([ap])\.?m"
    t = lambda n: F.regexp_extract(detail("time"), clock, n)
    same_day = F.to_date(wall) == make_day(d(3), d(1), d(2))
    same_time = (F.hour(wall) == hour24(t(1), t(3))) & (F.minute(wall) == t(2).try_cast("int"))
    rows = rows.withColumn("all_day", F.coalesce(F.lower(get(i, "$.allDay")) == "true", F.lit(False)) | (F.length(start) == 10))
    rows = rows.withColumn("start_datetime", F.when(same_day, F.when(F.col("all_day"), F.date_trunc("day", wall).cast("timestamp_ntz")).when(same_time, moved(start))))
    rows = rows.withColumn("end_datetime", F.when(~F.col("all_day"), moved(end)))
    rows = rows.withColumn("_t", card_fields(F.coalesce(text(i, "$.des"), F.lit("")), None, {"span": "span"})[0])
    rows = rows.withColumn("tags", F.filter(F.transform(F.col("_t")["span"], lambda e: F.trim(e["joined"])), lambda x: x != ""))
    names = F.from_json(param("place_names", "{}"), "map<string,string>")
    rename = lambda c: F.coalesce(F.try_element_at(names, F.coalesce(c, F.lit(""))), c)
    homes = F.from_json(param("homes", "{}"), "map<string,struct<name:string,street:string,city:string,zip:string,state:string>>")
    tag = F.try_element_at(F.filter("tags", lambda x: F.array_contains(F.map_keys(homes), x)), F.lit(1))
    home = F.try_element_at(homes, tag)
    v = F.col("reg.venue")
    g = lambda n: nonblank(first_text(_f(n)))
    org, l1, l2 = g("org"), g("l1"), g("l2")
    s_name = F.when(org.isNotNull(), org).when(l2.isNotNull(), l1).when(l1.rlike(r"^\d"), F.lit(None)).otherwise(l1)
    s_street = F.when(org.isNotNull(), nonblank(F.concat_ws(", ", l1, l2))).when(l2.isNotNull(), l2).when(l1.rlike(r"^\d"), l1)
    structured = place(rename(s_name), s_street, g("city"), F.substring(g("zip"), 1, 5), g("state"))
    free = place(rename(g("loc")), None, None)
    state = F.lit(None).cast("string")
    out = {}
    for f, leaf in (("venue_name", "name"), ("street_address", "street"), ("city", "city"), ("zip_code", "zip"), ("state", "state")):
        plain_venue = F.coalesce(v[leaf], F.col("source_name")) if leaf == "name" else v[leaf]
        from_home = F.coalesce(nonblank(home[leaf]), v[leaf], F.col("source_name")) if leaf == "name" else F.coalesce(nonblank(home[leaf]), v[leaf])
        out[f] = (F.when(F.size(_f("addr")) > 0, structured[f]).when(F.size(_f("loc")) > 0, free[f] if f != "state" else state)
                  .when(tag.isNotNull(), from_home).otherwise(plain_venue))
    rows = rows.withColumns(out)
    where = F.coalesce("venue_name", "reg.venue.name", "source_name")
    line = F.when(F.contains(F.lower("title"), F.lower(where)), F.concat("title", F.lit("."))).otherwise(F.concat("title", F.lit(" at "), where, F.lit(".")))
    line = F.concat(line, F.when(F.size("tags") > 0, F.concat(F.lit(" "), F.array_join("tags", ", "), F.lit("."))).otherwise(""))
    site = F.regexp_extract("reg.url", r"^([a-z]+://[^/?#]+)", 1)
    path = F.coalesce(text(i, "$.url"), F.lit(""))
    rows = (rows.withColumn("description", line)
            .withColumn("cost", F.when(F.array_contains("tags", "Free"), "Free").when(F.array_contains("tags", "Ticketed"), "Ticketed"))
            .withColumn("category", F.coalesce(param("category"), first_rule(F.concat_ws(" ", "title", F.array_join("tags", " ")), BOOKSHOP_RULES, "lectures")))
            .withColumn("source_url", F.when(path.startswith("/"), F.concat(site, path)).otherwise(F.coalesce(nonblank(path), F.col("reg.url"))))
            .withColumn("image_url", image_link(site, first_attr(_f("img"), "src"))).withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows.drop("tags"), ["source_url", "start_datetime"])


