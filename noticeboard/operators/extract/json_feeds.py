"""JSON feeds. Polymorphic fields are read as variants; nothing leaves the JVM but entity and tag stripping."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ...functions.text import NOTICE_TITLE, NOTICE_TITLE_RESCHEDULED, absolute_url, squeeze, strip_html, unescape
from ...functions.markup import card_fields
from ...functions.times import (from_epoch_seconds, offset_minutes, on_the_minute, utc_to_wall, wall_to_utc, zone_resolver)
from ...session import settled
from ...settings import DEFAULT, Settings
from .common import arrival, described, finish, nonblank, param, place, responses

# --- fixed values ----------------------------------------------------------
SHORTCODE = r"\[/?[a-z][a-z0-9_]*(?:\s[^\]]*)?\]"
ONLINE_TITLE = r"(?i)^\s*(?:\[\s*(?:virtual|online)\s*\]|(?:virtual|online)\s*:)"
PLACEHOLDERS = r"(?i)double-click to edit\.*|your custom text here"
PRIVATE = ("private party", "private event", "closed to public", "closed to the public",
           "invite only", "invite-only", "members only", "by invitation")
TRIVIA = ("trivia", "quiz", "jeopardy", "bingo", "prize")
PRICE = r"\$\d+(?:\.\d{2})?(?:\s*[-–]\s*\$?\d+(?:\.\d{2})?|\s*/\s*\$\d+(?:\.\d{2})?)?"
EXCLUDED_TYPES = ("Holidays", "Holiday", "Institute Holidays", "University Holidays",
                  "Academic Calendar", "Academic Dates", "Closures")
OPEN_TO_PUBLIC = r"(?i)(?<!not )(?<!n't )open\s+to\s+the\s+(?:general\s+)?public|public\s+is\s+welcome"
GROUP = r"(?:community|students|affiliates|faculty|staff|employees)"
RESTRICTED = (
    r"\binvite[\s-]+only|\bby\s+invitation\s+only",
    r"(?:not|n't)\s+open\s+to\s+the\s+(?:general\s+)?public",
    r"\bclosed\s+to\s+the\s+public",
    r"\bopen\s+(?:only\s+)?(?:to\s+)?(?:the\s+)?(?:[\w&.'-]+\s+){0,3}" + GROUP + r"(?:\s+members)?\s+only")
OWN_ONLY = r"\b(?:only\s+open|open\s+only)\s+to\s+(?:the\s+)?(?:"
OWN_RESTRICTED = r"\brestricted\s+to\s+(?:the\s+)?(?:"
OWN_PROOF = r"\s+(?:id|kerberos|certificate|login|credentials?)\s+(?:is\s+|are\s+)?required"
# ---------------------------------------------------------------------------


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text(v: Column, path: str) -> Column:
    """A string field; any other kind of value reads as null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("STRING"), get(v, path))


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.lower(get(v, path)).isin("true", "1", "yes"), F.lit(False))


def http(c: Column) -> Column:
    return F.when(c.startswith("http"), c)


def items(df: DataFrame, path: str) -> DataFrame:
    """Explode a payload array to rows with ``item`` and ``pos``."""
    parsed = df.withColumn("payload", F.try_parse_json("body"))
    return parsed.select("*", F.posexplode(get(F.col("payload"), path, "array<variant>")).alias("pos", "item")).drop("body", "payload")


# --- The Events Calendar ----------------------------------------------------------------

def _naive(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), t.try_cast("timestamp_ntz"))


def _agreed_time(rows: DataFrame, key: str, out: str, home: str) -> DataFrame:
    """Add ``out``: local wall clock on the minute, if UTC and written clock agree in the row's own zone ``_zone``.

    A manual offset such as ``UTC-5`` sits in ``_shift`` instead of ``_zone``.
    """
    i = F.col("item")
    rows = rows.withColumn("_u", _naive(text(i, f"$.utc_{key}"))).withColumn("_l", _naive(text(i, f"$.{key}")))
    fixed = F.col("_shift").isNotNull()
    rows = rows.withColumn("_said", F.when(fixed, F.col("_u") + F.col("_shift")).otherwise(utc_to_wall(F.col("_u"), F.col("_zone"))))
    from_local = F.when(fixed, F.col("_l") - F.col("_shift")).otherwise(wall_to_utc(F.col("_l"), F.col("_zone")))
    contradicts = F.coalesce(F.col("_said") != F.col("_l"), F.lit(False))
    rows = rows.withColumn("_at", F.when(F.col("_u").isNull(), from_local).when(~contradicts, F.col("_u")))
    return rows.withColumn(out, on_the_minute(utc_to_wall(F.col("_at"), home)))


def tribe(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    i = F.col("item")
    rows = items(responses(captures, registry, "tribe"), "$.events")
    first = lambda path, leaf: F.coalesce(text(i, f"$.{path}.{leaf}"), text(i, f"$.{path}[0].{leaf}"))
    rows = rows.filter((F.coalesce(get(i, "$.status"), F.lit("publish")) == "publish") & ~flag(i, "$.hide_from_listings"))
    rows = (settled(rows.withColumn("title", strip_html(text(i, "$.title"))))
            .filter((F.length("title") >= 3) & ~F.col("title").rlike(NOTICE_TITLE))
            .withColumn("all_day", flag(i, "$.all_day")))
    manual = r"^\s*UTC(?:([+-]\d{1,2}(?:\.\d+)?))?\s*$"
    minutes = F.round(F.coalesce(F.regexp_extract(text(i, "$.timezone"), manual, 1).try_cast("double"), F.lit(0.0)) * 60).cast("int")
    rows = (rows.withColumn("_zone", zone_resolver()(text(i, "$.timezone")))
            .withColumn("_shift", F.when(text(i, "$.timezone").rlike(manual), F.make_dt_interval(mins=minutes))))
    rows = _agreed_time(_agreed_time(rows, "start_date", "_start", settings.zone), "end_date", "_end", settings.zone)
    day = F.date_trunc("day", _naive(text(i, "$.start_date"))).cast("timestamp_ntz")
    rows = (rows.withColumn("start_datetime", F.when(F.col("all_day"), day).otherwise(F.col("_start")))
            .withColumn("end_datetime", F.when(~F.col("all_day"), F.col("_end"))))
    for out, leaf in (("_name", "venue"), ("_street", "address"), ("_city", "city"), ("_zip", "zip")):
        rows = rows.withColumn(out, strip_html(first("venue", leaf)))
    rows = rows.withColumn("_state", strip_html(F.coalesce(first("venue", "stateprovince"), first("venue", "state"), first("venue", "province"))))
    own = (F.col("_name") != "") | (F.col("_street") != "") | (F.col("_city") != "")
    online = F.col("title").rlike(ONLINE_TITLE) | (flag(i, "$.is_virtual") & ~own)
    room = (F.lower(param("rooms", "false")) == "true") & (F.col("_name") != "") & (F.col("_street") == "") & (F.col("_city") == "")
    at = place(F.col("_name"), F.col("_street"), F.col("_city"), F.col("_zip"), F.when(F.col("_state").rlike("^[A-Z]{2}$"), F.col("_state")))
    home = place(None, None, None)
    net = place(F.lit("Online"), None, None)
    none = F.lit(None).cast("string")
    for f in at:
        inside = F.concat(home["street_address"], F.lit(", "), F.col("_name")) if f == "street_address" else (none if f == "state" else home[f])
        rows = rows.withColumn(f, F.when(online, net[f] if f != "state" else none).when(room, inside).otherwise(at[f]))
    prose = lambda k: unescape(F.regexp_replace(strip_html(text(i, k)), SHORTCODE, " "))
    rows = rows.withColumn("_ex", prose("$.excerpt")).withColumn("_de", prose("$.description"))
    tags = F.transform(F.filter(get(i, "$.categories", "array<variant>"), lambda c: get(c, "$.name").isNotNull()), lambda c: get(c, "$.name"))
    image = F.coalesce(http(text(i, "$.image")), http(first("image", "url")))
    rows = (rows.withColumn("description", described(F.coalesce(nonblank(F.col("_ex")), F.col("_de")), F.col("title"), F.col("venue_name")))
            .withColumn("category", param("category")).withColumn("tags", F.coalesce(_strip_all(tags), F.array().cast("array<string>")))
            .withColumn("cost", nonblank(strip_html(text(i, "$.cost")))).withColumn("source_url", F.coalesce(nonblank(text(i, "$.url")), F.col("reg.url")))
            .withColumn("website_url", http(text(i, "$.website"))).withColumn("image_url", image).withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows, ["source_url", "start_datetime"])


def _strip_all(tags: Column) -> Column:
    """Strip each label through one kernel call: labels travel as one string with a separator."""
    joined = unescape(F.array_join(tags, "\x1e"))
    parts = F.transform(F.split(joined, "\x1e"), lambda t: squeeze(F.regexp_replace(t, "<[^>]*>", " ")))
    return F.filter(parts, lambda t: t != "")


# --- Squarespace --------------------------------------------------------------------------

def squarespace(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    i = F.col("item")
    rows = items(responses(captures, registry, "squarespace"), "$.upcoming")
    rows = settled(rows.withColumn("title", unescape(text(i, "$.title")))).filter((F.length("title") >= 3) & ~F.col("title").rlike(NOTICE_TITLE_RESCHEDULED))
    millis = lambda k: F.when(get(i, k, "double") > 0, get(i, k, "double"))
    moment = lambda k: on_the_minute(utc_to_wall(from_epoch_seconds(F.floor(millis(k) / 1000)), settings.zone))
    rows = rows.withColumn("start_datetime", moment("$.startDate")).withColumn("end_datetime", moment("$.endDate"))
    rows = rows.withColumn("_b", card_fields(F.coalesce(text(i, "$.body"), F.lit("")), None, {"block": ".sqs-html-content", "": ""})[0])
    tidy = lambda arr: squeeze(F.array_join(F.filter(F.transform(arr, lambda b: F.trim(F.regexp_replace(squeeze(b["text"]), PLACEHOLDERS, ""))), lambda t: t != ""), " "))
    rows = (rows.withColumn("_excerpt", strip_html(text(i, "$.excerpt")))
            .withColumn("_text", F.coalesce(nonblank(tidy(F.col("_b")["block"])), nonblank(F.col("_excerpt")), tidy(F.col("_b")[""]))))
    both = F.lower(F.concat("title", F.lit(" "), "_text"))
    rows = settled(rows).filter(~both.rlike("|".join(PRIVATE)))
    line2 = unescape(text(i, "$.location.addressLine2"))
    parts = F.filter(F.transform(F.split(line2, ","), lambda p: F.trim(p)), lambda p: p != "")
    head = F.try_element_at(parts, F.lit(1))
    city = F.when(~head.rlike(r"^\d{5}(?:-\d{4})?$"), head)
    state = F.try_element_at(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike("^[A-Z]{2}$")), F.lit(1))
    street = unescape(text(i, "$.location.addressLine1"))
    at = place(unescape(text(i, "$.location.addressTitle")), street, city, F.regexp_extract(line2, r"\b(\d{5})(?:-\d{4})?\b", 1), state)
    lat = F.coalesce(get(i, "$.location.markerLat", "double"), get(i, "$.location.mapLat", "double"))
    lng = F.coalesce(get(i, "$.location.markerLng", "double"), get(i, "$.location.mapLng", "double"))
    placed = (street != "") & lat.isNotNull() & lng.isNotNull()
    price = F.coalesce(nonblank(F.regexp_extract("_excerpt", PRICE, 0)), nonblank(F.regexp_extract("description", PRICE, 0)))
    rows = rows.withColumns({**at, "latitude": F.when(placed, lat), "longitude": F.when(placed, lng)})
    rows = rows.withColumn("description", described(F.col("_text"), F.col("title"), F.col("venue_name")))
    rows = (rows.withColumn("cost", F.when(~F.lower(F.concat("title", F.lit(" "), "description")).rlike("|".join(TRIVIA)), price))
            .withColumn("tags", F.coalesce(_strip_all(get(i, "$.categories", "array<string>")), F.array().cast("array<string>")))
            .withColumn("category", param("category")).withColumn("source_url", absolute_url(F.col("reg.url"), text(i, "$.fullUrl")))
            .withColumn("image_url", nonblank(text(i, "$.assetUrl"))).withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows, ["source_url", "start_datetime"])


# --- Localist -------------------------------------------------------------------------------

def localist(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    i = F.col("item")
    rows = items(responses(captures, registry, "localist"), "$.events").withColumn("item", get(i, "$.event", "variant"))
    rows = settled(settled(rows).withColumn("title", unescape(text(i, "$.title"))).withColumn("source_url", F.trim(text(i, "$.localist_url"))))
    rows = rows.filter((F.length("title") >= 3) & F.col("source_url").startswith("http") & ~flag(i, "$.private")
                       & ~F.coalesce(F.lower(get(i, "$.status")).isin("canceled", "cancelled"), F.lit(False)) & ~F.col("title").rlike(NOTICE_TITLE))
    names = lambda arr: F.coalesce(F.transform(arr, lambda t: F.coalesce(get(t, "$.name"), F.lit(""))), F.array().cast("array<string>"))
    types = names(get(i, "$.filters.event_types", "array<variant>"))
    audiences = names(F.try_element_at(get(i, "$.filters", "map<string,array<variant>>"), param("audience_filter", "event_audience")))
    excluded = F.transform(F.from_json(param("exclude_types", '["' + '","'.join(EXCLUDED_TYPES) + '"]'), "array<string>"), lambda t: F.lower(t))
    rows = rows.filter(~F.arrays_overlap(F.transform(types, lambda t: F.lower(t)), excluded))
    # who may attend: the institution's own names only matter where the registry lists them
    said = F.concat(F.coalesce(text(i, "$.title"), F.lit("")), F.lit("\n"), F.coalesce(text(i, "$.description_text"), F.lit("")))
    listed = F.array_join(F.transform(F.from_json(param("affiliation", "[]"), "array<string>"), lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    own = F.concat(F.lit("(?iU)" + OWN_ONLY), listed, F.lit(r")\b|" + OWN_RESTRICTED), listed, F.lit(r")\b|\b(?:"), listed, F.lit(")" + OWN_PROOF))
    closed = said.rlike("(?iU)" + "|".join(RESTRICTED)) | ((listed != "") & F.regexp_like(said, own))
    audience = param("audience", "Public")
    public = (audience.isin("", "null")) | F.array_contains(F.transform(audiences, lambda a: F.lower(a)), F.lower(audience)) | said.rlike(OPEN_TO_PUBLIC)
    rows = rows.filter(~closed & public)
    virtual = F.coalesce(get(i, "$.experience") == "virtual", F.lit(False))
    name = F.coalesce(nonblank(unescape(text(i, "$.location_name"))), unescape(text(i, "$.location")))
    room = unescape(get(i, "$.room_number"))
    roomed = F.when((name != "") & (room != ""), F.concat(name, F.when(room.rlike(r"^[A-Z]?-?\d"), ", Room ").otherwise(", "), room)).otherwise(name)
    state = unescape(text(i, "$.geo.state"))
    # columns of their own, as every field of the place asks for all of them
    rows = rows.withColumn("_roomed", roomed)
    roomed = F.col("_roomed")
    rows = rows.withColumns({"_p_name": F.substring(F.when(virtual, "Online").otherwise(roomed), 1, 150), "_p_street": F.when(~virtual, unescape(text(i, "$.geo.street"))),
                             "_p_city": F.when(~virtual, unescape(text(i, "$.geo.city")))})
    at = place(F.col("_p_name"), F.col("_p_street"), F.col("_p_city"), F.when(~virtual, unescape(get(i, "$.geo.zip"))),
               F.when(~virtual & state.rlike("^[A-Z]{2}$"), state))
    rows = rows.withColumns(at)
    whole = ~virtual & ((roomed != "") | (text(i, "$.geo.street") != "") | (text(i, "$.geo.city") != ""))
    for out, leaf in (("latitude", "latitude"), ("longitude", "longitude")):
        rows = rows.withColumn(out, F.when(whole, get(i, f"$.geo.{leaf}").try_cast("double")))
    said_text = F.coalesce(nonblank(unescape(text(i, "$.description_text"))), strip_html(text(i, "$.description")))
    raw = unescape(get(i, "$.ticket_cost"))
    cost = F.when((raw != "") & ~raw.isin("0", "$0"), F.substring(F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 500)), 1, 100)) \
        .when(flag(i, "$.free") | raw.isin("0", "$0"), "Free")
    rows = (rows.withColumn("description", described(said_text, F.col("title"), F.col("venue_name"))).withColumn("cost", cost)
            .withColumn("tags", F.filter(types, lambda t: t != "")).withColumn("website_url", http(text(i, "$.url")))
            .withColumn("image_url", nonblank(text(i, "$.photo_url"))).withColumn("category", param("category")))
    rows = rows.select("*", F.posexplode(get(i, "$.event_instances", "array<variant>")).alias("n", "one"))
    o = F.col("one")
    rows = rows.withColumn("all_day", flag(o, "$.event_instance.all_day"))

    def instant(path, keep_date):
        t = get(o, f"$.event_instance.{path}")
        off = F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1)
        wall = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
        ok = (off != "") & (F.second(wall) == 0) & (wall == F.date_trunc("second", wall).cast("timestamp_ntz"))
        moved = utc_to_wall(wall - F.make_dt_interval(mins=offset_minutes(off)), settings.zone)
        return F.when(ok, F.when(keep_date, F.date_trunc("day", wall).cast("timestamp_ntz")).otherwise(moved))

    rows = (rows.withColumn("start_datetime", instant("start", F.col("all_day")))
            .withColumn("end_datetime", F.when(~F.col("all_day"), instant("end", F.lit(False))))
            .withColumn("arrival_ix", arrival(F.col("pos") * 1024 + F.col("n"))))
    return finish(rows, ["_lt", "start_datetime", "venue_name"])


def failed_sources(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources whose response is not the shape its platform promises: failed, not empty."""
    side = registry.select(F.col("name").alias("source_name"), "adapter")
    rows = captures.filter("status < 400").join(side, "source_name")
    v = F.try_parse_json("body")
    lists = {"tribe": "$.events", "localist": "$.events", "squarespace": "$.upcoming"}
    bad = F.lit(False)
    for name, path in lists.items():
        bad = bad | ((F.col("adapter") == name) & get(v, path, "array<variant>").isNull())
    bad = bad | ((F.col("adapter") == "ical") & ~F.rlike("body", F.lit("(?i)BEGIN:VCALENDAR")))
    broken = rows.filter(bad).groupBy("source_name").agg(F.count(F.lit(1)).alias("responses"))
    # a JSON-LD source fails only when none of its pages has any
    plain = (rows.filter("adapter = 'jsonld'").groupBy("source_name")
             .agg(F.max(F.lower("body").rlike(r"<script[^>]*ld\+json").cast("int")).alias("has"), F.count(F.lit(1)).alias("responses"))
             .filter("has = 0").drop("has"))
    return broken.unionByName(plain)




def announced_pages(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """``source_name, page, total_pages`` of every good response whose platform announces its number of pages."""
    side = registry.select(F.col("name").alias("source_name"), "adapter")
    rows = captures.filter("status < 400").join(side, "source_name").filter(F.col("adapter").isin("tribe", "localist"))
    v = F.try_parse_json("body")
    total = F.when(F.col("adapter") == "tribe", get(v, "$.total_pages", "int")).otherwise(get(v, "$.page.total", "int"))
    return rows.select("source_name", F.col("seq").alias("page"), total.alias("total_pages")).filter("total_pages IS NOT NULL")
