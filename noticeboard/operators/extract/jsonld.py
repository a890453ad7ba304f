"""schema.org islands in pages. One kernel walks a document for events; the rest is native on variants."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ...functions.addresses import split_postal
from ...functions.rules import SCHEMA_TYPE_CATEGORY
from ...functions.text import NOTICE_TITLE, absolute_url, strip_html, unescape
from ...functions.times import let, make_day, offset_minutes, on_the_minute, utc_to_wall
from ...session import settled
from ...settings import DEFAULT, Settings
from .common import arrival, described, finish, nonblank, param, place, responses
from .json_feeds import get, text

# --- fixed values ----------------------------------------------------------
NOT_OCCURRENCES = ("EventSeries", "DeliveryEvent", "PublicationEvent", "BroadcastEvent", "OnDemandEvent")
EXTRA_TYPES = ("Festival", "Hackathon")
SCRIPT = r"(?is)<script\b[^>]*\bld\+json\b[^>]*>(.*?)</script>"
ISO = (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(Z|[+-]\d{1,2}(?::?\d{2})?)?)?\s*$")
TICKET_LINK = r"(?i)TICKET\s+LINK:\s*https?://\S+\s*"
# ---------------------------------------------------------------------------


def _bare_types(node: dict) -> list[str]:
    kinds = node.get("@type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    return [k.replace("#", "/").replace(":", "/").rsplit("/", 1)[-1] for k in kinds if isinstance(k, str)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def event_nodes(scripts: pd.Series) -> pd.Series:
    """Arrow kernel: every event object at any depth of the given JSON texts, as JSON, in document order.

    Raw control characters inside strings are tolerated; an unreadable text yields nothing.
    """
    def walk(top):
        queue = [top]
        while queue:
            node = queue.pop()
            if isinstance(node, list):
                queue.extend(reversed(node))
            elif isinstance(node, dict):
                kinds = _bare_types(node)
                if any((k.endswith("Event") or k in EXTRA_TYPES) and k not in NOT_OCCURRENCES for k in kinds):
                    yield {**node, "@bare": kinds}
                queue.extend(reversed([v for k, v in node.items() if k != "@context" and isinstance(v, (dict, list))]))

    def one(texts):
        out = []
        for t in texts if texts is not None else ():
            try:
                doc = json.loads(t, strict=False)
            except ValueError:
                continue
            out.extend(json.dumps(n) for n in walk(doc))
        return out

    return scripts.map(one)


def islands(body: Column) -> Column:
    """Texts of a page's ld+json scripts, comment and CDATA wrappers removed."""
    raw = F.regexp_extract_all(body, F.lit(SCRIPT), 1)
    bare = F.transform(raw, lambda t: F.trim(F.regexp_replace(t, r"^\s*(?://\s*)?<!\[CDATA\[|(?://\s*)?\]\]>\s*$|^\s*<!--|-->\s*$", "")))
    return F.filter(bare, lambda t: t != "")


def read_when(raw: Column, mode: Column, home: str) -> Column:
    """struct(at, all_day), or null when unreadable or its offset is not the region's at that clock.

    ``mode``: ``check`` believes an offset only where it is the region's own, ``wall``
    ignores it, ``instant`` converts by it.
    """
    part = lambda n: F.regexp_extract(raw, ISO, n)
    day = make_day(part(1), part(2), part(3)).cast("timestamp_ntz")
    hour, minute = part(4).try_cast("int"), part(5).try_cast("int")
    at = lambda t, d: F.when(t.isNotNull(), F.struct(t.alias("at"), F.lit(d).alias("all_day")))
    offset = part(7)

    def timed(wall):
        # the region's own offset: converting the instant gives back the written clock (either side of an overlap)
        return let(utc_to_wall(wall - F.make_dt_interval(mins=offset_minutes(offset)), home), lambda moved: at(
            F.when((offset == "") | (mode == "wall"), wall).when(mode == "instant", on_the_minute(moved)).when(moved == wall, wall), False))

    return F.when(raw.rlike(ISO), F.when(part(4) == "", at(day, True)).otherwise(
        let(F.when((hour < 24) & (minute < 60), day + F.make_dt_interval(hours=hour, mins=minute)), timed)))


def one_of(v: Column, path: str) -> Column:
    """A field that may be a value or a list: its first entry as text."""
    return F.coalesce(text(v, path), text(v, path + "[0]"))


def image_of(v: Column, path: str) -> Column:
    options = [text(v, path), text(v, path + ".url"), text(v, path + ".contentUrl"), text(v, path + "[0]"), text(v, path + "[0].url"), text(v, path + "[0].contentUrl")]
    return F.coalesce(*[F.when(o.startswith("http"), o) for o in options])


def offer_cost(v: Column) -> Column:
    """The first offer that states a price, as text."""
    offers = F.coalesce(get(v, "$.offers", "array<variant>"), F.array(get(v, "$.offers", "variant")))

    def one(o):
        money = F.coalesce(nonblank(get(o, "$.priceCurrency")), F.lit("USD"))
        sign = F.when(money == "USD", "$").otherwise(F.concat(money, F.lit(" ")))
        low, high = get(o, "$.lowPrice"), get(o, "$.highPrice")
        price = F.coalesce(get(o, "$.price"), low)
        zero = (price.try_cast("double") == 0) & (high.isNull() | (high == "") | (high == "0"))
        # a price that is no number spoils the offer
        readable = price.isNull() | price.try_cast("double").isNotNull()
        return F.when(readable, F.when(zero, "Free").when(high.try_cast("double") > low.try_cast("double"), F.concat(sign, low, F.lit(" - "), sign, high))
                      .when(F.trim(price) != "", F.concat(sign, price)))

    return F.try_element_at(F.filter(F.transform(offers, one), lambda c: c.isNotNull()), F.lit(1))


def jsonld(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    rows = responses(captures, registry, "jsonld")
    rows = rows.select("*", F.posexplode(event_nodes(islands(F.col("body")))).alias("pos", "node")).drop("body")
    rows = settled(rows.withColumn("v", F.try_parse_json("node")).drop("node"))
    v = F.col("v")
    rows = settled(rows.withColumn("title", strip_html(text(v, "$.name"))).withColumn("_status", F.coalesce(get(v, "$.eventStatus"), F.lit(""))))
    rows = rows.filter((F.length("title") >= 3) & ~F.col("_status").rlike("(EventCancelled|EventPostponed)$") & ~F.col("title").rlike(NOTICE_TITLE))
    mode = param("offsets", "check")
    # what several later columns ask for is a column of its own, so that it is worked out once
    rows = settled(rows.withColumns({"_from": one_of(v, "$.startDate"), "_to": one_of(v, "$.endDate")}))
    rows = settled(rows.withColumn("_s", read_when(F.col("_from"), mode, settings.zone)).withColumn("_e", read_when(F.col("_to"), mode, settings.zone)))
    rows = rows.withColumn("start_datetime", F.col("_s.at")).withColumn("all_day", F.col("_s.all_day"))
    rows = rows.withColumn("end_datetime", F.when(~F.col("all_day") & ~F.col("_e.all_day"), F.col("_e.at")))
    places = F.filter(F.coalesce(get(v, "$.location", "array<variant>"), F.array(get(v, "$.location", "variant"))), lambda p: p.isNotNull())
    virtual = lambda p: F.coalesce(F.to_json(get(p, "$['@type']", "variant")).contains("VirtualLocation"), F.lit(False))
    rows = settled(rows.withColumn("_places", places))
    rows = settled(rows.withColumn("_pl", F.try_element_at(F.filter("_places", lambda p: ~virtual(p)), F.lit(1))).withColumn("_np", F.size("_places")))
    p = F.col("_pl")
    online = F.col("_status").endswith("EventMovedOnline") | ((F.col("_np") > 0) & p.isNull())
    name = strip_html(F.coalesce(text(p, "$.name"), text(p, "$")))
    rows = settled(rows.withColumn("_addr", unescape(text(p, "$.address"))).withColumn("_name", name).withColumn("_region", unescape(text(p, "$.address.addressRegion"))))
    rows = settled(rows.withColumn("_split", split_postal(F.col("_addr"))))
    split, name, region = F.col("_split"), F.col("_name"), F.col("_region")
    given = lambda leaf, alt: F.coalesce(nonblank(unescape(get(p, f"$.address.{leaf}"))), split[alt])
    leaves = (("streetAddress", "street"), ("addressLocality", "city"), ("postalCode", "zip"))
    rows = settled(rows.withColumns({f"_{alt}": given(leaf, alt) for leaf, alt in leaves}))
    pick = lambda leaf, alt: F.col(f"_{alt}")
    at = place(F.substring(F.when(online, "Online").otherwise(name), 1, 150), F.substring(F.when(~online, pick("streetAddress", "street")), 1, 200),
               F.substring(F.when(~online, pick("addressLocality", "city")), 1, 50), F.when(~online, pick("postalCode", "zip")),
               F.when(~online, F.coalesce(F.when(region.rlike("^[A-Z]{2}$"), region), split["state"])))
    rows = settled(rows.withColumns(at))
    own = ~online & ((name != "") | pick("streetAddress", "street").isNotNull() | pick("addressLocality", "city").isNotNull())
    types = get(v, "$['@bare']", "array<string>")
    table = F.create_map(*[F.lit(x) for kv in SCHEMA_TYPE_CATEGORY.items() for x in kv])
    by_type = F.try_element_at(F.filter(F.transform(types, lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull()), F.lit(1))
    story = unescape(F.regexp_replace(strip_html(text(v, "$.description")), TICKET_LINK, " "))
    link = F.coalesce(nonblank(F.trim(one_of(v, "$.url"))), nonblank(F.trim(text(v, "$.offers.url"))), nonblank(F.trim(text(v, "$.offers[0].url"))))
    rows = settled(rows.withColumn("_link", link))
    rows = (rows.withColumn("latitude", F.when(own, get(p, "$.geo.latitude").try_cast("double")))
            .withColumn("longitude", F.when(own, get(p, "$.geo.longitude").try_cast("double")))
            .withColumn("description", described(story, F.col("title"), F.col("venue_name"))).withColumn("cost", offer_cost(v))
            .withColumn("category", F.coalesce(param("category"), by_type)).withColumn("source_url", absolute_url(F.coalesce("final_url", "url"), F.col("_link")))
            .withColumn("image_url", F.coalesce(image_of(v, "$.image"), image_of(v, "$.performer.image"), image_of(v, "$.performer[0].image")))
            .withColumn("arrival_ix", arrival(F.col("pos"))))
    return finish(rows, ["source_url", "start_datetime", "title"])
