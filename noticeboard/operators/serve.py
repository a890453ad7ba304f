"""Read side: predicates, ordering, search, roll-ups and digests over listings.

Each function only adds filters, projections and one sort, so Catalyst merges a
chain of them into a single scan with pushed filters, pruned columns and, with a
limit, ``TakeOrderedAndProject``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores
from ..functions.rules import fee_shown_free, fee_shown_paid, free_api, free_strict
from ..functions.text import slugify
from ..functions.times import local_naive, ntz
from ..schema import missing
from ..settings import DEFAULT

# --- fixed values ----------------------------------------------------------
SLIM_COLUMNS = ("id", "title", "start_datetime", "end_datetime", "all_day", "venue_name", "city", "latitude",
                "longitude", "category", "family_friendly", "image_url", "source_url", "source_name", "cost",
                "score", "featured")
SEARCH_WEIGHTS = (("title", 4), ("venue_name", 3), ("category", 2), ("city", 2), ("weekday", 1),
                  ("source_name", 1), ("cost", 1))
DIGEST_PER_PART = 7
DIGEST_DAYS = 30
DIGEST_LIMIT = 500
TURN_LIMIT, TURN_CHARS = 10, 4000
MAX_LIMIT = 5000
RETAIN_PAST_DAYS = 90
# ---------------------------------------------------------------------------

_c = F.col


# --- predicates ------------------------------------------------------------------

def upcoming(as_of) -> Column:
    return scores.upcoming(_c("start_datetime"), _c("end_datetime"), _c("all_day"), as_of)


def recently_past(as_of, days: int = RETAIN_PAST_DAYS) -> Column:
    now = ntz(as_of)
    return (_c("start_datetime") < now) & (_c("start_datetime") >= now - F.expr(f"INTERVAL {days} DAYS"))


def same_text(column: str, value: str) -> Column:
    """Case-insensitive equality; a row without the value never matches."""
    return F.lower(_c(column)) == value.lower()


def window_bounds(name: str, as_of) -> tuple[Column, Column] | None:
    """Half-open day range. A weekend is Friday to Sunday and stays put once begun."""
    today = F.to_date(ntz(as_of))
    if name == "today":
        return today, F.date_add(today, 1)
    if name == "tomorrow":
        return F.date_add(today, 1), F.date_add(today, 2)
    if name == "week":
        return today, F.date_add(today, 7)
    if name == "weekend":
        # weekday: Monday 0 .. Sunday 6; Saturday and Sunday look back to their Friday
        friday = F.date_add(today, F.lit(4) - F.weekday(today))
        return F.greatest(friday, today), F.date_add(friday, 3)
    return None


def in_window(name: str, as_of) -> Column:
    lo, hi = window_bounds(name, as_of)
    return (_c("start_datetime") >= lo.cast("timestamp_ntz")) & (_c("start_datetime") < hi.cast("timestamp_ntz"))


def bound(value, zone: str) -> Column:
    """A bound of a query as local wall clock: text with an offset is moved to the zone, other text is local already."""
    return local_naive(F.lit(value), zone) if isinstance(value, str) else ntz(value)


def filter_listings(df: DataFrame, as_of, *, upcoming_only=False, category=None, city=None, source=None,
                    start=None, end=None, free_only=False, family=None, zone: str = DEFAULT.zone) -> DataFrame:
    tests = []
    if upcoming_only:
        tests.append(upcoming(as_of))
    if category:
        tests.append(_c("category") == category)
    if city:
        tests.append(same_text("city", city))
    if source:
        tests.append(same_text("source_name", source))
    if start is not None:
        tests.append(_c("start_datetime") >= bound(start, zone))
    if end is not None:
        tests.append(_c("start_datetime") <= bound(end, zone))
    if free_only:
        tests.append(free_api(_c("cost")))
    if family is not None:
        tests.append(_c("family_friendly") == F.lit(family))
    for t in tests:
        df = df.filter(t)
    return df


def filter_board(df: DataFrame, as_of, *, categories=(), sources=(), all_sources: int | None = None, fee=None,
                 date=None, for_map=False, searching=False) -> DataFrame:
    """The list page's filters. Selecting every source is no filter; a map shows today unless told otherwise."""
    if categories:
        df = df.filter(_c("category").isin(*categories))
    if fee == "free":
        df = df.filter(fee_shown_free(_c("cost")))
    elif fee == "paid":
        df = df.filter(fee_shown_paid(_c("cost")))
    if sources and (all_sources is None or len(sources) < all_sources):
        df = df.filter(F.coalesce("source_name", F.lit("")).isin(*sources))
    if date is None and for_map and not searching:
        date = F.to_date(ntz(as_of))
    if date is not None:
        day = F.lit(str(date)).cast("date") if not isinstance(date, Column) else date
        df = df.filter(F.to_date("start_datetime") == day)
    return df


# --- ordering ----------------------------------------------------------------------

def ranked(df: DataFrame, as_of) -> DataFrame:
    """By relevance, ties in table order. Adds ``score``."""
    return df.withColumn("score", scores.relevance(as_of)).orderBy(_c("score").desc(), "arrival_ix")


def by_date(df: DataFrame, descending: bool = False) -> DataFrame:
    start = _c("start_datetime").desc() if descending else _c("start_datetime").asc()
    return df.orderBy(start, "arrival_ix")


def page(df: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_LIMIT} and offset not negative")
    return df.offset(offset).limit(limit)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("pages"))


def slim(df: DataFrame) -> DataFrame:
    """The columns a list or map needs; the description is never read."""
    if "score" not in df.columns:
        df = df.withColumn("score", F.lit(None).cast("double"))
    return df.select(*[F.round("score", 3).alias("score") if c == "score" else c for c in SLIM_COLUMNS])


def by_id(df: DataFrame, listing_id: str) -> DataFrame:
    return df.filter(_c("id") == listing_id)


# --- search ------------------------------------------------------------------------

def search(df: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Substring in title or description; title hits first, then by date."""
    q = query.lower()
    in_title = F.lower("title").contains(q)
    hits = df.filter(in_title | F.lower(F.coalesce("description", F.lit(""))).contains(q)).withColumn("title_hit", in_title)
    return hits.orderBy(~_c("title_hit"), "start_datetime", "arrival_ix").limit(limit)


def weighted_search(df: DataFrame, query: str) -> DataFrame:
    """Every term must land; each counts its heaviest field. Adds ``match_score``; ties keep table order."""
    terms = query.lower().split()
    weekday = F.date_format("start_datetime", "EEEE")
    value = lambda name: F.lower(F.coalesce(weekday if name == "weekday" else _c(name), F.lit("")))
    best = []
    for term in terms:
        hit = F.lit(0)
        for name, weight in reversed(SEARCH_WEIGHTS):
            hit = F.when(value(name).contains(term), weight).otherwise(hit)
        best.append(hit)
    if not best:
        return df
    out = df.withColumn("_best", F.array(*best)).filter(F.forall("_best", lambda b: b > 0))
    return (out.withColumn("match_score", F.aggregate("_best", F.lit(0), lambda a, b: a + b)).drop("_best")
            .orderBy(_c("match_score").desc(), "arrival_ix"))


# --- picks and facets --------------------------------------------------------------

def flag_picks(df: DataFrame, picks: DataFrame) -> DataFrame:
    """Mark every listing whose title and source are picked; null and empty are the same key."""
    key = lambda c: F.coalesce(_c(c), F.lit(""))
    chosen = picks.select(key("title").alias("_pt"), key("source_name").alias("_ps"), F.lit(True).alias("_picked")).distinct()
    joined = df.join(chosen, (key("title") == _c("_pt")) & (key("source_name") == _c("_ps")), "left")
    featured = _c("featured") if "featured" in df.columns else F.lit(False)
    return joined.withColumn("featured", F.coalesce("_picked", featured, F.lit(False))).drop("_pt", "_ps", "_picked")


def prune_picks(picks: DataFrame, listings: DataFrame, as_of, by_day: bool = False) -> DataFrame:
    """Drop picks that no upcoming listing matches. Without any listings nothing is dropped.

    ``by_day`` compares dates only, the nightly variant; otherwise the read side's rule.
    """
    if listings.isEmpty():
        return picks
    live = listings.filter(F.to_date("start_datetime") >= F.to_date(ntz(as_of))) if by_day else listings.filter(upcoming(as_of))
    key = lambda c: F.coalesce(_c(c), F.lit(""))
    live = live.select(key("title").alias("_t"), key("source_name").alias("_s")).distinct()
    return picks.join(live, (key("title") == _c("_t")) & (key("source_name") == _c("_s")), "left_semi")


def add_pick(picks: DataFrame, listings: DataFrame, listing_id: str, as_of) -> DataFrame:
    chosen = by_id(listings, listing_id).select("title", "source_name").distinct()
    kept = prune_picks(picks, listings, as_of)
    fresh = chosen.join(kept, chosen["title"].eqNullSafe(kept["title"]) & chosen["source_name"].eqNullSafe(kept["source_name"]), "left_anti")
    return kept.unionByName(fresh)


def remove_pick(picks: DataFrame, listings: DataFrame, listing_id: str, as_of) -> DataFrame:
    gone = by_id(listings, listing_id).select("title", "source_name").distinct()
    kept = picks.join(gone, picks["title"].eqNullSafe(gone["title"]) & picks["source_name"].eqNullSafe(gone["source_name"]), "left_anti")
    return prune_picks(kept, listings, as_of)


FACET_SCHEMA = "slug string, heading string, window string, free boolean, family boolean, category string, city string"


def facet_rows(settings) -> list[tuple]:
    """The landing pages: three windows, two audiences, one per category, one per city."""
    # --- fixed values ------------------------------------------------------
    rows = [("today", "Today", "today", None, None, None, None),
            ("this-weekend", "This Weekend", "weekend", None, None, None, None),
            ("this-week", "This Week", "week", None, None, None, None),
            ("free", "Free Events", None, True, None, None, None),
            ("family", "Family & Kids", None, None, True, None, None)]
    for slug, heading, category in (
            ("music", "Live Music", "music"), ("theater", "Theater", "theater"),
            ("arts-and-culture", "Arts & Culture", "arts and culture"), ("lectures", "Talks & Lectures", "lectures"),
            ("food-and-drink", "Food & Drink", "food and drink"), ("community", "Community", "community"),
            ("sports", "Sports & Fitness", "sports")):
        rows.append((slug, heading, None, None, None, category, None))
    # -----------------------------------------------------------------------
    return rows + [(c.lower().replace(" ", "-"), c, None, None, None, None, c) for c in settings.cities]


def match_facets(listings: DataFrame, facets: list[tuple], as_of) -> DataFrame:
    """Each upcoming listing once per landing page it belongs to (column ``facet``).

    The pages are a small fixed list, so each row tests them in one array
    expression and explodes its hits: no join, no shuffle.
    """
    tests = []
    for slug, _, window, free, family, category, city in facets:
        t = F.lit(True)
        if category:
            t = t & (F.lower(F.coalesce("category", F.lit(""))) == category)
        if city:
            t = t & (F.lower(F.coalesce("city", F.lit(""))) == city.lower())
        if free:
            t = t & free_strict(_c("cost"))
        if family:
            t = t & F.coalesce("family_friendly", F.lit(False))
        if window:
            t = t & in_window(window, as_of)
        tests.append(F.when(t, F.lit(slug)))
    hits = F.filter(F.array(*tests), lambda s: s.isNotNull())
    return listings.select("*", F.explode(hits).alias("facet"))


def top_per(df: DataFrame, key, order, n: int) -> DataFrame:
    """First ``n`` rows per key; the limit is pushed below the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(_c("position") <= n)


def featured_strip(listings: DataFrame, enabled: bool = True, n: int = 4) -> DataFrame:
    """Flagged rows, or rows with an image where none is flagged; the first four in table order."""
    if not enabled:
        return listings.limit(0)
    candidates = listings.filter(_c("featured") | ~missing(_c("image_url")))
    flagged = candidates.orderBy(_c("featured").desc(), "arrival_ix").limit(n)
    any_flag = flagged.agg(F.coalesce(F.max("featured"), F.lit(False)).alias("_any"))
    return flagged.join(F.broadcast(any_flag)).filter(_c("featured") | ~_c("_any")).drop("_any")


def at_venue(listings: DataFrame, slug: str) -> DataFrame:
    return listings.filter(slugify(_c("venue_name")) == slug)


# --- roll-ups -----------------------------------------------------------------------

def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source_name").agg(F.count(F.lit(1)).alias("events"))


def stats(df: DataFrame) -> DataFrame:
    """Total, dates, and counts by category, source and city, from one scan.

    Rows are ``(facet, value, events, earliest, latest)``; the total has facet ``all``.
    """
    filled = df.select(F.when(~missing(_c("category")), _c("category")).alias("category"), "source_name",
                       F.when(~missing(_c("city")), _c("city")).alias("city"), "start_datetime")
    sets = filled.groupingSets([["category"], ["source_name"], ["city"], []], "category", "source_name", "city").agg(
        F.count(F.lit(1)).alias("events"), F.min("start_datetime").alias("earliest"), F.max("start_datetime").alias("latest"),
        F.grouping_id().alias("g"))
    facet = F.when(_c("g") == 3, "category").when(_c("g") == 5, "source").when(_c("g") == 6, "city").otherwise("all")
    value = F.coalesce("category", "source_name", "city")
    return (sets.select(facet.alias("facet"), value.alias("value"), "events", "earliest", "latest")
            .filter((_c("facet") == "all") | (_c("facet") == "source") | _c("value").isNotNull()))


def health(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_events"), F.max("last_updated").alias("last_updated"))


# --- digest -------------------------------------------------------------------------

def digest(df: DataFrame, today) -> DataFrame:
    """Upcoming rows spread over days and parts of the day: seven per part, thirty days, five hundred rows.

    A multi-day run already under way is filed under today. Whole days are kept
    until one reaches the limit. Adds ``day, part, position, line_no``.
    """
    t = F.to_date(ntz(today))
    midnight = t.cast("timestamp_ntz")
    start_day = F.to_date("start_datetime")
    still = scores.all_day_still_on(_c("start_datetime"), _c("end_datetime"), _c("all_day"), midnight)
    day = F.when(start_day >= t, start_day).when(still, t)
    hour = F.hour("start_datetime")
    part = F.when(_c("all_day") | (hour < 12), 0).when(hour < 17, 1).otherwise(2)
    content = scores.content_score(_c("category"), _c("cost"), _c("featured"))
    filed = df.select("*", day.alias("day"), part.alias("part"), content.alias("content")).filter("day IS NOT NULL")
    best = top_per(filed, ["day", "part"], [_c("content").desc(), "start_datetime", "id"], DIGEST_PER_PART)
    # at most 21 rows a day from here on; only the first thirty days go further
    days = best.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day").limit(DIGEST_DAYS)
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).filter(_c("before") < DIGEST_LIMIT)
    chosen = best.join(F.broadcast(days.select("day", "before")), "day")
    inside = Window.partitionBy("day").orderBy("part", "position")
    return (chosen.withColumn("line_no", _c("before") + F.row_number().over(inside))
            .filter(_c("line_no") <= DIGEST_LIMIT).drop("before", "content"))


def when_text(start: Column, end: Column, all_day: Column) -> Column:
    """``Tue Oct 6, 7:30 PM``, ``Tue Oct 6 (all day)``, ``Tue Oct 6 to Thu Oct 8 (all day)``."""
    day = lambda t: F.date_format(t, "EEE MMM d")
    minute = F.when(F.minute(start) != 0, F.date_format(start, ":mm")).otherwise("")
    span = F.when(F.to_date(end) > F.to_date(start), F.concat(day(start), F.lit(" to "), day(end), F.lit(" (all day)")))
    return F.when(all_day, F.coalesce(span, F.concat(day(start), F.lit(" (all day)")))).otherwise(
        F.concat(day(start), F.lit(", "), F.date_format(start, "h"), minute, F.lit(" "), F.date_format(start, "a")))


def digest_line() -> Column:
    nonblank = lambda c: F.when(c != "", c)
    place = F.concat_ws(", ", nonblank(F.substring("venue_name", 1, 40)), nonblank(_c("city")))
    return F.concat(
        F.lit("- "), F.substring("title", 1, 80), F.lit(" | "),
        when_text(_c("start_datetime"), _c("end_datetime"), _c("all_day")), F.lit(" | "),
        F.when(place != "", place).otherwise("venue not listed"), F.lit(" | "), F.coalesce("category", F.lit("")),
        F.when(_c("family_friendly"), " [F]").otherwise(""), F.lit(" | "), _c("source_url"))


def trim_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: the last ten usable turns, cut to start with the user; content to 4,000 characters.

    Expects ``conv_id, turn, role, text``. At most ten rows per conversation reach the second window.
    """
    usable = turns.filter(_c("role").isin("user", "assistant")).withColumn("content", F.trim("text")).filter("content <> ''")
    last = top_per(usable, "conv_id", [_c("turn").desc()], TURN_LIMIT)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max((_c("role") == "user").cast("int")).over(w)
    return (last.withColumn("_begun", begun).filter("_begun = 1")
            .select("conv_id", "turn", "role", F.substring("content", 1, TURN_CHARS).alias("content")))


def display(df: DataFrame) -> DataFrame:
    """Card fields: weekday, ISO date, ``Oct 6``, a 12-hour time left blank for all-day rows, fallbacks."""
    s = _c("start_datetime")
    blank = lambda c, d: F.when(missing(_c(c)), F.lit(d)).otherwise(_c(c))
    return df.select(
        "id", blank("title", "Untitled Event").alias("title"), F.date_format(s, "EEEE").alias("day"),
        F.date_format(s, "yyyy-MM-dd").alias("date"), F.date_format(s, "MMM d").alias("date_label"),
        F.when(_c("all_day"), "").otherwise(F.date_format(s, "h:mm a")).alias("time"),
        blank("venue_name", "Location TBD").alias("location"), blank("city", "Location TBD").alias("address"),
        F.coalesce("cost", F.lit("")).alias("fee"), F.coalesce(F.lower("category"), F.lit("other")).alias("type"),
        F.when(_c("latitude").isNotNull() & _c("longitude").isNotNull(), F.array("longitude", "latitude")).alias("coordinates"),
        F.coalesce("family_friendly", F.lit(False)).alias("family_friendly"), F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("source_name", F.lit("")).alias("source_name"), "image_url", "start_datetime", "end_datetime",
        F.coalesce("all_day", F.lit(False)).alias("all_day"), F.coalesce("featured", F.lit(False)).alias("featured"))

