"""Keyword rules. Each list is folded into one alternation, so a text is scanned once per rule."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# --- fixed values ----------------------------------------------------------
GENERIC_TITLES = ("event", "show", "performance", "image", "home", "calendar")
INTERFACE_TEXT = ("jump to", "click here", "more info", "iframe", "please update")

EXPLICIT_FAMILY = ("family friendly", "family-friendly", "family event",
                   "family program", "family fun", "family day")
FAMILY_WORDS = ("kids?", "children", "child", "bab(?:y|ies)", "toddlers?", "infants?", "youth",
                "teens?", "teenager", "puppets?", "pajamas?", "caregiver")
FAMILY_PHRASES = (
    "story time", "storytime", "story hour", "lapsit", "lap sit",
    "family program", "family event", "family fun", "family day", "puppet show",
    "all ages", "all-ages", "family friendly", "family-friendly",
    "ages 0", "ages 1", "ages 2", "ages 3", "ages 4", "ages 5",
    "ages 6", "ages 7", "ages 8", "ages 9", "ages 10",
    "arts and crafts", "sing along", "sing-along", "singalong", "read aloud", "read-aloud",
    "playgroup", "play group", "playdate", "play date", "pj storytime",
    "preschool", "pre-school", "kindergarten", "young readers", "young reader",
    "parent and child", "parent & child")
EVENING_HOUR = 19

FOOD_EXCLUDED_VENUES = ("library", "branch", "museum", "theater", "theatre", "school", "church")
FOOD_VENUE_NAMES = ("lamplighter", "portico brewing", "aeronaut", "night shift", "idle hands",
                    "lamplighter cx", "lamplighter brewing")
FOOD_VENUE_TYPES = (
    "brewing", "brewery", "brewpub", "taproom", "tap room", "beer garden", "beer hall", "winery",
    "wine bar", "distillery", "restaurant", "cafe", "café", "bistro", "diner", "bar", "pub",
    "tavern", "lounge", "grill", "eatery", "coffeehouse", "coffee house", "bakery", "patisserie")
FOOD_KEYWORDS = (
    "beer", "wine tasting", "cocktail", "cocktails", "spirits", "whiskey", "bourbon",
    "happy hour", "beer tasting", "craft beer", "ipa", "lager", "stout", "cider", "mead",
    "food truck", "foodtruck", "pop-up dinner", "popup dinner", "cooking class", "culinary",
    "farmers market", "farmer's market", "food festival")

NAV_TITLES = (
    r"(?:home|menu|search|login|sign in|subscribe|newsletter|cookie|privacy)$",
    r"(?:read more|learn more|click here|view all|see all|load more|next|previous)$",
    r"(?:skip to|jump to)\b",
    r"\W*$")

API_FREE_COSTS = ("free", "$free", "0", "$0", "free admission")

# ordered keyword rules per platform: first hit wins
EVENTON_RULES = (
    ("theater", ("comedy", "comedian", "stand-up", "standup", "improv")),
    ("arts and culture", ("film", "movie", "screening", "cinema")),
    ("music", ("concert", "band", "tribute", "orchestra", "jazz", "live music")),
    ("lectures", ("talk", "lecture", "conversation", "panel")))
CIVIC_RULES = (
    ("sports", ("exercise", "yoga", "zumba", "walking club", "healthy steps", "tai chi", "fitness")),
    ("community", ("meeting", "committee", "commission", "board", "hearing", "subcommittee", "office hours")),
    ("music", ("concert", "music", "band")),
    ("theater", ("theater", "theatre", "shakespeare", "performance")),
    ("food and drink", ("farmers market", "luncheon", "tea party", "dinner", "brunch")),
    ("lectures", ("workshop", "training", "class", "lecture", "talk", "seminar")),
    ("arts and culture", ("festival", "celebration", "heritage", "art", "movie", "bingo",
                          "knitting", "crochet", "mahjong", "halloween")))
BOOKSHOP_RULES = (
    ("music", ("music", "concert")),
    ("arts and culture", ("story hour", "storytime", "story time", "kids", "children")))
LIBRARY_TEXT_RULES = (
    ("music", ("concert", "singalong", "sing-along", "music")),
    ("lectures", ("workshop", "class", "lecture", "talk", "author")),
    ("arts and culture", ("craft", "art", "film", "movie", "game", "club")))
SCHEMA_TYPE_CATEGORY = {
    "MusicEvent": "music", "TheaterEvent": "theater", "ComedyEvent": "theater",
    "DanceEvent": "theater", "ScreeningEvent": "arts and culture",
    "VisualArtsEvent": "arts and culture", "ExhibitionEvent": "arts and culture",
    "LiteraryEvent": "arts and culture", "FoodEvent": "food and drink", "SportsEvent": "sports",
    "EducationEvent": "lectures", "SocialEvent": "community", "ChildrensEvent": "community"}
# ---------------------------------------------------------------------------


def any_of(words) -> str:
    """One alternation of literal strings, written so that Java and RE2 read it alike."""
    return "|".join(re.sub(r"([.$+?()\[\]|*^{}\\])", r"\\\1", w) for w in words)


NAV_TITLE_PATTERN = "(?U)^(?:" + "|".join(NAV_TITLES) + ")"
# --- fixed values ----------------------------------------------------------
LOW_QUALITY_DATE = r"^[\d/\-\s:]+$"
LOW_QUALITY_MONTH = r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\d{1,2}$"
SAYS_FREE = r"(?i)^\s*(free|\$?0(\.00)?)\s*$"
# ---------------------------------------------------------------------------
FAMILY_PATTERN = r"(?U)\b(?:" + "|".join(FAMILY_WORDS) + r")\b|" + any_of(FAMILY_PHRASES)
FOOD_TYPE_PATTERN = r"(?U)\b(?:" + "|".join(FOOD_VENUE_TYPES) + r")\b"


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def title_and_description(title: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))


def low_quality_title(title: Column) -> Column:
    t = F.trim(_lower(title))
    return ((F.length(t) < 3) | t.rlike("(?U)" + LOW_QUALITY_DATE) | t.rlike(LOW_QUALITY_MONTH)
            | t.isin(*GENERIC_TITLES) | t.rlike(any_of(INTERFACE_TEXT)))


def family_friendly(title: Column, description: Column, start: Column) -> Column:
    """Keyword rule; from 19:00 on only an explicit family phrase counts."""
    text = title_and_description(title, description)
    evening = F.coalesce(F.hour(start) >= EVENING_HOUR, F.lit(False))
    return text.rlike(FAMILY_PATTERN) & (~evening | text.rlike(any_of(EXPLICIT_FAMILY)))


def food_and_drink(venue: Column, source: Column, title: Column, description: Column) -> Column:
    v, s = _lower(venue), _lower(source)
    by_place = (v.rlike(any_of(FOOD_VENUE_NAMES)) | s.rlike(any_of(FOOD_VENUE_NAMES))
                | v.rlike(FOOD_TYPE_PATTERN) | s.rlike(FOOD_TYPE_PATTERN))
    by_text = title_and_description(title, description).rlike(any_of(FOOD_KEYWORDS))
    return ~v.rlike(any_of(FOOD_EXCLUDED_VENUES)) & (by_place | by_text)


def nav_title(title: Column) -> Column:
    return F.trim(_lower(title)).rlike(NAV_TITLE_PATTERN)


def first_rule(text: Column, rules, default: str | None = None) -> Column:
    """Category of the first rule with a keyword in the text."""
    low, out = F.lower(text), None
    for category, words in rules:
        hit = low.rlike(any_of(words))
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    return out.otherwise(F.lit(default).cast("string"))


# Three notions of "free" exist side by side and are kept apart on purpose.

def free_api(cost: Column) -> Column:
    """The read API's notion: an exact spelling of free."""
    return F.coalesce(F.lower(F.trim(cost)).isin(*API_FREE_COSTS), F.lit(False))


def free_strict(cost: Column) -> Column:
    """The pages' notion: says free or zero; an unrecorded cost is not free."""
    return F.coalesce(cost, F.lit("")).rlike(SAYS_FREE)


def fee_shown_free(cost: Column) -> Column:
    """The list filter's notion: nothing recorded, or exactly ``Free``."""
    fee = F.coalesce(cost, F.lit(""))
    return (fee == "") | (fee == "Free")


def fee_shown_paid(cost: Column) -> Column:
    return ~fee_shown_free(cost)
