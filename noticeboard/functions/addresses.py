"""Address text to parts, and parts to text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null
from .times import let

# --- fixed values ----------------------------------------------------------
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming"}
COUNTRY_WORDS = ("usa", "us", "united states", "united states of america")
TAIL = r"^(?:(.*?)\s+)?([A-Z]{2})(?:\s+(\d{5})(?:-\d{4})?)?$"
# ---------------------------------------------------------------------------


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def _without_country(parts: Column, words=COUNTRY_WORDS) -> Column:
    last = F.try_element_at(parts, F.lit(-1))
    drop = F.coalesce(F.lower(last).isin(*words), F.lit(False))
    return F.when(drop, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _head(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(n, F.lit(0)))


def us_tail(parts: Column) -> Column:
    """Split a trailing ``City ST ZIP`` off the parts: struct(rest, city, state, zip); state null when there is none."""
    last = F.try_element_at(parts, F.lit(-1))
    found = (F.size(parts) > 1) & F.coalesce(last.rlike(TAIL), F.lit(False))
    own = blank_to_null(F.regexp_extract(last, TAIL, 1))
    n = F.size(parts)
    city = F.when(own.isNotNull(), own).otherwise(F.try_element_at(parts, F.lit(-2)))
    rest = F.when(own.isNotNull(), _head(parts, n - 1)).otherwise(_head(parts, n - 2))
    return F.when(found, F.struct(rest.alias("rest"), city.alias("city"), F.regexp_extract(last, TAIL, 2).alias("state"),
                                  blank_to_null(F.regexp_extract(last, TAIL, 3)).alias("zip"))) \
        .otherwise(F.struct(parts.alias("rest"), F.lit(None).cast("string").alias("city"),
                            F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("zip")))


def split_postal(text: Column) -> Column:
    """``5 Some St, Town, ST 02138`` to struct(street, city, state, zip); without a tail it is all street."""
    none = F.lit(None).cast("string")

    def parted(tail):
        return F.when(tail["state"].isNotNull(),
                      F.struct(blank_to_null(F.array_join(tail["rest"], ", ")).alias("street"), tail["city"].alias("city"),
                               tail["state"].alias("state"), tail["zip"].alias("zip"))) \
            .otherwise(F.struct(blank_to_null(text).alias("street"), none.alias("city"), none.alias("state"), none.alias("zip")))

    return let(_parts(text), lambda p: let(_without_country(p, ("usa", "us", "united states")), lambda q: let(us_tail(q), parted)))


def split_location(text: Column) -> Column:
    """A calendar LOCATION to struct(name, street, city, state, zip)."""
    joined = lambda a: blank_to_null(F.array_join(a, ", "))

    def parted(tail):
        def placed(rest):
            digit = lambda i: F.coalesce(F.try_element_at(rest, F.lit(i)).rlike(r"^\d"), F.lit(False))
            after = F.when(F.size(rest) > 1, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
            head = F.try_element_at(rest, F.lit(1))
            name = F.when(digit(1), F.lit(None)).when((F.size(rest) == 1) | digit(2), head).otherwise(joined(rest))
            street = F.when(digit(1), joined(rest)).when(digit(2), joined(after))
            return F.struct(F.substring(name, 1, 150).alias("name"), F.substring(street, 1, 200).alias("street"),
                            F.substring(tail["city"], 1, 50).alias("city"), tail["state"].alias("state"), tail["zip"].alias("zip"))
        return let(tail["rest"], placed)

    return let(_parts(text), lambda p: let(_without_country(p), lambda q: let(us_tail(q), parted)))


def split_submitted(text: Column) -> Column:
    """A reader's address to struct(name, street): ``Venue (street)``, ``Venue, street``, a bare street, or a bare name."""
    t = F.trim(F.coalesce(text, F.lit("")))
    paren = r"^(.+?)\s*\(([^)]+)\)\s*$"
    raw = F.transform(F.split(t, ","), lambda p: F.trim(p))
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("name"), b.alias("street"))
    return (F.when(t == "", pair(none, none))
            .when(t.rlike(paren), pair(F.trim(F.regexp_extract(t, paren, 1)), F.trim(F.regexp_extract(t, paren, 2))))
            .when((F.size(raw) >= 2) & (raw[0] != "") & ~raw[0].rlike(r"^\d"),
                  pair(raw[0], F.array_join(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(1))), ", ")))
            .when(t.rlike(r"^\d"), pair(none, t)).otherwise(pair(t, none)))


def street_only(address: Column, city: Column, state: str) -> Column:
    """The street line of an address: parts that repeat city, state, country or ZIP are dropped."""
    words = [w.lower() for w in (state, STATE_NAMES.get((state or "").upper())) if w]
    own_city = F.lower(F.coalesce(city, F.lit("")))

    def kept(part):
        low = F.lower(part)
        zip_tail = F.regexp_extract(low, r"^(.+?)\s+\d{5}(-\d{4})?$", 1)
        return ~((own_city != "") & (low == own_city)) & ~low.isin(*words) & ~low.rlike(r"^(usa?|united states)$") \
            & ~part.rlike(r"^\d{5}(-\d{4})?$") & ~zip_tail.isin(*words)

    return F.array_join(F.filter(_parts(address), kept), ", ")


def location_line(venue: Column, address: Column, city: Column, state: Column, home_state: str) -> Column:
    """Venue, street, city, state without repeats, ignoring case, in order."""
    parts = F.filter(F.array(venue, street_only(address, city, home_state), city, state), lambda p: p.isNotNull() & (p != ""))
    seen = F.aggregate(parts, F.array().cast("array<string>"),
                       lambda acc, p: F.when(F.exists(acc, lambda s: F.lower(s) == F.lower(p)), acc).otherwise(F.array_append(acc, p)))
    return F.array_join(seen, ", ")
