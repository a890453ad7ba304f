"""Wall-clock arithmetic. Every stored time is local wall clock, ``timestamp_ntz``."""
from __future__ import annotations

from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def as_zone(zone) -> Column:
    return F.lit(zone) if isinstance(zone, str) else zone


def ntz(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz") if not isinstance(value, Column) else value.cast("timestamp_ntz")


def utc_to_wall(utc: Column, zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), as_zone(zone), utc)


def wall_to_utc(wall: Column, zone) -> Column:
    """The instant of a wall clock. In an autumn overlap this is the later one (standard time)."""
    z = as_zone(zone)
    first = F.convert_timezone(z, F.lit("UTC"), wall)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(F.convert_timezone(F.lit("UTC"), z, later) == wall, later).otherwise(first)


def rezone(wall: Column, source_zone, target_zone) -> Column:
    return utc_to_wall(wall_to_utc(wall, source_zone), target_zone)


def epoch_seconds(t: Column) -> Column:
    """Whole seconds of a ``timestamp_ntz`` read as UTC, whatever the session zone."""
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def epoch_micros(t: Column) -> Column:
    return epoch_seconds(t) * 1000000 + F.date_format(t, "SSSSSS").cast("bigint")


def from_epoch_seconds(s: Column) -> Column:
    """UTC wall clock of epoch seconds, whatever the session zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=s)


def on_the_minute(t: Column) -> Column:
    return F.date_trunc("minute", t).cast("timestamp_ntz")


def has_subminute(t: Column) -> Column:
    return t != F.date_trunc("minute", t).cast("timestamp_ntz")


def iso(t: Column) -> Column:
    """ISO 8601 without offset; microseconds only where they are not zero."""
    micros = F.date_format(t, "SSSSSS")
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def has_offset(text: Column) -> Column:
    return text.rlike(_OFFSET)


def offset_minutes(offset: Column) -> Column:
    """Minutes east of UTC of ``Z``, ``+05:30``, ``-0400``, ``-4:00`` or ``-4``."""
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    hours = F.regexp_extract(offset, r"^[+-](\d{1,2}?)(?::?(\d{2}))?$", 1)
    minutes = F.regexp_extract(offset, r"^[+-](\d{1,2}?)(?::?(\d{2}))?$", 2)
    value = sign * (hours.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0)))
    return F.when(offset == "Z", F.lit(0)).otherwise(value)


def parse_iso(text: Column) -> Column:
    """A naive reading of ISO text, whatever offset follows; null when unreadable."""
    body = F.regexp_replace(F.trim(text), _OFFSET, "")
    return body.try_cast("timestamp_ntz")


def local_naive(text: Column, zone: str) -> Column:
    """Text time to local wall clock: an offset is honoured, its absence means local already."""
    naive = parse_iso(text)
    offset = F.regexp_extract(F.trim(text), _OFFSET, 1)
    shifted = naive - F.make_dt_interval(mins=offset_minutes(offset))
    return F.when(has_offset(F.trim(text)), utc_to_wall(shifted, zone)).otherwise(naive)


def iso_with_offset(wall: Column, zone: str) -> Column:
    """``2026-10-06T19:00:00-07:00``: the zone's offset in force at that wall clock; inside a gap, the one after it."""
    instant = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    minutes = ((epoch_seconds(utc_to_wall(instant, zone)) - epoch_seconds(instant)) / 60).cast("int")
    size = F.abs(minutes)
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm"), F.lit(":00"),
                    F.when(minutes < 0, "-").otherwise("+"),
                    F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((size % 60).cast("string"), 2, "0"))


def make_day(y: Column, m: Column, d: Column) -> Column:
    """A date, or null for an impossible one."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                       F.lpad(d.cast("string"), 2, "0"))
    return text.try_cast("date")


def year_for_weekday(month: Column, day: Column, weekday: Column, reference: Column) -> Column:
    """First of the reference year, the next and the last in which that date is that weekday.

    ``weekday`` is 0 for Monday. Null when no nearby year fits.
    """
    y = F.year(reference)
    years = F.array(y, y + 1, y - 1)
    return F.try_element_at(F.filter(years, lambda c: F.weekday(make_day(c, month, day)) == weekday), F.lit(1))


def month_number(name: Column) -> Column:
    key = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), key).cast("int")


def weekday_number(name: Column) -> Column:
    """0 for Monday; null when the text is no weekday."""
    key = F.lower(F.substring(name, 1, 3))
    pos = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), key).cast("int")
    return F.when(pos > 0, pos - 1)


def clock_text(t: Column) -> Column:
    """``7:05 PM``."""
    return F.date_format(t, "h:mm a")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that using it often does not copy it."""
    return F.transform(F.array(value), body)[0]


def zone_resolver(aliases: dict[str, str] | None = None):
    """Arrow kernel: an IANA zone from its name, from the end of a vendor path, or from an alias; else null."""
    known, aliases = available_timezones(), aliases or {}

    def one(name):
        if not name:
            return None
        name = name.strip().strip('"')
        parts = name.split("/")
        for candidate in [name] + (["/".join(parts[-3:]), "/".join(parts[-2:])] if aliases else []):
            if candidate in known:
                return candidate
        return aliases.get(name.lower())

    @F.pandas_udf(T.StringType())
    def kernel(s: pd.Series) -> pd.Series:
        cache = {n: one(n) for n in s.unique()}
        return s.map(cache.get)

    return kernel
