"""Relevance: what a listing is, times how soon it is."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import free_api
from .times import epoch_micros, ntz

# --- fixed values ----------------------------------------------------------
CATEGORY_WEIGHTS = {"music": 1.2, "theater": 1.1, "arts and culture": 1.1, "food and drink": 1.0,
                    "sports": 1.0, "lectures": 0.9, "community": 0.9, "other": 0.8}
FREE_FACTOR, FEATURED_FACTOR = 1.1, 1.5
# ---------------------------------------------------------------------------


def all_day_still_on(start: Column, end: Column, all_day: Column, as_of) -> Column:
    last = F.to_date(F.coalesce(end, start))
    return F.coalesce(all_day, F.lit(False)) & (last >= F.to_date(ntz(as_of)))


def upcoming(start: Column, end: Column, all_day: Column, as_of) -> Column:
    return (start >= ntz(as_of)) | all_day_still_on(start, end, all_day, as_of)


def content_score(category: Column, cost: Column, featured: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
    base = F.coalesce(F.try_element_at(weights, category), F.lit(1.0))
    free = F.when(free_api(cost), F.lit(FREE_FACTOR)).otherwise(F.lit(1.0))
    pick = F.when(F.coalesce(featured, F.lit(False)), F.lit(FEATURED_FACTOR)).otherwise(F.lit(1.0))
    return base * free * pick


def temporal_boost(start: Column, end: Column, all_day: Column, as_of) -> Column:
    """Five for now, tapering to one a month out; a run under way is neutral, the past is near nothing."""
    now = ntz(as_of)
    seconds = (epoch_micros(start) - epoch_micros(now)) / F.lit(1000000)
    days = seconds / F.lit(3600.0) / F.lit(24.0)
    return (F.when(all_day_still_on(start, end, all_day, as_of) & (start < now), F.lit(1.0))
            .when(days <= 0, F.lit(0.1))
            .when(days > 30, F.lit(1.0))
            .when(days <= 7, F.least(F.lit(2.0) + F.lit(3.0) / (days + 1), F.lit(5.0)))
            .otherwise(F.greatest(F.lit(1.0), F.lit(2.4) - F.lit(1.4) * (days - 7) / F.lit(23.0))))


def relevance(as_of) -> Column:
    c = F.col
    return (content_score(c("category"), c("cost"), c("featured"))
            * temporal_boost(c("start_datetime"), c("end_datetime"), c("all_day"), as_of))


__all__ = ["all_day_still_on", "upcoming", "content_score", "temporal_boost", "relevance"]
