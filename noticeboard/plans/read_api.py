"""The read endpoints as compositions of filters, orders and projections."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import serve


def events(listings: DataFrame, as_of, *, ranked=False, descending=False, limit=1000, offset=0, **filters) -> DataFrame:
    rows = serve.filter_listings(listings, as_of, **filters)
    return serve.page(serve.ranked(rows, as_of) if ranked else serve.by_date(rows, descending), limit, offset)


def events_slim(listings: DataFrame, as_of, *, ranked=True, upcoming_only=True, limit=1000, offset=0, **filters) -> DataFrame:
    rows = serve.filter_listings(listings, as_of, upcoming_only=upcoming_only, **filters)
    return serve.slim(serve.page(serve.ranked(rows, as_of) if ranked else serve.by_date(rows), limit, offset))


def with_picks(listings: DataFrame, picks: DataFrame) -> DataFrame:
    return serve.flag_picks(listings, picks)
