"""Extraction jobs: captures and registry in, candidates out.

A job parses each response once, explodes it to listing rows and decides
everything natively. Two statements of a start must agree or the row is dropped:
a date is never guessed.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ...session import keep
from ...settings import DEFAULT, Settings


def jobs():
    """Platform name to job. Extend by adding an entry."""
    from . import html_pages, ical, json_feeds, jsonld
    return {"tribe": json_feeds.tribe, "squarespace": json_feeds.squarespace, "localist": json_feeds.localist,
            "ical": ical.ical, "jsonld": jsonld.jsonld, "eventon": html_pages.eventon, "assabet": html_pages.assabet,
            "drupal_listing": html_pages.drupal_listing, "indiecommerce": html_pages.indiecommerce}


def extract_all(captures: DataFrame, registry: DataFrame, settings: Settings = DEFAULT, as_of=None) -> DataFrame:
    """Candidates of every platform the registry can name. Text listings, which need a day to read dates by, join in with ``as_of``.

    Captures are read by platform (see ``sources.captures.by_platform``), so each body is parsed by its own job alone.

    ``arrival_ix`` numbers the result from zero: run order, response, place in the payload, then the occurrence of a series. So every
    occurrence is a row of its own for what follows.
    """
    from ...sources.captures import by_platform
    from ..normalise import number_rows
    from .text_listing import text_listing
    captures = by_platform(captures, registry)
    # only what the registry names is planned: as many names as there are jobs, at most
    named = {r["adapter"] for r in registry.filter(F.col("adapter").isin(*jobs(), "custom")).select("adapter").distinct().collect()}
    wanted = [job for name, job in jobs().items() if name in named] or [jobs()["tribe"]]
    found = [job(captures, registry, settings) for job in wanted]
    if as_of is not None and "custom" in named:
        found.append(text_listing(captures, registry, as_of, settings))
    # ranging samples its input first: stored rows are extracted once
    placed = keep(reduce(DataFrame.unionByName, found))
    columns = placed.columns
    placed = placed.withColumn("_order", F.struct("arrival_ix", "start_datetime", "title", "source_url"))
    return number_rows(placed, "_order").withColumn("arrival_ix", F.col("n").cast("bigint")).select(*columns)
