"""Completeness and refusal checks over captures, and the page image pick."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.markup import card_fields, first_attr
from ...functions.text import image_link, plausible_image

# --- fixed values ----------------------------------------------------------
CHALLENGE_TITLES = ("just a moment", "performing security verification", "attention required", "access denied",
                    "verifying you are human", "please wait while we verify", "ddos-guard")
BLOCKED_STATUSES = (401, 403, 429)
# ---------------------------------------------------------------------------


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def challenged(status: Column, html: Column) -> Column:
    """A refusal, or a bot check posing as a page."""
    return F.coalesce(status.isin(*BLOCKED_STATUSES), F.lit(False)) | F.lower(page_title(html)).rlike("|".join(CHALLENGE_TITLES))


def completeness(pages: DataFrame) -> DataFrame:
    """Announced against captured pages per source. ``pages(source_name, page, total_pages)``; folded per page first."""
    seen = pages.groupBy("source_name", "page").agg(F.max("total_pages").alias("total"))
    return (seen.groupBy("source_name").agg(F.max("total").alias("announced"), F.count(F.lit(1)).alias("captured"))
            .withColumn("pages_missing", F.greatest(F.col("announced") - F.col("captured"), F.lit(0)).cast("bigint")))


def before_repeat(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the pages before the first one that adds no new key. ``rows`` has ``source_name, seq``.

    First sightings are a minimum per key; the stop is a minimum over pages.
    """
    first = rows.groupBy("source_name", *keys).agg(F.min("seq").alias("seq"))
    adding = first.select("source_name", "seq").distinct().withColumn("adds", F.lit(True))
    pages = rows.select("source_name", "seq").distinct()
    stops = pages.join(adding, ["source_name", "seq"], "left").filter("adds IS NULL").groupBy("source_name").agg(F.min("seq").alias("stop"))
    return rows.join(stops, "source_name", "left").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")


def source_outcomes(captures: DataFrame, candidates: DataFrame, malformed: DataFrame | None = None, cut: DataFrame | None = None) -> DataFrame:
    """Per source: ``failed`` with no rows and a refused response, else ``ok``; rows despite refusals are kept.

    ``malformed(source_name, responses)`` names sources with responses that are not what their platform promises: failed, whatever else came.
    ``cut`` has the completeness of sources whose announced pages were not all read: their rows stay, the error says how many are missing.
    """
    refused = captures.groupBy("source_name").agg(F.count_if(F.col("status") >= 400).alias("refused"), F.min(F.when(F.col("status") >= 400, F.struct("seq", "status", "url"))).alias("first"))
    rows = candidates.groupBy("source_name").agg(F.count(F.lit(1)).alias("returned"))
    out = refused.join(rows, "source_name", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    bad = (F.col("returned") == 0) & (F.col("refused") > 0)
    told = F.when(bad, F.concat(F.lit("0 rows after HTTP "), F.col("first.status").cast("string"), F.lit(" from "), F.col("first.url")))
    if malformed is not None:
        out = out.join(malformed, "source_name", "left")
        told = F.when(F.col("responses") > 0, F.concat(F.col("responses").cast("string"), F.lit(" malformed responses"))).otherwise(told)
        bad = bad | (F.coalesce("responses", F.lit(0)) > 0)
    if cut is not None:
        out = out.join(cut.select("source_name", "announced", "captured"), "source_name", "left")
        told = F.coalesce(told, F.when(F.col("announced").isNotNull(), F.format_string("read %d of %d announced pages", "captured", "announced")))
    return out.select(F.col("source_name").alias("source"), F.when(bad, "failed").otherwise("ok").alias("status"), "returned", told.alias("error"))


def page_images(pages: DataFrame) -> DataFrame:
    """The best image of each page, absolute: social tags first, then the main part's, then the first plausible of ten."""
    got = pages.withColumn("c", card_fields(F.col("html"), None, {
        "og": "meta[property=og:image]", "tw": "meta[name=twitter:image]", "main": "main img[src], article img[src]", "any": "img[src]"})[0])
    f = lambda n: F.col("c")[n]
    src = lambda e: F.try_element_at(e["attrs"], F.lit("src"))
    main = F.try_element_at(f("main"), F.lit(1))
    some = F.filter(F.slice(f("any"), 1, 10), lambda e: plausible_image(src(e)))
    pick = F.coalesce(F.nullif(first_attr(f("og"), "content"), F.lit("")), F.nullif(first_attr(f("tw"), "content"), F.lit("")),
                      F.when(plausible_image(src(main)), src(main)), src(F.try_element_at(some, F.lit(1))))
    return got.select("page_id", image_link(F.col("url"), pick).alias("image_url"))
