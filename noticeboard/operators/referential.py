"""Referential checks: constraints as pairs of key sets, their violations as rows with evidence.

A constraint says that every key of one frame stands in another. Keys are folded to distinct values with a count and a first example before they
meet, so a hot key is one row, and what comes out is the keys that are missing, never the rows behind them.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import CATEGORIES, STATUSES


@dataclass(frozen=True)
class Constraint:
    """``rule``: every value of ``key`` in ``child`` is a value of the one column of ``parent``; ``example`` and ``order`` pick the evidence."""
    rule: str
    child: DataFrame
    key: Column
    parent: DataFrame
    example: Column
    order: Column


def violations(constraints: list[Constraint]) -> DataFrame:
    """``rule, subject, rows, example`` of every key that its parent lacks; a null key refers to nothing and is fine."""
    def missing(c: Constraint) -> DataFrame:
        keys = c.child.select(c.key.cast("string").alias("subject"), c.example.cast("string").alias("example"), c.order.alias("_o")).filter("subject IS NOT NULL")
        keys = keys.groupBy("subject").agg(F.count(F.lit(1)).alias("rows"), F.min_by("example", "_o").alias("example"))
        known = c.parent.select(F.col(c.parent.columns[0]).cast("string").alias("subject")).distinct()
        return keys.join(known, "subject", "left_anti").select(F.lit(c.rule).alias("rule"), "subject", "rows", "example")

    return reduce(DataFrame.unionByName, [missing(c) for c in constraints])


def values(spark: SparkSession, words) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def listing_constraints(listings: DataFrame, registry: DataFrame, monitored: DataFrame, adapters) -> list[Constraint]:
    """What the published table and the registry owe each other.

    Names that listings carry are registered, scraped sources are watched, categories and states are of the vocabulary, every scraped source's
    platform has a job, and a retired source has no rows left.
    """
    spark = listings.sparkSession
    scraped = registry.filter("is_scraped")
    row = dict(example=F.col("id"), order=F.col("arrival_ix"))
    source = dict(example=F.col("url"), order=F.col("name"))
    return [Constraint("unregistered_source", listings, F.col("source_name"), registry.select("name"), **row),
            Constraint("unmonitored_source", scraped, F.col("name"), monitored, **source),
            Constraint("unknown_category", listings, F.col("category"), values(spark, CATEGORIES), **row),
            Constraint("unknown_status", registry, F.col("status"), values(spark, STATUSES), **source),
            Constraint("unknown_adapter", scraped, F.col("adapter"), values(spark, adapters), **source),
            Constraint("retired_source_published", listings, F.col("source_name"), registry.filter("status <> 'retired'").select("name").union(
                listings.select("source_name").join(registry.select(F.col("name").alias("source_name")), "source_name", "left_anti").distinct()), **row)]
