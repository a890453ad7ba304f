"""Pieces every extraction job shares."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...schema import CANDIDATE, conform
from ...session import settled
from ..dedup import first_wins

MIN_DESCRIPTION = 20


def responses(captures: DataFrame, registry: DataFrame, adapter: str) -> DataFrame:
    """A platform's good responses with their registry record as ``reg`` and the run position ``run_ix``.

    Captures stored by platform carry ``adapter`` as a partition: only the platform's own files are read.
    Spark decides by the registry's size at run time whether it is broadcast.
    """
    if "adapter" in captures.columns:
        captures = captures.filter(F.col("adapter") == adapter).drop("adapter")
    return with_registry(captures.filter((F.col("status") < 400) & F.col("body").isNotNull()), registry, adapter)


def with_registry(rows: DataFrame, registry: DataFrame, adapter: str) -> DataFrame:
    """Rows of a platform's sources with their record ``reg`` and run position ``run_ix``."""
    order = Window.orderBy("rank", "slug", "name")
    known = registry.withColumn("run_ix", F.row_number().over(order).cast("bigint")).filter(F.col("adapter") == adapter)
    side = known.select(F.col("name").alias("source_name"), F.struct("url", "venue", "params").alias("reg"), "run_ix")
    return rows.join(side, "source_name")


def param(name: str, default: str | None = None) -> Column:
    value = F.try_element_at("reg.params", F.lit(name))
    return value if default is None else F.coalesce(value, F.lit(default))


def arrival(position: Column) -> Column:
    """Source run order, then response, then place in the payload, as one sortable number."""
    return F.col("run_ix") * F.lit(1 << 44) + F.col("seq").cast("bigint") * F.lit(1 << 24) + position.cast("bigint")


def nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def place(name, street, city, zip_code=None, state=None, venue: Column | None = None) -> dict[str, Column]:
    """The row's own place, or, when it names none at all, the registry's venue."""
    none = F.lit(None).cast("string")
    name, street, city = (none if c is None else nonblank(c) for c in (name, street, city))
    own = name.isNotNull() | street.isNotNull() | city.isNotNull()
    v = F.col("reg.venue") if venue is None else venue
    pick = lambda c, d: nonblank(F.coalesce(c, F.when(~own, d)))
    return {"venue_name": pick(name, v["name"]), "street_address": pick(street, v["street"]), "city": pick(city, v["city"]),
            "zip_code": pick(none if zip_code is None else nonblank(zip_code), v["zip"]),
            "state": F.when(own, state) if state is not None else none}


def described(text: Column, title: Column, venue: Column) -> Column:
    """The text, or a plain sentence when it says too little."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= MIN_DESCRIPTION, text).otherwise(
        F.concat(title, F.lit(" at "), F.coalesce(venue, F.col("source_name")), F.lit(".")))


def finish(df: DataFrame, keys: list[str]) -> DataFrame:
    """Truncate, drop an end not after its start, keep the first of repeats, and conform."""
    df = (settled(df).filter(F.col("start_datetime").isNotNull())
          .withColumn("title", F.substring("title", 1, 200)).withColumn("description", F.substring("description", 1, 2000)))
    if "end_datetime" in df.columns:
        df = df.withColumn("end_datetime", F.when(F.col("end_datetime") > F.col("start_datetime"), F.col("end_datetime")))
    keyed = df.withColumn("_lt", F.lower("title"))
    return conform(first_wins(keyed, ["source_name", *keys]), CANDIDATE)


def agree(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Keep rows whose two statements of the start agree; also the disagreements per source."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    counts = df.groupBy("source_name").agg(F.count_if(~same).alias("disagreements"), F.count(F.lit(1)).alias("rows"))
    return df.filter(same), counts
