"""Snapshots that are compared without moving them: bucketed tables, row hashes, and parts whose hashes agree left unread.

A snapshot is stored in parts (by a hash of the id) and, inside, in buckets sorted by id, with one hash over the columns that count as a change. Two
snapshots laid out alike join bucket by bucket, without a shuffle. A small summary holds the number of rows and the sum of row hashes of every part:
parts that agree in both are equal and are not opened.

Rows without an id are left out and the last of several rows with one id counts, as in ``publish.diff_snapshots``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TRACKED_FIELDS, missing
from ..session import scratch_folder

PARTS, BUCKETS = 16, 32
_KEPT = ("title", "source_name", *(c for c in TRACKED_FIELDS if c != "title"))


def row_hash(columns=TRACKED_FIELDS) -> Column:
    """128 bits over the tracked columns; null and the empty string differ."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}).cast("binary"))


class Snapshot:
    """A stored snapshot: its bucketed table and the summary of its parts."""

    def __init__(self, table: DataFrame, summary: DataFrame, parts: int, buckets: int):
        self.table, self.summary, self.parts, self.buckets = table, summary, parts, buckets


def store(listings: DataFrame, name: str | None = None, path: str | None = None, parts: int = PARTS, buckets: int = BUCKETS) -> Snapshot:
    """Store ``listings`` as a snapshot; one shuffle by id. ``name`` is the table's, a new one by default."""
    spark = listings.sparkSession
    path, name = path or scratch_folder(spark), name or f"snapshot_{uuid.uuid4().hex}"
    last = (listings.filter(~missing(F.col("id"))).groupBy("id").agg(F.max_by(F.struct(*_KEPT), "arrival_ix").alias("r")).select("id", "r.*"))
    rows = last.withColumn("hash", row_hash()).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    (rows.repartition(buckets, "id").write.option("path", f"{path}/rows").partitionBy("part").bucketBy(buckets, "id").sortBy("id").format("parquet").saveAsTable(name))
    table = spark.table(name)
    # a decimal cannot overflow: the sum stays the same in any order
    table.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("id", "hash").cast("decimal(38,0)")).alias("sum")).write.parquet(f"{path}/summary")
    return Snapshot(table, spark.read.parquet(f"{path}/summary"), parts, buckets)


def changed_parts(before: Snapshot, after: Snapshot) -> list[int]:
    """Numbers of the parts that differ; ``parts`` of them at most."""
    both = before.summary.alias("a").join(after.summary.alias("b"), "part", "full")
    same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.sum").eqNullSafe(F.col("b.sum"))
    return sorted(r["part"] for r in both.filter(~same).select("part").collect())


def diff(before: Snapshot, after: Snapshot) -> DataFrame:
    """``id, change, title, source_name, fields`` of every id that was added, removed or changed."""
    if (before.parts, before.buckets) != (after.parts, after.buckets):
        raise ValueError("snapshots of different layouts: store both with the same parts and buckets")
    parts = changed_parts(before, after)
    side = lambda s, n: s.table.filter(F.col("part").isin(parts)).select("id", F.struct(*_KEPT).alias(n), F.col("hash").alias(f"hash_{n}"))
    both = side(before, "a").join(side(after, "b").hint("merge"), "id", "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    fields = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in TRACKED_FIELDS]), lambda x: x.isNotNull())
    change = F.when(F.col("hash_a").isNull(), "added").when(F.col("hash_b").isNull(), "removed").otherwise("changed")
    return both.select("id", change.alias("change"), F.coalesce("b.title", "a.title").alias("title"), F.coalesce("b.source_name", "a.source_name").alias("source_name"),
                       F.when(change == "changed", fields).alias("fields"))


def unchanged(before: Snapshot, after: Snapshot, found: DataFrame) -> DataFrame:
    """One row: how many ids both have alike, from the summaries and ``found`` (their difference) alone."""
    rows = after.summary.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    other = found.agg(F.count(F.when(F.col("change").isin("added", "changed"), 1)).alias("d"))
    return rows.join(other).select((F.col("n") - F.col("d")).cast("bigint").alias("unchanged"))      # one-row frames
