"""Helpers that several training-data operators share: stored intermediates, global row numbers, connected components."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

WORD_GAP = "[\\x20\\x09-\\x0D]+"          # words are the runs of anything else
_SLOT = (1 << 33) - 1                     # monotonically_increasing_id keeps the place in a partition in the low 33 bits


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null and for blank text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def settled_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """``df.where(condition)`` on columns as they stand: the row mark keeps the optimiser from pushing the condition below them, where
    it would repeat costly expressions once for every use of a column."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("_mark", F.monotonically_increasing_id()).where(condition & (F.col("_mark") >= 0)).drop("_mark")


def number_rows(df: DataFrame, *order: Column, name: str = "row_number") -> tuple[DataFrame, int]:
    """Number rows from 0 in ``order`` over all partitions; returns the frame and the number of rows.

    Rows are range-partitioned and sorted, stored once, and each partition's base is the prefix sum of the counts before it,
    so no task sees more than its range. Rows that are equal in ``order`` are interchangeable. Give it narrow rows.
    """
    at, part, base = (f"_{name}_{x}" for x in ("at", "part", "base"))
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    # one row per partition: bounded by the number of tasks, not by the number of rows
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    numbered = placed.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(at).bitwiseAND(F.lit(_SLOT)))
    return numbered.drop(at, part, base), placed.count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: ``node, root`` with the smallest node of the component as root.

    Alternates large-star and small-star steps; every step is a pre-aggregated minimum per node joined back to the edges, so a hub
    with any number of neighbours is never gathered. Stops when a round leaves the edges as they were. Nulls and loops are ignored.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        cur = stored(small.where("a <> b").distinct())
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b"), F.col("b")).distinct())


def might_contain(keys: DataFrame, column: Column, bits: int = 1 << 23) -> Column:
    """True for every value of ``column`` among the one long column of ``keys``, and for few others: a bitmap of fixed size.

    It thins what a join would shuffle. The exact join must follow: where keys outgrow the bitmap it lets more through, never less.
    """
    name, words = keys.columns[0], bits // 64
    at = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
    part = keys.select(F.call_function("div", at, F.lit(64)).cast("int").alias("w"), (at % 64).cast("int").alias("b"))
    part = part.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v"))
    whole = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(part, "w", "left")
    row = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))), lambda s: s["v"]).alias("bitmap"))
    mine = F.pmod(F.xxhash64(column), F.lit(bits))
    word = F.get(stored(row).scalar(), F.call_function("div", mine, F.lit(64)).cast("int"))
    return F.call_function("shiftrightunsigned", word, (mine % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
