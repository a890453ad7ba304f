"""Mix sources to target weights: tokens per source, repetition rates, then floor(rate) copies of each document plus one hash-seeded
Bernoulli copy whose probability is the fraction of the rate.

Targets share ``total_share`` of all tokens by weight; a target stops at ``max_epochs`` times its source's size, and what it leaves is
shared anew by weight among the others until none is above its bound. That fixed point is target = min(max_epochs * size, level * weight).

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources without tokens get target 0 and no
copies; rows with equal doc_id share their draw; an empty table gives an empty table; columns named like an output are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import number_rows, stored, word_count

BROADCAST_ROWS = 100_000          # a source row is some tens of bytes


def source_targets(sizes: DataFrame, weights: tuple[int, ...], total_percent: int, max_epochs: int) -> DataFrame:
    """``source, source_size, target`` of ``sizes(source, size)``; weights repeat over the sources in code-point order, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, _ = number_rows(totals, F.col("source").asc_nulls_last(), name="source_rank")
    turn = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = stored(ranked.withColumn("weight", F.element_at(turn, (F.col("source_rank") % len(weights) + 1).cast("int"))))
    everything = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    bound, level, capped = F.col("source_size") * max_epochs, 0.0, -1
    # each round binds at least one more source, or ends; only three sums come back
    while True:
        above = F.col("weight") * F.lit(level) >= bound
        n, full, free = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, bound)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total_percent * everything - 100 * int(full or 0)) / (100 * int(free)), n
    target = F.when(F.col("weight") * F.lit(level) >= bound, bound.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone: the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_copies(docs: DataFrame, weights: tuple[int, ...], total_percent: int = 150, max_epochs: int = 2, seed: int = 9,
               size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies, the number of times the mix takes the document."""
    named = docs.drop("source_size", "target", "copies")
    sized = named.withColumn("size", word_count(F.col("text")) if size is None else size)
    targets = source_targets(sized.select("source", "size"), weights, total_percent, max_epochs)
    targets = targets.withColumnRenamed("source", "_source")
    few = targets.count() <= BROADCAST_ROWS           # beyond it a shuffle join, whose hot source AQE splits
    out = sized.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("copies", (whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("int"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with ``copy`` from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
