"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the given order; the permutation of [0, n) is a keyed bijection, so shard and slot follow from
(number, n, shards, seed) alone, and :func:`locate` and :func:`row_at` compute them for single rows without touching the data.

Defined cases: an empty table gives an empty table; null order keys come first; rows equal in every order key are interchangeable;
columns named like an output are replaced.
"""
from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import number_rows

ROUNDS = 8


def _sides(n: int) -> tuple[int, int]:
    """Factors a, b with n <= a*b < n + a: fewer than a (about the root of n) numbers fall outside, so walks are rare."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def _mixed(value: Column, i: Column, seed: int) -> Column:
    return F.xxhash64(value, i, F.lit(seed).cast("long"))


def permuted(row: Column, n: int, seed: int) -> Column:
    """The permutation of [0, n), as a native expression."""
    a, b = (F.lit(x).cast("long") for x in _sides(n))
    steps = F.array(*(F.lit(i).cast("long") for i in range(ROUNDS)))

    def feistel(p: Column) -> Column:
        start = F.struct(F.call_function("div", p, b).alias("x"), F.pmod(p, b).alias("y"))

        def step(s: Column, i: Column) -> Column:
            even = F.struct(F.pmod(s["x"] + F.pmod(_mixed(s["y"], i, seed), a), a).alias("x"), s["y"].alias("y"))
            odd = F.struct(s["x"].alias("x"), F.pmod(s["y"] + F.pmod(_mixed(s["x"], i, seed), b), b).alias("y"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        return F.aggregate(steps, start, step, lambda s: s["x"] * b + s["y"])

    total = F.lit(n).cast("long")
    outside = math.prod(_sides(n)) - n
    first = feistel(row)
    if not outside:
        return first
    # a walk visits each outside number at most once, so outside + 1 steps always end inside
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside + 1)), first, lambda p, _: F.when(p < total, p).otherwise(feistel(p)))
    return F.when(first < total, first).otherwise(walk)


def shuffle_to_shards(rows: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """``rows`` with row_number, shard and slot: counts differ by at most one, and slots run from 0 without gaps in each shard."""
    numbered, n = number_rows(rows.drop("row_number", "shard", "slot"), *(F.col(c) for c in order))
    # the permuted position is bound below a projection that uses it twice
    placed = numbered.withColumn("_position", permuted(F.col("row_number"), max(n, 1), seed))
    return (placed.withColumn("shard", F.pmod("_position", F.lit(shards)).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("_position"), F.lit(shards).cast("long"))).drop("_position"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write shuffled rows as one folder per shard, in slot order."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _hash(value: int, i: int, seed: int) -> int:
    h = 42
    for v in (value, i, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    a, b = _sides(n)
    while True:
        x, y = divmod(row, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                x = (x + _hash(y, i, seed) % a) % a
            else:
                y = (y + _hash(x, i, seed) % b) % b
        row = x * b + y
        if row < n:
            return row % shards, row // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that stands at a shard's slot: the inverse walk."""
    a, b = _sides(n)
    at = slot * shards + shard
    while True:
        x, y = divmod(at, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                x = (x - _hash(y, i, seed) % a) % a
            else:
                y = (y - _hash(x, i, seed) % b) % b
        at = x * b + y
        if at < n:
            return at
