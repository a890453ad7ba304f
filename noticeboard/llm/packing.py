"""Pack documents into sequences of bounded length: large-item matching, then best fit.

Pieces above a third of the capacity share a sequence with at most one other such piece: greedy matching pairs each, largest first,
with the largest that still fits. Smaller pieces then go, largest first, where the remaining gap is tightest.

Equal lengths are interchangeable, so the plan is made on the histogram of lengths: its inputs, runs of alike sequences and steps are
bounded by the capacity and not by the corpus. Pieces get their place by their rank, a global row number ordered by length.

Defined cases: null text is empty and packs its end id alone; only documents longer than the capacity are cut; rows with equal
doc_id are separate documents; an empty table gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import number_rows, stored
from .tokens import batches, codec

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# items from..from+count of the length order; ``each`` go to a sequence, one after the other from offset
SEGMENT = ("first", "count", "each", "sequence", "offset", "length")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Encode, append the end id, cut at the capacity; one row per piece with the checksum of its ids."""
    def pieces(frames):
        coder = codec(tokenizer)
        for frame in batches(frames, "text"):
            rows = []
            for doc_id, ids in zip(frame["doc_id"], coder.encode(frame["text"].tolist())):
                ids = np.append(ids, end_id).astype("<u4")
                rows += [(doc_id, i, at, len(p := ids[at:at + capacity]), zlib.crc32(p.tobytes()))
                         for i, at in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(pieces, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Segments that place ``histogram[length]`` items of each length; items are numbered from 0, longest first."""
    left = {k: v for k, v in histogram.items() if v}
    at, start = {}, 0
    for length in sorted(left, reverse=True):
        at[length], start = start, start + left[length]
    out: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)      # gap -> (first sequence, sequences)
    sizes: list[int] = []                                           # gaps in use, ascending
    made = 0

    def put(length: int, n: int, each: int, sequence: int, gap: int) -> None:
        if n:
            out.append((at[length], n, each, sequence, capacity - gap, length))
            at[length] += n
            left[length] -= n

    def open_gap(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((sequence, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for length in reversed(large):
        while n := left[length]:
            i = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while i >= 0 and (not left[large[i]] or large[i] == length and n < 2):
                i -= 1
            mate = large[i] if i >= 0 else None
            k = n if mate is None else n // 2 if mate == length else min(n, left[mate])
            put(length, k, 1, made, capacity)
            if mate is not None:
                put(mate, k, 1, made, capacity - length)
            open_gap(capacity - length - (mate or 0), made, k)
            made += k
        large.pop()
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while n := left[length]:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                each = capacity // length
                gap, sequence, there = capacity, made, -(-n // each)
                made += there
            else:
                gap = sizes[i]
                sequence, there = gaps[gap].pop()
                if not gaps[gap]:
                    del sizes[i]
                each = gap // length
            whole, rest = min(n // each, there), n % each if n // each < there else 0
            put(length, whole * each, each, sequence, gap)
            open_gap(gap - each * length, sequence, whole)
            if rest:
                put(length, rest, rest, sequence + whole, gap)
                open_gap(gap - rest * length, sequence + whole, 1)
            used = whole + (rest > 0)
            open_gap(gap, sequence + used, there - used)
    return sorted(out)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    ranked, _ = number_rows(pieces, F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), name="rank")
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}       # at most ``capacity`` rows
    segments = np.array(plan(histogram, capacity) or [(0,) * len(SEGMENT)], "int64")

    def placed(frames):
        for frame in frames:
            rank = frame.pop("rank").to_numpy()
            s = segments[np.searchsorted(segments[:, 0], rank, side="right") - 1]
            nth = rank - s[:, 0]
            yield frame.assign(sequence_id=s[:, 3] + nth // s[:, 2], offset=s[:, 4] + nth % s[:, 2] * s[:, 5])

    return ranked.select(*pieces.columns, "rank").mapInPandas(placed, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    # ranging samples its input first: stored pieces are encoded once
    return place(stored(cut_pieces(docs, tokenizer, capacity, end_id)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves, ``sequence_id, ids``: the ids of each piece cut again and joined in order of offset.

    A sequence holds at most ``capacity`` ids, which bounds what is gathered. ``doc_id`` must be unique here.
    """
    spans = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("spans"))

    def cut(frames):
        coder = codec(tokenizer)
        for frame in batches(frames, "text"):
            rows = []
            for spans, ids in zip(frame["spans"], coder.encode(frame["text"].tolist())):
                ids = np.append(ids, end_id).astype("int32")
                rows += [(s["sequence_id"], s["offset"], ids[s["start"]:s["start"] + s["length"]].tolist()) for s in spans]
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "part"])

    parts = docs.select("doc_id", "text").join(spans, "doc_id").mapInPandas(cut, "sequence_id long, offset long, part array<int>")
    joined = F.array_sort(F.collect_list(F.struct("offset", "part")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(joined, lambda x: x["part"])).alias("ids"))
