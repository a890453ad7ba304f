"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

Each word shingle is hashed once. The hash says which of ``SLOTS`` bins it falls in; a bin keeps its smallest hash. An empty bin borrows from a
bin that a universal hash of (bin, attempt) names, trying until it meets a full one, so that any slot of two signatures is equal with a
probability equal to the sets' Jaccard similarity. ``BANDS`` runs of ``ROWS`` slots are the buckets.

* Documents with equal sets are one class and travel once, so copies make no candidates.
* In a bucket every class is a candidate with one hub, its smallest class: a star, never all pairs. Hubs are the smallest by one global number,
  so a group of near copies has the same few hubs in all its buckets.
* Links are confirmed on the full sets. Where a bucket is then left in several components, the classes outside its largest component are
  compared with those of other components, inside the join. So no link between two classes that share a bucket is lost, what is already
  connected is not compared again, and no pairs but links come out of it.
* A pair at similarity 0.85 shares no bucket with probability (1 - 0.85 ** ROWS) ** BANDS, under one in 100,000.

Defined cases: null or blank text has the empty set and links with nothing; fewer words than ``width`` make one shingle of all words; rows with null or
repeated doc_id are documents of their own, and a component's id is its smallest doc_id that is not null; an empty table gives an empty
table; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, might_contain, stored
from .ngram_join import forget_words, ngrams
from .tokens import batches

ROWS, BANDS = 9, 45
SLOTS = ROWS * BANDS
ATTEMPTS = 4096                   # beyond them an empty bin borrows from the next full one: with two full bins under one in 10**8 bins gets there
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _donors() -> np.ndarray:
    """donors[attempt, bin]: where an empty bin looks; the same for every document."""
    with np.errstate(over="ignore"):
        seed = np.arange(ATTEMPTS * SLOTS, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(13)
        return (_mixed(seed) % np.uint64(SLOTS)).astype("int16").reshape(ATTEMPTS, SLOTS)


_DONORS: list[np.ndarray] = []
_BAND_MULT = np.arange(1, 2 * ROWS, 2, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """The densified signature of a set of at least one hash, given in ascending order."""
    if not _DONORS:
        _DONORS.append(_donors())
    donors = _DONORS[0]
    bins = ((grams >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype("int64")
    first = np.concatenate(([True], bins[1:] != bins[:-1]))                    # ascending hashes: the first in a bin is its smallest
    own = np.full(SLOTS, _EMPTY)
    own[bins[first]] = grams[first]
    full = np.zeros(SLOTS, bool)
    full[bins] = True
    out, todo, at, step = own.copy(), np.flatnonzero(~full), 0, 8
    if int(first.sum()) == 1:
        out[:] = grams[0]
        return out
    while len(todo) and at < ATTEMPTS:
        names = donors[at:at + step][:, todo]
        met = full[names]
        found = met.any(axis=0)
        out[todo[found]] = own[names[met.argmax(axis=0), np.arange(len(todo))][found]]
        todo, at, step = todo[~found], at + step, min(2 * step, 256)
    if len(todo):
        there = np.flatnonzero(full)
        out[todo] = own[there[np.searchsorted(there, todo) % len(there)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its slots and its number mixed."""
    with np.errstate(over="ignore"):
        keys = (_mixed(sig.reshape(BANDS, ROWS)) * _BAND_MULT).sum(axis=1, dtype="uint64")
        return _mixed(keys + np.arange(BANDS, dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)).view("int64")


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, rows, classes): documents with their text hash, their sets' identity, and one row per distinct set with its band keys."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def signed(frames):
        for frame in batches(frames, "text"):
            rows = []
            for doc_id, text_hash, text in zip(frame["doc_id"].astype("Int64"), frame["text_hash"], frame["text"]):
                grams = ngrams(text, width)
                rows.append((doc_id, text_hash, len(grams), xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None, band_keys(signature(grams)) if len(grams) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "n", "set_hash", "bands"]).astype({"doc_id": "Int64"})
        forget_words()

    rows = stored(texts.select("doc_id", "text_hash", "text").mapInPandas(signed, "doc_id long, text_hash long, n int, set_hash binary, bands array<long>"))
    # equal sets have equal bands, so any row's do; a class is named by a hash of its set, the same in every run
    grouped = rows.where("n > 0").groupBy("set_hash", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"))
    return texts, rows.drop("bands"), stored(grouped.withColumn("node", F.xxhash64("set_hash")))


def _sets(nodes: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``node, grams``: the full sets of the stored ``nodes(node)``, made again from the texts, once a class."""
    wanted = stored(classes.join(nodes, "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash")))
    some = texts.where(might_contain(wanted.select("_hash"), F.col("text_hash")))
    found = some.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).dropDuplicates(["node"])

    def shingled(frames):
        for frame in batches(frames, "text"):
            yield pd.DataFrame({"node": frame["node"], "grams": [ngrams(t, width).view("int64") for t in frame["text"]]})
        forget_words()

    return stored(found.select("node", "text").mapInPandas(shingled, "node long, grams array<long>"))


def _reach(x: str, y: str, num: int, den: int) -> Column:
    """Whether two full sets reach the threshold; sizes settle most pairs before any set is met with another."""
    m, n = F.size(x).cast("long"), F.size(y).cast("long")
    return (F.least(m, n) * den >= F.greatest(m, n) * num) & (F.size(F.array_intersect(x, y)) * (num + den) >= (m + n) * num)


def confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` of classes whose full sets reach the threshold."""
    sets = _sets(stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), texts, classes, width)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"))
    return stored(both.where(_reach("x", "y", num, den)).select("a", "b"))


def across(members: DataFrame, roots: DataFrame, texts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between classes of a bucket that the stars left in different components: ``a, b``.

    Of two such classes at least one lies outside the bucket's largest component, so those are met with all others of the bucket. They are compared inside
    the join, each pair in the first bucket it shares, so that only links come out of it, never pairs.
    """
    named = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    named = stored(named.join(open_.select("bucket", "main"), "bucket"))
    sets = _sets(stored(named.select("node").distinct()), texts, classes, width).join(classes.select("node", "bands"), "node")
    full = stored(named.join(sets, "node"))
    x, y = full.where("root <> main").alias("x"), full.alias("y")
    once = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")
    # two classes outside the largest component meet twice; the smaller root asks
    turn = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.root") < F.col("y.root")))
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & turn & (F.least(F.size("x.grams"), F.size("y.grams")) * den >= F.greatest(F.size("x.grams"), F.size("y.grams")) * num)
                 & once & _reach("x.grams", "y.grams", num, den))
    return stored(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def link_near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept; documents link when den * overlap >= num * union."""
    texts, rows, classes = _classes(docs, width)
    spread = classes.select("node", "n", F.explode("bands").alias("bucket"))
    hubs = stored(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("hub")).where("size > 1").select("bucket", "hub"))
    members = spread.where(might_contain(hubs.select("bucket"), F.col("bucket"))).join(hubs, "bucket")
    members = stored(members.select("bucket", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    able = f"least(n, hub_n) * {den} >= greatest(n, hub_n) * {num}"
    star = stored(members.where(f"node <> hub AND {able}").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = confirmed(star, texts, classes, width, num, den)
    roots = stored(components(links))
    more = across(members, roots, texts, classes, width, num, den)
    if not more.isEmpty():
        roots = stored(components(links.union(more)))

    named = classes.join(roots, "node", "left").select("set_hash", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_set = named.join(least, "root").select("set_hash", "component_id")
    out = rows.join(by_set, "set_hash", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
