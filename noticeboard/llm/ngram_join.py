"""Near-duplicate documents by the Jaccard similarity of their word n-grams, joined by vertical partitioning.

All n-grams stand in one global order, rare first. A document's set, sorted in that order, is cut at common pivots into fragments; the
overlap of a pair is counted fragment by fragment and summed per pair, exactly. Only pairs that can still reach the threshold are counted:
they share n-grams in the rare ends of both sets (their prefixes), and enough of them.

* Documents with equal sets are one class and travel once, so copies make no pairs.
* The order comes from a count sketch of fixed size over all documents. It steers how much work there is, never which pairs are found:
  any order gives the same links.
* Classes that share a prefix n-gram are first compared with one hub of that n-gram. What that already connects needs no further
  pairs; the others in such a group are then compared with each other across components. So a large group of near copies costs about one
  comparison a member, and no link between different components is missed.

Defined cases: null or blank text has the empty set and links with nothing; fewer words than n make one n-gram of all words; rows with
null or repeated doc_id are documents of their own, and a component's id is its smallest doc_id that is not null; an empty table gives an
empty table; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, might_contain, stored
from .tokens import batches

SKETCH_BITS = 24                  # counters of the order sketch: 16 M of one byte, whatever the corpus
BLOCK = 1 << 16
FRAGMENTS = 8
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "uint64")
_WORDS: dict[bytes, int] = {}
_MOST_WORDS = 300_000             # about 60 MB in a worker; emptied when a task ends, as workers outlive their tasks


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased; a bounded memory keeps those seen."""
    words = (text or "").encode().lower().split()          # bytes split at 0x20 and 0x09-0x0D alone
    known = _WORDS
    if len(known) > _MOST_WORDS:
        known.clear()
    try:
        return np.array([known[w] for w in words], "uint64")
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], "uint64")


def forget_words() -> None:
    """Empty the memory of words; for the end of a task."""
    _WORDS.clear()


def ngrams(text: str | None, width: int) -> np.ndarray:
    """Distinct n-gram hashes of a text, sorted by hash."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    used = min(width, len(w))
    h = np.full(len(w) - used + 1, used, "uint64")
    for i in range(used):
        h += w[i:len(w) - used + 1 + i] * _MULT[i]
    h ^= h >> np.uint64(32)
    h *= _MULT[-1]
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


class Order:
    """The global order: (sketched frequency, hash) as one integer key, and the pivots that cut it into fragments."""

    def __init__(self, rank: np.ndarray, pivots: np.ndarray):
        self.rank, self.pivots = rank, pivots

    def keys(self, grams: np.ndarray) -> np.ndarray:
        rank = self.rank[(grams >> np.uint64(64 - SKETCH_BITS)).astype("int64")].astype("uint64")
        key = (rank << np.uint64(56)) | (grams >> np.uint64(8))
        key.sort()
        return (key ^ np.uint64(1 << 63)).view("int64")          # signed, in the same order


def frequency_order(docs: DataFrame, width: int) -> Order:
    """Count the n-grams of all documents into a sketch of 2**SKETCH_BITS counters and rank them."""
    def count(frames):
        seen = np.zeros(1 << SKETCH_BITS, "uint8")
        for frame in batches(frames, "text"):
            grams = [ngrams(t, width) for t in frame["text"]]
            at, n = np.unique((np.concatenate(grams) >> np.uint64(64 - SKETCH_BITS)).astype("int64"), return_counts=True)
            seen[at] = np.minimum(255, seen[at] + n)
        forget_words()
        rows = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(seen.reshape(-1, BLOCK)) if b.any()]
        yield pd.DataFrame(rows, columns=["block", "counts"])

    def total(key, frame):
        out = np.zeros(BLOCK, "uint32")
        for c in frame["counts"]:
            out += np.frombuffer(zlib.decompress(c), "uint8")
        return pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(out.tobytes(), 1)]})

    def ranked(key, frame):
        out = np.zeros(BLOCK, "uint32")
        for c in frame["counts"]:
            out += np.frombuffer(zlib.decompress(c), "uint32")
        rank = np.minimum(255, np.round(8 * np.log2(1.0 + out))).astype("uint8")
        return pd.DataFrame({"block": [key[0]], "rank": [zlib.compress(rank.tobytes(), 1)], "mass": [np.bincount(rank, weights=out, minlength=256).tolist()]})

    parts = docs.select(F.col("text").cast("string")).mapInPandas(count, "block int, counts binary")
    # summed in two steps, so that no group grows with the number of tasks by more than its root
    some = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).applyInPandas(total, "block int, counts binary")
    rank, share = np.zeros(1 << SKETCH_BITS, "uint8"), np.zeros(256)             # a fixed size, not the corpus's
    for r in some.groupBy("block").applyInPandas(ranked, "block int, rank binary, mass array<double>").toLocalIterator():
        rank[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["rank"]), "uint8")
        share += r["mass"]
    mass = np.concatenate(([0.0], np.cumsum(share)))
    want = mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    r = np.minimum(np.searchsorted(mass, want, side="right") - 1, 255)
    within = (want - mass[r]) / np.maximum(mass[r + 1] - mass[r], 1.0)
    pivots = (r.astype("uint64") << np.uint64(56)) | (np.clip(within, 0, 1) * float((1 << 56) - 256)).astype("uint64")
    return Order(rank, (pivots ^ np.uint64(1 << 63)).view("int64"))


def _reaches(overlap: str, a: str, b: str, num: int, den: int) -> str:
    """overlap / (a + b - overlap) >= num / den, in whole numbers."""
    return f"({overlap}) * {num + den} >= {num} * ({a} + {b})"


def link_documents(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id; documents link when den * overlap >= num * union."""
    return _linked(docs, width, num, den).drop("root")


def _linked(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of ``link_documents`` with the root of their component, which groups without any doc_id have too."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = spark.sparkContext.broadcast(frequency_order(texts, width))

    def prefixes(frames):
        for frame in batches(frames, "text"):
            rows = []
            for doc_id, text_hash, text in zip(frame["doc_id"].astype("Int64"), frame["text_hash"], frame["text"]):
                keys = order.value.keys(ngrams(text, width))
                n = len(keys)
                kept = n - -(-num * n // den) + 1 if n else 0
                rows.append((doc_id, text_hash, n, xxhash.xxh3_128_digest(keys.tobytes()) if n else None, keys[:kept]))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "n", "set_hash", "prefix"]).astype({"doc_id": "Int64"})
        forget_words()

    sets = stored(texts.select("doc_id", "text_hash", "text").mapInPandas(prefixes, "doc_id long, text_hash long, n int, set_hash binary, prefix array<long>"))
    # one class per set; its first member stands for it where its text is read again, its smallest id is that which is not null
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = sets.where("n > 0").groupBy("set_hash", "n").agg(first, F.min("doc_id").alias("least_id"), F.any_value("prefix").alias("prefix"), F.count(F.lit(1)).alias("members"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    postings = classes.select("node", "n", F.posexplode("prefix").alias("i", "gram"))
    groups = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "node", "i")).alias("hub")).where("size > 1")
    shared = stored(postings.join(groups, "gram").select("gram", "node", "n", "i", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.i").alias("hub_i")))

    rest = lambda n: f"({n} - ({n} - cast(ceil({num} * {n} / {den}) as int) + 1))"  # noqa: E731  what a set has behind its prefix
    alike = lambda a, b: f"least({a}, {b}) * {den} >= greatest({a}, {b}) * {num}"
    ahead = lambda a, i, b, j: _reaches(f"least({i}, {j}) + 1 + least({a} - {i}, {b} - {j}) - 1", a, b, num, den)
    star = (shared.where(f"node <> hub AND {alike('n', 'hub_n')} AND {ahead('n', 'i', 'hub_n', 'hub_i')}")
            .groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.first("hub_n").alias("a_n"), F.first("n").alias("b_n"), F.count(F.lit(1)).alias("both"))
            .where(_reaches(f"both + greatest({rest('a_n')}, {rest('b_n')})", "a_n", "b_n", num, den)))
    star = stored(star.select("a", "b", "a_n", "b_n"))

    def cut(frames):
        for frame in batches(frames, "text"):
            rows = []
            for node, text in zip(frame["node"], frame["text"]):
                keys = order.value.keys(ngrams(text, width))
                ends = [0, *np.searchsorted(keys, order.value.pivots), len(keys)]
                rows += [(node, f, keys[i:j]) for f, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
            yield pd.DataFrame(rows, columns=["node", "fragment", "grams"])
        forget_words()

    def fragments(pairs: DataFrame) -> DataFrame:
        """The cut sets of the classes in ``pairs``; their texts are read again and moved once."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = classes.join(nodes, "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash"))
        found = texts.join(wanted, F.col("text_hash").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        return stored(found.select("node", "text").mapInPandas(cut, "node long, fragment int, grams array<long>").dropDuplicates(["node", "fragment"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs that reach the threshold: partial overlaps per fragment, summed per pair."""
        cuts = fragments(pairs)
        left = pairs.join(cuts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("a_grams")), "a")
        both = left.join(cuts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("b_grams")), ["b", "fragment"])
        partial = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_grams", "b_grams")).alias("partial"))
        summed = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("partial").alias("overlap"))
        return stored(summed.where(_reaches("overlap", "a_n", "b_n", num, den)).select("a", "b"))

    links = linked(star)
    roots = components(links)
    # groups that the hubs left in several components: compare across components, each pair once
    named = shared.join(roots, "node", "left").select("gram", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    split = named.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("gram")
    open_ = stored(named.join(split, "gram"))
    x, y = open_.alias("x"), open_.alias("y")
    meet = ((F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") < F.col("y.root"))
            & F.expr(alike("x.n", "y.n")) & F.expr(ahead("x.n", "x.i", "y.n", "y.i")))
    across = (x.join(y, meet).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
              .agg(F.first("x.n").alias("a_n"), F.first("y.n").alias("b_n"), F.count(F.lit(1)).alias("both"))
              .where(_reaches(f"both + greatest({rest('a_n')}, {rest('b_n')})", "a_n", "b_n", num, den)))
    tested = star.select("a", "b").union(star.select("b", "a"))
    across = stored(across.select("a", "b", "a_n", "b_n").join(tested, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        roots = components(links.union(linked(across)))

    order.unpersist()                 # what follows reads stored frames alone
    named = classes.join(roots, "node", "left").select("set_hash", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_set = named.join(least, "root").select("set_hash", "component_id", "root")
    return (sets.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "set_hash").join(by_set, "set_hash", "left")
            .select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, once: bool = False) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with the smallest (doc_id, text_hash), null ids last.

    Rows that repeat this document's id and text stay, or with ``once`` any one of them. Documents without words are in no group and stay.
    """
    found = stored(_linked(docs, width, num, den).where("n_shingles > 0").select("doc_id", "text_hash", "root"))
    rows = found.groupBy("root", "doc_id", "text_hash").agg((F.count(F.lit(1)) > 1).alias("again"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("kept"))
    judged = rows.join(kept, "root").withColumn("gone", ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))))
    marks = stored(judged.where(F.col("gone") | (F.col("again") & F.lit(once))).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_marked"), F.col("gone").alias("_gone")))
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    touched = might_contain(marks.select("_marked"), F.col("_hash"))
    some = hashed.where(touched).join(marks, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_marked")), "left")
    # rows without a mark get a key of their own
    some = some.where("_gone IS NULL OR NOT _gone").withColumn("_own", F.when(F.col("_gone").isNull(), F.monotonically_increasing_id()))
    some = some.dropDuplicates(["doc_id", "_hash", "_own"]) if once else some
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return hashed.where(~touched).select(*columns).union(some.select(*columns))
