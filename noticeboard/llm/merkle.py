"""A Merkle manifest of a dataset: one tree per source over its rows, one tree over the sources, and a proof for every row.

A leaf is the digest of the row's fields, each written as ``-`` for null or else as its length in UTF-8 bytes, a colon and its value. Leaves
stand in ascending order; while a tree has several nodes, every ``fanout`` consecutive ones become the digest of their joined digests.

Checkpoint and recompute: only the leaves and every ``stride``-th level above are stored. The levels between are never written. A proof goes
from the root down: the stored nodes of one aligned subtree (``fanout ** stride`` at most, which bounds what meets in a row) are read, its
missing interior nodes are made again, the siblings of each stored node are put in front of its parent's path, and the rest is dropped.

* Places come from one global range numbering of narrow rows, so a source of any size is spread over all tasks and no source meets in one.
* Rounds are logarithmic in the largest source; each writes a fraction of 1 / fanout ** stride of the nodes before it.

Defined cases: null fields count as ``-``; a null source is a source of its own, first in order; rows with equal source and doc_id stand in order
of their leaves; a null doc_id comes first in its source; a tree of one leaf is that leaf; an empty table has no root and no rows; other columns are
ignored, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import number_rows, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_TREES = 100_000         # a tree's row is some tens of bytes


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of the fields in the order given; no two lists of fields are written alike."""
    written = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values))
    return digest(F.concat(*written))


@dataclass(frozen=True)
class Manifest:
    """Stored parts of a manifest.

    ``leaves``: tree, pos, n (nodes of the tree on this level), digest and the row's own columns; ``levels``: tree, pos, n, digest of every
    ``stride``-th level above, the last holding one node a tree; ``top``: the same lists for the tree over the sources, its leaves first.
    """
    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    fanout: int
    stride: int


def _joined(digests: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(digests, start, length), "")


def _above(digests: Column, fanout: int) -> Column:
    """The next level over a run-aligned array of digests."""
    runs = F.sequence(F.lit(0), F.call_function("div", F.size(digests) - 1, F.lit(fanout)).cast("int"))
    return F.transform(runs, lambda i: digest(_joined(digests, i * fanout + 1, F.lit(fanout))))


def _nodes_above(n: Column, fanout: int) -> Column:
    return F.when(n > 1, F.call_function("div", n + (fanout - 1), F.lit(fanout))).otherwise(n)


def _subtrees(level: DataFrame, fanout: int, stride: int, *carried: str) -> DataFrame:
    """Aligned subtrees of a stored level: tree, block, n, members in order (pos, digest and carried columns)."""
    block = F.call_function("div", F.col("pos"), F.lit(fanout ** stride)).alias("block")
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))         # at most fanout ** stride
    return level.groupBy("tree", "n", block).agg(members.alias("members"))


def _interior(subtrees: DataFrame, fanout: int, stride: int, levels: int) -> DataFrame:
    """The nodes of the ``levels`` lowest levels of each subtree, made again from its stored ones: d0, d1, ... and the widths n0, n1, ..."""
    out = subtrees.withColumn("d0", F.transform("members", lambda m: m["digest"])).withColumn("n0", F.col("n"))
    for t in range(1, levels):
        # an aggregate's result is used several times: stop the optimiser from writing it out at every use
        out = out.withColumn(f"d{t}", F.when(F.col(f"n{t - 1}") > 1, _above(F.col(f"d{t - 1}"), fanout)).otherwise(F.col(f"d{t - 1}")))
        out = out.withColumn(f"n{t}", _nodes_above(F.col(f"n{t - 1}"), fanout))
    return out


def _climb(leaves: DataFrame, fanout: int, stride: int) -> list[DataFrame]:
    """The stored levels above ``leaves(tree, pos, n, digest)``; ends when every tree has one node."""
    out, cur = [], leaves
    while cur.where("n > 1").limit(1).count():
        tops = _interior(_subtrees(cur.select("tree", "pos", "n", "digest"), fanout, stride), fanout, stride, stride + 1)
        cur = stored(tops.select("tree", F.col("block").alias("pos"), F.col(f"n{stride}").alias("n"), F.element_at(f"d{stride}", 1).alias("digest")))
        out.append(cur)
    return out


def build(rows: DataFrame, digest_column: str = "leaf", group: str = "source", order: str = "doc_id", fanout: int = 16, stride: int = 2) -> Manifest:
    """The manifest of ``rows``, whose column ``digest_column`` holds the leaf; the other columns stay with the leaves."""
    kept = [c for c in rows.columns if c != digest_column]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(digest_column).alias("digest"))
    # equal rows are interchangeable but may be many: their place in the files spreads them
    packed = stored(packed).withColumn("tie", F.monotonically_increasing_id())
    group_key = F.col("row").getField(group)
    ranked, total = number_rows(packed, group_key, F.col("row").getField(order), F.col("digest"), F.col("tie"), name="place")
    if total == 0:
        none = packed.select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), "digest", "row")
        return Manifest(none, [], [], None, fanout, stride)
    spans = ranked.groupBy(group_key.alias("name")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    trees, n_trees = number_rows(spans, F.col("first"), name="tree")
    trees = stored(trees)
    small = n_trees <= BROADCAST_TREES               # beyond it a shuffle join, whose hot source AQE splits
    named = ranked.join(F.broadcast(trees) if small else trees, group_key.eqNullSafe(F.col("name")))
    leaves = stored(named.select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", "digest", "row"))
    levels = _climb(leaves, fanout, stride)
    roots = (levels[-1] if levels else leaves).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "digest")
    top = [stored(roots)]
    top += _climb(top[0], fanout, stride)
    return Manifest(leaves, levels, top, top[-1].first()["digest"], fanout, stride)


_STEP = "array<struct<left:string,right:string>>"


def _descend(level: DataFrame, paths: DataFrame, m: Manifest, *carried: str) -> DataFrame:
    """Each node of a stored level with its path: its siblings inside the subtree, then ``paths(tree, pos, path, subroot)`` of the node above."""
    made = _interior(_subtrees(level, m.fanout, m.stride, *carried), m.fanout, m.stride, m.stride)
    met = made.join(paths.select("tree", F.col("pos").alias("block"), "path", "subroot"), ["tree", "block"])

    def with_path(member, i):
        own = []
        for t in range(m.stride):
            at = F.call_function("div", i, F.lit(m.fanout ** t)).cast("int")
            first = at - at % m.fanout
            step = F.struct(_joined(F.col(f"d{t}"), first + 1, at - first).alias("left"),
                            _joined(F.col(f"d{t}"), at + 2, F.lit(m.fanout - 1) - (at - first)).alias("right"))
            own.append(F.when(F.col(f"n{t}") > 1, F.array(step)).otherwise(F.array().cast(_STEP)))
        return F.struct(member["pos"].alias("pos"), member["digest"].alias("digest"), *(member[c].alias(c) for c in carried),
                        F.concat(*own, F.col("path")).alias("path"))

    return met.select("tree", "subroot", F.explode(F.transform("members", with_path)).alias("m")).select("tree", "subroot", "m.*")


def proofs(m: Manifest) -> DataFrame:
    """``row, leaf, subroot, path`` of every row; ``path`` has one step a level up to the root: the joined siblings left and right of it."""
    none = F.array().cast(_STEP).alias("path")
    paths = m.top[-1].select("tree", "pos", none, F.lit(None).cast("string").alias("subroot")) if m.top else None
    for level in reversed(m.top[:-1]):
        paths = stored(_descend(level, paths, m).select("tree", "pos", "path", "subroot"))
    if paths is None:
        return m.leaves.select("row", F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("subroot"), none)
    # a node of the tree over the sources is the root of the source's own tree
    source = m.top[0].select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"))
    paths = paths.select(F.col("pos").alias("tree"), "path").join(source, "tree").withColumn("pos", F.lit(0).cast("long"))
    if not m.levels:
        return m.leaves.join(paths, ["tree", "pos"]).select("row", F.col("digest").alias("leaf"), "subroot", "path")
    for level in reversed(m.levels[:-1]):
        paths = stored(_descend(level, paths, m).select("tree", "pos", "path", "subroot"))
    return _descend(m.leaves, paths, m, "row").select("row", F.col("digest").alias("leaf"), "subroot", "path")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, fanout: int = 16, stride: int = 2) -> Manifest:
    """The manifest of documents; rows keep doc_id, source and, where ``tampered`` is given, the leaf with that text."""
    of = lambda text: leaf(*(text if c == "text" else F.col(c) for c in fields))
    again = F.lit(None).cast("string") if tampered is None else of(tampered)
    rows = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), again.alias("tampered"))
    return build(rows, fanout=fanout, stride=stride)


def verify(m: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where it has one) and verified."""
    root = F.lit(m.root).cast("string")
    claimed = F.coalesce(F.col("row.tampered"), F.col("leaf"))
    out = proofs(m).select("row.doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(claimed, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
