"""Duplicate occurrences: find, group and merge.

Two rows of one source are the same occurrence when start and folded title are
equal and the venues are equal or one is missing. Rows of different sources are
the same when they start within an hour, their venues (where both are known) are
alike, and their titles are alike or, with both venues known, one title contains
the other.

Grouping is a greedy sweep in (start, arrival) order: the first row not yet
taken becomes a leader and takes every later untaken row it duplicates. That is
*not* transitive closure, and it is order-dependent, so it is reproduced exactly:

* Rows equal in source, start, title and venue are one **node**: they match the
  same rows, so the sweep always decides them together.
* Nodes equal in start, title and venue are one **class**. Members of a class all
  match each other, and whether two classes match depends only on their texts
  (and on the two sources differing). So pairs are only ever formed between
  classes, never within a group of copies.
* The connected components of the matching classes are independent, so each is
  replayed in order by one task. Two leaders of a class are enough to know the
  earliest one whose source differs from a given one.
* A component too large for one task is settled by rounds instead: a node leads
  exactly when no earlier undecided node matches it, and each round settles every
  node for which that is already known, for the whole table at once, with joins
  that are linear in the class pairs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.similarity import alike_pairs, link_stages, number_texts, title_links
from ..functions.text import identity_title, venue_key
from ..functions.times import epoch_seconds
from ..schema import missing
from ..session import keep
from ..sources.registry import with_source_rank
from . import replay

# --- fixed values ----------------------------------------------------------
WINDOW_SECONDS = 3600
TITLE_SIMILARITY = 0.85
VENUE_SIMILARITY = 0.7
# ---------------------------------------------------------------------------


def with_keys(df: DataFrame) -> DataFrame:
    """Comparison columns: folded title ``t``, venue key ``v``, source ``src``, second ``sec``, hour ``hour``."""
    sec = epoch_seconds(F.col("start_datetime"))
    return df.select("*", identity_title(F.col("title")).alias("t"), venue_key(F.col("venue_name")).alias("v"),
                     F.coalesce("source_name", F.lit("")).alias("src"), sec.alias("sec"),
                     F.floor(sec / WINDOW_SECONDS).alias("hour"))


def same_source_pairs(df: DataFrame) -> DataFrame:
    """Rows of one source with equal start and folded title whose venues do not contradict.

    Copies are folded first; the pairs are (representative, representative), with
    the number of rows behind each.
    """
    nodes = (with_keys(df).groupBy("src", "start_datetime", "t", "v")
             .agg(F.min("arrival_ix").alias("ix"), F.count(F.lit(1)).alias("copies")))
    blank, named = nodes.filter("v = ''"), nodes.filter("v <> ''")
    pairs = (blank.alias("a").join(named.alias("b"), ["src", "start_datetime", "t"])
             .select("src", "start_datetime", "t",
                     F.least("a.ix", "b.ix").alias("ix_a"), F.greatest("a.ix", "b.ix").alias("ix_b"),
                     (F.col("a.copies") * F.col("b.copies")).alias("row_pairs")))
    within = (nodes.filter("copies > 1")
              .select("src", "start_datetime", "t", F.col("ix").alias("ix_a"), F.col("ix").alias("ix_b"),
                      F.expr("copies * (copies - 1) div 2").alias("row_pairs")))
    return pairs.union(within)


def interval_pair_counts(df: DataFrame) -> DataFrame:
    """How many row pairs start within an hour of each other, per second of the earlier start.

    Counts are folded per start before pairing, so a crowded start costs one row.
    """
    starts = (with_keys(df).groupBy("sec", "hour").agg(F.count(F.lit(1)).alias("n")))
    right = starts.select(F.explode(F.array(F.col("hour"), F.col("hour") - 1)).alias("hour"),
                          F.col("sec").alias("sec_b"), F.col("n").alias("m"))
    gap = F.col("sec_b") - F.col("sec")
    return (starts.join(right, "hour").filter((gap >= 0) & (gap <= WINDOW_SECONDS))
            .groupBy("sec").agg(F.sum(F.when(gap == 0, F.expr("n * (n - 1) div 2"))
                                      .otherwise(F.col("n") * F.col("m"))).alias("pairs")))


def number_classes(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes with ``tid`` and ``vid``, titles, venues): titles and venue names as numbers; a class without a venue has no ``vid``."""
    titles, venues = number_texts(classes.select("t")), number_texts(classes.filter("v <> ''").select("v"), "v")
    numbered = classes.join(titles, "t").join(venues.select(F.col("tid").alias("vid"), F.col("t").alias("v")), "v", "left")
    return keep(numbered), titles, venues


def match_classes(a: DataFrame, b: DataFrame, links: DataFrame, venues: DataFrame, offsets, gap_filter) -> DataFrame:
    """Directed class pairs (a first) that match by title and venue and start close enough.

    ``a`` and ``b`` have ``cid, sec, hour, tid, vid``. Pairs travel as numbers; each distinct pair of venue names is compared once.
    """
    left = a.select(F.explode(F.array(*[F.col("hour") + o for o in offsets])).alias("hour"),
                    F.col("cid").alias("a"), F.col("sec").alias("sec_a"), F.col("tid").alias("ta"), F.col("vid").alias("va"))
    right = b.select("hour", F.col("cid").alias("b"), F.col("sec").alias("sec_b"), F.col("tid").alias("tb"), F.col("vid").alias("vb"))
    cols = ["a", "b", "sec_a", "sec_b", "va", "vb", "same_title"]
    equal = (left.join(right.withColumnRenamed("tb", "ta"), ["hour", "ta"])
             .filter(gap_filter & (F.col("a") != F.col("b")))
             .withColumn("same_title", F.lit(True)).select(*cols))
    linked = links.select("hour", F.col("a").alias("ta"), F.col("b").alias("tb"), "near", "contained")
    alike = (left.join(linked, ["hour", "ta"]).join(right, ["hour", "tb"])
             .filter(gap_filter & (F.col("near") | (F.col("contained") & F.col("va").isNotNull() & F.col("vb").isNotNull())))
             .withColumn("same_title", F.lit(False)).select(*cols))
    pairs = keep(equal.unionByName(alike))
    open_ = F.col("va").isNull() | F.col("vb").isNull() | (F.col("va") == F.col("vb"))
    names = pairs.filter(~open_).select(F.col("va").alias("a"), F.col("vb").alias("b")).distinct()
    close = alike_pairs(names, venues, VENUE_SIMILARITY).toDF("va", "vb")
    return pairs.filter(open_).unionByName(pairs.filter(~open_).join(close, ["va", "vb"]).select(*cols))


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, classes, titles, venues)."""
    nodes = keep(with_keys(df.filter(F.col("start_datetime").isNotNull()))
                 .groupBy("src", "sec", "hour", "t", "v")
                 .agg(F.min("arrival_ix").alias("ix"), F.count(F.lit(1)).alias("copies")))
    classes = nodes.groupBy("sec", "hour", "t", "v").agg(F.min("ix").alias("cid"), F.count(F.lit(1)).alias("sources"))
    return nodes, *number_classes(classes)


def _title_links(classes: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct titles by hour, links between them)."""
    hours = classes.select("hour", "tid").distinct()
    return hours, keep(title_links(hours, hours, titles, TITLE_SIMILARITY, 2, contain=True, offsets=(0, 1)))


def duplicate_nodes(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, classes, directed class edges). See the module docstring."""
    nodes, classes, titles, venues = _classes(df)
    return nodes, classes, class_edges(classes, venues, _title_links(classes, titles)[1])


def class_edges(classes: DataFrame, venues: DataFrame, links: DataFrame) -> DataFrame:
    """Directed edges between classes whose titles are equal or linked."""
    # a leads, so it starts no later; equal starts keep both directions (arrival decides per node)
    gap = F.col("sec_b") - F.col("sec_a")
    edges = match_classes(classes, classes, links, venues, (0, 1), (gap >= 0) & (gap <= WINDOW_SECONDS))
    edges = edges.select("a", "b", "sec_a", "sec_b",
                         (F.col("same_title") & (gap == 0)
                          & (F.col("va").isNull() | F.col("vb").isNull())).alias("any_source"))
    return keep(edges)


def pair_stages(df: DataFrame) -> DataFrame:
    """One row on the work of the duplicate search: rows, nodes and classes, tokens filed, candidate and compared title pairs, alike ones, class pairs."""
    nodes, classes, titles, venues = _classes(df)
    hours, links = _title_links(classes, titles)
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    stages = link_stages(hours, hours, titles, TITLE_SIMILARITY, 2, links, offsets=(0, 1))
    return one(df, "rows").join(one(nodes, "nodes")).join(one(classes, "classes")).join(stages).join(one(class_edges(classes, venues, links), "class_pairs"))     # one-row frames


def _first_two(members: DataFrame, key: str) -> DataFrame:
    """Per key: the earliest member and the earliest one with another source, in columns f1, f2.

    Expects one row per (key, src). The two-row limit is pushed below the shuffle.
    """
    w = Window.partitionBy(key).orderBy("sec", "ix")
    two = members.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    at = lambda n: F.max(F.when(F.col("_n") == n, F.struct("sec", "ix", "src")))
    return two.groupBy(key).agg(at(1).alias("f1"), at(2).alias("f2"))


def _order(s):
    return F.struct(s["sec"], s["ix"])


def _touching(leaders: DataFrame, edges: DataFrame) -> DataFrame:
    """Per class: the earliest leaders that match it, as t0 (whatever the source), t1 and t2 (other source)."""
    seen = edges.join(leaders.select(F.col("cid").alias("a"), "sec", "ix", "src"), "a")
    per_source = (seen.groupBy("b", "src").agg(
        F.min(F.struct("sec", "ix")).alias("o"),
        F.min(F.when(F.col("any_source"), F.struct("sec", "ix"))).alias("o0")))
    ranked = per_source.select("b", "src", F.col("o.sec").alias("sec"), F.col("o.ix").alias("ix"))
    two = _first_two(ranked, "b")
    zero = per_source.groupBy("b").agg(F.min("o0").alias("t0"))
    return two.join(zero, "b").select(F.col("b").alias("cid"), "t0", F.col("f1").alias("t1"), F.col("f2").alias("t2"))


def _earliest_taker(src, t0, t1, t2):
    """The earliest leader in t0/t1/t2 that may take a member of source ``src``."""
    other = F.when(t1["src"] != src, _order(t1)).otherwise(F.when(t2.isNotNull(), _order(t2)))
    return F.least(t0, other)


def _sweep_by_rounds(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``cid, src, leader_ix`` of members in components that are too large to be replayed by one task."""
    undecided = members.select("cid", "sec", "ix", "src")
    settled = None
    while True:
        two = _first_two(undecided, "cid")
        head = two.select("cid", F.col("f1.sec").alias("sec"), F.col("f1.ix").alias("ix"), F.col("f1.src").alias("src"))
        # is some earlier undecided node still able to take this head?
        rivals = (edges.join(two.withColumnRenamed("cid", "a"), "a")
                  .join(head.select(F.col("cid").alias("b"), F.col("sec").alias("hs"), F.col("ix").alias("hi"),
                                    F.col("src").alias("hsrc")), "b"))
        rival = F.when(F.col("any_source") | (F.col("f1.src") != F.col("hsrc")), _order(F.col("f1"))) \
            .otherwise(F.when(F.col("f2").isNotNull(), _order(F.col("f2"))))
        held = (rivals.filter(rival < F.struct(F.col("hs").alias("sec"), F.col("hi").alias("ix")))
                .select(F.col("b").alias("cid")).distinct())
        leaders = keep(head.join(held, "cid", "left_anti"))
        settled = leaders if settled is None else settled.unionByName(leaders)
        touch = _touching(leaders, edges)
        own = leaders.select("cid", F.lit(True).alias("led"))
        left = (undecided.join(own, "cid", "left").filter("led IS NULL").drop("led")
                .join(touch, "cid", "left"))
        taker = _earliest_taker(F.col("src"), F.col("t0"), F.col("t1"), F.col("t2"))
        undecided = keep(left.filter(~F.coalesce(taker < F.struct("sec", "ix"), F.lit(False)))
                         .select("cid", "sec", "ix", "src"))
        if undecided.isEmpty():
            break
    settled = keep(settled)
    lead = settled.select("cid", F.struct("sec", "ix").alias("own"))
    touch = _touching(settled, edges)
    me = F.struct("sec", "ix")
    taker = _earliest_taker(F.col("src"), F.col("t0"), F.col("t1"), F.col("t2"))
    joined = members.join(lead, "cid", "left").join(touch, "cid", "left")
    return joined.select("cid", "src", F.least(F.when(taker < me, taker), F.when(F.col("own") <= me, F.col("own")))["ix"].alias("leader_ix"))


def sweep(nodes: DataFrame, classes: DataFrame, edges: DataFrame, largest: int | None = None) -> DataFrame:
    """Settle the greedy sweep. Returns ``src, sec, t, v, ix, copies, leader_ix`` for every node."""
    members = nodes.join(classes.select("sec", "t", "v", "cid"), ["sec", "t", "v"])
    roots = keep(replay.label_components(edges.select("a", "b")))
    members = keep(members.join(roots.withColumnRenamed("node", "cid"), "cid", "left"))
    alone = members.filter("root IS NULL").withColumn("leader_ix", F.col("cid"))
    linked = members.filter("root IS NOT NULL")
    rooted = edges.join(roots.withColumnRenamed("node", "a"), "a")
    rows = replay.row(rooted, replay.LINK, a="a", b="b", flag="any_source").union(replay.row(linked, replay.MEMBER, a="cid", o1="sec", o2="ix", src="src"))
    large = replay.split_by_size(roots, [rows.select("root")], largest)
    decided = replay.replay(rows.join(large, "root", "left_anti"), replay.lead, "cid long, src string, sec long, ix long, leader_ix long").select("cid", "src", "leader_ix")
    if not large.isEmpty():
        decided = decided.unionByName(_sweep_by_rounds(keep(linked.join(large, "root", "left_semi")), keep(rooted.join(large, "root", "left_semi"))))
    cols = ["src", "sec", "t", "v", "ix", "copies", "leader_ix"]
    return alone.select(*cols).unionByName(linked.join(decided, ["cid", "src"]).select(*cols))




def assign_groups(df: DataFrame, largest: int | None = None) -> DataFrame:
    """Every row with ``group_ix`` (arrival of its leader) and ``group_size``."""
    nodes, classes, edges = duplicate_nodes(df)
    assigned = keep(sweep(nodes, classes, edges, largest))
    sizes = (assigned.groupBy("leader_ix").agg(F.sum("copies").alias("group_size")).filter("group_size > 1"))
    grouped = assigned.join(sizes, "leader_ix").select("src", "sec", "t", "v", F.col("leader_ix").alias("group_ix"), "group_size")
    rows = with_keys(df)
    return (rows.join(grouped, ["src", "sec", "t", "v"], "left")
            .withColumn("group_ix", F.coalesce("group_ix", "arrival_ix"))
            .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
            .drop("src", "sec", "t", "v", "hour"))


_FILL = ("venue_name", "street_address", "category", "contact_email", "contact_phone", "website_url", "image_url")
_FROM_BASE = ("title", "start_datetime", "end_datetime", "all_day", "city", "state", "zip_code", "family_friendly",
              "age_restrictions", "cost", "registration_required", "source_url", "source_name", "recurring_pattern")


def merge_groups(grouped: DataFrame, registry: DataFrame) -> DataFrame:
    """Fold each group into one row, credited to its best-ranked source.

    Rank decides the base row, arrival breaks ties. Gaps are filled in arrival
    order; the longest description wins; coordinates travel together; tags are
    united. Every aggregate keeps one row per group on the map side.
    """
    single = grouped.filter("group_size = 1").drop("group_ix", "group_size")
    many = with_source_rank(grouped.filter("group_size > 1"), registry)
    base_of = many.groupBy("group_ix").agg(F.min(F.struct("source_rank", "arrival_ix"))["arrival_ix"].alias("base_ix"))
    many = many.join(base_of, "group_ix")
    is_base = F.col("arrival_ix") == F.col("base_ix")
    turn = F.struct(~is_base, F.col("arrival_ix"))
    # the map column cannot take part in an aggregate's ordering, but can be a value
    aggs = [F.min_by(F.struct(*_FROM_BASE), turn).alias("base"),
            F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), is_base, -F.col("arrival_ix"))).alias("description"),
            F.min("base_ix").alias("base_ix")]
    for name in _FILL:
        aggs.append(F.min_by(name, F.when(~missing(F.col(name)), turn)).alias(name))
    place = F.struct("latitude", "longitude")
    has_place = F.col("latitude").isNotNull() & (F.col("latitude") != 0)
    aggs += [F.min_by(place, F.when(has_place, turn)).alias("place"), F.min_by(place, turn).alias("base_place")]
    tags = (many.select("group_ix", F.explode("tags").alias("tag")).distinct()
            .groupBy("group_ix").agg(F.array_sort(F.collect_list("tag")).alias("tags")))
    merged = (many.groupBy("group_ix").agg(*aggs).join(tags, "group_ix", "left")
              .withColumn("place", F.coalesce("place", "base_place")))
    out = merged.select("base.*", "description", *_FILL,
                        F.col("place.latitude").alias("latitude"), F.col("place.longitude").alias("longitude"),
                        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                        F.col("base_ix").alias("arrival_ix"))
    extra = [c for c in single.columns if c not in out.columns]
    return single.drop(*extra).unionByName(out)


def deduplicate(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates with every group of duplicates merged into one row."""
    return merge_groups(assign_groups(df), registry)


def first_wins(df: DataFrame, keys: list, order: str = "arrival_ix") -> DataFrame:
    """The first row per key. The one-row limit is pushed below the shuffle, so a hot key stays cheap."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
