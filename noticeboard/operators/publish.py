"""Ids, the publish set, snapshot diffs, and reconciling fresh rows with preserved ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import title_links
from ..functions.text import identity_title
from ..functions.times import iso, ntz
from ..schema import FIELD_LIMITS, LISTING, TRACKED_FIELDS, USER_SUBMITTED, conform, missing
from ..sources import registry as reg
from . import replay
from .dedup import TITLE_SIMILARITY, WINDOW_SECONDS, first_wins, keep, match_classes, number_classes, with_keys

SECOND_PASS_SIMILARITY = 0.70


# --- identity ---------------------------------------------------------------------

def content_id(source: Column, url: Column, start: Column, title: Column) -> Column:
    """32 hex digits of SHA-256 over source, URL, start and folded title: the same occurrence, the same id."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", e(source), e(url), e(iso(start)), identity_title(title)), 256), 1, 32)


def exceeds_limits() -> Column:
    """Name of the first field longer than a listing may hold, or null."""
    return F.coalesce(*[F.when(F.length(F.col(f)) > n, F.lit(f)) for f, n in FIELD_LIMITS.items()])


def promote(candidates: DataFrame, scraped_at) -> tuple[DataFrame, DataFrame]:
    """Candidates to listings. Returns (listings, rows a field limit rejects)."""
    judged = candidates.withColumn("over_limit", exceeds_limits())
    fine = judged.filter("over_limit IS NULL").drop("over_limit")
    listed = (fine.withColumn("id", content_id(F.col("source_name"), F.col("source_url"), F.col("start_datetime"), F.col("title")))
              .withColumn("scraped_at", ntz(scraped_at)).withColumn("last_updated", ntz(scraped_at)))
    return conform(listed, LISTING), judged.filter("over_limit IS NOT NULL")


# --- reconcile and second pass --------------------------------------------------------

def _settle(edges: DataFrame) -> DataFrame:
    """Work off pairwise contests as a sequential scan would, many at a time: for components too large to be replayed by one task.

    ``edges(i, j, j_ix, i_loses)``: scanning each ``i`` in order and its ``j`` by ``j_ix``,
    skipping what is gone: either j goes, or i goes and its scan stops. An ``i`` may
    settle a prefix of its contests as soon as no earlier ``i`` still has an open
    contest with those ``j`` (and, when i is itself some row's j, with i). The
    earliest open ``i`` always may, so every round makes progress, and a hub with
    many partners is settled in one. Returns the keys ``k`` that are gone.
    """
    gone = None
    edges = keep(edges)
    while not edges.isEmpty():
        first_i = edges.groupBy(F.col("j").alias("k")).agg(F.min("i").alias("first_i"))
        ready = edges.select(F.col("i").alias("k")).distinct().join(first_i, "k", "left_anti")
        open_ = (edges.join(ready.withColumnRenamed("k", "i"), "i", "left_semi")
                 .join(first_i.withColumnRenamed("k", "j"), "j").withColumn("clean", F.col("first_i") == F.col("i")))
        stops = open_.groupBy("i").agg(F.min(F.when(~F.col("clean"), F.col("j_ix"))).alias("unclean"),
                                       F.min(F.when(F.col("i_loses"), F.col("j_ix"))).alias("killer"))
        judged = keep(open_.join(stops, "i"))
        none = F.lit(True)
        before = F.when(F.col("unclean").isNull(), none).otherwise(F.col("j_ix") < F.col("unclean"))
        before_kill = F.when(F.col("killer").isNull(), none).otherwise(F.col("j_ix") < F.col("killer"))
        lost_j = judged.filter(before & before_kill).select(F.col("j").alias("k"))
        dead = F.col("killer").isNotNull() & (F.col("unclean").isNull() | (F.col("killer") < F.col("unclean")))
        lost_i = judged.filter(dead).select(F.col("i").alias("k"))
        lost = keep(lost_j.union(lost_i).distinct())
        gone = lost if gone is None else gone.union(lost)
        # an i without losses in reach has met only unclean contests; those stay
        edges = keep(edges.join(lost.withColumnRenamed("k", "i"), "i", "left_anti")
                     .join(lost.withColumnRenamed("k", "j"), "j", "left_anti"))
    return keep(gone) if gone is not None else edges.select(F.col("i").alias("k"))


def _contest_classes(*sides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, titles, venues) over the rows of all sides: one class for equal start, title and venue, numbered ``cid``."""
    every = sides[0].select("sec", "hour", "t", "v")
    for side in sides[1:]:
        every = every.union(side.select("sec", "hour", "t", "v"))
    return number_classes(keep(every.distinct().withColumn("cid", F.monotonically_increasing_id())))


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return keep(rows.join(classes.select("sec", "t", "v", "cid"), ["sec", "t", "v"]))


def second_pass(listings: DataFrame, registry: DataFrame, largest: int | None = None) -> DataFrame:
    """Cross-source duplicates on one calendar date: starts within an hour, venues alike, lower-cased
    titles at least 70 % alike. The better-ranked source stays, then the longer description, then the
    earlier row.

    Rows equal in start, title and venue are one class; links are between classes, and each connected component is replayed in
    order. Meant for rows that went through :func:`dedup.deduplicate`, so copies of one source are gone.
    """
    keyed = (reg.with_source_rank(with_keys(listings.filter(F.col("start_datetime").isNotNull())), registry)
             .withColumn("t", F.lower(F.coalesce("title", F.lit(""))))
             .select("arrival_ix", "src", "sec", "hour", "t", "v", "source_rank", F.length(F.coalesce("description", F.lit(""))).alias("dlen")))
    classes, titles, venues = _contest_classes(keyed)
    keyed = _of_classes(keyed, classes)
    hours = classes.select("hour", "tid").distinct()
    links = keep(title_links(hours, hours, titles, SECOND_PASS_SIMILARITY, 1, contain=False))
    gap = (F.abs(F.col("sec_a") - F.col("sec_b")) <= WINDOW_SECONDS) & (F.expr("sec_a div 86400") == F.expr("sec_b div 86400"))
    pairs = keep(match_classes(classes, classes, links, venues, (-1, 0, 1), gap).select("a", "b"))
    # a class with several rows is a component of its own even without links
    several = keyed.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    roots = keep(replay.label_components(pairs.union(several)))
    members = keyed.join(roots.withColumnRenamed("node", "cid"), "cid")
    rooted = pairs.join(roots.withColumnRenamed("node", "a"), "a")
    rows = replay.row(rooted, replay.LINK, a="a", b="b").union(
        replay.row(members, replay.MEMBER, a="cid", o2="arrival_ix", src="src", n1=F.col("source_rank").cast("long"), n2=-F.col("dlen").cast("long")))
    large = replay.split_by_size(roots, [rows.select("root")], largest)
    gone = replay.replay(rows.join(large, "root", "left_anti"), replay.contest, "arrival_ix long")
    if not large.isEmpty():
        side = lambda n: members.join(large, "root", "left_semi").select(F.col("cid").alias(f"c{n}"), F.col("arrival_ix").alias(n), F.col("src").alias(f"src_{n}"), F.struct("source_rank", -F.col("dlen")).alias(f"key_{n}"))
        met = pairs.union(members.select(F.col("cid").alias("a"), F.col("cid").alias("b")).distinct()).toDF("ca", "cb")
        both = met.join(side("a"), "ca").join(side("b"), "cb").filter((F.col("src_a") != F.col("src_b")) & (F.col("a") < F.col("b")))
        late = _settle(both.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("b").alias("j_ix"), (F.col("key_a") > F.col("key_b")).alias("i_loses")))
        gone = gone.union(late.select("k"))
    return listings.join(gone, "arrival_ix", "left_anti")


def reconcile(fresh: DataFrame, preserved: DataFrame, registry: DataFrame, largest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop duplicates between this run's rows and preserved ones; returns (fresh, preserved).

    A reader submission always stays, a better-ranked preserved row beats a fresh
    copy, and otherwise the fresh row stays. Order is ``arrival_ix`` on both sides.
    """
    def side(df):
        return (reg.with_source_rank(with_keys(df.filter(F.col("start_datetime").isNotNull())), registry)
                .select("arrival_ix", "src", "sec", "hour", "t", "v", "source_rank", "source_manual", F.expr("sec div 86400").alias("day")))
    p, f = side(preserved), side(fresh)
    classes, titles, venues = _contest_classes(p, f)
    p, f = _of_classes(p, classes), _of_classes(f, classes)
    of = lambda rows: keep(classes.join(rows.select("cid").distinct(), "cid", "left_semi"))
    p_classes, f_classes = of(p), of(f)
    hours = lambda c: c.select("hour", "tid").distinct()
    links = keep(title_links(hours(p_classes), hours(f_classes), titles, TITLE_SIMILARITY, 2, contain=True))
    gap = F.abs(F.col("sec_a") - F.col("sec_b")) <= WINDOW_SECONDS
    pairs = match_classes(p_classes, f_classes, links, venues, (-1, 0, 1), gap)
    # one source's own rows are duplicates only with equal start and title
    own = F.col("same_title") & (F.col("sec_a") == F.col("sec_b")) & (F.col("va").isNull() | F.col("vb").isNull() | F.col("va").eqNullSafe(F.col("vb")))
    pairs = keep(pairs.select("a", "b", own.alias("own")))
    shared = p_classes.join(f_classes.select("cid"), "cid", "left_semi").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    roots = keep(replay.label_components(pairs.select("a", "b").union(shared)))
    member = lambda df, s: df.join(roots.withColumnRenamed("node", "cid"), "cid").withColumn("side", F.lit(s).cast("long"))
    members = member(p, 0).union(member(f, 1))
    rooted = pairs.join(roots.withColumnRenamed("node", "a"), "a")
    rows = replay.row(rooted, replay.LINK, a="a", b="b", flag="own").union(
        replay.row(members, replay.MEMBER, a="cid", b="side", o1="day", o2="arrival_ix", src="src", n1=F.col("source_rank").cast("long"), flag="source_manual"))
    large = replay.split_by_size(roots, [rows.select("root")], largest)
    gone = replay.replay(rows.join(large, "root", "left_anti"), replay.reconcile, "side long, arrival_ix long")
    if not large.isEmpty():
        rest = members.join(large, "root", "left_semi")
        info = lambda s, n: rest.filter(F.col("side") == s).select(F.col("cid").alias(f"c{n}"), F.col("arrival_ix").alias(n), F.col("src").alias(f"src_{n}"), F.col("source_rank").alias(f"rank_{n}"), F.col("source_manual").alias(f"manual_{n}"), F.col("day").alias(f"day_{n}"))
        met = pairs.union(shared.withColumn("own", F.lit(True))).toDF("ca", "cb", "own")
        both = met.join(info(0, "a"), "ca").join(info(1, "b"), "cb").filter(F.col("own") | (F.col("src_a") != F.col("src_b")))
        late = _settle(both.select(
            F.struct(F.lit(0).alias("side"), F.col("a").alias("ix")).alias("i"), F.struct(F.lit(1).alias("side"), F.col("b").alias("ix")).alias("j"),
            F.struct("day_b", "b").alias("j_ix"), (~(F.col("manual_a") | (F.col("rank_a") < F.col("rank_b")))).alias("i_loses")))
        gone = gone.union(late.select(F.col("k.side").cast("long"), F.col("k.ix")))
    gone = keep(gone)
    ids = lambda s: gone.filter(F.col("side") == s).select("arrival_ix")
    return fresh.join(ids(1), "arrival_ix", "left_anti"), preserved.join(ids(0), "arrival_ix", "left_anti")


# --- the publish set --------------------------------------------------------------------

def preserved_rows(stored: DataFrame, registry: DataFrame, skipped: DataFrame, produced: DataFrame,
                   ran: DataFrame, as_of) -> DataFrame:
    """Stored rows that must survive the run.

    Always: reader submissions and sources this run skipped. Upcoming only:
    sources that ran and produced nothing, and blocked ones. The source sets are
    registry-sized.
    """
    always = skipped.select(F.col(skipped.columns[0]).alias("source_name")).union(reg.preserved_always(registry)).distinct()
    barren = ran.select(F.col(ran.columns[0]).alias("source_name")).join(
        produced.select(F.col(produced.columns[0]).alias("source_name")), "source_name", "left_anti")
    rescue = barren.union(reg.blocked(registry)).distinct().join(always, "source_name", "left_anti")
    keep_all = stored.join(always, "source_name", "left_semi")
    keep_some = stored.filter(F.to_date("start_datetime") >= F.to_date(ntz(as_of))).join(rescue, "source_name", "left_semi")
    return keep_all.unionByName(keep_some)


def publish_set(fresh: DataFrame, preserved: DataFrame, registry: DataFrame) -> DataFrame:
    """Fresh and preserved rows without duplicates between them; write with ``stored.write_listings``."""
    kept_fresh, kept_old = reconcile(fresh, preserved, registry)
    return kept_fresh.unionByName(kept_old, allowMissingColumns=True)


def replace_sources(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of every source that produced nothing now."""
    produced = fresh.select("source_name").distinct()
    return stored.join(produced, "source_name", "left_anti")


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per id that was added, removed or changed, with the changed columns.

    Rows without an id are ignored and the last of several rows with one id counts.
    """
    def last(df, name):
        cols = ["title", "source_name"] + [c for c in TRACKED_FIELDS if c != "title"]
        return (df.filter(~missing(F.col("id"))).groupBy("id")
                .agg(F.max_by(F.struct(*cols), "arrival_ix").alias(name)))
    both = last(before, "a").join(last(after, "b"), "id", "full")
    fields = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in TRACKED_FIELDS]),
                      lambda x: x.isNotNull())
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
              .when(F.size(fields) > 0, "changed").otherwise("unchanged"))
    return both.select("id", change.alias("change"), F.coalesce("b.title", "a.title").alias("title"),
                       F.coalesce("b.source_name", "a.source_name").alias("source_name"),
                       F.when(change == "changed", fields).alias("fields"))


def diff_counts(diff: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return diff.agg(*[n(c) for c in ("added", "removed", "changed", "unchanged")])


def diff_by_source(diff: DataFrame, top: int = 8) -> DataFrame:
    return (diff.filter(F.col("change").isin("added", "removed")).groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.col("rows").desc(), "source_name").limit(top))


def new_submissions(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Submissions whose (lower-cased title, date) is neither stored nor repeated; the first of several stays."""
    key = lambda d: d.withColumn("_k", F.lower(F.coalesce("title", F.lit("")))).withColumn("_d", F.to_date("start_datetime"))
    unique = first_wins(key(rows), ["_k", "_d"])
    old = key(stored.filter(F.col("source_name") == USER_SUBMITTED)).select("_k", "_d").distinct()
    return unique.join(old, ["_k", "_d"], "left_anti").drop("_k", "_d")

