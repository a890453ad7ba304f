"""One pass over the publish set for everything the gate asks: a mergeable state from which rules and shapes are read.

Every row is read once and counted under several keys at the same time: its exact start, title, venue, image, description length and id. What
comes out has one row per distinct key and source, is stored, and all checks, shapes and totals are small aggregates of it. No rule and no
shape reads the publish set again, and states of parts of a publish set could be added up.

Defined cases: an empty source and a null one count as ``Unknown`` in shapes and stay as they are in findings; a null title counts as one title; a null
start counts as a row but has no day.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import nav_title
from ..functions.times import has_offset, has_subminute, iso, ntz
from ..schema import FINGERPRINT, REQUIRED_FIELDS, missing
from ..session import keep

RAW, START, TITLE, VENUE, IMAGE, LENGTH, ID = "raw", "start", "title", "venue", "image", "length", "id"


def _marks(df: DataFrame, as_of, past_days: int, future_days: int) -> dict[str, tuple[Column, Column]]:
    """Per rule that looks at one row: (is it broken, sample)."""
    start = F.col("start_datetime")
    low, high = ntz(as_of) - F.expr(f"INTERVAL {past_days} DAYS"), ntz(as_of) + F.expr(f"INTERVAL {future_days} DAYS")
    short = F.substring(F.coalesce("title", F.lit("")), 1, 60)
    out = {"clock_stamped": (has_subminute(start), iso(start)), "date_out_of_range": ((start < low) | (start > high), iso(start)),
           "nav_title": (nav_title(F.col("title")), short)}
    out |= {f"missing_{f}": (missing(F.col(f).cast("string")), short) for f in REQUIRED_FIELDS}
    return out


def source_state(df: DataFrame, as_of, past_days: int = 730, future_days: int = 730) -> DataFrame:
    """The stored state of a publish set; one scan and one shuffle of pre-aggregated keys."""
    raw = [c for c in ("start_datetime_raw", "end_datetime_raw") if c in df.columns]
    marks = _marks(df, as_of, past_days, future_days)
    broken = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(1).cast("long").alias("n"), F.struct("arrival_ix", F.lit(0).alias("field"), sample.cast("string").alias("text")).alias("first"))).alias(rule)
              for rule, (cond, sample) in marks.items()]
    # an offset counts in each of the two text columns
    offsets = F.filter(F.array(*[F.struct("arrival_ix", F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(raw)]), lambda x: F.coalesce(has_offset(x["text"]), F.lit(False))) \
        if raw else F.array().cast("array<struct<arrival_ix:bigint,field:int,text:string>>")
    broken.append(F.when(F.size(offsets) > 0, F.struct(F.size(offsets).cast("long").alias("n"), F.element_at(offsets, 1).alias("first"))).alias("tz_aware"))
    folded = F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), F.lit("Unknown"))
    null = lambda t: F.lit(None).cast(t)
    rules = F.struct(*broken)

    def key(kind, source, text=None, start=None, number=None, rule=None):
        return F.struct(F.lit(kind).alias("kind"), source.alias("source"), (null("string") if text is None else text.cast("string")).alias("text"),
                        (null("timestamp_ntz") if start is None else start).alias("start"), (null("int") if number is None else number).alias("number"),
                        (F.when(F.lit(False), rules) if rule is None else rule).alias("rules"))

    no_source = null("string")
    keys = [key(RAW, F.col("source_name"), start=F.col("start_datetime"), rule=rules), key(START, folded, start=F.col("start_datetime")), key(TITLE, folded, F.col("title")),
            key(VENUE, folded, F.coalesce("venue_name", F.lit(""))), key(IMAGE, folded, F.coalesce("image_url", F.lit(""))),
            key(LENGTH, folded, number=F.length(F.coalesce("description", F.lit(""))))]
    if "id" in df.columns:
        keys.append(F.when(~missing(F.col("id")), key(ID, no_source, F.col("id"))))
    spread = df.select("arrival_ix", F.explode(F.array(*keys)).alias("k")).filter("k IS NOT NULL").select("arrival_ix", "k.*")
    names = [*marks, "tz_aware"]
    return keep(spread.groupBy("kind", "source", "text", "start", "number").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival_ix").alias("ix"),
        *[F.coalesce(F.sum(f"rules.{r}.n"), F.lit(0)).alias(f"{r}_n") for r in names], *[F.min(f"rules.{r}.first").alias(f"{r}_first") for r in names]))


def counts(state: DataFrame) -> DataFrame:
    """``source_name, n`` of the publish set behind a state."""
    return state.filter(F.col("kind") == RAW).groupBy(F.col("source").alias("source_name")).agg(F.sum("n").alias("n"))


def findings(state: DataFrame, per_timestamp: int = 20, uniform_share: float = 0.70, uniform_rows: int = 8, past_days: int = 730, future_days: int = 730) -> DataFrame:
    """Every broken rule as one row: rule, severity, source, count, sample, detail. A detail table, nowhere collected."""
    raw = state.filter(F.col("kind") == RAW)
    text = lambda s: F.col(s).cast("string")

    def finding(rule, source, count, sample, detail):
        return F.struct(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), source.cast("string").alias("source"), count.cast("bigint").alias("count"),
                        sample.cast("string").alias("sample"), detail.alias("detail"))

    says = {"clock_stamped": "%d start times carry seconds or microseconds", "date_out_of_range": f"%d events dated outside [-{past_days}d, +{future_days}d]",
            "nav_title": "%d titles look like page chrome", "tz_aware": "%d datetimes carry an offset"}
    calm = F.when(F.col("n") <= per_timestamp, F.struct("n", "start"))
    per = raw.groupBy("source").agg(F.sum("n").alias("total"), F.max(calm).alias("top"),
                                    *[F.sum(f"{r}_n").alias(f"{r}_n") for r in says], *[F.min(f"{r}_first").alias(f"{r}_first") for r in says])
    row_rules = [F.when(F.col(f"{r}_n") > 0, finding(r, F.col("source"), F.col(f"{r}_n"), text(f"{r}_first.text"), F.format_string(say, f"{r}_n"))) for r, say in says.items()]
    # a share above one half is held by one start only
    one_start = F.when((F.col("total") >= uniform_rows) & (F.col("top.n") / F.col("total") > uniform_share),
                       finding("uniform_timestamp", F.col("source"), F.col("top.n"), iso(F.col("top.start")), F.format_string("%d of %d events share one exact start", "top.n", "total")))
    crowded = raw.filter(F.col("n") > per_timestamp).select(finding(
        "timestamp_pileup", F.col("source"), F.col("n"), iso(F.col("start")), F.format_string(f"%d events share one exact start (limit {per_timestamp})", "n")).alias("f"))
    fields = raw.groupBy("source").agg(*[F.sum(f"missing_{f}_n").alias(f"{f}_n") for f in REQUIRED_FIELDS], *[F.min(f"missing_{f}_first").alias(f"{f}_first") for f in REQUIRED_FIELDS])
    fields = fields.agg(*[F.sum(f"{f}_n").alias(f"{f}_n") for f in REQUIRED_FIELDS],
                        *[F.min_by(F.struct("source", F.col(f"{f}_first.text").alias("text")), F.col(f"{f}_first.arrival_ix")).alias(f"{f}_first") for f in REQUIRED_FIELDS])
    empty = [F.when(F.col(f"{f}_n") > 0, finding("missing_required", F.col(f"{f}_first.source"), F.col(f"{f}_n"), F.col(f"{f}_first.text"), F.format_string(f"%d events missing {f}", f"{f}_n"))) for f in REQUIRED_FIELDS]
    twice = state.filter((F.col("kind") == ID) & (F.col("n") > 1)).agg(F.count(F.lit(1)).alias("ids"), F.max_by(F.struct("text", "n"), F.struct("n", -F.col("ix"))).alias("w"))
    same_id = F.when(F.col("ids") > 0, finding("duplicate_id", F.lit(None), F.col("ids"), F.concat(F.col("w.text"), F.lit(" x"), F.col("w.n").cast("string")), F.format_string("%d ids used by more than one event", "ids")))
    out = per.select(F.explode(F.array(*row_rules, one_start)).alias("f")).union(crowded).union(fields.select(F.explode(F.array(*empty)).alias("f"))).union(twice.select(same_id.alias("f")))
    return out.filter("f IS NOT NULL").select("f.*")


def shapes(state: DataFrame) -> DataFrame:
    """The fingerprint of every source, from its state."""
    part = lambda kind, c: F.when(F.col("kind") == kind, c)
    named = F.coalesce(F.col("text") != "", F.lit(False))
    per = state.filter(F.col("kind").isin(START, TITLE, VENUE, IMAGE, LENGTH)).groupBy("source", "kind", F.to_date("start").alias("day"), "number").agg(
        F.sum("n").alias("n"), F.max("n").alias("peak"), F.count(F.lit(1)).alias("keys"), F.count(F.when(named, 1)).alias("named_keys"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("named_rows"))
    # as many rows in a window as a source has days and lengths: element number n div 2 of the sorted lengths is the upper median
    w = Window.partitionBy("source", "kind")
    per = (per.withColumn("upto", F.sum("n").over(w.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w)))
    dated = F.col("day").isNotNull()
    out = per.groupBy("source").agg(
        F.sum(part(START, F.col("n"))).alias("events"), F.min("day").alias("earliest_start"), F.max("day").alias("latest_start"),
        F.max(F.when(dated, F.col("n"))).alias("day_n"), F.max(F.when(dated, F.col("peak"))).alias("start_n"), F.max(part(TITLE, F.col("keys"))).alias("titles"),
        F.max(part(VENUE, F.col("named_keys"))).alias("distinct_venues"), F.max(part(VENUE, F.col("n") - F.col("named_rows"))).alias("no_venue"),
        F.max(part(IMAGE, F.col("named_keys"))).alias("images"), F.max(part(IMAGE, F.col("named_rows"))).alias("with_image"),
        F.min(F.when((F.col("kind") == LENGTH) & F.expr("upto > total div 2"), F.col("number"))).alias("median_description_len"))
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), 4)
    out = (out.withColumn("date_span_days", F.coalesce(F.datediff("latest_start", "earliest_start") + 1, F.lit(0)))
           .withColumn("max_events_one_day", F.coalesce("day_n", F.lit(0))).withColumn("max_events_one_timestamp", F.coalesce("start_n", F.lit(0)))
           .withColumn("distinct_titles_ratio", ratio("titles", "events")).withColumn("null_venue_rate", ratio("no_venue", "events"))
           .withColumn("distinct_images_ratio", F.when(F.col("with_image") > 0, ratio("images", "with_image"))))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in FINGERPRINT.fields])
