"""Absolute rules, source shapes, drift against a source's own history, and the gate.

Checks are aggregates with a map-side combine; none collects a source's rows
anywhere. The gate reads a publish set once, into a state (``quality_state``);
the functions of single rules stay for queries about one of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rules import nav_title
from ..functions.times import has_offset, has_subminute, iso, ntz
from ..schema import FINGERPRINT, REQUIRED_FIELDS, missing
from ..session import keep
from . import quality_state as state

# --- fixed values ----------------------------------------------------------
MAX_EVENTS_PER_TIMESTAMP = 20
UNIFORM_TIMESTAMP_SHARE = 0.70
UNIFORM_TIMESTAMP_MIN_EVENTS = 8
MAX_PAST_DAYS = 730
MAX_FUTURE_DAYS = 730
MIN_EVENTS_FOR_DRIFT = 10
MIN_RUNS_FOR_DRIFT = 3
MIN_EVENTS_RATIO = 0.50
MIN_SOURCES_RATIO = 0.60
GATE_MODES = ("enforce", "report", "force")
ROUND_PAGE_SIZES = (10, 12, 20, 25, 30, 50, 100)
# metric, direction, warns at, errors at, what it suggests
DRIFT_RULES = (
    ("events", "down", 0.70, 0.50, "source returns far less than usual"),
    ("events", "up", 2.00, 3.00, "source returns far more than usual"),
    ("date_span_days", "down", 0.70, 0.50, "reaches less far ahead"),
    ("max_events_one_day", "up", 2.00, 2.50, "dates collapse onto one day"),
    ("distinct_titles_ratio", "down", 0.70, 0.50, "titles repeat"),
    ("distinct_images_ratio", "down", 0.60, 0.40, "images collapse to a placeholder"),
    ("median_description_len", "down", 0.50, 0.30, "descriptions thin out"),
)
# ---------------------------------------------------------------------------

VIOLATION = "rule string, severity string, source string, count bigint, sample string, detail string"
DRIFT = ("source string, metric string, severity string, current double, baseline double, detail string")


# --- invariants -----------------------------------------------------------------

def _rows(df: DataFrame, rule: str, count, sample, detail, source="source_name") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"),
                     (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
                     count.cast("bigint").alias("count"), sample.cast("string").alias("sample"), detail.alias("detail"))


def _first(value):
    return F.min_by(value, F.col("arrival_ix"))


def missing_required(df: DataFrame) -> DataFrame:
    """One row per empty required field, over all sources; the sample is the first such row."""
    tests = F.array(*[F.when(missing(F.col(f).cast("string")), F.lit(f)) for f in REQUIRED_FIELDS])
    bad = (df.select("arrival_ix", "source_name", "title", F.explode(tests).alias("field")).filter("field IS NOT NULL")
           .groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("source_name", "title"), "arrival_ix").alias("s")))
    return _rows(bad.select("field", "n", F.col("s.source_name").alias("source_name"),
                            F.substring(F.coalesce("s.title", F.lit("")), 1, 60).alias("sample")),
                 "missing_required", F.col("n"), F.col("sample"),
                 F.format_string("%d events missing %s", "n", "field"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    ids = (df.filter(~missing(F.col("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("arrival_ix").alias("ix"))
           .filter("n > 1"))
    worst = ids.agg(F.count(F.lit(1)).alias("ids"), F.max_by(F.struct("id", "n"), F.struct("n", -F.col("ix"))).alias("w")).filter("ids > 0")
    return _rows(worst, "duplicate_id", F.col("ids"), F.concat(F.col("w.id"), F.lit(" x"), F.col("w.n")),
                 F.format_string("%d ids used by more than one event", "ids"), source=None)


def _per_source(df: DataFrame, rule: str, condition, sample, text: str) -> DataFrame:
    bad = df.filter(condition).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), _first(sample).alias("sample"))
    return _rows(bad, rule, F.col("n"), F.col("sample"), F.format_string(text, "n"))


def clock_stamped(df: DataFrame, column: str = "start_datetime") -> DataFrame:
    return _per_source(df, "clock_stamped", has_subminute(F.col(column)), iso(F.col(column)),
                       "%d start times carry seconds or microseconds")


def tz_aware(raw: DataFrame) -> DataFrame:
    """Offset suffixes, judged on the text columns ``*_raw``; each field counts."""
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(("start_datetime_raw", "end_datetime_raw"))])
    bad = (raw.select("arrival_ix", "source_name", F.explode(fields).alias("f")).filter(has_offset(F.col("f.v")))
           .groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.min_by("f.v", F.struct("arrival_ix", "f.i")).alias("sample")))
    return _rows(bad, "tz_aware", F.col("n"), F.col("sample"), F.format_string("%d datetimes carry an offset", "n"))


def starts_per_source(df: DataFrame) -> DataFrame:
    """Rows per (source, exact start): the shared first level of the pile-up rules."""
    return df.groupBy("source_name", "start_datetime").agg(F.count(F.lit(1)).alias("n"))


def timestamp_pileup(df: DataFrame) -> DataFrame:
    bad = starts_per_source(df).filter(F.col("n") > MAX_EVENTS_PER_TIMESTAMP)
    return _rows(bad, "timestamp_pileup", F.col("n"), iso(F.col("start_datetime")),
                 F.format_string(f"%d events share one exact start (limit {MAX_EVENTS_PER_TIMESTAMP})", "n"))


def uniform_timestamp(df: DataFrame) -> DataFrame:
    """More than 70 % of a source on one start, where the pile-up cap has not spoken already."""
    per_start = starts_per_source(df)
    totals = per_start.groupBy("source_name").agg(F.sum("n").alias("total")).filter(F.col("total") >= UNIFORM_TIMESTAMP_MIN_EVENTS)
    # a share above one half is held by one start only
    top = per_start.filter(F.col("n") <= MAX_EVENTS_PER_TIMESTAMP)
    bad = (top.join(totals.withColumnRenamed("source_name", "_s"), F.col("source_name").eqNullSafe(F.col("_s")))
           .filter(F.col("n") / F.col("total") > UNIFORM_TIMESTAMP_SHARE))
    return _rows(bad, "uniform_timestamp", F.col("n"), iso(F.col("start_datetime")),
                 F.format_string("%d of %d events share one exact start", "n", "total"))


def date_out_of_range(df: DataFrame, as_of) -> DataFrame:
    lo = ntz(as_of) - F.expr(f"INTERVAL {MAX_PAST_DAYS} DAYS")
    hi = ntz(as_of) + F.expr(f"INTERVAL {MAX_FUTURE_DAYS} DAYS")
    start = F.col("start_datetime")
    return _per_source(df, "date_out_of_range", (start < lo) | (start > hi), iso(start),
                       f"%d events dated outside [-{MAX_PAST_DAYS}d, +{MAX_FUTURE_DAYS}d]")


def nav_titles(df: DataFrame) -> DataFrame:
    return _per_source(df, "nav_title", nav_title(F.col("title")), F.substring(F.coalesce("title", F.lit("")), 1, 60),
                       "%d titles look like page chrome")


def publish_state(df: DataFrame, as_of) -> DataFrame:
    """The stored one-pass state of a publish set, from which rules, shapes and totals are read."""
    return state.source_state(df, as_of, MAX_PAST_DAYS, MAX_FUTURE_DAYS)


def rule_findings(of: DataFrame) -> DataFrame:
    """Every absolute rule over a state."""
    return state.findings(of, MAX_EVENTS_PER_TIMESTAMP, UNIFORM_TIMESTAMP_SHARE, UNIFORM_TIMESTAMP_MIN_EVENTS, MAX_PAST_DAYS, MAX_FUTURE_DAYS)


def check_invariants(df: DataFrame, as_of) -> DataFrame:
    """Every absolute rule, in one pass. ``tz_aware`` runs where the raw text columns are present."""
    return rule_findings(publish_state(df, as_of))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy((F.col("severity") != "error"), F.col("count").desc(), "rule", F.col("source").asc_nulls_first())


def errors(findings: DataFrame) -> DataFrame:
    return findings.filter("severity = 'error'")


# --- fingerprints ------------------------------------------------------------------

def fingerprints(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The shape of each source's output, one row per source (and per ``by`` column).

    Three aggregates over finer keys (start, title, description length) are folded
    per source; the upper median is read off the running count of lengths, so no
    source is ever sorted or gathered as rows.
    """
    extra = list(by or [])
    key = ["source", *extra]
    base = df.select(F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), F.lit("Unknown")).alias("source"), *extra,
                     "start_datetime", "title", "venue_name", "image_url",
                     F.length(F.coalesce("description", F.lit(""))).alias("dlen"))
    per_start = base.groupBy(*key, "start_datetime").agg(F.count(F.lit(1)).alias("n"))
    dated = per_start.filter("start_datetime IS NOT NULL")
    per_day = dated.groupBy(*key, F.to_date("start_datetime").alias("day")).agg(F.sum("n").alias("n"), F.max("n").alias("peak"))
    dates = per_day.groupBy(*key).agg(
        F.min("day").alias("earliest_start"), F.max("day").alias("latest_start"),
        F.max("n").alias("max_events_one_day"), F.max("peak").alias("max_events_one_timestamp"))
    # null counts as one title, hence the wrapper that is never null
    counts = base.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"),
        (F.count_distinct("title") + F.max(F.col("title").isNull().cast("int"))).alias("titles"),
        F.count_distinct(F.when(F.col("venue_name") != "", F.col("venue_name"))).alias("distinct_venues"),
        F.count(F.when(missing(F.col("venue_name")), 1)).alias("no_venue"),
        F.count_distinct(F.when(F.col("image_url") != "", F.col("image_url"))).alias("images"),
        F.count(F.when(F.col("image_url") != "", 1)).alias("with_image"))
    lengths = base.groupBy(*key, "dlen").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*key).orderBy("dlen").rowsBetween(Window.unboundedPreceding, 0)
    # element number n div 2 (from zero) of the sorted lengths: the upper median
    total = lengths.groupBy(*key).agg(F.sum("n").alias("total"))
    median = (lengths.withColumn("upto", F.sum("n").over(run)).join(total, key)
              .filter("upto > total div 2").groupBy(*key).agg(F.min("dlen").alias("median_description_len")))
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), 4)
    out = (counts.join(median, key).join(dates, key, "left")
           .withColumn("date_span_days", F.coalesce(F.datediff("latest_start", "earliest_start") + 1, F.lit(0)))
           .withColumn("max_events_one_day", F.coalesce("max_events_one_day", F.lit(0)))
           .withColumn("max_events_one_timestamp", F.coalesce("max_events_one_timestamp", F.lit(0)))
           .withColumn("distinct_titles_ratio", ratio("titles", "events"))
           .withColumn("null_venue_rate", ratio("no_venue", "events"))
           .withColumn("distinct_images_ratio", F.when(F.col("with_image") > 0, ratio("images", "with_image"))))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in FINGERPRINT.fields], *extra)


# --- drift ---------------------------------------------------------------------------

METRICS = ("events", "date_span_days", "max_events_one_day", "distinct_titles_ratio",
           "distinct_images_ratio", "median_description_len")


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value")


def baseline(history: DataFrame) -> DataFrame:
    """Median of every metric over a source's history; nulls are left out.

    History is trimmed to 30 runs per source, so a median never sees more values.
    """
    return (_long(history, ["source"]).filter("value IS NOT NULL")
            .groupBy("source", "metric").agg(F.median("value").alias("base")))


def drift_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(DRIFT_RULES)],
        "rule_ix int, metric string, direction string, warn_at double, error_at double, hint string")


def _judged(current: DataFrame, history: DataFrame) -> DataFrame:
    """Sources with enough runs and enough events to say anything, with their usual event count."""
    runs = history.groupBy("source").agg(F.count(F.lit(1)).alias("runs")).filter(F.col("runs") >= MIN_RUNS_FOR_DRIFT)
    usual = baseline(history).filter("metric = 'events'").select("source", F.col("base").alias("usual"))
    return (current.join(runs, "source").join(usual, "source", "left")
            .withColumn("usual", F.coalesce("usual", F.lit(0.0)))
            .filter(~((F.col("events") < MIN_EVENTS_FOR_DRIFT) & (F.col("usual") < MIN_EVENTS_FOR_DRIFT))))


def _drift_row(metric, severity, current, base, detail):
    return [F.col("source"), metric.alias("metric"), severity.alias("severity"), current.cast("double").alias("current"),
            base.cast("double").alias("baseline"), detail.alias("detail")]


def metric_drift(current: DataFrame, history: DataFrame) -> DataFrame:
    """Each source against the median of its own past. A total loss is reported alone."""
    judged = _judged(current, history)
    gone = judged.filter((F.col("events") == 0) & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT))
    lost = gone.select(*_drift_row(F.lit("events"), F.lit("error"), F.lit(0), F.col("usual"), F.lit("returned nothing")))
    rest = judged.filter(~((F.col("events") == 0) & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT)))
    compared = (_long(rest, ["source"]).join(baseline(history), ["source", "metric"])
                .join(F.broadcast(drift_rules(current.sparkSession)), "metric")
                .filter(F.col("value").isNotNull() & (F.col("base") != 0))
                .withColumn("ratio", F.col("value") / F.col("base")))
    down, ratio = F.col("direction") == "down", F.col("ratio")
    fired = compared.filter(F.when(down, ratio < F.col("warn_at")).otherwise(ratio > F.col("warn_at")))
    severity = F.when(F.when(down, ratio < F.col("error_at")).otherwise(ratio > F.col("error_at")), "error").otherwise("warning")
    return lost.unionByName(fired.select(*_drift_row(
        F.col("metric"), severity, F.round("value", 4), F.round("base", 4),
        F.format_string("%s (%.0f%% of normal)", F.col("hint"), ratio * 100))))


def stale_drift(current: DataFrame, history: DataFrame) -> DataFrame:
    """The furthest-out listing moved backwards: the source may have stopped publishing."""
    best = history.groupBy("source").agg(F.max("latest_start").alias("best"))
    judged = _judged(current, history).filter(~((F.col("events") == 0) & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT)))
    fired = judged.join(best, "source").filter(F.col("latest_start") < F.col("best"))
    return fired.select(*_drift_row(F.lit("latest_start"), F.lit("warning"), F.lit(0), F.lit(0),
                                    F.format_string("furthest-out listing moved from %s to %s",
                                                    F.col("best").cast("string"), F.col("latest_start").cast("string"))))


def disappeared(current: DataFrame, history: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Sources with history and no rows now. ``active=None`` (registry unreadable) checks them all."""
    absent = history.join(current.select("source"), "source", "left_anti")
    if active is not None:
        absent = absent.join(active.select(F.col("name").alias("source")), "source", "left_semi")
    usual = (absent.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.median("events").alias("usual"))
             .filter((F.col("runs") >= MIN_RUNS_FOR_DRIFT) & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT)))
    return usual.select(*_drift_row(F.lit("events"), F.lit("error"), F.lit(0), F.col("usual"),
                                    F.lit("source disappeared from the data entirely")))


def past_of(history: DataFrame) -> DataFrame:
    """What a source's history says of it, one row a source: runs, usual, best and the median of every metric. Trimmed history is 30 runs a source."""
    return history.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.median("events"), F.lit(0.0)).alias("usual"), F.max("latest_start").alias("best"),
                                         *[F.median(F.col(m).cast("double")).alias(f"base_{m}") for m in METRICS])


def check_drift(current: DataFrame, history: DataFrame, active: DataFrame | None = None,
                scope: list[str] | None = None) -> DataFrame:
    """All drift, with one read of each side. ``scope`` judges only the named sources, so that the rest do not look vanished."""
    if scope is not None:
        current, history = (d.filter(F.col("source").isin(*scope)) for d in (current, history))
    both = current.join(past_of(history), "source", "full")
    known = F.lit(True)
    if active is not None:
        both = both.join(active.select(F.col("name").alias("source")).distinct().withColumn("known", F.lit(True)), "source", "left")
        known = F.coalesce("known", F.lit(False))
    enough = F.col("runs") >= MIN_RUNS_FOR_DRIFT
    here = F.col("events").isNotNull()
    judged = here & enough & ~((F.col("events") < MIN_EVENTS_FOR_DRIFT) & (F.col("usual") < MIN_EVENTS_FOR_DRIFT))
    lost = judged & (F.col("events") == 0) & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT)
    row = lambda *cols: F.struct(*_drift_row(*cols))
    found = [F.when(lost, row(F.lit("events"), F.lit("error"), F.lit(0), F.col("usual"), F.lit("returned nothing"))),
             F.when(~here & enough & (F.col("usual") >= MIN_EVENTS_FOR_DRIFT) & known,
                    row(F.lit("events"), F.lit("error"), F.lit(0), F.col("usual"), F.lit("source disappeared from the data entirely"))),
             F.when(judged & ~lost & (F.col("latest_start") < F.col("best")), row(
                 F.lit("latest_start"), F.lit("warning"), F.lit(0), F.lit(0),
                 F.format_string("furthest-out listing moved from %s to %s", F.col("best").cast("string"), F.col("latest_start").cast("string"))))]
    for metric, direction, warn_at, error_at, hint in DRIFT_RULES:
        value, base = F.col(metric).cast("double"), F.col(f"base_{metric}")
        ratio = value / base
        beyond = (lambda bound: ratio < bound) if direction == "down" else (lambda bound: ratio > bound)
        found.append(F.when(judged & ~lost & (base != 0) & beyond(warn_at), row(
            F.lit(metric), F.when(beyond(error_at), "error").otherwise("warning"), F.round(value, 4), F.round(base, 4),
            F.format_string("%s (%.0f%% of normal)", F.lit(hint), ratio * 100))))
    return both.select(F.explode(F.array(*found)).alias("f")).filter("f IS NOT NULL").select("f.*")


# --- the gate ----------------------------------------------------------------------

def source_counts(df: DataFrame) -> DataFrame:
    """``source_name, n``: of listings, or of their state without reading them again."""
    return state.counts(df) if "kind" in df.columns else df.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


def collapse(events: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Absolute stop: most of the rows, or of the sources, about to vanish. One row: reasons and the number of rows now.

    Counting per source first leaves a small table for the totals. Either side may be listings or their state.
    """
    now = source_counts(events).withColumnRenamed("n", "now")
    if previous is None:
        return now.agg(F.array().cast("array<string>").alias("reasons"), F.coalesce(F.sum("now"), F.lit(0)).alias("events"))
    both = source_counts(previous).withColumnRenamed("n", "was").join(now, "source_name", "full")
    named = ~missing(F.col("source_name"))
    # a null name never joins itself, so its rows are still counted on both sides
    totals = both.agg(
        F.coalesce(F.sum("was"), F.lit(0)).alias("was"), F.coalesce(F.sum("now"), F.lit(0)).alias("now"),
        F.count(F.when(named & (F.col("was") > 0), 1)).alias("was_sources"),
        F.count(F.when(named & (F.col("now") > 0), 1)).alias("now_sources"),
        F.array_sort(F.collect_list(F.when(named & (F.col("was") > 0) & F.col("now").isNull(), F.col("source_name")))).alias("lost"))      # one name a source
    rows = F.when((F.col("was") > 0) & (F.col("now") < F.col("was") * MIN_EVENTS_RATIO),
                  F.format_string("event count collapsed: %d vs %d currently published", "now", "was"))
    sources = F.when((F.col("was_sources") > 0) & (F.col("now_sources") < F.col("was_sources") * MIN_SOURCES_RATIO),
                     F.concat(F.format_string("%d of %d sources vanished: ", F.size("lost"), F.col("was_sources")),
                              F.array_join(F.slice("lost", 1, 8), ", "), F.when(F.size("lost") > 8, " ...").otherwise("")))
    return totals.select(F.filter(F.array(rows, sources), lambda r: r.isNotNull()).alias("reasons"), F.col("now").alias("events"))


def lost_sources(previous: DataFrame, events: DataFrame) -> DataFrame:
    names = lambda d: d.filter(~missing(F.col("source_name"))).select("source_name").distinct()
    return names(previous).join(names(events), "source_name", "left_anti")


def resolve_mode(mode: str | None = None, force: bool = False) -> str:
    """Anything but an exact, known mode means enforce: a typo must not switch the gate off."""
    if force:
        return "force"
    value = (mode or "enforce").strip().lower()
    return value if value in GATE_MODES else "enforce"


SHOWN_PER_SOURCE, SHOWN = 5, 1000     # findings that a decision lists; all of them are in the detail tables


def _listed(findings: DataFrame, key: list[str], order: list, columns: list[str], name: str) -> DataFrame:
    """One row: how many findings and errors there are, and the worst of them as a bounded list in order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    # both limits are pushed below the shuffle, so no task sees more than they allow
    few = findings.withColumn("_n", nth).filter(F.col("_n") <= SHOWN_PER_SOURCE).orderBy(*order).limit(SHOWN).drop("_n")
    shown = few.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    count = findings.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.count(F.when(F.col("severity") == "error", 1)).alias(f"bad_{name}"))
    return count.join(shown)                                    # one-row tables


def gate(events: DataFrame, violations: DataFrame, drifts: DataFrame, previous: DataFrame | None = None, *,
         mode: str | None = None, force: bool = False, enforce_drift: bool = False) -> DataFrame:
    """The one decision before publishing, as one row.

    ``events`` and ``previous`` are listings or their states. Decided from counts; the lists hold the worst findings only
    (``n_violations`` and ``n_drifts`` count all), the frames that come in are the detail.
    """
    resolved = resolve_mode(mode, force)
    violations, drifts = keep(violations), keep(drifts)         # findings, not rows: a few per source and start
    v = _listed(violations.withColumn("order", -F.col("count")), ["rule", "source"], ["severity", "order", "rule", F.col("source").asc_nulls_first(), "sample"],
                ["severity", "order", "rule", "source", "count", "sample", "detail"], "violations")
    d = _listed(drifts, ["source"], ["severity", "source", "metric", "current", "baseline"], ["severity", "source", "metric", "current", "baseline", "detail"], "drifts")
    one = collapse(events, previous).join(v).join(d)             # one-row tables
    drifted = F.when(F.col("bad_drifts") > 0, F.format_string("%d source(s) drifted beyond tolerance", "bad_drifts"))
    found = F.concat(
        F.array(F.when(F.col("events") == 0, F.lit("the run produced no events at all"))), F.col("reasons"),
        F.array(F.when(F.col("bad_violations") > 0, F.format_string("%d invariant violation(s)", "bad_violations")),
                drifted if enforce_drift else F.lit(None).cast("string")))
    noted = F.array(F.lit(None).cast("string") if enforce_drift else F.concat(drifted, F.lit(" (not blocking)")))
    real = lambda a: F.filter(a, lambda r: r.isNotNull())
    clean = F.size(F.col("found")) == 0
    passed = clean | F.lit(resolved == "force")
    forced = F.when(~clean & F.lit(resolved == "force"), F.array(F.lit("overridden by force"))).otherwise(F.array().cast("array<string>"))
    return (one.withColumn("found", real(found))
            .select(F.when(passed, "pass").otherwise("BLOCKED" if resolved == "enforce" else f"fail({resolved})").alias("decision"),
                    F.lit(resolved).alias("mode"), F.lit(enforce_drift).alias("drift_enforced"), passed.alias("passed"),
                    (~passed & F.lit(resolved == "enforce")).alias("blocking"),
                    F.concat("found", forced, real(noted)).alias("reasons"), "violations", "drifts", "events", "n_violations", "n_drifts"))


def report(decision: DataFrame) -> DataFrame:
    """The decision as text: reasons, collapse, blocking rules, drift, warnings."""
    line_v = lambda v: F.concat(F.lit("  "), F.coalesce(F.concat(v["source"], F.lit(": ")), F.lit("")), v["detail"],
                                F.coalesce(F.concat(F.lit("  e.g. "), v["sample"]), F.lit("")))
    line_d = lambda d: F.concat(F.lit("  "), d["source"], F.lit(": "), d["metric"], F.lit(" "), d["current"].cast("string"),
                                F.lit(" vs baseline "), d["baseline"].cast("string"), F.lit(" - "), d["detail"])

    def block(title, lines):
        return F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))

    more = F.col("n_violations") + F.col("n_drifts") - F.size("violations") - F.size("drifts")
    sev = lambda c, s, f: F.transform(F.filter(c, lambda x: x["severity"] == s), f)
    collapsed = F.transform(F.filter("reasons", lambda r: r.contains("collapsed") | r.contains("vanished")), lambda r: F.concat(F.lit("  "), r))
    return decision.select(F.concat_ws(
        "\n", F.concat(F.lit("Gate: "), "decision"),
        F.when(F.size("reasons") > 0, F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("  "), r)), "\n")),
        block("Catastrophic collapse:", collapsed),
        block("Invariant violations:", sev("violations", "error", line_v)),
        block("Drift from each source's own baseline:", sev("drifts", "error", line_d)),
        block("Warnings (not blocking):", F.concat(sev("violations", "warning", line_v), sev("drifts", "warning", line_d))),
        F.when(more > 0, F.format_string("%d further finding(s) in the detail tables", more))).alias("report"))


# --- boards ---------------------------------------------------------------------------

def silent_sources(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Scraped sources that contribute nothing."""
    present = events.select(F.col("source_name").alias("name")).distinct()
    return registry.filter("is_scraped").select("name").join(present, "name", "left_anti")


def unregistered_sources(events: DataFrame, registry: DataFrame) -> DataFrame:
    present = events.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("name")).agg(F.count(F.lit(1)).alias("event_count"))
    return present.join(registry.select("name"), "name", "left_anti")


def findings_board(violations: DataFrame, drifts: DataFrame, silent: DataFrame, last_run: DataFrame, as_of_utc) -> DataFrame:
    """Everything worth knowing, errors first: rules, drift, silent sources, the last run's state and age."""
    part = lambda df, level, message: df.select(level.alias("level"), message.alias("message"))
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    rows = part(violations, level, F.concat(F.coalesce("source", F.lit("data")), F.lit(": "), "detail"))
    rows = rows.unionByName(part(drifts, level, F.concat_ws(" ", F.concat("source", F.lit(":")), "metric", "detail")))
    quiet = silent.agg(F.array_sort(F.collect_list("name")).alias("names")).filter(F.size("names") > 0)
    rows = rows.unionByName(part(quiet, F.lit("warning"), F.concat(F.size("names").cast("string"), F.lit(" registered source(s) contribute no events: "), F.array_join("names", ", "))))
    bad = F.col("gate.decision") != "pass"
    rows = rows.unionByName(part(last_run.filter(F.coalesce(bad, F.lit(True))), F.lit("error"), F.concat_ws(" ", F.lit("last run"), "run_id", F.concat(F.lit("gate="), F.coalesce("gate.decision", F.lit("?"))))))
    failed = last_run.withColumn("f", F.transform(F.filter("scrapers", lambda s: s["status"] == "failed"), lambda s: s["source"])).filter(F.size("f") > 0)
    rows = rows.unionByName(part(failed, F.lit("error"), F.concat(F.lit("last run: "), F.size("f").cast("string"), F.lit(" source(s) failed: "), F.array_join(F.slice("f", 1, 5), ", "))))
    days = F.floor((ntz(as_of_utc) - F.col("started_at").cast("timestamp_ntz")).cast("interval day").cast("int"))
    old = last_run.withColumn("days", days).filter(ntz(as_of_utc) - F.col("started_at").cast("timestamp_ntz") > F.expr("INTERVAL 2 DAYS"))
    rows = rows.unionByName(part(old, F.lit("warning"), F.concat(F.lit("last run was "), F.col("days").cast("string"), F.lit(" days ago"))))
    return rows.orderBy(F.col("level") != "error", "message")


def coverage_signals(events: DataFrame, completeness: DataFrame | None, as_of, short_days: int = 14) -> DataFrame:
    """Signs that a source was read only in part: a round row count, a short horizon, pages missing."""
    per = events.groupBy("source_name").agg(F.count(F.lit(1)).alias("events"), F.max("start_datetime").alias("latest"))
    per = per.withColumn("round_count", F.col("events").isin(*ROUND_PAGE_SIZES)) \
             .withColumn("short_horizon", F.datediff(F.to_date("latest"), F.to_date(ntz(as_of))) < short_days)
    if completeness is None:
        return per.drop("latest").withColumn("pages_missing", F.lit(None).cast("bigint"))
    return per.drop("latest").join(completeness.select("source_name", "pages_missing"), "source_name", "left")
