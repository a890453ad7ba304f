"""Monitors: freshness and volume per source."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import ntz

# --- fixed values ----------------------------------------------------------
CI_STALE_DAYS = 3
LOCAL_STALE_DAYS = 14
VOLUME_RUNS = 5
# ---------------------------------------------------------------------------


def _days_since(t, as_of):
    return F.floor(F.extract(F.lit("DAY"), ntz(as_of) - t)).cast("int")


def source_freshness(listings: DataFrame, registry: DataFrame, as_of_utc) -> DataFrame:
    """Every registered source with its row count, latest start, latest scrape and its age in days."""
    per = listings.groupBy(F.col("source_name").alias("name")).agg(
        F.count(F.lit(1)).alias("events"), F.max("start_datetime").alias("latest_start"), F.max("scraped_at").alias("last_scraped"))
    return (registry.select("name", "adapter", "kind", "status", "runs_in_ci").join(per, "name", "left")
            .withColumn("events", F.coalesce("events", F.lit(0)))
            .withColumn("days_since_scrape", _days_since(F.col("last_scraped"), as_of_utc)))


def freshness_monitor(listings: DataFrame, registry: DataFrame, as_of_utc) -> DataFrame:
    """One row per watched source (healthy, stale, missing) and per unregistered one."""
    per = listings.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("event_count"), F.max("scraped_at").alias("latest"))
    known = registry.select(F.col("name").alias("source"), F.col("runs_in_ci").alias("ci"), F.col("is_scraped").alias("watched"))
    both = per.join(known, "source", "full")
    days = _days_since(F.col("latest"), as_of_utc)
    limit = F.when(F.col("ci"), CI_STALE_DAYS).otherwise(LOCAL_STALE_DAYS)
    state = (F.when(F.col("watched").isNull(), "unregistered")
             .when(F.col("event_count").isNull(), "missing")
             .when(F.col("latest").isNull() | (days > limit), "stale").otherwise("healthy"))
    return (both.filter(F.coalesce("watched", F.lit(True)))
            .select("source", state.alias("state"), "ci", F.coalesce("event_count", F.lit(0)).alias("event_count"),
                    F.when(F.col("watched").isNotNull(), days).alias("days_since_scrape")))


def freshness_summary(monitor: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return monitor.agg(*[count(s) for s in ("healthy", "stale", "missing", "unregistered")])


def volume_history(runs: DataFrame, keep: int = VOLUME_RUNS) -> DataFrame:
    """The last runs' counts as rows ``(run_id, source, events)``. ``runs`` has one row per run and source."""
    recent = runs.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(keep)
    return runs.join(recent, "run_id", "left_semi")


def volume_monitor(listings: DataFrame, history: DataFrame, registry: DataFrame) -> DataFrame:
    """Current rows against the mean of the last runs in which the source appeared.

    Without history the result is empty: a first run only records a baseline.
    """
    current = listings.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("current"))
    past = history.groupBy("source").agg((F.sum("events") / F.count(F.lit(1))).alias("average"))
    active = registry.filter("status = 'active'").select(F.col("name").alias("source"))
    both = past.join(active, "source", "left_semi").join(current, "source", "left")
    now, avg = F.coalesce("current", F.lit(0)), F.col("average")
    severity = (F.when((now == 0) & (avg > 5), "CRITICAL")
                .when((avg > 0) & (now > 0) & (now < avg * 0.5), "WARNING")
                .when(F.col("current").isNull(), "MISSING"))
    return (both.select("source", severity.alias("severity"), now.alias("current"), F.round("average", 1).alias("average"))
            .filter("severity IS NOT NULL"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows per stage as ``(stage, rows)``; inside a run prefer ``observed`` below, which adds no pass."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def observed(df: DataFrame, name: str):
    """Count rows as they pass. Returns (frame, observation); read ``observation.get['rows']`` after an action."""
    from pyspark.sql import Observation
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def rejection_tally(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def run_errors(outcome: DataFrame, run_id: str) -> DataFrame:
    """One row for the run with its per-source results as an array (one entry per source)."""
    return outcome.agg(F.lit(run_id).alias("run_id"),
                       F.array_sort(F.collect_list(F.struct("source", "status", "returned", "error"))).alias("scrapers"))
