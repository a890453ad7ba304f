"""The daily run, the single-source repair, the local refresh and the submission sync.

Each returns frames. A run is written by ``commit_run``, whose only driver decision is the gate's
one row; a repair or a refresh is written by its own ``write``, which refuses error findings.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import dedup, monitors, normalise, publish, quality, serve
from ..operators.extract import checks, extract_all
from ..operators.extract.json_feeds import announced_pages, failed_sources
from ..operators.extract.text_listing import submissions
from ..schema import CANDIDATE, conform
from ..settings import DEFAULT, Settings
from ..sources import history as h, registry as reg, stored as st


@dataclass(frozen=True)
class Run:
    """What a run produced, before anything is written."""
    publish_set: DataFrame
    decision: DataFrame
    fingerprints: DataFrame
    diff: DataFrame
    rejected: DataFrame
    outcomes: DataFrame
    findings: DataFrame
    drifts: DataFrame
    stages: DataFrame
    completeness: DataFrame


class Refused(ValueError):
    """A write that error findings forbid."""


def guarded_write(rows: DataFrame, findings: DataFrame, path: str) -> int:
    """Write listings unless a finding is an error; the message names the first rules."""
    errors = findings.filter("severity = 'error'").groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").limit(10).collect()
    if errors:
        raise Refused("not written: " + ", ".join(f"{r['rule']} x{r['n']}" for r in errors))
    return st.write_listings(rows, path)


@dataclass(frozen=True)
class Checked:
    """A publish set with the findings on it and its difference to what is stored."""
    rows: DataFrame
    findings: DataFrame
    diff: DataFrame

    def write(self, path: str) -> int:
        """Write the rows as a new version; raises ``Refused`` where a finding is an error."""
        return guarded_write(self.rows, self.findings, path)


def prepare(candidates: DataFrame, registry: DataFrame, venues: DataFrame, cache: DataFrame, as_of,
            settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Clean, judge and deduplicate. Returns (accepted and merged, rejected with reasons)."""
    cleaned = dedup.keep(normalise.enhance(candidates, venues, cache, settings))
    accepted, rejected = normalise.validate(cleaned, as_of)
    return dedup.deduplicate(accepted, registry), rejected


def daily_run(captures: DataFrame, registry: DataFrame, venues: DataFrame, cache: DataFrame, stored: DataFrame, history: DataFrame,
              as_of, as_of_utc, *, is_ci: bool = False, settings: Settings = DEFAULT, mode: str | None = None,
              force: bool = False, enforce_drift: bool = False) -> Run:
    candidates = dedup.keep(extract_all(captures, registry, settings, as_of))
    cleaned = dedup.keep(normalise.enhance(candidates, venues, cache, settings))
    accepted, rejected = normalise.validate(cleaned, as_of)
    merged = dedup.keep(dedup.deduplicate(accepted, registry))
    unique = publish.second_pass(merged, registry)
    listed, _ = publish.promote(unique, as_of_utc)
    fresh = dedup.keep(listed)
    skipped = reg.skipped_in_ci(registry) if is_ci else registry.select("name").limit(0)
    kept = publish.preserved_rows(stored, registry, skipped, fresh.select("source_name").distinct(),
                                  reg.run_order(registry, is_ci).select("name"), as_of)
    final = dedup.keep(publish.publish_set(fresh, kept, registry))
    of = quality.publish_state(final, as_of)
    shapes = dedup.keep(quality.state.shapes(of))
    findings = quality.rule_findings(of)
    drifts = quality.check_drift(shapes, history, registry.filter("status = 'active'"))
    decision = quality.gate(of, findings, drifts, stored, mode=mode, force=force, enforce_drift=enforce_drift)
    # every frame counted here is stored already
    stages = monitors.stage_counts(scraped=candidates, validated=accepted, deduplicated=merged, final=final)
    seen = checks.completeness(announced_pages(captures, registry))
    return Run(final, dedup.keep(decision), shapes, publish.diff_snapshots(stored, final), rejected,
               checks.source_outcomes(captures, candidates, failed_sources(captures, registry), seen.filter("pages_missing > 0")), findings, drifts, stages, seen)


def run_record(run: Run, run_id: str, duration_s: float | None = None) -> DataFrame:
    """One row about a run, whether it was published or not. Lists hold one entry per source, stage or reason."""
    pairs = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(name))
    scrapers = monitors.run_errors(run.outcomes, run_id)
    counts = run.stages.agg(F.map_from_entries(F.collect_list(F.struct("stage", "rows"))).alias("counts"))
    blocking = run.decision.select(F.struct(F.when(F.col("blocking"), "block").otherwise("pass").alias("decision")).alias("gate"))
    one = scrapers.join(counts).join(pairs(run.rejected, "reject_reason", "rejected")).join(pairs(run.diff, "change", "diff")).join(blocking)          # five one-row frames
    return one.select("run_id", F.lit(duration_s).cast("double").alias("duration_s"), "scrapers", "counts", "rejected", "diff", "gate")


def commit_run(run: Run, history: DataFrame, run_id: str, listings_path: str, history_path: str, quarantine_root: str,
               runs_path: str | None = None) -> bool:
    """Publish a passing run and extend the history, or quarantine it. Returns whether it was published.

    Paths name new versions, so a reader never sees a half-written table. ``runs_path`` gets a record of either outcome.
    """
    if runs_path:
        run_record(run, run_id).write.mode("append").parquet(runs_path)
    if run.decision.first()["blocking"]:
        target = h.write_quarantine(run.publish_set, run.decision, quality.report(run.decision), quarantine_root, run_id)
        # the decision lists the worst findings; these are all of them
        run.findings.write.mode("errorifexists").parquet(f"{target}/findings")
        run.drifts.write.mode("errorifexists").parquet(f"{target}/drifts")
        return False
    st.write_listings(run.publish_set, listings_path)
    h.append_fingerprints(history, run.fingerprints, run_id).write.mode("errorifexists").parquet(history_path)
    return True


def dry_run(candidates: DataFrame, source: str, registry: DataFrame, venues: DataFrame, cache: DataFrame, history: DataFrame, as_of,
            settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One source through the pipeline without writing: (rows, findings, drift)."""
    rows, _ = prepare(candidates.filter(F.col("source_name") == source), registry, venues, cache, as_of, settings)
    rows = dedup.keep(rows)
    return rows, quality.check_invariants(rows, as_of), quality.check_drift(quality.fingerprints(rows), history, scope=[source])


@dataclass(frozen=True)
class AfterRun:
    """What a published run leaves to do: the picks that still hold, who is stale, whose volume fell, and the volumes of this run."""
    picks: DataFrame
    freshness: DataFrame
    volume: DataFrame
    volumes: DataFrame


def after_run(published: DataFrame, picks: DataFrame, volumes: DataFrame, registry: DataFrame, run_id: str, as_of, as_of_utc) -> AfterRun:
    """Pick pruning and both monitors on what is published. ``volumes(run_id, source, events)`` are those of earlier runs."""
    now = published.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("events"))
    return AfterRun(serve.prune_picks(picks, published, as_of, by_day=True), monitors.freshness_monitor(published, registry, as_of_utc),
                    monitors.volume_monitor(published, monitors.volume_history(volumes), registry),
                    now.select(F.lit(run_id).alias("run_id"), "source", "events"))


def repair(candidates: DataFrame, source: str, registry: DataFrame, venues: DataFrame, cache: DataFrame, stored: DataFrame, as_of, as_of_utc,
           settings: Settings = DEFAULT) -> Checked:
    """Splice one source in and leave the others alone."""
    merged, _ = prepare(candidates.filter(F.col("source_name") == source), registry, venues, cache, as_of, settings)
    fresh, _ = publish.promote(merged, as_of_utc)
    others = stored.filter(~F.col("source_name").eqNullSafe(F.lit(source)))
    final = dedup.keep(publish.publish_set(fresh, others, registry))
    return Checked(final, dedup.keep(quality.check_invariants(final, as_of)), publish.diff_snapshots(stored, final))


def refresh_local(candidates: DataFrame, registry: DataFrame, venues: DataFrame, cache: DataFrame, stored: DataFrame, as_of, as_of_utc,
                  settings: Settings = DEFAULT) -> Checked:
    """Replace only the sources that produced something; the findings are those on the new rows."""
    merged, _ = prepare(candidates, registry, venues, cache, as_of, settings)
    listed, _ = publish.promote(merged, as_of_utc)
    fresh = dedup.keep(listed)
    final = dedup.keep(publish.publish_set(fresh, publish.replace_sources(stored, fresh), registry))
    return Checked(final, dedup.keep(quality.check_invariants(fresh, as_of)), publish.diff_snapshots(stored, final))


def sync_submissions(pending: DataFrame, registry: DataFrame, venues: DataFrame, cache: DataFrame, stored: DataFrame, as_of, as_of_utc,
                     settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Publish pending reader submissions: (rows to add, sheet rows that were read). An undated row stays unread."""
    read = dedup.keep(submissions(pending, settings))
    merged, _ = prepare(conform(read, CANDIDATE), registry, venues, cache, as_of, settings)
    listed, _ = publish.promote(merged, as_of_utc)
    return publish.new_submissions(listed, stored), read.select("row_index")
