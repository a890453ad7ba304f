"""Run history: fingerprints per source and run, run records, quarantine, reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from ..schema import FINGERPRINT
from .stored import _exists

MAX_HISTORY = 30
MAX_RUNS = 90


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Past fingerprints; a missing or unreadable store is an empty history."""
    empty = spark.createDataFrame([], FINGERPRINT.add("run_id", "string") if "run_id" not in FINGERPRINT.names else FINGERPRINT)
    if not _exists(spark, path):
        return empty
    try:
        return spark.read.parquet(path)
    except Exception as error:                       # AnalysisException: nothing readable there
        if "UNABLE_TO_INFER_SCHEMA" in str(error) or "CANNOT_READ" in str(error):
            return empty
        raise


def latest_per_source(history: DataFrame, keep: int = MAX_HISTORY, key: str = "source", order: str = "run_id") -> DataFrame:
    """The last ``keep`` runs of every source. The limit is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return history.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def append_fingerprints(history: DataFrame, current: DataFrame, run_id: str, keep: int = MAX_HISTORY) -> DataFrame:
    """History after a run that passed the gate. A rejected run must never reach this."""
    return latest_per_source(history.unionByName(current.withColumn("run_id", F.lit(run_id)), allowMissingColumns=True), keep)


def reset_fingerprints(history: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forget named sources. Returns (history without them, runs dropped per source)."""
    names = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    dropped = history.join(names, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("runs_dropped"))
    return history.join(names, "source", "left_anti"), dropped


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(limit)


def prune_runs(runs: DataFrame, keep: int = MAX_RUNS) -> DataFrame:
    return recent_runs(runs, keep)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def run_summary(runs: DataFrame) -> DataFrame:
    """One line per run: decision, rows, sources that worked, time, changes."""
    ok = F.size(F.filter("scrapers", lambda s: s["status"] == "ok"))
    failed = F.transform(F.filter("scrapers", lambda s: s["status"] == "failed"), lambda s: s["source"])
    return runs.select(
        "run_id", F.coalesce(F.col("gate.decision"), F.lit("?")).alias("decision"),
        F.coalesce(F.try_element_at("counts", F.lit("final")), F.lit(0)).alias("final"),
        ok.alias("ok"), F.size("scrapers").alias("sources"), failed.alias("failed"), "duration_s",
        *[F.coalesce(F.try_element_at("diff", F.lit(k)), F.lit(0)).alias(k) for k in ("added", "removed", "changed")])


def write_quarantine(rows: DataFrame, decision: DataFrame, report: DataFrame, root: str, run_id: str) -> str:
    """Keep a rejected run as evidence: rows, the decision as JSON, and the report text."""
    target = f"{root.rstrip('/')}/run_id={run_id}"
    rows.write.mode("errorifexists").parquet(f"{target}/rows")
    decision.write.mode("errorifexists").json(f"{target}/decision")
    report.select("report").write.mode("errorifexists").text(f"{target}/report")
    return target


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)
