"""The source registry: a few hundred hand-kept records, read and checked on the driver."""
from __future__ import annotations

from pathlib import Path
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import KIND_RANK, REGISTRY, STATUSES, UNKNOWN_SOURCE_RANK, USER_SUBMITTED

# --- fixed values: how each platform is fetched, where the record does not say ---
PLATFORM_KIND = {"tribe": "requests", "squarespace": "requests", "localist": "requests",
                 "ical": "requests", "jsonld": "requests", "eventon": "requests",
                 "assabet": "requests", "drupal_listing": "requests", "indiecommerce": "playwright"}
# ---------------------------------------------------------------------------------

MAX_REGISTRY_ROWS = 100_000     # what makes broadcasting the registry safe; checked on load


def registry_rows(records: Iterable[dict]) -> list[tuple]:
    """Validate records and add the built-in reader-submission source."""
    rows, names = [], set()
    for rec in records:
        where = rec.get("slug") or "?"
        name = rec.get("name")
        if not name:
            raise ValueError(f"{where}: missing `name`")
        adapter = rec.get("adapter")
        if adapter == "custom" and not (rec.get("module") and rec.get("class")):
            raise ValueError(f"{where}: a custom source needs `module` and `class`")
        status = rec.get("status", "active")
        if status not in STATUSES:
            raise ValueError(f"{where}: status must be one of {STATUSES}")
        kind = rec.get("kind") or PLATFORM_KIND.get(adapter, "requests")
        if kind not in KIND_RANK:
            raise ValueError(f"{where}: kind must be one of {tuple(KIND_RANK)}")
        if name in names:
            raise ValueError(f"source names must be unique; repeated: {name!r}")
        names.add(name)
        venue = rec.get("venue") or {}
        scraped = status == "active" and kind != "manual" and bool(adapter or rec.get("class"))
        params = {str(k): v if isinstance(v, str) else _plain(v) for k, v in (rec.get("params") or {}).items()}
        rows.append((name, kind, adapter, rec.get("url"), params,
                     tuple(venue.get(k) for k in ("name", "street", "city", "zip", "state")),
                     rec.get("module"), rec.get("class"), bool(rec.get("runs_in_ci", True)), status,
                     (rec.get("notes") or "").strip(), rec.get("slug"), KIND_RANK[kind], scraped))
    if USER_SUBMITTED not in names:
        rows.append((USER_SUBMITTED, "manual", None, None, {}, (None,) * 5, None, None, True, "active",
                     "reader submissions", "user-submitted", KIND_RANK["manual"], False))
    if len(rows) > MAX_REGISTRY_ROWS:
        raise ValueError(f"{len(rows)} registry records; the limit that keeps the broadcast small is {MAX_REGISTRY_ROWS}")
    return rows


def _plain(value) -> str:
    import json
    return json.dumps(value)


PATTERN_PARAMS = ("exclude",)


def check_patterns(spark: SparkSession, rows: list[tuple]) -> None:
    """Patterns of the registry are compiled once here, so that a bad one names its source instead of failing a job."""
    import json
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    for name, params in ((r[0], r[4]) for r in rows):
        for key in PATTERN_PARAMS:
            for pattern in json.loads(params.get(key) or "[]"):
                try:
                    compile_(pattern)
                except Exception as error:
                    raise ValueError(f"{name}: `{key}` has a pattern that cannot be read: {pattern!r}") from error


def registry_frame(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    rows = registry_rows(records)
    check_patterns(spark, rows)
    return spark.createDataFrame(rows, REGISTRY)


def load_registry(spark: SparkSession, folder: str | Path) -> DataFrame:
    """One YAML file per source; files whose name starts with ``_`` are notes."""
    import yaml
    records = []
    for path in sorted(Path(folder).glob("*.yaml")):
        if not path.name.startswith("_"):
            records.append({**(yaml.safe_load(path.read_text()) or {}), "slug": path.stem})
    return registry_frame(spark, records)


# --- selections -------------------------------------------------------------------

def run_order(registry: DataFrame, is_ci: bool = False) -> DataFrame:
    """Scraped sources, cheapest transport first; ``run_position`` defines arrival order."""
    runnable = registry.filter(F.col("is_scraped"))
    if is_ci:
        runnable = runnable.filter(F.col("runs_in_ci"))
    return runnable.orderBy("rank", "slug")


def skipped_in_ci(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("is_scraped") & ~F.col("runs_in_ci")).select("name")


local_only = skipped_in_ci


def blocked(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "blocked").select("name")


def preserved_always(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("kind") == "manual").select("name")


def with_source_rank(df: DataFrame, registry: DataFrame, column: str = "source_name") -> DataFrame:
    """Add ``source_rank`` and ``source_manual``; a name the registry does not list ranks as an aggregator."""
    ranks = registry.select(F.col("name").alias(column), F.col("rank").alias("source_rank"), (F.col("kind") == "manual").alias("source_manual"))
    return (df.join(ranks, column, "left")
            .withColumn("source_rank", F.coalesce("source_rank", F.lit(UNKNOWN_SOURCE_RANK)))
            .withColumn("source_manual", F.coalesce("source_manual", F.lit(False))))
