"""Stored listings: JSON in, canonical order out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.times import parse_iso
from ..schema import LISTING, conform


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


_RAW = T.StructType([
    T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
    for f in LISTING.fields if f.name != "arrival_ix"])


def read_listings_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of listings, or ``{"events": [...]}``; a missing file is an empty table.

    ``arrival_ix`` numbers the rows from zero by file and place in it; how the files are split does not matter.

    Times keep their text in ``*_raw`` columns too, for the checks that judge the text.
    ``lines=True`` reads newline-delimited JSON, which Spark can split; a single
    JSON document is one task by nature.
    """
    if not _exists(spark, path):
        return _typed(spark.createDataFrame([], _RAW))
    wrapped = T.StructType(_RAW.fields + [T.StructField("events", T.ArrayType(_RAW))])
    raw = spark.read.schema(wrapped).json(path, multiLine=not lines)
    rows = F.coalesce(F.col("events"), F.array(F.struct(*[F.col(f.name) for f in _RAW.fields])))
    placed = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_nth"), F.posexplode(rows).alias("_pos", "r"))
    return _typed(placed.select("r.*", F.struct("_file", "_at", "_nth", "_pos").alias("_place")))


def _typed(raw: DataFrame) -> DataFrame:
    from ..operators.normalise import number_rows
    times = [f.name for f in LISTING.fields if isinstance(f.dataType, T.TimestampNTZType)]
    out = raw
    for name in ("start_datetime", "end_datetime"):
        out = out.withColumn(f"{name}_raw", F.col(name))
    for name in times:
        out = out.withColumn(name, parse_iso(F.col(name)))
    for f in LISTING.fields:
        if isinstance(f.dataType, T.BooleanType):
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(False)))
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if "_place" not in out.columns:
        return out.withColumn("arrival_ix", F.lit(0).cast("bigint"))
    # by file and place in it, however the files are split
    return number_rows(out, "_place").withColumn("arrival_ix", F.col("n").cast("bigint")).drop("_place", "n")


def canonical_order(df: DataFrame) -> DataFrame:
    """Chronological, then by id."""
    return df.orderBy(F.col("start_datetime").asc_nulls_first(), F.col("id").asc_nulls_first())


def write_listings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> int:
    """Write in canonical order across files (range partitions) and within them; returns the count."""
    from pyspark.sql import Observation
    seen = Observation()
    # counted behind the range shuffle, whose sampling reads the input once more
    ordered = (df.repartitionByRange("start_datetime", "id").sortWithinPartitions("start_datetime", "id")
               .observe(seen, F.count(F.lit(1)).alias("rows")))
    ordered.write.mode(mode).format(fmt).save(path)
    return int(seen.get["rows"])


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], LISTING)
    return conform(spark.read.parquet(path), LISTING)


def read_picks(spark: SparkSession, paths: list[str], enabled: bool = True) -> DataFrame:
    """The first of several stores that exists; empty when the feature is off."""
    schema = "title string, source_name string"
    if enabled:
        for path in paths:
            if _exists(spark, path):
                return spark.read.schema(schema).parquet(path).select("title", "source_name")
    return spark.createDataFrame([], schema)
