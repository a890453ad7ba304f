"""Row shapes and fixed vocabularies."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# --- fixed values ----------------------------------------------------------
CATEGORIES = ("music", "arts and culture", "food and drink", "theater",
              "lectures", "sports", "community", "other")
KIND_RANK = {"requests": 0, "playwright": 1, "aggregator": 2, "manual": 3}
STATUSES = ("active", "blocked", "retired")
UNKNOWN_SOURCE_RANK = KIND_RANK["aggregator"]
USER_SUBMITTED = "User Submitted"
REQUIRED_FIELDS = ("title", "description", "start_datetime", "source_url", "source_name")
TRACKED_FIELDS = ("title", "start_datetime", "end_datetime", "venue_name",
                  "category", "cost", "image_url", "description")
FIELD_LIMITS = {"title": 200, "description": 2000, "venue_name": 150, "street_address": 200,
                "city": 50, "state": 2, "zip_code": 10}
# ---------------------------------------------------------------------------

_S, _B, _D = T.StringType(), T.BooleanType(), T.DoubleType()
_TS = T.TimestampNTZType()

CANDIDATE = T.StructType([
    T.StructField("title", _S), T.StructField("description", _S),
    T.StructField("start_datetime", _TS), T.StructField("end_datetime", _TS),
    T.StructField("all_day", _B),
    T.StructField("venue_name", _S), T.StructField("street_address", _S),
    T.StructField("city", _S), T.StructField("state", _S), T.StructField("zip_code", _S),
    T.StructField("latitude", _D), T.StructField("longitude", _D),
    T.StructField("category", _S), T.StructField("tags", T.ArrayType(_S)),
    T.StructField("family_friendly", _B), T.StructField("age_restrictions", _S),
    T.StructField("cost", _S), T.StructField("registration_required", _B),
    T.StructField("source_url", _S), T.StructField("source_name", _S),
    T.StructField("contact_email", _S), T.StructField("contact_phone", _S),
    T.StructField("website_url", _S), T.StructField("image_url", _S),
    T.StructField("recurring_pattern", T.MapType(_S, _S)),
    T.StructField("arrival_ix", T.LongType()),
])

LISTING = T.StructType(
    [T.StructField("id", _S)]
    + CANDIDATE.fields
    + [T.StructField("scraped_at", _TS), T.StructField("last_updated", _TS),
       T.StructField("featured", _B)])

REGISTRY = T.StructType([
    T.StructField("name", _S), T.StructField("kind", _S), T.StructField("adapter", _S),
    T.StructField("url", _S), T.StructField("params", T.MapType(_S, _S)),
    T.StructField("venue", T.StructType([T.StructField(n, _S) for n in ("name", "street", "city", "zip", "state")])),
    T.StructField("module", _S), T.StructField("class", _S),
    T.StructField("runs_in_ci", _B), T.StructField("status", _S),
    T.StructField("notes", _S), T.StructField("slug", _S),
    T.StructField("rank", T.IntegerType()), T.StructField("is_scraped", _B),
])

CAPTURE = T.StructType([
    T.StructField("run_id", _S), T.StructField("source_name", _S), T.StructField("seq", T.IntegerType()),
    T.StructField("url", _S), T.StructField("final_url", _S), T.StructField("status", T.IntegerType()),
    T.StructField("content_type", _S), T.StructField("fetched_at", _TS), T.StructField("body", _S),
])

FINGERPRINT = T.StructType([
    T.StructField("source", _S), T.StructField("events", T.LongType()),
    T.StructField("date_span_days", T.IntegerType()), T.StructField("max_events_one_day", T.LongType()),
    T.StructField("max_events_one_timestamp", T.LongType()), T.StructField("distinct_titles_ratio", _D),
    T.StructField("distinct_venues", T.LongType()), T.StructField("distinct_images_ratio", _D),
    T.StructField("median_description_len", T.IntegerType()), T.StructField("null_venue_rate", _D),
    T.StructField("earliest_start", T.DateType()), T.StructField("latest_start", T.DateType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``: absent columns become typed nulls, flags become false."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "tags":
            cols.append(F.array().cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.lit(False).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def missing(col):
    """The data model treats null and the empty string alike; blanks are values."""
    return col.isNull() | (col == "")
