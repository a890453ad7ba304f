"""Clean, enhance and judge candidates. A rejected row keeps its reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import family_friendly, food_and_drink, low_quality_title
from ..functions.text import clean_text
from ..functions.times import has_subminute, ntz
from ..schema import CATEGORIES, missing
from ..session import settled
from ..settings import DEFAULT, Settings
from .places import fill_coordinates, resolve_places

# --- fixed values ----------------------------------------------------------
MIN_TITLE, MIN_DESCRIPTION = 3, 10
PAST_DAYS, FUTURE_DAYS = 30, 730
REASONS = (
    "Title is too short", "Description is too short", "Missing start datetime",
    "Start datetime looks like a scrape timestamp, not a published time",
    "Event date is too far in the past", "Event date is too far in the future",
    "Title appears to be low quality")
BACKFILL_BATCH = 25
# ---------------------------------------------------------------------------


def clean(candidates: DataFrame) -> DataFrame:
    """Text fields cleaned; empty places become null-free or stay as they were."""
    out = candidates.withColumn("title", clean_text(F.col("title"))).withColumn("description", clean_text(F.col("description")))
    for name in ("venue_name", "street_address"):
        out = out.withColumn(name, F.when(missing(F.col(name)), F.col(name)).otherwise(clean_text(F.col(name))))
    return out


def enhance(candidates: DataFrame, venues: DataFrame, cache: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cleaned rows with city, state, family flag, food category and coordinates filled in."""
    out = resolve_places(settled(clean(candidates)), venues, cache, settings)
    city = F.when(~missing(F.col("city")), F.col("city")).otherwise(F.coalesce("place_city", F.lit(settings.default_city or None)))
    state = F.when(~missing(F.col("state")), F.col("state")).otherwise(F.lit(settings.state or None))
    family = F.coalesce("family_friendly", F.lit(False)) | family_friendly(F.col("title"), F.col("description"), F.col("start_datetime"))
    food = food_and_drink(F.col("venue_name"), F.col("source_name"), F.col("title"), F.col("description"))
    out = (out.withColumn("city", city).withColumn("state", state).withColumn("family_friendly", family)
           .withColumn("category", F.when(food, "food and drink").otherwise(F.col("category"))))
    return fill_coordinates(out).select(*candidates.columns)


def reject_reason(as_of) -> Column:
    """The first rule a row fails, in order, or null."""
    now, start = ntz(as_of), F.col("start_datetime")
    length = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    tests = (length("title") < MIN_TITLE, length("description") < MIN_DESCRIPTION, start.isNull(), has_subminute(start),
             start < now - F.expr(f"INTERVAL {PAST_DAYS} DAYS"), start > now + F.expr(f"INTERVAL {FUTURE_DAYS} DAYS"),
             low_quality_title(F.col("title")))
    return F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)])


def validate(candidates: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``). Persist the input when both are used."""
    judged = settled(settled(candidates).withColumn("reject_reason", reject_reason(as_of)))
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")


# --- backfill -----------------------------------------------------------------------

def category_worklist(listings: DataFrame) -> DataFrame:
    """Rows without a useful category, numbered in batches of 25 with their position in the batch.

    Numbers follow ``arrival_ix``: a range sort and per-partition offsets, so no
    single task ever holds the list.
    """
    todo = listings.filter(missing(F.col("category")) | (F.col("category") == "other"))
    numbered = number_rows(todo, "arrival_ix")
    line = F.concat((F.col("n") % BACKFILL_BATCH).cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit(" | "),
                    F.coalesce("venue_name", F.lit("")), F.lit(" | "), F.substring(F.coalesce("description", F.lit("")), 1, 100))
    return numbered.select("arrival_ix", (F.col("n") / BACKFILL_BATCH).cast("bigint").alias("batch"),
                           (F.col("n") % BACKFILL_BATCH).cast("int").alias("position"), line.alias("line"))


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """Consecutive numbers ``n`` from zero in order of a unique column, without a global window.

    Rows are range-partitioned; only the row count per partition goes to one place.
    """
    from pyspark.sql import Window
    from .dedup import keep
    ranged = keep(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.withColumn("off", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return (ranged.join(F.broadcast(offsets.select("_p", "off")), "_p").withColumn("n", F.col("off") + within).drop("_p", "off"))


def parse_replies(replies: DataFrame, valid=CATEGORIES) -> DataFrame:
    """Reply text per batch to ``(batch, position, label)``: lines ``position: label`` with a valid label; the last wins."""
    lines = replies.select("batch", F.posexplode(F.split("reply", "\n")).alias("line_no", "line"))
    parsed = lines.select("batch", "line_no", F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).try_cast("int").alias("position"),
                          F.lower(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias("label"))
    good = parsed.filter(F.col("label").isin(*valid) & F.col("position").between(0, BACKFILL_BATCH - 1))
    return good.groupBy("batch", "position").agg(F.max_by("label", "line_no").alias("label"))


def apply_categories(listings: DataFrame, worklist: DataFrame, labels: DataFrame) -> DataFrame:
    chosen = worklist.join(labels, ["batch", "position"]).select("arrival_ix", "label")
    return (listings.join(chosen, "arrival_ix", "left").withColumn("category", F.coalesce("label", "category")).drop("label"))


def family_worklist(listings: DataFrame, venues: tuple[str, ...]) -> DataFrame:
    """Rows at listed family venues that are not flagged yet."""
    return listings.filter(~F.coalesce("family_friendly", F.lit(False)) & F.col("venue_name").isin(*venues))


def apply_family(listings: DataFrame, yes: DataFrame) -> DataFrame:
    hits = yes.select("arrival_ix", F.lit(True).alias("_y")).distinct()
    return (listings.join(hits, "arrival_ix", "left")
            .withColumn("family_friendly", F.coalesce("_y", "family_friendly")).drop("_y"))
