"""The submission sheet: fourteen text columns per row."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values ----------------------------------------------------------
COLUMNS = ("timestamp", "event_name", "date", "time", "address", "description", "category",
           "cost", "family_friendly", "event_url", "image_url", "contact_email", "approved", "uploaded")
APPROVED = ("yes", "y", "true", "1", "approved", "x")
# ---------------------------------------------------------------------------


def pending_submissions(sheet: DataFrame, require_approval: bool = False, position: str | None = None) -> DataFrame:
    """Rows not yet published (and approved, where moderation is on), padded and trimmed.

    ``position`` names a zero-based row position; the sheet row is two further on.
    """
    cols = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in sheet.columns
            else F.lit("").alias(c) for c in COLUMNS]
    row = (F.col(position) + 2) if position else F.col("row_index")
    out = sheet.select(*cols, row.cast("bigint").alias("row_index"))
    out = out.filter((F.col("event_name") != "") & ~F.lower("uploaded").startswith("yes"))
    return out.filter(F.lower("approved").isin(*APPROVED)) if require_approval else out
