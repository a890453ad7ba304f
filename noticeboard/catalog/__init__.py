"""Registered queries: every operator over the given tables, with its SQL twin where SQL can say it."""
from importlib import import_module

ALL: dict = {}
for _part in ("quality_queries", "serving_queries", "listing_queries", "duplicate_queries", "page_queries", "extract_queries", "run_queries"):
    ALL.update(import_module(f"{__name__}.{_part}").QUERIES)
