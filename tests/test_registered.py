"""A few registered queries against their SQL twins, at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

SF = "/root/testdata/sf0.001"
NAMES = ("fingerprint_by_source", "invariant_uniform", "drift_all", "stats", "ranked_page", "digest_lines", "reject_reason", "content_id",
         "gazetteer_match", "resolve_places", "snapshot_diff", "preserve_and_rescue", "interval_pairs", "venue_pages", "ics_export", "feed_tribe", "page_platform_scores")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
