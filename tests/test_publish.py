import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest

from noticeboard.operators.publish import reconcile, second_pass
from noticeboard.schema import KIND_RANK
from noticeboard.sources.registry import registry_frame

from test_dedup import T0, alike, frame

KINDS = {"A": "requests", "B": "playwright", "C": "aggregator", "D": "requests", "User Submitted": "manual"}
RECORDS = [{"name": n, "kind": k, "adapter": "ical"} for n, k in KINDS.items()]


def rank(n):
    return KIND_RANK[KINDS[n]]


def rows(seed, n, sources):
    r = random.Random(seed)
    titles = ["Jazz Night", "Jazz Nights", "Late Jazz Night", "Jazz Fright", "Open Mic", "Open Mics Here", "Story Time", "story tim", "X"]
    return [{"source_name": r.choice(sources), "title": r.choice(titles), "venue_name": r.choice([None, "Main Hall", "The Main Hall", "Club"]),
             "description": "d" * r.choice([10, 20, 30]), "start_datetime": T0 + timedelta(minutes=r.choice([0, 0, 30, 60, 90, 250, 290, 310]))} for _ in range(n)]


@pytest.mark.parametrize("largest", [None, 0])
def test_second_pass_equals_the_sequential_rule(spark, largest):
    registry = registry_frame(spark, RECORDS)
    data = rows(5, 70, list("ABCD"))
    gone = set()
    for i, a in enumerate(data):
        if i in gone:
            continue
        for j in range(i + 1, len(data)):
            b = data[j]
            if j in gone or a["source_name"] == b["source_name"] or a["start_datetime"].date() != b["start_datetime"].date():
                continue
            if abs((a["start_datetime"] - b["start_datetime"]).total_seconds()) > 3600:
                continue
            va, vb = (" ".join((x["venue_name"] or "").lower().split()) for x in (a, b))
            if va and vb and SequenceMatcher(None, va, vb).ratio() < .7:
                continue
            if SequenceMatcher(None, a["title"].lower(), b["title"].lower()).ratio() >= .7:
                key = lambda e: (rank(e["source_name"]), -len(e["description"]))
                lose = j if key(a) <= key(b) else i
                gone.add(lose)
                if lose == i:
                    break
    got = {r["arrival_ix"] for r in second_pass(frame(spark, data).repartition(5), registry, largest).collect()}
    assert got == set(range(len(data))) - gone


@pytest.mark.parametrize("largest", [None, 0])
def test_reconcile_equals_the_sequential_rule(spark, largest):
    registry = registry_frame(spark, RECORDS)
    fresh, old = rows(7, 50, list("ABC")), rows(8, 40, ["B", "C", "D", "User Submitted"])
    lost_f, lost_p = set(), set()
    for p, a in enumerate(old):
        order = sorted(range(len(fresh)), key=lambda i: (fresh[i]["start_datetime"].date(), i))
        for f in order:
            if f in lost_f or not alike(a, fresh[f]):
                continue
            if a["source_name"] == "User Submitted" or rank(a["source_name"]) < rank(fresh[f]["source_name"]):
                lost_f.add(f)
            else:
                lost_p.add(p)
                break
    got_f, got_p = reconcile(frame(spark, fresh), frame(spark, old), registry, largest)
    assert {r["arrival_ix"] for r in got_f.collect()} == set(range(len(fresh))) - lost_f
    assert {r["arrival_ix"] for r in got_p.collect()} == set(range(len(old))) - lost_p
    assert datetime(2026, 10, 6, 19) == T0
