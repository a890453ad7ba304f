import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from noticeboard.functions import similarity
from noticeboard.functions.similarity import title_links
from noticeboard.operators import replay
from noticeboard.operators.dedup import assign_groups, deduplicate, interval_pair_counts, pair_stages
from noticeboard.schema import CANDIDATE, conform
from noticeboard.sources.registry import registry_frame

T0 = datetime(2026, 10, 6, 19, 0)


def frame(spark, rows):
    data = [{"arrival_ix": i, "description": "d" * 12, **r} for i, r in enumerate(rows)]
    schema = ("arrival_ix long, source_name string, title string, venue_name string, start_datetime timestamp_ntz, "
              "description string, latitude double, longitude double, category string, image_url string, tags array<string>")
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)
    return conform(df, CANDIDATE)


def fold(title):
    kept = "".join(c for c in (title or "").lower() if c.isalnum() or c == "_" or c.isspace())
    return " ".join(kept.split())


def alike(a, b):
    ta, tb = fold(a["title"]), fold(b["title"])
    va, vb = " ".join((a.get("venue_name") or "").lower().split()), " ".join((b.get("venue_name") or "").lower().split())
    gap = abs((a["start_datetime"] - b["start_datetime"]).total_seconds())
    if a["source_name"] == b["source_name"]:
        return gap == 0 and ta == tb and (not va or not vb or va == vb)
    if gap > 3600:
        return False
    if va and vb and SequenceMatcher(None, va, vb).ratio() < .7:
        return False
    if SequenceMatcher(None, ta, tb).ratio() >= .85:
        return True
    short, long_ = sorted((ta, tb), key=len)
    return bool(va and vb) and len(short) >= 8 and short in long_


def brute_groups(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["start_datetime"], i))
    leader = {}
    for n, i in enumerate(order):
        if i in leader:
            continue
        leader[i] = i
        for j in order[n + 1:]:
            if j not in leader and alike(rows[i], rows[j]):
                leader[j] = i
    return leader


def random_rows(seed, n):
    r = random.Random(seed)
    titles = ["Jazz Night", "Jazz Nights", "Jazz Night!", "Late Jazz Night", "Global Arts presents Jazz Night", "Tap Level 1",
              "Tap Level 2", "Tap Level One", "Story Time", "Story time for kids", "Story", "Open Mic", "Open Mics", "Mic", "A", "", "AB"]
    venues = [None, "", "Main Hall", "The Main Hall", "Main  hall", "Branch Library", "West Branch Library", "Club"]
    return [{"source_name": r.choice("ABCD"), "title": r.choice(titles), "venue_name": r.choice(venues),
             "start_datetime": T0 + timedelta(minutes=r.choice([0, 0, 0, 15, 30, 60, 61, 90, 120, 240]))} for _ in range(n)]


def test_sweep_equals_the_sequential_rule_on_random_rows(spark):
    for seed, n in ((1, 60), (3, 300)):
        rows = random_rows(seed, n)
        got = {r["arrival_ix"]: r["group_ix"] for r in
               assign_groups(frame(spark, rows).repartition(7)).select("arrival_ix", "group_ix").collect()}
        assert got == brute_groups(rows)


def test_large_components_settled_by_rounds_give_the_same_groups(spark):
    rows = random_rows(5, 120)
    got = {r["arrival_ix"]: r["group_ix"] for r in assign_groups(frame(spark, rows), largest=0).select("arrival_ix", "group_ix").collect()}
    assert got == brute_groups(rows)


def test_a_chain_of_a_thousand_rows_takes_few_rounds(spark, monkeypatch):
    """Each row matches only its neighbours, so every decision hangs on the one before."""
    rows = [dict(source_name="AB"[i % 2], title="Jazz Night", venue_name="Hall", start_datetime=T0 + timedelta(minutes=40 * i)) for i in range(1000)]
    kept, plain = [], replay.keep
    monkeypatch.setattr(replay, "keep", lambda df: kept.append(1) or plain(df))
    got = {r["arrival_ix"]: r["group_ix"] for r in assign_groups(frame(spark, rows)).select("arrival_ix", "group_ix").collect()}
    assert got == {i: i - i % 2 for i in range(1000)} == brute_groups(rows)
    assert len(kept) <= 16                                            # rounds of the labelling, logarithmic in the chain


def test_labels_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7001, 7000), (7002, 7001)]
    got = dict(replay.label_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k for k, v in got.items() if v == 0} == set(range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert got[5000] == 5000 and got[7002] == 7000 and replay.label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts_of(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "tid long, t string")


def test_links_lose_no_pair(spark):
    """Index, filters and anchors against comparing everything with everything."""
    r = random.Random(8)
    words = "night jazz story time for kids open mic global arts presents the late hall brad trio".split()
    texts = {" ".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(60)}
    texts |= {t[:k] + r.choice("abc xyz") + t[k + r.randrange(3):] for t in list(texts) for k in [r.randrange(len(t) + 1)]}
    long_ = " ".join(r.choice(words) for _ in range(60))
    texts |= {long_, long_.replace("jazz", "jass"), "prefix " + long_, "", "a", "b", "ab", "ba", "é\U0001F600", "é\U0001F601", "aaaaaaaa", "aaaaaaaaa", "x" * 300, "x" * 280}
    texts = sorted(texts)
    hours = spark.createDataFrame([(h, i) for i in range(len(texts)) for h in ((0,) if i % 3 else (0, 1, 5))], "hour long, tid long")
    at = {i: ((0,) if i % 3 else (0, 1, 5)) for i in range(len(texts))}
    for threshold, q in ((0.85, 2), (0.7, 1)):
        got = {(x["hour"], x["a"], x["b"]): (x["near"], x["contained"]) for x in title_links(hours, hours, texts_of(spark, texts), threshold, q, contain=True, offsets=(-1, 0, 1)).collect()}
        want = {}
        for a, x in enumerate(texts):
            for b, y in enumerate(texts):
                near = SequenceMatcher(None, x, y).ratio() >= threshold
                short, long_one = sorted((x, y), key=len)
                held = len(short) >= 8 and short in long_one
                if a != b and (near or held):
                    want |= {(h, a, b): (near, held) for h in at[b] if any(abs(h - g) <= 1 for g in at[a])}
        assert got == want


def test_common_words_leave_few_ratios():
    """Titles behind one long phrase share most of their pairs of letters; filters, not ratios, tell them apart."""
    r = random.Random(4)
    digits = lambda: "".join(r.choice("0123456789abcdef") for _ in range(64))
    texts = ["the house of music proudly presents " + digits() for _ in range(150)] + [digits() for _ in range(150)]
    texts += [t[:-3] + "xyz" for t in texts[:10]] + [texts[200] + " show", "a" * 90 + "b" * 600, "a" * 90 + "b" * 601]
    block, confirmed = similarity.Block(texts, 0.85, 2), []
    plain = block._confirm
    block._confirm = lambda a, b: confirmed.extend(a) or plain(a, b)
    every = similarity.np.arange(len(texts))
    got = set(zip(*(x.tolist() for x in block.alike(every, every))))
    assert {(i, 300 + i) for i in range(10)} | {(200, 310), (310, 200), (311, 312)} <= got and len(confirmed) <= 200
    short = similarity.Block(texts[:311], 0.85, 2)
    pairs = [(a, b) for a in range(0, 311, 5) for b in range(311) if a != b and SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.85]
    assert pairs == sorted(p for p in zip(*(x.tolist() for x in short.alike(every[:311:5], every[:311]))))


def test_an_hour_beyond_one_block_loses_no_link(spark, monkeypatch):
    words = [f"{w} {n:04d} late show" for n in range(8) for w in ("jazz night", "night of jazz", "story time for kids")] + ["0003 late show"]
    hours = spark.createDataFrame([(h, i) for i in range(len(words)) for h in (0, 1, 90)[:1 + i % 3]], "hour long, tid long")
    links = lambda: {tuple(x) for x in title_links(hours, hours, texts_of(spark, words), 0.85, 2, contain=True, offsets=(0, 1)).collect()}
    whole = links()
    one = lambda: similarity.link_stages(hours, hours, texts_of(spark, words), 0.85, 2, spark.createDataFrame([], "a long, b long, near boolean"), (0, 1)).first().asDict()
    stages = one()
    monkeypatch.setattr(similarity, "BLOCK", 4)
    assert links() == whole and len(whole) > 100 and one() == stages


def test_tiles_meet_every_pair_once():
    frame = similarity.pd.DataFrame({"side": [0, 1] * 9 + [0], "tid": range(19), "t": ["x" * (7 * i % 11) for i in range(19)]})
    met = [(a, b) for tile in similarity.tiles(frame, 4) for a in tile["tid"][tile["side"] == 0] for b in tile["tid"][tile["side"] == 1]]
    assert sorted(met) == [(a, b) for a in range(0, 19, 2) for b in range(1, 19, 2)]
    # few pairs stay in small groups, so that all cores have some; many come in large ones, so that texts are copied less
    assert similarity.group_side(10 ** 6, 8) == similarity.BLOCK and similarity.group_side(10 ** 13, 8) == similarity.TILES * similarity.BLOCK
    assert similarity.group_side(64 * 5000 ** 2, 8) == 5000


def test_common_subsequence(spark):
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randrange(0, 90))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_subsequence(similarity._letter_masks(b), len(b), a) == table[-1][-1]


def test_stages_of_the_search_are_counted(spark):
    got = pair_stages(frame(spark, random_rows(2, 80))).first()
    assert got["rows"] == 80 >= got["nodes"] >= got["classes"] and got["compared"] <= got["candidates"] and 0 < got["alike"] <= got["compared"] and got["class_pairs"] > 0


def test_greedy_is_not_transitive(spark):
    base = dict(venue_name=None)
    rows = [dict(base, source_name=s, title="Jazz Night", start_datetime=T0 + timedelta(minutes=m))
            for s, m in (("A", 0), ("B", 50), ("C", 100))]
    got = sorted((r["arrival_ix"], r["group_ix"]) for r in assign_groups(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (2, 2)]


def test_merge_prefers_the_venues_own_source_and_fills_gaps(spark):
    registry = registry_frame(spark, [{"name": "Hall", "adapter": "ical"}, {"name": "Aggregator", "kind": "aggregator", "adapter": "ical"}])
    rows = [dict(source_name="Aggregator", title="Brad Mehldau Trio", venue_name="Main Hall", start_datetime=T0,
                 description="a much longer description", latitude=1.5, longitude=2.5, tags=["x", "b"], image_url="i"),
            dict(source_name="Hall", title="Global presents Brad Mehldau Trio", venue_name="The Main Hall", start_datetime=T0, tags=["a", "b"]),
            dict(source_name="Hall", title="Something else", venue_name="Main Hall", start_datetime=T0)]
    out = {r["title"]: r for r in deduplicate(frame(spark, rows), registry).collect()}
    assert set(out) == {"Global presents Brad Mehldau Trio", "Something else"}
    m = out["Global presents Brad Mehldau Trio"]
    assert (m["source_name"], m["description"], m["latitude"], m["longitude"], m["image_url"], m["tags"]) == (
        "Hall", "a much longer description", 1.5, 2.5, "i", ["a", "b", "x"])


def test_back_to_back_sessions_of_one_source_stay_apart(spark):
    rows = [dict(source_name="S", title=f"Tap Level {n}", venue_name="Studio", start_datetime=T0 + timedelta(hours=n)) for n in (1, 2)]
    rows += [dict(source_name="S", title="Story Time", venue_name=v, start_datetime=T0) for v in ("East Branch", "West Branch")]
    assert assign_groups(frame(spark, rows)).filter("group_size > 1").count() == 0


def test_copies_fold_without_pairs(spark):
    rows = [dict(source_name="S", title="Copy", venue_name="Hall", start_datetime=T0)] * 500
    df = assign_groups(frame(spark, rows))
    assert df.select("group_ix", "group_size").distinct().collect() == [(0, 500)]
    assert interval_pair_counts(frame(spark, rows)).agg(F.sum("pairs")).first()[0] == 500 * 499 // 2
