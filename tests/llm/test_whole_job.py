"""Cases that an operator once cut short, each against plain Python."""
import collections
import random

from noticeboard.llm import language_id, line_dedup, ngram_join

from .test_operators import brute_components, prose


def whole_lines(docs, short=0):
    """Lines kept by brute force with the shingles of every position; lines of ``short`` to MIN_CHARS characters by identity alone."""
    places = collections.defaultdict(list)
    for k, t in set(docs):
        for p, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS or short and line.strip():
                places[line].append((k, t, p))
    lines = list(places)
    n = line_dedup.SHINGLE
    sets = [{x[i:i + n] for i in range(len(x) - n + 1)} if len(x.strip(" ")) >= line_dedup.MIN_CHARS else set() for x in map(str.lower, lines)]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(lines):
        first[find(i)] = min(first.get(find(i), min(places[line])), min(places[line]))
    of = {line: first[find(i)] for i, line in enumerate(lines)}
    return {(k, "\n".join(x for p, x in enumerate(t.split("\n")) if of.get(x, (k, t, p)) == (k, t, p))) for k, t in docs}


def unspaced(seed, n):
    r = random.Random(seed)
    return "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))


def line_cases():
    same, script = unspaced(1, 400), unspaced(2, 80)
    lines = [f"https://www.example.org/{unspaced(i, 3)}/{random.Random(i).getrandbits(160):040x}" for i in range(12)]          # one beginning, different
    lines += [script[:14] + unspaced(20 + i, 40) for i in range(6)]
    lines += ["https://www.example.org/" + same, "http://mirror.site.net/" + same + "x"] + [script + "A", script + "b", "\U0001F600" * 3 + script]       # alike behind different beginnings
    lines += [f"{prose(40 + i, 5)} at https://www.example.org/recipes/all/some-long-path-of-a-page?x=1" for i in range(3)]
    lines += [prose(60, 30), prose(60, 30).upper(), prose(61, 30)]
    return [(i, line + "\n" + prose(300 + i, 14)) for i, line in enumerate(lines)]


def test_hashes_of_shingles_without_a_pattern(spark, capsys):
    """The bytes of a line give the hashes that the pattern gives, whatever characters it has, and no pattern is run at every place."""
    from pyspark.sql import functions as F
    texts = [x for _, t in line_cases() for x in t.split("\n")] + ["x" * 11, "x" * 12, "", "\u00e9" * 12, "I\u0130" * 30, "Caf\u00e9 " * 300, "ab\u2026\U0001F600" * 400, prose(5, 900), None]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    quick = line_dedup.hash_rows(lines, every_position=True)
    slow = lines.select("id", F.explode(line_dedup.shingles(F.col("line"), True)).alias("s")).select("id", F.xxhash64("s").alias("h"))
    assert {tuple(r) for r in quick.collect()} == {tuple(r) for r in slow.collect()} != set()
    quick.explain(True)
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_line_dedup_looks_at_every_character(make):
    docs = line_cases()
    got = line_dedup.dedup_lines(make(docs), every_position=True).collect()
    assert {(x["doc_id"], x["text"]) for x in got} == whole_lines(docs)
    removed = {x["doc_id"] for x in got if x["n_removed"]}
    assert not removed & set(range(18)) and {19, 21, 22, 27} <= removed


def test_line_dedup_takes_short_repeats(make):
    docs = [(i, "\n".join(["Share this", prose(500 + i, 14), "", " ", "Cookie policy" if i % 2 else f"page {i}", "Share this", "\t"])) for i in range(8)] + [(50, "Share this"), (51, "share this"), (52, "x")]
    got = line_dedup.dedup_lines(make(docs), every_position=True, short_lines=True).collect()
    assert {(x["doc_id"], x["text"]) for x in got} == whole_lines(docs, short=1)
    assert sum(x["text"].split("\n").count("Share this") for x in got) == 1 and sum(x["n_removed"] for x in got) == 16 + 3


def test_line_dedup_stores_no_shingle_sets(make, monkeypatch):
    kept, write = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df: kept.append(df.columns) or write(df))
    docs = line_cases() + [(100 + i, f"{prose(700, 24 + i % 3)} {prose(701 + i, 2)}") for i in range(12)]
    got = line_dedup.dedup_lines(make(docs), every_position=True).collect()
    assert {(x["doc_id"], x["text"]) for x in got} == whole_lines(docs)
    assert kept and not any("set" in columns for columns in kept)


def test_ngram_join_null_id_among_copies(make):
    text = prose(70, 60)
    near = text.replace(" ", "  ") + " tail"
    docs = [(None, text), (6, text), (5, text), (None, near), (9, near), (None, prose(71, 60)), (30, prose(72, 60)), (None, prose(72, 60))]
    got = ngram_join.link_documents(make(docs), 5, 8, 10).collect()
    found = collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got)
    assert found == brute_components(docs, 5, 8, 10) and {x["component_id"] for x in got if x["doc_id"] in (5, 6, 9)} == {5}


def test_one_of_each_keeps_one_row_of_a_group(make):
    text, other = prose(80, 60), prose(81, 60)
    docs = [(5, text), (5, text), (5, text + " tail"), (6, text), (None, other), (None, other), (None, other + " tail"), (7, ""), (7, ""), (8, prose(82, 60)), (9, None), (None, text)]
    kept = ngram_join.one_of_each(make(docs), once=True).select("doc_id", "text", "shard").collect()
    assert len(kept) == 6 and {x["shard"] for x in kept} == {"clash"}
    assert collections.Counter(x["doc_id"] for x in kept) == {5: 1, None: 1, 7: 2, 8: 1, 9: 1}
    assert ngram_join.one_of_each(make([]), once=True).count() == 0


def test_more_languages_than_a_fixed_number(spark):
    letters = lambda lang, seed: "".join(chr(0x4E00 + 40 * lang + random.Random(seed).randrange(3)) if i % 6 else " " for i, seed in enumerate(range(seed, seed + 120)))
    labelled = [(lang * 10 + k, letters(lang, lang * 1000 + k), f"l{lang:02d}") for lang in range(70) for k in range(5 - (lang >= 64))]
    langs, table = language_id.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    assert len(langs) == 70 and table.shape[1] == 70
    pages = [(lang, f"http://h{lang % 3}.org/", f"<html lang='l{lang}'>" if lang % 2 else None, letters(lang, lang * 1000 + 500)) for lang in range(70)]
    frame = spark.createDataFrame(pages, "key long, address string, html string, text string")
    got = {r["key"]: r for r in language_id.identify(frame, langs, table).collect()}
    assert all(got[lang]["lang"] == got[lang]["text_lang"] == f"l{lang:02d}" for lang in range(70))


def test_ngram_join_hubs_and_what_they_leave_apart(make):
    """Chains and near copies that no hub joins at once, against brute force over all pairs."""
    r, docs = random.Random(8), []
    for base in range(3):
        words = [f"w{base}x{i}" for i in range(90)]
        for k in range(30):
            docs.append((base * 100 + k, " ".join(words[k // 2:] + [f"t{base}x{i}" for i in range(k // 2)])))
            docs.append((1000 + base * 100 + k, " ".join("edit%d" % r.randrange(10 ** 6) if r.random() < 0.012 else w for w in words)))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.link_documents(make(docs), 3, 90, 100).collect()}
    sets = {k: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {k: find(k) for k in sets}
