"""Each operator against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from noticeboard.llm import fingerprints, language_id, line_dedup, mixing, ngram_join, packing, pii, quality_rules, sharding, token_files
from noticeboard.llm.common import components, shared_folder
from noticeboard.llm.tokens import codec, tokenizer_path

WORDS = "of the sun and moon in a river that flows by old stone walls where birds sing at dawn for all who listen".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.6 else str(r.randrange(40))) for _ in range(n))


ODD = [(None, "null id"), (1, None), (2, ""), (3, "x"), (4, "one two"), (5, prose(5, 40)), (5, prose(5, 40)), (6, prose(5, 40)), (7, "é\U0001F600 " * 30), (8, prose(8, 6000))]


def test_feistel_is_a_permutation_and_computable():
    for n in (1, 2, 3, 24, 25, 97, 1000):
        places = [sharding.locate(i, n, 24, 7) for i in range(n)]
        assert len(set(places)) == n
        assert all(sharding.row_at(s, l, n, 24, 7) == i for i, (s, l) in enumerate(places))
        counts = collections.Counter(s for s, _ in places)
        assert max(counts.values()) - min(counts[s] for s in range(min(n, 24))) <= 1


def test_shards(make):
    rows = sharding.shuffle_to_shards(make(ODD), ["doc_id", "text"], 4, 3).collect()
    assert len(rows) == len(ODD)
    assert all((r["shard"], r["slot"]) == sharding.locate(r["row_number"], len(ODD), 4, 3) for r in rows)
    assert sharding.shuffle_to_shards(make([]), ["doc_id"], 4, 3).count() == 0


def test_fingerprints(make):
    docs = [(9, prose(1, 60)), (8, prose(1, 60)), (7, prose(2, 50)), (6, ""), (5, "ab"), (4, None), (3, "é" * 3000)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(make(docs)).collect()}
    assert len(got) == len(docs)
    texts = [t or "" for _, t in docs]
    for i, (k, _) in enumerate(docs):
        edited = fingerprints.edited_text(texts[i], texts[(i + 1) % len(docs)])
        a, b, c = (fingerprints.signature(x) for x in (texts[i], edited, texts[(i + 1) % len(docs)]))
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (fingerprints.as_text(a), fingerprints.as_text(b))
        assert got[k]["near_edited"] == fingerprints.likeness(a, b) and got[k]["near_next"] == fingerprints.likeness(a, c)
    assert got[9]["fingerprint"] == got[8]["fingerprint"] and got[9]["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(make([])).count() == 0


def test_fingerprints_follow_order_and_repeats():
    text = prose(3, 400)
    near = text.replace("river", "stream", 1)
    swapped = text[len(text) // 2:] + text[:len(text) // 2]
    like = lambda a, b: fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b))
    assert like(text, near) > 0.8 > like(text, swapped)
    assert like("abcdefgh " * 3, "abcdefgh " * 30) < 1
    hashes = fingerprints.numbered_kmers("abcdefgh" * 50)
    assert len(set(hashes.tolist())) == len(hashes)                  # occurrence numbers keep repeats apart


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs, width, num, den):
    sets = [sets_of(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return collections.Counter((k, len(s), k if not s else least.get(find(i))) for i, ((k, _), s) in enumerate(zip(docs, sets)))


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_join_equals_brute_force(make, width, num, den):
    r = random.Random(width)
    docs = list(ODD)
    for base in range(4):                                             # messy clusters: copies with a few changed words each
        words = prose(100 + base, 120).split()
        for k in range(25):
            w = list(words)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
            docs.append((1000 + base * 100 + k, " ".join(w)))
    docs += [(2000 + k, "a shared line of quite ordinary words " + prose(k, 8)) for k in range(20)]
    got = ngram_join.link_documents(make(docs), width, num, den).collect()
    assert collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_components(docs, width, num, den)


def test_ngram_join_small(make):
    assert ngram_join.link_documents(make([]), 3, 9, 10).count() == 0
    kept = ngram_join.one_of_each(make(ODD)).select("doc_id", "shard").collect()
    assert sorted(x["doc_id"] or 0 for x in kept) == [0, 1, 2, 3, 4, 5, 5, 7, 8] and {x["shard"] for x in kept} == {"clash"}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(500, 501), (501, 502), (7, 7)] + [(900, 900 + i) for i in range(1, 200)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {k for k, v in got.items() if v == 0} == set(range(61)) and got[502] == 500 and all(got[900 + i] == 900 for i in range(200))


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(make):
    again = prose(4, 30)
    docs = ODD + [(20, again + " " + again + "\n" + again), (21, "a b c d e f g h " * 2 + "z a b c d e f g h"), (22, "# x\n# x\n\n# x | & <b>")]
    got = quality_rules.judge(make(docs)).collect()
    want = collections.Counter((k, *plain_quality(t)) for k, t in docs)
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality_rules.BASE)) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} >= {5, 6} and quality_rules.judge(make([])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def plain_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    passes = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")), "card": lambda v: 13 <= len(digits(v)) <= 19 and plain_luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes[k](m[0])]


def test_personal_data(make):
    r = random.Random(2)
    texts = ["a@b.c_d@e.f", "a@b.c.@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.04 1.2.3", "4111 1111-1111 1111 x 4111111111111112", "+1 (234) 555-6789. +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
             "\U0001F600é me@site.org", "@@ a@b 1..2 + +", "x" * 50_000 + "@y.z " + "a." * 20_000 + "b@c" + ".d" * 20_000, "9" * 3000, None, ""]
    texts += ["".join(r.choice("a1.@+- ()_%") for _ in range(400)) for _ in range(60)]
    docs = list(enumerate(texts))
    got = {x["doc_id"]: x for x in pii.find_personal_data(make(docs)).select("doc_id", pii.written(__import__("pyspark").sql.functions.col("base")).alias("base"), "spans").collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        assert got[k]["base"] == ",".join(plain_spans(t)), repr(t)[:80]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[k]["spans"]][:len(plain_spans(t))] == plain_spans(t)
    assert pii.find_personal_data(make([])).count() == 0


def test_span_classifier_learns_credentials(make, spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f'words here token = "{key(40)}" more') for i in range(40)] + [(100 + i, f"see invoice {r.randrange(10 ** 9, 10 ** 10)} of the year") for i in range(40)]
    rows = pii.find_personal_data(make(docs)).collect()
    found = {x["doc_id"] for x in rows if x["spans"]}
    assert found == set(range(40))
    from pyspark.sql import functions as F
    frame = spark.createDataFrame([("a b@c.de f", [("email", 2, 8)])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert frame.select(pii.masked(F.col("text"), F.col("spans"))).first()[0] == "a <email> f"


def plain_lines(docs):
    start = re.compile(r"(?s)(?<![^\x20\x09-\x0D])(?=([^\x20\x09-\x0D].{0,11}))")
    unique = {(k, t) for k, t in docs if t is not None}
    places = collections.defaultdict(list)
    for k, t in unique:
        for p, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS:
                places[line].append((k is not None, k or 0, t, p))
    lines = list(places)
    sets = [frozenset(start.findall(x.lower())) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) and both:
                root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(lines):
        at = min((a, b, p) for a, b, _, p in places[line])
        first[find(i)] = min(first.get(find(i), at), at)
    of = {line: find(i) for i, line in enumerate(lines)}
    keep = lambda k, p, line: line not in of or first[of[line]] == (k is not None, k or 0, p)
    return collections.Counter((k, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if keep(k, p, x))) for k, t in docs)


def test_line_dedup_equals_brute_force(make):
    r = random.Random(1)
    common = [prose(900 + i, 12) for i in range(6)]
    docs = [(None, "null id " + common[0]), (1, None), (2, ""), (3, "short\nshort")]
    for k in range(60):
        lines = [prose(k * 7 + j, 15) for j in range(2)] + [r.choice(common)]
        if k % 3 == 0:
            w = prose(77, 40).split()
            w[r.randrange(40)] = f"new{k}"
            lines.append(" ".join(w))
        r.shuffle(lines)
        docs.append((10 + k, "\n".join(lines)))
    docs.append(docs[-1])
    got = line_dedup.dedup_lines(make(docs)).collect()
    assert collections.Counter((x["doc_id"], x["text"]) for x in got) == plain_lines(docs)
    assert all(isinstance(x["n_removed"], int) and x["shard"] == "clash" for x in got)
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_language_fusion(spark, make):
    from pyspark.sql import functions as F
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    train, held = labelled.where("doc_id % 2 = 0"), labelled.where("doc_id % 2 = 1")
    langs, table = language_id.train(train)
    pages = held.select(F.struct("doc_id").alias("key"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("html"), "text")
    got = {r["key"]["doc_id"]: r["lang"] for r in language_id.identify(pages, langs, table).collect()}
    truth = dict(held.select("doc_id", "lang").collect())
    assert sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.95
    odd = [(i, f"http://de.site.org/{i}", f"<html lang='de'><script>var x='the of and'</script><p>{t}</p>", None) for i, (t, l) in enumerate(held.where("lang = 'de'").select("text", "lang").limit(20).collect())]
    odd += [(900, "http://de.site.org/x", "<html><body></body></html>", None), (901, None, None, None), (902, "http://de.site.org/y", None, "")]
    frame = spark.createDataFrame(odd, "key long, address string, html string, text string")
    got = {r["key"]: r for r in language_id.identify(frame, langs, table).collect()}
    assert got[900]["lang"] == "de" and got[900]["text_lang"] is None and got[901]["lang"] in langs and got[902]["lang"] == "de"
    assert language_id.identify(frame, [], table).where("lang IS NULL").count() == len(odd)
    assert language_id.identify(frame.limit(0), langs, table).count() == 0


def test_token_files_round_trip(make, spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizer_path())
    docs = ODD + [(11, "Hello, WORLD's  <|endoftext|> <|ENDOFTEXT|> x"), (12, "é ́x ÀÉ\x1cb")]
    folder = shared_folder(spark)
    token_files.write_tokens(make(docs), folder, tokenizer_path(), end_id=1)
    got = sorted(token_files.document_digests(spark, folder).collect(), key=lambda r: r["start"])
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in order]
    assert [r["doc_id"] for r in got] == [k for k, _ in order]
    assert [r["start"] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
    assert sorted(map(tuple, (r["ids"] for r in token_files.document_ids(spark, folder).collect()))) == sorted(map(tuple, ids))
    empty = shared_folder(spark)
    token_files.write_tokens(make([]), empty, tokenizer_path(), end_id=1)
    assert token_files.document_digests(spark, empty).count() == 0


def test_mixing(make):
    docs = [(i, prose(i, 20 + i), f"s{i % 4}") for i in range(200)] + [(500, None, "none"), (501, "", None), (502, prose(1, 9), None), (503, prose(1, 9), None)]
    rows = mixing.mix_copies(make(docs), (3, 1, 2)).collect()
    assert len(rows) == len(docs)
    size = collections.Counter()
    for k, t, s in docs:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total = {}, 1.5 * sum(size.values())
    free = set(order)
    while True:                                                       # share, stop at the bound, share the excess anew
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        if not full:
            break
        target.update({s: 2.0 * size[s] for s in full})
        free -= full
    target.update({s: level * weight[s] for s in free})
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]] and r["copies"] <= 2 for r in rows)
    assert mixing.emit_copies(mixing.mix_copies(make(docs), (3, 1, 2))).count() == sum(r["copies"] for r in rows)
    assert mixing.mix_copies(make([]), (3, 1, 2)).count() == 0


def test_packing_plan_places_every_item_once():
    r = random.Random(4)
    for capacity, n in ((10, 50), (64, 500), (2048, 3000), (1, 5)):
        lengths = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(n)]
        hist = collections.Counter(lengths)
        spots, rank = [], 0
        for first, count, each, seq, offset, length in packing.plan(dict(hist), capacity):
            assert first == rank
            spots += [(seq + i // each, offset + i % each * length, length) for i in range(count)]
            rank += count
        assert [x[2] for x in spots] == sorted(lengths, reverse=True)
        bins = collections.defaultdict(list)
        for s, o, l in spots:
            bins[s].append((o, l))
        for items in bins.values():
            assert [o for o, _ in sorted(items)] == [sum(l for _, l in sorted(items)[:i]) for i in range(len(items))] and sum(l for _, l in items) <= capacity
        assert len(bins) <= -(-sum(lengths) // capacity) * 1.25 + 1


def test_packing(make):
    docs = ODD + [(30 + i, prose(i, 50 + 40 * i)) for i in range(20)]
    got = packing.pack(make(docs), tokenizer_path(), capacity=256).collect()
    coder = codec(tokenizer_path())
    want = collections.Counter()
    for (k, _), ids in zip(docs, coder.encode([t for _, t in docs])):
        ids = np.append(ids, 0).astype("<u4")
        want.update((k, i, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256].tobytes())) for i, at in enumerate(range(0, len(ids), 256)))
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(l for _, l in b) <= 256 and [o for o, _ in sorted(b)] == [sum(l for _, l in sorted(b)[:i]) for i in range(len(b))] for b in bins.values())
    assert packing.pack(make([]), tokenizer_path()).count() == 0
    single = [d for d in docs if d[0] is not None and d[0] > 6]
    placed = packing.pack(make(single), tokenizer_path(), capacity=256)
    whole = packing.sequences(make(single), placed, tokenizer_path()).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in placed.collect()) and all(len(r["ids"]) <= 256 for r in whole)


def test_codec_gives_the_tokenizers_own_ids():
    """Every entry of the vocabulary, every character of the fast range in several places, and random mixtures."""
    from tokenizers import Tokenizer

    from noticeboard.llm import tokens
    plain, coder = Tokenizer.from_file(tokenizer_path()), tokens.Codec(tokenizer_path())
    assert coder.by_chunk and coder.words is not None and tokens.Codec(tokenizer_path("byte_bpe_50k.json")).by_chunk is False
    alphabet, r = tokens._byte_alphabet(), random.Random(3)
    texts = []
    for entry in plain.get_vocab():
        try:
            texts.append(bytes(alphabet[c] for c in entry.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    texts += [f for c in map(chr, range(0x300)) for f in (c, " " + c, c * 3, f"a{c}b", f"1{c}2", f"'{c}s", f"x {c}{c} y", f"{c}'s{c}'LL")]
    some = "abcXYZ019'sS'tTreRE.,;<|>_-\x1c\x1d\x00\x7f\x85é ŸſİĲ"
    texts += ["".join(r.choice(some) for _ in range(r.randrange(1, 40))) for _ in range(3000)] + ["<|endoftext|> A<|ENDOFTEXT|> b", "ÀÉ\x1cb é ́x"]
    assert [x.tolist() for x in coder.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    coder.bytes = tokens.MEMORY_BYTES + 1
    assert coder.encode(["again"])[0].tolist() == plain.encode("again", add_special_tokens=False).ids and len(coder.known) == 1


def test_codec_keeps_what_is_in_use_when_its_memory_is_full(monkeypatch):
    from noticeboard.llm import tokens
    coder = tokens.Codec(tokenizer_path())
    coder.encode(["often, seldom"])
    coder.bytes = tokens.MEMORY_BYTES + 1
    monkeypatch.setattr(coder.words, "merge", None)                   # nothing can be worked out anew
    assert coder.encode(["often, often"])[0].tolist() and set(coder.known) == {b"often,", b"often"}
    assert b"seldom" in coder.before
