"""The Merkle manifest against plain Python: trees of several heights, proofs, tampering, nulls, ties and repeated rows."""
import collections
import hashlib
import random
import zlib

from noticeboard.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """Root and, per leaf, the runs it stands in as (siblings left, siblings right)."""
    levels, paths = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        cur, width = levels[-1], fanout ** (len(levels) - 1)
        for i in range(len(leaves)):
            at = i // width
            run = at - at % fanout
            paths[i].append(("".join(cur[run:at]), "".join(cur[at + 1:run + fanout])))
        levels.append([H(*cur[i:i + fanout]) for i in range(0, len(cur), fanout)])
    return levels[-1][0], paths


def plain_manifest(rows, fanout=16):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        members = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = (members, *plain_tree([plain_leaf(r) for r in members], fanout))
    root, top = plain_tree([trees[s][1] for s in names], fanout)
    out = collections.Counter()
    for s, above in zip(names, top):
        members, subroot, paths = trees[s]
        for r, path in zip(members, paths):
            path = path + above
            t = r[4]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            node = plain_leaf((*r[:4], t))
            for left, right in path:
                node = H(left, node, right)
            out[(r[0], plain_leaf(r), subroot, root, H(*(a + b for a, b in path)), node, node == root)] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def run(spark, tmp_path, rows, clash=True):
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(rows, SCHEMA)
    if clash:
        frame = frame.withColumns({c: F.lit("clash") for c in ("tree", "pos", "n", "digest", "row", "path", "leaf", "place", "tie", "first", "name", "root", "tampered")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return collections.Counter(tuple(r[c] for c in OUT) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect())


def test_manifest_equals_plain_python(spark, tmp_path):
    r = random.Random(3)
    sizes = {"big": 700, "b16": 16, "b17": 17, "b256": 256, "b257": 257, "one": 1, None: 33, "": 2, "é": 3, "z\U0001F600": 2}
    sizes |= {f"s{i}": 1 + i % 3 for i in range(30)}                       # more than 16 sources: the tree above has two levels
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k * 7 % 10007, s, r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", f"Text É {k}", "SAME", "lower"])))
    rows += [(None, "big", None, None, None)] * 3 + [(5, "big", "en", 1, "Twice")] * 2 + [(5, "big", "en", 1, "Other")]
    rows.append((10 ** 12, "big", "en", 1, "LONG " * 50_000))
    r.shuffle(rows)
    assert run(spark, tmp_path, rows) == plain_manifest(rows)


def test_small_manifests(spark, tmp_path):
    for i, rows in enumerate(([], [(1, "a", "en", 1, "X")], [(1, "a", "en", 1, "X"), (2, "b", "en", 1, "Y")], [(k, "a", None, None, "T") for k in range(20)])):
        assert run(spark, tmp_path / str(i), rows) == (plain_manifest(rows) if rows else collections.Counter())


def test_other_fanout_and_stored_levels(spark):
    rows = [(k, "ab"[k % 2], "en", k, f"text {k}") for k in range(400)]
    m = merkle.manifest_of(spark.createDataFrame(rows, SCHEMA), fanout=3, stride=3)
    want = plain_manifest([(*r[:4], r[4]) for r in rows], fanout=3)
    assert {m.root} == {k[3] for k in want}
    # 200 leaves a source: levels 3 and 6 are stored, those between are not
    assert [level.count() for level in m.levels] == [2 * -(-200 // 27), 2]
    assert {r["proof_sha256"] for r in merkle.verify(m).collect()} == {k[4] for k in want} and merkle.verify(m).where("NOT verified").count() == 0
