"""Cross-tokenizer alignment against plain Python, and its bitmaps against sets."""
import collections
import hashlib
import random

import numpy as np
import pytest

from noticeboard.llm import alignment
from noticeboard.llm.tokens import tokenizer_path
from tests.llm.test_operators import ODD, prose

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_align(docs):
    """Token by token; bytes of A's entries through the tokenizer's own decoder, bytes of B's pieces by the rule of the format."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment._byte_alphabet()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    rows, links = [], []
    for k, t in docs:
        want = b" " + (t or "").encode()
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        xs, ys = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not t or b"".join(xs) != want or b"".join(ys) != want:
            rows.append((k, 0, 0, 0, ""))
            links.append([])
            continue
        groups, mine, i, j, ga, gb, pa, pb = [], [], 0, 0, [], [], 0, 0
        while i < len(x) or j < len(y):
            if pa <= pb and i < len(x):
                ga.append(x[i]); pa += len(xs[i]); i += 1
            else:
                gb.append(y[j]); pb += len(ys[j]); j += 1
            if pa == pb and ga and gb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                mine.append((ga[-1], gb[-1]))
                ga, gb = [], []
        rows.append((k, len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(mine)
    count = collections.Counter(p for mine in links for p in mine)
    top = collections.Counter()
    for (_, q), n in count.items():
        top[q] = max(top[q], n)
    out = collections.Counter()
    for (k, n_a, n_b, n_groups, sha), mine in zip(rows, links):
        out[(k, n_a, n_b, n_groups, len(mine), sum(count[p] == top[p[1]] for p in mine), sum(count[p] for p in mine), sha)] += 1
    return out, count, links


TEXTS = ODD + [(20, "Hello <|endoftext|> </s> <unk> <s>world"), (21, "a ▁ b"), (22, "tabs\t\tand\n\n\nlines  two   three    four"), (23, "日本語のテキスト と 한국어 и русский"),
               (24, "\x00\x01 zero"), (25, " leading and trailing "), (26, "é ﬁ ½   　 wide"), (27, "x" * 3000), (28, "word " * 5000), (29, "\U0001F469‍\U0001F680 🇩🇪 end")]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("merge_links,most_entries", [(alignment.MERGE_LINKS, alignment.MOST_ENTRIES), (50, 300)])
def test_alignment_equals_plain_python(make, monkeypatch, merge_links, most_entries):
    docs = TEXTS + [(100 + i, prose(i, 5 + 3 * i)) for i in range(60)]
    want, count, links = plain_align(docs)
    chunk, full = alignment._Chunk, alignment._Chunk.full
    assert sum(k[1] > 0 for k in want) > 60 and any(k[1] == 0 and k[0] == 21 for k in want)
    frame = make(docs)
    if merge_links < alignment.MERGE_LINKS:                               # several merges a chunk and several chunks a task
        whole = chunk()
        monkeypatch.setattr(alignment, "MERGE_LINKS", merge_links)
        monkeypatch.setattr(alignment, "MOST_ENTRIES", most_entries)
        merged = collections.Counter()
        for mine in links:
            whole.add(np.array([a << 32 | b for a, b in mine], "int64"))
        whole.merge()
        for pair, (held, *planes) in whole.postings.items():
            n = len(alignment.places_of(held)) + sum(len(alignment.places_of(x)) << p for p, x in enumerate(planes))
            merged[pair >> 32, pair & 0xFFFFFFFF] = n
            assert set(alignment.places_of(held).tolist()) == {i for i, mine in enumerate(links) if (pair >> 32, pair & 0xFFFFFFFF) in mine}
        assert merged == count
        return
    got = alignment.align_documents(frame, A, B).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == want
    documents, postings = alignment.align(frame, A, B)
    scores = {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): (r["n_docs"], r["n_links"]) for r in alignment.pair_scores(postings).collect()}
    assert scores == {p: (sum(p in mine for mine in links), n) for p, n in count.items()}


def test_fast_encoder_gives_the_same_ids():
    from tokenizers import Tokenizer
    tools, plain = alignment.tokenizers(A, B), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    assert tools.fast is not None
    r = random.Random(6)
    odd = [chr(c) for c in range(ord(alignment.COMMON_CHARACTERS))]
    texts = [f for c in odd for f in (c, " " + c, c * 3, f"a{c}b", f"1{c}2", f"a {c} b", f"a{c} {c}b", f"'{c}s", f"  {c}  {c}\n{c}")]
    texts += ["".join(r.choice(odd) for _ in range(r.randrange(1, 60))) for _ in range(3000)] + [t or "" for _, t in TEXTS]
    texts += ["".join(r.choice("abcXYZ 0'\n\té.") for _ in range(200)) for _ in range(500)] + ["they'll've it's I'M don't <|endoftext|>"]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tools.encode_a(texts)] == want


def test_containers(spark):
    r = random.Random(1)
    sets = [set(), {0}, {65535}, set(range(0, 65536, 3)), set(r.sample(range(65536), 4095)), set(r.sample(range(65536), 4096)), set(range(65536)), set(range(100, 3000)), set(range(3000, 5000))]
    raw = [alignment.container(np.array(sorted(s), "int64")) for s in sets]
    assert [set(alignment.places_of(x).tolist()) for x in raw] == sets
    for s, x in zip(sets, raw):
        for t, y in zip(sets, raw):
            assert set(alignment.places_of(alignment.union(x, y)).tolist()) == s | t
    from pyspark.sql import functions as F
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw binary").select("i", alignment.popcount(F.col("raw")).alias("n")).collect()
    assert {c["i"]: c["n"] for c in counts} == {i: len(s) for i, s in enumerate(sets)}


def test_empty_and_unaligned(make):
    assert alignment.align_documents(make([]), A, B).count() == 0
    rows = alignment.align_documents(make([(1, None), (2, ""), (None, "▁")]), A, B).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"], r["groups_sha256"]) for r in rows) == [(0, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, "")]
