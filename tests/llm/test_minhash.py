"""One-permutation MinHash: the signature against a plain version, links against brute force, groups of near copies and shared passages."""
import collections
import random

import numpy as np

from noticeboard.llm import minhash
from noticeboard.llm.ngram_join import ngrams
from tests.llm.test_operators import ODD, brute_components, prose


def plain_signature(grams):
    """Bin by bin in plain Python."""
    own = {}
    for g in map(int, grams):
        b = (g >> 32) * minhash.SLOTS >> 32
        own[b] = min(own.get(b, g), g)
    donors, out = minhash._donors(), []
    for b in range(minhash.SLOTS):
        if b not in own:
            names = (int(donors[t, b]) for t in range(minhash.ATTEMPTS))
            b = next((x for x in names if x in own), None) if len(own) > 1 else next(iter(own))
        out.append(own[b])
    return out


def test_signature_equals_plain_python_and_estimates_similarity():
    r = random.Random(1)
    for n in (1, 2, 3, 10, 300, 5000):
        grams = np.array(sorted([r.getrandbits(64) for _ in range(n)]), "uint64")
        assert minhash.signature(grams).tolist() == plain_signature(grams)
    for n, share in ((400, 0.85), (60, 0.85), (2000, 0.5)):
        seen = []
        for _ in range(60):
            pool = [r.getrandbits(64) for _ in range(n)]
            both = int(n * share)
            rest = pool[both:]
            a, b = (np.array(sorted(pool[:both] + x), "uint64") for x in (rest[::2], rest[1::2]))
            seen.append(float(np.mean(minhash.signature(a) == minhash.signature(b))))
        assert abs(np.mean(seen) - share) < 0.03
    assert (1 - 0.85 ** minhash.ROWS) ** minhash.BANDS < 1e-5


def linked(make, docs):
    rows = minhash.link_near_duplicates(make(docs)).collect()
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in rows)
    return collections.Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows)


def test_links_equal_brute_force(make):
    r = random.Random(9)
    docs = list(ODD) + [(None, prose(5, 40)), (3000, "Two Words"), (3001, "two words"), (3002, " \t\n")]
    for base in range(4):
        words = prose(200 + base, 150).split()
        for k in range(25):                                               # chains: each copy is an edit of an earlier one
            w = list(words)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
            words = w if k % 3 == 0 else words
            docs.append((1000 + base * 100 + k, " ".join(w)))
    for k in range(30):                                                   # short texts, near in few shingles
        docs.append((2000 + k, " ".join(["a", "short", "text", "that", "is", "near", "others", "of", "its", "kind"] * 3 + [f"end{k % 7}"] + ["more"] * (k % 3))))
    passage = prose(77, 70)
    docs += [(2500 + k, passage + " " + prose(300 + k, 30)) for k in range(40)]     # one passage, but not near
    assert linked(make, docs) == brute_components(docs, 5, 85, 100)


def test_a_group_of_near_copies_makes_few_candidates(make, monkeypatch):
    r = random.Random(4)
    words, docs = prose(50, 400).split(), []
    for k in range(1500):
        w = list(words)
        w[r.randrange(len(w))] = f"edit{k}"
        docs.append((k, " ".join(w)))
    pairs, plain = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda p, *a: pairs.append(p.count()) or plain(p, *a))
    got = linked(make, docs)
    assert {k[2] for k in got} == {0} and len(got) == 1500
    assert sum(pairs) < 20 * len(docs)


def test_empty_table(make):
    assert minhash.link_near_duplicates(make([])).count() == 0
