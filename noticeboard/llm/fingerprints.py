"""Order MinHash fingerprints: sensitive to edit distance because the chosen k-mers keep their order in the text.

A text's k-mers (k code points) are numbered by occurrence, so repeats stay apart. Each of ``slots`` hash orders selects the
``PICK`` smallest numbered k-mers, puts them back in text order and hashes the tuple to 16 bits. The likeness of two fingerprints is the
share of equal slots.

Defined cases: null text counts as empty; the empty text has the zero fingerprint, which no other text has, and is like itself alone;
a text shorter than k is one k-mer; equal texts have equal fingerprints; texts are read whole at any length.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import batches

K = 8                              # a power of two: window hashes double up
SLOTS = 64
PICK = 2
_BASE, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))
_ORDERS = (np.random.default_rng(1).integers(0, 1 << 31, SLOTS, dtype=np.int64) * 2 + 1).astype("uint32")


_DOUBLING = [(1 << i, np.uint64(pow(int(_BASE), 1 << i, 1 << 64))) for i in range(K.bit_length() - 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def numbered_kmers(text: str) -> np.ndarray:
    """64-bit hashes of the (k-mer, occurrence number) pairs, in text order."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64") + np.uint64(1)
    if len(h) < K:
        power = _BASE ** np.arange(len(h), dtype="uint64")
        return _mixed(np.array([(h * power).sum()], "uint64") + np.uint64(len(h)))
    for width, power in _DOUBLING:
        h = h[:len(h) - width] * power + h[width:]
    h = _mixed(h)
    # one sort groups equal k-mers in text order: the low bits of the key hold the place
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    key = np.sort((h >> bits << bits) | np.arange(len(h), dtype="uint64"))
    group = key >> bits
    same = group[1:] == group[:-1]
    at = np.flatnonzero(same) + 1                                     # second and later occurrences
    if len(at):
        fresh = np.concatenate(([True], np.diff(at) > 1))             # a later occurrence that follows a first one
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        number = (np.arange(len(at)) - start + 1).astype("uint64")
        place = (key[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype("int64")
        h[place] = _mixed(h[place] + number * _BASE)
    return h


def signature(text: str) -> np.ndarray:
    if not text:
        return np.zeros(SLOTS, "uint16")
    h = numbered_kmers(text)
    rank = (h >> np.uint64(32)).astype("uint32")
    low, high = np.empty(SLOTS, "int64"), np.empty(SLOTS, "int64")
    step = max(1, 65_536 // len(h))                                   # orders tried at once: what fits a cache
    for i in range(0, SLOTS, step):
        values = rank[None, :] * _ORDERS[i:i + step, None]
        rows = np.arange(len(values))
        first = values.argmin(1)
        values[rows, first] = 0xFFFFFFFF
        second = values.argmin(1) if len(h) > 1 else first
        low[i:i + step], high[i:i + step] = np.minimum(first, second), np.maximum(first, second)
    pair = _mixed(h[low] * _MIX + h[high] + np.uint64(len(h) > 1))
    return (pair % np.uint64(65_535)).astype("uint16") + np.uint16(1)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """``text`` with its second half replaced by as many code points from the start of ``following``, or all it has."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


DONE = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
ENDS = DONE + ", part int, end string, text string"


def _compared(doc_id, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    other = sig if edited == text else signature(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(sig), as_text(other), likeness(sig, other), likeness(sig, next_sig))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its text edited with the next document's, and compare it with both.

    The next document is the one after it in descending doc_id (equal ids: by text), the first after the last; null ids come last.
    Texts move once, into ranges of doc_id; the first and last document of every range, at most two per task, are matched afterwards.
    """
    def ranges(frames):
        part, head, last, rows = TaskContext.get().partitionId(), None, None, []
        for frame in batches(frames, "text"):
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                now = (doc_id, text, signature(text))
                if last is None:
                    head = (doc_id, len(text), None, as_text(now[2]), None, None, None, part, "head", text)
                else:
                    rows.append((*_compared(*last, text, now[2]), part, None, None))
                last = now
            yield frame_of(rows)
            rows = []
        if last is not None:
            yield frame_of([head, (last[0], len(last[1]), None, as_text(last[2]), None, None, None, part, "tail", last[1])])

    def frame_of(rows):
        names = [x.split()[0] for x in ENDS.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "near_edited": "float64", "near_next": "float64"})

    def closing(frames):
        for frame in frames:
            unpack = lambda x: np.frombuffer(bytes.fromhex(x), ">u2").astype("uint16")
            rows = [_compared(r.doc_id, r.text, unpack(r.fingerprint), r.next_text, unpack(r.next_fingerprint)) for r in frame.astype({"doc_id": "Int64"}).itertuples()]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DONE.split(", ")]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    made = stored(texts.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInPandas(ranges, ENDS))
    done, ends = made.where("end IS NULL"), made.where("end IS NOT NULL")
    parts = sorted(r["part"] for r in ends.where("end = 'head'").select("part").collect())          # one small number per task
    if not parts:
        return made.select(*[x.split()[0] for x in DONE.split(", ")])
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follower int")
    heads = ends.where("end = 'head'").select(F.col("part").alias("follower"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = ends.where("end = 'tail'").select("doc_id", "text", "fingerprint", "part").join(follows, "part").join(heads, "follower")
    closed = tails.mapInPandas(closing, DONE)
    return done.select(*closed.columns).union(closed)
