"""Alignment of two tokenizers over a corpus with inverted pair bitmaps.

Every text is encoded by a byte-level tokenizer (A, on a space and the text) and by a piece tokenizer (B, which adds that space itself). Byte offsets
where tokens of both end cut the text into groups; the A token and the B token that end at such an offset are a link.

Links are kept inverted: per pair of ids and chunk of documents a compressed bitmap of the documents that hold the pair, and multiplicity planes,
one bitmap for each binary digit of (occurrences in the document - 1). A task OR-merges the bitmaps of its batches until its chunk is full. A pair's
document count is the popcount of its bitmaps, its link count that popcount plus 2**p times the popcount of plane p. The scored pairs go back
along the postings: each document gets its pairs' scores, weighted by their multiplicity, summed chunk by chunk in arrays of fixed size.

* A container is a list of 16-bit places while that is shorter than the plain bitmap of ``CHUNK`` bits, which it then becomes.
* A chunk closes at ``CHUNK`` documents or ``MOST_ENTRIES`` entries, so neither many nor very long documents let a task's memory grow.
* What travels by pair or by chunk is postings, about two bytes an entry, not links. The pair table is never collected or broadcast.

Defined cases: texts that are null, empty, or that the tokenizers do not give back byte for byte have no tokens: zeros and an empty groups_sha256; names of
special tokens inside a text are ordinary text; rows with null or repeated doc_id are documents of their own; an empty table gives an empty table;
other columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .tokens import batches

CHUNK = 1 << 16
DENSE = CHUNK // 8                # bytes of a plain bitmap; a list of places is always shorter
MERGE_LINKS = 1_000_000           # links gathered before they are merged into the chunk's bitmaps
MOST_ENTRIES = 6_000_000          # places in a chunk's bitmaps, which bounds a task's memory
# --- fixed values: how byte-level vocabularies split a text before merging ---
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ------------------------------------------------------------------------------
COMMON_CHARACTERS = "\u0250"      # below it (Latin with its extensions) both libraries know the same letters, digits and blanks; a test compares every one
_LOADED: dict[tuple[str, str], "Tokenizers"] = {}


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with their tables: bytes and byte length of every id, and ids written in decimal.

    Where A's file is plain byte-pair merging in the order of its ids, texts of common characters are encoded by the other library for such vocabularies, which
    is given A's own entries: the same ids, several times as fast. All other texts, and other files, go to A itself.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", x) else x.replace("▁", " ").encode() for x in pieces]
        self.a_length, self.b_length = (np.array([len(x) for x in table], "int64") for table in (self.a_bytes, self.b_bytes))
        # ids in decimal with the mark that follows them, as bytes padded with zeros: A inside and at the end of a group, then B
        marked = [b"%d%s" % (i, mark) for table, mark in ((self.a_bytes, b","), (self.a_bytes, b"|"), (self.b_bytes, b","), (self.b_bytes, b";")) for i in range(len(table))]
        self.marked = np.array(marked).view("uint8").reshape(len(marked), -1)
        self.fast = self._fast(a_path)

    def _fast(self, a_path: str):
        """An encoder of the same ids from A's own entries and split pattern, or None where A is more than merges in the order of ids."""
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, split = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
        special = {t["content"] for t in spec.get("added_tokens") or ()}
        plain = (spec["model"].get("type") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if not plain:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(pair)] for pair in pairs]
        if any(x >= y for x, y in zip(made, made[1:])) or len(set(made)) + 256 != len(vocab) - sum(t in vocab for t in special) or min(made, default=256) < 256:
            return None
        import tiktoken
        ranks = {self.a_bytes[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("alignment", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        if self.fast is not None:
            for i, t in enumerate(texts):
                if t.isascii() or max(t) < COMMON_CHARACTERS:
                    out[i] = np.array(self.fast.encode_ordinary(t), "int64")
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = np.array(e.ids, "int64")
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text by A and B; None where either does not give back the text."""
        a = self.encode_a([" " + t for t in texts])
        b = self.b.encode(texts, out_type=int, num_threads=1)
        out = []
        for text, x, y in zip(texts, a, b):
            raw = b" " + text.encode()
            same = bool(text) and b"".join(map(self.a_bytes.__getitem__, x.tolist())) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw
            out.append((x, np.array(y, "int64")) if same else None)
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of A and of B end a group, in equal numbers: tokens are never empty, so every group ends in one link."""
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        marks = np.zeros(int(a_ends[-1]) + 1, "int8")
        marks[a_ends] = 1
        marks[b_ends] += 1
        return marks[a_ends] == 2, marks[b_ends] == 2

    def written(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: each group's A tokens, then its B tokens."""
        a_upto, b_upto = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        codes = np.empty(len(a) + len(b), "int64")
        codes[np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group]] = a + n_a * a_last
        codes[np.arange(len(b)) + a_upto[b_group]] = 2 * n_a + b + n_b * b_last
        text = self.marked[codes].ravel()
        return text[text != 0].tobytes()[:-1]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers per worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


# --- containers ---------------------------------------------------------------------

def container(places: np.ndarray) -> bytes:
    """A set of ascending places below CHUNK."""
    raw = places.astype("<u2").tobytes()
    if len(raw) < DENSE:
        return raw
    bits = np.zeros(CHUNK, "uint8")
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places_of(raw: bytes) -> np.ndarray:
    if len(raw) < DENSE:
        return np.frombuffer(raw, "<u2").astype("int64")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, "uint8"), bitorder="little"))


def union(x: bytes, y: bytes) -> bytes:
    """OR of two containers."""
    if not x or not y:
        return x or y
    if len(x) < DENSE and len(y) < DENSE:
        if len(x) + len(y) < DENSE and int.from_bytes(x[-2:], "little") < int.from_bytes(y[:2], "little"):
            return x + y                                          # later batches hold later documents
        return container(np.union1d(places_of(x), places_of(y)))
    dense = [np.frombuffer(c, "uint8") if len(c) >= DENSE else np.packbits(np.isin(np.arange(CHUNK), places_of(c)), bitorder="little") for c in (x, y)]
    return np.bitwise_or(*dense).tobytes()


def popcount(raw: Column) -> Column:
    return F.when(F.octet_length(raw) < DENSE, F.shiftright(F.octet_length(raw), 1)).otherwise(F.bitmap_count(raw)).cast("long")


class _Chunk:
    """Postings of the documents gathered so far: pair -> [documents, plane 0, plane 1, ...]."""

    def __init__(self):
        self.postings: dict[int, list[bytes]] = {}
        self.pairs, self.places, self.waiting, self.entries, self.docs = [], [], 0, 0, 0

    def add(self, pairs: np.ndarray) -> None:
        """Links of the next document."""
        if len(pairs):
            self.pairs.append(pairs)
            self.places.append(np.full(len(pairs), self.docs, "int64"))
            self.waiting += len(pairs)
        self.docs += 1
        if self.waiting >= MERGE_LINKS:
            self.merge()

    def full(self) -> bool:
        return self.docs == CHUNK or self.entries >= MOST_ENTRIES

    def merge(self) -> None:
        if not self.waiting:
            return
        pair, place = np.concatenate(self.pairs), np.concatenate(self.places)
        order = np.argsort(pair, kind="stable")                   # documents stay in order within a pair
        pair, place = pair[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (place[1:] != place[:-1]))))
        more = np.diff(np.append(new, len(pair))) - 1
        pair, place = pair[new], place[new]
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        bounds = np.append(starts, len(pair))
        layers = [(place, bounds)]
        for p in range(int(more.max()).bit_length()):
            bit = (more >> p) & 1 == 1
            layers.append((place[bit], np.concatenate(([0], np.cumsum(bit)))[bounds]))
        wide = np.maximum.reduceat(more, starts)
        raw, ends = [x.astype("<u2").tobytes() for x, _ in layers], [b.tolist() for _, b in layers]
        for i, (key, most) in enumerate(zip(pair[starts].tolist(), wide.tolist())):
            mine = []
            for layer in range(1 + most.bit_length()):
                i0, i1 = ends[layer][i], ends[layer][i + 1]
                mine.append(raw[layer][2 * i0:2 * i1] if 2 * (i1 - i0) < DENSE else container(layers[layer][0][i0:i1]))
            old = self.postings.get(key)
            if old is not None:
                width = max(len(old), len(mine))
                mine = [union(x, y) for x, y in zip(old + [b""] * (width - len(old)), mine + [b""] * (width - len(mine)))]
            self.postings[key] = mine
        self.entries += len(pair)
        self.pairs, self.places, self.waiting = [], [], 0


# --- operator ---------------------------------------------------------------------------

_DOCUMENT = ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_POSTING = ("pair", "chunk", "docs", "planes")
SCHEMA = ("key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pair long, chunk long, docs binary, planes array<binary>")


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings), stored together in one pass over the texts.

    documents: key (chunk and place), doc_id, n_a, n_b, n_groups, n_links, groups_sha256; postings: pair (A id and B id in the high and
    low 32 bits), chunk, docs and planes.
    """
    def aligned(frames):
        tools = tokenizers(a_path, b_path)
        chunk, at, number = _Chunk(), TaskContext.get().partitionId() << 24, 0

        def postings():
            chunk.merge()
            items = list(chunk.postings.items())
            for i in range(0, len(items), 50_000):
                some = items[i:i + 50_000]
                frame = pd.DataFrame({"pair": [k for k, _ in some], "docs": [v[0] for _, v in some], "planes": [v[1:] for _, v in some]})
                yield frame.assign(chunk=at + number, **{c: pd.NA for c in _DOCUMENT}).astype({c: "Int64" for c in _DOCUMENT[:-1]})[[*_DOCUMENT, *_POSTING]]

        for frame in batches(frames, "text"):
            rows = []
            for doc_id, ids in zip(frame["doc_id"].astype("Int64"), tools.encode(frame["text"].tolist())):
                key = (at + number) * CHUNK + chunk.docs
                if ids is None:
                    rows.append((key, doc_id, 0, 0, 0, 0, ""))
                    chunk.add(np.empty(0, "int64"))
                else:
                    a, b = ids
                    a_last, b_last = tools.groups(a, b)
                    digest = hashlib.sha256(tools.written(a, b, a_last, b_last)).hexdigest()
                    links = a[a_last] << 32 | b[b_last]
                    rows.append((key, doc_id, len(a), len(b), len(links), len(links), digest))
                    chunk.add(links)
                if chunk.full():
                    yield from postings()
                    chunk, number = _Chunk(), number + 1
            if rows:
                frame = pd.DataFrame(rows, columns=_DOCUMENT).astype({"doc_id": "Int64"})
                yield frame.assign(pair=pd.array([pd.NA] * len(rows), "Int64"), chunk=pd.array([pd.NA] * len(rows), "Int64"), docs=None, planes=None)
        yield from postings()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    both = stored(docs.select(F.col("doc_id").cast("long"), text).mapInPandas(aligned, SCHEMA))
    return both.where("docs IS NULL").select(*_DOCUMENT), both.where("docs IS NOT NULL").select(*_POSTING)


def pair_scores(postings: DataFrame) -> DataFrame:
    """One row per pair: pair, n_docs, n_links and best, 1 where no pair of the same B id has more links."""
    # planes are few: one for each binary digit of the largest multiplicity
    planes = F.transform("planes", lambda x, p: popcount(x) * F.call_function("shiftleft", F.lit(1).cast("long"), p))
    links = popcount(F.col("docs")) + F.aggregate(planes, F.lit(0).cast("long"), lambda x, y: x + y)
    totals = stored(postings.select("pair", popcount(F.col("docs")).alias("d"), links.alias("l")).groupBy("pair").agg(F.sum("d").alias("n_docs"), F.sum("l").alias("n_links")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = totals.groupBy(b_id.alias("b")).agg(F.max("n_links").alias("most"))           # as many rows as B has ids, at most
    return totals.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).cast("int").alias("best"))


def document_scores(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores along the postings back to the documents: key, n_best and count_sum, for documents with links."""
    def summed(frames):
        def closed():
            there = np.flatnonzero(count)
            return pd.DataFrame({"key": chunk * CHUNK + there, "n_best": best[there], "count_sum": count[there]})

        chunk, count, best = None, None, None
        for frame in frames:
            for name, part in frame.groupby("chunk", sort=False):
                if name != chunk:
                    if chunk is not None:
                        yield closed()
                    chunk, count, best = name, np.zeros(CHUNK, "int64"), np.zeros(CHUNK, "int64")
                layers: dict[int, list[tuple[bytes, int, int]]] = {}
                for docs, planes, n, top in zip(part["docs"], part["planes"], part["n_links"], part["best"]):
                    layers.setdefault(0, []).append((docs, n, top))
                    for p, raw in enumerate(planes):
                        layers.setdefault(p, []).append((raw, n, top))
                for p, rows in layers.items():
                    places = [places_of(raw) for raw, _, _ in rows]
                    sizes, at = [len(x) for x in places], np.concatenate(places)
                    np.add.at(count, at, np.repeat(np.array([n for _, n, _ in rows], "int64") << p, sizes))
                    np.add.at(best, at, np.repeat(np.array([t for _, _, t in rows], "int64") << p, sizes))
        if chunk is not None:
            yield closed()

    # a chunk's postings are bounded by MOST_ENTRIES; the sort keeps each chunk together
    scored = postings.join(scores.select("pair", "n_links", "best"), "pair").drop("pair")
    return scored.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(summed, "key long, n_best long, count_sum long")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    documents, postings = align(docs, a_path, b_path)
    scores = stored(document_scores(postings, pair_scores(postings)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return documents.join(scores, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
