"""Language by Bayesian evidence fusion: text likelihood, declared markup language, and host priors smoothed up a hierarchy.

    log P(l | page) = text log-likelihood(l) + log P(declared | l) + log prior(host, l)

The text model is naive Bayes over hashed character trigrams, trained on a sample of labelled texts of at most about ``SAMPLE`` a language
(the bound is a parameter; everything else counts all rows). How far declarations can be trusted is learned from the corpus: expected
counts of (declared, language) under the text alone. A host's prior is its expected counts, without the page itself, smoothed by those of
its domain, these by those of its address suffix, these by the whole corpus: one grouped aggregation a level.

Defined cases: null or empty text gives no text evidence, so declaration and host decide; a null address has no host and takes the corpus
prior; an unknown or missing declaration counts as its own value; ties go to the language that sorts first; without labelled texts the
language is null; an empty table gives an empty table; repeated rows are judged alike; other columns are ignored.
"""
from __future__ import annotations

import html as markup
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .tokens import batches

SAMPLE = 2000
BUCKETS = 1 << 16
BLOCK = 1 << 14                    # trigrams whose rows of the model are summed at a time
OVERLAP = 3.0                      # neighbouring trigrams tell the same thing about three times
STRENGTH = {"host": 20.0, "domain": 50.0, "suffix": 100.0}
_DROP = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})""")


def visible_text(page: str | None) -> str:
    return markup.unescape(_DROP.sub(" ", page or ""))


def declared_language(page: str | None) -> str | None:
    found = _LANG.search(page or "")
    return found[1].lower() if found else None


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased text, blanks around it."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), "<u4").astype("uint32")
    if len(c) < 3:
        return np.zeros(0, "int64")
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype("int64")


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language) from ``labelled(doc_id, text, lang)``."""
    # one row a labelled language
    counts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), "float32")
    at = {lang: i for i, lang in enumerate(langs)}
    share = F.try_element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"])))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)

    def count(frames):
        tables = {}
        for frame in batches(frames, "text"):
            for lang, text in zip(frame["lang"], frame["text"]):
                if lang not in tables:
                    tables[lang] = np.zeros(BUCKETS, "int64")
                tables[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, table in tables.items():
            g = np.nonzero(table)[0]
            yield pd.DataFrame({"l": at[lang], "g": g, "n": table[g]})

    seen = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & drawn).select("lang", "text").mapInPandas(count, "l int, g int, n long")
    table = np.full((BUCKETS, len(langs)), 0.1)
    for r in seen.groupBy("l", "g").agg(F.sum("n").alias("n")).toLocalIterator():            # at most languages x buckets
        table[r["g"], r["l"]] += r["n"]
    table /= table.sum(0)
    return langs, np.log(table, out=table).astype("float32")


def _softmax(rows: np.ndarray) -> np.ndarray:
    parts = np.exp(rows - rows.max(1, keepdims=True))
    return parts / parts.sum(1, keepdims=True)


def identify(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``pages(key, address, html, text)`` with the language, its probability, and the evidence.

    A page has markup or a plain text; ``key`` is any struct or value that comes back as it is.
    """
    width = range(len(langs))
    if not langs:
        return pages.select("key", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    model = pages.sparkSession.sparkContext.broadcast(table)
    key_type = pages.schema["key"].dataType.simpleString()

    def likelihood(text: str) -> np.ndarray:
        g = trigrams(text)
        if not len(g) or not text.strip():
            return np.zeros(len(langs))
        return sum(model.value[g[i:i + BLOCK]].sum(0, dtype="float64") for i in range(0, len(g), BLOCK)) / OVERLAP

    def score(frames):
        for frame in frames:
            if len(frame) == 0:
                continue
            plain = [t if t is not None else visible_text(h) for t, h in zip(frame["text"], frame["html"])]
            sums = np.stack([likelihood(t) for t in plain])
            yield pd.DataFrame({"key": frame["key"], "address": frame["address"], "declared": [declared_language(h) for h in frame["html"]],
                                "t": list(sums), "p": list(_softmax(sums))})

    rows = pages.select("key", "address", "html", "text").mapInPandas(score, f"key {key_type}, address string, declared string, t array<double>, p array<double>")
    host = F.lower(F.regexp_extract("address", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = rows.withColumn("host", F.when(F.col("address").isNotNull(), host))
    rows = rows.withColumn("domain", F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", "([^.]+)$", 1))
    said = F.when(F.col("declared").isin(*langs), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), "none").otherwise("other"))
    scored = stored(rows.withColumn("said", said))

    # languages are the places of an array: t text, p probability by text, n expected counts, q smoothed prior
    total = lambda name: F.array(*(F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0.0)) for i in width)).alias("n")
    everything = np.array(scored.agg(total("p")).first()["n"]) + 1.0
    prior = everything / everything.sum()
    # P(said | language), from expected counts: languages + 2 rows
    trust = {r["said"]: np.array(r["n"]) for r in scored.groupBy("said").agg(total("p")).collect()}
    values = sorted({*trust, *langs, "none", "other"})
    told = {v: (trust.get(v, np.zeros(len(langs))) + 0.5) / (everything + 0.5 * len(values)) for v in values}

    def smoothed(level: str, parent: Column) -> Column:
        """Expected counts ``n`` of ``rows`` pages, each of which has the weight one."""
        return F.zip_with("n", parent, lambda n, q: (n + STRENGTH[level] * q) / (F.col("rows") + STRENGTH[level]))

    hosts = stored(scored.where("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(total("p"), F.count(F.lit(1)).alias("rows")))
    corpus = F.array(*(F.lit(float(x)) for x in prior))
    suffixes = hosts.groupBy("suffix").agg(total("n"), F.sum("rows").alias("rows")).select("suffix", smoothed("suffix", corpus).alias("q_suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(total("n"), F.sum("rows").alias("rows")).join(suffixes, "suffix")
    domains = domains.select("suffix", "domain", smoothed("domain", F.col("q_suffix")).alias("q"))
    known = hosts.join(domains, ["suffix", "domain"]).select("host", "n", "q")
    joined = scored.join(known, "host", "left").select("key", "declared", "host", "said", "t", "p", "n", "q")

    def fuse(frames):
        names = np.array(langs, dtype=object)
        for frame in frames:
            if len(frame) == 0:
                continue
            text, own = np.stack(frame["t"]), np.stack(frame["p"])
            at_host = np.tile(prior, (len(frame), 1))
            there = frame["n"].notna().to_numpy()
            if there.any():
                others = np.maximum(np.stack(frame["n"][there]) - own[there], 0.0)
                at_host[there] = (others + STRENGTH["host"] * np.stack(frame["q"][there])) / (others.sum(1, keepdims=True) + STRENGTH["host"])
            fused = _softmax(text + np.log(np.stack([told[v] for v in frame["said"]])) + np.log(at_host))
            heard = np.abs(text).max(1) > 0
            yield pd.DataFrame({"key": frame["key"], "lang": names[fused.argmax(1)], "probability": fused.max(1),
                                "text_lang": np.where(heard, names[text.argmax(1)], None), "declared": frame["declared"], "host": frame["host"]})

    return joined.mapInPandas(fuse, f"key {key_type}, lang string, probability double, text_lang string, declared string, host string")
