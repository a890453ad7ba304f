"""Personal data and credentials in whole texts, in DataFrame operations alone.

Base patterns (email, ip, card, phone) always count. Wider candidates (long mixed tokens, long digit groups) are judged by weak supervision:
regex, gazetteer and context labelers vote +1, 0 or -1; the votes of all documents are counted by pattern, expectation-maximisation
estimates each labeler's reliability on those at most 3**5 counts, and the posteriors train a naive Bayes span classifier on other traits of
the span (shape, length, neighbours). The classifier alone decides which candidates are added.

Spans are in code points, end exclusive. Patterns are written so that each start is tried once in a run of like characters, and loops are
possessive, so long texts cost linear time and no deep recursion.

Defined cases: null text is empty and has no spans; texts without a digit and without ``@`` are not searched, since nothing can match; rows
with equal doc_id and text are judged alike; with no candidates nothing is trained or added; an empty table gives an empty table; other
columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "number", "secret")
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
SECRET = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
NUMBER = "(?<![0-9+.])[0-9](?:[\\x20().-]{0,2}[0-9]){6,}+"

# fixed values of the labelers
CREDENTIAL_SHAPES = "^(AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{20,})$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
ISSUER_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb", "xoxp", "sk_l", "sk-p", "AIza", "eyJh", "glpa")
CONTEXT_FOR = "(password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|auth|bearer|ssn|social security|account|passport|iban|credential)"
CONTEXT_AGAINST = "(version|release|page|isbn|issn|doi|issue|commit|checksum|sha-?[0-9]*|md5|figure|order|invoice|ticket|http|www|file|path)"
LABELERS = 5


def _spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches with their places: what splitting leaves between them gives the distances."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("v")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    return F.aggregate(steps, empty, lambda s, x: F.struct(
        (s["at"] + x["g"] + x["h"]).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["h"]).alias("end"), x["v"].alias("value")))).alias("out")), lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.try_to_number(bare, F.lit("999")) <= 255)


def _passes(kind: str):
    def keep(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            return F.forall(F.split(value, "\\."), _byte)
        if kind == "card":
            return F.length(_digits(value)).between(13, 19) & luhn(_digits(value))
        if kind == "phone":
            return F.length(_digits(value)).between(9, 15)
        return F.lit(True)

    return keep


def found_spans(docs: DataFrame) -> DataFrame:
    """Per document, stored without its text: doc_id, text_hash, base spans by kind, and candidates with votes and traits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hint = F.rlike("text", F.lit("[0-9@]"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    for kind, pattern, needs in (("email", EMAIL, F.contains(F.col("text"), F.lit("@"))), ("ip", IP, hint), ("card", CARD, hint), ("phone", PHONE, F.contains(F.col("text"), F.lit("+")))):
        rows = rows.withColumn(f"_{kind}", F.when(needs, _spans(F.col("text"), pattern)).otherwise(none))
        rows = rows.withColumn(kind, F.filter(f"_{kind}", _passes(kind)))
    rows = rows.withColumn("_secret", F.when(hint, _spans(F.col("text"), SECRET)).otherwise(none))
    rows = rows.withColumn("_number", F.when(hint, _spans(F.col("text"), NUMBER)).otherwise(none))
    rows = rows.withColumn("_base", F.concat("email", "ip", "card", "phone"))

    def candidate(kind: str, s: Column) -> Column:
        before = F.lower(F.substring(F.col("text"), F.greatest(s["start"] - 31, F.lit(0)) + 1, F.least(s["start"], F.lit(32))))
        last = F.substring(F.col("text"), s["start"], F.lit(1))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                        F.when(s["start"] > 0, before).otherwise("").alias("before"), F.when(s["start"] > 0, last).otherwise("").alias("last"))

    def free(s: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    wide = F.concat(F.transform(F.filter("_secret", free), lambda s: candidate("secret", s)),
                    F.transform(F.filter("_number", lambda s: free(s) & ~F.exists("_secret", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))), lambda s: candidate("number", s)))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return stored(rows.select("doc_id", "text_hash", *(bare(k).alias(k) for k in ("email", "ip", "card", "phone")), wide.alias("candidates")))


def voted(found: DataFrame) -> DataFrame:
    """One row per candidate: its place, the labelers' votes and the classifier's traits."""
    c = found.select("doc_id", "text_hash", F.explode("candidates").alias("c")).select("doc_id", "text_hash", "c.*")
    v, before = F.col("value"), F.col("before")
    digits = F.length(_digits(v)) / F.length(v)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    votes = (
        vote(F.rlike(v, F.lit(CREDENTIAL_SHAPES)), (F.col("kind") == "number")),
        vote(F.substring(v, 1, 4).isin(*ISSUER_PREFIXES), F.rlike(v, F.lit("[a-z]{3,}[/_-][a-z]{3,}"))),
        vote(F.rlike(before, F.lit(CONTEXT_FOR)), F.rlike(before, F.lit(CONTEXT_AGAINST))),
        vote(digits.between(0.05, 0.9) & F.rlike(v, F.lit("[A-Za-z]")), digits > 0.9),
        vote(F.col("last").isin('"', "'", "=", ":"), F.col("last").isin("/", ".", "#", "$")),
    )
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-f]+", "h"), "[g-z]+", "z"), "[0-9]+", "9")
    traits = F.array(
        F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("shape:"), F.pmod(F.xxhash64(F.substring(shape, 1, 6)), F.lit(512)).cast("string")),
        F.concat(F.lit("length:"), F.least(F.length(v), F.lit(64)).cast("string")), F.concat(F.lit("last:"), F.pmod(F.xxhash64("last"), F.lit(64)).cast("string")),
        F.concat(F.lit("word:"), F.pmod(F.xxhash64(F.regexp_extract(before, "([a-z_]+)[^a-z_]*$", 1)), F.lit(1024)).cast("string")))
    return c.select("doc_id", "text_hash", "kind", "start", "end", *(x.alias(f"v{i}") for i, x in enumerate(votes)), traits.alias("traits"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns: posterior of each pattern, and P(vote | class) of each labeler."""
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    table: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(post[p] * n for p, n in patterns) + 1
        no = sum((1 - post[p]) * n for p, n in patterns) + 1
        table = [{v: ((sum(post[p] * n for p, n in patterns if p[i] == v) + 1) / (yes + 2), (sum((1 - post[p]) * n for p, n in patterns if p[i] == v) + 1) / (no + 2))
                  for v in (-1, 0, 1)} for i in range(LABELERS)]
        odds = math.log(yes / no)
        post = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, odds + sum(math.log(table[i][v][0] / table[i][v][1]) for i, v in enumerate(p)))))) for p, _ in patterns}
    return post, table


def accepted(votes: DataFrame) -> DataFrame:
    """Candidates that the trained classifier takes: doc_id, text_hash, kind, start, end."""
    names = [f"v{i}" for i in range(LABELERS)]
    counts = [(tuple(r[n] for n in names), r["count"]) for r in votes.groupBy(*names).count().collect()]      # at most 3 ** LABELERS rows
    spans = votes.select("doc_id", "text_hash", "kind", "start", "end")
    if not counts:
        return spans
    post, _ = reliabilities(counts)
    soft = votes.sparkSession.createDataFrame([(*p, w) for p, w in post.items()], ", ".join(f"{n} int" for n in names) + ", p double")
    traits = votes.join(F.broadcast(soft), names).select("p", F.explode("traits").alias("trait"))
    # as many weights as there are hashed traits, whatever the corpus
    weights = traits.groupBy("trait").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    yes = sum(post[p] * n for p, n in counts)
    total = sum(n for _, n in counts)
    share = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("no") + 0.5) / (total - yes + 1.0))
    weights = stored(weights.select("trait", share.alias("w")))
    scored = votes.select("doc_id", "text_hash", "kind", "start", "end", F.explode("traits").alias("trait")).join(F.broadcast(weights), "trait")
    return scored.groupBy("doc_id", "text_hash", "kind", "start", "end").agg((F.sum("w") / F.count_distinct("trait").cast("double") * 5).alias("w")) \
        .where(F.col("w") + math.log((yes + 0.5) / (total - yes + 0.5)) > 0).drop("w")


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, base spans and all spans as arrays of (kind, start, end), ordered by kind as listed and start."""
    found = found_spans(docs)
    votes = stored(voted(found))
    added = accepted(votes).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    joined = found.drop("candidates").alias("f").join(added.alias("a"), (F.col("f.text_hash") == F.col("a.text_hash")) & F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")), "left")
    base = F.concat(*(F.transform(F.col(f"f.{k}"), _named(k)) for k in ("email", "ip", "card", "phone")))
    return joined.select("f.doc_id", "f.text_hash", base.alias("base"), F.concat(base, F.coalesce("a.added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; a span that begins inside an earlier one is skipped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at")))
    return F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
