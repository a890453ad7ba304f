"""Search by an inverted index: words to the rows and fields that hold them, so that a query reads its words and not every row.

A search term has no blank in it, so where it occurs it lies inside one blank-separated word of a field. The index keeps the distinct words (the
dictionary) and, per word and block of rows, the rows with one bit for each field. A term asks the dictionary which words contain it; the postings of
those words say everything, exactly, and no row is read again. Postings are partitioned by a hash of the word, and the dictionary's answer
prunes those partitions at run time.

Defined cases: null fields have no words; a query without terms returns every row unscored; a row's number in the index is its ``arrival_ix``,
which must be unique; a common word has many blocks, each of ``BLOCK`` rows at most, so no word is ever one row or one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import keep, scratch_folder
from . import serve
from .serve import SEARCH_WEIGHTS

BLOCK_BITS = 16
PARTS = 64
POSTINGS = "word string, block bigint, rows array<struct<low:int,bits:int>>, bits int, part int"
DICTIONARY = "word string, bits int, part int"
FIELDS = (*SEARCH_WEIGHTS, ("description", 0))          # the description is found by phrase search alone


def _value(name: str) -> Column:
    return F.lower(F.coalesce(F.date_format("start_datetime", "EEEE") if name == "weekday" else F.col(name), F.lit("")))


def build_index(listings: DataFrame, path: str | None = None, parts: int = PARTS) -> str:
    """Write the index of ``listings`` below ``path`` (a new shared folder by default) and return the path."""
    path = path or scratch_folder(listings.sparkSession)
    fields = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.split(_value(name), " ").alias("words")) for i, (name, _) in enumerate(FIELDS)])
    words = listings.select("arrival_ix", F.explode(fields).alias("f")).select("arrival_ix", "f.bit", F.explode("f.words").alias("word")).filter("word <> ''")
    per_row = words.groupBy("word", "arrival_ix").agg(F.bit_or("bit").alias("bits"))
    block = F.shiftright("arrival_ix", BLOCK_BITS).alias("block")
    low = F.col("arrival_ix").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("low")
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")
    posted = per_row.groupBy("word", block).agg(F.sort_array(F.collect_list(F.struct(low, "bits"))).alias("rows"), F.bit_or("bits").alias("bits"))
    (posted.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("word", "block"), F.lit(16))).sortWithinPartitions("part", "word", "block")
     .write.partitionBy("part").parquet(f"{path}/postings"))
    stored = listings.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    stored.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.first("part").alias("part")).write.parquet(f"{path}/words")
    return path


def _postings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Postings of the ``wanted(part, word, ...)``: the dictionary is asked first, then only the partitions of its answer are opened."""
    wanted = keep(wanted)
    parts = sorted(r["part"] for r in wanted.select("part").distinct().collect())         # numbers, as many as the index has parts at most
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("part").isin(parts)).drop("bits").join(wanted, ["part", "word"])


def _row(block: str = "block") -> Column:
    return F.shiftleft(block, BLOCK_BITS).bitwiseOR(F.col("r.low").cast("long"))


def _best_weight(bits: Column) -> Column:
    return F.greatest(*[F.when(bits.bitwiseAND(F.lit(1 << i)) > 0, weight).otherwise(0) for i, (_, weight) in enumerate(FIELDS)])


def matches(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``arrival_ix, match_score`` of rows in which every term lands; each term counts its heaviest field."""
    terms = query.lower().split()
    words = spark.read.schema(DICTIONARY).parquet(f"{path}/words")
    hit = F.array(*[F.when(F.contains("word", F.lit(t)), i) for i, t in enumerate(terms)])
    # the dictionary is read once for all terms; a field without weight never lands
    wanted = words.filter(F.exists(hit, lambda i: i.isNotNull())).filter(_best_weight(F.col("bits")) > 0).select("part", "word", F.array_compact(hit).alias("terms"))
    found = _postings(spark, path, wanted).select("block", "terms", F.explode("rows").alias("r"))
    scored = found.select(_row().alias("arrival_ix"), F.explode("terms").alias("term"), _best_weight(F.col("r.bits")).alias("w")).filter("w > 0")
    best = [F.max(F.when(F.col("term") == i, F.col("w"))).alias(f"w{i}") for i in range(len(terms))]
    per_row = scored.groupBy("arrival_ix").agg(*best)
    for i in range(len(terms)):
        per_row = per_row.filter(F.col(f"w{i}").isNotNull())
    return per_row.select("arrival_ix", sum((F.col(f"w{i}") for i in range(1, len(terms))), F.col("w0")).alias("match_score"))


def weighted_search(listings: DataFrame, path: str, query: str) -> DataFrame:
    """As ``serve.weighted_search``, from the index: the listings that match with ``match_score``, best first, ties in table order."""
    if not query.split():
        return listings
    return listings.join(matches(listings.sparkSession, path, query), "arrival_ix").orderBy(F.col("match_score").desc(), "arrival_ix")


def phrase_candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``arrival_ix`` of rows whose title or description may hold the phrase: its first word ends, its last begins and those between are words of the field."""
    parts = query.lower().split(" ")
    asked = []
    for i, p in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        word = F.col("word")
        if p:
            asked.append(F.contains(word, F.lit(p)) if first and last else word.endswith(p) if first else word.startswith(p) if last else word == p)
    fields = sum(1 << i for i, (name, _) in enumerate(FIELDS) if name in ("title", "description"))
    if not asked:
        return None                                      # nothing but blanks: no word to ask for
    hit = F.array(*[F.when(c, i) for i, c in enumerate(asked)])
    words = spark.read.schema(DICTIONARY).parquet(f"{path}/words").filter(F.exists(hit, lambda i: i.isNotNull())).filter(F.col("bits").bitwiseAND(F.lit(fields)) > 0)
    found = _postings(spark, path, words.select("part", "word", F.array_compact(hit).alias("terms"))).select("block", "terms", F.explode("rows").alias("r"))
    found = found.filter(F.col("r.bits").bitwiseAND(F.lit(fields)) > 0).select(_row().alias("arrival_ix"), F.explode("terms").alias("term"))
    return found.groupBy("arrival_ix").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(asked)).select("arrival_ix")


def search(listings: DataFrame, path: str, query: str, limit: int = 50) -> DataFrame:
    """As ``serve.search``, on the rows that the index names; the phrase itself decides."""
    named = phrase_candidates(listings.sparkSession, path, query)
    return serve.search(listings if named is None else listings.join(named, "arrival_ix", "left_semi"), query, limit)
