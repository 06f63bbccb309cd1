"""What five quality filters remove, alone and one after the other (operator 12), as a relational word pipeline.

Texts are dealt out once by document; the words are exploded there, counted by (document, word) and then by document, and
both aggregates and the join keep that partitioning. The other flags are column expressions, joined from the left, so that
a document without words has zeros. A document is then five bits; 32 conditional counts for each part say all: what a
filter removes in an order, and its Shapley value, are sums of them by fixed weights.

Filters: A under ``least_words`` words; B distinct words under ``least_distinct`` percent; C A-Z over ``most_upper`` percent of
code points; D one of ``#$%&*|``; E a text that a smaller doc_id has. Words are runs of other than blanks (0x20, 0x09 to 0x0D).

Equal texts have equal SHA-256. A document is known by its id and its text's hash; rows that agree in both count alike.

Defined results: a null text is empty (fails A); a null lang is the part ''; a row without a doc_id counts in its part, never
fails E and makes no other fail it, and has no labels; of rows with one doc_id and one text none fails E for another; of
several labels of a doc_id the highest counts; an empty table gives no rows; other columns are ignored; texts of any
length are split in a stream of words.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import join_hot, write_table

FILTERS = "ABCDE"
#: Bytes of text whose words a task counts: their hash tables take about 25 times as much.
PART_BYTES = 4 << 20
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def word_counts(texts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, h, words and distinct words, for rows of doc_id, h and text; rows equal in doc_id and h are added up."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    words = texts.repartition(partitions, "doc_id", "h").select("doc_id", "h", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    each = words.groupBy("doc_id", "h", "word").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "h").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def fails(docs: DataFrame, least_words: int = 100, least_distinct: int = 80, most_upper: int = 10) -> DataFrame:
    """A row for each row of docs: doc_id, part, h (a hash of the text), and a, b, c, d, e, true where it fails the filter. A table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = texts.select("doc_id", "h", "part", F.sha2("text", 256).alias("digest"), (100 * upper > most_upper * F.length("text")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    flags = flags.withColumn("alike", F.count("*").over(Window.partitionBy("doc_id", "h")))
    counted = word_counts(texts.select("doc_id", "h", "text"))
    # Nulls are no key of an equi-join: rows without an id are spread by their hash and meet nothing; their words are joined by it.
    no_id = lambda df: df.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("has_id", F.col("doc_id").isNotNull())
    joined = no_id(flags).join(no_id(counted).drop("doc_id"), ["id", "h", "has_id"], "left")
    words, distinct = (F.expr(f"coalesce({c}, 0L) div alike") if c == "words" else F.coalesce(c, F.lit(0)) for c in ("words", "distinct_words"))
    facts = joined.select("doc_id", "h", "part", F.unhex("digest").alias("digest"), (words < least_words).alias("a"), (100 * distinct < least_distinct * words).alias("b"), "c", "d")
    facts = write_table(facts, "flags")
    firsts = write_table(facts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "firsts")
    found = join_hot(facts, firsts, ["digest"], facts.count())
    return found.select("doc_id", "h", "part", "a", "b", "c", "d", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("e"))


def _steps(spark: SparkSession) -> DataFrame:
    """What a document with a set of failed filters (mask) adds at each step of each order: 120 * 5 * 32 rows."""
    rows = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            for mask in range(32):
                failed, gone = bool(mask & bit), bool(mask & before)
                # In 120 orders a filter comes first of those the document fails as often as each other one.
                rows.append((mask, "".join(FILTERS[k] for k in order), step, not mask & (before | bit), failed and not gone, failed and gone, mask == bit, 120 // mask.bit_count() if failed else 0))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays boolean, goes boolean, gone boolean, alone boolean, weight int")


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, filter_order, step and the counts: 600 rows for each part."""
    found = fails(docs, **limits)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id are spread: they match no label.
    spread = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.lit(0))
    mask = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate("abcde")), F.lit(0))
    marked = found.withColumn("spread", spread).withColumn("mask", mask).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    marked = marked.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by_mask = marked.groupBy("part", "good", "toxic").agg(*(F.count(F.when(F.col("mask") == m, 1)).alias(f"n{m}") for m in range(32)))
    cells = by_mask.select("part", "good", "toxic", F.posexplode(F.array(*(f"n{m}" for m in range(32)))).alias("mask", "n"))
    cells = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    total = lambda n, when: F.sum(F.when(F.col(when), F.col(n)).otherwise(0))
    sums = [total("n", "stays"), total("n", "goes"), total("n", "gone"), total("n", "alone"), total("good", "goes"), total("toxic", "goes"), F.sum(F.col("n") * F.col("weight"))]
    # The steps are 19,200 rows whatever the input.
    return cells.join(F.broadcast(_steps(docs.sparkSession)), "mask").groupBy("part", "filter_order", "step").agg(*(s.alias(c) for s, c in zip(sums, COUNTS, strict=True)))
