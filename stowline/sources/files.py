"""Small text and JSON files: launcher versions, localisation, saved catalogue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import Snapshots

# What a version looks like; last parts of keys that are no names.
NOT_NAMES = ["desc", "description", "clinic", "hospital"]
_VERSION = r"\b(\d+\.\d+(?:\.\d+)?)-[a-z]+\.(\d{6,})\b"


def launcher_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """build -> version: the last one in the given files, in order, that names the build."""
    out = None
    for rank, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True).select(F.lit(rank).alias("rank"), F.posexplode(F.regexp_extract_all("value", F.lit(_VERSION), F.lit(0))).alias("pos", "hit"))
        out = text if out is None else out.unionByName(text)
    hit = out.select(F.regexp_extract("hit", _VERSION, 2).cast("int").alias("build"), F.regexp_extract("hit", _VERSION, 1).alias("version"), "rank", "pos")
    return hit.groupBy("build").agg(F.max_by("version", F.struct("rank", "pos")).alias("version"))


def localisation(spark: SparkSession, path: str) -> DataFrame:
    """key -> value of ``key[,flag]=value`` lines; keys without case, the last of a key counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("n", "line")).where(F.instr("line", "=") > 1)
    key = F.lower(F.substring_index(F.trim(F.substring_index("line", "=", 1)), ",", 1))
    return lines.select("n", key.alias("key"), F.expr("substring(line, instr(line, '=') + 1)").alias("value")).where("key <> ''").groupBy("key").agg(F.max_by("value", "n").alias("value"))


def language(spark: SparkSession, path: str) -> str:
    """The language that a settings file (a few lines) sets; English where it sets none."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?m)^\s*g_language\s*=\s*([^\s;]+)", 1).alias("v")).where("v <> ''").first()
    return found["v"] if found else "english"


def catalogue_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of saved pages ``{"data": [...]}``; schema is that of one row."""
    pages = spark.read.schema(f"data array<struct<{schema}>>").option("multiLine", "true").json(path)
    return pages.select(F.explode("data").alias("d")).select("d.*")


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved pages as they are: file, page, last_page, data; null where a page lacks it."""
    shape = f"data array<struct<{schema}>>, meta struct<current_page:int,last_page:int>"
    pages = spark.read.schema(shape).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return pages.select(F.col("_metadata.file_name").alias("file"), F.col("meta.current_page").alias("page"), F.col("meta.last_page").alias("last_page"), "data")


def page_problems(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(problem, file, page): why a set of saved pages is not the whole catalogue; no rows prove that it is.

    Each page has its number, the number of the last one, and rows; all agree on the last one, and each up to it is there.
    """
    pages = _pages(spark, path, schema)
    bad = F.when(F.col("page").isNull() | F.col("last_page").isNull() | (F.col("page") < 1) | (F.col("last_page") < F.col("page")), "no valid numbers").when(F.col("data").isNull(), "no rows")
    faulty = pages.select(bad.alias("problem"), "file", "page").where("problem IS NOT NULL")
    ends = pages.agg(F.min("last_page").alias("least"), F.max("last_page").alias("most"), F.count("*").alias("n"))
    apart = ends.select(F.when(F.col("n") == 0, "no pages").when(F.col("least") < F.col("most"), "last pages differ").alias("problem"), F.lit(None).cast("string").alias("file"), F.col("most").alias("page")).where("problem IS NOT NULL")
    wanted = ends.where("most >= 1").select(F.explode(F.sequence(F.lit(1), F.col("most"))).alias("page"))
    gaps = wanted.join(pages.select("page"), "page", "left_anti").select(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("file"), "page")
    return faulty.unionByName(apart).unionByName(gaps)


def replace_catalogue(store: Snapshots, name: str, path: str, schema: str, key: str) -> int | None:
    """Make saved pages the catalogue ``name``, all of it, if they are whole; the new version, or None where they are not.

    A set that lacks a page leaves the old catalogue as it was. A row that two pages have counts once, as the later page has it;
    rows without a key are none.
    """
    spark = store.spark
    if not page_problems(spark, path, schema).isEmpty():
        return None
    rows = _pages(spark, path, schema).select("page", F.posexplode("data").alias("at", "d")).where(F.col(f"d.{key}").isNotNull())
    newest = rows.groupBy(F.col(f"d.{key}").alias("_key")).agg(F.max_by("d", F.struct("page", "at")).alias("d")).select("d.*")
    return store.publish({name: newest})


def only_child(keys: DataFrame, stems: DataFrame) -> DataFrame:
    """stem -> its one child key: ``stem_x`` with no further part, where there is exactly one that can be a name.

    A key's own stem is what stands before its last part, so an equi-join finds the children.
    """
    child = keys.select(F.regexp_replace(F.lower("key"), r"_[^_]+$", "").alias("stem"), F.lower("key").alias("key")).where("stem <> key").where(~F.element_at(F.split("key", "_"), -1).isin(*NOT_NAMES)).distinct()
    return stems.select(F.lower("stem").alias("stem")).distinct().join(child, "stem").groupBy("stem").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("stem", "key")
