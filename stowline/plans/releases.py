"""Release notes: what bodies of releases say, and which releases to tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds of notes by the word before the colon; releases listed at most; what a subject looks like.
KINDS = {"feat": "New", "perf": "Improved", "fix": "Fixed"}
MOST = 10
_SUBJECT = r"^([A-Za-z]+)(\([^)]*\))?!?:\s*(.+)$"


def version(tag: Column) -> Column:
    """A tag such as v0.2.45 as four numbers, absent ones zero; null where it is none."""
    text = F.regexp_replace(F.trim(tag), "^[vV]", "")
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    zeros = F.array_repeat(F.lit(0), 4)
    return F.when(text.rlike(r"^\d{1,9}(\.\d{1,9}){1,3}$"), F.slice(F.concat(parts, zeros), 1, 4))


def version_text(v: Column) -> Column:
    """Three numbers, four where the last one is not zero."""
    return F.array_join(F.transform(F.slice(v, 1, F.when(v[3] > 0, 4).otherwise(3)), lambda x: x.cast("string")), ".")


def notes(releases: DataFrame) -> DataFrame:
    """releases (tag, body) -> (tag, n, kind, text): the lines of a body that are notes, in order, without their pull request's number."""
    lines = releases.select("tag", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), "^\ufeff+", ""))
    lines = lines.withColumn("line", F.ltrim(F.regexp_replace(bare, r"^[-*] ", "")))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.lower(F.regexp_extract("line", _SUBJECT, 1))]
    text = F.trim(F.regexp_replace(F.regexp_extract("line", _SUBJECT, 3), r"\s*\(#\d+\)\s*$", ""))
    told = lines.select("tag", "n", kind.alias("kind"), text.alias("text")).where("kind IS NOT NULL AND text <> ''")
    return told.withColumn("text", F.concat(F.upper(F.substring("text", 1, 1)), F.expr("substring(text, 2)")))


def to_tell(releases: DataFrame, current: str, seen: str | None = None, most: int = MOST) -> DataFrame:
    """Releases (tag, body) after the version seen last up to the current one that have notes, the newest first, ``most`` of them.

    Where no version was seen, the newest one alone counts, if it has notes.
    """
    r = releases.withColumn("version", version(F.col("tag"))).where(F.col("version") <= version(F.lit(current)))
    r = r.where(F.col("version") > version(F.lit(seen))) if seen else r.orderBy(F.desc("version")).limit(1)
    return r.join(notes(releases).select("tag").distinct(), "tag", "left_semi").orderBy(F.desc("version")).limit(most)


def action(current: str, seen: str | None, set_up: bool) -> Column:
    """Whether to show notes, only to record the version, or nothing."""
    if seen is None:
        return F.lit("show" if set_up else "record")
    return F.when(version(F.lit(current)) > version(F.lit(seen)), "show").otherwise("nothing")
