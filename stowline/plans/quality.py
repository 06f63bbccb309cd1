"""Quality of what the engine derives: parity, calibration, manifests, ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scoring import CAVEATS
from ..functions.text import NON_RELOCATING

TOLERANCE = 0.002
# Move types that stay on their own grid, in lower case; seconds between a request and its move; ages of beliefs.
SAME_GRID = ["split", "stack", "ammorepool"]
CAPTURE_S = 10
AGES = [("< 1 h", 3600), ("1 h – 1 d", 86400), ("1 – 7 d", 7 * 86400), ("7 – 30 d", 30 * 86400)]
OLDEST = "> 30 d"
# Metric -> (higher is better, objective, limit that no run may break).
METRICS = {
    "capture.request_rate": (True, 0.98, None), "capture.unrecognised_lines": (False, 0.0, 0.0),
    "enrich.geid_coverage": (True, 0.85, None), "enrich.confirmed_rate": (True, 0.95, None),
    "ledger.accounted_rate": (True, 0.95, None), "ledger.duplicate_risk_rate": (False, 0.02, None), "worn.evicted_then_resighted": (False, 0.0, None),
    "holdings.high_share": (True, 0.8, None), "holdings.low_share": (False, 0.05, None), "holdings.mean_score": (True, 0.85, None), "holdings.inferred_share": (False, 0.05, None), "holdings.first_seen_share": (False, 0.15, None),
    "placement.within_build_same_place": (True, 0.95, None), "placement.brier": (False, 0.05, None), "placement.across_update_same_place": (True, 0.9, None),
    "live.parity": (True, 1.0, 1.0), "live.cold_parity": (True, 0.95, None),
}
CALIBRATION_SHARE, LEAST_CHECKS, DEFAULT_FACTOR = 0.7, 5, 0.5


def parity(live: DataFrame, cold: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: fingerprints of both replays, of either, of one alone, and the ratio of the first two.

    Repeats are counted, not listed: a fingerprint is shared as often as the side that has it less often.
    """
    counts = [d.groupBy(*columns).agg(F.count("*").alias(n)) for d, n in ((live, "a"), (cold, "b"))]
    both = counts[0].join(counts[1], columns, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    out = both.agg(F.sum(F.least("a", "b")).alias("shared"), F.sum(F.greatest("a", "b")).alias("either"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_live"))
    return out.withColumn("parity", F.col("shared") / F.col("either"))


def holdout_brier(checks: DataFrame, build: str, at: str, survived: str) -> DataFrame:
    """Builds' survival on the first part of the distinct times, held against the rest.

    The distinct times are ranked on their own, by counts of a table with a row for each time.
    """
    times = checks.select(at).distinct()
    n = times.count()
    cut = max(1, min(n - 1, -(-n * 7 // 10)))
    # The cut is one value: the last time of the calibration part.
    ordered = times.orderBy(at).limit(cut).agg(F.max(at).alias("cut"))
    split = checks.crossJoin(F.broadcast(ordered))
    early, late = split.where(F.col(at) <= F.col("cut")), split.where(F.col(at) > F.col("cut"))
    y = F.col(survived).cast("double")
    p = early.groupBy(build).agg(F.avg(y).alias("p"), F.count("*").alias("c")).where(F.col("c") >= LEAST_CHECKS).select(build, "p")
    return late.join(p, build, "left").groupBy(build).agg(F.count("*").alias("n"), F.avg(F.pow(F.coalesce("p", F.lit(DEFAULT_FACTOR)) - y, 2)).alias("brier"))


def _long(row: DataFrame) -> DataFrame:
    """The columns of a one-row table as rows (metric, value); nulls go."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL")


def _share(when: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.avg(F.coalesce(when, F.lit(False)).cast("double")), F.lit(empty))


def enrichment(moves: DataFrame) -> DataFrame:
    """(metric, value): moves that name their entity, and moves that the game confirmed."""
    return _long(moves.agg(_share(F.col("item_geid").isNotNull(), 1.0).alias("enrich.geid_coverage"), _share(F.lower("result") == "succeed", 1.0).alias("enrich.confirmed_rate")))


def holding_rates(holdings: DataFrame) -> DataFrame:
    """(metric, value) of resolved holdings: rank, score, caveats."""
    told = lambda text: F.array_contains("caveats", text)
    return _long(
        holdings.agg(
            _share(F.col("rank") == 2).alias("holdings.high_share"), _share(F.col("rank") == 0).alias("holdings.low_share"), F.coalesce(F.avg("score"), F.lit(1.0)).alias("holdings.mean_score"),
            _share(told(CAVEATS["duplicate_risk"])).alias("holdings.inferred_share"), _share(told(CAVEATS["first_seen"])).alias("holdings.first_seen_share"),
        )
    )


def ledger_rates(rows: DataFrame) -> DataFrame:
    """(metric, value) of the account's counters, over all accounts."""
    n = lambda name: F.coalesce(F.sum(F.when(F.col("detail") == name, F.col("quantity"))), F.lit(0))
    one = rows.where("row_kind = 'stat'").agg(n("class_units").alias("units"), n("duplicate_risk").alias("risk"), (n("from_named") + n("from_loose")).alias("hit"), n("seen_again").alias("again"))
    share = lambda c, empty: F.when(F.col("units") == 0, empty).otherwise(c / F.col("units"))
    return _long(one.select((1 - share(F.col("risk"), 0.0)).alias("ledger.accounted_rate"), share(F.col("risk"), 0.0).alias("ledger.duplicate_risk_rate"), share(F.col("hit"), 1.0).alias("ledger.source_hit_rate"), F.col("again").alias("worn.evicted_then_resighted")))


def crossed(checks: DataFrame, updates: DataFrame) -> DataFrame:
    """checks with ``crossed``, whether a game update came between belief and check, and ``predicted``, the trust left by those that did.

    updates are those of ``update_factors``; an account has a handful of them, so they come as a list.
    """
    listed = updates.groupBy("account").agg(F.collect_list(F.struct(F.col("at").alias("u"), "factor")).alias("_u"))
    between = lambda x: (x["u"] > F.col("since")) & (x["u"] <= F.col("at"))
    worst = F.array_min(F.transform(F.filter("_u", between), lambda x: x["factor"]))
    c = checks.join(listed, "account", "left")
    return c.withColumns({"crossed": F.coalesce(F.exists("_u", between), F.lit(False)), "predicted": F.coalesce(worst, F.lit(1.0))}).drop("_u")


def placement_rates(checks: DataFrame) -> DataFrame:
    """(metric, value) of crossed() checks: agreement in all, within a build and across updates, and the error of the trust."""
    same = F.col("same_place").cast("double")
    return _long(checks.agg(F.avg(same).alias("placement.accuracy"), F.avg(F.when(~F.col("crossed"), same)).alias("placement.within_build_same_place"), F.avg(F.when(F.col("crossed"), same)).alias("placement.across_update_same_place"), F.avg(F.pow(F.col("predicted") - same, 2)).alias("placement.brier")))


def age_bucket(seconds: Column) -> Column:
    out = F.when(seconds < AGES[0][1], AGES[0][0])
    for label, most in AGES[1:]:
        out = out.when(seconds < most, label)
    return out.otherwise(OLDEST)


def placement_table(checks: DataFrame) -> DataFrame:
    """Checks by how long the belief had stood, within a build and across updates, and how many held."""
    age = (F.unix_micros("at") - F.unix_micros("since")) / 1_000_000
    return checks.groupBy(age_bucket(age).alias("age"), "crossed").agg(F.count("*").alias("checked"), F.count_if("same_place").alias("held"))


def caveat_shapes(holdings: DataFrame) -> DataFrame:
    """Caveats by what they say, whatever names and numbers are in them."""
    text = F.regexp_replace(F.regexp_replace("caveat", "'[^']*'", "'…'"), r"\d+", "#")
    return holdings.select(F.explode("caveats").alias("caveat")).groupBy(text.alias("caveat")).agg(F.count("*").alias("n"))


def miss_causes(rows: DataFrame) -> DataFrame:
    """Units that were not where a move took them from, by cause and by what made up for them."""
    made_up = F.when(F.col("carried"), "found on the player").when(F.col("duplicate_risk"), F.concat(F.lit("held elsewhere: "), F.col("elsewhere"))).otherwise("first seen")
    return rows.where("row_kind = 'miss'").groupBy(F.col("detail").alias("cause"), made_up.alias("made_up")).agg(F.sum("quantity").alias("units"))


def report(found: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(metric, value, baseline, objective, gain, ok): gain is signed, better is positive; not ok: lost more than the tolerance, or broke a limit."""
    spark = found.sparkSession
    rules = spark.createDataFrame([(i, m, *rule) for i, (m, rule) in enumerate(METRICS.items())], "n int, metric string, higher boolean, objective double, limit double")
    old = (baseline if baseline is not None else spark.createDataFrame([], "metric string, value double")).select("metric", F.col("value").alias("baseline"))
    both = found.join(F.broadcast(rules), "metric").join(old, "metric", "left")
    sign = F.when(F.col("higher"), 1.0).otherwise(-1.0)
    gain = sign * (F.col("value") - F.col("baseline"))
    kept = F.coalesce(sign * (F.col("value") - F.col("limit")) >= 0, F.lit(True))
    return both.select("n", "metric", "value", "baseline", "objective", gain.alias("gain"), (kept & F.coalesce(gain >= -TOLERANCE, F.lit(True))).alias("ok")).orderBy("n").drop("n")


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """A report as JSON lines or as a Markdown table, in one file of a folder; it has a row for each metric."""
    rows = rows.coalesce(1)
    if form == "json":
        rows.write.mode("overwrite").json(path)
        return
    cell = lambda c: F.coalesce(F.format_number(c, 4), F.lit("—"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "metric", cell("value"), cell("baseline"), cell("objective"), F.when(F.col("ok"), "ok").otherwise("failed")), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([("| Metric | Value | Baseline | Objective | Status |",), ("|---|---:|---:|---:|---|",)], "value string").coalesce(1)
    head.unionByName(rows.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted manifest, a line for each file."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "name"))), "\n"), 256).alias("fingerprint"))


def _captured(shapes: DataFrame, moves: DataFrame) -> tuple[DataFrame, Column]:
    """Requests that ask for a move to another place, and what makes a move one's own: the number, ten seconds apart at most."""
    asked = shapes.where(F.col("is_add") & ~F.col("blank") & ~F.col("move_type").isin(*NON_RELOCATING) & ~F.lower("move_type").isin(*SAME_GRID))
    near = F.abs(F.unix_micros(asked["ts"]) - F.unix_micros(moves["ts"])) <= CAPTURE_S * 1_000_000
    return asked, (asked["session_id"] == moves["session_id"]) & (asked["request_no"] == moves["request_no"]) & near


def capture_rate(shapes: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: requests, recognised by their shape alone (``events.request_shapes``), those that became a move, and their share."""
    asked, own = _captured(shapes, moves)
    hit = asked.join(moves, own, "left_semi").agg(F.count("*").alias("hit"))
    return asked.agg(F.count("*").alias("requests")).crossJoin(hit).withColumn("rate", F.when(F.col("requests") == 0, 1.0).otherwise(F.col("hit") / F.col("requests")))


def missed_requests(shapes: DataFrame, moves: DataFrame) -> DataFrame:
    """Requests that never became a move, by type."""
    asked, own = _captured(shapes, moves)
    return asked.join(moves, own, "left_anti").groupBy("move_type").agg(F.count("*").alias("n"))
