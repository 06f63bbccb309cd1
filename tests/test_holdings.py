"""Checks across updates, against counting each pair."""

import random
from datetime import datetime, timedelta

from stowline.plans.holdings import update_factors

START = datetime(2026, 8, 1)


def test_update_factors_equal_counting_pairs(spark):
    rng = random.Random(6)
    at = lambda: START + timedelta(minutes=rng.randrange(60))
    updates = [(a, b, at(), "x") for a in ("a", "b", "c") for b in range({"a": 12, "b": 1, "c": 3}[a])]
    updates += [("a", 50, updates[0][2], "x")]
    checks = [(rng.choice("abd"), at(), at(), rng.choice([True, False, None])) for _ in range(400)] + [("a", START, None, True), ("a", None, START, True)]
    found = update_factors(spark.createDataFrame(checks, "account string, since timestamp, at timestamp, same_place boolean"), spark.createDataFrame(updates, "account string, build int, at timestamp, spawn string"))
    assert found.columns == ["account", "build", "at", "spawn", "checked", "survived", "factor"]
    want = set()
    for a, b, t, s in updates:
        spans = [same for who, since, seen, same in checks if who == a and since and seen and since < t <= seen]
        want.add((a, b, t, s, len(spans), sum(x is True for x in spans)))
    assert {tuple(r)[:6] for r in found.collect()} == want and found.count() == len(updates)
    assert max(r["checked"] for r in found.collect()) > 20


def test_no_checks_and_no_updates(spark):
    none = spark.createDataFrame([], "account string, since timestamp, at timestamp, same_place boolean")
    one = spark.createDataFrame([("a", 1, START)], "account string, build int, at timestamp")
    assert [tuple(r)[3:5] for r in update_factors(none, one).collect()] == [(0, 0)]
    assert update_factors(none, one.limit(0)).count() == 0
