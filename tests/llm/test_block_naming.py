"""Operator 13 against grouping by text, on odd rows, with names that straddle partitions."""

import hashlib
import random
import string
from collections import defaultdict

import pytest

from stowline.llm.block_naming import dense_names, exact_duplicates, identities
from stowline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, name string, level string, part string, key string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abAB é\x00\n") for _ in range(n)) for n in (0, 1, 15, 16, 17, 31, 32, 33, 64, 100, 1000, 5000)]
    out = [(i, rng.choice(base)) for i in range(150)]
    out += [(i, base[10].swapcase()) for i in range(200, 260)]  # a group of copies
    long = "x" * 3000
    out += [(300, long), (301, long[:-1] + "y"), (302, "y" + long[1:]), (303, long + "x"), (304, long.upper()), (305, "É" * 40), (306, "é" * 40), (307, "K" * 20), (308, "K" * 20)]
    out += [(400, None), (401, ""), (None, ""), (None, None), (None, "alone"), (None, "ALONE"), (402, "twice"), (402, "twice"), (402, "other")]
    return out


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = False
        for i in ids:
            kept = i == keep and not stays
            stays = stays or kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=str)


def frame(spark, data, partitions):
    return spark.createDataFrame([(i, t, "r", "n", "l", "p", "k", 1) for i, t in data], SCHEMA).repartition(partitions)


@pytest.mark.parametrize("size, part_bytes", [(200, 8000), (1024, 1 << 20)])
def test_equals_grouping_by_text(spark, size, part_bytes):
    found = exact_duplicates(frame(spark, rows(), 3), size, part_bytes)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows())


def test_names_are_dense_ranks_over_all_partitions(spark):
    keys = [f"{k:03}" for k in (5, 1, 9, 3) for _ in range(100)] + ["004"]
    data = spark.createDataFrame([(k.encode(), i) for i, k in enumerate(keys)], "key binary, row long")
    rank = {k: i for i, k in enumerate(sorted(set(keys)))}
    for rows in (data, data.selectExpr("cast(cast(key as string) as long) as key", "row")):
        named, marked = dense_names(rows, ["key"], ["row"], 13, "row < 7")
        assert sorted((r["row"], r["name"]) for r in named.collect()) == [(i, rank[k]) for i, k in enumerate(keys)]
        assert marked == 7
    # Two keys with one lead, at the edges of partitions.
    one = data.selectExpr("0L as lead", "key", "row")
    named, _ = dense_names(one, ["lead", "key"], ["row"], 13, lead=1)
    assert sorted((r["row"], r["name"]) for r in named.collect()) == [(i, rank[k]) for i, k in enumerate(keys)]
    assert dense_names(data.limit(0), ["key"], ["row"], 4)[0].count() == 0


def test_one_identity_a_row_and_levels_by_length(spark):
    found = {r["doc_id"]: r["level"] for r in identities(spark.createDataFrame([(n, "q" * n) for n in (0, 16, 17, 32, 33, 64, 65)], "doc_id long, text string"), 16).collect()}
    assert found == {0: 0, 16: 0, 17: 1, 32: 1, 33: 2, 64: 2, 65: 3}


def test_registered_query(spark, tmp_path):
    frame(spark, rows(), 4).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_block_naming"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows())
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert QUERIES["op13_block_naming"](spark, f"{tmp_path}/e").count() == 0
