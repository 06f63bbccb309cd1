"""The pipeline, stage by stage and as a whole, on a small corpus with odd rows."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from stowline.llm import word_cache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string"


def corpus():
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    good = lambda n: " ".join(word() for _ in range(n))
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        rows.append((i, good(80) if i % 3 else bad()))
        labels.append((i, int(i % 3 != 0), 0))
    base = good(120).split()
    near = list(base)
    near[60] = "other"
    item = good(30) + ". " + good(8) + "."
    rows += [(1000, " ".join(base)), (1001, " ".join(base)), (1002, " ".join(near)), (1003, good(100) + " " + item + " " + good(50)), (1004, good(60) + " mail a.b@c.de or +1 (234) 555-1234, later 555-1234 " + good(60)), (1005, good(9000)), (1006, bad()), (1007, None), (1008, ""), (1004, good(90)), (None, good(50))]
    return rows, labels, [(1, item), (None, good(20)), (2, None)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, labels, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "k") for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_and_the_whole(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {name: [i for i, _ in rows] for name, rows in kept.items()}
    # Quality: the shouting goes, clean prose stays.
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i in set(ids["quality"])) == (i % 3 != 0) for i in held) > 0.95 * len(held)
    assert 1006 not in ids["quality"] and {1000, 1001, 1002, 1003, 1004, 1005} <= set(ids["quality"]) and None not in ids["quality"]
    # Near-duplicates: the smallest of each group stays; rows of one doc_id stay together.
    assert 1000 in ids["near_dedup"] and not {1001, 1002} & set(ids["near_dedup"])
    assert sorted(set(ids["quality"]) - set(ids["near_dedup"]) - {1007, 1008}) == [1001, 1002]
    # Decontamination: the document with the item goes, alone.
    assert sorted(set(ids["near_dedup"]) - set(ids["decontamination"])) == [1003]
    # Personal data: masked, and nothing else changes.
    before, after = sorted(kept["decontamination"], key=str), sorted(kept["personal_data"], key=str)
    changed = [t for (i, t) in after if (i, t) not in before]
    assert len(changed) == 1 and changed[0].count("[PHONE]") == 2 and changed[0].count("[EMAIL]") == 1
    # Packing: every id of every document in exactly one piece.
    path = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")
    whole = corpus_pipeline.run(spark, data).toPandas()
    want = sorted(len(x) + 1 for x in word_cache.encode_whole(path, [t or "" for _, t in after]))
    assert whole["length"].sum() == sum(want) and set(whole["doc_id"]) == set(ids["personal_data"])
    texts = {i: np.append(x, 1).astype("<u4") for (i, _), x in zip(after, word_cache.encode_whole(path, [t or "" for _, t in after]), strict=True) if i != 1004}
    for i, g in whole[whole["doc_id"] != 1004].sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert [zlib.crc32(texts[i][a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()


def test_empty_tables(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
