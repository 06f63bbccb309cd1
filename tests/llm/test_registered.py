"""Registered queries on a folder of small tables: the columns that they derive from their operators' results."""

import hashlib
import zlib

import pytest
import xxhash

from stowline.llm.queries import QUERIES
from test_operators import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, law string, fp string"


@pytest.fixture(scope="module")
def rows():
    return [*corpus(seed=2, n=80), (1000, None), (1001, "PASS " * 40), (1002, "pass " * 40)]


@pytest.fixture(scope="module")
def data(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", 1, "k", "l", "f") for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_op1_digests(spark, data, rows):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        strings = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + 50] = b"\x01" * 50
        seen.update(strings)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op1_suffix_dedup"](spark, data).collect()}
    assert got == want and any(n for _, n, _, _ in want.values())


def test_op4_laws_sizes_and_slots(spark, data, rows):
    got = QUERIES["op4_kk_sharding"](spark, data).collect()
    texts = {i: (t or "").encode() for i, t in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {(i, len(b) + 16, zlib.crc32(b), "bytes", None) for i, b in texts.items()}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(40))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_op6_scores_and_predictions(spark, data, rows):
    got = QUERIES["op6_subword_quality"](spark, data).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_op7_fingerprints_and_components(spark, data, rows):
    prints = {}
    for i, t in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_covering_simhash"](spark, data).collect()}
    assert got == {i: (f"{prints[i]:016x}", top(i)) for i in ids}
