"""Operator 11 against a plain tree, on odd rows, for blocks of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from stowline.llm.merkle_manifest import Subtree, block_root, manifest, traverse
from stowline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, index long, total long, hash string, path string, block long, part long, at long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def path(found, i):
    out = []
    for nodes in found[:-1]:
        out.append(("<" + nodes[i - 1]) if i % 2 else (">" + nodes[i + 1]) if i + 1 < len(nodes) else "=")
        i //= 2
    return out


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def fold(node, steps):
    for s in steps:
        node = sha(s[1:], node) if s[0] == "<" else sha(node, s[1:])
    return node


def brute(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), r))
    trees = {k: levels([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in by_lang.items()}
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    top = levels([trees[k][-1][0] for k in langs])
    root, out = top[-1][0] if langs else None, []
    for at, k in enumerate(langs):
        for i, (*_, own, r) in enumerate(sorted(by_lang[k], key=lambda x: x[:3])):
            steps = path(trees[k], i) + path(top, at)
            hit = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[0] is not None and r[4] is not None
            seen = fold(leaf(r[0], r[3], k, r[4] + 1, r[1]) if hit else own, steps)
            out.append((r[0], own, trees[k][-1][0], root, sha(*(s[1:] for s in steps)), seen, seen == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 2, 3, 4])
def test_traversal_gives_each_path_with_few_nodes(span):
    for n in [*range(1, 36), 64, 100, 255, 256]:
        leaves = [sha(str(i)) for i in range(n)]
        for height in {(n - 1).bit_length(), (n - 1).bit_length() + 2}:
            found = levels(leaves)
            while len(found) <= height:
                found.append([sha(found[-1][0])])
            assert block_root(leaves, height) == found[height][0]
            assert [p.split(",") if p else [] for p in traverse(leaves, height, span)] == [path(found[: height + 1], i) for i in range(n)]


def test_desired_subtrees_are_whole_in_time_and_small():
    leaves = [sha(str(i)) for i in range(4096)]
    tree = Subtree(leaves, 4, 8, 3)
    for _ in range(256):
        tree.unit()
        tree.unit()
    assert tree.whole() and len(tree.nodes) == 31


def rows():
    rng = random.Random(8)
    out = [(i, f"text {i} é" * rng.randint(0, 3), rng.choice(["en", "fr", "é", None, ""]), f"src{i % 3}", rng.randint(0, 99)) for i in range(150)]
    out += [(i, "same", "en", None, 1) for i in (5, 5, 5, 900)] + [(None, "x", "en", "s", 2), (None, None, None, None, None), (901, None, "solo", "s", None), (902, "z" * 200000, "en", "s", 2**63 - 1), (-7, "neg", "en", "s", -1)]
    return out


def frame(spark, data, partitions=4):
    return spark.createDataFrame([(*r, "k", 5, 6, "h", "p", 7, 8, 9) for r in data], SCHEMA).repartition(partitions)


@pytest.mark.parametrize("bits", [2, 12])
def test_every_tier(spark, bits):
    found = manifest(frame(spark, rows()), bits).collect()
    want = brute(rows())
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(*(s[1:] for s in r["path"]))) for r in found), key=str) == [w[:5] for w in want]
    assert all(fold(r["leaf"], r["path"]) == r["root"] for r in found)


def test_registered_query(spark, tmp_path):
    for name, data in (("all", rows()), ("one", rows()[:1]), ("none", [])):
        frame(spark, data).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/{name}")
        assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(data)
