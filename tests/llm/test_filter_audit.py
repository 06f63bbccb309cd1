"""Operator 12 against a plain replay of every order, on odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

from stowline.llm.filter_audit import COUNTS, fails
from stowline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, word string, h string, part string, mask string, n long, digest string"


def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    out = []
    for i in range(300):
        text = rng.choice([" ", "\t", " \n", "\x0b", "  "]).join(rng.choice(words[: rng.choice([60, 400])]) for _ in range(rng.choice([99, 100, 101, 150, 400])))
        text = text.upper() if rng.random() < 0.2 else text + "$" if rng.random() < 0.2 else text
        if rng.random() < 0.25 and out:
            text = rng.choice(out)[1]
        out.append((i, text, rng.choice(["en", "fr", None, ""])))
    out += [(400, None, "en"), (401, "", "de"), (402, " \t\n ", "de"), (None, out[0][1], "en"), (None, "x", None), (None, "x", None), (None, " ".join(words), "en"), (5, out[5][1], out[5][2]), (5, out[5][1], "fr"), (5, "another text", "en"), (403, " " + "A" * 11 + "b" * 89, "xx"), (404, "A" * 10 + "b" * 90, "xx"), (405, "ZZ\ttop\x85top top", "xx"), (406, "long " * 40000, "xx")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 300, 2)] + [(0, 1, 1), (None, 1, 1), (7, None, None), (9, 1, None)]
    return out, labels


def masks(rows):
    out = []
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        out.append((i, lang or "", {c for c, b in zip("ABCDE", bits, strict=True) if b}))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    found, out, by_part = masks(rows), {}, {}
    for doc in found:
        by_part.setdefault(doc[1], []).append(doc)
    for part, docs in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                failing = sum(f in d[2] for d in docs)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[2] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[6] = shapley[value[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_flags_and_registered_query(spark, tmp_path):
    data, labels = rows()
    docs = spark.createDataFrame([(i, t, lang, "w", "h", "p", "m", 1, "d") for i, t, lang in data], SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    flags = sorted(((r["doc_id"], r["part"], "".join(c.upper() for c in "abcde" if r[c])) for r in fails(docs).collect()), key=str)
    assert flags == sorted(((i, p, "".join(sorted(m))) for i, p, m in masks(data)), key=str)
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in QUERIES["op12_filter_audit"](spark, str(tmp_path)).collect()}
    assert found == brute(data, labels)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES["op12_filter_audit"](spark, str(tmp_path)).count() == 0
