"""The document operators against brute force, exact round trips and held-out rows, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

from stowline.llm import bm25_decontam, covering_simhash, dac_tokens, flac_media, kk_sharding, license_scan, skip_chain_pii, subword_quality, suffix_dedup, vector_packing, word_cache
from stowline.llm.common import id_and_text, join_hot
from stowline.llm.components import connected_components
from stowline.llm.queries import QUERIES

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, block string, key string, score string, n_chars long"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["été", "x%%%", "The"]
    line = " ".join(rng.choice(words) for _ in range(12))
    texts = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if i % 4 == 0:
            t += "\n" + line
        if i % 10 == 3 and texts:
            t = texts[rng.randrange(len(texts))]
        texts.append(t)
    texts += ["", " ", "one", "a" * 500, "ab" * 2000, " ".join(rng.choice(words) for _ in range(9000)), "日本 語\t\r\n x", "퟿\U0001f600 \x00 x"]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, "p", None, "k", None, len(t or "")) for i, t in rows], SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (1000, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, [*rows, (None, "no id")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def removed(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                gone[k : k + length] = 1
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), bytes(x for x, g in zip(b, gone, strict=False) if not g))
    return out


@pytest.mark.parametrize("hot", [500_000, 40, 1])
def test_repeats_are_those_of_brute_force(docs, rows, hot):
    found = suffix_dedup.remove_repeats(docs, block_bytes=3000, bucket_bytes=5000, hot=hot).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["span_starts"]), bytes(r["kept"])) for r in found}
    assert got == removed(rows) and any(x[1] for x in got.values())


def test_repeats_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_groups_are_in_byte_order():
    text = np.frombuffer((b"abracadabra" * 20) + bytes(8), np.uint8)
    at = np.arange(len(text) - 58)
    order, group = suffix_dedup.suffix_groups(text, at, 50)
    strings = [bytes(text[at[i] : at[i] + 50]) for i in order]
    assert strings == sorted(strings) and len(set(strings)) == len(set(group.tolist()))


# 2


def test_base_spans_are_those_of_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab1.@-+ %") for _ in range(40))
        assert [m.span() for m in email.finditer(t)] == [(a, z) for k, a, z in skip_chain_pii.base_spans(t) if k == 0]
    t = "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (234) 555-1234 +12"
    assert [(skip_chain_pii.KINDS[k], t[a:z]) for k, a, z in skip_chain_pii.base_spans(t)] == [("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "0255.1.1.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 555-1234")]


def test_field_carries_labels_to_mentions_and_leaves_numbers_alone():
    f = skip_chain_pii.field()
    assert f.accuracy > 0.95 and f.precision > 0.95 and f.recall > 0.9
    t = "Call +1 (377) 555-0271 today. " + "words " * 300 + "Then 555-0271 again, in 2021 with 12 items of v2.0.1, order 5550."
    base, added = skip_chain_pii.find(f, [t])[0]
    assert [t[a:z] for _, a, z in added] == ["555-0271"] and skip_chain_pii.mask(t, base + added).count("[PHONE]") == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ("Call +1-377-555-0271 now, later words and 377-555-0271 again", ["377-555-0271"]),
        ("tel +15550001111 and more text 5550001111 end", ["5550001111"]),
        ("Phone +1 (377) 555-0271 is the same as 3775550271 here", ["3775550271"]),
        ("card 4111 1111 1111 1111 then again 4111.1111.1111.1111 ok", ["4111.1111.1111.1111"]),
        ("ip 10.20.30.40 and 10-20-30-40 ok", ["10-20-30-40"]),
        ("mail john.doe77@foo.com and john.doe77@foo too", ["john.doe77@foo"]),
        ("number 1234567812345678 and 1234-5678-1234-5678, 4111111111111112", []),
    ],
)
def test_similar_forms_are_linked(text, want):
    _, added = skip_chain_pii.find(skip_chain_pii.field(), [text])[0]
    assert [text[a:z] for _, a, z in added] == want


def test_long_runs_take_linear_time():
    import time

    skip_chain_pii.field()
    began = time.time()
    assert skip_chain_pii.base_spans("7" * 1_000_000 + " 1.2.3.4 " + "5." * 3) == [(1, 1_000_001, 1_000_008)]
    skip_chain_pii.find(skip_chain_pii.field(), ["7" * 1_000_000])
    assert time.time() - began < 2


def test_personal_data_query_is_brute_force(docs, rows, spark):
    """Every column of the query against the patterns as they are written in its contract."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(22)
    odd = ["".join(rng.choice("0123456789.@-+ ()ab") for _ in range(200)) for _ in range(200)]
    odd += ["call +1 (234) 555-1234 or a.b@c.de, 4111-1111-1111-1111, 10.0.0.1; 4111.1111.1111.1111 and 555-1234 é +12 345 678"] * 2
    own = [*rows, *((5000 + i, t) for i, t in enumerate(odd))]

    def good(kind, t):
        digits = [int(c) for c in t if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in t.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    got = {r["doc_id"]: r for r in QUERIES["op2_skip_chain_pii"].__globals__["personal_data"](frame(spark, own)).collect()}
    assert len(got) == len(own)
    more = 0
    for i, t in own:
        base = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        assert [got[i][f"n_{k}"] for k in patterns] == [sum(b[0] == k for b in base) for k in patterns]
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        spans = [(list(patterns).index(x.split(":")[0]), *map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x]
        assert spans == sorted(spans) and {(list(patterns).index(k), a, z) for k, a, z in base} <= set(spans)
        more += len(spans) - len(base)
        assert all(good("card", t[a:z]) for k, a, z in spans if k == 2)
    assert more >= 4


def test_personal_data(docs, rows, none):
    got = {r["doc_id"]: r for r in skip_chain_pii.personal_data(docs).collect()}
    assert set(got) == {i for i, _ in rows} and got[1000]["spans"] == ""
    masked = skip_chain_pii.mask_personal_data(docs)
    assert masked.columns == docs.columns and masked.where("doc_id = 1000").first()["text"] is None
    assert skip_chain_pii.personal_data(none).count() == 0


# 3


def check_packing(found, ids, tokens=2048, segments=32, loss=2016, prompt=32):
    assert sorted(found["doc_id"].unique()) == sorted(ids)
    for i, g in found.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(ids[i]) == g["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[i][a : a + n].astype("<u4").tobytes()) for a, n in zip(g["start"], g["length"], strict=True)] == g["ids_crc32"].tolist()
        assert [max(0, a + n - max(a, prompt)) for a, n in zip(g["start"], g["length"], strict=True)] == g["loss_tokens"].tolist()
    padding = 0
    for _, g in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        n = int(g["length"].sum())
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and n <= tokens and len(g) <= segments and g["loss_tokens"].sum() <= loss
        padding += 0 if n & (n - 1) == 0 else tokens - n
    return padding / found["length"].sum()


def test_packing(docs, rows, none):
    ids = {i: np.append(x, 1) for (i, _), x in zip(rows, word_cache.encode_whole(WORD, [t or "" for _, t in rows]), strict=True)}
    found = vector_packing.pack(docs, WORD).toPandas()
    assert check_packing(found, ids) == 0
    assert found.groupby("sequence_id")["loss_tokens"].sum().max() > 1900
    tight = vector_packing.pack(docs, WORD, max_tokens=256, max_segments=3, max_loss=200, prompt_tokens=5).toPandas()
    check_packing(tight, ids, 256, 3, 200, 5)
    assert vector_packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("low, high", [(3, 3), (3, 10), (20, 40), (1, 3000), (5000, 9000)])
def test_no_padding_whatever_the_lengths(low, high):
    rng = np.random.default_rng(low)
    packer = vector_packing.Packer(2048, 32, 2016, 32, 8, 0)
    ids = {i: rng.integers(0, 1000, rng.integers(low, high + 1), np.uint32) for i in range(3000 if high < 100 else 300)}
    for i, x in ids.items():
        packer.add(i, x)
        if len(packer.pool) >= 500:
            packer.pack(250)
    packer.pack(0)
    found = pd.DataFrame(packer.out, columns=[c.split()[0] for c in vector_packing.RESULT.split(", ")])
    assert check_packing(found, ids) == 0 and not packer.pool
    if low > 1000 or low == 1:
        assert (found.groupby("sequence_id")["length"].sum() >= 1024).mean() > 0.9


# 4


def test_karmarkar_karp_is_better_than_dealing():
    rng = random.Random(4)
    sizes = [rng.randint(1, 10_000) for _ in range(500)]
    sums = np.bincount(kk_sharding.karmarkar_karp(sizes, 8), sizes, minlength=8)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() < 10


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(200)], "i long, k long")
    one = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 AS v").where("k <> 5")
    for least in (1, 30, 1000):
        got = sorted(tuple(r) for r in join_hot(rows, one, ["k"], 200, least).select("i", "k", "v").collect())
        assert got == [(i, k, k * 10) for i, k in sorted((i, i % 7 if i % 3 else 0) for i in range(200)) if k != 5]


def test_an_odd_radius_raises(docs):
    with pytest.raises(ValueError):
        covering_simhash.near_duplicates(docs, radius=3)


@pytest.mark.parametrize("part_groups,fan,hot", [(50_000, 2000, 200_000), (4, 3, 2)])
def test_shards(docs, rows, part_groups, fan, hot, monkeypatch):
    monkeypatch.setattr(join_hot, "__defaults__", (hot,))
    got = kk_sharding.shard(docs, 7, part_groups, fan).toPandas().sort_values("doc_id")
    # One text is larger than a shard's share; the other shards are near equal.
    sums = sorted(np.bincount(got["shard"], got["size"], minlength=7))
    assert part_groups < 100 or sums[-2] - sums[0] < 50
    text = {i: (t or "").encode() for i, t in rows}
    assert got["doc_id"].tolist() == sorted(text) and got["size"].tolist() == [len(text[i]) + 16 for i in sorted(text)] and got["text_crc32"].tolist() == [zlib.crc32(text[i]) for i in sorted(text)]
    assert got.assign(t=[text[i] for i in got["doc_id"]]).groupby("t")["shard"].nunique().max() == 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards_of_nothing(none):
    assert kk_sharding.shard(none).count() == 0


# 5


def test_wand_finds_what_scores_above(rows):
    index = bm25_decontam.Index([(i, t[:300]) for i, t in rows if t])
    rng = random.Random(5)
    real = [k for k, w in enumerate(index.words) if w]
    for _ in range(200):
        item = rng.choice(real)
        terms = sorted({rng.randrange(len(index.vocabulary)) for _ in range(20)} | {t for t, p in enumerate(index.lists) if any(i == item for i, _ in p) and rng.random() < 0.8})
        scores = {}
        for t in terms:
            for i, x in index.lists[t]:
                scores[i] = scores.get(i, 0) + x
        threshold = rng.choice([0.1, 0.4, 0.7])
        assert sorted(i for i, _ in index.above(terms, threshold)) == sorted(i for i, x in scores.items() if x >= threshold - 1e-6)
        for _, first, end in index.classes:
            assert sorted(i for i, _ in index.above(terms, threshold, first, end)) == sorted(i for i, x in scores.items() if x >= threshold - 1e-6 and first <= i < end)


def test_contaminated_is_brute_force_whatever_the_slices(spark):
    """Every item against every passage, with documents that hold about as much of an item as the threshold asks."""
    import math
    from collections import Counter

    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("klmnop") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, ". ".join(plain(rng.randint(2, 40)) for _ in range(rng.randint(1, 3))) + ".") for k in range(40)]
    items += [(3, items[3][1] + " more words"), (500, items[0][1]), (501, "short one")]
    docs = [(0, None), (1, ""), (2, plain(700))]
    for k, t in items:
        w = t.split()
        keep = [x for x in w if rng.random() < rng.choice([0.75, 0.85, 0.95, 1])]
        docs.append((100 + len(docs), plain(rng.randint(0, 90)) + " " + " ".join(keep) + " " + plain(rng.randint(0, 60))))
    words = bm25_decontam.words
    held = [(i, t, words(t)) for i, t in items]
    df = Counter(x for _, _, w in held for x in set(w))
    mean = sum(len(w) for _, _, w in held) / len(held)
    weight = lambda w, x: math.log(1 + (len(held) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    want, near = {}, 0
    for d, t in docs:
        own = words(t or "")
        for i, text, w in held:
            size = 1
            while size < len(w):
                size *= 2
            span = (1 + -(-size // 30)) * 30
            total = sum(weight(w, x) for x in set(w))
            for a in range(0, len(own), 30):
                passage = own[a : a + span]
                score = sum(weight(w, x) for x in set(w) & set(passage)) / total
                near += 0.65 < score < 0.75
                if score < 0.7 - 1e-6:
                    continue
                q, r = (bm25_decontam._overlap(p, passage) for p in bm25_decontam.Index._parts(text))
                if q >= 0.8 and r >= 0.8:
                    want[d, i] = max(want.get((d, i), ()), (round(score, 5), round(q, 6), round(r, 6), -a))
    assert len(want) > 20 and near > 100
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slices, size in ((2000, 8 << 20), (3, 8 << 20), (3, 2000)):
        got = bm25_decontam.contaminated(frame(spark, docs), bench, slice_items=slices, scan_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]): (round(r["score"], 5), round(r["question_overlap"], 6), round(r["answer_overlap"], 6), -r["word_start"]) for r in got} == want
        assert len(got) == len(want)


def test_words_that_differ_behind_32_bytes_have_other_keys():
    raw = [b"x" * 40 + b"a", b"x" * 40 + b"b", b"x" * 1000 + b"c", b"x" * 1000 + b"d", b"y"]
    ends = np.cumsum([len(r) for r in raw])
    keys = bm25_decontam._keys(np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8), ends - [len(r) for r in raw], ends)
    assert len(set(keys.tolist())) == 5


def test_decontamination(spark, docs, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("klmnopqrstuvw") for _ in range(rng.randint(3, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60))) + ". " + " ".join(word() for _ in range(5)) + ".") for k in range(12)]
    plain = lambda n: " ".join(word() for _ in range(n))
    rows = [(10 * k, plain(200) + " " + t.upper().replace(" ", "\n") + " " + plain(500)) for k, t in items] + [(7, items[0][1][: len(items[0][1]) // 3] + plain(300)), (9, None)]
    bench = spark.createDataFrame([*((k, t, "x") for k, t in items), (99, None, "x"), (None, "a b c", "x"), (98, "...", "x")], "item_id long, text string, score string")
    for size in (2000, 5):
        got = bm25_decontam.contaminated(frame(spark, rows), bench, slice_items=size).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10 * k, k) for k, _ in items]
    assert sorted(r["doc_id"] for r in bm25_decontam.decontaminate(frame(spark, rows), bench).collect()) == [7, 9]
    assert bm25_decontam.contaminated(none, bench).count() == 0 and bm25_decontam.contaminated(docs, bench.limit(0)).count() == 0


# 6


def test_quality_is_learnt_and_held_out(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        w = [word() for _ in range(60)]
        bad = [x.upper() + "!!" for x in w] if i % 2 else [w[k // 15] for k in range(60)]
        rows.append((i, " ".join(w if good else bad)))
        labels.append((i, int(good), None))
    labels += [(5, None, None), (None, 1, None), (99999, 1, None)]
    truth = dict((i, q) for i, q, _ in labels[:400])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (1000, None), (1001, "")])
    got = {r["doc_id"]: r["score"] for r in subword_quality.score(docs, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in held]) > 0.95 and all(0 <= x <= 1 for x in got.values()) and got[1000] == got[1001]
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", subword_quality.held_out("doc_id").alias("h")).collect()}
    assert sorted(i for i, h in flags.items() if h and i < 400) == held
    assert {r["score"] for r in subword_quality.score(docs, lab.limit(0)).collect()} == {0.5}
    kept = subword_quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.7 for s in got.values())


# 7


def brute_classes(prints, radius=4):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_classes(docs, rows):
    prints = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in covering_simhash.near_duplicates(docs).collect()}
    assert {i: f for i, (f, _) in got.items()} == prints and {i: c for i, (_, c) in got.items()} == brute_classes(prints)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_no_link_is_lost(spark, bucket):
    rng, prints = random.Random(8), {}
    for c in range(4):
        base = rng.getrandbits(64)
        for k in range(25):
            prints[100 * c + k] = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    nodes = {f: min(i for i in prints if prints[i] == f) for f in prints.values()}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in nodes], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(covering_simhash.links(df, 4, bucket)).collect()}
    least = {}
    for f, i in nodes.items():
        least[roots.get(f, f)] = min(i, least.get(roots.get(f, f), i))
    assert {i: least[roots.get(f, f)] for f, i in nodes.items()} == brute_classes({i: f for f, i in nodes.items()})


def test_every_pair_within_the_radius_shares_a_table():
    masks = [m % (1 << 64) for m in covering_simhash.covering_masks(4)]
    rng = random.Random(9)
    assert all(any(sum(1 << b for b in rng.sample(range(64), 4)) & m == 0 for m in masks) for _ in range(0)) and len(masks) == 31
    for _ in range(5000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & m == 0 for m in masks)


def test_components_of_nothing_and_of_a_path(spark, none):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(5, 5), (3, 2)], "u long, v long")
    assert {r["root"] for r in connected_components(path).collect()} == {0}
    assert covering_simhash.near_duplicates(none).count() == 0


# 8


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_cache_is_the_library(rows, path):
    texts = [t or "" for _, t in rows] + ["don't can't x", " a", "a  b", "a\n\nb", "12 34.5 'll", "é .'s x", "“x” y", "x́ .́a", "a×b ÷c", "supercalifragilisticexpialidociousandmoreletters!!!! ok", "x\x1cy z", "　x y", "ΑΣ ΣΑ"]
    for cache in (word_cache.WordCache(path),) * 2:
        assert all(np.array_equal(a, b) for a, b in zip(cache.encode(texts), word_cache.encode_whole(path, texts), strict=True))


def test_codes_give_any_token():
    for ids in ([], [0], [255, 256, 65535, 65536, 1 << 31], np.random.default_rng(0).integers(0, 50257, 3000).tolist()):
        s = dac_tokens.Segment(dac_tokens.encode_ids(np.array(ids, "<u4")))
        assert s.run(0, len(ids)).tolist() == ids and [s.token(i) for i in range(0, len(ids), 7)] == ids[::7]
        for a in range(0, len(ids), 97):
            z = min(len(ids), a + 1 + a * 7 % 1300)
            assert s.run(a, z).tolist() == ids[a:z] and s.run(a, a).tolist() == []


def test_token_ids(docs, rows, none, monkeypatch):
    ids = {i: np.append(x, 0).astype("<u4") for (i, _), x in zip(rows, word_cache.encode_whole(BYTE, [t or "" for _, t in rows]), strict=True)}
    got = dac_tokens.token_ids(docs, BYTE).toPandas().sort_values("doc_id")
    n = np.array([len(ids[i]) for i in sorted(ids)])
    assert got["doc_id"].tolist() == sorted(ids) and got["n_tokens"].tolist() == n.tolist() and got["start"].tolist() == (np.cumsum(n) - n).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(ids[i].tobytes()) for i in sorted(ids)]
    assert dac_tokens.token_ids(none, BYTE).count() == 0
    monkeypatch.setattr(dac_tokens, "SEGMENT_IDS", 500)
    segments = dac_tokens.write_segments(docs, BYTE)
    wanted = [(i, k) for i in sorted(ids) for k in (0, len(ids[i]) // 2, len(ids[i]) - 1, len(ids[i]), -1)] + [(10**9, 0)]
    asked = dac_tokens.tokens_at(segments, docs.sparkSession.createDataFrame(wanted, "doc_id long, index int")).collect()
    assert {(r["doc_id"], r["index"]): r["token"] for r in asked} == {(i, k): int(ids[i][k]) for i, k in wanted if i in ids and 0 <= k < len(ids[i])}
    assert len(asked) == len({(i, k) for i, k in wanted if i in ids and 0 <= k < len(ids[i])})


# 9


def test_streams_come_back_and_damage_is_found():
    rng = np.random.default_rng(9)
    waves = [(128 + 60 * np.sin(np.arange(192 * 20) / 9)).astype(np.uint8).tobytes(), (np.cumsum(rng.integers(-2, 3, 192 * 9)) % 256).astype(np.uint8).tobytes(), rng.integers(0, 256, 192 * 300, dtype=np.uint8).tobytes(), bytes(192), bytes([0, 255] * 96)]
    streams = flac_media.encode_streams(waves)
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac_media.decode_streams(streams)] == waves
    assert len(streams[0]) < len(waves[0]) / 2 and len({s[flac_media._stream_info(s)[0] + 6] >> 1 for s in streams}) > 2
    for k in (60, 200, len(streams[2]) // 2):
        with pytest.raises(ValueError):
            flac_media.decode_streams([streams[2][:k] + bytes([streams[2][k] ^ 1]) + streams[2][k + 1 :]] if k > 90 else [b"x" + streams[2]])


def test_media(docs, rows, none):
    media = flac_media.to_flac(docs)
    got = {r["doc_id"]: r for r in flac_media.features(media).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    blocks = flac_media.pcm_blocks(media, 192).toPandas()
    assert all((g.sort_values("block")["first_sample"] == np.arange(len(g)) * 192).all() for _, g in blocks.groupby("doc_id"))
    assert flac_media.features(flac_media.to_flac(none)).count() == 0


# 10


def test_licences(spark, none):
    m = license_scan.model()
    assert m.recall > 0.9 and m.precision > 0.95 and m.unknown_recall > 0.9
    text = "Some prose.\nReleased under the MIT License.\nfiller\nThis work is licensed under the GNU General Public License,\nversion 3.\n" + "word " * 30 + "\nAll rights reserved."
    odd = "This work may be licensed under the Foobar Community License of our company."
    got = license_scan.licences(frame(spark, [(1, text), (2, None), (3, ""), (4, "The plumber is licensed in the state.\nEin mit. Die. Mit. This. Of this."), (5, odd), (5, odd)])).collect()
    assert [(r["doc_id"], r["family"], r["confirmed"], r["first_line"], r["last_line"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["paragraph"])) if r["doc_id"] < 5] == [(1, "MIT", True, 1, 1), (1, "GPL", True, 3, 4), (1, "Proprietary", True, 6, 6)]
    assert [(r["family"], r["confirmed"]) for r in got if r["doc_id"] == 5] == [("unknown", False)] * 2
    assert license_scan.licences(none).count() == 0


def test_a_notice_in_a_long_line_and_a_wrapped_one():
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    long_line = "bla " * 1000 + "licensed under the Apache License, Version 2.0 " + "foo " * 1000
    wrapped = "intro\n" + "\n".join(notice.split(" ")) + "\nend"
    got = [[(x[3], x[6]) for x in found] for found in license_scan.scan(license_scan.model(), [long_line, wrapped, "bla " * 3000])]
    assert got == [[("Apache-2.0", True)], [("MIT", True)], []]
    found = license_scan.scan(license_scan.model(), [wrapped])[0][0]
    assert (found[1], found[2]) == (1, len(notice.split(" ")))


def test_wordings_it_has_not_seen():
    """Families announced otherwise, licences of no family, and prose about licences."""
    said = {"This code is distributed under the MIT license": "MIT", "Available under the Apache License 2.0": "Apache-2.0", "The program is distributed under the GNU General Public License": "GPL", "Released under the BSD license": "BSD", "Distributed under the Mozilla Public License": "MPL-2.0", "This library is distributed under the GNU Lesser General Public License": "LGPL", "Published under the Barfoo Public License": "unknown", "Licensed under the Quux Software License": "unknown"}
    prose = ["The council granted the bar a license to serve until late.", "He read the terms of the lease and the conditions of the sale.", "The general public may visit on Sundays.", "La licencia fue otorgada bajo ciertas condiciones."]
    found = license_scan.scan(license_scan.model(), [*said, *prose])
    assert sum([x[3] for x in f] == [w] for f, w in zip(found, said.values())) >= len(said) - 1
    assert not any(x[3] != "unknown" for f in found[len(said) :] for x in f)


def test_templates_confirm_and_reject():
    """A text's beginning is its family's whatever the classifier is sure of; a name alone in prose is none's."""
    m = license_scan.model()
    begun = "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated documentation files"
    eupl = "Distributed under the terms of the European Union Public Licence."
    prose = ["The MIT campus is large.", "The GNU is a large antelope of the savanna.", "She studied at MIT and the BSD conference was in Ottawa.", "The Apache helicopter landed near the general store.", "Mozilla is a company with an office in Berlin."]
    found = license_scan.scan(m, [begun, eupl, *prose])
    assert [(x[3], x[5], x[6]) for x in found[0]] == [("MIT", 1.0, True)]
    assert [(x[3], x[6], x[7]) for x in found[1]] == [("unknown", False, eupl.rstrip("."))]
    assert found[2:] == [[]] * len(prose)
    # A named family is always a confirmed one, and its paragraph shares trigrams with it.
    texts = [form.format(n) for n in ("MIT License", "Apache License 2.0", "BSD license", "Quux License") for form in license_scan.SAID_OTHERWISE]
    for x in (x for f in license_scan.scan(m, texts) for x in f):
        assert (x[3] != "unknown") == x[6] and (not x[6] or m.similarity(license_scan.tokens_of(x[7]), m.classes.index(x[3])) >= 0.6)


def test_texts_of_a_batch_are_scanned_as_each_alone(rows):
    m = license_scan.model()
    texts = [t or "" for _, t in rows] + ["Released under the MIT License.", "", "All rights reserved", "é Licensed under CC BY 4.0"]
    assert license_scan.scan(m, texts) == [license_scan.scan(m, [t])[0] for t in texts]
    assert sum(map(bool, license_scan.scan(m, texts))) >= 3


# All


def test_ids_and_queries(docs, rows):
    assert id_and_text(docs).count() == len(rows)
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 14))
    assert pd.Series(list(QUERIES)).is_unique
