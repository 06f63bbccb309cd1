"""Places where an operator once did less than its whole job."""

import numpy as np
import pytest


def near_copies():
    """Texts in families at shingle similarities around 0.8, with a chain, copies, short and empty texts."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(4000)])
    texts = []
    for family in range(12):
        base = rng.choice(words, 150)
        for _ in range(8):
            text = base.copy()
            text[rng.choice(150, family % 6, replace=False)] = rng.choice(words, family % 6)
            texts.append(" ".join(text))
    chain = rng.choice(words, 120)
    for k in range(0, 110, 10):
        chain[k : k + 8] = rng.choice(words, 8)
        texts.append(" ".join(chain))
    return [*texts, texts[0].upper(), "one two", "one  two", "", "", None, "three"]


@pytest.mark.parametrize("group, block", [(256, 512), (3, 2)])
def test_near_dedup_links_all_pairs_at_jaccard_08(spark, group, block):
    from stowline.llm.jaccard_sets import similar_documents

    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = [(t or "").lower().split() for t in texts]
    sets = [{tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} if p else set() for p in parts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert {r.doc_id: r.component_id for r in similar_documents(docs, group=group, block=block).collect()} == dict(enumerate(want))


def test_near_dedup_stage_keeps_one_of_a_pair_far_apart_in_bits(spark):
    import corpus_pipeline
    from stowline.llm.covering_simhash import fingerprints_of

    rng = np.random.default_rng(5)
    base = rng.choice([f"w{i}" for i in range(5000)], 200)
    other = base.copy()
    other[[40, 90, 140]] = "x", "y", "z"
    texts = [" ".join(base), " ".join(other)]
    a, b = fingerprints_of(texts, 5)
    assert (int(a) ^ int(b)).bit_count() > 4
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_in_texts_are_one_id(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from stowline.llm.word_cache import WordCache

    path = public_tokenizers.path(name)
    fresh = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "a<|startoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "plain text", "", "x<|endoftext|><|endoftext|>\ny"]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert fresh.token_to_id("<|endoftext|>") in want[0]
    cache = WordCache(path)
    for _ in range(2):
        assert [x.tolist() for x in cache.encode(texts)] == want


def test_links_broadcast_nothing_that_grows(spark, tmp_path):
    from stowline.llm.covering_simhash import links

    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/nodes")
    found = links(spark.read.parquet(f"{tmp_path}/nodes"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_stage_links_what_operator_7_links(spark):
    import corpus_pipeline
    from stowline.llm.covering_simhash import near_duplicates
    from stowline.llm.jaccard_sets import similar_documents

    rng = np.random.default_rng(7)
    few = [f"w{i}" for i in range(40)]
    # Many repeats of one line: its shingles settle the fingerprint, the rest of the set differs.
    line = " ".join(rng.choice(few, 5, replace=False)) + " "
    texts = [line * 200 + " ".join(f"{side}{i}" for i in range(30)) for side in "ab"]
    # A third, which shares four fifths of the second's set, and one that is like none.
    texts += [texts[1] + " c1 c2", " ".join(rng.choice([f"v{i}" for i in range(5000)], 100))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.component_id for r in similar_documents(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}[1] == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]
