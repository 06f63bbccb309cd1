"""Near-duplicates by the Jaccard similarity of word shingles (in the pipeline, links beyond those of operator 7).

Two documents are linked if their sets of shingles have a similarity of ``SIMILAR`` or more. Candidates share one of
``BANDS`` keys of ``ROWS`` min-hashes; a pair at 0.8 shares none with probability 1.1e-4, closer pairs less. Each
candidate is verified on the shingles themselves, so no pair below the bound is linked.

Documents of one set meet before any key is made. A bucket's members are verified first against its smallest one, in
groups of at most about ``GROUP``, whatever the bucket's size. Buckets that this leaves in several components are
verified whole; beyond ``BLOCK`` members by all pairs of their blocks.

Defined results: null, empty and blank texts have the empty set and are copies of each other; a text of fewer words than
a shingle is one shingle; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import frame, id_and_text, join_spread, release_shuffles, write_table
from .components import connected_components
from .covering_simhash import SEED, shingle_hashes

SIMILAR = 0.8
BANDS, ROWS = 30, 6
#: Members of a bucket that one task verifies against its smallest; members of a block of those verified whole.
GROUP, BLOCK = 256, 512
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _set_of(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set, none of which may be empty."""
    flat = np.concatenate(sets)
    n = np.array([len(s) for s in sets])
    starts = np.cumsum(n) - n
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sets), band + 1, np.uint64)
        for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            h = (h ^ np.minimum.reduceat(flat * factor, starts)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        keys[:, band] = h
    return keys


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (one for each set), keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for at in range(0, len(texts), 256):
                sets = [_set_of(t, words) for t in texts[at : at + 256]]
                fps = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
                keys = [np.empty(0, np.int64)] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, row in zip(full, band_keys([sets[i] for i in full]).view(np.int64), strict=True):
                        keys[i] = row
                yield pd.DataFrame({"doc_id": ids[at : at + 256], "fp": fps, "keys": keys})

    return id_and_text(docs).mapInPandas(run, "doc_id long, fp long, keys array<long>")


def _shingles(docs: DataFrame, words: int) -> DataFrame:
    """fp and its set, as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 256):
                sets = [_set_of(t, words) for t in texts[at : at + 256]]
                yield frame("fp long, shingles binary", fp=np.array([_set_id(s) for s in sets], np.uint64).view(np.int64), shingles=[s.tobytes() for s in sets])

    return id_and_text(docs).mapInPandas(run, "fp long, shingles binary")


def set_forest(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least ``similar``."""
    n = np.array([len(s) for s in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(n) - n
    mark = np.zeros(len(words), np.int64)
    left, queue, out = np.arange(len(sets)), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        mine = ids[begins[i] : begins[i] + n[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids], begins)[left]
        mark[mine] = 0
        near = both * (1 + similar) >= similar * (n[left] + n[i]) - 1e-9
        found, left = left[near].tolist(), left[~near]
        out += [(i, j) for j in found]
        queue += found
    return out


def _verified(groups: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links (u, v) within the groups (g, fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for members in batch["members"]:
                fps = [m["fp"] for m in members]
                for i, j in set_forest([np.frombuffer(m["shingles"], np.uint64) for m in members]):
                    us.append(fps[i])
                    vs.append(fps[j])
            yield frame("u long, v long", u=np.array(us, np.int64), v=np.array(vs, np.int64))

    members = groups.join(shingles, "fp").groupBy("g").agg(F.collect_list(F.struct("fp", "shingles")).alias("members"))
    return members.select("members").mapInPandas(run, "u long, v long")


def _part(of: str, n: str, size: int):
    """The number of a member's part, of as many as hold ``size`` each."""
    return F.pmod(F.xxhash64(of, F.lit(size)), F.ceil(F.col(n) / size).cast("long"))


def set_links(docs: DataFrame, signatures: DataFrame, words: int, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) of sets whose connected components are those of all candidate pairs of similarity ``SIMILAR``."""
    first = signatures.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    keyed = signatures.join(first, ["doc_id", "fp"]).select("fp", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top")
    shared = write_table(join_spread(keyed, sizes.select("key", "hub"), ["key"]).distinct(), "buckets")
    wanted = shared.select("fp").distinct().join(first, "fp").select("doc_id").distinct()
    wanted = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    shingles = write_table(_shingles(wanted, words).dropDuplicates(["fp"]), "shingles")
    pairs = shared.where("fp <> hub").select("hub", "fp").distinct()
    pairs = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub").withColumn("g", F.xxhash64("hub", _part("fp", "n", group)))
    stars = pairs.select("g", "fp").unionByName(pairs.select("g", F.col("hub").alias("fp")).distinct())
    near = write_table(_verified(stars, shingles), "links")
    release_shuffles(docs.sparkSession)
    rooted = shared.join(connected_components(near), F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    # Pairs alone in their bucket have been verified; buckets of the same members are verified once.
    open_ = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("z"), F.xxhash64(F.bit_xor(F.xxhash64("fp")), F.sum(F.col("fp").cast("decimal(38,0)"))).alias("bucket")).where("n > 2 and a < z")
    whole = rooted.join(open_.select("key", "n", "bucket"), "key").select("bucket", "n", "fp").distinct()
    whole = whole.withColumn("part", _part("fp", "n", block)).withColumn("parts", F.ceil(F.col("n") / block))
    both = F.expr("transform(filter(sequence(0L, parts - 1), x -> x <> part), x -> xxhash64(bucket, least(x, part), greatest(x, part)))")
    whole = whole.select("fp", F.explode(F.when(F.col("parts") == 1, F.array("bucket")).otherwise(both)).alias("g"))
    return near.unionByName(_verified(whole, shingles))


def similar_documents(docs: DataFrame, words: int = 5, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over links."""
    signatures = write_table(_signatures(docs, words), "signatures")
    roots = connected_components(set_links(docs, signatures, words, group, block))
    release_shuffles(docs.sparkSession)
    rooted = signatures.select("doc_id", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.groupBy("doc_id", "root").agg(F.lit(1).alias("one")).select("doc_id", "root")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs but for those whose component has a smaller doc_id; all columns stay."""
    kept = similar_documents(docs, words).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")


def keep_one_of_groups(docs: DataFrame, groups: DataFrame, words: int = 5) -> DataFrame:
    """keep_one_of_each over the links of similar documents and of ``groups`` (doc_id, component_id), taken together."""
    links = [d.where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for d in (groups, similar_documents(docs, words))]
    roots = connected_components(links[0].unionByName(links[1]))
    # Documents without a link are their own; of linked ones the root alone stays.
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node")).distinct()
    kept = join_spread(ids, roots.where("node <> root").select("node").distinct(), ["node"], "left_anti").select(F.col("node").alias("doc_id"))
    return docs.join(kept, "doc_id", "left_semi")
