"""SimHash near-duplicates by covering locality-sensitive hashing (operator 7).

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Bit i of a fingerprint is
given a nonzero vector m(i) of radius+1 bits; table v, for each nonzero v, keeps the bits with <m(i), v> = 1 (mod 2).
Up to ``radius`` differing bits have vectors that some v is orthogonal to, and table v drops them all: every pair
within the radius agrees in some table. 31 tables of about 32 bits serve radius 4.

Exact copies meet in one fingerprint before any table is built. A bucket of up to ``BUCKET`` distinct fingerprints is
searched in one task, which returns a spanning forest of its links, not the pairs. The fingerprints of larger buckets
are linked through shared points within half the radius, which two fingerprints have exactly if they are within the
radius; that takes a fixed number of keys a fingerprint and sums of keys, whatever the bucket's size.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows get equal fingerprints; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import frame, id_and_text, join_hot, join_spread, release_shuffles, write_table
from .components import connected_components

BITS = 64
SEED = 42
#: Distinct fingerprints of a bucket that one task compares; larger buckets go by shared points.
BUCKET = 4096
_BIT_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float32)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text, with A-Z in lower case."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = (ends - [len(p) for p in parts]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends.tolist()[words - 1 :] or [len(joined)], strict=False)], np.uint64)


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    hashes = [shingle_hashes(t, words) for t in texts]
    n = np.array([len(h) for h in hashes])
    counts = np.zeros((len(texts), BITS), np.float64)
    flat = np.concatenate(hashes) if len(hashes) else np.empty(0, np.uint64)
    for at in range(0, len(flat), 1 << 20):
        part = flat[at : at + (1 << 20)]
        owner = np.searchsorted(np.cumsum(n), np.arange(at, at + len(part)), side="right")
        first = owner[0]
        width = owner[-1] - first + 1
        index = ((owner - first)[:, None] * 8 + np.arange(8)) * 256 + part.view(np.uint8).reshape(-1, 8)
        tally = np.bincount(index.ravel(), minlength=width * 2048).reshape(width * 8, 256)
        counts[first : first + width] += (tally.astype(np.float32) @ _BIT_OF_BYTE).reshape(width, BITS)
    bits = counts * 2 > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel() if len(texts) else np.empty(0, np.uint64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 256):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + 256].to_numpy(), "fp": fingerprints_of(texts[at : at + 256], words).view(np.int64)})

    return id_and_text(docs).mapInPandas(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The bit masks of the tables, as signed longs."""
    vectors = (1 << (radius + 1)) - 1
    m = [1 + i % vectors for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (m[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _forest(radius: int):
    """Links of a spanning forest of each bucket's fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for fps in batch["fps"]:
                fps = np.asarray(fps, np.int64).view(np.uint64)
                left = np.arange(len(fps))
                queue: list[int] = []
                while len(left):
                    if not queue:
                        queue, left = [left[0]], left[1:]
                        continue
                    i = queue.pop()
                    near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
                    if near.any():
                        found, left = left[near], left[~near]
                        us.append(fps[found])
                        vs.append(np.full(len(found), fps[i]))
                        queue += found.tolist()
            if us:
                yield frame("u long, v long", u=np.concatenate(us).view(np.int64), v=np.concatenate(vs).view(np.int64))

    return run


def _points(radius: int):
    """Every point within half the radius of each fingerprint."""
    flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    near = np.array(flips, np.uint64).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fp in batch["fp"].tolist():
                yield frame("point long, fp long", point=near ^ np.int64(fp), fp=np.full(len(near), fp))

    return run


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) of fingerprints whose connected components are those of all pairs within the radius.

    nodes has one row (fp) for each distinct fingerprint. A table's number and the bits it keeps are hashed into one bucket
    key; should two buckets fall together, distances still decide. radius must be even.
    """
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])
    keyed = nodes.select("fp", F.explode(tables).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = join_spread(keyed, sizes, ["key"])
    buckets = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = buckets.select("fps").mapInPandas(_forest(radius), "u long, v long")
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    points = crowded.mapInPandas(_points(radius), "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("x")).where("v < x").select("point", "v")
    return near.unionByName(join_spread(points, least, ["point"]).select(F.col("fp").alias("u"), "v").where("u <> v")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links within the radius.

    Fingerprints that many documents have, and components of many fingerprints, are joined by broadcast (``join_hot``).
    """
    if radius % 2:
        raise ValueError("the radius must be even: crowded buckets are searched through points at half of it")
    prints = write_table(fingerprints(docs, words), "fingerprints")
    nodes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius, bucket))
    release_shuffles(docs.sparkSession)
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rooted = write_table(join_spread(nodes, roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(rooted.select("fp", "root", F.col("n").alias("docs")), least, ["root"], count)
    found = write_table(named.select("fp", "component_id", F.col("docs").alias("n")), "named")
    return join_hot(prints, found, ["fp"], total).select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
