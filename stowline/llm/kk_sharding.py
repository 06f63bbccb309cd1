"""Balanced shards by Karmarkar-Karp differencing (operator 4).

Rows with equal texts are an indivisible group whose size is the sum of its rows'. A partial partition is a list of
as many sums as there are shards; the method takes the two with the largest spread (largest less smallest sum) and
adds them in opposite order, until one is left.

Groups are dealt to parts by their digest. Each part is differenced in a task of its own; its partial partition, one
sum a shard, is differenced with those of up to ``FAN`` parts, level by level, the last on the driver. A group is one
row here, whatever its rows count, and its rows find their shard by a join, those of very large groups by broadcast. Equal texts: equal length, CRC32, XXH64
and Murmur3.

Defined results: null and empty texts are one group, of 16 bytes a row; repeated rows stay together; an empty table
gives no rows; other columns are ignored; of equal spreads the one that came first goes first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_and_text, join_hot, write_table

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Groups of a part, about: what one task differences.
PART_GROUPS = 50_000
#: Parts that one differencing above the first level takes.
FAN = 2000
#: Rows of all shards for each cell in which slots are numbered.
CELL_ROWS = 200_000


def _difference(vectors: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, list]:
    """Differencing of (sums, trees by place); a tree is a leaf, a list of two trees, or None where empty."""
    heap = [(-int(s.max() - s.min()), i, s, t) for i, (s, t) in enumerate(vectors)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heap[0]
        total = a + b[::-1]
        order = np.argsort(-total, kind="stable")
        trees = [x if y is None else y if x is None else [x, y] for x, y in zip(ta, reversed(tb), strict=True)]
        total = total[order]
        heapq.heapreplace(heap, (-int(total[0] - total[-1]), count, total, [trees[k] for k in order.tolist()]))
        count += 1
    return heap[0][2], heap[0][3]


def _leaves(tree) -> Iterator:
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += x
        elif x is not None:
            yield x


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size."""
    out = [0] * len(sizes)
    if sizes:
        _, trees = _difference([(np.array([s] + [0] * (shards - 1), "int64"), [i] + [None] * (shards - 1)) for i, s in enumerate(sizes)])
        for shard, tree in enumerate(trees):
            for i in _leaves(tree):
                out[i] = shard
    return out


def combine(parts: dict[int, list[int]], shards: int) -> list[tuple[int, int, int]]:
    """(part, place, shard) by differencing whole parts, each given by its sums by place."""
    if not parts:
        return []
    vectors = []
    for part, sums in sorted(parts.items()):
        order = sorted(range(shards), key=lambda k, sums=sums: (-sums[k], k))
        vectors.append((np.array([sums[k] for k in order], "int64"), [(part, k) for k in order]))
    _, trees = _difference(vectors)
    return [(*leaf, shard) for shard, tree in enumerate(trees) for leaf in _leaves(tree)]


def _by_part(rows, shards: int) -> dict[int, list[int]]:
    sums: dict[int, list[int]] = {}
    for part, place, size in rows:
        sums.setdefault(int(part), [0] * shards)[int(place)] = int(size)
    return sums


def _seats(cells: DataFrame, shards: int, fan: int) -> DataFrame:
    """(part, place, shard) for cells (part, place, bytes), by levels of at most ``fan`` parts a differencing."""
    spark = cells.sparkSession
    if cells.select("part").distinct().count() <= fan:
        found = combine(_by_part([tuple(r) for r in cells.select("part", "place", "bytes").collect()], shards), shards)
        return spark.createDataFrame(found, "part long, place int, shard int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = combine(_by_part(group[["part", "place", "bytes"]].itertuples(index=False), shards), shards)
        out = pd.DataFrame(found, columns=["part", "place", "up_place"])
        return out.assign(up=group["up"].iloc[0])[["part", "place", "up", "up_place"]]

    level = write_table(cells.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up").applyInPandas(run, "part long, place int, up long, up_place int"), "level")
    above = cells.join(level, ["part", "place"]).groupBy(F.col("up").alias("part"), F.col("up_place").alias("place")).agg(F.sum("bytes").alias("bytes"))
    higher = _seats(write_table(above, "cells"), shards, fan).select(F.col("part").alias("up"), F.col("place").alias("up_place"), "shard")
    return level.join(higher, ["up", "up_place"]).select("part", "place", "shard")


GROUP = ["h1", "h2", "size", "text_crc32"]


def shard(docs: DataFrame, shards: int = 40, part_groups: int = PART_GROUPS, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: gapless from 0 within a shard, in an order that hashes of doc_id give."""
    rows = id_and_text(docs).select("doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    rows = write_table(rows, "sizes")
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    parts = max(1, -(-groups.count() // part_groups))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "first"], ascending=[False, True], kind="stable")
        return group.assign(place=karmarkar_karp(group["bytes"].tolist(), shards))

    placed = groups.withColumn("part", F.pmod("h1", F.lit(parts))).groupBy("part").applyInPandas(run, "h1 long, h2 int, size long, text_crc32 long, bytes long, first long, n long, part long, place int")
    placed = write_table(placed, "places")
    cells = placed.groupBy("part", "place").agg(F.sum("bytes").alias("bytes"))
    seats = write_table(placed.join(_seats(cells, shards, fan), ["part", "place"]).select(*GROUP, "n", "shard"), "seats")
    laid = write_table(join_hot(rows, seats, GROUP, rows.count()).select("doc_id", "size", "text_crc32", "shard"), "shards")
    # Slots: rows are numbered within cells of a shard and a hash of doc_id, after the rows of the shard's cells in front.
    buckets = max(1, -(-laid.count() // CELL_ROWS))
    laid = laid.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = laid.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    begins = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("begin"))
    ranked = laid.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")) - 1)
    return ranked.join(begins, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("rank")).alias("slot"))
