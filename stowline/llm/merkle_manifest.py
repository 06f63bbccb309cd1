"""A Merkle manifest of a dataset, with a proof for every row (operator 11), by fractal traversal.

A leaf is the digest of a row. Leaves of one lang, in the order of doc_id, are paired level by level up to the lang's
subroot (the last node of a level that has no neighbour is hashed alone); subroots, in the order of lang, are paired up to
the root. Digests are lowercase hex SHA-256 of inputs written one after the other.

Rows get their place in the lang by one range shuffle and a count for each lang and partition. A lang's leaves are cut into aligned
blocks of ``2 ** BITS``; the roots of the blocks are the leaves of the next tier, cut in the same way, and so on, so that a task
has one block at a time and the upper proofs are rows of tables. Within a block a fractal traversal goes from leaf to
leaf: of the stacked subtrees from the leaf to the block's root it keeps the existing ones, which hold the current path, and
beside each the desired one that follows it, grown by two units a leaf so that it is whole when it is needed. It keeps
the nodes of twice as many subtrees as are stacked, whatever the block. The block's own path is followed by that of its root.

Defined results: nulls in any column are leaves of their own form, rows without a doc_id come first in their lang, a null
lang in front of all others; rows that agree in lang and doc_id are ordered by leaf; repeated rows are leaves each; texts of
any length are one digest; one row is its own subroot and root, with an empty path; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import write_table

#: Levels of an aligned block, and of a subtree of its stack.
BITS, SPAN = 12, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Subtree:
    """A subtree under construction: nodes of the levels from ``low`` up to ``top``, and a stack of what is not yet joined.

    A unit of work is a leaf or an inner node.
    """

    def __init__(self, leaves: list[str], low: int, top: int, index: int):
        self.leaves, self.low, self.top = leaves, low, top
        self.next, self.end = index << top, min((index + 1) << top, len(leaves))
        self.nodes: dict[tuple[int, int], str] = {}
        self.stack: list[tuple[int, int, str]] = []

    def whole(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] == self.top

    def _put(self, level: int, index: int, node: str) -> None:
        self.stack.append((level, index, node))
        if level >= self.low:
            self.nodes[level, index] = node

    def unit(self) -> None:
        if self.stack:
            level, index, node = self.stack[-1]
            if level == self.top:
                return
            if index & 1:
                del self.stack[-1]
                self._put(level + 1, index >> 1, digest(self.stack.pop()[2], node))
                return
            if (index + 1) << level >= len(self.leaves):
                del self.stack[-1]
                self._put(level + 1, index >> 1, digest(node))
                return
        self._put(0, self.next, self.leaves[self.next])
        self.next += 1

    def finish(self) -> Subtree:
        while not self.whole():
            self.unit()
        return self


def block_root(leaves: list[str], height: int) -> str:
    return Subtree(leaves, height, height, 0).finish().stack[-1][2]


def traverse(leaves: list[str], height: int, span: int = SPAN) -> Iterator[str]:
    """Each leaf's path to the block's root at ``height``: a level's neighbour with its side, < or >, or = where there is none, comma-joined."""
    lows = range(0, height, span)
    tops = [min(low + span, height) for low in lows]
    existing = [Subtree(leaves, low, top, 0).finish() for low, top in zip(lows, tops, strict=True)]

    def desired(t: int, index: int) -> Subtree | None:
        return Subtree(leaves, lows[t], tops[t], index) if index << tops[t] < len(leaves) else None

    growing = [desired(t, 1) for t in range(len(tops) - 1)]
    for i in range(len(leaves)):
        path = []
        for t, low in enumerate(lows):
            nodes = existing[t].nodes
            for level in range(low, tops[t]):
                index = i >> level
                if index & 1:
                    path.append("<" + nodes[level, index - 1])
                elif (index + 1) << level < len(leaves):
                    path.append(">" + nodes[level, index + 1])
                else:
                    path.append("=")
        yield ",".join(path)
        for t, subtree in enumerate(growing):
            if subtree is not None:
                subtree.unit()
                subtree.unit()
                if not (i + 1) & ((1 << tops[t]) - 1):
                    existing[t] = subtree
                    growing[t] = desired(t, ((i + 1) >> tops[t]) + 1)


def _height(total: int, bits: int) -> int:
    """Levels of a block, of a key with ``total`` nodes on this tier."""
    return bits if total > 1 << bits else (total - 1).bit_length()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``index``, their place within ``key`` in the given order, and ``total``, the key's number of rows.

    Rows of a key spread over as many partitions as they need; of those only a count each is gathered.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    laid = write_table(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "leaves")
    key = Window.partitionBy("key")
    stretches = laid.groupBy("key", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    stretches = stretches.select("key", "part", (F.sum("n").over(key.orderBy("part")) - F.col("n") - F.col("begin")).alias("shift"), F.sum("n").over(key).alias("total"))
    return laid.join(write_table(stretches, "stretches"), ["key", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """nodes with ``path``: through their block, then that of the block's root from ``above`` (key, block, above)."""

    def run(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index", kind="stable")
        tail = upper["above"].iloc[0]
        found = traverse(block["hash"].tolist(), _height(int(block["total"].iloc[0]), bits))
        return block.drop(columns="block").assign(path=[",".join(x for x in (path, tail) if x) for path in found])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in nodes.dtypes) + ", path string"
    blocks = nodes.withColumn("block", F.shiftright("index", bits))
    return blocks.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInPandas(run, schema)


def climb(nodes: DataFrame, bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """For nodes (key, index, total, hash): (key, block, above), the path from each block's root to its key's; (key, hash), the keys' roots."""

    def run(group: tuple, block: pd.DataFrame) -> pd.DataFrame:
        total = int(block["total"].iloc[0])
        root = block_root(block.sort_values("index", kind="stable")["hash"].tolist(), _height(total, bits))
        return pd.DataFrame({"key": [group[0]], "index": [group[1]], "total": [-(-total >> bits)], "hash": [root]})

    blocks = nodes.select("key", F.shiftright("index", bits).alias("block"), "index", "total", "hash")
    roots = write_table(blocks.groupBy("key", "block").applyInPandas(run, "key string, index long, total long, hash string"), "roots")
    if most <= 1 << bits:
        return roots.select("key", F.col("index").alias("block"), F.lit("").alias("above")), roots.select("key", "hash")
    above, tops = climb(roots, bits, -(-most >> bits))
    return paths(roots, above, bits).select("key", F.col("index").alias("block"), F.col("path").alias("above")), tops


def leaf_of(**instead: Column) -> Column:
    """The digest of a row of ``documents``; columns can be given instead of the row's own."""
    parts = []
    for name in FIELDS:
        value = instead.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(path: str, leaf: str) -> Column:
    """The root that a leaf and the neighbours of its path give."""
    step = lambda node, at: F.sha2(F.when(at.startswith("<"), F.concat(F.substring(at, 2, 64), node)).otherwise(F.concat(node, F.substring(at, 2, 64))), 256)
    return F.aggregate(path, F.col(leaf), step)


def siblings(path: str) -> Column:
    """The path's neighbours, one after the other."""
    return F.array_join(F.transform(path, lambda at: F.substring(at, 2, 64)), "")


def manifest(docs: DataFrame, bits: int = BITS, **carried: Column) -> DataFrame:
    """doc_id, lang, leaf, index in the lang, path (array of neighbours with their sides), subroot and root; carried columns as given."""
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("hash"), *(c.alias(name) for name, c in carried.items()))
    leaves = numbered(rows, "doc_id", "hash")
    most = leaves.agg(F.max("total")).first()[0] or 0
    above, subroots = climb(leaves, bits, most)
    subroots = write_table(subroots, "subroots")
    langs = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "hash"), "of")
    upper, root = climb(langs, bits, langs.count())
    found = root.first()
    of_lang = write_table(paths(langs, upper, bits).select(F.col("of").alias("key"), F.col("hash").alias("subroot"), F.col("path").alias("over")), "langs")
    above = above.join(of_lang, "key").select("key", "block", F.concat_ws(",", F.nullif("above", F.lit("")), F.nullif("over", F.lit(""))).alias("above"))
    proven = paths(leaves, above, bits).join(of_lang.select("key", "subroot"), "key")
    lang = F.when(F.col("key") != "0", F.expr("substring(key, 2)"))
    path = F.filter(F.split("path", ","), lambda at: at != "")
    return proven.select("doc_id", lang.alias("lang"), F.col("hash").alias("leaf"), "index", path.alias("path"), "subroot", F.lit(found["hash"] if found else None).cast("string").alias("root"), *carried)


def tampered() -> Column:
    """The row's leaf had its n_chars been raised by one, where 7 divides the CRC-32 of its id; else its own leaf."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return leaf_of(n_chars=F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string")))
