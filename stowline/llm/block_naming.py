"""Exact duplicates by deterministic block naming (operator 13).

A normalised text (A-Z lower-cased, UTF-8) is cut into blocks of a fixed size. Blocks of all documents are sorted, by a
64-bit hash and then by their bytes, and each gets an integer name, its dense rank; then adjacent names are paired, the pairs sorted and named in the same way, and so on
until each document has one name. Names are ranks of what they stand for, not hashes: two documents get the same name
at the same level if and only if they have the same bytes.

Ranks come from one range shuffle a level. Rows are sorted by (block, row, position), so that a block that a third of the
documents share is spread over as many partitions as its rows need; each partition numbers its own blocks, and a block
that goes on in the next partition is found by comparing last and first blocks, an equi-join of one row a partition. What
comes to the driver is a count for each partition.

Defined results: every row counts, one of a repeated or null ``doc_id`` too; null and empty texts are equal; of equal
texts the row with the largest doc_id stays (null is smaller than any id; of rows that tie on doc_id, one stays); a text
of any length takes as many levels as the logarithm of its blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import join_hot, release_shuffles, write_table

#: Bytes of a block.
BLOCK = 1024
#: Bytes of keys that a partition of a naming gets, about.
PART_BYTES = 48 << 20
#: Rows from which on a naming gets another partition, up to Spark's own number of them.
PART_ROWS = 4000
#: Bytes of blocks that the cutter holds before it hands them on.
BATCH_BYTES = 8 << 20

BLOCKS = "row long, doc_id long, pos long, blocks long, lead long, key binary, text_sha256 string"


def _cutter(size: int) -> Callable:
    """Blocks of each text; position 0 carries the document's id and its text's digest."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("blocks", pa.int64()), ("lead", pa.int64()), ("key", pa.binary()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                # bytes.lower() changes A-Z and no other byte.
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                count = max(1, -(-len(data) // size))
                for pos in range(count):
                    first = pos == 0
                    block = data[pos * size : (pos + 1) * size]
                    held.append((row, doc_id if first else None, pos, count, xxhash.xxh3_64_intdigest(block) - (1 << 63), block, hashlib.sha256(data).hexdigest() if first else None))
                    held_bytes += size
                    if held_bytes >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, held_bytes = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _numbered(keys: int) -> Callable:
    """Ranks within a sorted partition: the first ``keys`` columns are the key; the first and the last row keep theirs."""

    def changes(batch: pa.RecordBatch, last: list | None) -> list[bool]:
        """For each row, whether its key differs from the one in front of it."""
        found = None
        for i in range(keys):
            column = batch.column(i)
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            found = differs if found is None else pc.or_(found, differs)
        return [last != [batch.column(i)[0].as_py() for i in range(keys)], *found.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, last, waiting = TaskContext.get().partitionId(), -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = []
            for new in changes(batch, last):
                rank += new
                ranks.append(rank)
            n, opening = batch.num_rows, last is None
            last = [batch.column(i)[n - 1].as_py() for i in range(keys)]
            rest = batch.columns[keys:]
            edge = [pa.array([batch.column(i)[0].as_py()] + [None] * (n - 1) if opening else [None] * n, batch.column(i).type) for i in range(keys)]
            out = pa.RecordBatch.from_arrays([*rest, pa.array([part] * n, pa.int64()), pa.array(ranks, pa.int64()), *edge], names=[*batch.schema.names[keys:], "part", "rank", *(f"first_{i}" for i in range(keys))])
            if waiting is not None:
                yield _closed(waiting, None, keys)
            waiting = out
        if waiting is not None:
            yield _closed(waiting, last, keys)

    return run


def _closed(batch: pa.RecordBatch, last: list | None, keys: int) -> pa.RecordBatch:
    """The batch with its columns for the partition's last key, set on its last row."""
    n = batch.num_rows
    types = [batch.schema.field(f"first_{i}").type for i in range(keys)]
    ends = [pa.array([None] * (n - 1) + [last[i] if last else None], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*batch.schema.names, *(f"last_{i}" for i in range(keys))])


def dense_names(rows: DataFrame, keys: list[str], order: list[str], partitions: int, marked: str = "false", lead: int | None = None) -> tuple[DataFrame, int]:
    """rows with ``name``, the dense rank of the key columns over all rows, in place of them; and how many rows are marked.

    Keys are not null. ``order`` tells rows with equal keys apart: they spread over partitions too. Ranges are drawn by
    the first ``lead`` key columns alone, so that no wide key is sampled; should different keys with one lead meet at the edge of
    two partitions, all is drawn anew by whole keys. The rows are a table in the shared folder.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    edges = [[f"{side}_{i}" for i in range(len(keys))] for side in ("first", "last")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rest), "part long, rank long", *(f"{e} {kinds[k]}" for names in edges for e, k in zip(names, keys, strict=True))])
    lead = len(keys) if lead is None else lead
    dealt = rows.select(*keys, *rest).repartitionByRange(partitions, *keys[:lead], *order).sortWithinPartitions(*keys, *order)
    ranked = write_table(dealt.mapInArrow(_numbered(len(keys)), schema), "ranks")
    # Integers come along; blocks are compared where they are.
    narrow = all(kinds[k] == "bigint" for k in keys)
    wanted = [F.max(e).alias(e) for names in edges for e in (names if narrow else names[:lead] if lead < len(keys) else [])]
    counts = sorted(tuple(r) for r in ranked.groupBy("part").agg((F.max("rank") + 1).alias("n"), F.count(F.when(F.expr(marked), 1)).alias("marked"), *wanted).collect())
    neighbours = list(zip(counts, counts[1:], strict=False))
    if narrow:
        goes_on = {b[0] for a, b in neighbours if a[3 + len(keys) :] == b[3 : 3 + len(keys)]}
    else:
        before = spark.createDataFrame([(b[0], a[0]) for a, b in neighbours], "part long, front long")
        first, last = (ranked.where(f"{names[0]} is not null").select(F.col("part").alias(of), *(F.col(e).alias(f"k{i}") for i, e in enumerate(names))) for names, of in zip(edges, ("part", "front"), strict=True))
        goes_on = {r["part"] for r in first.join(before, "part").join(last, ["front", *(f"k{i}" for i in range(len(keys)))]).select("part").collect()}
        if lead < len(keys) and any(b[0] not in goes_on and a[3 + lead :] == b[3 : 3 + lead] for a, b in neighbours):
            return dense_names(rows, keys, order, partitions, marked)
    starts, total = [], 0
    for part, n, *_ in counts:
        total -= part in goes_on
        starts.append((part, total))
        total += n
    # One row of two integers for each partition: as bounded as the driver's own list of tasks.
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    return ranked.join(offsets, "part").select(*rest, (F.col("start") + F.col("rank")).alias("name")), sum(c[2] for c in counts)


def identities(docs: DataFrame, size: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """For each row of docs: row (a number), doc_id, text_sha256 of the normalised text, and (level, name), its identity."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parts(rows: int, row_bytes: int) -> int:
        return max(min(least, rows // PART_ROWS + 1), -(-rows * row_bytes // part_bytes))

    count = total[0] // size + total[1]
    named, left = dense_names(texts.mapInArrow(_cutter(size), BLOCKS), ["lead", "key"], ["row", "pos"], parts(count, -(-total[0] // max(1, count)) + 48), "blocks > 1", 1)
    release_shuffles(spark)
    heads = named.where("pos = 0").select("row", "doc_id", "text_sha256")
    done = lambda names, level: names.where("blocks = 1").select("row", F.lit(level).alias("level"), "name")
    every, level = done(named, 0), 0
    while left:
        level += 1
        # A last block without a neighbour is paired with -1, which no name is.
        even, odd = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = named.where("blocks > 1").groupBy("row", F.shiftright("pos", 1).alias("pos"), F.expr("(blocks + 1) div 2").alias("blocks")).agg(even.alias("a"), F.coalesce(odd, F.lit(-1)).alias("b"))
        named, left = dense_names(pairs, ["a", "b"], ["row", "pos"], parts(left, 24), "blocks > 1")
        release_shuffles(spark)
        every = every.unionByName(done(named, level))
    return heads.join(every, "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs."""
    rows = write_table(identities(docs, size, part_bytes), "identities")
    # Null ids come behind all others; of equal ids the first row stays.
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", (-F.col("row")).alias("place")))
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("n"), best.alias("best"))
    groups = write_table(groups.select("level", "name", "n", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.place")).alias("keep_row")), "groups")
    joined = join_hot(rows, groups, ["level", "name"], rows.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
