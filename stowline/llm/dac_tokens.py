"""Token ids in directly addressable codes (operator 8).

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap
says which ids go on, and level 1 holds the second chunk of those alone, and so on. A rank directory gives the number
of set bits before each block of ``RANK_BLOCK`` bits, so the place of an id's next chunk is one directory entry and
one partial popcount away: any token is read without decoding its neighbours, and any run of tokens without decoding
what stands before it. The query reads each document's ids as such a run; ``tokens_at`` reads single ones.

Segment layout (little endian): magic ``DAC1``, chunk bits u8, levels u8, two zero bytes, n u64; then for each level
its length u64, chunk bytes, and, but for the last level, bitmap bytes and rank directory (u64 each).

Defined results: a null or empty text has the end id alone; an empty table gives no rows; repeated rows are encoded
each; rows of equal doc_id stand in the order of their texts; other columns are ignored. A very long text is one
document of one segment, in memory whole while it is encoded and while it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import frame, id_and_text, write_table
from .word_cache import word_cache

CHUNK_BITS = 8
RANK_BLOCK = 512
#: Ids after which a segment ends, at the end of a document.
SEGMENT_IDS = 1 << 20
SEGMENT = "part long, before long, first_doc long, n_docs long, n_ids long, doc_ids binary, lengths binary, codes binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_ids(ids: np.ndarray) -> bytes:
    """The segment of an array of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    levels, rest = [], ids
    while True:
        more = rest >= (1 << CHUNK_BITS)
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    out = [b"DAC1", struct.pack("<BBHQ", CHUNK_BITS, len(levels), 0, len(ids))]
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint64)
            out += [bits.tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """A segment's bytes, opened for whole reads and for random access."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        self.bits, n_levels, _, self.n = struct.unpack_from("<BBHQ", data, 4)
        self.levels, at = [], 16
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = ranks = None
            if k + 1 < n_levels:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(data, "<u8", -(-n // RANK_BLOCK), at + len(bitmap))
                at += len(bitmap) + 8 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set bits in front of bit i of a level's bitmap: a directory entry and a partial popcount."""
        _, bitmap, ranks = self.levels[level]
        block = min(i // RANK_BLOCK, len(ranks) - 1)
        part = bitmap[block * RANK_BLOCK // 8 : -(-i // 8)]
        within = int(np.bitwise_count(part).sum())
        if i & 7:
            within -= (int(part[-1]) >> (i & 7)).bit_count()
        return int(ranks[block]) + within

    def token(self, i: int) -> int:
        """Id number i: one chunk a level, its place found by rank."""
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * self.bits)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def run(self, a: int, z: int) -> np.ndarray:
        """Ids a to z (exclusive): a slice of each level, its ends found by rank."""
        out, where = np.zeros(z - a, "<u4"), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[a:z].astype("<u4") << np.uint32(k * self.bits)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if bitmap is None or a == z:
                break
            bits = np.unpackbits(bitmap[a >> 3 : -(-z // 8)], bitorder="little")[a & 7 : (a & 7) + z - a]
            more = np.flatnonzero(bits)
            where = more if where is None else where[more]
            a = self._rank(k, a)
            z = a + len(more)
        return out


def _segments(path: str, end_id: int):
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, part, before = word_cache(path), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal before, size
            lengths = np.array([len(x) for x in held], "<i8")
            ids = np.concatenate(held)
            out = frame(SEGMENT, part=[part], before=[before], first_doc=[docs[0]], n_docs=[len(docs)], n_ids=[len(ids)], doc_ids=[np.array(docs, "<i8").tobytes()], lengths=[lengths.tobytes()], codes=[encode_ids(ids)])
            before, size = before + len(ids), 0
            docs.clear()
            held.clear()
            return out

        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in range(0, len(texts), 1000):
                for doc, got in zip(ids[at : at + 1000], cache.encode(texts[at : at + 1000]), strict=True):
                    docs.append(doc)
                    held.append(np.append(got, end))
                    size += len(got) + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Segments of the documents in ascending doc_id order, written as files of the shared folder and read again.

    Parts are ranges of doc_id in order; ``before`` counts the ids of the part in front of the segment.
    """
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return write_table(ordered.mapInPandas(_segments(tokenizer_path, end_id), SEGMENT), "dac", "none")


def read_segments(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the stored codes.

    What goes to the driver is one pair of numbers for each written part.
    """
    spark = segments.sparkSession
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, at = [], 0
    for part, n in totals:
        rows.append((part, at))
        at += n
    offsets = spark.createDataFrame(rows, "part long, part_start long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                segment, lengths = Segment(row.codes), np.frombuffer(row.lengths, "<i8")
                starts = np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(segment.run(a, a + n).tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield frame(RESULT, doc_id=np.frombuffer(row.doc_ids, "<i8"), start=starts + row.part_start + row.before, n_tokens=lengths, ids_crc32=crcs)

    return segments.join(F.broadcast(offsets), "part").select("part_start", "before", "doc_ids", "lengths", "codes").mapInPandas(run, RESULT)


def directory(segments: DataFrame) -> DataFrame:
    """doc_id, part, before, at, n_tokens: the segment that holds each document, and where it begins there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, "<i8")
                yield pd.DataFrame({"doc_id": np.frombuffer(row.doc_ids, "<i8"), "part": row.part, "before": row.before, "at": np.cumsum(lengths) - lengths, "n_tokens": lengths})

    return segments.select("part", "before", "doc_ids", "lengths").mapInPandas(run, "doc_id long, part long, before long, at long, n_tokens long")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, index and token for each distinct (doc_id, index) of ``wanted`` that is a token of a document.

    Each segment that is asked for is opened once, and its tokens are read one by one through the rank directories.
    """
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("index").cast("long")).distinct().join(directory(segments), "doc_id").where("index >= 0 AND index < n_tokens")
    lists = asked.groupBy("part", "before").agg(F.collect_list(F.struct("doc_id", "index", (F.col("at") + F.col("index")).alias("place"))).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                segment = Segment(row.codes)
                yield pd.DataFrame([(x["doc_id"], x["index"], segment.token(x["place"])) for x in row.asked], columns=["doc_id", "index", "token"])

    return lists.join(segments.select("part", "before", "codes"), ["part", "before"]).select("asked", "codes").mapInPandas(run, "doc_id long, index long, token long")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids as directly addressable codes and return what the files say of each document."""
    return read_segments(write_segments(docs, tokenizer_path, end_id))
