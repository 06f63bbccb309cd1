"""Removal of repeated byte strings over a corpus, by prefix-free parsing (operator 1).

Every byte that lies in a string of ``LENGTH`` bytes which also starts in a document of a smaller doc_id is removed.

*Triggers and phrases.* A rolling hash of ``TRIGGER`` bytes is taken everywhere. A trigger window is one whose hash is
the least (leftmost of equals) of those inside some string of LENGTH bytes. So each such string holds a trigger at a
place which the string alone decides, equal strings are parsed alike wherever they stand, and no string is without
one, which triggers by a fixed remainder can't promise. A phrase is the run of strings that share a trigger, with its
overlap into the next: its suffixes of LENGTH bytes and more are those strings.

*Dictionary and parse.* Documents lie in blocks, in doc_id order. Round 1 finds the triggers that more than one
document has. Round 2 sends the distinct phrases of a block that have such triggers to their trigger's bucket, once a
block with the smallest doc_id: the bucket's distinct phrases are its dictionary, the blocks' lists of them its parse.
The dictionary's suffix array, sorted a word of 8 bytes at a time among those still tied, gives the suffixes in corpus
order; neighbours that share LENGTH bytes are one string, and the parse gives its smallest document. Round 3 takes the
answers back to the blocks.

*Load.* A phrase costs one entry a block, however many copies the block holds; a block writes a row for each bucket it has
something for, so rows grow with the text and never beyond a block's keys. Round 1 adds up, over all blocks, how many
strings each trigger's distinct phrases have; the strings of triggers with ``HOT`` or more are dealt out by each string's
own hash instead, one entry a block and string, so that no bucket grows with a passage that many documents share.
Tasks are dealt a fixed amount of text each. Only counts of bytes and blocks come to the driver. Each round is a job
that ends in a table of the shared folder.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows of equal doc_id do not count as
smaller than one another; an empty table gives no rows; other columns are ignored. A text longer than a block is a
block of its own, in one task's memory about sixty times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import frame, id_and_text, release_shuffles, write_table

LENGTH = 50
TRIGGER = 16
#: Text bytes of a block, but for longer documents.
BLOCK_BYTES = 8 << 20
#: Text bytes for each bucket of triggers.
BUCKET_BYTES = 16 << 20
#: Strings of a trigger, over all blocks, from which on they are dealt out one by one.
HOT = 500_000
#: Most partitions of a shuffle; beyond it a partition has several buckets or blocks, one after another.
PARTITIONS = 100_000
#: Bytes hashed at a time.
CHUNK = 1 << 18

BLOCKS = "block long, n_bytes long, doc_ids binary, lengths binary, text binary"
RESULT = "doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Phrases:
    """The phrases of a block: trigger key, first and last string, and a digest of each phrase's bytes."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        self.text = text
        doc_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        found = [self._chunk(at, min(CHUNK, len(text) - LENGTH + 1 - at), doc_of) for at in range(0, len(text) - LENGTH + 1, CHUNK)]
        empty = [np.empty(0, d) for d in ("u8", "i8", "i8", "i8", "i4", "u8")]
        self.key, self.first, self.last, self.trigger, self.doc, self.digest = (np.concatenate(x) for x in zip(*found, empty, strict=True))

    def _chunk(self, at: int, n: int, doc_of: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.text[at : at + n + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        two = four = sixteen = None
        size = 1
        while size < 32:
            h = h[:-size] * _power(size) + h[size:]
            size *= 2
            two, sixteen = (h if size == 2 else two), (h if size == 16 else sixteen)
        whole = h[:n] * _power(18) + sixteen[32 : 32 + n] * _power(2) + two[48 : 48 + n]
        keys = _mix(sixteen)
        least = keys >> np.uint64(24) << np.uint64(24) | np.arange(len(keys), dtype=np.uint64)
        span, size = LENGTH - TRIGGER + 1, 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: size - span], least[span - size :])
        ok = np.flatnonzero(doc_of[at : at + n] == doc_of[at + LENGTH - 1 : at + LENGTH - 1 + n])
        place = (least[ok] & np.uint64((1 << 24) - 1)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(ok) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(ok)) - 1
        first, last, trigger = ok[begins], ok[ends] if len(ok) else begins, place[begins]
        digest = _mix(whole[first] * np.uint64(3) + _mix(whole[last]) + (last - first).astype(np.uint64))
        return keys[trigger], first + at, last + at, trigger + at, doc_of[first + at], digest


def _squeeze(data: bytes) -> bytes:
    """Text on its way through a shuffle or a table, at about half of what Spark's own codec leaves."""
    return zstandard.compress(data, 3)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] numbers, then starts[1] and so on."""
    return np.repeat(starts - _starts(counts), counts) + np.arange(int(counts.sum()))


def _least_of(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct groups, the least value of each, and each entry's number in them."""
    order = np.argsort(groups, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1]])) if len(order) else np.empty(0, np.int64)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    return groups[order][begins], np.minimum.reduceat(values[order], begins) if len(begins) else values[:0], inverse


def _pack(values: np.ndarray) -> bytes:
    """Runs of equal values: a bitmap of changes and the values at them."""
    change = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    return np.packbits(change).tobytes() + values[change].astype("<i8").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    width = -(-n // 8)
    change = np.unpackbits(np.frombuffer(data, np.uint8, width), count=n)
    return np.frombuffer(data, "<i8", -1, width)[np.cumsum(change, dtype=np.int64) - 1] if n else np.empty(0, "<i8")


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A table of blocks: consecutive documents in doc_id order, their UTF-8 bytes end to end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, count = [], [], 0, TaskContext.get().partitionId() << 32

        def block() -> pd.DataFrame:
            return frame(BLOCKS, block=[count], n_bytes=[size], doc_ids=[np.array(ids, "<i8").tobytes()], lengths=[np.array([len(t) for t in texts], "<i8").tobytes()], text=[_squeeze(b"".join(texts))])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                text = bytes(text)
                if texts and size + len(text) > block_bytes:
                    yield block()
                    ids, texts, size, count = [], [], 0, count + 1
                ids.append(doc)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    rows = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return write_table(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, BLOCKS), "blocks")


def _open(row) -> tuple[np.ndarray, np.ndarray, Phrases]:
    lengths = np.frombuffer(row.lengths, "<i8")
    return np.frombuffer(row.doc_ids, "<i8"), lengths, Phrases(np.frombuffer(zstandard.decompress(row.text), np.uint8), lengths)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def _cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run of sorted bucket numbers: only those that occur."""
    begins = _edges(buckets)
    ends = np.append(begins, len(buckets))[1:]
    return list(zip(buckets[begins].tolist(), begins.tolist(), ends.tolist(), strict=True))


def _block_keys(phrases: Phrases, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Distinct trigger keys by bucket, whether two documents of the block have each, the buckets' cuts, phrase -> key."""
    order = np.lexsort((phrases.key, phrases.key % np.uint64(buckets)))
    key, doc = phrases.key[order], phrases.doc[order]
    begins = _edges(key)
    shared = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(begins) else np.empty(0, bool)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
    keys = key[begins]
    return keys, shared, _cuts((keys % np.uint64(buckets)).astype(np.int64)), inverse


def _offer_keys(buckets: int):
    """Per bucket: keys, whether the block's documents share them, and the eighths of a power of two of their strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                p = _open(row)[2]
                keys, shared, cut, of_phrase = _block_keys(p, buckets)
                _, sample = np.unique(p.digest, return_index=True)
                strings = np.bincount(of_phrase[sample], (p.last - p.first + 1)[sample], len(keys))
                many = np.ceil(8 * np.log2(np.maximum(strings, 1))).astype(np.uint8)
                yield pd.DataFrame({"bucket": [c[0] for c in cut], "block": row.block, "keys": [keys[a:b].astype("<u8").tobytes() for _, a, b in cut], "shared": [np.packbits(shared[a:b]).tobytes() for _, a, b in cut], "strings": [many[a:b].tobytes() for _, a, b in cut]})

    return run


def _judge_keys(hot: int):
    """Per block, two bits a key: other documents have it; it has so many strings that they are dealt out singly."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, "<u8") for k in group["keys"]]
        shared = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(group["shared"], keys, strict=True)])
        strings = 2 ** (np.concatenate([np.frombuffer(x, np.uint8) for x in group["strings"]]) / 8)
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        both = np.bincount(inverse, shared) > 0
        wanted, often = ((counts > 1) | both)[inverse], (np.bincount(inverse, strings) >= hot)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(np.concatenate([wanted[e - len(k) : e], often[e - len(k) : e]])).tobytes() for e, k in zip(ends, keys, strict=True)]
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "bits": bits})

    return run


class Asks:
    """What a block asks: distinct phrases whose trigger others have, and single strings of hot triggers, by bucket."""

    def __init__(self, phrases: Phrases, doc_ids: np.ndarray, bits: dict[int, bytes], buckets: int):
        keys, _, cuts, of_phrase = _block_keys(phrases, buckets)
        wanted, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for bucket, a, z in cuts:
            both = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=2 * (z - a)).astype(bool)
            wanted[a:z], often[a:z] = both[: z - a], both[z - a :]
        self.phrases, p = phrases, phrases
        doc = doc_ids[p.doc]
        # Phrases: those of a block with equal digests are one entry, its document the least.
        self.soft = np.flatnonzero(wanted[of_phrase] & ~often[of_phrase])
        digest, least, self.entry = _least_of(p.digest[self.soft], doc[self.soft])
        sample = np.empty(len(digest), np.int64)
        sample[self.entry] = self.soft
        order = np.lexsort((digest, p.key[sample] % np.uint64(buckets)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.entry, self.sample, self.least, self.digest = back[self.entry], sample[order], least[order], digest[order]
        self.counts = (p.last - p.first + 1)[self.sample]
        self.cuts = _cuts((p.key[self.sample] % np.uint64(buckets)).astype(np.int64))
        # Strings.
        hard = np.flatnonzero(wanted[of_phrase] & often[of_phrase])
        n = (p.last - p.first + 1)[hard]
        self.places = _ranges(p.first[hard], n)
        self.place_doc = np.repeat(p.doc[hard], n)
        one, two = self._strings(self.places)
        order = np.lexsort((two, one, one % np.uint64(buckets)))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.empty(0, bool)
        begins = np.flatnonzero(new)
        self.place_entry = np.empty(len(order), np.int64)
        self.place_entry[order] = np.cumsum(new) - 1
        self.one, self.two = one[order][begins], two[order][begins]
        docs = doc_ids[self.place_doc][order]
        self.place_least = np.minimum.reduceat(docs, begins) if len(begins) else docs
        self.place_cuts = _cuts((self.one % np.uint64(buckets)).astype(np.int64))

    def _strings(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each string of LENGTH bytes."""
        one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
        for k in range(LENGTH):
            byte = self.phrases.text[places + k].astype(np.uint64) + np.uint64(1)
            one = one * np.uint64(_BASE) + byte
            two = _mix(two + byte)
        return _mix(one), two

    def rows(self, block: int) -> pd.DataFrame:
        p, out = self.phrases, []
        size = self.counts + LENGTH - 1
        into = (p.trigger - p.first)[self.sample]
        for b, a, z in self.cuts:
            x = slice(a, z)
            out.append((b, block, self.digest[x].tobytes(), self.least[x].astype("<i8").tobytes(), self.counts[x].astype(np.uint8).tobytes(), into[x].astype(np.uint8).tobytes(), _squeeze(p.text[_ranges(p.first[self.sample[x]], size[x])].tobytes())))
        for b, a, z in self.place_cuts:
            x = slice(a, z)
            out.append((-1 - b, block, self.one[x].tobytes(), self.place_least[x].astype("<i8").tobytes(), b"", b"", self.two[x].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "digests", "docs", "counts", "into", "bytes"])

    def covered(self, doc_ids: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """A boolean for each byte of the block: in a string that a smaller document has."""
        p = self.phrases
        values = np.full(int(self.counts.sum()), np.iinfo("i8").max, "i8")
        at = np.append(_starts(self.counts), len(values))
        place_values = np.full(len(self.one), np.iinfo("i8").max, "i8")
        for b, i, k in self.cuts:
            a, z = at[i], at[k]
            values[a:z] = _unpack(answers[b], z - a)
        for b, a, z in self.place_cuts:
            place_values[a:z] = _unpack(answers[-1 - b], z - a)
        n = self.counts[self.entry]
        places = _ranges(p.first[self.soft], n)
        found = values[_ranges(at[self.entry], n)] < np.repeat(doc_ids[p.doc[self.soft]], n)
        hit = np.concatenate([places[found], self.places[place_values[self.place_entry] < doc_ids[self.place_doc]]])
        change = np.zeros(len(p.text) + 1, np.int32)
        change[hit] += 1
        change[hit + LENGTH] -= 1
        return np.cumsum(change[:-1]) > 0


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """8 bytes from each place, as big-endian numbers: their order is that of the bytes."""
    return np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))[at].byteswap()


def suffix_groups(text: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at`` in order of their first ``length`` bytes, as far as they tie.

    Returns (order, group): indexes into ``at`` of the suffixes that share ``length`` bytes with another, in corpus
    order, and a number for each distinct string of them.
    """
    order, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = _words(text, at[order] + depth)
        step = np.lexsort((word, group)) if depth else np.argsort(word, kind="stable")
        order, group, word = order[step], group[step], word[step]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]) if len(order) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        tied = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.empty(0, bool)
        order, group = order[tied], group[tied]
    return order, group


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """The smallest document of every string that the bucket's blocks ask about."""
    digests = [np.frombuffer(x, "<u8") for x in group["digests"]]
    sizes = np.array([len(x) for x in digests])
    digest, doc = np.concatenate(digests), np.concatenate([np.frombuffer(x, "<i8") for x in group["docs"]])
    if group["bucket"].iloc[0] < 0:
        other = np.concatenate([np.frombuffer(x, "<u8") for x in group["bytes"]])
        _, least, entry = _least_of(_mix(digest) ^ other, doc)
        values, counts = least[entry], np.ones(len(digest), np.int64)
    else:
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in group["counts"]]).astype(np.int64)
        into = np.concatenate([np.frombuffer(x, np.uint8) for x in group["into"]]).astype(np.int64)
        text = np.frombuffer(b"".join([*map(zstandard.decompress, group["bytes"]), bytes(8)]), np.uint8)
        starts = _starts(counts + LENGTH - 1)
        # The dictionary: distinct phrases.
        _, least, entry = _least_of(digest, doc)
        sample = np.empty(len(least), np.int64)
        sample[entry] = np.arange(len(digest))
        n = counts[sample]
        begin = _starts(n)
        best = np.repeat(least, n)
        # A trigger with one phrase has nothing to sort.
        trigger = starts[sample] + into[sample]
        key = _mix(_words(text, trigger)) ^ _words(text, trigger + 8)
        _, of_key, times = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[of_key] > 1)
        mine = _ranges(begin[several], n[several])
        order, tied = suffix_groups(text, _ranges(starts[sample[several]], n[several]))
        if len(order):
            edge = np.flatnonzero(np.concatenate([[True], tied[1:] != tied[:-1]]))
            low = np.minimum.reduceat(best[mine[order]], edge)
            best[mine[order]] = np.repeat(low, np.diff(np.append(edge, len(order))))
        values = best
        where = begin[entry]
    out, at = [], 0
    for size in sizes.tolist():
        if group["bucket"].iloc[0] < 0:
            out.append(_pack(values[at : at + size]))
        else:
            out.append(_pack(values[_ranges(where[at : at + size], counts[at : at + size])]))
        at += size
    return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "data": out})


def _answers(row) -> dict[int, bytes]:
    return dict(zip(row.buckets, row.data, strict=True)) if row.data is not None else {}


def _ask(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                doc_ids, _, phrases = _open(row)
                yield Asks(phrases, doc_ids, _answers(row), buckets).rows(row.block)

    return run


def _cut(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                doc_ids, lengths, phrases = _open(row)
                bits = dict(zip(row.key_buckets, row.key_bits, strict=True)) if row.key_bits is not None else {}
                covered = Asks(phrases, doc_ids, bits, buckets).covered(doc_ids, _answers(row))
                out, text = [], phrases.text.tobytes()
                for doc, a, n in zip(doc_ids.tolist(), _starts(lengths).tolist(), lengths.tolist(), strict=True):
                    gone = covered[a : a + n]
                    if not gone.any():
                        out.append((doc, n, 0, np.empty(0, "i8"), np.empty(0, "i8"), text[a : a + n]))
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    out.append((doc, n, int(gone.sum()), edges[::2], edges[1::2], phrases.text[a : a + n][~gone].tobytes()))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept"])

    return run


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed runs (byte offsets, end exclusive) and the remaining bytes of each document."""
    spark = docs.sparkSession
    blocks = to_blocks(docs, block_bytes)
    release_shuffles(spark)
    total, count = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    buckets = max(16, -(-total // bucket_bytes))
    by_bucket, by_block = (lambda df, n=min(n, PARTITIONS), key=key: df.repartition(n, key) for n, key in ((buckets, "bucket"), (max(1, count), "block")))

    def gathered(rows: DataFrame, data: str, *names: str) -> DataFrame:
        """A row for each block: its buckets and what they say."""
        return by_block(rows).groupBy("block").agg(F.collect_list("bucket").alias(names[0]), F.collect_list(data).alias(names[1]))

    offers = blocks.mapInPandas(_offer_keys(buckets), "bucket long, block long, keys binary, shared binary, strings binary")
    bits = write_table(by_bucket(offers).groupBy("bucket").applyInPandas(_judge_keys(hot), "block long, bucket long, bits binary"), "triggers")
    release_shuffles(spark)
    asks = by_block(blocks).join(gathered(bits, "bits", "buckets", "data"), "block", "left").mapInPandas(_ask(buckets), "bucket long, block long, digests binary, docs binary, counts binary, into binary, bytes binary")
    answers = write_table(by_bucket(asks).groupBy("bucket").applyInPandas(_resolve, "block long, bucket long, data binary"), "strings")
    release_shuffles(spark)
    told = by_block(blocks).join(gathered(bits, "bits", "key_buckets", "key_bits"), "block", "left").join(gathered(answers, "data", "buckets", "data"), "block", "left")
    return told.mapInPandas(_cut(buckets), RESULT)
