"""Benchmark decontamination by a BM25 index of test items with block-max WAND (operator 5).

The test items are the index, each training passage is a query. A posting holds its BM25 impact as a share of what
the item scores against itself, so one threshold serves items of any length; postings are in item order, in blocks of
``BLOCK_ITEMS`` item numbers with their largest impact.

A document is read in segments of ``SEGMENT`` words. Items are in classes by their number of words, up to a power of two;
for each class, as many segments as hold its longest item wherever it starts are a passage, so a passage's length
depends on the item alone. Before cursors are moved, the sums of block maxima of all passages of a batch are
taken at once: a passage in which no block can reach the threshold holds nothing. The others go through block-max
WAND, which returns every item above the threshold. A found item counts if the words of its question part and those
of its answer part (its last sentence, or its last quarter if it has one sentence) stand in the passage, in order, to
``LEAST_OVERLAP`` each.

The number of items, their mean length and each word's document frequency are counted by Spark over all items. Items
are indexed in slices of about ``slice_items``, all with those statistics, so what is found does not depend on the
slices. A scan of the texts asks the slices of up to ``SCAN_BYTES`` of items one after another, which is the bound on
what is broadcast; a larger test set takes another scan for each such part.

Defined results: null and empty texts match nothing; an item without words or item_id is left out; repeated documents match
each, repeated items each (of equal item_id and place, the best score counts); of equal passages the first counts; an
empty table on either side gives no rows; other columns are ignored. A very long text is one row of a task: its words take
about 25 bytes a byte of it, its passages are looked at ``CELLS`` bounds at a time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, write_table

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
SEGMENT = 30
THRESHOLD = 0.7
LEAST_OVERLAP = 0.8
SLICE_ITEMS, SCAN_BYTES = 2000, 8 << 20
BATCH_BYTES, CELLS = 4 << 20, 8 << 20
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_start long"

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes."""
    inside = _WORD_BYTE[text]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def words(text: str) -> list[str]:
    raw = text.lower().encode("utf-8", "surrogatepass")
    starts, ends = _spans(np.frombuffer(raw, np.uint8))
    return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]


def _keys(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of all bytes of each word; text has 8 bytes or more behind the last word."""
    lengths = ends - starts
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    view = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    some = np.arange(len(lengths))
    for k in range(0, int(lengths.max(initial=0)), 8):
        some = some[lengths[some] > k]
        left = np.minimum(lengths[some] - k, 8).astype(np.uint64)
        h = out[some] ^ (view[starts[some] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8))))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[some] = h ^ (h >> np.uint64(29))
    return out


class Statistics:
    """Of all items: how many, their mean number of words, and how many hold each word."""

    def __init__(self, n: int, mean: float, frequency: dict[str, int]):
        self.n, self.mean, self.frequency = n, mean, frequency

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        held = [w for t in texts if (w := words(t or ""))]
        return cls(len(held), sum(map(len, held)) / max(1, len(held)), Counter(t for w in held for t in set(w)))

    def impacts(self, item: list[str]) -> dict[str, float]:
        """BM25 of each distinct word of the item, as a share of their sum."""
        out = {}
        for t, f in Counter(item).items():
            d = self.frequency[t]
            out[t] = math.log(1 + (self.n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(item) / self.mean))
        own = sum(out.values())
        return {t: x / own for t, x in out.items()}


def span_of(n_words: int) -> int:
    """Segments of a passage for items of so many words: by the next power of two."""
    return 1 + -(-(1 << (n_words - 1).bit_length()) // SEGMENT)


class Index:
    """An inverted index of items (id, text) with BM25 impacts relative to each item's own score.

    Item numbers run by length class; a class begins at a block of its own, so some numbers are of no item.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics.of([t for _, t in items])
        held = sorted(((i, t, w) for i, t in items if (w := words(t or ""))), key=lambda x: (span_of(len(x[2])), x[0], x[1]))
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.parts: list[tuple] = []
        #: (segments of a passage, first item, last item + 1) of each class.
        self.classes: list[tuple[int, int, int]] = []
        for item, text, own in held:
            if not self.classes or self.classes[-1][0] != span_of(len(own)):
                for part in (self.ids, self.words, self.parts):
                    part += [None] * (-len(part) % BLOCK_ITEMS)
                self.classes.append((span_of(len(own)), len(self.ids), len(self.ids)))
            self.ids.append(item)
            self.words.append(own)
            self.parts.append(self._parts(text))
            self.classes[-1] = (*self.classes[-1][:2], len(self.ids))
        self.vocabulary = sorted({t for w in self.words if w for t in w})
        number = {t: k for k, t in enumerate(self.vocabulary)}
        self.lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        self.blocks = -(-len(self.ids) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.vocabulary), self.blocks), np.float32)
        for item, own in enumerate(self.words):
            for t, x in (statistics.impacts(own) if own else {}).items():
                self.lists[number[t]].append((item, x))
                self.block_max[number[t], item // BLOCK_ITEMS] = max(self.block_max[number[t], item // BLOCK_ITEMS], x)
        self.max = self.block_max.max(axis=1) if self.blocks else np.zeros(0, np.float32)
        raw = [t.encode("utf-8", "surrogatepass") for t in self.vocabulary]
        text = np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        keys = _keys(text, ends - [len(r) for r in raw], ends) if raw else np.empty(0, np.uint64)
        self.order = np.argsort(keys)
        self.sorted_keys = keys[self.order]

    @staticmethod
    def _parts(text: str) -> tuple[list[str], list[str]]:
        """Words of the question part and of the answer part."""
        sentences = [w for s in re.split(r"(?<=[.?!])\s+", text) if (w := words(s))]
        if len(sentences) > 1:
            return [w for s in sentences[:-1] for w in s], sentences[-1]
        own = sentences[0]
        cut = len(own) - max(1, len(own) // 4)
        return own[:cut], own[cut:]

    def terms(self, keys: np.ndarray) -> np.ndarray:
        """Term number of each word, or -1."""
        if not len(self.sorted_keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[i] == keys, self.order[i], -1)

    def above(self, terms: list[int], threshold: float, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """(item, score) of every item from first to end that scores the threshold or more against distinct terms: block-max WAND."""
        end = len(self.ids) if end is None else end
        cursors = [[bisect_left(self.lists[t], (first,)), self.lists[t], float(self.max[t]), self.block_max[t]] for t in terms]
        out, slack = [], threshold - 1e-6
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(c[1]) and c[1][c[0]][0] < end), key=lambda c: c[1][c[0]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][1][cursors[pivot][0]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(float(c[3][block]) for c in cursors[: pivot + 1]) < slack:
                # No item of the block up to the next list's head can do it.
                to = min((block + 1) * BLOCK_ITEMS, cursors[pivot + 1][1][cursors[pivot + 1][0]][0] if pivot + 1 < len(cursors) else end)
            else:
                to = item
                if cursors[0][1][cursors[0][0]][0] == item:
                    score = sum(c[1][c[0]][1] for c in cursors[: pivot + 1])
                    if score >= slack:
                        out.append((item, score))
                    to = item + 1
            for c in cursors[: pivot + 1]:
                while c[0] < len(c[1]) and c[1][c[0]][0] < to:
                    c[0] += 1


def _overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's words that stand in the passage in the same order."""
    if not part:
        return 1.0
    return sum(m.size for m in SequenceMatcher(None, part, passage, autojunk=False).get_matching_blocks()) / len(part)


class Passages:
    """The words of a batch of texts, in segments."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        self.text = np.frombuffer(b" ".join([*raw, bytes(8)]), np.uint8)
        self.starts, self.ends = _spans(self.text[:-8])
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))  # of each document's words
        self.keys = _keys(self.text, self.starts, self.ends)
        count = np.diff(self.first)
        segments = -(-count // SEGMENT)
        self.seg_begin = np.cumsum(segments) - segments
        self.seg_doc = np.repeat(np.arange(len(raw)), segments)
        self.seg_end = (self.seg_begin + segments)[self.seg_doc]
        doc = np.repeat(np.arange(len(raw)), count)
        self.segment = self.seg_begin[doc] + (np.arange(len(self.starts)) - self.first[:-1][doc]) // SEGMENT

    def words(self, a: int, z: int) -> list[str]:
        return [bytes(self.text[x:y]).decode("utf-8", "surrogatepass") for x, y in zip(self.starts[a:z].tolist(), self.ends[a:z].tolist(), strict=True)]


def _found(index: Index, p: Passages, threshold: float, least: float) -> dict[tuple[int, int], tuple]:
    """(document's place, item) -> best passage's score, overlaps and first word."""
    best: dict[tuple[int, int], tuple] = {}
    term = index.terms(p.keys)
    hit = np.flatnonzero(term >= 0)
    if not len(hit):
        return best
    pairs = np.unique(p.segment[hit] * len(index.vocabulary) + term[hit])
    of_segment, of_term = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    total, width = len(p.seg_doc), max(1, CELLS // index.blocks)
    for span, first, end in index.classes:
        columns = slice(first // BLOCK_ITEMS, -(-end // BLOCK_ITEMS))
        for at in range(0, total, width):
            to, upto = min(at + width, total), min(at + width + span, total)
            x, y = np.searchsorted(of_segment, [at, upto])
            if x == y:
                continue
            edge = x + np.flatnonzero(np.diff(of_segment[x:y], prepend=-1))
            sums = np.zeros((upto - at + 1, columns.stop - columns.start))
            sums[of_segment[edge] - at + 1] = np.add.reduceat(index.block_max[of_term[x:y], columns], edge - x, axis=0)
            np.cumsum(sums, axis=0, out=sums)
            begin = np.arange(at, to)
            bound = sums[np.minimum(begin + span, p.seg_end[at:to]) - at] - sums[begin - at]
            for s in (at + np.flatnonzero((bound >= threshold - 1e-4).any(axis=1))).tolist():
                d = int(p.seg_doc[s])
                a = p.first[d] + (s - p.seg_begin[d]) * SEGMENT
                z = min(a + span * SEGMENT, p.first[d + 1])
                passage = None
                for item, score in index.above(sorted({t for t in term[a:z].tolist() if t >= 0}), threshold, first, end):
                    passage = p.words(a, z) if passage is None else passage
                    question, answer = (_overlap(part, passage) for part in index.parts[item])
                    if question >= least and answer >= least:
                        row = (score, question, answer, int(a - p.first[d]))
                        key = (d, index.ids[item])
                        if key not in best or (*row[:3], -row[3]) > (*best[key][:3], -best[key][3]):
                            best[key] = row
    return best


def _read_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held = [words(t or "") for t in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"], "text": batch["text"], "n_words": [len(w) for w in held], "terms": [sorted(set(w)) for w in held]})


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = LEAST_OVERLAP, slice_items: int = SLICE_ITEMS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """One row for each document and test item found in it, with its best passage's score, overlaps and first word."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = write_table(items.mapInPandas(_read_items, "item_id long, text string, n_words long, terms array<string>").where("n_words > 0"), "items")
    n, total, size = items.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequency = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    scans = max(1, -(-size // scan_bytes))
    slices = max(1, -(-n // (scans * slice_items)))
    texts, found = id_and_text(docs), None
    numbered = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(scans * slices)))
    for scan in range(scans):
        part = numbered.where(F.col("slice") % scans == scan)
        asked = part.select(F.explode("terms").alias("term")).distinct()
        known = {r["term"]: r["n"] for r in frequency.join(asked, "term", "left_semi").collect()}
        held: dict[int, list] = {}
        for r in part.select("slice", "item_id", "text").collect():
            held.setdefault(r["slice"], []).append((r["item_id"], r["text"]))
        shared = spark.sparkContext.broadcast((Statistics(n, total / max(1, n), known), [held[k] for k in sorted(held)]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            statistics, parts = shared.value
            indexes = [Index(p, statistics) for p in parts]
            for batch in batches:
                ids, some = batch["doc_id"].tolist(), batch["text"].tolist()
                at = 0
                while at < len(some):
                    size, end = 0, at
                    while end < len(some) and (end == at or size < BATCH_BYTES):
                        size += len(some[end])
                        end += 1
                    p = Passages(some[at:end])
                    rows = [(ids[at + d], item, *row) for index in indexes for (d, item), row in _found(index, p, threshold, least).items()]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
                    at = end

        rows = texts.mapInPandas(run, RESULT)
        found = rows if found is None else found.unionByName(rows)
    # Items of one id but other texts may lie in several slices.
    return found if scans * slices == 1 else found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("word_start")).alias("w"))).alias("b")).select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap", (-F.col("b.w")).alias("word_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item was found; all columns stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
