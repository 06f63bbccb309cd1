"""Packing documents into fixed-length sequences by vector bin packing (operator 3).

An item's demand is a vector: tokens, segments (one a piece), loss-bearing tokens (those behind a document's first
``prompt_tokens``, which stand for its instruction). A sequence is a bin with a limit on each. The next item is the one of
the pool whose demand has the largest dot product with what the bin has left, both as shares of the limits, among those
that fit; when none fits, the one of which most fits is cut. A text longer than a bin's loss goes to the pool in pieces
of that size, so that short texts' prompts fill the bins beside it.

A sequence that reached its limit of segments or of loss before that of tokens is cut back to a power of two, which needs
no padding, and so are a task's last ones; what is cut off returns to the pool. So no sequence is padded. Each task packs
the rows of its own input partition through a bounded pool: nothing is shuffled, and a sequence's number is the task's number
and a count.

Defined results: a null or empty text is the end id alone; repeated rows are packed each, ties go by doc_id and place;
rows of equal doc_id are told apart by doc_tokens alone; an empty table gives no rows; other columns are ignored. A very
long text is tokenized and held whole in one task, at about its own size in ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import frame, id_and_text
from .word_cache import word_cache

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Items that a task holds before it packs; half of them stay for the next sequences.
POOL = 2048


class Packer:
    """Packs pieces of documents into sequences under limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, prompt_tokens: int, least_cut: int, sequence: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss, self.prompt = max_tokens, max_segments, max_loss, prompt_tokens
        self.least_cut, self.sequence = least_cut, sequence
        #: (doc, first id, id behind the last, all ids of the document)
        self.pool: list[tuple[int, int, int, np.ndarray]] = []
        self.out: list[tuple] = []

    def loss(self, start, stop):
        return np.maximum(stop - np.maximum(start, self.prompt), 0)

    def add(self, doc: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.max_tokens, self.max_loss + max(0, self.prompt - at))
            self.pool.append((doc, at, at + take, ids))
            at += take

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, stop, ids in pieces:
            self.out.append((doc, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids), self.sequence, offset, int(self.loss(start, stop))))
            offset += stop - start
        self.sequence += 1

    def pack(self, keep: int) -> None:
        """Fill sequences until no more than ``keep`` items are left; those that can't fill one stay, unless all must go."""
        pool = sorted(self.pool, key=lambda p: (p[1] - p[2], p[0], p[1]))
        start, stop = np.array([p[1] for p in pool], np.int64), np.array([p[2] for p in pool], np.int64)
        demand = np.empty((3, len(pool)))
        live = stop > start

        def weigh(i) -> None:
            for k, amount in enumerate((stop[i] - start[i], 1, self.loss(start[i], stop[i]))):
                demand[k, i] = amount / self.limits[k]

        weigh(slice(None))
        while live.sum() > keep and (not keep or (stop - start)[live].sum() >= self.max_tokens):
            taken, used = [], np.zeros(3)
            while used[0] < self.max_tokens and used[1] < self.max_segments:
                room = self.limits - used
                share = room / self.limits
                fits = live & (demand[0] <= share[0] + 1e-12) & (demand[1] <= share[1] + 1e-12) & (demand[2] <= share[2] + 1e-12)
                score = np.where(fits, share @ demand, -1.0)
                i = int(score.argmax())
                if score[i] >= 0:
                    end = stop[i]
                else:
                    part = np.where(live, np.minimum(np.minimum(stop - start, room[0]), room[2] + np.maximum(self.prompt - start, 0)), 0)
                    i = int(part.argmax())
                    n = int(part[i])
                    if n < self.least_cut and n < room[0] or not n:
                        break
                    end = start[i] + n
                taken.append((i, int(start[i]), int(end)))
                used += (end - start[i], 1, self.loss(start[i], end))
                start[i] = end
                live[i] = end < stop[i]
                weigh(i)
            extra = int(used[0]) - (1 << (int(used[0]).bit_length() - 1))
            while extra:
                i, a, z = taken.pop()
                cut = min(extra, z - a)
                if cut < z - a:
                    taken.append((i, a, z - cut))
                # What is cut off lies right before the item's rest.
                start[i], live[i] = z - cut, True
                weigh(i)
                extra -= cut
            self._emit([(pool[i][0], a, z, pool[i][3]) for i, a, z in taken])
        self.pool = [(pool[i][0], int(start[i]), int(stop[i]), pool[i][3]) for i in np.flatnonzero(live).tolist()]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 32, max_loss: int = 2016, prompt_tokens: int = 32, least_cut: int = 8) -> DataFrame:
    """One row for each piece of each document: where it begins there, its length, its sequence and its place in it."""
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, prompt_tokens, least_cut, TaskContext.get().partitionId() << 40)

        def flush() -> pd.DataFrame:
            columns = zip(*packer.out, strict=True) if packer.out else [[]] * 8
            out = frame(RESULT, **{c: np.array(v, "int64") for c, v in zip((x.split()[0] for x in RESULT.split(", ")), columns, strict=True)})
            packer.out = []
            return out

        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for at in range(0, len(texts), 1000):
                for doc, got in zip(ids[at : at + 1000], cache.encode(texts[at : at + 1000]), strict=True):
                    packer.add(doc, np.append(got, end).astype("<u4"))
                    if len(packer.pool) >= POOL:
                        packer.pack(POOL // 2)
                if len(packer.out) >= 20_000:
                    yield flush()
        packer.pack(0)
        yield flush()

    return id_and_text(docs).mapInPandas(run, RESULT)
