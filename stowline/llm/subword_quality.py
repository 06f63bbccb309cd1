"""Quality classifier over supervised subword embeddings (operator 6).

Every word (a run of characters without white space) and every byte n-gram of 3 to 5 inside ``<word>`` is hashed to a
learned vector; a word that repeats the one before it counts as a ditto instead, one word for all. A document is the mean of its vectors; a softmax layer gives the probability of label 1. Vectors and
layer are trained by stochastic gradient descent in numpy (AdaGrad steps over minibatches of documents), on at most
``TRAIN_ROWS`` labelled rows, those with the smallest hash of doc_id. Only the text is an input.

A document's logit is a mean of one number a feature, so to score, a task sums these numbers for each distinct word of
a batch once and adds up words by document.

Defined results: null, empty and blank texts are scored by the layer's bias alone; repeated rows get equal scores; rows
of labels without a document, of no quality or of equal doc_id (of which the smallest label counts) do no harm; without
both labels to learn from, every score is the share of label 1 (0.5 without rows); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bm25_decontam import _keys
from .common import id_and_text

BUCKETS, DIM = 1 << 17, 8
NGRAMS = (3, 4, 5)
#: Stands for a word that repeats the one before it.
DITTO = b"\x7fditto\x7f"
TRAIN_ROWS, EPOCHS, MINIBATCH, RATE, SEED = 3000, 8, 64, 0.5, 6
HELD_OUT, FOLDS = 2, 4
KEEP = 0.7
BATCH_BYTES = 4 << 20
RESULT = "doc_id long, score double"


def _word_spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes above the blank."""
    edge = np.flatnonzero(np.diff((text > 32).view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def word_features(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, end to end, and how many each has."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), ord(">"), np.uint8)
    padded[begin] = ord("<")
    padded[_ranges(begin + 1, ends - starts)] = text[_ranges(starts, ends - starts)]
    owner = np.repeat(np.arange(len(size)), size)
    value = padded.astype(np.uint64) + np.uint64(1)
    ids, who = [(_mix(_keys(text, starts, ends)) % np.uint64(BUCKETS)).astype(np.int64)], [np.arange(len(size))]
    h = value
    for n in range(2, max(NGRAMS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n in NGRAMS:
            inside = owner[: len(h)] == owner[n - 1 :]
            ids.append((_mix(h[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            who.append(owner[: len(h)][inside])
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return ids[order], np.bincount(who, minlength=len(size))


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, distinct words (starts, ends), and the document and distinct word of every word."""
    raw = [*(t.encode("utf-8", "surrogatepass") for t in texts), DITTO]
    text = np.frombuffer(b" ".join([*raw, bytes(32)]), np.uint8)
    starts, ends = _word_spans(text)
    doc = np.searchsorted(np.cumsum([0, *(len(r) + 1 for r in raw)]), starts, side="right") - 1
    keys = _keys(text, starts, ends)
    again = np.flatnonzero((keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])) + 1
    keys[again] = keys[-1]
    _, sample, inverse = np.unique(keys[::-1], return_index=True, return_inverse=True)
    sample = len(keys) - 1 - sample
    return text, starts[sample], ends[sample], doc[:-1], inverse[::-1][:-1]


class Model:
    """One number a feature and a bias: the difference of the softmax layer's two logits."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        text, starts, ends, doc, word = _words_of(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        if len(starts):
            ids, n = word_features(text, starts, ends)
            own = np.add.reduceat(self.weight[ids], np.cumsum(n) - n)
            total = np.bincount(doc, own[word], minlength=len(texts))
            count = np.bincount(doc, n[word], minlength=len(texts))
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Stochastic gradient descent on embeddings and layer."""
    if not len(texts) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(texts) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    # A row for each dimension, so that sums over features are over one array each.
    emb, layer, bias = rng.normal(0, 0.05, (DIM, BUCKETS)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    g_emb, g_layer, g_bias = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    text, starts, ends, doc, word = _words_of(texts)
    ids, n = word_features(text, starts, ends)
    at = np.cumsum(n) - n
    # Distinct (document, word) pairs with counts, by document.
    pairs, times = np.unique(doc * len(starts) + word, return_counts=True)
    pair_doc, pair_word = pairs // max(1, len(starts)), pairs % max(1, len(starts))
    first = np.searchsorted(pair_doc, np.arange(len(texts) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), MINIBATCH):
            some = order[k : k + MINIBATCH]
            size = first[some + 1] - first[some]
            p = _ranges(first[some], size)
            who = np.repeat(np.arange(len(some)), size)
            used = np.zeros(len(starts), bool)
            used[pair_word[p]] = True
            own = np.flatnonzero(used)
            inverse = np.cumsum(used)[pair_word[p]] - 1
            f = ids[_ranges(at[own], n[own])]
            begin = np.cumsum(n[own]) - n[own]
            vectors = [np.add.reduceat(e[f], begin) if len(own) else np.zeros(0) for e in emb]
            many = np.maximum(np.bincount(who, times[p] * n[pair_word[p]], minlength=len(some)), 1)
            share = times[p] / many[who]
            mean = np.stack([np.bincount(who, share * vectors[d][inverse], minlength=len(some)) for d in range(DIM)], axis=1)
            logits = mean @ layer + bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = e / e.sum(axis=1, keepdims=True)
            slope[np.arange(len(some)), labels[some]] -= 1
            slope /= len(some)
            down = slope @ layer.T
            d_layer, d_bias = mean.T @ slope, slope.sum(axis=0)
            d_emb = [np.bincount(f, np.repeat(np.bincount(inverse, share * down[who, d], minlength=len(own)), n[own]), minlength=BUCKETS) for d in range(DIM)]
            g_emb += sum(x * x for x in d_emb) / DIM
            g_layer += d_layer**2
            g_bias += d_bias**2
            rate = RATE / np.sqrt(g_emb)
            for e, x in zip(emb, d_emb, strict=True):
                e -= rate * x
            layer -= RATE * 0.2 * d_layer / np.sqrt(g_layer)
            bias -= RATE * 0.2 * d_bias / np.sqrt(g_bias)
    return Model((layer[:, 1] - layer[:, 0]) @ emb, float(bias[1] - bias[0]))


def held_out(doc_id):
    """Whether a row is of the fold that no label is learnt from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = id_and_text(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return train(got["text"].tolist(), got["quality"].to_numpy(np.int64))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and score (probability of label 1) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size < BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:end].to_numpy(), "score": model.scores(texts[at:end])})
                at = end

    return id_and_text(docs).mapInPandas(run, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of docs that score ``least`` or more; all columns stay."""
    return docs.join(score(docs, labels).where(F.col("score") >= least).select("doc_id").distinct(), "doc_id", "left_semi")
