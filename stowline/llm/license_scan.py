"""Licence scans by a trained paragraph classifier (operator 10).

A multinomial logistic regression over sparse word 1- to 3-grams tells a paragraph's licence family from others, from
licences of no known family (``unknown``) and from ordinary text. It is trained here, by numpy gradient descent, on
variants of public licence wording, on announcements of families and of other licences by name, on decoys and on random
words. Its temperature, and the probability below which a family is not named, are fitted on announcements worded
otherwise and on licences it has not seen: of these, at most ``LEAST_NAMED`` may be given a family.

The family's templates, its texts and the announcements of its names, have the last word. Of the word trigrams of the
shorter of the two, the paragraph and a template share a part. A family is named if that is at least ``LEAST_SIMILARITY`` and it is
probable enough, or, however probable, at least ``SURE``; so a named family is a confirmed one. If it is less than ``REJECTED``
the templates reject the family and the next likely class counts, which may be ordinary text; in between the paragraph is of
an unknown licence.

What is scored are stretches of words, whatever the lines: a document's anchors are the word 2- and 3-grams that speak
for a licence and not all function words; anchors of one sentence with at most ``GAP`` words between them are a stretch, with up to ``AROUND`` words
of the sentence at each side. So a notice in a line of a thousand words, or one wrapped over several lines, is scored as
itself. Neighbouring stretches of one family are one paragraph, and are scored again as one.

Defined results: null and empty texts have no paragraphs; repeated documents are reported each; of equal families the
first in template order wins; an empty table gives no rows; other columns are ignored. Lines are counted by line feeds from
0. A very long text is scanned whole, in about 30 times its size in memory.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .bm25_decontam import _keys, _spans
from .common import id_and_text
from .license_templates import DECOYS, NAMES, OTHERS, SAID, SAID_OTHERWISE, TEMPLATES, UNSEEN

#: Probability of being no ordinary text at which a stretch is reported; share of unseen licences that may be named.
LEAST_LICENCE, LEAST_NAMED = 0.5, 0.05
#: Shared trigrams, as a share of the smaller set, that confirm a family.
LEAST_SIMILARITY = 0.6
#: The same, at which a family is named whatever its probability, and below which it is rejected.
SURE, REJECTED = 0.9, 0.3
#: Words between anchors of a stretch, around a stretch, and between stretches of a paragraph.
GAP, AROUND, BETWEEN = 10, 3, 12
#: Further words of the sentence that are shown of a licence of no known family: its name.
NAME = 6
VARIANTS, ROUNDS, SEED = 8, 150, 10
BATCH_BYTES = 4 << 20
RESULT = "doc_id long, paragraph long, first_line long, last_line long, family string, probability double, similarity double, confirmed boolean, text string"


# Words that speak for nothing.
FUNCTION_WORDS = "a an and any are as at be been by but can for from had has have he her his if in into is it its may no not of on or our she so some such than that the their them there these they this those to under was we were which who will with would you your".split()
FUNCTION_SET = frozenset(FUNCTION_WORDS)


def tokens_of(text: str) -> list[str]:
    """Words as the scan reads them: runs of ASCII letters, small ones, digits and all other characters beyond ASCII."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    starts, ends = _spans(np.frombuffer(raw, np.uint8))
    return [raw[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]


def ngrams(tokens: list[str], most: int = 3) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for n in range(1, most + 1) for i in range(len(tokens) - n + 1)}


def _norm(words_in: int) -> float:
    """Root of the n-grams that so many words have, known or not: foreign words around a known one weaken it."""
    return float(np.sqrt(max(1, 3 * words_in - 3)))


def _noise(rng: random.Random) -> str:
    return "".join(rng.choices("aeiourstnlmdhc", k=rng.randint(2, 8)))


def _variant(rng: random.Random, tokens: list[str]) -> list[str]:
    """A wording as it stands, with a word gone or a part of it, and with up to three other words at each side."""
    out = list(tokens)
    kind = rng.randrange(4)
    if kind == 1 and len(out) > 4:
        del out[rng.randrange(len(out))]
    elif kind == 2 and len(out) > 12:
        a = rng.randrange(len(out) - 10)
        out = out[a : a + rng.randint(8, len(out))]
    return [_noise(rng) for _ in range(rng.randint(0, AROUND))] + out + [_noise(rng) for _ in range(rng.randint(0, AROUND))]


class Model:
    """Weights by n-gram; classes are the families, ``unknown`` and ``none``.

    ``named`` is the least probability of a named family; ``recall`` and ``precision`` are those of naming, and
    ``unknown_recall`` the share of licences never seen that are reported as unknown, all on the calibration rows.
    """

    def __init__(self):
        rng = random.Random(SEED)
        self.classes = [*TEMPLATES, "unknown", "none"]
        self.templates = [[tokens_of(t) for t in v] for v in TEMPLATES.values()]
        said = [[tokens_of(form.format(n)) for n in NAMES.get(name, []) for form in SAID] for name in TEMPLATES]
        self.compared = [[self._trigrams(t) for t in (*texts, *announced)] for texts, announced in zip(self.templates, said, strict=True)]
        unknown, none = len(self.classes) - 2, len(self.classes) - 1
        rows: list[tuple[list[str], int]] = []
        for family, (name, texts) in enumerate(TEMPLATES.items()):
            wordings = [*texts, *(s for t in texts for s in re.split(r"(?<=[.;:])\s+", t) if len(s) > 30)]
            rows += [(_variant(rng, tokens_of(t)), family) for t in wordings for _ in range(VARIANTS)]
            rows += [(_variant(rng, tokens_of(said.format(n))), family) for n in NAMES.get(name, []) for said in SAID]
        others = [*OTHERS, *(f"{_noise(rng).title()} {rng.choice(['Public', 'Community', 'Software', 'Open Source'])} License" for _ in range(20))]
        rows += [(_variant(rng, tokens_of(said.format(n))), unknown) for n in others for said in SAID]
        rows += [(_variant(rng, tokens_of(d)), none) for d in DECOYS for _ in range(VARIANTS)]
        rows += [([rng.choice(FUNCTION_WORDS) if rng.random() < 0.6 else _noise(rng) for _ in range(rng.randint(1, 20))], none) for _ in range(400)]
        common = sorted({w for tokens, _ in rows for w in tokens})
        rows += [([_noise(rng) if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.randint(1, 60))], none) for _ in range(500)]
        rows += [([rng.choice(common) for _ in range(rng.randint(1, 2))], none) for _ in range(200)]
        told: list[tuple[list[str], int]] = []
        told += [(_variant(rng, tokens_of(said.format(n))), family) for family, name in enumerate(TEMPLATES) for n in NAMES.get(name, []) for said in SAID_OTHERWISE]
        told += [(_variant(rng, tokens_of(said.format(n))), unknown) for n in UNSEEN for said in SAID + SAID_OTHERWISE]
        told += [([_noise(rng) if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.randint(1, 60))], none) for _ in range(300)]
        counts: dict[tuple, int] = {}
        for tokens, _ in rows:
            for g in ngrams(tokens):
                counts[g] = counts.get(g, 0) + 1
        self.grams = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 2))}
        self._train([self._features(t) for t, _ in rows], [_norm(len(t)) for t, _ in rows], np.array([y for _, y in rows]))
        self.weights, self.bias = self.weights.astype(np.float64), self.bias.astype(np.float64)
        self._calibrate([t for t, _ in told], np.array([y for _, y in told]), unknown, none)
        # Anchors: about the weakest that still gives every template one.
        lean = self.weights[:, :none].max(axis=1) - self.weights[:, none]
        several = np.array([len(g) > 1 and not FUNCTION_SET.issuperset(g) for g in self.grams])
        best = [max((lean[i] for i in self._features(t) if several[i]), default=0) for v in self.templates for t in v]
        self.anchor = several & (lean >= min(1.0, 0.8 * min(best)))
        self._key_tables()

    def _train(self, features: list[np.ndarray], norms: list[float], label: np.ndarray) -> None:
        classes = len(self.classes)
        self.weights, self.bias = np.zeros((len(self.grams), classes), np.float32), np.zeros(classes, np.float32)
        self.temperature = 1.0
        size = np.array([len(f) for f in features])
        row, column = np.repeat(np.arange(len(features)), size), np.concatenate(features)
        value = np.repeat(1 / np.array(norms, np.float32), size)
        balance = (len(label) / classes / np.bincount(label, minlength=classes)).astype(np.float32)[label]
        order = np.argsort(column, kind="stable")
        col_edge, row_edge = np.flatnonzero(np.diff(column[order], prepend=-1)), np.flatnonzero(np.diff(row, prepend=-1))
        target = np.eye(classes, dtype=np.float32)[label]
        for step in range(ROUNDS):
            logits = np.tile(self.bias, (len(label), 1))
            logits[row[row_edge]] += np.add.reduceat(self.weights[column] * value[:, None], row_edge, axis=0)
            slope = (self._softmax(logits) - target) * balance[:, None] / len(label)
            rate = np.float32(60 / (1 + step / 100))
            self.weights[column[order][col_edge]] -= rate * np.add.reduceat((slope[row] * value[:, None])[order], col_edge, axis=0)
            self.weights *= np.float32(1 - 1e-4)
            self.bias -= rate * np.float32(0.1) * slope.sum(axis=0)

    def _calibrate(self, rows: list[list[str]], label: np.ndarray, unknown: int, none: int) -> None:
        logits = np.stack([self._logits(t) for t in rows])
        loss = {t: -np.log(self._softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
        self.temperature = float(min(loss, key=loss.get))
        p = self._softmax(logits / self.temperature)
        top, reported = p[:, :none].argmax(axis=1), 1 - p[:, none] >= LEAST_LICENCE
        sure = p[np.arange(len(p)), top]
        odd = label == unknown
        self.named = next(x for x in np.arange(0.4, 1.001, 0.02) if (odd & reported & (top < unknown) & (sure >= x)).sum() <= LEAST_NAMED * odd.sum())
        named = reported & (top < unknown) & (sure >= self.named)
        right = named & (top == label)
        self.precision, self.recall = float(right.sum() / max(1, named.sum())), float(right.sum() / (label < unknown).sum())
        self.unknown_recall = float((odd & reported & ~named).sum() / odd.sum())

    def _features(self, tokens: list[str]) -> np.ndarray:
        return np.array(sorted(i for g in ngrams(tokens) if (i := self.grams.get(g)) is not None), np.int64)

    def _logits(self, tokens: list[str]) -> np.ndarray:
        return self.bias + self.weights[self._features(tokens)].sum(axis=0) / _norm(len(tokens))

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        return self._softmax(self._logits(tokens) / self.temperature)

    def _key_tables(self) -> None:
        """Keys of the anchors' words, and anchors as numbers, for whole batches of words."""
        self.known = {w for v in self.templates for t in v for w in t}
        anchors = [g for g, i in self.grams.items() if self.anchor[i]]
        names = sorted({w for g in anchors for w in g})
        raw = [w.encode("utf-8", "surrogatepass") for w in names]
        ends = np.cumsum([len(r) for r in raw])
        keys = _keys(np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8), ends - [len(r) for r in raw], ends)
        order = np.argsort(keys)
        self.word_keys, self.word_of = keys[order], order
        number = {w: i + 1 for i, w in enumerate(names)}
        self.base = len(names) + 1
        self.codes = np.array(sorted(sum(number[w] * self.base**k for k, w in enumerate(g)) for g in anchors))

    def anchors(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word, and word behind the last, of each anchor that lies in one sentence, in order."""
        keys = _keys(text, starts, ends)
        i = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        word = np.where(self.word_keys[i] == keys, self.word_of[i] + 1, 0)
        at, size = [], []
        for n in (2, 3):
            m = max(0, len(word) - n + 1)
            some = np.flatnonzero((word[:m] > 0) & (word[n - 1 :] > 0) & (sentence[:m] == sentence[n - 1 :])) if m else np.empty(0, np.int64)
            if n == 3:
                some = some[word[some + 1] > 0]
            code = sum(word[some + k].astype(np.int64) * self.base**k for k in range(n)) if len(some) else some
            j = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = some[self.codes[j] == code]
            at.append(hit)
            size.append(np.full(len(hit), n))
        at, size = np.concatenate(at), np.concatenate(size)
        order = np.lexsort((size, at))
        return at[order], (at + size)[order]

    @staticmethod
    def _trigrams(tokens: list[str]) -> frozenset[tuple[str, ...]]:
        return frozenset(tuple(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2)))

    def similarity(self, tokens: list[str], family: int) -> float:
        own = self._trigrams(tokens)
        return max(len(own & other) / min(len(own), len(other)) for other in self.compared[family])

    def judge(self, tokens: list[str], p: np.ndarray) -> tuple[str, float, float, bool] | None:
        """Family, probability, similarity and whether it is confirmed; None for ordinary text."""
        for kind in np.argsort(-p, kind="stable").tolist():
            if self.classes[kind] == "none":
                return None
            if self.classes[kind] == "unknown":
                return "unknown", float(p[kind]), 0.0, False
            alike = self.similarity(tokens, kind)
            if alike >= SURE or alike >= LEAST_SIMILARITY and p[kind] >= self.named:
                return self.classes[kind], float(p[kind]), alike, True
            if alike >= REJECTED:
                return "unknown", float(p[kind]), alike, False
        return None


@lru_cache(maxsize=1)
def model() -> Model:
    """Trained once a process, the same everywhere."""
    return Model()


_STOP, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;"]] = True
_SPACE[[9, 10, 13, 32]] = True


def scan(m: Model, texts: list[str]) -> list[list[tuple]]:
    """Paragraphs of each text: (paragraph, first line, last line, family, probability, similarity, confirmed, text)."""
    raw = b"\n\n".join([*(t.encode("utf-8", "surrogatepass") for t in texts), bytes(8)])
    text = np.frombuffer(raw.lower(), np.uint8)
    starts, ends = _spans(text[:-8])
    found: list[list[tuple]] = [[] for _ in texts]
    if not len(starts):
        return found
    begins = np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass")) + 2 for t in texts)])
    lines = np.flatnonzero(text == 10)
    # A sentence ends with a stop before white space, and with an empty line.
    stop = np.concatenate([_STOP[text[:-1]] & _SPACE[text[1:]] | (text[:-1] == 10) & (text[1:] == 10), [False]])
    sentence = np.cumsum(stop, dtype=np.int64)[starts]
    first, behind = m.anchors(text, starts, ends, sentence)
    if not len(first):
        return found
    reach = np.maximum.accumulate(behind)
    new = np.flatnonzero(np.concatenate([[True], (sentence[first[1:]] != sentence[first[:-1]]) | (first[1:] - reach[:-1] > GAP)]))
    own_low, own_high = first[new], reach[np.append(new[1:], len(first)) - 1]
    low = np.maximum(own_low - AROUND, np.searchsorted(sentence, sentence[own_low]))
    high = np.minimum(own_high + AROUND, np.searchsorted(sentence, sentence[own_high - 1], side="right"))
    doc = np.searchsorted(begins, starts[low], side="right") - 1

    def tokens(a: int, z: int) -> list[str]:
        return [bytes(text[x:y]).decode("utf-8", "surrogatepass") for x, y in zip(starts[a:z].tolist(), ends[a:z].tolist(), strict=True)]

    groups: list[list] = []
    for d, a, z, x, y in zip(doc.tolist(), low.tolist(), high.tolist(), own_low.tolist(), own_high.tolist(), strict=True):
        own = tokens(a, z)
        p = m.probabilities(own)
        if 1 - p[-1] < LEAST_LICENCE:
            continue
        while x > a and own[x - 1 - a] in m.known:
            x -= 1
        while y < z and own[y - a] in m.known:
            y += 1
        kind = int(p[:-1].argmax())
        if groups and groups[-1][0] == (d, kind) and a - groups[-1][2] <= BETWEEN:
            groups[-1][2], groups[-1][3], groups[-1][5] = max(z, groups[-1][2]), None, y
        else:
            groups.append([(d, kind), a, z, p, x, y])
    # Words around a stretch that are none of licences are scored with it but are no part of what is reported.
    for (d, _), a, z, p, x, y in groups:
        own = tokens(a, z)
        p = m.probabilities(own) if p is None else p
        judged = m.judge(own, p)
        if judged is None:
            continue
        if judged[0] == "unknown":
            # The name of a licence that is not known is none of the known words.
            x, y = a, min(z + NAME, int(np.searchsorted(sentence, sentence[z - 1], side="right")))
        at = np.searchsorted(lines, [begins[d], starts[x], ends[y - 1]])
        found[d].append((len(found[d]), int(at[1] - at[0]), int(at[2] - at[0]), *judged, raw[starts[x] : ends[y - 1]].decode("utf-8", "surrogatepass")))
    return found


def licences(docs: DataFrame) -> DataFrame:
    """A row for each licence paragraph of each document. The model, of fixed size, is trained on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size < BATCH_BYTES):
                    size += len(texts[end])
                    end += 1
                rows = [(doc, *row) for doc, found in zip(ids[at:end], scan(m, texts[at:end]), strict=True) for row in found]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
                at = end

    return id_and_text(docs).mapInPandas(run, RESULT)
