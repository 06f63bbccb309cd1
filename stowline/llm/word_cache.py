"""Whole-text tokenization with the tokenizers library, one distinct piece at a time.

The public vocabularies cut a text, before any merge is done, in front of a blank that stands alone, around a line
feed that stands alone, and between a letter and a sign that is no apostrophe. So the ids of a text are those of such
pieces in order. A worker finds the distinct pieces of a few MB of text at once, keeps the ids of those it has met
(at most ``MAX_PIECES``), and asks the library for the others. Texts with white space of another kind or in runs, or with
an added token of the vocabulary such as <|endoftext|>, go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces whose ids one Python worker keeps; beyond it the cache starts anew.
MAX_PIECES = 3_000_000
#: Text bytes taken at once.
CHUNK = 6 << 20
#: Longer pieces are not kept. A piece up to this length is told from others by all its bytes.
LONGEST = 32
_OTHER_BLANK = re.compile(r"[^\S \n]")

#: Kinds of byte: 1 letter, 2 sign that always stands apart from letters, 4 blank or line feed, 8 white space or control.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[]^_`{|}~\\']] = 2
_KIND[[32, 10]] = 4
_KIND[[*range(0, 10), *range(11, 32), 127]] = 8
#: First bytes of characters some of which are white space.
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _added(path: str) -> list[str]:
    """Strings that the vocabulary cuts out of a text before anything else."""
    return [token.content for token in _tokenizer(path).get_added_tokens_decoder().values()]


def encode_whole(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, by the library alone."""
    return [np.array(x.ids, np.uint32) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Known:
    """Sorted keys of pieces with the place of their ids."""

    def __init__(self):
        self.one, self.two = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, count, known) of each key."""
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        i = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return self.at[i], self.n[i], (self.one[i] == one) & (self.two[i] == two)

    def add(self, one: np.ndarray, two: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        parts = [np.concatenate(x) for x in ((self.one, one), (self.two, two), (self.at, at), (self.n, n))]
        order = np.argsort(parts[0], kind="stable")
        self.one, self.two, self.at, self.n = (x[order] for x in parts)


class WordCache:
    """Ids of texts by one vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.old, self.new = _Known(), _Known()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _keep(self, ids: list[np.ndarray]) -> np.ndarray:
        """Store ids; the place of each."""
        n = np.array([len(x) for x in ids], np.int64)
        total = int(n.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(total, self.used // 2), np.uint32)])
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(ids)
        at = self.used + np.cumsum(n) - n
        self.used += total
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out, at = [], 0
        while at < len(raw):
            size, end = 0, at
            while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
                size += len(raw[end])
                end += 1
            out += self._chunk(texts[at:end], raw[at:end])
            at = end
        return out

    def _chunk(self, texts: list[str], raw: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(r) for r in raw], np.int64)
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join([*raw, bytes(LONGEST)]), np.uint8)
        body = text[: len(text) - LONGEST]
        whole = self._irregular(texts, body, begins, sizes)
        for token in _added(self.path):
            whole |= np.fromiter((token in t for t in texts), bool, len(texts))
        kind = _KIND[body]
        lead = np.flatnonzero(body == 0xC3)
        lead = lead[(text[lead + 1] != 0x97) & (text[lead + 1] != 0xB7)]
        kind[lead] = 1
        kind[lead + 1] = 1
        first = np.empty(len(body), bool)
        if len(body):
            first[0] = True
            first[1:] = ((kind[1:] ^ kind[:-1]) == 3) | (kind[1:] == 4) | (body[:-1] == 10)
        first[begins[sizes > 0]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(body)))
        owner = np.searchsorted(begins, starts, side="right") - 1
        if whole.any():
            regular = ~whole[owner]
            starts, lengths, owner = starts[regular], lengths[regular], owner[regular]
        place, count = self._pieces(text, starts, lengths)
        ids = self.ids[_ranges(place, count)]
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner, count)
        ends = np.cumsum(total).tolist()
        out = [ids[e - n : e] for e, n in zip(ends, total.tolist(), strict=True)]
        if whole.any():
            some = np.flatnonzero(whole).tolist()
            for i, got in zip(some, encode_whole(self.path, [texts[i] for i in some]), strict=True):
                out[i] = got
        return out

    @staticmethod
    def _irregular(texts: list[str], body: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts have white space other than single blanks and line feeds inside."""
        whole = np.zeros(len(texts), bool)
        if not len(body):
            return whole
        full = sizes > 0
        blank = _KIND[body] == 4
        bad = _KIND[body] == 8
        bad[1:] |= blank[1:] & blank[:-1]
        bad[begins[full]] |= blank[begins[full]]
        bad[(begins + sizes - 1)[full]] |= blank[(begins + sizes - 1)[full]]
        whole[np.searchsorted(begins, np.flatnonzero(bad), side="right") - 1] = True
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(_MAY_BE_BLANK[body]), side="right") - 1).tolist():
            whole[i] = whole[i] or _OTHER_BLANK.search(texts[i]) is not None
        return whole

    def _pieces(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of the ids of each piece."""
        one = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = ~one
        words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        for k in range(0, LONGEST, 8):
            some = np.flatnonzero(lengths > k) if k else slice(None)
            left = np.minimum(lengths[some] - k, 8).astype(np.uint64)
            word = words[starts[some] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
            one[some] = _mix(one[some] ^ word)
            two[some] = _mix(two[some] * np.uint64(5) + word)
        long = np.flatnonzero(lengths > LONGEST)
        one[long] = np.uint64(0xFFFFFFFFFFFFFFFF) - starts[long].astype(np.uint64)
        two[long] = 0
        keys, sample, inverse = np.unique(one, return_index=True, return_inverse=True)
        second = two[sample]
        if len(self.old.one) + len(self.new.one) + len(keys) > MAX_PIECES:
            self._clear()
        place, count, known = self.old.find(keys, second)
        place_new, count_new, known_new = self.new.find(keys, second)
        place, count = np.where(known_new, place_new, place), np.where(known_new, count_new, count)
        lack = np.flatnonzero(~(known | known_new))
        if len(lack):
            data = text.tobytes()
            got: list[np.ndarray] = []
            where = [(a, a + n) for a, n in zip(starts[sample[lack]].tolist(), lengths[sample[lack]].tolist(), strict=True)]
            for at in range(0, len(where), 8192):
                got += encode_whole(self.path, [data[a:z].decode("utf-8", "surrogatepass") for a, z in where[at : at + 8192]])
            place[lack], count[lack] = self._keep(got), [len(x) for x in got]
            keep = lack[second[lack] != 0]
            self.new.add(keys[keep], second[keep], place[keep], count[keep])
            if len(self.new.one) * 4 > len(self.old.one):
                self.old.add(self.new.one, self.new.two, self.new.at, self.new.n)
                self.new = _Known()
        # Two pieces with one key and different second keys don't occur but for one in 2^64 pairs; they would be asked apart.
        apart = np.flatnonzero(two != second[inverse])
        place, count = place[inverse], count[inverse]
        if len(apart):
            data = text.tobytes()
            got = encode_whole(self.path, [data[starts[i] : starts[i] + lengths[i]].decode("utf-8", "surrogatepass") for i in apart.tolist()])
            place[apart], count[apart] = self._keep(got), [len(x) for x in got]
        return place, count


@lru_cache(maxsize=4)
def word_cache(path: str) -> WordCache:
    """One per worker process and vocabulary; later tasks of the worker use it again."""
    return WordCache(path)
