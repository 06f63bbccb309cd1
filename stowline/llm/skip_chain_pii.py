"""Personal data by patterns and a skip-chain conditional random field (operator 2).

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers; these base spans always stand. The random field
adds mentions that the patterns miss, such as a phone number given again without its prefix or an address with other
signs between its parts. Its nodes are the tokens with a digit or an at sign (others are clamped to *no entity*); its
labels are the kinds and *none*. Neighbouring nodes share a chain potential. Nodes that repeat one another, wholly or in
part, share a skip potential: each is linked to the last node, and to the last node in a base span, before it with one of
its keys (an address's local part, a number's digits, its last ten and its last seven, the four parts of an IP address,
the token as it stands), however far; one in a base span that is the last as well counts twice. So links grow with mentions and not with their square. A base span of several tokens gives its keys to its last one.
Nodes in base spans are observed. Loopy belief propagation carries labels along both kinds of edge, for the documents
of a batch together; nodes of a kind with enough belief become spans, neighbours of one kind one span if they can be, and a span
must be one that its kind allows (``plausible``: a card's digits pass Luhn).

Potentials are trained here by stochastic gradient descent on the pseudo-likelihood of documents that a seeded generator
writes: entities in full and repeated in other forms, among years, prices, versions, hashes, card-like numbers that fail
Luhn, and other numbers. The least belief is the one with the best F1 on held-out documents of the generator.

Defined results: null and empty texts have no spans; repeated rows get equal spans; spans are in code points, end
exclusive, by kind as listed and then start; an empty table gives no rows; other columns are ignored. A text of any
length is read whole, in time proportional to its length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
ROUNDS, DAMPING = 12, 0.3
SEED = 2
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The base patterns.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits are taken to the end of their run and a match begins at a run's first digit, as the plain pattern would have it.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")

# Words in front of an entity that speak for a kind.
CUES = {
    "email": frozenset(["email", "mail", "e-mail", "contact", "write"]),
    "ip": frozenset(["ip", "host", "server", "address", "from"]),
    "card": frozenset(["card", "visa", "credit", "mastercard", "number"]),
    "phone": frozenset(["phone", "tel", "call", "mobile", "fax"]),
}
_EDGE = " .,;:!?\"'()[]{}<>|%*#&$=+-"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start."""
    out, free = [], 0
    for m in _AT_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            free = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the signs around them."""
    out, at = [], 0
    while m := _NODE.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _BLANK.search(text, m.end())
        at = stop.start() if stop else len(text)
        token = text[start:at]
        left = len(token) - len(token.lstrip(_EDGE))
        if left < len(token):
            out.append((start + left, start + len(token.rstrip(_EDGE))))
    return out


_DIGITS = re.compile(r"[0-9]+")
_FOUR = re.compile(r"[0-9]{1,3}([.:_-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")


def keys(mention: str) -> list[str]:
    """What a mention is linked by; mentions with a common key are similar."""
    if "@" in mention:
        local = mention.split("@")[0].lower()
        return [f"@{local}"] if len(local) > 2 else []
    out = []
    if len(mention) < 20 and (four := _FOUR.fullmatch(mention)):
        out.append("." + mention.replace(four[1], "."))
    digits = "".join(_DIGITS.findall(mention))
    if len(digits) > 5 and 2 * len(digits) >= len(mention):
        out += [f"#{d}" for d in dict.fromkeys((digits, digits[-10:], digits[-7:]) if len(digits) < 16 else (digits,))]
    elif len(mention) > 5:
        out.append(mention.lower())
    return out


def plausible(kind: int, mention: str) -> bool:
    """Whether a mention can be of the kind at all."""
    if kind == 0:
        return "@" in mention.strip("@")
    runs = _DIGITS.findall(mention)
    digits = "".join(runs)
    if kind == 1:
        return len(runs) == 4 and all(len(r) < 4 and int(r) <= 255 for r in runs)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


_FEATURES = 35


def features(token: str, before: str) -> list[int]:
    digits = "".join(_DIGITS.findall(token))
    n, letters = len(digits), len(_LETTER.findall(token))
    out = [0, 1 + min(7, 0 if not n else 1 if n < 4 else 2 if n < 7 else 3 if n < 8 else 4 if n < 12 else 5 if n < 16 else 6 if n < 20 else 7)]
    flags = (
        "@" in token, "." in token, token.count(".") == 3, "-" in token, letters > 0, n > 0 and letters == 0, "/" in token, ":" in token, "_" in token or "=" in token, letters > 0 and n > 0 and "@" not in token,
        "@" in token and "." in token.split("@")[-1], token.count("-") == 1, token.count("-") > 1, len(token) > 24, 16 <= n <= 19 and luhn(digits), 16 <= n <= 19 and not luhn(digits), bool(_FOUR.fullmatch(token[:20])),
    )
    out += [9 + i for i, x in enumerate(flags) if x]
    return out + [26 + i for i, k in enumerate(KINDS) if before.strip(_EDGE).lower() in CUES[k]]


_LETTER = re.compile(r"[^\W\d_]")
TRAIN_TEXTS, HELD_TEXTS = 3000, 600


class Field:
    """Unary weights (features x labels) and symmetric chain and skip potentials (labels x labels).

    ``least`` is the least belief, ``precision`` and ``recall`` those of added nodes on held-out documents.
    """

    def __init__(self):
        rng = random.Random(SEED)
        x, y, around = [], [], []
        for _ in range(TRAIN_TEXTS):
            text, labels = _written(rng)
            places = nodes(text)
            own = [next((k for k, a, z in labels if a < e and s < z), NONE) for s, e in places]
            first = len(y)
            around += [np.zeros(2 * LABELS) for _ in places]
            for kind, i, j in _edges(text, places, base_spans(text)):
                around[first + i][kind * LABELS + own[j]] += 1
                around[first + j][kind * LABELS + own[i]] += 1
            for n, (s, e) in enumerate(places):
                row = np.zeros(_FEATURES)
                row[features(text[s:e], _before(text, s))] = 1
                x.append(row)
                y.append(own[n])
        x, y = np.hstack([np.array(x), np.array(around)]), np.array(y)
        w, some = np.zeros((x.shape[1], LABELS)), np.random.default_rng(SEED)
        for step in range(4000):
            i = some.integers(0, len(x), 256)
            logits = x[i] @ w
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(256), y[i]] -= 1
            w -= 2 / (1 + step / 1000) * (x[i].T @ p / 256 + 2e-5 * w)
        self.accuracy = float(((x @ w).argmax(axis=1) == y).mean())
        self.unary = w[:_FEATURES]
        pair = [w[_FEATURES + k * LABELS : _FEATURES + (k + 1) * LABELS] for k in range(2)]
        self.pair = np.stack([(p + p.T) / 2 for p in pair])
        held = [_written(rng) for _ in range(HELD_TEXTS)]
        best = (-1.0,)
        for least in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
            best = max(best, (*self._measured(held, least), least))
        _, self.precision, self.recall, self.least = best

    def _measured(self, held: list[tuple[str, list]], least: float) -> tuple[float, float, float]:
        """F1, precision and recall of the added spans: entities that no base span covers."""
        right = wrong = missed = 0
        for (text, labels), (base, added) in zip(held, find(self, [t for t, _ in held], least), strict=True):
            open_ = [x for x in labels if not any(a < x[2] and x[1] < z for _, a, z in base)]
            hit = [any(k == x[0] and a < x[2] and x[1] < z for k, a, z in added) for x in open_]
            right, missed = right + sum(hit), missed + len(hit) - sum(hit)
            wrong += sum(not any(k == x[0] and a < x[2] and x[1] < z for x in open_) for k, a, z in added)
        precision, recall = right / max(1, right + wrong), right / max(1, right + missed)
        return 2 * precision * recall / max(1e-9, precision + recall), precision, recall


def _card(rng: random.Random, good: bool) -> str:
    """Sixteen digits that pass Luhn, or don't."""
    head = "".join(rng.choices("0123456789", k=15))
    return next(head + c for c in rng.sample("0123456789", 10) if luhn(head + c) == good)


def _written(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated document and its entities."""
    word = lambda: "".join(rng.choices("aeiorstnlmdh", k=rng.randint(2, 8)))
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    spaced = lambda n, sign: sign.join(n[k : k + 4] for k in range(0, 16, 4))
    text, labels, junk = "", [], []

    def put(token: str, kind: int = NONE) -> None:
        nonlocal text
        if kind < NONE:
            labels.append((kind, len(text), len(text) + len(token)))
        text += token + rng.choice([" ", " ", ", ", ". ", "\n"])

    def filler() -> None:
        for _ in range(rng.randint(1, 5)):
            put(word())
        if rng.random() < 0.6:
            if junk and rng.random() < 0.2:
                return put(rng.choice(junk))
            bad = _card(rng, False)
            junk.append(rng.choice([
                number(4), "$" + number(rng.randint(1, 5)), f"{number(1)}.{number(1)}.", f"v{number(1)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", hashlib.md5(number(9).encode()).hexdigest(), number(rng.randint(5, 14)),
                number(rng.randint(20, 29)), f"{rng.randint(0, 99)}%", f"{rng.randint(0, 23)}:{number(2)}", f"{word()}{rng.randint(0, 99)}", f"{number(3)}-{number(2)}", bad, spaced(bad, " "), spaced(bad, "-"), f"{number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}",
            ]))
            put(junk[-1])

    for _ in range(rng.randint(0, 2)):
        kind = rng.randrange(4)
        area, line, card = number(3), f"{number(3)}-{number(4)}", _card(rng, True)
        local = f"{word()}.{word()}{rng.randint(0, 99)}"
        four = [str(rng.randint(0, 255)) for _ in range(4)]
        country = rng.randint(1, 98)
        full = [f"{local}@{word()}.{rng.choice(['com', 'org', 'net'])}", ".".join(four), card if rng.random() < 0.5 else spaced(card, " "), f"+{country} ({area}) {line}"][kind]
        part = [[f"{local}@{word()}"], ["-".join(four), ":".join(four), "_".join(four)], [spaced(card, "."), spaced(card, "/"), spaced(card, "_")], [f"({area}) {line}", line, f"{area}-{line}", f"{area}{line.replace('-', '')}", f"{country}-{area}-{line}"]][kind]
        filler()
        if rng.random() < 0.5:
            put(rng.choice(sorted(CUES[KINDS[kind]])))
        put(full, kind)
        for _ in range(rng.randint(0, 2)):
            filler()
            put(rng.choice(part) if rng.random() < 0.7 else full, kind)
    for _ in range(rng.randint(1, 3)):
        filler()
    return text, labels


def _before(text: str, at: int) -> str:
    return text[max(0, at - 24) : at].split(" ")[-2] if " " in text[max(0, at - 24) : at] else ""


def _edges(text: str, places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(0 chain or 1 skip, node, node)."""
    out, seen, certain = [], {}, {}
    ends = {z: text[a:z] for _, a, z in spans}
    kinds = _kinds(places, spans)
    for i, (s, e) in enumerate(places):
        if i and s - places[i - 1][1] <= 4 and not text[places[i - 1][1] : s].strip(_EDGE + "\n"):
            out.append((0, i - 1, i))
        mine = keys(text[s:e])
        if (whole := ends.get(e)) and len(whole) > e - s:
            mine += keys(whole)
        out += [(1, j, i) for held in (seen, certain) for j in dict.fromkeys(held[k] for k in mine if k in held)]
        for k in mine:
            seen[k] = i
            if kinds[i] is not None:
                certain[k] = i
    return out


@lru_cache(maxsize=1)
def field() -> Field:
    """Trained once a process, the same everywhere."""
    return Field()


def beliefs(f: Field, unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marginals of the nodes by loopy belief propagation; edges are rows (kind, i, j)."""
    if not len(edges):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    both = np.concatenate([edges, edges[:, [0, 2, 1]]])
    source, target = both[:, 1], both[:, 2]
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    potential = f.pair[both[:, 0]]
    message = np.zeros((len(both), LABELS))

    def gathered() -> np.ndarray:
        total = unary.copy()
        for k in range(LABELS):
            total[:, k] += np.bincount(target, message[:, k], minlength=len(unary))
        return total

    for _ in range(ROUNDS):
        lone = gathered()[source] - message[back]
        new = potential + lone[:, :, None]
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    total = gathered()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(f: Field, texts: list[str], least: float | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    least = f.least if least is None else least
    base, places, rows, edges, owner = [], [], [], [], []
    clamped = [[_FEATURES + k] for k in range(len(KINDS))]
    for d, text in enumerate(texts):
        if not _NODE.search(text):
            base.append([])
            continue
        spans = base_spans(text)
        base.append(spans)
        own = nodes(text)
        n = len(places)
        edges += [(k, n + i, n + j) for k, i, j in _edges(text, own, spans)]
        kinds = _kinds(own, spans)
        for (s, e), kind in zip(own, kinds, strict=True):
            rows.append(features(text[s:e], _before(text, s)) if kind is None else clamped[kind])
            places.append((s, e))
            owner.append((d, kind is not None))
    added: list[list] = [[] for _ in texts]
    if places:
        edges = np.array(edges, np.int64).reshape(-1, 3)
        weights = np.concatenate([f.unary, np.where(np.eye(LABELS)[: len(KINDS)] > 0, 0.0, -1e6)])
        size = np.array([len(r) for r in rows])
        unary = np.add.reduceat(weights[np.concatenate(rows)], np.cumsum(size) - size, axis=0)
        p = beliefs(f, unary, edges)
        near = {int(j): int(i) for k, i, j in edges if k == 0}
        kind = p.argmax(axis=1)
        for i in np.flatnonzero((kind < NONE) & (p.max(axis=1) >= least)).tolist():
            d, observed = owner[i]
            if observed:
                continue
            if added[d] and added[d][-1][0] == int(kind[i]) and near.get(i) == added[d][-1][-1]:
                added[d][-1].append(i)
            else:
                added[d].append([int(kind[i]), i])
    return [(b, sorted(x for run in a for x in _spans_of(texts[d], run[0], [places[i] for i in run[1:]]))) for d, (b, a) in enumerate(zip(base, added, strict=True))]


def _spans_of(text: str, kind: int, run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """A run of neighbours of one kind as one span, or, if that is none, those that are one alone."""
    whole = (run[0][0], run[-1][1])
    return [(kind, s, e) for s, e in ([whole] if plausible(kind, text[slice(*whole)]) else run) if plausible(kind, text[s:e])]


def _kinds(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int | None]:
    """The first kind with a base span over each node; spans of one kind are in order and apart."""
    out: list[int | None] = [None] * len(places)
    for kind in range(len(KINDS)):
        own, at = [s for s in spans if s[0] == kind], 0
        for i, (s, e) in enumerate(places):
            while at < len(own) and own[at][2] <= s:
                at += 1
            if out[i] is None and at < len(own) and own[at][1] < e:
                out[i] = kind
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def _shared_field(docs: DataFrame):
    """The field, of fixed size, trained on the driver."""
    return docs.sparkSession.sparkContext.broadcast(field())


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, of each document."""
    shared = _shared_field(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, (base, added) in zip(batch["doc_id"].tolist(), find(shared.value, batch["text"].tolist()), strict=True):
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((doc, *counts, hashlib.sha256(named(base).encode()).hexdigest(), named(sorted(base + added))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return id_and_text(docs).mapInPandas(run, RESULT)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, given as its first kind in brackets."""
    out, at = [], 0
    for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with spans masked in text, and n_chars, where there is one, as the new length; null texts stay null."""
    shared = _shared_field(docs)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t or "" for t in texts.tolist()]
            masked = [mask(t, base + added) for t, (base, added) in zip(known, find(shared.value, known), strict=True)]
            yield pd.Series([None if old is None else new for old, new in zip(texts.tolist(), masked, strict=True)], dtype=object)

    masked = docs.withColumn("text", F.pandas_udf(run, "string")("text"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
