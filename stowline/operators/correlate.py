"""Correlation of events that share a reusable request number.

A pass over each session pairs requests, queued moves, spawns and completions, and emits moves and patches to
them; what patches say is then merged by joins and aggregates, which also settle what a disconnect voided. The state is
what the pairing windows can still reach: entries leave it, in the order of their times, when no later event can pair
with them. Requests that no queued line has answered stay until their numbers begin anew.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import HOLDING_KINDS
from .folds import fold

# Pairing windows in seconds.
COMPLETION_S, SPAWN_S, NAME_S, ARRIVAL_S, ASSET_S = 120, 60, 30, 10, 300
_COMPLETION, _SPAWN = COMPLETION_S * 1_000_000, SPAWN_S * 1_000_000

PAIRED = (
    "session_id long, line_offset long, item_ix int, patch string, at_offset long, request_no long, ts timestamp, player string, player_id string, move_type string, item_class string, "
    "item_geid string, amount int, src_raw string, src_kind string, src_key string, tgt_raw string, tgt_kind string, tgt_key string, caller string, action string, result string"
)
#: Rows that are no moves: what a patch says of one, a disconnect, and that a session has no more lines.
GEID, RESULT, CLOSED, FINISHED = "geid", "result", "closed", "finished"
_NAMES = [c.strip().split()[0] for c in PAIRED.split(",")]
_AT = {n: i for i, n in enumerate(_NAMES)}
_REAL = frozenset(HOLDING_KINDS)

PAIRING_KINDS = ["MoveRequested", "MoveBatchRequested", "ItemMoved", "EntitySpawned", "MoveCompleted", "ItemStored", "ChannelDisconnected", "LocationChanged"]


def pairing_rows(events: DataFrame) -> DataFrame:
    """What the pass reads of the events, in plain columns; times in microseconds, number 0 where a kind has none (pandas would make all of them floats)."""
    end = lambda side: [F.col(f"{side}.{x}").alias(f"{short}_{x}") for short in [{"source": "src", "target": "tgt"}[side]] for x in ("kind", "key", "raw", "sub_id")]
    place = F.when(F.col("location_id") != "0", F.col("location_id")).when(F.col("landing_id") != "0", F.col("landing_id"))
    return events.where(F.col("event_kind").isin(*PAIRING_KINDS)).select(
        "session_id", "line_offset", "ts", F.unix_micros("ts").alias("us"), "event_kind", F.coalesce("request_no", F.lit(0)).alias("request_no"), "move_type", "player", "player_id", "item_class", "item_geid", "amount", *end("source"), *end("target"), "caller", "action", "classes", "result", place.alias("place"),
    )


class Pairing:
    """One session's open requests."""

    def __init__(self):
        self.generation, self.last, self.here, self.now = 0, None, None, None
        self.issued: set[int] = set()
        self.callers: dict[int, tuple] = {}
        self.moves: dict[int, list[dict]] = {}
        self.spawns: dict[int, list[tuple]] = {}
        #: (time, number) of moves and of spawns, as they came.
        self.move_queue: deque = deque()
        self.spawn_queue: deque = deque()

    def _forget(self) -> None:
        self.generation += 1
        self.callers.clear()
        self.spawns.clear()
        self.spawn_queue.clear()
        self.issued.clear()

    def _observe(self, number: int) -> None:
        if self.last is not None and number < self.last:
            self._forget()
        self.last = number

    def _target(self, e, caller: str | None, action: str | None) -> tuple | None:
        """(raw, kind, key) of the target that the move has, or None where it moved nothing."""
        if e.tgt_kind == "Invalid" and (caller and "AttachItem" in caller or action == "Carry"):
            return "EQUIPPED", "Equipped", ""
        return None if e.tgt_kind not in _REAL or e.src_kind in _REAL and e.src_raw == e.tgt_raw else (e.tgt_raw, e.tgt_kind, e.tgt_key)

    def _record(self, e, target: tuple, name: str, geid: str | None, amount: int, caller: str | None, ix: int = 0) -> tuple:
        number = int(e.request_no)
        if geid is None:
            waiting = self.spawns.get(number, ())
            found = next((s for s in waiting if s[3] == self.generation and s[1] == name and abs(e.us - s[2]) <= _SPAWN), None)
            if found:
                waiting.remove(found)
                geid = found[0]
        if ix == 0:
            self.moves.pop(number, None)
        self.moves.setdefault(number, []).append({"offset": e.line_offset, "ix": ix, "us": e.us, "class": name, "generation": self.generation, "named": geid is not None, "late": False})
        self.move_queue.append((e.us, number))
        return (e.session_id, e.line_offset, ix, "move", e.line_offset, number, e.ts, e.player or "", e.player_id or "", e.move_type, name, geid, amount, e.src_raw, e.src_kind, e.src_key, *target, caller, e.action, None)

    def _patch(self, e, m: dict, **values) -> tuple:
        row = [None] * len(_NAMES)
        row[0], row[1], row[2], row[4] = e.session_id, m["offset"], m["ix"], e.line_offset
        for name, value in values.items():
            row[_AT[name]] = value
        return tuple(row)

    def step(self, e) -> list[tuple]:
        if self.now is not None and e.us < self.now:
            # The clock went back: the order of times is no longer the order of lines.
            self._sweep(self.now)
            out = getattr(self, "_" + e.event_kind)(e)
            self._sweep(e.us)
        else:
            out = getattr(self, "_" + e.event_kind)(e)
            self._expire(e.us)
        self.now = e.us
        return out

    def end(self) -> list[tuple]:
        return []

    def _MoveRequested(self, e) -> list[tuple]:
        number = int(e.request_no)
        self._observe(number)
        self.moves.pop(number, None)
        if e.move_type == "Drop":
            at = e.src_sub_id if e.src_kind == "Location" else self.here
            return [self._record(e, ("WORLD", "World", at or ""), e.item_class, None, 1, e.caller)]
        self.issued.add(number)
        self.callers[number] = (e.caller, e.us, self.generation)
        return []

    def _MoveBatchRequested(self, e) -> list[tuple]:
        self._observe(int(e.request_no))
        self.moves.pop(int(e.request_no), None)
        target = self._target(e, e.caller, None)
        return [self._record(e, target, name, None, 1, e.caller, i) for i, name in enumerate(e.classes)] if target else []

    def _ItemMoved(self, e) -> list[tuple]:
        number = int(e.request_no)
        if number in self.issued:
            self.issued.discard(number)
        else:
            self._observe(number)
        caller, at, generation = self.callers.pop(number, (None, e.us, -1))
        if generation != self.generation or abs(e.us - at) > _COMPLETION:
            caller = None
        target = self._target(e, caller, e.action)
        return [self._record(e, target, e.item_class, e.item_geid, int(e.amount), caller)] if target else []

    def _EntitySpawned(self, e) -> list[tuple]:
        number = int(e.request_no)
        for m in self.moves.get(number, ()):
            if not m["named"] and m["generation"] == self.generation and m["class"] == e.item_class and abs(e.us - m["us"]) <= _SPAWN:
                m["named"] = True
                return [self._patch(e, m, patch=GEID, item_geid=e.item_geid)]
        self.spawns.setdefault(number, []).append((e.item_geid, e.item_class, e.us, self.generation))
        self.spawn_queue.append((e.us, number))
        return []

    def _MoveCompleted(self, e) -> list[tuple]:
        out = []
        for m in self.moves.get(int(e.request_no), ()):
            gap = e.us - m["us"]
            if e.line_offset > m["offset"] and (m["generation"] == self.generation and abs(gap) <= _COMPLETION or m["late"] and 0 <= gap <= _COMPLETION):
                out.append(self._patch(e, m, patch=RESULT, result=e.result))
        return out

    def _ItemStored(self, e) -> list[tuple]:
        return [(e.session_id, e.line_offset, 0, "move", e.line_offset, 0, e.ts, "", "", "StoreItem", e.item_class, e.item_geid, 1, "", "Invalid", "", e.tgt_raw, e.tgt_kind, e.tgt_key, None, None, None)]

    def _ChannelDisconnected(self, e) -> list[tuple]:
        self._forget()
        self.last = None
        for m in (m for held in self.moves.values() for m in held):
            if 0 <= e.us - m["us"] <= _COMPLETION:
                m["late"] = True
        return [self._patch(e, {"offset": e.line_offset, "ix": -1}, patch=CLOSED, ts=e.ts)]

    def _LocationChanged(self, e) -> list[tuple]:
        self.here = e.place or self.here
        return []

    def _expire(self, us: int) -> None:
        """What is too old for any later event goes, the oldest first."""
        for queue, held, at, window in ((self.move_queue, self.moves, lambda m: m["us"], _COMPLETION), (self.spawn_queue, self.spawns, lambda s: s[2], _SPAWN)):
            while queue and us - queue[0][0] > window:
                _, number = queue.popleft()
                if (some := held.get(number)) is not None and (left := [x for x in some if us - at(x) <= window]) != some:
                    if left:
                        held[number] = left
                    else:
                        del held[number]
        if len(self.callers) > 64 and us - next(iter(self.callers.values()))[1] > _COMPLETION:
            self.callers = {k: c for k, c in self.callers.items() if us - c[1] <= _COMPLETION}

    def _sweep(self, us: int) -> None:
        """All that is too far from a time, on either side, goes."""
        self.callers = {k: c for k, c in self.callers.items() if abs(us - c[1]) <= _COMPLETION}
        for held, at, window in ((self.moves, lambda m: m["us"], _COMPLETION), (self.spawns, lambda s: s[2], _SPAWN)):
            for number in list(held):
                held[number] = [x for x in held[number] if abs(us - at(x)) <= window]
                if not held[number]:
                    del held[number]
        self.move_queue = deque(sorted((m["us"], k) for k, held in self.moves.items() for m in held))
        self.spawn_queue = deque(sorted((s[2], k) for k, held in self.spawns.items() for s in held))


def with_location(events: DataFrame) -> DataFrame:
    """Events with ``here``, the location the player was last at, and ``here_since``, within the session."""
    to = F.when(F.col("location_id") != "0", F.col("location_id")).when(F.col("landing_id") != "0", F.col("landing_id"))
    place = F.when(to.isNotNull(), F.struct(to.alias("id"), F.col("ts").alias("since")))
    w = Window.partitionBy("session_id").orderBy("line_offset")
    return events.withColumn("_at", F.last(place, ignorenulls=True).over(w)).withColumns({"here": F.col("_at.id"), "here_since": F.col("_at.since")}).drop("_at")


def paired(events: DataFrame) -> DataFrame:
    """Moves, patches to them and disconnects, as the pass over each session emits them."""
    return fold(pairing_rows(events), ["session_id"], ["line_offset"], Pairing, PAIRED)


def finished_rows(finished: DataFrame) -> DataFrame:
    """The rows of the pass that say that sessions (session_id) have no more lines; they stand behind all others."""
    return finished.select("session_id", F.lit(2**63 - 1).alias("line_offset"), F.lit(-1).alias("item_ix"), F.lit(FINISHED).alias("patch")).distinct()


def settle(rows: DataFrame) -> DataFrame:
    """Moves with what the other rows of the pass say of them.

    The last completion of a move counts. Without one, it was lost if a later disconnect's time is not before its own, or
    if its session has no more lines. One shuffle by session: patches meet their move in an aggregate, and what comes
    later is the running maximum of the disconnects' times, from the last line back.
    """
    key = ["session_id", "line_offset", "item_ix"]
    values = [c for c in _NAMES if c not in (*key, "patch", "at_offset", "result")]
    of = lambda patch, value: F.when(F.col("patch") == patch, value)
    one = rows.repartition("session_id").groupBy(*key).agg(
        F.max_by(F.struct(*values), of("move", F.lit(1))).alias("m"), F.max_by("item_geid", of(GEID, F.col("at_offset"))).alias("_geid"), F.max_by("result", of(RESULT, F.col("at_offset"))).alias("_result"),
        F.max(of(CLOSED, F.col("ts"))).alias("_closed"), F.max(of(FINISHED, F.lit(True))).alias("_finished"),
    )
    later = Window.partitionBy("session_id").orderBy(F.desc("line_offset"), F.desc("item_ix")).rowsBetween(Window.unboundedPreceding, -1)
    out = one.withColumn("_end", F.max("_finished").over(later)).withColumn("_after", F.max("_closed").over(later)).where("m IS NOT NULL").select(*key, "m.*", "_geid", "_result", "_end", "_after")
    gone = F.coalesce("_end", F.col("_after") >= F.col("ts"), F.lit(False)) & (F.col("request_no") > 0) & (F.col("move_type") != "StoreItem")
    result = F.coalesce("_result", F.when(gone, "lost"))
    return out.select(*key, "request_no", "ts", "player", "player_id", "move_type", "item_class", F.coalesce("item_geid", "_geid").alias("item_geid"), "amount", "src_raw", "src_kind", "src_key", "tgt_raw", "tgt_kind", "tgt_key", "caller", "action", result.alias("result"))


def moves(events: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """Settled moves of events; finished has the sessions (session_id) that have no more lines."""
    rows = paired(events)
    return settle(rows if finished is None else rows.unionByName(finished_rows(finished), allowMissingColumns=True))
