"""What is where: the running account of moves, sightings, body listings and resets.

Positions depend on order and neither commute nor associate, so each account's timeline streams, sorted, through a
state that holds what the account holds now. Everything that does not need the order (timeline, chains, scores, names,
checks against updates) is a join or an aggregate around it.

A place is (kind, key). A slot, for a place and a class, has named entities, newest last, and unnamed units in groups of
one provenance, with the date and manner of the newest arrival over all of them. Slots that become empty stay: that
a class was once there tells two kinds of miss apart. Places are searched in the order in which they were first
used, carried containers by geid.

Only unnamed units, the body and containers tie entities to each other. Where a large account's epoch has none of them, its
entries come entity by entity, and the state is one entity's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_apparel, is_body_port, is_character_port, is_part_port
from .folds import fold

REAL = frozenset(["Location", "Container", "Equipped", "World"])
BODY, LOST = ("Equipped", ""), ("LostTrack", "")
#: Containers within containers that are followed; seconds that a body listing takes.
DEPTH, LISTING_S = 6, 30
#: Entries of an account from which on its resets are broadcast; of n entries in all, at most n / MANY accounts are so large.
MANY = 200_000
#: How an epoch whose entities stand apart ends.
WIPED, OPEN = "wiped", "open"

ROWS = (
    "account string, row_kind string, geid string, item_class string, quantity int, kind string, key string, since timestamp, arrived_by string, confirmed boolean, inferred boolean, "
    "duplicate_risk boolean, ambiguous boolean, carried boolean, part_parent boolean, at timestamp, source_kind string, source_key string, same_place boolean, detail string, elsewhere string"
)
_NAMES = [c.strip().split()[0] for c in ROWS.split(",")]
#: What the pass itself gives; part parents are told by the entries.
KINDS = frozenset(["holding", "miss", "check", "reset", "stat"])
#: What the pass looks at; the other columns are for the order.
_READS = ["account", "entry", "ts", "move_type", "item_class", "item_geid", "amount", "src_kind", "src_key", "tgt_kind", "tgt_key", "action", "result", "port", "is_part", "body_port", "parent_geid", "geids", "classes", "build", "apart"]


class Slot:
    __slots__ = ("named", "groups", "since", "by")

    def __init__(self):
        self.named: list[dict] = []
        self.groups: list[dict] = []
        self.since, self.by = None, None

    def units(self) -> int:
        return len(self.named) + sum(g["n"] for g in self.groups)

    def add(self, group: dict) -> None:
        """Units of one provenance are one group, dated by the newer of the two."""
        for i, g in enumerate(self.groups):
            if all(g[k] == group[k] for k in ("confirmed", "inferred", "risk")):
                self.groups[i] = (g if g["since"] > group["since"] else group) | {"n": g["n"] + group["n"]}
                return
        self.groups.append(group)

    def take(self, inferred_only: bool = False) -> bool:
        """One unit of the newest group, the later listed of equals."""
        pick = max((i for i, g in enumerate(self.groups) if g["inferred"] or not inferred_only), key=lambda i: (self.groups[i]["since"], i), default=None)
        if pick is None:
            return False
        if self.groups[pick]["n"] > 1:
            self.groups[pick] = self.groups[pick] | {"n": self.groups[pick]["n"] - 1}
        else:
            del self.groups[pick]
        return True


class Account:
    """One account's state, which gives rows of the kinds that are wanted."""

    kinds = KINDS
    #: Units that were let go before the reset that takes them.
    left = 0

    def __init__(self, kinds: frozenset[str] = KINDS):
        if kinds != KINDS:
            self.kinds = kinds
        self.places: dict[tuple, dict[str, Slot]] = {}
        #: The places that have, or once had, a class.
        self.places_of: dict[str, dict[tuple, None]] = {}
        self.at: dict[str, tuple] = {}
        self.carried: set[str] = set()
        self.settled: set[str] = set()
        self.parents: set[str] = set()
        self.port_of: dict[str, str] = {}
        self.occupant: dict[str, str] = {}
        self.out: dict[tuple, int] = {}
        self.into: dict[tuple, int] = {}
        self.wearable: set[str] = set()
        self.stats: dict[str, int] = {}
        self.account = None

    def step(self, e) -> list[tuple]:
        self.account = e.account
        return getattr(self, f"_{e.entry}")(e) or []

    def end(self) -> list[tuple]:
        return self._holdings() + [self._row("stat", detail=k, quantity=n) for k, n in sorted(self.stats.items()) if "stat" in self.kinds]

    def leave(self, wiped: bool) -> list[tuple]:
        """Let go of all that is held, of which no later entry speaks; what a reset will take is only counted."""
        rows = [] if wiped else self._holdings()
        if wiped:
            self.left += self._units()
        self._clear()
        return rows

    def _holdings(self) -> list[tuple]:
        rows = []
        for (kind, key), classes in self.places.items() if "holding" in self.kinds else ():
            for name, slot in classes.items():
                for i in slot.named:
                    rows.append(self._row("holding", geid=i["geid"], item_class=name, quantity=1, kind=kind, key=key, since=i["since"], arrived_by=i["by"], confirmed=i["confirmed"], inferred=i["inferred"], duplicate_risk=False, ambiguous=i["ambiguous"], carried=i["geid"] in self.carried, part_parent=i["geid"] in self.parents))
                for g in slot.groups:
                    rows.append(self._row("holding", item_class=name, quantity=g["n"], kind=kind, key=key, since=g["since"], arrived_by=g["by"], confirmed=g["confirmed"], inferred=g["inferred"], duplicate_risk=g["risk"], ambiguous=False, carried=False, part_parent=False))
        return rows

    def _units(self) -> int:
        return sum(s.units() for c in self.places.values() for s in c.values())

    def _clear(self) -> None:
        for held in (self.places, self.places_of, self.at, self.carried, self.settled, self.port_of, self.occupant, self.out, self.into):
            held.clear()

    def _row(self, row_kind: str, **values) -> tuple:
        values |= {"account": self.account, "row_kind": row_kind}
        return tuple(values.get(n) for n in _NAMES)

    def _count(self, name: str, n: int = 1) -> None:
        if n:
            self.stats[name] = self.stats.get(name, 0) + n

    def _slot(self, place: tuple, name: str, create: bool = False) -> Slot | None:
        if create:
            self.places_of.setdefault(name, {})[place] = None
            return self.places.setdefault(place, {}).setdefault(name, Slot())
        return self.places.get(place, {}).get(name)

    def _stack(self, place: tuple, name: str, n: int, e, by: str, confirmed: bool, inferred: bool = False, risk: bool = False) -> None:
        if n > 0:
            slot = self._slot(place, name, True)
            slot.since, slot.by = e.ts, by
            slot.add({"n": n, "since": e.ts, "by": by, "confirmed": confirmed, "inferred": inferred, "risk": risk})

    def _remove(self, geid: str) -> dict | None:
        """Take an entity out of wherever it is, whatever class it has there."""
        for slot in self.places.get(self.at.get(geid), {}).values():
            for i in slot.named:
                if i["geid"] == geid:
                    slot.named.remove(i)
                    return i
        return None

    def _place(self, geid: str, name: str, place: tuple, e, by: str, confirmed: bool, inferred: bool = False, ambiguous: bool = False, source: tuple | None = None) -> None:
        known = geid in self.at
        if known:
            self._remove(geid)
        # An unnamed unit was this entity, if it may have been one: once, and later only a guessed one.
        spend = [] if known else [(source, False)] if source and source[0] in REAL and self._has_loose(source, name) else [(place, False)]
        for where, only in [*spend, (place, True)]:
            if (geid not in self.settled or not only) and (slot := self._slot(where, name)) and slot.take(only):
                self.settled.add(geid)
                self._count("reconciled")
        self._slot(place, name, True).named.append({"geid": geid, "since": e.ts, "by": by, "confirmed": confirmed, "inferred": inferred, "ambiguous": ambiguous})
        self.at[geid] = place

    def _has_loose(self, place: tuple, name: str) -> bool:
        slot = self._slot(place, name)
        return bool(slot and slot.groups)

    def _lose(self, geid: str, name: str) -> None:
        """No longer where it was, and no line says where it went."""
        i = self._remove(geid)
        self._slot(LOST, name, True).named.append(i)
        self.at[geid] = LOST
        self._count("evicted")

    def _note(self, geid: str, by: str) -> None:
        (self.carried.add if by == "Carry" else self.carried.discard)(geid)

    # Moves.

    def _move(self, e) -> list[tuple] | None:
        result = (e.result or "").lower()
        source, target = (e.src_kind, e.src_key), (e.tgt_kind, e.tgt_key)
        if result == "lost":
            self._count("lost")
            return self._lost(e, source, target)
        if result in ("succeed", "failed"):
            self.out.clear()
            self.into.clear()
        if result == "failed" or target[0] not in REAL:
            return self._count("failed" if result == "failed" else "unreal_target")
        by, good = e.action if e.action == "Carry" else e.move_type, result == "succeed"
        if e.item_geid is None:
            return self._anonymous(e, source, target, by, good)
        self._count("named_moves")
        self._note(e.item_geid, by)
        rows = self._check(e, source)
        self._place(e.item_geid, e.item_class, target, e, by, good, source=source)
        return rows

    def _lost(self, e, source: tuple, target: tuple) -> None:
        """The move did not happen, but what it meant to take was at its source."""
        if source[0] not in REAL:
            return
        if e.item_geid is not None:
            if e.item_geid not in self.at:
                self._place(e.item_geid, e.item_class, source, e, e.move_type, True, True)
                self._count("credited_by_lost")
            return
        n, key = max(1, int(e.amount)), (source, e.item_class)
        slot = self._slot(*key)
        short = self.out.get(key, 0) + n - self.into.get(key, 0) - (slot.units() if slot else 0)
        if short > 0:
            self._stack(source, e.item_class, short, e, e.move_type, True, True)
            self._count("credited_by_lost", short)
        self.out[key] = self.out.get(key, 0) + n
        if target[0] in REAL:
            self.into[target, e.item_class] = self.into.get((target, e.item_class), 0) + n

    def _anonymous(self, e, source: tuple, target: tuple, by: str, good: bool) -> list[tuple]:
        if source[0] not in REAL and e.move_type == "Store":
            source = BODY
        wanted, rows = max(1, int(e.amount)), []
        self._count("class_moves")
        self._count("class_units", wanted)
        real = source[0] in REAL
        if real and self._slot(source, e.item_class) is None:
            self._count("source_unknown")
        taken = self._draw(e, source, target, wanted, by, good, "", None) if real else 0
        own = taken
        if real and taken < wanted:
            for carrier in self._carriers(e.item_class):
                if carrier not in (source, target):
                    taken += self._draw(e, carrier, target, wanted - taken, by, good, "from_carried", True)
            taken += self._draw(e, LOST, target, wanted - taken, by, good, "from_lost_track", True, loose=False)
        if taken < wanted or taken > own:
            classes = self.places.get(source)
            cause = "NoSource" if not real else "SourceNeverSeen" if classes is None else "ClassNeverAtSource" if e.item_class not in classes else "AlreadyTaken"
            elsewhere = next((p for p in self.places_of.get(e.item_class, ()) if p not in (source, target) and self._slot(p, e.item_class).units()), None)
            covered = taken >= wanted
            if "miss" in self.kinds:
                rows.append(self._row("miss", item_class=e.item_class, quantity=wanted - (own if covered else taken), kind=target[0], key=target[1], at=e.ts, source_kind=source[0], source_key=source[1], duplicate_risk=elsewhere is not None, carried=covered, detail=cause, elsewhere=elsewhere and elsewhere[0]))
            if not covered:
                self._count("inferred", wanted - taken)
                self._count("duplicate_risk" if elsewhere else "first_seen", wanted - taken)
                self._stack(target, e.item_class, wanted - taken, e, by, good, True, elsewhere is not None)
        return rows

    def _draw(self, e, place: tuple, target: tuple, wanted: int, by: str, good: bool, stat: str, ambiguous: bool | None, loose: bool = True) -> int:
        """Take up to ``wanted`` units of the class from a place to the target: named ones first, the newest first."""
        slot, taken = self._slot(place, e.item_class), 0
        if slot is None:
            return 0
        several = len(slot.named) > 1
        while taken < wanted and slot.named:
            pick = slot.named.pop()
            self._note(pick["geid"], by)
            self._place(pick["geid"], e.item_class, target, e, by, good, ambiguous=ambiguous if ambiguous is not None else several or pick["ambiguous"])
            taken += 1
        named = taken
        while loose and taken < wanted and slot.take():
            self._stack(target, e.item_class, 1, e, by, good)
            taken += 1
        # Of what a move's own source gave, named and unnamed units are told apart.
        self._count(stat or "from_loose", taken if stat else taken - named)
        self._count("from_named", 0 if stat else named)
        return taken

    def _carriers(self, name: str) -> list[tuple]:
        """The body and what is worn on it, as far as they have had the class."""
        have = self.places_of.get(name, {})
        return [BODY, *sorted(p for p in have if p[0] == "Container" and p[1] in self.wearable and self._worn_along(p[1]))]

    def _worn_along(self, geid: str) -> bool:
        seen = set()
        while (at := self.at.get(geid)) is not None:
            if at[0] == "Equipped":
                return True
            if at[0] != "Container" or at[1] not in self.wearable or at[1] in seen:
                return False
            seen.add(at[1])
            geid = at[1]
        return True

    def _check(self, e, source: tuple) -> list[tuple]:
        """Where the entity was believed to be, held against where a move says it came from."""
        if "check" not in self.kinds:
            return []
        believed = self.at.get(e.item_geid)
        slot = self._slot(believed, e.item_class) if believed else None
        known = next((i for i in slot.named if i["geid"] == e.item_geid), None) if slot else None
        if source[0] not in REAL or known is None or believed == LOST:
            return []
        return [self._row("check", geid=e.item_geid, item_class=e.item_class, kind=believed[0], key=believed[1], since=known["since"], arrived_by=known["by"], at=e.ts, source_kind=source[0], source_key=source[1], same_place=self._outer(believed) == self._outer(source))]

    def _outer(self, place: tuple) -> tuple:
        for _ in range(DEPTH):
            if place[0] != "Container" or place[1] not in self.at:
                break
            place = self.at[place[1]]
        return place

    # What the body shows.

    def _wearable(self, e) -> None:
        self.wearable.add(e.item_geid)

    def _parent(self, e) -> None:
        self.parents.add(e.item_geid)

    def _worn(self, e) -> None:
        self._count("sightings")
        if self.at.get(e.item_geid) == LOST:
            self._count("seen_again")
        if e.port and not e.is_part and e.body_port:
            old = self.occupant.get(e.port)
            if old not in (None, e.item_geid) and self.port_of.get(old) == e.port and self.at.get(old) == BODY:
                name, since = next((n, i["since"]) for n, s in self.places[BODY].items() for i in s.named if i["geid"] == old)
                if since <= e.ts:
                    self._lose(old, name)
                    self.carried.discard(old)
            self.occupant[e.port], self.port_of[e.item_geid] = e.item_geid, e.port
        place = BODY
        if e.is_part and e.parent_geid:
            place = ("Container", e.parent_geid)
            self.parents.add(e.parent_geid)
        self._place(e.item_geid, e.item_class, place, e, "Worn", True)

    def _body(self, e) -> None:
        geids, names = set(e.geids), set(e.classes)
        for parent in self.parents & geids:
            for name, slot in list(self.places.get(("Container", parent), {}).items()):
                for i in [i for i in slot.named if i["since"] < e.ts and i["geid"] not in geids]:
                    self._lose(i["geid"], name)
        for name, slot in list(self.places.get(BODY, {}).items()):
            for i in [i for i in slot.named if i["since"] < e.ts and i["geid"] not in geids]:
                if i["geid"] in self.carried:
                    # Eaten, drunk or handed in.
                    self.carried.discard(i["geid"])
                    slot.named.remove(i)
                    del self.at[i["geid"]]
                    self._count("used_up")
                else:
                    self._lose(i["geid"], name)
            if slot.groups and slot.since < e.ts and name not in names:
                n = sum(g["n"] for g in slot.groups)
                if slot.by != "Carry":
                    lost = self._slot(LOST, name, True)
                    if not lost.groups or slot.since > lost.since:
                        lost.since, lost.by = slot.since, slot.by
                    for g in slot.groups:
                        lost.add(g)
                slot.groups = []
                self._count("used_up" if slot.by == "Carry" else "evicted", n)

    def _reset(self, e) -> list[tuple]:
        n, self.left = self.left + self._units(), 0
        self._clear()
        self._count("wiped", n)
        return [self._row("reset", at=e.ts, quantity=n, detail=str(int(e.build)))] if "reset" in self.kinds else []


class Epoch:
    """An account between two resets. Entities that stand apart come one after another; of each only its own state is held."""

    def __init__(self, kinds: frozenset[str] = KINDS):
        self.account, self.geid = Account(kinds), None

    def step(self, e) -> list[tuple]:
        if e.apart is None or e.item_geid == self.geid:
            return self.account.step(e)
        rows = [] if self.geid is None else self.account.leave(e.apart == WIPED)
        self.geid = e.item_geid
        return rows + self.account.step(e)

    def end(self) -> list[tuple]:
        return self.account.end()


def listings(seen: DataFrame) -> DataFrame:
    """A body listing for each sighting of the body: what its session shows from there on, for half a minute.

    One pass of a window over the log's order, which a session's lines have anyway, instead of a join on time.
    """
    from pyspark.sql import Window

    s = seen.where("NOT placeholder").withColumn("us", F.unix_micros("ts"))
    after = Window.partitionBy("account", "session_id").orderBy("us").rangeBetween(0, LISTING_S * 1_000_000)
    listed = F.collect_list(F.struct("line_offset", "geid", "class_name")).over(after)
    b = s.withColumn("l", listed).where("port = 'Body_ItemPort'")
    later = F.filter("l", lambda x: x["line_offset"] >= F.col("line_offset"))
    return b.select("account", "session_id", "line_offset", "ts", F.array_distinct(F.transform(later, lambda x: x["geid"])).alias("geids"), F.array_distinct(F.transform(later, lambda x: x["class_name"])).alias("classes"))


_TIMELINE = ["account", "entry", "ts", "rank", "seq", "sub", "move_type", "item_class", "item_geid", "amount", "src_kind", "src_key", "tgt_kind", "tgt_key", "action", "result", "port", "is_part", "body_port", "parent_geid", "geids", "classes", "build"]


def timeline(moves: DataFrame, seen: DataFrame, resets: DataFrame, containers: DataFrame) -> DataFrame:
    """All entries of all accounts. At one instant resets come first, then moves, sightings, listings.

    moves and seen have an account and seq (order of ingestion); resets (account, ts, build); containers (account, geid,
    class_name).
    """
    types = {"account": "string", "entry": "string", "ts": "timestamp", "rank": "int", "seq": "long", "sub": "int", "amount": "int", "is_part": "boolean", "body_port": "boolean", "geids": "array<string>", "classes": "array<string>", "build": "int"}

    def entry(df: DataFrame, name: str, rank: int, **columns) -> DataFrame:
        have = {c: F.col(c) for c in df.columns} | columns | {"entry": F.lit(name), "rank": F.lit(rank)}
        return df.select(*[have.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _TIMELINE])

    wear = containers.where(is_apparel("class_name")).select("account", "geid").unionByName(seen.where("NOT placeholder").select("account", "geid")).distinct()
    worn = seen.where("NOT placeholder").where(~is_character_port("port"))
    return (
        entry(wear, "wearable", 0, ts=F.lit(0).cast("timestamp"), seq=F.lit(0), item_geid=F.col("geid"))
        .unionByName(entry(resets, "reset", 1, seq=F.lit(0)))
        .unionByName(entry(moves, "move", 2, sub=F.col("item_ix")))
        .unionByName(entry(worn, "worn", 3, item_geid=F.col("geid"), item_class=F.col("class_name"), is_part=is_part_port("port"), body_port=is_body_port("port")))
        .unionByName(entry(listings(seen), "body", 4, seq=F.col("line_offset")))
    )


def stands_apart(kinds: frozenset[str]) -> Column:
    """Whether an entry speaks of one named entity alone, or is a reset. A check follows containers, which are entities too."""
    in_box = F.coalesce(F.col("src_kind") == "Container", F.lit(False)) | F.coalesce(F.col("tgt_kind") == "Container", F.lit(False))
    alone = (F.col("entry") == "move") & F.col("item_geid").isNotNull()
    return (F.col("entry") == "reset") | (alone & ~in_box if "check" in kinds else alone)


def epochs(entries: DataFrame, many: int = MANY, apart: Column | None = None) -> DataFrame:
    """Entries with ``epoch``, the number of the account's resets before them, and what each epoch must know of those before.

    A reset empties all places, so that an account falls into stretches that share nothing but two sets: what can be worn,
    and what has been the parent of parts. Of these an epoch gets what its own entries speak of. A reset closes its epoch. Resets
    of an account are as few as the game's updates: their times are one array, no order of entries is needed. Accounts of many
    entries get it by broadcast, so that no task reads an account whole before it is dealt out by epochs.

    With ``apart``, what an entry must be so that entities share nothing (``stands_apart``), the entries have a column of that name: of
    accounts of many entries, in the epochs whose entries all are so, it says how the epoch ends.
    """
    worn = F.coalesce((F.col("entry") == "worn") & F.col("is_part") & F.col("parent_geid").isNotNull(), F.lit(False))
    accounts = entries.groupBy("account").agg(F.collect_list(F.when(F.col("entry") == "reset", F.col("ts"))).alias("wiped"), F.count_if(F.col("entry") != "wearable").alias("n"), F.bool_or((F.col("entry") == "wearable") | worn).alias("marked"))
    hot, rest = accounts.where(F.col("n") > many).drop("n"), accounts.where((F.col("n") <= many) & (F.size("wiped") > 0)).drop("n")
    # Those of its own instant included unless it is one. Counted, as sorting them for each entry takes several times as long.
    up_to = F.when(F.col("entry") == "reset", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.col("ts"))
    before = F.coalesce(F.array_size(F.filter("wiped", lambda x: x <= F.col("up_to"))).cast("long"), F.lit(0))
    told, wear = entries.where("entry <> 'wearable'").withColumn("up_to", up_to), entries.where("entry = 'wearable'")
    large = lambda some: told.join(F.broadcast(some), "account").withColumn("epoch", before).drop("up_to")
    small = lambda some, how: told.join(F.broadcast(hot), "account", "left_anti").join(some, "account", how).withColumn("epoch", before).drop("up_to")
    of_large, of_small = large(hot), small(rest, "left")
    numbered = of_large.unionByName(of_small)
    dealt = numbered
    if apart is not None:
        # As few rows as those accounts have resets.
        all_apart = of_large.groupBy("account", "epoch").agg(F.bool_and(apart).alias("all_apart"))
        ends = F.when(F.col("all_apart"), F.when(F.col("epoch") < F.size("wiped"), WIPED).otherwise(OPEN))
        dealt = of_large.join(F.broadcast(all_apart), ["account", "epoch"]).withColumn("apart", ends).drop("all_apart").unionByName(of_small, allowMissingColumns=True)
    dealt = dealt.drop("wiped", "marked")
    spoken = F.array_compact(F.array(F.when(F.col("src_kind") == "Container", F.col("src_key")), F.when(F.col("tgt_kind") == "Container", F.col("tgt_key")), "parent_geid", "item_geid"))
    # The first epoch has all there is to wear; its parents are its own. Most large accounts have neither.
    later = large(hot.where("marked")).unionByName(small(rest.where("marked"), "inner")).where("epoch > 0").select("account", "epoch", F.explode(spoken).alias("item_geid")).distinct()
    known = wear.withColumn("epoch", F.lit(0)).unionByName(wear.join(later, ["account", "item_geid"]))
    parents = numbered.where("entry = 'worn' AND is_part AND parent_geid IS NOT NULL").groupBy("account", F.col("parent_geid").alias("item_geid")).agg(F.min("epoch").alias("first"))
    carried = parents.join(later, ["account", "item_geid"]).where("epoch > first").select("account", "epoch", "item_geid", F.lit("parent").alias("entry"), F.lit(0).alias("rank"), F.lit(0).cast("timestamp").alias("ts"))
    return dealt.unionByName(known, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)


def ledger(entries: DataFrame, kinds: list[str] | None = None, many: int = MANY) -> DataFrame:
    """Rows of every account: holdings, part parents, misses, placement checks, resets, counters (``row_kind``).

    An account runs in as many tasks as it has epochs. Each has its own counters, which ``counters`` adds up. The entries are
    read more than once: a table, not a plan. Who reads rows of some ``kinds`` only gets them alone: the pass is the same, but the
    other rows are not written.
    """
    wanted = KINDS if kinds is None else KINDS & set(kinds)
    dealt = epochs(entries, many, stands_apart(wanted))
    dealt = dealt.withColumns({"by": F.when(F.col("apart").isNotNull(), F.col("item_geid")), "last": F.col("apart").isNotNull() & (F.col("entry") == "reset")})
    rows = fold(dealt, ["account", "epoch"], ["last", "by", "ts", "rank", "seq", "sub", "item_geid"], lambda: Epoch(wanted), ROWS, _READS)
    if kinds is not None and "parent" not in kinds:
        return rows
    parents = entries.where("entry = 'worn' AND is_part AND parent_geid IS NOT NULL").select("account", F.lit("parent").alias("row_kind"), F.col("parent_geid").alias("geid")).distinct()
    return rows.unionByName(parents, allowMissingColumns=True)


def counters(rows: DataFrame) -> DataFrame:
    """(account, detail, quantity): the counters of an account over all its epochs."""
    return rows.where("row_kind = 'stat'").groupBy("account", "detail").agg(F.sum("quantity").alias("quantity"))
