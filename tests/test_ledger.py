"""Rules of the running account, on entries as the timeline gives them."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from stowline.operators.ledger import _NAMES, Account, counters, ledger
from stowline.streaming.live import LiveLedger

START = datetime(2026, 8, 1)
BODY, STATION, CRATE, LOST = ("Equipped", ""), ("Location", "1"), ("Container", "7"), ("LostTrack", "")


def entry(minute, kind, **v):
    base = dict.fromkeys(["item_class", "item_geid", "amount", "src_kind", "src_key", "tgt_kind", "tgt_key", "move_type", "action", "result", "port", "is_part", "body_port", "parent_geid", "geids", "classes", "build"])
    return SimpleNamespace(**(base | {"account": "a", "entry": kind, "ts": START + timedelta(minutes=minute)} | v))


def move(minute, name, source, target, geid=None, n=1, result="succeed", kind="Move", action=None):
    return entry(minute, "move", item_class=name, item_geid=geid, amount=n, src_kind=source[0], src_key=source[1], tgt_kind=target[0], tgt_key=target[1], move_type=kind, action=action, result=result)


def worn(minute, name, geid, port="Armor_Helmet", parent=None):
    return entry(minute, "worn", item_class=name, item_geid=geid, port=port, is_part=parent is not None, body_port=port.startswith("Armor_"), parent_geid=parent)


def body(minute, geids, classes=()):
    return entry(minute, "body", geids=list(geids), classes=list(classes))


def play(*entries):
    a = Account()
    rows = [r for e in entries for r in a.step(e)] + a.end()
    rows = [dict(zip(_NAMES, r, strict=True)) for r in rows]
    held = {(r["item_class"], r["geid"], r["quantity"], r["kind"], r["key"]) for r in rows if r["row_kind"] == "holding"}
    return held, rows, a


INVALID = ("Invalid", "")


def test_an_entity_has_one_placement():
    held, _, _ = play(move(0, "hat", INVALID, STATION, "g1", kind="Store"), move(1, "hat", STATION, CRATE, "g1"), worn(2, "hat", "g1"))
    assert held == {("hat", "g1", 1, *BODY)}


def test_class_move_takes_the_newest_named_then_loose_then_infers():
    held, rows, a = play(move(0, "ammo", INVALID, STATION, "g1"), move(1, "ammo", INVALID, STATION, "g2"), move(2, "ammo", STATION, CRATE, n=1))
    assert held == {("ammo", "g1", 1, *STATION), ("ammo", "g2", 1, *CRATE)}
    held, rows, a = play(move(0, "ammo", INVALID, STATION, "g1"), move(1, "ammo", STATION, CRATE, n=3))
    assert held == {("ammo", "g1", 1, *CRATE), ("ammo", None, 2, *CRATE)}
    miss = next(r for r in rows if r["row_kind"] == "miss")
    assert (miss["detail"], miss["quantity"], miss["duplicate_risk"]) == ("AlreadyTaken", 2, False)


def test_shortfall_comes_from_the_body_and_from_lost_track_but_not_from_storage():
    carried = [worn(0, "pack_backpack", "p", "backpack"), entry(0, "wearable", item_geid="p")]
    held, rows, _ = play(*carried, move(1, "ammo", INVALID, ("Container", "p"), "g1"), move(2, "ammo", STATION, CRATE))
    assert ("ammo", "g1", 1, *CRATE) in held
    held, rows, _ = play(move(0, "ammo", INVALID, ("Container", "9"), "g1"), move(1, "ammo", STATION, CRATE))
    assert ("ammo", "g1", 1, "Container", "9") in held and ("ammo", None, 1, *CRATE) in held
    assert next(r for r in rows if r["row_kind"] == "miss")["duplicate_risk"]
    held, _, _ = play(worn(0, "gun", "g1", "Armor_x"), body(1, ["b"]), move(2, "gun", STATION, CRATE))
    assert held == {("gun", "g1", 1, *CRATE)}


def test_listing_evicts_the_worn_and_uses_up_the_carried():
    held, _, a = play(worn(0, "vest", "v", "Armor_Torso"), worn(0, "hat", "h"), move(1, "Drink_a", STATION, BODY, "d", action="Carry"), body(5, ["v"], ["vest"]))
    assert held == {("vest", "v", 1, *BODY), ("hat", "h", 1, *LOST)} and a.stats["used_up"] == 1
    held, _, _ = play(worn(9, "hat", "h"), body(5, []))
    assert held == {("hat", "h", 1, *BODY)}


def test_parts_follow_their_parent_and_ports_have_one_occupant():
    held, _, _ = play(worn(0, "gun", "g", "Armor_a"), worn(0, "scope", "s", "optics_attach", "g"), body(1, ["g"], ["gun"]))
    assert held == {("gun", "g", 1, *BODY), ("scope", "s", 1, *LOST)}
    held, _, _ = play(worn(0, "hat", "h1"), worn(1, "cap", "h2"))
    assert held == {("hat", "h1", 1, *LOST), ("cap", "h2", 1, *BODY)}


def test_lost_and_failed_moves_move_nothing():
    held, _, _ = play(move(0, "ammo", STATION, CRATE, n=2, result="lost"), move(1, "gun", STATION, CRATE, "g", result="failed"))
    assert held == {("ammo", None, 2, *STATION)}
    held, _, _ = play(move(0, "ammo", STATION, CRATE, n=2, result="lost"), move(1, "ammo", CRATE, STATION, n=2, result="lost"), move(2, "ammo", STATION, CRATE, n=2, result="lost"))
    assert held == {("ammo", None, 2, *STATION)}


def test_reset_wipes_and_items_reappear():
    held, rows, _ = play(move(0, "hat", INVALID, STATION, "g1"), entry(1, "reset", build=5), move(2, "hat", STATION, CRATE, "g1"))
    assert held == {("hat", "g1", 1, *CRATE)} and next(r for r in rows if r["row_kind"] == "reset")["quantity"] == 1


def test_naming_a_unit_spends_it_once():
    held, _, _ = play(move(0, "ammo", INVALID, STATION, n=3), move(1, "ammo", STATION, CRATE, "g1"), move(2, "ammo", CRATE, STATION, "g1"))
    assert held == {("ammo", "g1", 1, *STATION), ("ammo", None, 2, *STATION)}


def test_groups_keep_their_provenance():
    held, rows, _ = play(move(0, "ammo", INVALID, STATION, n=1), move(1, "ammo", INVALID, STATION, n=2, result=None))
    groups = {(r["quantity"], r["confirmed"]) for r in rows if r["row_kind"] == "holding"}
    assert groups == {(1, True), (2, False)}


def test_checks_compare_belief_and_source():
    _, rows, _ = play(move(0, "hat", INVALID, CRATE, "g1"), move(1, "crate", INVALID, STATION, "7"), move(2, "hat", STATION, BODY, "g1"), move(3, "hat", CRATE, BODY, "g1"))
    assert [r["same_place"] for r in rows if r["row_kind"] == "check"] == [True, False]


SCHEMA = "account string, entry string, ts timestamp, rank int, seq long, sub int, move_type string, item_class string, item_geid string, amount int, src_kind string, src_key string, tgt_kind string, tgt_key string, action string, result string, port string, is_part boolean, body_port boolean, parent_geid string, geids array<string>, classes array<string>, build int"
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]


def random_timeline():
    """Three accounts with moves, sightings, listings and resets, many at one instant."""
    rng = random.Random(12)
    rank = {"wearable": 0, "reset": 1, "move": 2, "worn": 3, "body": 4}
    places = [STATION, ("Location", "2"), BODY, ("World", "w"), ("Invalid", ""), *(("Container", f"g{i}") for i in range(4))]
    rows = []
    for who in "abc":
        resets = {"a": 6, "b": 1, "c": 0}[who]
        minutes = [0, *rng.sample(range(1, 200), 79)]
        for i, minute in enumerate(sorted(minutes * 2)):
            src, tgt = rng.choice(places), rng.choice(places)
            kind, geid = rng.choice(["move", "move", "worn", "body"]), f"g{rng.randrange(9)}"
            v = {"move": {"src_kind": src[0], "src_key": src[1], "tgt_kind": tgt[0], "tgt_key": tgt[1], "item_geid": rng.choice([geid, None]), "item_class": "c" + geid[1:], "amount": rng.randint(1, 3), "move_type": "Move", "action": rng.choice([None, "Carry"]), "result": rng.choice(["succeed", "failed", "lost", None])},
                 "worn": {"item_geid": geid, "item_class": "c" + geid[1:], "port": rng.choice(["Armor_Helmet", "wep_1", "optics_attach"]), "is_part": rng.random() < 0.4, "body_port": True, "parent_geid": f"g{rng.randrange(4)}"},
                 "body": {"geids": [f"g{rng.randrange(9)}" for _ in range(4)], "classes": ["c1", "c2"]}}[kind]
            rows.append(v | {"account": who, "entry": kind, "ts": START + timedelta(minutes=minute), "seq": i, "sub": 0})
        rows += [{"account": who, "entry": "reset", "ts": START + timedelta(minutes=m), "seq": 0, "build": 10 + n} for n, m in enumerate([*rng.sample(minutes, max(0, resets - 1)), minutes[5]][:resets])]
        rows += [{"account": who, "entry": "wearable", "ts": datetime(1970, 1, 1), "seq": 0, "item_geid": f"g{i}"} for i in (0, 1, 2)]
    return [dict.fromkeys(COLUMNS) | r | {"rank": rank[r["entry"]]} for r in rows]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in COLUMNS) for r in rows], SCHEMA).repartition(3)


def test_epochs_equal_one_serial_pass(spark):
    """An epoch at a time gives the rows of one pass over the account."""
    rows = random_timeline()
    want = []
    for who in "abc":
        a, parents = Account(), set()
        own = sorted((r for r in rows if r["account"] == who), key=lambda r: (r["ts"], r["rank"], r["seq"], r["sub"] or -1, r["item_geid"] or ""))
        for r in own:
            want += a.step(SimpleNamespace(**r))
            parents |= {r["parent_geid"]} if r["entry"] == "worn" and r["is_part"] else set()
        assert parents == a.parents
        want += a.end() + [a._row("parent", geid=p) for p in parents]
    found = ledger(frame(spark, rows))
    sums = {(r[_NAMES.index("account")], r[_NAMES.index("detail")], r[_NAMES.index("quantity")]) for r in want if r[1] == "stat"}
    assert {tuple(r) for r in counters(found).collect()} == sums
    assert sorted((tuple(r) for r in found.where("row_kind <> 'stat'").collect()), key=str) == sorted((r for r in want if r[1] != "stat"), key=str)


def test_a_live_ledger_equals_a_rebuild_and_replays_what_changed(spark, tmp_path):
    """Entries in three deliveries, the second in the midst of the first, the third of one account; then an old move is patched."""
    rows = random_timeline()
    live = LiveLedger(spark, str(tmp_path / "live"), every=10)
    times = sorted({r["ts"] for r in rows if r["entry"] != "wearable"})
    late = {times[k] for k in range(len(times) // 2, len(times) // 2 + 9)}
    last = set(times[-6:])
    deliveries = [lambda r: r["ts"] not in late | last, lambda r: r["ts"] not in last, lambda r: r["ts"] not in last or r["account"] == "b", lambda r: r["ts"] not in last or r["account"] == "b"]

    def all_rows(df):
        sums = {tuple(r) for r in counters(df).collect()}
        return sums, sorted((tuple(r) for r in df.where("row_kind <> 'stat'").collect()), key=str)

    sizes = []
    for i, wanted in enumerate(deliveries):
        have = [r for r in rows if wanted(r)]
        if i == 3:
            patched = next(r for r in reversed(have) if r["account"] == "a" and r["entry"] == "move" and r["result"] is None)
            have = [r | {"result": "failed"} if r is patched else r for r in have]
        version = live.update(frame(spark, have))
        assert version == i + 1
        assert all_rows(live.rows()) == all_rows(ledger(frame(spark, have)))
        sizes.append(live.store.read("entries", version).count())
        if i == 2:
            assert [r["account"] for r in live.republished(version).collect()] == ["b"]
    assert live.update(frame(spark, have)) is None
    # Only what stands behind a kept state is read again.
    assert sizes[1] < 0.7 * sizes[0] and sizes[2] < 40 and sizes[3] < 0.3 * sizes[0]


def test_resets_reach_large_accounts_by_broadcast(spark):
    from stowline.operators.ledger import epochs

    none = "cast(NULL AS string)"
    entries = spark.range(60).selectExpr(
        "IF(id % 6 = 0, 'small', IF(id % 2 = 0, 'large', 'never'))  AS account", "IF(id % 10 = 0 AND id % 4 = 0, 'reset', 'move') AS entry", "timestamp_seconds(id DIV 3) AS ts",
        "id AS seq", f"{none} AS src_kind", f"{none} AS src_key", "'Container' AS tgt_kind", "string(id % 5) AS tgt_key", f"{none} AS parent_geid", "string(id) AS item_geid", "false AS is_part", "1 AS rank",
    )
    want = sorted(map(tuple, epochs(entries).collect()), key=str)
    assert len(want) == 60 and len({(r[0], r[-1]) for r in want}) > 4
    for many in (0, 15):
        found = epochs(entries, many)
        assert sorted(map(tuple, found.collect()), key=str) == want
    assert "BroadcastHashJoin [account" in epochs(entries, 0)._jdf.queryExecution().executedPlan().toString()


def test_a_pass_gets_lists_as_text_and_nothing_that_is_for_the_order_alone(spark):
    """Spark walks all absent arrays of a batch for each row that it adds to it, so no array may go to a task."""
    from pyspark.sql import functions as F

    from stowline.operators.folds import fold

    class Told:
        def step(self, e):
            return [(e.k, repr((e.ts, e.l, e.n, hasattr(e, "o"))), e.ts)]

        def end(self):
            return []

    some = F.array(F.lit('a"b\n, ü'), F.lit(None), F.col("id").cast("string"))
    rows = spark.range(7).select((F.col("id") % 2).cast("string").alias("k"), (-F.col("id")).alias("o"), F.timestamp_micros(F.col("id") + 1).alias("ts"), F.when(F.col("id") > 1, some).alias("l"), F.when(F.col("id") != 4, F.col("id")).alias("n"))
    found = fold(rows, ["k"], ["o"], Told, "k string, told string, ts timestamp", ["ts", "l", "n"])
    us = lambda i: datetime(1970, 1, 1) + timedelta(microseconds=i + 1)
    want = [(str(i % 2), repr((us(i), ['a"b\n, ü', None, str(i)] if i > 1 else None, None if i == 4 else i, False))) for i in (6, 4, 2, 0, 5, 3, 1)]
    assert sorted((r.k, r.told) for r in found.collect()) == sorted(want)
    assert [r.told for r in found.where("k = '0'").collect()] == [told for k, told in want if k == "0"]
    assert [r.us for r in found.selectExpr("unix_micros(ts) AS us").orderBy("us").collect()] == list(range(1, 8))
    assert "array<" not in found._jdf.queryExecution().analyzed().children().head().schema().catalogString()


def test_a_pass_writes_rows_in_pieces(spark, monkeypatch):
    """What many small accounts leave is not gathered over a batch of entries."""
    import pyarrow as pa

    from stowline.operators import folds

    class Ends:
        def step(self, e):
            self.k = e.k
            return []

        def end(self):
            return [(self.k, i) for i in range(3)]

    rows = spark.createDataFrame([], "k long, o long")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    run = folds.fold(rows, ["k"], ["o"], Ends, "k long, i int", ["k"])
    out = list(run(iter([pa.record_batch([pa.array(range(10_000))], names=["k"])])))
    assert [(r["k"], r["i"]) for b in out for r in b.to_pylist()] == [(k, i) for k in range(10_000) for i in range(3)]
    assert max(b.num_rows for b in out) < folds.PIECE + 3


def test_rows_of_some_kinds_are_those_of_all(spark):
    entries = frame(spark, random_timeline())
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    every = rows(ledger(entries))
    assert {r[1] for r in every} == {"holding", "miss", "check", "reset", "stat", "parent"}
    for kinds in (["holding"], ["miss", "check", "reset"], ["stat"], ["parent", "stat"]):
        assert rows(ledger(entries, kinds)) == [r for r in every if r[1] in kinds]


def named_timeline():
    """Moves of named entities alone, many at one instant, between resets; account n also has a sighting and an unnamed move in two of its epochs."""
    rng = random.Random(5)
    rank, places = {"reset": 1, "move": 2, "worn": 3}, [STATION, ("Location", "2"), ("World", "w"), ("Invalid", ""), BODY]
    rows = []
    for who in "mnob":
        for i in range(300):
            boxes = [("Container", f"g{k}") for k in range(3)] if who == "b" else []
            src, tgt = rng.choice(places + boxes), rng.choice(places + boxes)
            rows.append({"account": who, "entry": "move", "ts": START + timedelta(minutes=i // 3), "seq": rng.randrange(9), "sub": 0, "src_kind": src[0], "src_key": src[1], "tgt_kind": tgt[0], "tgt_key": tgt[1], "item_geid": f"g{rng.randrange(12)}", "item_class": rng.choice("cd"), "amount": 1, "move_type": "Move", "action": rng.choice([None, "Carry"]), "result": rng.choice(["succeed", "failed", "lost", None])})
        rows += [{"account": who, "entry": "reset", "ts": START + timedelta(minutes=m), "seq": 0, "build": 7} for m in ((20, 45, 70) if who != "o" else ())]
    rows.append({"account": "n", "entry": "worn", "ts": START + timedelta(minutes=30), "seq": 99, "item_geid": "g1", "item_class": "c", "port": "optics_attach", "is_part": True, "body_port": False, "parent_geid": "g2"})
    rows.append(next(r for r in rows if r["account"] == "n" and r["ts"] > START + timedelta(minutes=80) and r["tgt_kind"] == "Location") | {"item_geid": None, "seq": 98, "result": "succeed"})
    return [dict.fromkeys(COLUMNS) | r | {"rank": rank[r["entry"]], "seq": n if r["entry"] == "move" else 1000} for n, r in enumerate(rows)]


def test_entities_that_stand_apart_equal_one_serial_pass(spark):
    from stowline.operators.ledger import KINDS, epochs, stands_apart

    rows = named_timeline()
    want = []
    for who in "mnob":
        a = Account()
        for r in sorted((r for r in rows if r["account"] == who), key=lambda r: (r["ts"], r["rank"], r["seq"])):
            want += a.step(SimpleNamespace(**r))
        want += a.end() + [a._row("parent", geid=p) for p in a.parents]
    entries = frame(spark, rows)
    text = lambda found: sorted((tuple(r) for r in found), key=str)
    for many in (0, 10_000):
        for kinds in (None, ["holding", "miss", "reset", "stat"], ["check"]):
            found, asked = ledger(entries, kinds, many), {r[1] for r in want} if kinds is None else set(kinds)
            assert text(found.where("row_kind <> 'stat'").collect()) == text(r for r in want if r[1] in asked and r[1] != "stat")
            if "stat" in asked:
                assert {tuple(r) for r in counters(found).collect()} == {(r[0], r[_NAMES.index("detail")], r[_NAMES.index("quantity")]) for r in want if r[1] == "stat"}
    assert {r[1] for r in want} == {"holding", "miss", "reset", "stat", "check", "parent"}
    ends = lambda kinds: {(r.account, r.epoch): r.apart for r in epochs(entries, 0, stands_apart(frozenset(kinds))).where("entry = 'move'").collect()}
    found = ends(["holding", "reset"])
    assert [found["m", k] for k in range(4)] == [found["b", k] for k in range(4)] == ["wiped", "wiped", "wiped", "open"] and found["o", 0] == "open"
    assert [found["n", k] for k in range(4)] == ["wiped", None, "wiped", None]
    assert {v for (who, _), v in ends(KINDS).items() if who == "b"} == {None}


def test_of_entities_that_stand_apart_one_is_held():
    from stowline.operators.ledger import OPEN, WIPED, Epoch

    for end in (WIPED, OPEN):
        e, rows = Epoch(), []
        for i in range(500):
            for minute in (i, i + 1):
                m = move(minute, "hat", INVALID, STATION, f"g{i}", kind="Store")
                m.apart = end
                rows += e.step(m)
                assert len(e.account.at) == sum(len(s.named) for c in e.account.places.values() for s in c.values()) == 1
        if end == WIPED:
            r = entry(600, "reset", build=5)
            r.apart = end
            rows += e.step(r)
        rows = [dict(zip(_NAMES, r, strict=True)) for r in rows + e.end()]
        kinds = [r["row_kind"] for r in rows]
        assert (kinds.count("holding"), kinds.count("reset")) == ((0, 1) if end == WIPED else (500, 0))
        assert [r["quantity"] for r in rows if r["row_kind"] == "reset" or r["detail"] == "wiped"] == ([500, 500] if end == WIPED else [])
        assert next(r["quantity"] for r in rows if r["detail"] == "named_moves") == 1000
