"""Oracle-checked queries that write log lines, moves and holdings from the star-schema tables and run the engine on them.

Each line of ``events`` becomes a log line, or a short play of lines in a session or account of its own; the SQL says from the
same tables what must come out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scoring import CAVEATS
from .analogs import K, E, H, LABEL, _holdings, events, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def text(template: str) -> Column:
    """A template with SQL expressions in double braces as a column."""
    parts = re.split(r"\{\{(.*?)\}\}", template)
    return F.concat(*[F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def stamp(seconds: Column) -> Column:
    """Time of a line, so many seconds after a fixed day, as the log writes it."""
    return F.date_format(F.timestamp_millis((F.lit(1_785_542_400_000) + seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_line(seconds: Column, tag: str, body: str) -> Column:
    return F.concat(F.lit("<"), stamp(seconds), F.lit(f"> [Notice] <{tag}> "), text(body))


# Lines of every shape.

G = "700000000000 + event_id"
_QUEUED, _DONE, _ADD = "Inventory Mgmt Request Queued", "Inventory Request Completed", "Add Inventory Management Move"


def queued(request: str, kind: str, source: str, target: str, name: str = "NULL", n: str = "1", item: str = "NONE", action: str = "None") -> str:
    return f"Queued Request[{request}] Type[{kind}] for 'P' [9001] Source Inventory[{source}] Target Inventory[{target}]. Source[{name}] amount[{n}] rank[]. Target[NULL] amount[0] rank[]. Item[{item}] action[{action}]. tail"


def added(request: str, kind: str, source: str, target: str, name: str, caller: str) -> str:
    return f"New Request[{request}] Player[P] Type[{kind}] SourceInventory[{source}] TargetInventory[{target}] ItemClass[{name}] StoredEntity[NULL] x Caller[{caller}]"


_INT = ("request_no", "amount", "n_classes")
_OUT = ["event_kind", "request_no", "move_type", "item_class", "item_geid", "amount", "src_kind", "src_key", "tgt_kind", "tgt_key", "caller", "action", "n_classes", "result", "port", "status", "name", "landing_id", "location_id", "capacity"]
_AREA, _BOX = "9001:Location:{{user_id}}", "{{" + G + "}}:Container:0"
_GEID = f"cast({G} AS VARCHAR)"
#: (tag, body, what the line must say); an empty dict: nothing.
SHAPES: list[tuple[str, str, dict[str, str]]] = [
    (_QUEUED, queued("{{k}}", "Store", "INVALID", _AREA, item="tool_a_01_{{" + G + "}}"), {"event_kind": "'ItemMoved'", "request_no": "k", "move_type": "'Store'", "item_class": "'tool_a_01'", "item_geid": _GEID, "amount": "1", "src_kind": "'Invalid'", "src_key": "''", "tgt_kind": "'Location'", "tgt_key": "cast(user_id AS VARCHAR)"}),
    ("InventoryManagementRequest", queued("{{k}}", "Interaction", _BOX, "INVALID", "ammo_{{k}}", "3", action="Carry"), {"event_kind": "'ItemMoved'", "request_no": "k", "move_type": "'Interaction'", "item_class": "concat('ammo_', k)", "amount": "3", "src_kind": "'Container'", "src_key": _GEID, "tgt_kind": "'Invalid'", "tgt_key": "''", "action": "'Carry'"}),
    (_QUEUED, queued("{{k}}", "QueryInventory", "INVALID", _AREA, "ammo_a"), {}),
    (_QUEUED, "Queued Request[{{k}}] Kind[Store] changed", {"event_kind": "'UnrecognisedMove'", "name": f"'{_QUEUED}'"}),
    (_ADD, added("{{k}}", "Interaction", _AREA, "INVALID", "hat_{{k}}", "X::AttachItem"), {"event_kind": "'MoveRequested'", "request_no": "k", "move_type": "'Interaction'", "item_class": "concat('hat_', k)", "src_kind": "'Location'", "src_key": "cast(user_id AS VARCHAR)", "tgt_kind": "'Invalid'", "tgt_key": "''", "caller": "'X::AttachItem'"}),
    (_ADD, added("{{k}}", "Move", "9001:ClientOnly:1", _BOX, "[a_1] [b_{{k}}] [NULL] [c_3] ", "Drag").replace("ItemClass[[a_1]", "ItemClass[[a_1]"), {"event_kind": "'MoveBatchRequested'", "request_no": "k", "move_type": "'Move'", "src_kind": "'ClientOnly'", "src_key": "''", "tgt_kind": "'Container'", "tgt_key": _GEID, "caller": "'Drag'", "n_classes": "3"}),
    (_ADD, "New request[{{k}}] Player[P] Type[Drop] SourceInventory[odd] TargetInventory[INVALID] ItemClass[cup] x Caller[D]", {"event_kind": "'MoveRequested'", "request_no": "k", "move_type": "'Drop'", "item_class": "'cup'", "src_kind": "'Unknown'", "src_key": "''", "tgt_kind": "'Invalid'", "tgt_key": "''", "caller": "'D'"}),
    (_DONE, "Request[{{k}}] Player[P] Result[failed] x", {"event_kind": "'MoveCompleted'", "request_no": "k", "result": "'failed'"}),
    ("Player Inventory Request Complete", "Request[{{k}}] for 'P' [9001] Type[Store] Result[Succeed]", {"event_kind": "'MoveCompleted'", "request_no": "k", "result": "'Succeed'"}),
    ("UnstowPendingEntities", "Unstow Request[{{k}}] x finalized spawn of 'hat_a_{{" + G + "}}' [{{" + G + "}}], 0 remaining", {"event_kind": "'EntitySpawned'", "request_no": "k", "item_class": "'hat_a'", "item_geid": _GEID}),
    ("UnstowPendingEntities", "Unstow Request[{{k}}] x finalized spawn of 'hat_a_{{" + G + "}}' [700000000000], 0 remaining", {}),
    ("OnInventoryStoreItem", "Entity[hat_a_{{" + G + "}} - Class(hat_a) - x] Inventory[" + _AREA + "]", {"event_kind": "'ItemStored'", "item_class": "'hat_a'", "item_geid": _GEID, "tgt_kind": "'Location'", "tgt_key": "cast(user_id AS VARCHAR)"}),
    ("AttachmentReceived", "Player[P] Attachment[hat_a_{{" + G + "}}, hat_a, {{" + G + "}}] Status[persistent] Port[Armor_Helmet]", {"event_kind": "'AttachmentSeen'", "item_class": "'hat_a'", "item_geid": _GEID, "port": "'Armor_Helmet'", "status": "'persistent'"}),
    ("Inventory Token Flow", "x on Inventory[pack_backpack_01_{{" + G + "}}, {{" + G + "}}]", {"event_kind": "'ContainerIdentified'", "item_class": "'pack_backpack_01'", "item_geid": _GEID}),
    ("Inventory Token Flow", "x on Inventory[PersonalStorage_SHIP_A-{{k}}, {{" + G + "}}]", {"event_kind": "'ContainerIdentified'", "item_class": "concat('PersonalStorage_SHIP_A-', k)", "item_geid": _GEID}),
    ("OnDragInventoryItemModifyTarget", "Source[INVALID] Capacity[-1] x | Target[" + _BOX + "] Capacity[{{k}}000] x", {"event_kind": "'ContainerCapacitySeen'", "src_kind": "'Invalid'", "src_key": "''", "tgt_kind": "'Container'", "tgt_key": _GEID, "capacity": "cast(concat(k, '000') AS BIGINT)"}),
    ("Update Inventory Location", "x Landing [0] -> [{{k}}]. Location [0] -> [{{user_id}}]. x", {"event_kind": "'LocationChanged'", "landing_id": "cast(k AS VARCHAR)", "location_id": "cast(user_id AS VARCHAR)"}),
    ("RequestLocationInventory", "x Location[Stanton3_Area{{k}}]", {"event_kind": "'LocationNamed'", "name": "concat('Stanton3_Area', k)"}),
    ("Calculate Route", "x Projected Start Location is Name {{k}} for route to destination B", {"event_kind": "'PlaceNamed'", "name": "concat('Name ', k)"}),
    ("Player Selected Quantum Target - Local", "x has selected point pt_{{k}} as their destination", {"event_kind": "'QuantumTargetSelected'", "name": "concat('pt_', k)"}),
    ("Quantum Drive Arrived - Arrived at Final Destination", "x", {"event_kind": "'QuantumArrived'"}),
    ("Loading", "data/ObjectContainers/PU/loc/mod/nyx/x{{k}}", {"event_kind": "'PlaceAssetSeen'", "name": "'Nyx'"}),
    ("Vehicle Control Flow", "x releasing control token for 'SHIP_A_{{" + G + "}}' [{{" + G + "}}]", {"event_kind": "'VehicleFlown'", "item_class": "'SHIP_A'", "item_geid": _GEID}),
    ("CEntityComponentShipListProvider::SetVehicleSpawningInformations", "x VehicleEntityId: [{{" + G + "}}], x", {"event_kind": "'VehicleRetrieved'", "item_geid": _GEID}),
    ("Channel Disconnected", "cause={{k}} reason=\"r {{k}}\" x", {"event_kind": "'ChannelDisconnected'", "name": "concat('r ', k)"}),
    ("ReuseChannel", "x 'sc.external.services.character_customizer.v1.CharacterCustomizerService' x", {"event_kind": "'CharacterCreatorOpened'"}),
    ("A New Tag", "Queued Request[{{k}}] in another shape", {"event_kind": "'UnrecognisedMove'", "name": "'A New Tag'"}),
    ("Talk", "nothing of note {{k}}", {}),
]


def _case(what: str) -> str:
    known = [f"WHEN {i} THEN {want[what]}" for i, (_, _, want) in enumerate(SHAPES) if what in want]
    kind = "BIGINT" if what == "capacity" else "INTEGER" if what in _INT else "VARCHAR"
    return f"cast(CASE event_id % {len(SHAPES)} {' '.join(known)} END AS {kind}) AS {what}"


@query(f"SELECT * FROM (SELECT event_id, {', '.join(map(_case, _OUT))} FROM {E}) WHERE event_kind IS NOT NULL")
def parse_shapes(spark, sf_dir):
    """A line of one of all shapes for each event: kinds, fields, lines that say nothing, lines that changed shape."""
    from ..functions.events import events as parse

    at, out = F.col("event_id") % 1000, None
    for i, (tag, body, _) in enumerate(SHAPES):
        hit = F.col("event_id") % len(SHAPES) == i
        out = F.when(hit, log_line(at, tag, body)) if out is None else out.when(hit, log_line(at, tag, body))
    lines = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_offset"), out.alias("line"))
    e = parse(lines).withColumns({"event_id": F.col("line_offset"), "request_no": F.col("request_no").cast("int"), "src_kind": F.col("source.kind"), "src_key": F.col("source.key"), "tgt_kind": F.col("target.kind"), "tgt_key": F.col("target.key"), "n_classes": F.when(F.col("classes").isNotNull(), F.size("classes")), "capacity": F.col("target_capacity")})
    return e.select("event_id", *_OUT)


# Pairing of reused request numbers.

_M = "event_type IN ('view', 'click')"


@query(f"""WITH e AS (SELECT user_id AS s, event_id AS o, k % 3 + 1 AS n, event_type IN ('view', 'click') AS mv, event_type = 'purchase' AS done, event_type = 'error' AS cut FROM {E} WHERE event_type <> 'signup'),
b AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY s ORDER BY o) AS d FROM e),
r AS (SELECT *, CASE WHEN mv THEN lag(CASE WHEN mv THEN n END IGNORE NULLS) OVER (PARTITION BY s, d ORDER BY o) END AS p FROM b),
g AS (SELECT *, d + sum(CASE WHEN p > n THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY o ROWS UNBOUNDED PRECEDING) AS gen FROM r),
m AS (SELECT *, lead(o) OVER (PARTITION BY s, n ORDER BY o) AS nxt FROM g WHERE mv),
hit AS (SELECT m.s, m.o, max(c.o) AS c FROM m JOIN g c ON c.done AND c.s = m.s AND c.n = m.n AND c.o > m.o AND (m.nxt IS NULL OR c.o < m.nxt) AND c.o - m.o <= 120 AND (c.gen = m.gen OR c.d > m.d) GROUP BY 1, 2)
SELECT m.s AS session_id, m.o AS line_offset, m.n AS request_no, CASE WHEN hit.c IS NOT NULL THEN concat('r', hit.c % 2) WHEN m.d < (SELECT max(d) FROM b WHERE b.s = m.s) THEN 'lost' END AS result
FROM m LEFT JOIN hit ON hit.s = m.s AND hit.o = m.o""")
def pair_reused(spark, sf_dir):
    """Completions of numbers that begin anew: generations, superseded moves, windows, disconnects between, moves that were lost."""
    from ..functions.events import events as parse
    from ..operators.correlate import moves

    e, at = events(spark, sf_dir).where("event_type <> 'signup'"), F.col("event_id")
    line = (
        F.when(F.expr(_M), log_line(at, _QUEUED, queued("{{k % 3 + 1}}", "Move", "9:Location:1", "{{event_id}}:Container:0", "part")))
        .when(F.col("event_type") == "purchase", log_line(at, _DONE, "Request[{{k % 3 + 1}}] Player[P] Result[r{{event_id % 2}}] x"))
        .otherwise(log_line(at, "Channel Disconnected", 'cause=1 reason="x"'))
    )
    lines = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line_offset"), line.alias("line"))
    return moves(parse(lines)).select("session_id", "line_offset", F.col("request_no").cast("int").alias("request_no"), "result")


_Q = lambda n, **v: (_QUEUED, queued(str(n), v.get("kind", "Move"), v.get("src", "9:Location:5"), v.get("tgt", _BOX), "part_{{k}}"))
_SPAWNED = lambda n: ("UnstowPendingEntities", f"Unstow Request[{n}] x finalized spawn of 'part_{{{{k}}}}_{{{{{G}}}}}' [{{{{{G}}}}}], 0 remaining")
_OK = lambda n: (_DONE, f"Request[{n}] Player[P] Result[succeed] x")
_CUT = ("Channel Disconnected", 'cause=1 reason="x"')
#: Plays of (seconds, (tag, body)), and what must come of them: (class, geid, target kind, target key, caller, result).
PLAYS: list[tuple[list, list[tuple]]] = [
    ([(0, (_ADD, added("5", "Interaction", "9:Location:5", "INVALID", "part_{{k}}", "X::AttachItem"))), (1, _Q(5, kind="Interaction", tgt="INVALID")), (9, _OK(5))], [("P", None, "'Equipped'", "''", "'X::AttachItem'", "'succeed'")]),
    ([(0, _Q(5)), (120, _OK(5))], [("P", None, "'Container'", _GEID, None, "'succeed'")]),
    ([(0, _Q(5)), (121, _OK(5))], [("P", None, "'Container'", _GEID, None, None)]),
    ([(0, _Q(5)), (30, _CUT)], [("P", None, "'Container'", _GEID, None, "'lost'")]),
    ([(0, _Q(5)), (30, _CUT), (60, _OK(5))], [("P", None, "'Container'", _GEID, None, "'succeed'")]),
    ([(0, _Q(5)), (20, _SPAWNED(5))], [("P", _GEID, "'Container'", _GEID, None, None)]),
    ([(0, _SPAWNED(5)), (60, _Q(5))], [("P", _GEID, "'Container'", _GEID, None, None)]),
    ([(0, _Q(5)), (61, _SPAWNED(5))], [("P", None, "'Container'", _GEID, None, None)]),
    ([(0, ("Update Inventory Location", "x Landing [0] -> [0]. Location [0] -> [{{user_id + 1}}]. x")), (5, (_ADD, added("5", "Drop", _BOX, "INVALID", "part_{{k}}", "D")))], [("P", None, "'World'", "cast(user_id + 1 AS VARCHAR)", "'D'", None)]),
    ([(0, (_ADD, added("5", "Move", "9:Location:5", _BOX, "[part_{{k}}] [b] ", "Drag"))), (3, _OK(5))], [("P", None, "'Container'", _GEID, "'Drag'", "'succeed'"), ("'b'", None, "'Container'", _GEID, "'Drag'", "'succeed'")]),
    ([(0, _Q(5, tgt="9:Location:5"))], []),
    ([(0, _Q(9)), (10, _Q(4)), (20, _OK(9)), (21, _OK(4))], [("P", None, "'Container'", _GEID, None, None), ("P", None, "'Container'", _GEID, None, "'succeed'")]),
    ([(0, (_ADD, added("9", "Move", "9:Location:5", _BOX, "part_{{k}}", "C"))), (1, (_ADD, added("8", "Move", "9:Location:5", _BOX, "part_{{k}}", "C"))), (2, _Q(9)), (3, _OK(9))], [("P", None, "'Container'", _GEID, None, "'succeed'")]),
    ([(0, ("OnInventoryStoreItem", "Entity[part_{{k}}_{{" + G + "}} - Class(part_{{k}}) - x] Inventory[" + _BOX + "]"))], [("P", _GEID, "'Container'", _GEID, None, None)]),
]


def _played() -> str:
    names = ["item_class", "item_geid", "tgt_kind", "tgt_key", "caller", "result"]
    value = lambda x: "cast(NULL AS VARCHAR)" if x is None else "concat('part_', k)" if x == "P" else x
    rows = [f"SELECT event_id AS session_id, {', '.join(f'{value(x)} AS {n}' for x, n in zip(want, names, strict=True))} FROM {E} WHERE event_id % {len(PLAYS)} = {i}" for i, (_, wants) in enumerate(PLAYS) for want in wants]
    return " UNION ALL ".join(rows)


@query(_played())
def pair_plays(spark, sf_dir):
    """Short plays, one a session: windows at their edges, spawns before and after, drops, batches, moves that move nothing."""
    from ..functions.events import events as parse
    from ..operators.correlate import moves

    out = None
    for i, (play, _) in enumerate(PLAYS):
        rows = F.array(*[F.struct(F.lit(n).alias("n"), log_line(F.lit(at), tag, body).alias("line")) for n, (at, (tag, body)) in enumerate(play)])
        hit = F.col("event_id") % len(PLAYS) == i
        out = F.when(hit, rows) if out is None else out.when(hit, rows)
    lines = events(spark, sf_dir).select(F.col("event_id").alias("session_id"), F.explode(out).alias("x")).select("session_id", F.col("x.n").cast("long").alias("line_offset"), "x.line")
    return moves(parse(lines)).select("session_id", "item_class", "item_geid", "tgt_kind", "tgt_key", "caller", "result")


# The account.

_A, _B = ("Location", "'A'"), ("Container", "'B'")
_NOWHERE, _WORLD = ("Invalid", "''"), ("World", "'W'")


def _mv(minute, source, target, geid=False, n=1, kind="Move", result="succeed", action=None):
    return ("move", minute, {"src": source, "tgt": target, "geid": geid, "n": n, "kind": kind, "result": result, "action": action})


#: Plays of an account's entries, and what it must hold: (kind, key, units, named, inferred).
ACCOUNTS: list[tuple[list, list[tuple]]] = [
    ([_mv(0, _NOWHERE, _A, True, kind="Store"), _mv(5, _A, _B, True)], [("Container", "B", 1, 1, False)]),
    ([_mv(0, _NOWHERE, _A, n=3)], [("Location", "A", 3, 0, True)]),
    ([_mv(0, _NOWHERE, _A, True, kind="Store"), _mv(5, _A, _B)], [("Container", "B", 1, 1, False)]),
    ([_mv(0, _NOWHERE, _A, True, kind="Store", result="failed")], []),
    ([_mv(0, _NOWHERE, _A, n=5), _mv(5, _A, _B, n=2)], [("Location", "A", 3, 0, True), ("Container", "B", 2, 0, False)]),
    ([_mv(0, _NOWHERE, _A, True, kind="Store"), _mv(5, _A, _B, True, result="lost")], [("Location", "A", 1, 1, False)]),
    ([_mv(0, _A, _B, True, result="lost")], [("Location", "A", 1, 1, True)]),
    ([_mv(0, _A, _B, n=4, result="lost")], [("Location", "A", 4, 0, True)]),
    ([_mv(0, _NOWHERE, _A, True, kind="Store"), ("reset", 5, {})], []),
    ([_mv(0, _A, ("Equipped", "''"), True, action="Carry"), ("worn", 5, {"port": "Body_ItemPort", "geid": 2})], []),
    ([_mv(0, _A, ("Equipped", "''"), True), ("worn", 5, {"port": "Body_ItemPort", "geid": 2})], [("LostTrack", "", 1, 1, False)]),
    ([("worn", 0, {"port": "Armor_Helmet", "geid": 1}), ("worn", 5, {"port": "Armor_Helmet", "geid": 3})], [("Equipped", "", 1, 1, False), ("LostTrack", "", 1, 1, False)]),
    ([_mv(0, _NOWHERE, _A, n=2), _mv(5, _NOWHERE, _A, True, kind="Store")], [("Location", "A", 2, 1, True)]),
    ([_mv(0, _A, _WORLD, n=1, kind="Drop")], [("World", "W", 1, 0, True)]),
    ([_mv(5, _NOWHERE, _B, True, kind="Store"), _mv(0, _NOWHERE, _A, True, kind="Store")], [("Container", "B", 1, 1, False)]),
    ([_mv(0, _NOWHERE, _A, n=2), _mv(5, _A, _B, n=2, result="failed"), _mv(6, _A, _B, n=3)], [("Container", "B", 3, 0, True)]),
]


def _held() -> str:
    rows = [f"SELECT cast(event_id AS VARCHAR) AS account, '{kind}' AS kind, '{key}' AS key, concat('part_', k) AS item_class, cast({n} AS BIGINT) AS quantity, cast({named} AS BIGINT) AS named, {str(inferred).upper()} AS inferred FROM {E} WHERE event_id % {len(ACCOUNTS)} = {i}" for i, (_, wants) in enumerate(ACCOUNTS) for kind, key, n, named, inferred in wants]
    return " UNION ALL ".join(rows)


def _played_accounts(spark, sf_dir, *kinds: str) -> DataFrame:
    """The account's rows of these kinds for the plays of ACCOUNTS, an account for each event."""
    from ..operators.ledger import ledger, timeline

    def entries(kind: str, make: Callable[[int, dict, int], Column]) -> DataFrame:
        out = None
        for i, (play, _) in enumerate(ACCOUNTS):
            own = [(minute, v, n) for n, (what, minute, v) in enumerate(play) if what == kind]
            if own:
                rows, hit = F.array(*[make(*x) for x in own]), F.col("event_id") % len(ACCOUNTS) == i
                out = F.when(hit, rows) if out is None else out.when(hit, rows)
        return events(spark, sf_dir).select(F.col("event_id").cast("string").alias("account"), F.explode(out).alias("x")).select("account", "x.*")

    ts = lambda minute: F.timestamp_seconds(F.lit(1_785_542_400 + 60 * minute)).alias("ts")
    name, none = F.concat(F.lit("part_"), F.col("k")), F.lit(None).cast("string")
    geid = lambda n: F.concat(F.lit(f"{n}"), F.col("event_id").cast("string"))
    end = lambda side, at: [F.lit(at[0]).alias(f"{side}_kind"), F.expr(at[1]).alias(f"{side}_key")]
    moves = entries("move", lambda minute, v, n: F.struct(ts(minute), F.lit(n).cast("long").alias("seq"), F.lit(0).alias("item_ix"), F.lit(v["kind"]).alias("move_type"), name.alias("item_class"), (geid(1) if v["geid"] else none).alias("item_geid"), F.lit(v["n"]).alias("amount"), *end("src", v["src"]), *end("tgt", v["tgt"]), F.lit(v["action"]).cast("string").alias("action"), F.lit(v["result"]).alias("result")))
    seen = entries("worn", lambda minute, v, n: F.struct(F.lit(1).cast("long").alias("session_id"), F.lit(n).cast("long").alias("line_offset"), F.lit(n).cast("long").alias("seq"), ts(minute), geid(v["geid"]).alias("geid"), name.alias("class_name"), F.lit(v["port"]).alias("port"), F.lit(False).alias("placeholder"), none.alias("parent_geid")))
    resets = entries("reset", lambda minute, v, n: F.struct(ts(minute), F.lit(1).alias("build")))
    boxes = spark.createDataFrame([], "account string, geid string, class_name string")
    return ledger(timeline(moves, seen, resets, boxes), list(kinds))


@query(_held())
def ledger_plays(spark, sf_dir):
    """An account for each event: named and unnamed moves, shortfalls, lost and failed moves, listings, ports, resets, late lines."""
    rows = _played_accounts(spark, sf_dir, "holding")
    return rows.groupBy("account", "kind", "key", "item_class").agg(F.sum("quantity").alias("quantity"), F.count("geid").alias("named"), F.bool_or(F.coalesce("inferred", F.lit(False))).alias("inferred"))


# Dimensions.


def _dimension_lines(spark, sf_dir) -> DataFrame:
    """Changes and names of places, ships flown and fetched, worn items and their parts: a line for each event, a second apart."""
    at = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "view", log_line(at, "Update Inventory Location", "x Landing [0] -> [0]. Location [0] -> [{{k % 10}}]. x"))
        .when(F.col("event_type") == "signup", log_line(at, "RequestLocationInventory", "x Location[N{{k % 3}}]"))
        .when(F.col("event_type") == "purchase", log_line(at, "Vehicle Control Flow", "x releasing control token for 'SHIP_{{k % 7}}_{{700000000000 + k % 20}}' [{{700000000000 + k % 20}}]"))
        .when(F.col("event_type") == "error", log_line(at, "CEntityComponentShipListProvider::SetVehicleSpawningInformations", "x VehicleEntityId: [{{700000000000 + k % 20}}], x"))
        .when(F.col("k") % 3 == 0, log_line(at * 0.3, "AttachmentReceived", "Player[P] Attachment[visor_{{700000000000 + event_id % 50}}, visor_{{k}}, {{700000000000 + event_id % 50}}] Status[persistent] Port[helmet_visor]"))
        .otherwise(log_line(at * 0.3, "AttachmentReceived", "Player[P] Attachment[hat_{{700000000000 + event_id % 50}}, hat_{{k}}, {{700000000000 + event_id % 50}}] Status[persistent] Port[Armor_Helmet]"))
    )
    return events(spark, sf_dir).select((F.col("user_id") % 5).alias("session_id"), F.col("event_id").alias("line_offset"), line.alias("line"))


def _dimension_events(spark, sf_dir) -> DataFrame:
    from ..functions.events import events as parse

    return parse(_dimension_lines(spark, sf_dir)).withColumn("ingest_seq", F.col("session_id"))


@query(f"""WITH x AS (SELECT *, user_id % 5 AS s, lag(event_type) OVER w AS pe, lag(k) OVER w AS pk, lag(event_id) OVER w AS po FROM {E} WHERE event_type IN ('view', 'signup') WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id)),
b AS (SELECT cast(pk % 10 AS VARCHAR) AS location_id, concat('N', k % 3) AS name, s, event_id FROM x WHERE event_type = 'signup' AND pe = 'view' AND event_id - po <= 30 AND pk % 10 <> 0),
f AS (SELECT location_id, arg_min(name, struct_pack(s := s, o := event_id)) AS first FROM b GROUP BY 1)
SELECT f.location_id, f.first AS name, count(*) FILTER (WHERE b.name = f.first) AS evidence_count, count(*) FILTER (WHERE b.name <> f.first) AS conflicts FROM f JOIN b USING (location_id) GROUP BY 1, 2""")
def dim_location_names(spark, sf_dir):
    """The first name of a place stays; later ones agree or conflict."""
    from ..operators.dimensions import location_names

    return location_names(_dimension_events(spark, sf_dir)).select("location_id", "name", "evidence_count", "conflicts")


@query(f"""WITH x AS (SELECT user_id % 5 AS s, event_id AS o, cast(700000000000 + k % 20 AS VARCHAR) AS geid, concat('SHIP_', k % 7) AS cls, event_type AS t, last_value(CASE WHEN event_type = 'view' AND k % 10 <> 0 THEN cast(k % 10 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS here FROM {E})
SELECT geid, arg_max(cls, struct_pack(s := s, o := o)) FILTER (WHERE t = 'purchase') AS class_name, arg_max(here, o) FILTER (WHERE t = 'error' AND here IS NOT NULL) AS retrieved_loc_id, max(o) FILTER (WHERE t = 'error') AS retrieved_at FROM x WHERE t IN ('purchase', 'error') GROUP BY 1""")
def dim_vehicles(spark, sf_dir):
    """Ships by the last class told, and where and when each was last fetched."""
    from ..operators.dimensions import vehicles

    return vehicles(_dimension_events(spark, sf_dir)).select("geid", "class_name", "retrieved_loc_id", (F.unix_seconds("retrieved_ts") - 1_785_542_400).alias("retrieved_at"))


_WORN = f"""(SELECT *, max(CASE WHEN new THEN event_id END) OVER (PARTITION BY s ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, user_id % 5 AS s, cast(700000000000 + event_id % 50 AS VARCHAR) AS geid, k % 3 = 0 AS part,
coalesce(event_id * 300 - lag(event_id) OVER (PARTITION BY user_id % 5 ORDER BY event_id) * 300 >= 1000, true) AS new FROM {E} WHERE event_type = 'click'))"""


@query(f"""SELECT event_id, geid, burst AS burst_id, CASE WHEN part THEN last_value(CASE WHEN NOT part THEN geid END IGNORE NULLS) OVER (PARTITION BY s, burst ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_geid FROM {_WORN}""")
def dim_sightings(spark, sf_dir):
    """Worn items in bursts of less than a second between lines; a part belongs to the item before it."""
    from ..operators.dimensions import sightings

    return sightings(_dimension_events(spark, sf_dir)).select(F.col("line_offset").alias("event_id"), "geid", "burst_id", "parent_geid")


@query(f"""SELECT geid, arg_max(concat(CASE WHEN part THEN 'visor_' ELSE 'hat_' END, k), struct_pack(s := s, o := event_id)) AS class_name, arg_max(CASE WHEN part THEN 'helmet_visor' ELSE 'Armor_Helmet' END, struct_pack(s := s, o := event_id)) AS port FROM {_WORN} GROUP BY 1""")
def dim_attachments(spark, sf_dir):
    from ..operators.dimensions import attachments, sightings

    return attachments(sightings(_dimension_events(spark, sf_dir))).select("geid", "class_name", "port")


@query(f"""SELECT user_id % 5 AS session_id, max(event_id) AS byte_offset, arg_min(cast(k % 10 AS VARCHAR), event_id) FILTER (WHERE event_type = 'view' AND k % 10 <> 0) AS first_loc_id, arg_max(cast(k % 10 AS VARCHAR), event_id) FILTER (WHERE event_type = 'view' AND k % 10 <> 0) AS cur_loc_id, cast(0 AS BIGINT) AS unrecognised FROM {E} GROUP BY 1""")
def dim_sessions(spark, sf_dir):
    from ..functions.events import events as parse
    from ..operators.dimensions import sessions

    lines = _dimension_lines(spark, sf_dir)
    return sessions(lines, parse(lines), "2026-07-16 00:00:00").select("session_id", "byte_offset", "first_loc_id", "cur_loc_id", F.col("unrecognised").cast("long").alias("unrecognised"))


# Chains, scores, names.


@query("""WITH b AS (SELECT s_suppkey, s_suppkey % 6 AS t FROM supplier)
SELECT s_suppkey, CASE t WHEN 0 THEN 'crate > n1' WHEN 1 THEN 'carried on your character' WHEN 2 THEN 'Lootable_Box' WHEN 3 THEN 'crate > n2' WHEN 4 THEN 'in your SHIP_X' ELSE 'container 5' END AS chain,
CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 WHEN 4 THEN 1.0 ELSE 0.6 END AS factor,
CASE t WHEN 1 THEN 'in worn apparel that was never seen being stored anywhere, so assumed still carried' WHEN 2 THEN '''Lootable_Box'' is a lootable container, not a tracked place' WHEN 3 THEN '''crate'' was placed by where you last opened it, not by a recorded move' WHEN 5 THEN 'we have never seen where ''container 5'' itself is kept' ELSE '' END AS caveat FROM b""")
def chain_kinds(spark, sf_dir):
    """Containers that are held, worn, found, opened somewhere, in a ship, unknown: chain, factor, caveat of what is in them."""
    from .holdings import chains

    t = F.col("s_suppkey") % 6
    day = F.lit("2026-08-01").cast("timestamp").alias("since")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", day, F.lit("a").alias("account"), F.lit(None).cast("string").alias("geid"), F.lit("gem").alias("item_class"), F.lit("Container").alias("kind"), t.cast("string").alias("key"))
    crate = spark.createDataFrame([(-1, "a", "0", "crate", "Location", "1")], "s_suppkey long, account string, geid string, item_class string, kind string, key string").withColumn("since", day)
    boxes = spark.createDataFrame([("a", "1", "my_backpack_01", None, "2"), ("a", "2", "Lootable_Box", None, "2"), ("a", "3", "crate", None, "2"), ("a", "4", "PersonalStorage_SHIP_X-7", None, "2")], "account string, geid string, class_name string, capacity long, last_loc_id string")
    places = spark.createDataFrame([("1", "n1"), ("2", "n2")], "location_id string, name string")
    out = chains(rows.unionByName(crate), spark.createDataFrame([], "account string, geid string"), boxes, places).where("s_suppkey >= 0")
    shown = F.array_join(F.transform("chain", lambda x: F.concat(x["label_prefix"], x["label"])), " > ")
    return out.select("s_suppkey", shown.alias("chain"), F.round("chain_factor", 6).alias("factor"), F.array_join("chain_caveats", "; ").alias("caveat"))


_LABELS = ["Helmet (Armor)", "  fps weapon ", "Legs", "legs (armor)", "Power Plant", "Mining Modifier", "Drink", "Char Accessory Eyes", "", "Backpack"]
_WANTED = ["Armor", "Weapons", "Clothing", "Armor", "ShipParts", "Other", "Consumables", "Clothing", "Other", "Armor"]


@query(f"SELECT category, count(*) AS rows FROM (SELECT CASE p_partkey % 11 {' '.join(f'''WHEN {i} THEN '{w}' ''' for i, w in enumerate(_WANTED))} ELSE 'Other' END AS category FROM part) GROUP BY 1")
def item_categories(spark, sf_dir):
    """Type labels, odd in case and blanks, or absent, by category."""
    from .queries import category_counts

    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % 11).cast("int"))
    return category_counts(read(spark, sf_dir, "part").select(label.alias("type_label")))


_RAW = ["RR_HUR_LEO", "rs_mic_l3", "Stanton3_Area_18", "Nyx_Levski", "Pyro6_Ruin", "RR_CRU_L2", "Terra1_X", "plain"]
_KNOWN = [("Everus Harbor", "Hurston"), ("MIC-L3 Endless Odyssey Station", "microTech L3"), ("Area 18", "ArcCorp"), ("Levski", "Delamar"), ("Ruin", "Terminus"), None, None, None]


@query(f"SELECT s_suppkey, CASE s_suppkey % 8 {' '.join(f'''WHEN {i} THEN '{w[0]}' ''' for i, w in enumerate(_KNOWN) if w)} END AS place, CASE s_suppkey % 8 {' '.join(f'''WHEN {i} THEN '{w[1]}' ''' for i, w in enumerate(_KNOWN) if w)} END AS planet FROM supplier")
def known_places(spark, sf_dir):
    from .naming import known_place

    raw = F.get(F.array(*[F.lit(x) for x in _RAW]), (F.col("s_suppkey") % 8).cast("int"))
    return read(spark, sf_dir, "supplier").withColumn("k", known_place(raw)).select("s_suppkey", "k.place", "k.planet")


# Read queries.


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN s_name END AS src_place, CASE WHEN l_linestatus = 'O' THEN p_name END AS tgt_container FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def q_trace(spark, sf_dir):
    """Both ends of every move of one entity, each by its own kind of place."""
    from .queries import trace

    i = read(spark, sf_dir, "lineitem")
    moves = i.select("l_orderkey", "l_linenumber", F.lit("g").alias("item_geid"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("line_offset"), F.col("l_linenumber").alias("item_ix"), F.when(F.col("l_returnflag") == "R", "Location").otherwise("World").alias("src_kind"), F.col("l_suppkey").cast("string").alias("src_key"), F.when(F.col("l_linestatus") == "O", "Container").otherwise("World").alias("tgt_kind"), F.col("l_partkey").cast("string").alias("tgt_key"))
    places = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("location_id"), F.col("s_name").alias("name"))
    boxes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("geid"), F.col("p_name").alias("class_name"))
    return trace(moves, "g", places, boxes).select("l_orderkey", "l_linenumber", "src_place", "tgt_container")


def _places(spark, sf_dir) -> DataFrame:
    """Nations with an even key, as places; each is its own and its region's alias."""
    return read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("place_key"), F.col("n_name").alias("name"), F.concat(F.lit("S"), F.col("n_regionkey")).alias("system"), F.array("n_name").alias("alias_ids"))


@query(f"SELECT n_name AS place_key, concat('S', n_regionkey) AS system FROM nation WHERE n_nationkey % 2 = 0 AND n_name IN (SELECT root_key FROM {H} WHERE root_kind = 'Location')")
def q_stations(spark, sf_dir):
    from .queries import stations

    return stations(_holdings(spark, sf_dir), _places(spark, sf_dir)).select("place_key", "system")


@query(f"SELECT DISTINCT root_key AS location_id FROM {H} WHERE root_kind = 'Location' AND root_key NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def q_orphans(spark, sf_dir):
    from .queries import orphans

    return orphans(_holdings(spark, sf_dir), _places(spark, sf_dir))


@query(f"SELECT root_key AS location_id, cast(sum(quantity) AS BIGINT) AS quantity FROM {H} WHERE root_kind = 'Location' AND root_key NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1")
def q_unnamed_stations(spark, sf_dir):
    from .queries import unnamed_stations

    return unnamed_stations(_holdings(spark, sf_dir), _places(spark, sf_dir).select(F.col("place_key").alias("location_id")))


@query(f"SELECT item_class, cast(sum(quantity) AS BIGINT) AS quantity, max(since) AS last_move, {LABEL} FROM {H} GROUP BY 1")
def q_pool(spark, sf_dir):
    from .queries import pool

    return pool(_holdings(spark, sf_dir).withColumn("caveats", F.array().cast("array<string>"))).drop("caveats")


@query(f"SELECT item_class, root_kind, quantity, CASE root_kind WHEN 'World' THEN concat('crate ', crate, ' → dropped at ', root_key) WHEN 'Ship' THEN concat('crate ', crate, ' → ship ', l_linenumber) ELSE concat('crate ', crate, ' → ', root_key) END AS \"where\" FROM {H} WHERE item_class IN ('part_3', 'part_5')")
def q_search(spark, sf_dir):
    """Holdings by display name and class, of one category, with where each is."""
    from .queries import root_kind, search

    h = _holdings(spark, sf_dir).withColumn("display_name", F.when(F.col("item_class") == "part_3", "Blue RING")).withColumn("type_label", F.lit("Food"))
    both = search(h, "ring", "Consumables").unionByName(search(h, "PART_5", "Consumables")).unionByName(search(h, "ring", "Armor"))
    return both.select("item_class", root_kind().alias("root_kind"), "quantity", "where")


@query("SELECT n_name AS label, r_name AS kind FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(concat(n_name, ' ', r_name)), 'ation') AND contains(lower(concat(n_name, ' ', r_name)), '1') ORDER BY r_name, n_name LIMIT 40")
def q_palette(spark, sf_dir):
    """Every word of the text in label or kind; the first forty are the feature."""
    from .queries import palette

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return palette(n.select(F.col("n_name").alias("label"), F.col("r_name").alias("kind")), "  aTION  1 ")


_BANNERS = [("none", "no logs found"), ("empty", "logs are still empty"), ("wiped", "no lines since the wipe date"), ("old", "logs are of an earlier patch"), ("still since", "no moves since the wipe date"), ("still", "no moves yet"), ("fine", None), ("new", "reading logs")]


@query(" UNION ALL ".join(f"SELECT '{case}' AS case_, {f"'{text}'" if text else "cast(NULL AS VARCHAR)"} AS banner, (SELECT count(*) FROM orders WHERE {"false" if case in ("none", "new") else "true"}) AS files FROM region WHERE r_regionkey = 0" for case, text in _BANNERS))
def q_banner(spark, sf_dir):
    """Each of the reasons for an empty page, on tables that give it."""
    from .queries import banner, health

    o, moves = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day, none = F.col("o_orderdate"), F.lit(None).cast("timestamp")

    def sessions(lines: Column, any_line: Column) -> DataFrame:
        return o.select(lines.alias("last_ts"), any_line.alias("last_line_ts"), F.lit(0).alias("unrecognised"))

    no_moves, no_logs = moves.where("false"), sessions(day, day).where("false")
    cases = {
        "none": (no_logs, no_moves, False, True), "empty": (sessions(none, none), no_moves, True, True), "wiped": (sessions(none, day), moves, True, True), "old": (sessions(none, day), moves, False, True),
        "still since": (sessions(day, day), no_moves, True, True), "still": (sessions(day, day), no_moves, False, True), "fine": (sessions(day, day), moves, True, True), "new": (no_logs, no_moves, False, False),
    }
    out = None
    for case, (s, m, wipe, built) in cases.items():
        row = banner(health(s, m), wipe, built).select(F.lit(case).alias("case_"), "banner", "files")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT metric, round(value, 6) AS value FROM (SELECT 'enrich.geid_coverage' AS metric, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS value FROM lineitem UNION ALL SELECT 'enrich.confirmed_rate', avg(CASE WHEN l_linestatus = 'O' AND l_linenumber > 1 THEN 1.0 ELSE 0.0 END) FROM lineitem
UNION ALL SELECT 'holdings.high_share', avg(CASE WHEN l_discount >= 0.07 THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL SELECT 'holdings.low_share', avg(CASE WHEN l_discount < 0.04 THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL SELECT 'holdings.mean_score', avg(l_discount) FROM lineitem
UNION ALL SELECT 'holdings.inferred_share', avg(CASE WHEN l_tax > 0.05 THEN 1.0 ELSE 0.0 END) FROM lineitem UNION ALL SELECT 'holdings.first_seen_share', avg(CASE WHEN l_tax <= 0.05 AND l_linenumber = 2 THEN 1.0 ELSE 0.0 END) FROM lineitem)""")
def quality_metrics(spark, sf_dir):
    from .quality import enrichment, holding_rates

    i = read(spark, sf_dir, "lineitem")
    moves = i.select(F.when(F.col("l_returnflag") == "R", "g").alias("item_geid"), F.when(F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") == 1, "lost").otherwise("Succeed")).alias("result"))
    rank = F.when(F.col("l_discount") >= 0.07, 2).when(F.col("l_discount") >= 0.04, 1).otherwise(0)
    caveats = F.filter(F.array(F.when(F.col("l_tax") > 0.05, CAVEATS["duplicate_risk"]).when(F.col("l_linenumber") == 2, CAVEATS["first_seen"]), F.when(F.col("l_linenumber") == 3, CAVEATS["dropped"])), lambda x: x.isNotNull())
    holdings = i.select(F.col("l_discount").alias("score"), rank.alias("rank"), caveats.alias("caveats"))
    return enrichment(moves).unionByName(holding_rates(holdings)).select("metric", F.round("value", 6).alias("value"))


# What the account counts and notes.

#: Counters of each play of ACCOUNTS.
COUNTED: list[dict[str, int]] = [
    {"named_moves": 2}, {"class_moves": 1, "class_units": 3, "inferred": 3, "first_seen": 3}, {"named_moves": 1, "class_moves": 1, "class_units": 1, "from_named": 1}, {"failed": 1},
    {"class_moves": 2, "class_units": 7, "inferred": 5, "first_seen": 5, "from_loose": 2}, {"named_moves": 1, "lost": 1}, {"lost": 1, "credited_by_lost": 1}, {"lost": 1, "credited_by_lost": 4},
    {"named_moves": 1, "wiped": 1}, {"named_moves": 1, "used_up": 1}, {"named_moves": 1, "evicted": 1}, {"sightings": 2, "evicted": 1},
    {"class_moves": 1, "class_units": 2, "inferred": 2, "first_seen": 2, "named_moves": 1, "reconciled": 1}, {"source_unknown": 1, "class_moves": 1, "class_units": 1, "inferred": 1, "first_seen": 1}, {"named_moves": 2},
    {"class_moves": 2, "class_units": 5, "inferred": 3, "first_seen": 3, "failed": 1, "from_loose": 2},
]
#: (kind of row, detail, units, whether belief and source agree) of each play.
NOTED: dict[int, list[tuple]] = {
    0: [("check", None, None, True)], 1: [("miss", "NoSource", 3, None)], 4: [("miss", "NoSource", 5, None)], 8: [("reset", "1", 1, None)], 12: [("miss", "NoSource", 2, None)],
    13: [("miss", "SourceNeverSeen", 1, None)], 15: [("miss", "NoSource", 2, None), ("miss", "AlreadyTaken", 1, None)],
}


def _of_plays(values: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT cast(event_id AS VARCHAR) AS account, {v} FROM events WHERE event_id % {len(ACCOUNTS)} = {i}" for i, v in values)


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper()


@query(_of_plays([(i, f"'{name}' AS counter, {n} AS n") for i, counted in enumerate(COUNTED) for name, n in counted.items()]))
def ledger_counters(spark, sf_dir):
    from ..operators.ledger import counters

    return counters(_played_accounts(spark, sf_dir, "stat")).select("account", F.col("detail").alias("counter"), F.col("quantity").alias("n"))


@query(_of_plays([(i, f"'{kind}' AS row_kind, cast({_sql(detail)} AS VARCHAR) AS detail, cast({_sql(n)} AS INTEGER) AS n, cast({_sql(same)} AS BOOLEAN) AS same_place") for i, notes in NOTED.items() for kind, detail, n, same in notes]))
def ledger_notes(spark, sf_dir):
    """Shortfalls by cause, checks of belief against source, resets."""
    return _played_accounts(spark, sf_dir, "miss", "check", "reset").select("account", "row_kind", "detail", F.col("quantity").alias("n"), "same_place")


_UNITS = {name: f"(SELECT sum(n) FROM ({_of_plays([(i, f'{counted[name]} AS n') for i, counted in enumerate(COUNTED) if name in counted])}))" for name in ("class_units", "from_named", "from_loose")}


@query(f"SELECT 'ledger.accounted_rate' AS metric, 1.0 AS value UNION ALL SELECT 'ledger.duplicate_risk_rate', 0.0 UNION ALL SELECT 'ledger.source_hit_rate', round(({_UNITS['from_named']} + {_UNITS['from_loose']}) / {_UNITS['class_units']}, 6) UNION ALL SELECT 'worn.evicted_then_resighted', 0.0")
def ledger_metrics(spark, sf_dir):
    from .quality import ledger_rates

    return ledger_rates(_played_accounts(spark, sf_dir, "stat")).select("metric", F.round("value", 6).alias("value"))


_MISSED = [("NoSource", n, i) for i, n in ((1, 3), (4, 5), (12, 2), (15, 2))] + [("SourceNeverSeen", 1, 13), ("AlreadyTaken", 1, 15)]


@query(f"SELECT cause, 'first seen' AS made_up, cast(sum(n) AS BIGINT) AS units FROM ({_of_plays([(i, f"'{cause}' AS cause, {n} AS n") for cause, n, i in _MISSED])}) GROUP BY 1")
def ledger_misses(spark, sf_dir):
    from .quality import miss_causes

    return miss_causes(_played_accounts(spark, sf_dir, "miss"))


_N = "replace(n_name, '_', ' ')"
_W = f"concat(upper(substr({_N}, 1, 1)), lower(substr({_N}, 2)))"


@query(f"""WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 4 THEN concat('Old ', {_W}) WHEN n_nationkey % 2 = 0 THEN {_W} WHEN n_nationkey % 3 = 0 THEN lower({_N}) WHEN n_nationkey % 3 = 1 THEN concat('old ', {_N}) ELSE {_N} END AS name,
n_nationkey % 6 <> 4 AND (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AS confirmed FROM nation)
SELECT l_linenumber AS line, concat(name, CASE WHEN confirmed THEN '' ELSE ' (unconfirmed)' END) AS "where", cast(count(*) AS BIGINT) AS holdings FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN p ON k = s_nationkey GROUP BY 1, 2""")
def names_in_holdings(spark, sf_dir):
    """Places that the log's routes, places on record and the wiki name alike, otherwise, or alone: confirmed, contested and proposed names in holdings."""
    from .engine import resolve
    from .holdings import where_text

    n = read(spark, sf_dir, "nation").withColumn("place", F.translate("n_name", "_", " "))
    k, key = F.col("n_nationkey"), F.col("n_nationkey").cast("string").alias("location_id")
    listed = F.concat(F.upper(F.substring("place", 1, 1)), F.lower(F.expr("substring(place, 2)")))
    raw = n.select(key, F.concat(F.lit("Stanton"), F.col("n_regionkey") % 4 + 1, F.lit("_"), "n_name").alias("name"))
    route = F.when(k % 3 == 0, F.lower("place")).when(k % 3 == 1, F.concat(F.lit("old "), "place"))
    evidence = n.select(key, F.lit("name").alias("kind"), route.alias("value"), F.lit(2).cast("long").alias("hits"), F.lit(0).cast("timestamp").alias("last_seen")).where("value IS NOT NULL")
    wiki = n.where(k % 2 == 0).select(k.alias("id"), listed.alias("name"), F.lit("stanton").alias("system")).unionByName(n.where(k % 6 == 4).select((k + 1000).alias("id"), F.concat(F.lit("Old "), listed).alias("name"), F.lit("Stanton").alias("system")))
    held = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("me").alias("account"), F.lit("holding").alias("row_kind"), F.lit(None).cast("string").alias("geid"), F.col("l_linenumber").cast("string").alias("item_class"), F.lit(1).alias("quantity"), F.lit("Location").alias("kind"), F.col("s_nationkey").cast("string").alias("key"), F.col("l_shipdate").cast("timestamp").alias("since"), F.lit("Move").alias("arrived_by"), F.lit(True).alias("confirmed"), F.lit(False).alias("inferred"), F.lit(False).alias("duplicate_risk"), F.lit(False).alias("ambiguous"), F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("same_place"))
    none = lambda schema: spark.createDataFrame([], schema)
    tables = {"ledger": held, "location_names": raw, "place_evidence": evidence, "containers": none("account string, geid string, class_name string, capacity long, last_seen timestamp, last_loc_id string, last_loc_ts timestamp"), "updates": none("account string, build int, at timestamp, spawn string, left_from string, reset_at timestamp")}
    out = resolve(tables, "2026-08-02 00:00:00", wiki=wiki)
    return out.groupBy(F.col("item_class").cast("int").alias("line"), where_text(F.col("chain")).alias("where")).agg(F.count("*").alias("holdings"))


@query("""SELECT o_custkey AS build, o_orderdate AS at, o_orderdate + INTERVAL 5 HOUR AS reset_at, date_trunc('day', o_orderdate + INTERVAL 5 HOUR) AS wipe_from FROM orders WHERE o_orderstatus = 'F'""")
def q_resets(spark, sf_dir):
    """Updates that came with a character reset, and the day a wipe date after them counts from."""
    from .queries import resets

    o = read(spark, sf_dir, "orders")
    reset = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS"))
    return resets(o.select(F.col("o_custkey").alias("build"), F.col("o_orderdate").alias("at"), reset.alias("reset_at")))


@query(f"""SELECT concat('ship ', l_linenumber) AS ship, cast(sum(quantity) AS BIGINT) AS quantity, count(*) AS rows, CASE WHEN l_linenumber % 2 = 1 THEN concat('Model ', l_linenumber) END AS label, (SELECT max(ts) FROM events WHERE user_id % 9 = l_linenumber AND event_type = 'error') AS retrieved_ts
FROM {H} WHERE root_kind = 'Ship' GROUP BY l_linenumber""")
def q_ships_named(spark, sf_dir):
    """Ships that hold something, with the label of their class, in any case, and when the newest of the class was fetched."""
    from .queries import ships

    e = read(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SHIP "), F.col("user_id") % 9)).otherwise(F.concat(F.lit("Ship "), F.col("user_id") % 9))
    vehicles = e.select(name.alias("class_name"), F.when(F.col("event_type") == "error", F.col("ts")).alias("retrieved_ts"))
    models = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("Ship "), "n_nationkey").alias("class_name"), F.concat(F.lit("Model "), "n_nationkey").alias("name"))
    return ships(_holdings(spark, sf_dir), vehicles, models).select("ship", "quantity", "rows", "label", "retrieved_ts")


@query("""SELECT cast(n_nationkey AS VARCHAR) AS place_key, n_name AS name, r_name AS system, CASE WHEN bit_count(n_nationkey % 16) >= 2 THEN 'Confirmed' ELSE 'Proposed' END AS status, cast(bit_count(n_nationkey % 16) AS INTEGER) AS support, cast(count(s_suppkey) AS INTEGER) AS aliases
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name, r_name""")
def q_places_listing(spark, sf_dir):
    """Places with their system, status, how many sources agree and how many ids they have."""
    from .queries import places_listing

    ids = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("alias_ids"))
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(ids, "n_nationkey", "left")
    sources = F.col("n_nationkey") % 16
    return places_listing(n.select(F.col("n_nationkey").cast("string").alias("place_key"), F.col("n_name").alias("name"), F.col("r_name").alias("system"), F.when(F.bit_count(sources) >= 2, "Confirmed").otherwise("Proposed").alias("status"), sources.alias("sources"), F.coalesce("alias_ids", F.array().cast("array<string>")).alias("alias_ids")))


@query("""SELECT DISTINCT concat('Place ', event_id % 700) AS name FROM events WHERE user_id % 3 = 1 AND event_type IN ('view', 'signup')""")
def q_suggestions(spark, sf_dir):
    """Names in one system, whatever its case, of types that begin alike."""
    from .queries import suggestions

    e = events(spark, sf_dir)
    system = F.when(F.col("user_id") % 3 == 1, F.when(F.col("user_id") % 2 == 0, "PYRO").otherwise("pyro")).otherwise("Stanton")
    kind = F.when(F.col("event_type") == "view", "Station, orbital").when(F.col("event_type") == "signup", "landing zone").otherwise("Moon of a station")
    return suggestions(e.select(F.concat(F.lit("Place "), F.col("event_id") % 700).alias("name"), system.alias("system"), kind.alias("type")), "Pyro", ["station", "Landing"])


@query("""SELECT cast(s_suppkey AS VARCHAR) AS location_id, CASE WHEN s_suppkey % 4 < 2 THEN concat('Zone ', s_suppkey) ELSE concat('Social ', s_suppkey) END AS name FROM supplier WHERE s_suppkey % 3 <> 0""")
def names_of_game_text(spark, sf_dir):
    """Raw names that the game's text has by their own key, in any case, or by the key of a pattern; a third of the keys is absent."""
    from .naming import game_text_names

    n = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    zone = F.col("s_suppkey") % 4 < 2
    raw = n.select(k.alias("location_id"), F.when(zone, F.concat(F.lit("Stanton1_Z"), k)).otherwise(F.concat(F.lit("AsteroidClusterBase_Pyro_Social_Hub_"), k)).alias("name"))
    text = n.where("s_suppkey % 3 <> 0").select(F.when(zone, F.concat(F.lit("STANTON1_z"), k)).otherwise(F.concat(F.lit("Pyro_SocialStation_"), k)).alias("key"), F.when(zone, F.concat(F.lit("Zone "), k)).otherwise(F.concat(F.lit("Social "), k)).alias("value"))
    return game_text_names(raw, text)


# Scores, caveats, labels.

_S = f"(SELECT *, CASE k % 4 WHEN 0 THEN 'Carry' WHEN 1 THEN 'Drop' ELSE 'Move' END AS how, k % 5 <> 0 AS good, k % 7 = 0 AS guess, k % 2 = 0 AS risk, k % 3 = 0 AS food, CASE WHEN user_id % 2 = 0 THEN 'Location' ELSE 'Container' END AS kind, epoch_us(TIMESTAMP '2024-02-20 00:00:00' - ts) / 1000000 AS age, user_id % 4 = 0 AND ts < TIMESTAMP '2024-01-15 00:00:00' AS old FROM {E})"
_STALE = "food AND how = 'Move' AND kind <> 'Location' AND age > 604800"
_DAYS = "cast(cast(round(age / 86400) AS BIGINT) AS VARCHAR)"
_TEXTS = f"""concat_ws('; ', CASE WHEN NOT good THEN 'the game never confirmed the move that put it here' END, CASE WHEN guess AND risk THEN 'we saw this arrive but never saw where it came from, so it may have been counted twice' WHEN guess THEN 'first seen being moved out of somewhere we had no record of — looted, bought, or there before the logs begin' END,
CASE WHEN how = 'Carry' THEN 'last picked up in hand to use — food, drink and handed-in items are used up without a log line' END, CASE WHEN {_STALE} THEN concat('food, drink and medical items are used up without a log line, and this one has not moved in ', {_DAYS}, ' days — it may be gone') END,
CASE WHEN how = 'Drop' THEN 'dropped on the floor — kept if in a hangar, cleared away anywhere else, and the logs do not say which' END, CASE WHEN old THEN 'placed before the game update to build 7, after which 6 of 8 items checked were not where the ledger had them' END, CASE WHEN age > 2592000 THEN concat('last seen ', {_DAYS}, ' days ago') END, 'in a box')"""
_SCORE = f"(CASE WHEN good THEN 1 ELSE 0.5 END) * (CASE WHEN guess AND risk THEN 0.8 ELSE 1 END) * (CASE WHEN how = 'Carry' THEN 0.5 ELSE 1 END) * (CASE WHEN {_STALE} THEN 0.5 ELSE 1 END) * (CASE WHEN how = 'Drop' THEN 0.3 ELSE 1 END) * (CASE WHEN old THEN 0.25 ELSE 1 END) * 0.9"


@query(f"""SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'High' WHEN s >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence, cast((NOT good)::INT + guess::INT + (how = 'Carry')::INT + ({_STALE})::INT + (how = 'Drop')::INT + (age > 2592000)::INT + old::INT + 1 AS INTEGER) AS caveats, {_TEXTS} AS texts,
CASE WHEN old THEN 'placed before the game update to build 7, after which 6 of 8 items checked were not where the ledger had them' END AS told FROM (SELECT *, {_SCORE} AS s FROM {_S})""")
def holding_scores(spark, sf_dir):
    """Every factor of a score, and the update that weighs most of those since."""
    from .holdings import score

    time = lambda t: F.lit(t).cast("timestamp")
    k, user = F.col("k"), F.col("user_id")
    rows = events(spark, sf_dir).select(
        "event_id", (user % 4).cast("string").alias("account"), F.lit(None).cast("string").alias("geid"), F.when(k % 3 == 0, "food_a").otherwise("gun").alias("item_class"), F.when(user % 2 == 0, "Location").otherwise("Container").alias("kind"), F.col("ts").cast("timestamp").alias("since"),
        F.when(k % 4 == 0, "Carry").when(k % 4 == 1, "Drop").otherwise("Move").alias("arrived_by"), (k % 5 != 0).alias("confirmed"), (k % 7 == 0).alias("inferred"), (k % 2 == 0).alias("duplicate_risk"), F.lit(False).alias("ambiguous"), F.lit(0.9).alias("chain_factor"), F.array(F.lit("in a box")).alias("chain_caveats"),
    )
    none = F.lit(None).cast("string")
    updates = spark.createDataFrame([("0", 7, 0.25, 8, 2, "2024-01-15 00:00:00"), ("0", 8, 0.5, 0, 0, "2024-01-03 00:00:00"), ("0", 9, 0.1, 9, 0, "2024-03-01 00:00:00")], "account string, build int, factor double, checked long, survived long, t string")
    updates = updates.select("*", F.col("t").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("reset_at"), none.alias("spawn"), none.alias("left_from"), F.lit(False).alias("moved"))
    told = F.get(F.filter("caveats", lambda c: c.startswith("placed before")), F.lit(0))
    return score(rows, updates, time("2024-02-20 00:00:00")).select("event_id", F.round("score", 6).alias("score"), "confidence", F.size("caveats").alias("caveats"), F.array_join("caveats", "; ").alias("texts"), told.alias("told"))


_PLAIN = "placed before the game update to build "


@query(f"""SELECT s_suppkey, s_suppkey % 6 = 3 AS moved, CASE s_suppkey % 6 WHEN 0 THEN concat('{_PLAIN}', s_suppkey, ', after which 2 of 5 items checked were not where the ledger had them') WHEN 1 THEN concat('placed before the character reset of 2026-08-01 (game build ', s_suppkey, '), which cleared everything held before it')
WHEN 2 THEN concat('{_PLAIN}', s_suppkey, ', which came without a character reset — the logs do not say where the player spawned after it, and no later move has checked it')
WHEN 3 THEN concat('{_PLAIN}', s_suppkey, ', which came without a character reset — the player spawned somewhere new, and no later move has checked whether stored items stayed put')
WHEN 4 THEN concat('{_PLAIN}', s_suppkey, ', which no later move has checked — the logs do not say where the player logged out before it, so nothing says whether it moved anything')
ELSE concat('{_PLAIN}', s_suppkey, ', which no later move has checked — the player picked up where they had logged out, so nothing says whether it moved anything') END AS caveat FROM supplier""")
def update_texts(spark, sf_dir):
    """Six kinds of updates, told from where the player logged out and spawned, aliases of one place folded."""
    from .holdings import moved_the_player, update_caveat

    t = F.col("s_suppkey") % 6
    u = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("build"), F.when(t == 0, 5).otherwise(3).alias("checked"), F.lit(3).alias("survived"), F.when(t == 1, F.lit("2026-08-01").cast("timestamp")).alias("reset_at"), F.when(t == 2, None).when(t == 3, "9").otherwise("1").alias("spawn"), F.when(t == 4, None).otherwise("2").alias("left_from"))
    places = spark.createDataFrame([("a", ["1", "2"]), ("b", ["9"])], "place_key string, alias_ids array<string>")
    out = moved_the_player(u, places)
    fields = F.struct("build", "checked", "survived", "reset_at", "spawn", "left_from", "moved")
    return out.withColumn("u", fields).select("s_suppkey", "moved", update_caveat(F.col("u")).alias("caveat"))


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query(f"""SELECT ago, count(*) AS n FROM (SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(cast(round(s / 60) AS BIGINT), ' min ago') WHEN s < 86400 THEN concat(cast(round(s / 3600) AS BIGINT), ' h ago') WHEN s < 2592000 THEN concat(cast(round(s / 86400) AS BIGINT), ' d ago') ELSE strftime(ts, '%Y-%m-%d') END AS ago
FROM (SELECT ts, epoch({_NOW}) - floor(epoch(ts)) AS s FROM events)) GROUP BY 1""")
def times_ago(spark, sf_dir):
    from ..functions.scoring import time_ago

    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return read(spark, sf_dir, "events").groupBy(time_ago(F.col("ts").cast("timestamp"), now).alias("ago")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN concat('container ', p_partkey) WHEN p_partkey % 5 = 1 THEN concat(p_size, ' SCU container') WHEN p_partkey % 5 = 2 THEN concat(p_size, '.5 SCU container') WHEN p_partkey % 5 = 3 THEN concat(p_size, ' cSCU container') ELSE concat(p_size, '.25 cSCU container') END AS label FROM part""")
def size_labels(spark, sf_dir):
    """Capacities in micro-SCU, or none, as labels."""
    from ..functions.scoring import size_label

    t, n = F.col("p_partkey") % 5, F.col("p_size").cast("long")
    capacity = F.when(t == 1, n * 1_000_000).when(t == 2, n * 1_000_000 + 500_000).when(t == 3, n * 10_000).when(t == 4, n * 10_000 + 2_500)
    return read(spark, sf_dir, "part").select("p_partkey", size_label(capacity, F.col("p_partkey").cast("string")).alias("label"))


_SYSTEM_RAW = [("Stanton3_Area18", "Stanton"), ("RR_P5_L2", None), ("Pyro_JumpPoint_Nyx", "Pyro"), ("ruins_pyro4b_x", "Pyro"), ("NYX_Levski", "Nyx"), ("stantonish_x", None), ("", None)]


@query(f"SELECT s_suppkey, CASE s_suppkey % {len(_SYSTEM_RAW)} {' '.join(f"WHEN {i} THEN '{w}' " for i, (_, w) in enumerate(_SYSTEM_RAW) if w)} END AS system FROM supplier")
def raw_systems(spark, sf_dir):
    from .naming import system_of_raw

    raw = F.get(F.array(*[F.lit(x) for x, _ in _SYSTEM_RAW]), (F.col("s_suppkey") % len(_SYSTEM_RAW)).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", system_of_raw(raw).alias("system"))


# Names.


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 5 = c_nationkey % 5 AND n_regionkey = c_nationkey % 2) END AS wiki_id FROM customer")
def wiki_lookup(spark, sf_dir):
    """The first wiki row with a name in a system, in any case; an unknown system matches none."""
    from .naming import wiki_place

    n = F.col("c_nationkey")
    names = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("PLACE "), n % 5).alias("name"), F.when(n % 3 != 0, F.concat(F.lit("s"), n % 2)).alias("system"))
    wiki = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Place "), F.col("n_nationkey") % 5).alias("name"), F.concat(F.lit("S"), "n_regionkey").alias("system"))
    return wiki_place(names, wiki).select("c_custkey", "wiki_id")


@query("""WITH d AS (SELECT *, n_nationkey % 2 = 0 AS confirmed, n_nationkey % 3 = 0 AS by_user, n_nationkey % 5 = 0 AS again, n_nationkey % 7 <> 0 AS stored FROM nation)
SELECT n_name AS place_key, CASE WHEN NOT stored THEN 'new' WHEN again AND by_user THEN CASE WHEN confirmed THEN 'old' ELSE 'new' END WHEN again THEN 'new' WHEN by_user OR confirmed THEN 'old' ELSE 'new' END AS name FROM d""")
def decisions_merged(spark, sf_dir):
    """Stored decisions and new ones: a user's counts, a confirmed one is not replaced by an automatic one, otherwise the newer stands."""
    from .naming import merge_decisions

    n, key = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    row = lambda name, status, by_user, at: [F.col("n_name").alias("place_key"), F.lit(name).alias("name"), status.alias("status"), F.lit(1).alias("sources"), F.when(by_user, "user").otherwise("auto").alias("decided_by"), F.lit(at).alias("updated_at")]
    old = n.where("n_nationkey % 7 <> 0").select(*row("old", F.when(key % 2 == 0, "Confirmed").otherwise("Proposed"), key % 3 == 0, 1))
    return merge_decisions(old, n.select(*row("new", F.lit("Proposed"), key % 5 == 0, 2))).select("place_key", "name")


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 3 THEN 'none' ELSE 'stem' END AS match, count(*) AS classes FROM part GROUP BY 1")
def name_matches(spark, sf_dir):
    """Item classes by how the catalogue names them."""
    from .naming import name_coverage

    t, own = F.col("p_partkey") % 4, F.concat(F.lit("gun_k"), F.col("p_partkey"))
    p = read(spark, sf_dir, "part")
    items = p.select(F.when(t == 1, F.concat(own, F.lit("_red"))).when(t == 2, F.concat(own, F.lit("_red_01_x"))).otherwise(own).alias("item_class"))
    names = p.where(t != 3).select(own.alias("class_name"), F.lit("Gun").alias("display_name"))
    return name_coverage(items.unionByName(items), names)


# Captured requests, files, levels, store.

_ASKED = "(k % 6 IN (0, 3, 4, 5))"


@query(f"SELECT count(*) FILTER (WHERE {_ASKED}) AS requests, count(*) FILTER (WHERE {_ASKED} AND event_type <> 'error' AND k % 20 <= 10) AS hit, round(count(*) FILTER (WHERE {_ASKED} AND event_type <> 'error' AND k % 20 <= 10) / count(*) FILTER (WHERE {_ASKED}), 6) AS rate FROM {E}")
def capture(spark, sf_dir):
    """Requests by their shape that became a move within ten seconds; those that move nothing don't count."""
    from .quality import capture_rate

    return capture_rate(*_asked_and_moved(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"SELECT CASE k % 6 WHEN 3 THEN 'Store' WHEN 4 THEN 'Interaction' ELSE 'Move' END AS move_type, count(*) AS n FROM {E} WHERE {_ASKED} AND NOT (event_type <> 'error' AND k % 20 <= 10) GROUP BY 1")
def capture_missed(spark, sf_dir):
    from .quality import missed_requests

    return missed_requests(*_asked_and_moved(spark, sf_dir))


def _asked_and_moved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A request for each event, some of no item, some within a grid or of no move, and a move up to twenty seconds after it, unless it was an error."""
    from ..functions.events import events as parse, request_shapes
    from ..operators.correlate import moves

    e, t = events(spark, sf_dir), F.col("k") % 6
    kind = F.when(t == 1, "Sort").when(t == 2, "Stack").when(t == 3, "Store").when(t == 4, "Interaction").otherwise("Move")
    ask = log_line(F.lit(0), _ADD, added("{{k + 1}}", "{{kind}}", "9:Location:5", _BOX, "part_{{k}}", "C"))
    odd = log_line(F.lit(0), _ADD, added("{{k + 1}}", "{{kind}}", "9:Location:5", _BOX, "NULL", "C"))
    # Every third of the events with k % 6 = 0 asks once more, for no item.
    move = log_line(F.col("k") % 20, _QUEUED, queued("{{k + 1}}", "Move", "9:Location:5", _BOX, "part_{{k}}"))
    line = lambda n, x: F.struct(F.lit(n).cast("long").alias("n"), x.alias("line"))
    rows = F.array(line(0, ask), line(1, F.when(t == 0, odd)), line(2, F.when(F.col("event_type") != "error", move)))
    lines = e.withColumn("kind", kind).select(F.col("event_id").alias("session_id"), F.explode(rows).alias("x")).select("session_id", F.col("x.n").alias("line_offset"), "x.line").where("line IS NOT NULL")
    return request_shapes(lines), moves(parse(lines))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS moves FROM orders")
def session_moves(spark, sf_dir):
    """Sessions with their number of moves, none included."""
    from .queries import moves_per_session

    o = read(spark, sf_dir, "orders").withColumn("session_id", F.col("o_orderkey"))
    return moves_per_session(o, read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("session_id"))).select("o_orderkey", "moves")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def incomplete_files(spark, sf_dir):
    """Files that are there, not live, and not read to their end."""
    from .queries import incomplete

    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/logs/"), "o_orderkey").alias("path"), (F.col("o_orderstatus") == "F").alias("complete"))
    files = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("/logs/"), "l_orderkey").alias("path"), (F.col("l_returnflag") == "R").alias("is_live"))
    return incomplete(o, files).select("o_orderkey")


def _ends(spark, sf_dir) -> tuple[str, str]:
    """The first and the last of the nations that have suppliers."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return tuple(n.agg(F.min("n_name"), F.max("n_name")).first())


def _shelf(spark, sf_dir) -> DataFrame:
    """Two crates in each nation with their own records, what is in five of them, parts of things in the fifth, and loose items."""
    from .analogs import place_chain

    n = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    day = F.lit("2026-08-01").cast("timestamp").alias("since")
    inside = _holdings(spark, sf_dir).where(F.element_at("chain", -1)["kind"] == "Location")
    on = F.transform("chain", lambda x, i: F.when((i == 0) & (x["key"] == "4"), x.withField("label_prefix", F.lit("on "))).otherwise(x))
    inside = inside.withColumn("chain", on)
    row = lambda geid, name, rank, caveats, label, place: [F.lit("me").alias("account"), name.alias("item_class"), F.lit(1).alias("quantity"), place_chain(place).alias("chain"), day, F.lit(rank).alias("rank"), geid.alias("geid"), caveats.alias("caveats"), F.lit(label).alias("type_label")]
    nations = read(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c"))
    crates = nations.select(*row(F.col("c").cast("string"), F.lit("crate"), 2, F.array(F.lit("own")), "Backpack", F.col("n_name")))
    loose = n.select(*row(F.lit(None).cast("string"), F.concat(F.lit("loose_"), F.col("s_suppkey") % 3), 1, F.array(F.concat(F.lit("c"), F.col("s_suppkey") % 2)), "Hat", F.col("n_name")))
    return inside.select(*loose.columns).withColumn("since", F.col("since").cast("timestamp")).unionByName(crates).unionByName(loose)


_NATIONS = "(SELECT min(n_name) AS a, max(n_name) AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey)"
_ENDS = f"((SELECT a FROM {_NATIONS}), (SELECT b FROM {_NATIONS}))"
_AT = f"(SELECT * FROM {H} WHERE root_kind = 'Location' AND root_key IN {_ENDS})"
_KIND = "CASE WHEN l_linenumber = 1 THEN 'Consumables' ELSE 'Other' END"


@query(f"""WITH b AS (SELECT crate, cast(sum(quantity) AS BIGINT) AS inside, string_agg(DISTINCT {_KIND}, ',' ORDER BY {_KIND}) AS kinds, min(rank) AS rank FROM {_AT} GROUP BY 1)
SELECT 'container' AS row, 'crate' AS item_class, cast(c.c AS VARCHAR) AS key, cast(1 AS BIGINT) AS quantity, b.inside, 'High' AS confidence, 'own' AS caveats, concat('Armor', ',', b.kinds) AS categories FROM (SELECT unnest([0, 1]) AS c) c JOIN b ON b.crate = c.c
UNION ALL SELECT 'container', concat(CASE WHEN crate = 4 THEN 'on ' ELSE '' END, 'crate ', crate), cast(crate AS VARCHAR), 1, inside, CASE rank WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END, '', kinds FROM b WHERE crate > 1
UNION ALL SELECT 'item', concat('loose_', s_suppkey % 3), NULL, count(*), NULL, 'Medium', string_agg(DISTINCT concat('c', s_suppkey % 2), ',' ORDER BY concat('c', s_suppkey % 2)), 'Clothing' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN {_ENDS} GROUP BY 2""")
def q_level_rows(spark, sf_dir):
    """One place under two ids: loose items, crates with and without their own record, a thing known by its parts only."""
    from .queries import level

    h = _shelf(spark, sf_dir)
    # Both ids have the two crates; an entity has one record.
    first, last = _ends(spark, sf_dir)
    h = h.where((F.col("item_class") != "crate") | (F.col("chain")[0]["key"] == first))
    return level(h, [("Location", first)], (last,)).select("row", "item_class", "key", "quantity", "inside", "confidence", F.array_join("caveats", ",").alias("caveats"), F.array_join("categories", ",").alias("categories"))


@query(f"""SELECT category, cast(sum(quantity) AS BIGINT) AS quantity FROM (SELECT {_KIND} AS category, quantity FROM {_AT} WHERE root_key = (SELECT a FROM {_NATIONS}) AND crate <> 4 UNION ALL SELECT 'Armor', 2 UNION ALL SELECT 'Clothing', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = (SELECT a FROM {_NATIONS})) GROUP BY 1 HAVING sum(quantity) > 0""")
def q_level_categories(spark, sf_dir):
    """Units at a place by category, parts of things aside."""
    from .queries import level_categories

    return level_categories(_shelf(spark, sf_dir), [("Location", _ends(spark, sf_dir)[0])])


@query(f"SELECT category, count(*) AS rows FROM (SELECT {_KIND} AS category FROM {H} WHERE item_class = 'part_5') GROUP BY 1")
def q_search_categories(spark, sf_dir):
    from .queries import search_categories

    return search_categories(_holdings(spark, sf_dir).withColumn("display_name", F.lit(None).cast("string")), "PART_5")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier) AND (l_linenumber <> 2 OR l_shipdate >= TIMESTAMP '1995-01-01 00:00:00')")
def q_history(spark, sf_dir):
    """One entity's moves since the last reset of each account; one of the accounts had two."""
    from .queries import item_page

    first = read(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    moves = read(spark, sf_dir, "lineitem").select("*", F.col("l_suppkey").cast("string").alias("item_geid"), F.col("l_linenumber").cast("string").alias("account"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_orderkey").alias("line_offset"))
    resets = spark.createDataFrame([("2", "1993-01-01"), ("2", "1995-01-01")], "account string, t string").select("account", F.col("t").cast("timestamp").alias("ts"))
    return item_page(_holdings(spark, sf_dir), moves, str(first), resets)[1].select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"SELECT DISTINCT user_id, k FROM {E} WHERE event_type <> 'view' AND (user_id, k) NOT IN (SELECT user_id, k FROM {E} WHERE event_type = 'view')")
def insert_ignore(spark, sf_dir):
    """Keys that an insert which ignores conflicts adds."""
    from .store import insert_new

    e = events(spark, sf_dir)
    return insert_new(e.where("event_type = 'view'"), e.where("event_type <> 'view'").select("user_id", "k", "event_id"), ["user_id", "k"]).select("user_id", "k")


_BODIES = ["feat(app): show items (#12)\n\n- fix: a crash\nchore: none", "docs: words", "* perf!: faster reads  (#7)\r\nfix:   ", "Fix: one\nfeat: two"]
_TOLD = [[("New", "Show items"), ("Fixed", "A crash")], [], [("Improved", "Faster reads")], [("Fixed", "One"), ("New", "Two")]]


@query(" UNION ALL ".join(f"SELECT concat('v0.', s_suppkey) AS tag, '{kind}' AS kind, '{text}' AS text FROM supplier WHERE s_suppkey % 4 = {i}" for i, told in enumerate(_TOLD) for kind, text in told))
def release_notes(spark, sf_dir):
    from .releases import notes

    return notes(_releases(spark, sf_dir)).select("tag", "kind", "text")


def _releases(spark, sf_dir) -> DataFrame:
    body = F.get(F.array(*[F.lit(x) for x in _BODIES]), (F.col("s_suppkey") % 4).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("v0."), "s_suppkey").alias("tag"), body.alias("body"))


@query("SELECT concat('v0.', s_suppkey) AS tag FROM supplier WHERE s_suppkey % 4 <> 1 AND s_suppkey > 3 AND s_suppkey <= 9 ORDER BY s_suppkey DESC LIMIT 10")
def releases_to_tell(spark, sf_dir):
    """Releases since the last one seen that have notes, the newest first; ten at most are the feature."""
    from .releases import to_tell

    return to_tell(_releases(spark, sf_dir), "0.9.0.0", "0.3").select("tag")
