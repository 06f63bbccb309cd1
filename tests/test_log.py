"""The log pipeline on lines of our own in the log's grammar."""

from pyspark.sql import functions as F

from stowline.functions.events import events, request_shapes
from stowline.functions.text import entity_split, inventory
from stowline.operators import dimensions as D
from stowline.operators.correlate import moves
from stowline.plans.engine import derive, from_folder, resolve
from stowline.sources.gamelog import split_bytes

T = "2026-08-01T10:{m:02d}:{s:02d}.000Z"


def at(m, s=0):
    return T.format(m=m, s=s)


def line(ts, tag, body):
    return f"<{ts}> [Notice] <{tag}> {body}"


def store(ts, req, cls, geid, src="INVALID", tgt="9001:Location:5001", kind="Store"):
    return line(ts, "Inventory Mgmt Request Queued", f"Queued Request[{req}] Type[{kind}] for 'P1' [9001] Source Inventory[{src}] Target Inventory[{tgt}]. Source[NULL] amount[1] rank[]. Target[NULL] amount[0] rank[]. Item[{cls}_{geid}] action[None]. tail")


def class_move(ts, req, cls, n, src, tgt, kind="Move", action="None"):
    return line(ts, "InventoryManagementRequest", f"Queued Request[{req}] Type[{kind}] for 'P1' [9001] Source Inventory[{src}] Target Inventory[{tgt}]. Source[{cls}] amount[{n}] rank[]. Target[NULL] amount[0] rank[]. Item[NONE] action[{action}]. tail")


def add(ts, req, cls, src, tgt, kind="Interaction", caller="Drag"):
    return line(ts, "Add Inventory Management Move", f"New Request[{req}] Player[P1] Type[{kind}] SourceInventory[{src}] TargetInventory[{tgt}] ItemClass[{cls}] StoredEntity[NULL] x Caller[{caller}]")


def done(ts, req, result="succeed"):
    return line(ts, "Inventory Request Completed", f"Request[{req}] Player[P1] Result[{result}] x")


def spawn(ts, req, cls, geid):
    return line(ts, "UnstowPendingEntities", f"Unstow Request[{req}] for 'P1' [9001] finalized spawn of '{cls}_{geid}' [{geid}], 0 remaining")


def worn(ts, cls, geid, port, status="persistent"):
    return line(ts, "AttachmentReceived", f"Player[P1] Attachment[{cls}_{geid}, {cls}, {geid}] Status[{status}] Port[{port}]")


def place(ts, location, landing="0"):
    return line(ts, "Update Inventory Location", f"x Landing [0] -> [{landing}]. Location [0] -> [{location}]. x")


def frame(spark, lines, session=1):
    return spark.createDataFrame([(session, 1, i * 1000, x) for i, x in enumerate(lines)], "session_id long, ingest_seq long, line_offset long, line string")


def tables(spark, lines, builds=((1, 100),)):
    return derive(frame(spark, lines), spark.createDataFrame(list(builds), "session_id long, build int"), "me")


def held(t):
    rows = t["ledger"].where("row_kind = 'holding'").collect()
    return sorted(((r["item_class"], r["geid"], r["quantity"], r["kind"], r["key"]) for r in rows), key=str)


def test_split_bytes():
    data = b"\xef\xbb\xbf<a>\r\nb\xff\n\nlast"
    assert list(split_bytes(data)) == [(0, "<a>"), (8, "b�"), (11, "")]


def test_every_shape(spark):
    long = " ".join(f"[item_with_a_rather_long_name_{i:03d}]" for i in range(60))
    cut = line(at(1), "Add Inventory Management Move", f"New Request[9] Player[P1] Type[Move] SourceInventory[9001:Location:5001] TargetInventory[700000000005:Container:0] ItemClass[{long}")[:1060] + "..."
    lines = [
        store(at(0), 7, "tool_a_01", 700000000001), class_move(at(0), 8, "ammo_a", 3, "9001:Location:5001", "700000000005:Container:0"), class_move(at(0), 9, "x", 1, "9001:Location:5001", "9001:Location:5001", "QueryInventory"),
        add(at(0), 10, "hat_a", "9001:Location:5001", "INVALID", caller="X::AttachItem"), add(at(0), 11, "[a_1] [b_2] [c_3] ", "9001:Location:5001", "700000000005:Container:0", "Move"), cut, add(at(0), 12, "gun", "9001:Location:5001", "INVALID", "Drop"),
        done(at(0), 7), line(at(0), "Player Inventory Request Complete", "Request[7] for 'P1' [9001] Type[Store] Result[Succeed] x"), spawn(at(0), 8, "hat_a", 700000000002), spawn(at(0), 8, "hat_a", "700000000002").replace("[700000000002]", "[700000000009]"),
        line(at(0), "OnInventoryStoreItem", "Entity[hat_a_700000000002 - Class(hat_a) - x] Inventory[9001:Location:5001]"), worn(at(0), "hat_a", 700000000002, "Armor_Helmet"), line(at(0), "Calculate Route", "x Projected Start Location is Name A for route to destination B"),
        line(at(0), "Player Selected Quantum Target - Local", "x has selected point pt_1 as their destination"), line(at(0), "Quantum Drive Arrived - Arrived at Final Destination", "x"), line(at(0), "Streaming", "x Data/ObjectContainers/PU/loc/mod/nyx/y.socpak"),
        line(at(0), "Inventory Token Flow", "x on Inventory[pack_backpack_01_700000000003, 700000000003]"), line(at(0), "Inventory Token Flow", "x on Inventory[PersonalStorage_SHIP_A-000, 700000000004]"), line(at(0), "OnDragInventoryItemModifyTarget", "Source[INVALID] Capacity[-1] x | Target[700000000005:Container:0] Capacity[2000000] x"),
        place(at(0), 5001), line(at(0), "RequestLocationInventory", "x Location[Stanton3_Area18]"), line(at(0), "RequestLocationInventory", "x Location[ ]"), line(at(0), "Vehicle Control Flow", "x releasing control token for 'SHIP_A_700000000006' [700000000006]"),
        line(at(0), "CEntityComponentShipListProvider::SetVehicleSpawningInformations", "x VehicleEntityId: [700000000006], x"), line(at(0), "Channel Disconnected", 'cause=30016 reason="x y" frame=1'), line(at(0), "ReuseChannel", "for 'sc.external.services.character_customizer.v1.CharacterCustomizerService' to x"),
        line(at(0), "New Tag", "Queued Request[9] whatever"), line(at(0), "Inventory Mgmt Request Queued", "Queued Request[9] broken"), "no line", "<2026> [x]",
    ]
    got = {r["line_offset"] // 1000: r for r in events(frame(spark, lines)).collect()}
    kinds = ["ItemMoved", "ItemMoved", None, "MoveRequested", "MoveBatchRequested", "MoveBatchRequested", "MoveRequested", "MoveCompleted", "MoveCompleted", "EntitySpawned", None, "ItemStored", "AttachmentSeen", "PlaceNamed", "QuantumTargetSelected", "QuantumArrived", "PlaceAssetSeen", "ContainerIdentified", "ContainerIdentified", "ContainerCapacitySeen", "LocationChanged", "LocationNamed", None, "VehicleFlown", "VehicleRetrieved", "ChannelDisconnected", "CharacterCreatorOpened", "UnrecognisedMove", "UnrecognisedMove", None, None]
    assert [got[i]["event_kind"] if i in got else None for i in range(len(kinds))] == kinds
    assert (got[0]["item_class"], got[0]["item_geid"], got[0]["request_no"]) == ("tool_a_01", "700000000001", 7)
    assert (got[1]["item_class"], got[1]["item_geid"], got[1]["amount"], got[1]["target"]["key"]) == ("ammo_a", None, 3, "700000000005")
    assert got[4]["classes"] == ["a_1", "b_2", "c_3"] and not got[4]["list_cut"]
    assert got[5]["list_cut"] and got[5]["classes"][0] == "item_with_a_rather_long_name_000"
    assert got[16]["name"] == "Nyx" and got[13]["name"] == "Name A" and got[21]["name"] == "Stanton3_Area18"
    assert got[18]["item_class"] == "PersonalStorage_SHIP_A-000" and got[19]["target_capacity"] == 2000000
    assert request_shapes(frame(spark, lines)).count() == 7


def test_handles(spark):
    df = spark.createDataFrame([("9:Location:5",), ("7:Container:0",), ("INVALID",), ("a:b",), (None,)], "r string").select(inventory("r").alias("i"))
    assert [(r["i"]["kind"], r["i"]["key"]) for r in df.collect()] == [("Location", "5"), ("Container", "7"), ("Invalid", ""), ("Unknown", ""), ("Invalid", "")]
    df = spark.createDataFrame([("a_01_01_745829874584",), ("NULL",), ("a_1",)], "e string").select(entity_split("e").alias("x"))
    assert [r["x"] and tuple(r["x"]) for r in df.collect()] == [("a_01_01", "745829874584"), None, None]


def results(spark, lines, finished=None):
    e = events(frame(spark, lines)).withColumn("ingest_seq", F.lit(1))
    return [(r["move_type"], r["item_class"], r["item_geid"], r["tgt_kind"], r["tgt_key"], r["result"], r["caller"]) for r in moves(e, finished).orderBy("line_offset", "item_ix").collect()]


def test_pairing(spark):
    lines = [
        add(at(0), 5, "hat_a", "9001:Location:5001", "INVALID", caller="X::AttachItem"), class_move(at(0), 5, "hat_a", 1, "9001:Location:5001", "INVALID", "Interaction"), done(at(0, 5), 5), spawn(at(0, 30), 5, "hat_a", 700000000002),
        class_move(at(5), 6, "ammo", 1, "9001:Location:5001", "7:Container:0"), spawn(at(6, 30), 6, "ammo", 700000000003), done(at(8), 6), class_move(at(9), 2, "ammo", 1, "9001:Location:5001", "7:Container:0"), line(at(9, 30), "Channel Disconnected", 'cause=1 reason="x"'), done(at(9, 50), 2, "failed"),
        class_move(at(10), 3, "gun", 1, "9001:Location:5001", "7:Container:0"), line(at(10, 5), "Channel Disconnected", 'cause=1 reason="x"'), place(at(11), 5002), add(at(12), 4, "cup", "7:Container:0", "INVALID", "Drop"),
    ]
    assert results(spark, lines) == [
        ("Interaction", "hat_a", "700000000002", "Equipped", "", "succeed", "X::AttachItem"), ("Move", "ammo", None, "Container", "7", "lost", None), ("Move", "ammo", None, "Container", "7", "failed", None), ("Move", "gun", None, "Container", "7", "lost", None), ("Drop", "cup", None, "World", "5002", None, "Drag"),
    ]


def test_queued_interleaved_is_no_restart(spark):
    lines = [add(at(0), 5, "a", "9:Location:1", "7:Container:0"), add(at(0), 6, "b", "9:Location:1", "7:Container:0"), class_move(at(0), 6, "b", 1, "9:Location:1", "7:Container:0"), class_move(at(0), 5, "a", 1, "9:Location:1", "7:Container:0"), spawn(at(0, 9), 6, "b", 700000000009), done(at(1), 5), done(at(1), 6)]
    assert [(r[1], r[2], r[5]) for r in results(spark, lines)] == [("b", "700000000009", "succeed"), ("a", None, "succeed")]


def test_request_numbers_have_64_bits(spark):
    n = 2**53 + 1
    lines = [place(at(0), 5001), class_move(at(0), n, "ammo", 1, "9:Location:1", "7:Container:0"), class_move(at(0), n + 1, "gun", 1, "9:Location:1", "7:Container:0"), spawn(at(0, 9), n, "ammo", 700000000009), done(at(1), n), add(at(2), 2**31, "cup", "9:Location:1", "7:Container:0", "Drop"), done(at(3), n + 1)]
    assert [(r[1], r[2], r[5]) for r in results(spark, lines)] == [("ammo", "700000000009", "succeed"), ("gun", None, None), ("cup", None, None)]
    assert [r["request_no"] for r in events(frame(spark, lines)).orderBy("line_offset").collect()] == [None, n, n + 1, n, n, 2**31, n + 1]
    assert {r["request_no"] for r in request_shapes(frame(spark, lines)).collect()} == {n, n + 1, 2**31}


def test_dimensions(spark):
    lines = [
        place(at(0), 5001, 77), line(at(0, 10), "RequestLocationInventory", "x Location[Stanton3_Area18]"), place(at(1), 5002), line(at(2), "RequestLocationInventory", "x Location[Late]"),
        line(at(3), "Player Selected Quantum Target - Local", "has selected point mine_1 as their destination"), line(at(4), "Quantum Drive Arrived - Arrived at Final Destination", "x"), place(at(4, 5), 5003), line(at(4, 8), "Calculate Route", "Projected Start Location is Mine One for route to destination B"),
        worn(at(5), "gun", 700000000001, "wep_stocked_1"), worn(at(5), "scope", 700000000002, "optics_attach"), worn(at(5, 30), "hat", 700000000003, "Armor_Helmet"), worn(at(5, 30), "x", 200012345678, "Armor_Helmet"),
    ]
    e = events(frame(spark, lines)).withColumn("ingest_seq", F.lit(1))
    assert {(r["location_id"], r["name"]) for r in D.location_names(e).collect()} == {("5001", "Stanton3_Area18"), ("77", "Stanton3_Area18")}
    assert {(r["location_id"], r["kind"], r["value"], r["hits"]) for r in D.place_evidence(e).collect()} == {("5003", "arrival", "mine_1", 1), ("5003", "name", "Mine One", 1)}
    seen = {r["geid"]: r for r in D.sightings(e).collect()}
    assert seen["700000000002"]["parent_geid"] == "700000000001" and seen["700000000003"]["burst_id"] != seen["700000000001"]["burst_id"] and seen["200012345678"]["placeholder"]


def test_chain_and_score(spark):
    lines = [
        place(at(0), 5001), line(at(0, 5), "RequestLocationInventory", "x Location[Area18]"), line(at(1), "Inventory Token Flow", "x on Inventory[crate_a_700000000005, 700000000005]"),
        store(at(2), 1, "crate_a", 700000000005), done(at(2, 1), 1), store(at(3), 2, "gem", 700000000006, "INVALID", "700000000005:Container:0"), done(at(3, 1), 2),
    ]
    got = {r["item_class"]: r for r in resolve(tables(spark, lines), "2026-08-02 00:00:00").collect()}
    assert [x["label"] for x in got["gem"]["chain"]] == ["crate_a", "Area18 (unconfirmed)"] and got["gem"]["score"] == 1.0 and got["gem"]["confidence"] == "High"
    assert [x["label"] for x in got["crate_a"]["chain"]] == ["Area18 (unconfirmed)"]


def test_folder(spark, tmp_path):
    backup = tmp_path / "logbackups"
    backup.mkdir()
    (backup / "Game Build(12300000) 01 Aug 26 (10 00 00).log").write_bytes(("\r\n".join([store(at(0), 1, "hat", 700000000001), done(at(0, 1), 1), store(at(1), 2, "hat", 700000000001), "half"])).encode())
    (backup / "Game Build(1) 01 Aug 26.log").write_bytes((store(at(0), 1, "old", 700000000009) + "\n").encode())
    (tmp_path / "Game.log").write_bytes((store(at(5), 1, "cup", 700000000002) + "\n").encode())
    t = from_folder(spark, str(tmp_path))
    assert held(t) == [("cup", "700000000002", 1, "Location", "5001"), ("hat", "700000000001", 1, "Location", "5001")]
    assert {(r["item_class"], r["request_no"]): r["result"] for r in t["moves"].collect()} == {("cup", 1): None, ("hat", 1): "succeed", ("hat", 2): "lost"}


def test_a_line_is_taken_apart_and_dated_once(spark):
    from stowline.functions.events import split_lines

    texts = ["<2026-08-01T00:00:00.500Z> [Notice] <Tag> a\x01b", "<2026-08-01T00:00:00.500+02:00> [Notice] <Tag> c", "<2026-08-01T00:00:00.5> [Notice] <Tag> d", "<no time Z> [Notice] <Tag> e", "<Z> [Notice] <Tag> f", "g"]
    found = split_lines(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, line_offset long, line string"))
    got = {r.line_offset: (str(r.ts_), r.rest) for r in found.selectExpr("line_offset", "cast(ts AS string) AS ts_", "rest").collect()}
    assert got == {0: ("2026-08-01 00:00:00.5", "a b"), 1: ("2026-07-31 22:00:00.5", "c"), 2: ("2026-08-01 00:00:00.5", "d")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("+00:00") == 1
