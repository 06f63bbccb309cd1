"""Log lines to typed events, by column expressions alone.

One wide row for each event; columns that its kind lacks are null. The event's tag chooses the pattern, so that a line is
matched against its own patterns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import ENTITY, NON_RELOCATING, group, inventory_of, is_holding, ship_of_locker

# Tags and line patterns of the log. (?d): only a line feed ends a line.
SHAPE = r"(?d)^<([^>]+)> \[(\w+)\] <([^>]*)>\s*(.*)$"
QUEUED_TAGS = ["InventoryManagementRequest", "Inventory Mgmt Request Queued"]
ADD_TAG = "Add Inventory Management Move"
QUEUED = (
    r"(?d)^Queued Request\[(\d+)\] Type\[([^\]]*)\] for '([^']*)' \[(\d+)\] Source Inventory\[([^\]]*)\] Target Inventory\[([^\]]*)\]\. "
    r"Source\[([^\]]*)\] amount\[(\d+)\] rank\[[^\]]*\]\. Target\[([^\]]*)\] amount\[\d+\] rank\[[^\]]*\]\. Item\[([^\]]*)\] action\[([^\]]*)\]"
)
_ADD_HEAD = r"(?d)^New [Rr]equest\[(\d+)\] Player\[[^\]]*\] Type\[([^\]]*)\] SourceInventory\[([^\]]*)\] TargetInventory\[([^\]]*)\] "
ADD = _ADD_HEAD + r"ItemClass\[(.*?)\] StoredEntity\[.*?Caller\[([^\]]*)\]"
ADD_LOOSE = _ADD_HEAD + r"ItemClass\[([^\]]*)\].*?Caller\[([^\]]*)\]"
ADD_CUT = _ADD_HEAD + r"ItemClass\[(\[.*)\.\.\.\s*$"
REQUEST_LIKE = r"(?i)^(?:Queued|New) request\[\d+\]"
REQUEST_SHAPE = r"(?id)^(New|Queued) Request\[(\d+)\].*?Type\[([^\]]*)\]"
SPAWN = r"(?d)^Unstow Request\[(\d+)\].*?finalized spawn of '([^']*)' \[(\d{6,})\]"
STORE = r"(?d)^Entity\[([^ \]]+) - Class\(([^)]*)\).*?\] Inventory\[([^\]]*)\]"
ATTACHMENT = r"(?d)^Player\[[^\]]*\] Attachment\[[^,]+, ([^,]+), (\d+)\] Status\[([^\]]*)\] Port\[([^\]]*)\]"
ROUTE = r"(?d)Projected Start Location is (.+?) for route to destination"
TARGET_POINT = r"has selected point (\S+) as their destination"
PLAYER_COMPLETE = r"(?d)^Request\[(\d+)\] for '[^']*' \[\d+\] Type\[[^\]]*\] Result\[([^\]]*)\]"
COMPLETE = r"(?d)^Request\[(\d+)\] Player\[[^\]]*\] Result\[([^\]]*)\]"
TOKEN_FLOW = r"on Inventory\[([A-Za-z0-9_\-]+), (\d{6,})\]"
CAPACITY = r"(?d)^Source\[([^\]]*)\] Capacity\[(-?\d+)\].*?\| Target\[([^\]]*)\] Capacity\[(-?\d+)\]"
LOCATION = r"Landing \[\d+\] -> \[(\d+)\]\. Location \[\d+\] -> \[(\d+)\]"
LOCATION_NAME = r"Location\[([^\]]*)\]"
FLOWN = r"releasing control token for '([^']+)' \[(\d{6,})\]"
RETRIEVED = r"VehicleEntityId: \[(\d{6,})\]"
DISCONNECT = r'(?d)^cause=(\d+) reason="([^"]*)"'
CUSTOMIZER = "'sc.external.services.character_customizer.v1.CharacterCustomizerService'"
ASSETS = "objectcontainers/pu/loc/"
SYSTEMS = ["stanton", "pyro", "nyx"]
#: Characters from the severity on that a line has where the game cut it, about.
CUT_LENGTH = 1000


#: Stands between the groups that one pass of a pattern gives; lines don't have it.
_MARK = "\x01"


def groups(c: Column, pattern: str, n: int, name: str = "") -> Column:
    """The pattern's n groups in an array behind a name, by one pass; where it doesn't match, the text is the only element."""
    body = pattern.replace("(?d)", "")
    whole = f"(?ds){body}.*$" if body.startswith("^") else f"(?ds)^.*?{body}.*$"
    return F.split(F.regexp_replace(c, whole, name + "".join(f"{_MARK}${k}" for k in range(1, n + 1))), _MARK, -1)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is made once a row, whatever is asked of it later: filters don't move below it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def split_lines(lines: DataFrame) -> DataFrame:
    """lines (session_id, line_offset, line) with ts, severity, event_name and rest; others have no event and go."""
    text = F.when(F.contains("line", F.lit(_MARK)), F.translate("line", _MARK, " ")).otherwise(F.col("line"))
    df = held(lines.where(F.col("line").startswith("<")), "_s", groups(text, SHAPE.removesuffix("$"), 4)).where(F.size("_s") > 1)
    part = lambda n: F.get("_s", F.lit(n))
    ts = F.try_to_timestamp(F.when(part(1).endswith("Z"), F.concat(F.left(part(1), F.length(part(1)) - 1), F.lit("+00:00"))).otherwise(part(1)))
    return held(df, "ts", ts).where(F.col("ts").isNotNull()).select(*lines.columns, "ts", part(2).alias("severity"), part(3).alias("event_name"), part(4).alias("rest"))


def _blank(c: Column) -> Column:
    return c.isin("", "NULL", "NONE", "null", "none")


def _classes(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: (x != "") & ~x.isin("NULL", "NONE"))


#: Pattern, number of groups and name of what a tag's lines say.
_BY_TAG = {
    "UnstowPendingEntities": (SPAWN, 3, "spawn"),
    "OnInventoryStoreItem": (STORE, 3, "store"),
    "AttachmentReceived": (ATTACHMENT, 4, "attachment"),
    "Calculate Route": (ROUTE, 1, "route"),
    "Player Selected Quantum Target - Local": (TARGET_POINT, 1, "point"),
    "Player Inventory Request Complete": (PLAYER_COMPLETE, 2, "complete"),
    "Inventory Request Completed": (COMPLETE, 2, "complete"),
    "Inventory Token Flow": (TOKEN_FLOW, 2, "token"),
    "OnDragInventoryItemModifyTarget": (CAPACITY, 4, "capacity"),
    "Update Inventory Location": (LOCATION, 2, "location"),
    "RequestLocationInventory": (LOCATION_NAME, 1, "location name"),
    "Vehicle Control Flow": (FLOWN, 2, "flown"),
    "CEntityComponentShipListProvider::SetVehicleSpawningInformations": (RETRIEVED, 1, "retrieved"),
    "Channel Disconnected": (DISCONNECT, 2, "disconnect"),
}
_NO_PATTERN = ["Quantum Drive Arrived - Arrived at Final Destination", "CreateChannel", "ReuseChannel"]


def _said(tag: Column, rest: Column) -> Column:
    """What a line says: the name of its pattern and the groups. A line is matched against its own tag's patterns only."""
    out = F.when(tag.isin(*QUEUED_TAGS), F.when(rest.startswith("Queued Request["), groups(rest, QUEUED, 11, "queued")))
    out = out.when(tag == ADD_TAG, F.when(rest.rlike(ADD), groups(rest, ADD, 6, "add")).when(rest.rlike(ADD_LOOSE), groups(rest, ADD_LOOSE, 6, "add")).when(rest.rlike(ADD_CUT), groups(rest, ADD_CUT.removesuffix("$"), 5, "cut")))
    for name, (pattern, n, what) in _BY_TAG.items():
        out = out.when(tag == name, groups(rest, pattern, n, what))
    return F.coalesce(out, F.array(F.lit("")))


def events(lines: DataFrame) -> DataFrame:
    """Typed events of lines (session_id, line_offset, line); lines that say nothing are left out.

    Each line's pattern runs once; its groups, and the entity, inventories and classes that they name, are columns of
    their own from which the event is made.
    """
    df = held(split_lines(lines), "p", _said(F.col("event_name"), F.col("rest")))
    tag, rest, p = F.col("event_name"), F.col("rest"), F.col("p")
    of = lambda *tags: tag.isin(*tags)
    get = lambda n: F.get(p, F.lit(n))
    said = F.when(F.size(p) > 1, get(0)).otherwise("")
    is_ = lambda *names: F.col("said").isin(*names)
    df = df.withColumn("said", said)
    entity = F.when(is_("queued"), get(10)).when(is_("spawn"), get(2)).when(is_("store", "token", "flown"), get(1))
    source = F.when(is_("queued"), get(5)).when(is_("add", "cut"), get(3)).when(is_("capacity"), get(1))
    target = F.when(is_("queued"), get(6)).when(is_("add", "cut"), get(4)).when(is_("store", "capacity"), get(3))
    # Queued: the authoritative record of a move. Add: the request behind it, for batches and drops the only record.
    cut_list = F.element_at(F.split(get(5), r"(?<=\])\s*\]", 2), 1)
    listed = F.when(is_("add") & get(5).startswith("["), _classes(get(5))).when(is_("cut"), _classes(cut_list))
    df = held(df, "r", F.struct(groups(F.trim(entity), ENTITY, 2).alias("entity"), F.trim(source).alias("source"), F.trim(target).alias("target"), F.when(is_("add", "cut"), listed).alias("listed")))
    df = held(df, "h", F.struct(F.split("r.source", ":", -1).alias("source"), F.split("r.target", ":", -1).alias("target")))
    handle = lambda side: F.when(F.col(f"r.{side}").isNotNull(), inventory_of(F.col(f"r.{side}"), F.col(f"h.{side}")))
    named = F.when(F.size("r.entity") == 3, F.struct(F.get("r.entity", F.lit(1)).alias("class_name"), F.get("r.entity", F.lit(2)).alias("geid")))
    df = held(df, "x", F.struct(named.alias("entity"), handle("source").alias("source"), handle("target").alias("target")))
    split, source, target, listed = F.col("x.entity"), F.col("x.source"), F.col("x.target"), F.col("r.listed")
    own_geid = F.when(is_("spawn"), split["geid"] == get(3)).otherwise(split["geid"] == get(2))
    q_class = F.when(split.isNotNull(), split["class_name"]).when(~_blank(get(7)), get(7)).when(~_blank(get(10)), get(10))
    body = F.rtrim("line")
    long_enough = F.length(body) - F.instr(body, "[") + 1 >= CUT_LENGTH
    relocating = ~get(2).isin(*NON_RELOCATING)
    readable = long_enough & (get(2) != "Store") & (target["kind"] != "Invalid") & (F.size(listed) > 0)
    batch = get(5).startswith("[") & (get(2) != "Store") & (F.size(listed) > 0)
    locker = ship_of_locker(get(1)).isNotNull()
    known = [*QUEUED_TAGS, ADD_TAG, *_BY_TAG, *_NO_PATTERN]
    path = F.lower(F.regexp_extract("line", r"(?i)objectcontainers/pu/loc/([^\s\"']*)", 1))
    asset = F.element_at(F.filter(F.slice(F.split(path, "/"), 1, 2), lambda x: x.isin(*SYSTEMS)), 1)

    kind = (
        F.when(is_("queued"), F.when(relocating & q_class.isNotNull(), "ItemMoved"))
        .when(of(*QUEUED_TAGS) & rest.startswith("Queued Request["), "UnrecognisedMove")
        .when(is_("add"), F.when(relocating, F.when(batch, "MoveBatchRequested").otherwise("MoveRequested")))
        .when(is_("cut") & ~long_enough, "UnrecognisedMove")
        .when(is_("cut") & ~relocating, F.lit(None))
        .when(is_("cut") & ((get(2) == "Store") | (target["kind"] == "Invalid")), "UnrecognisedMove")
        .when(is_("cut") & ~is_holding(target["kind"]), F.lit(None))
        .when(is_("cut"), F.when(readable, "MoveBatchRequested").otherwise("UnrecognisedMove"))
        .when(of(ADD_TAG), F.when(rest.rlike(REQUEST_LIKE), "UnrecognisedMove"))
        .when(is_("complete"), "MoveCompleted")
        .when(is_("spawn") & own_geid, "EntitySpawned")
        .when(is_("store") & split.isNotNull() & is_holding(target["kind"]), "ItemStored")
        .when(is_("attachment"), "AttachmentSeen")
        .when(is_("route") & (F.trim(get(1)) != ""), "PlaceNamed")
        .when(is_("point"), "QuantumTargetSelected")
        .when(of("Quantum Drive Arrived - Arrived at Final Destination"), "QuantumArrived")
        .when(is_("token") & (locker | own_geid), "ContainerIdentified")
        .when(is_("capacity"), "ContainerCapacitySeen")
        .when(is_("location"), "LocationChanged")
        .when(is_("location name") & (F.trim(get(1)) != ""), "LocationNamed")
        .when(is_("flown") & own_geid, "VehicleFlown")
        .when(is_("retrieved"), "VehicleRetrieved")
        .when(is_("disconnect"), "ChannelDisconnected")
        .when(of("CreateChannel", "ReuseChannel") & rest.contains(CUSTOMIZER), "CharacterCreatorOpened")
        .when(~tag.isin(*known) & rest.rlike(REQUEST_LIKE), "UnrecognisedMove")
    )
    kind = F.coalesce(kind, F.when(F.lower("line").contains(ASSETS) & asset.isNotNull(), "PlaceAssetSeen"))
    df = df.withColumn("event_kind", kind).where(F.col("event_kind").isNotNull())
    k = F.col("event_kind")
    moved, batched, added = k == "ItemMoved", k == "MoveBatchRequested", k.isin("MoveRequested", "MoveBatchRequested")
    name = (
        F.when(k.isin("PlaceNamed", "LocationNamed"), F.trim(get(1))).when(k == "QuantumTargetSelected", get(1)).when(k == "PlaceAssetSeen", F.initcap(asset)).when(k == "UnrecognisedMove", tag).when(k == "ChannelDisconnected", get(2))
    )
    return df.select(
        "session_id", "line_offset", "ts", "event_kind",
        F.when(moved | added | k.isin("MoveCompleted", "EntitySpawned"), get(1)).cast("long").alias("request_no"),
        F.when(moved | added, get(2)).alias("move_type"),
        F.when(moved, get(3)).alias("player"), F.when(moved, get(4)).alias("player_id"),
        F.when(moved, q_class).when(k == "MoveRequested", get(5)).when(k.isin("EntitySpawned", "VehicleFlown"), split["class_name"]).when(k == "ItemStored", get(2)).when(k == "AttachmentSeen", get(1)).when((k == "ContainerIdentified") & locker, get(1)).when(k == "ContainerIdentified", split["class_name"]).alias("item_class"),
        F.when(moved | (k == "ItemStored"), split["geid"]).when(k == "EntitySpawned", get(3)).when(k.isin("AttachmentSeen", "ContainerIdentified", "VehicleFlown"), get(2)).when(k == "VehicleRetrieved", get(1)).alias("item_geid"),
        F.when(moved, get(8)).cast("int").alias("amount"),
        F.when(moved | added | (k == "ContainerCapacitySeen"), source).alias("source"),
        F.when(moved | added | k.isin("ItemStored", "ContainerCapacitySeen"), target).alias("target"),
        F.when(added & is_("add"), get(6)).alias("caller"),
        F.when(moved & ~get(11).isin("", "None"), get(11)).alias("action"),
        F.when(batched, listed).alias("classes"),
        F.when(batched, is_("cut") & ~get(5).rlike(r"(?<=\])\s*\]")).alias("list_cut"),
        F.when(k == "MoveCompleted", get(2)).alias("result"),
        F.when(k == "AttachmentSeen", get(4)).alias("port"), F.when(k == "AttachmentSeen", get(3)).alias("status"),
        name.alias("name"),
        F.when(k == "LocationChanged", get(1)).alias("landing_id"), F.when(k == "LocationChanged", get(2)).alias("location_id"),
        F.when(k == "ContainerCapacitySeen", get(2)).cast("long").alias("source_capacity"), F.when(k == "ContainerCapacitySeen", get(4)).cast("long").alias("target_capacity"),
    )


def request_shapes(lines: DataFrame) -> DataFrame:
    """Request lines by their body alone: what the capture rate is measured against."""
    df = split_lines(lines).where(F.col("rest").rlike(REQUEST_SHAPE))
    return df.select("session_id", "line_offset", "ts", F.regexp_extract("rest", REQUEST_SHAPE, 2).cast("long").alias("request_no"), F.regexp_extract("rest", REQUEST_SHAPE, 3).alias("move_type"), (F.lower(group("rest", REQUEST_SHAPE, 1)) == "new").alias("is_add"), F.col("rest").rlike(r"(?i)ItemClass\[(|null|none)\] ").alias("blank"))
