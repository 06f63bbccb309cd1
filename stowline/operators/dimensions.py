"""Dimensions that events add up to: names, containers, vehicles, attachments, evidence, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import is_part_port, is_placeholder
from ..plans.naming import is_system_only
from .correlate import ARRIVAL_S, ASSET_S, NAME_S, with_location
from .sessions import bursts

BURST_GAP = "INTERVAL 1 SECOND"
_SEQ = ["ingest_seq", "line_offset"]


def _since(a: str, b: str):
    return (F.unix_micros(a) - F.unix_micros(b)) / 1_000_000


def location_bindings(events: DataFrame) -> DataFrame:
    """(session_id, ingest_seq, line_offset, ts, location_id, name): the first name after a change of place, within the window, names its ids."""
    e = events.where(F.col("event_kind").isin("LocationChanged", "LocationNamed"))
    w = Window.partitionBy("session_id").orderBy("line_offset")
    before = F.lag(F.struct("event_kind", "ts", "location_id", "landing_id")).over(w)
    e = e.withColumn("p", before).where("event_kind = 'LocationNamed' AND p.event_kind = 'LocationChanged'").where(_since("ts", "p.ts") <= NAME_S)
    ids = F.array_distinct(F.filter(F.array("p.location_id", "p.landing_id"), lambda x: x != "0"))
    return e.select("session_id", "ingest_seq", "line_offset", "ts", F.explode(ids).alias("location_id"), "name")


def location_names(events: DataFrame) -> DataFrame:
    """The first name of an id stays; evidence counts those that agree, conflicts the others."""
    b = location_bindings(events).groupBy("location_id", "name").agg(F.count("*").alias("n"), F.min(F.struct(*_SEQ)).alias("at"), F.min_by("ts", F.struct(*_SEQ)).alias("ts"))
    out = b.groupBy("location_id").agg(F.min_by(F.struct("name", "ts", "n"), "at").alias("f"), F.sum("n").alias("total"))
    return out.select("location_id", "f.name", F.col("f.ts").alias("first_seen"), F.col("f.n").alias("evidence_count"), (F.col("total") - F.col("f.n")).alias("conflicts"))


def containers(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Class and capacity as last told, last seen, and where the player last was in reach of each, by account."""
    e = with_location(events)
    named = e.where("event_kind = 'ContainerIdentified'").select(F.col("item_geid").alias("geid"), F.col("item_class").alias("class_name"), F.lit(None).cast("long").alias("capacity"), "ts", *_SEQ, "here", "account")
    ends = F.array(F.struct(F.col("source").alias("ref"), F.col("source_capacity").alias("capacity")), F.struct(F.col("target").alias("ref"), F.col("target_capacity").alias("capacity")))
    drag = e.where("event_kind = 'ContainerCapacitySeen'").select(F.explode(ends).alias("x"), "ts", *_SEQ, "here", "account").where("x.ref.kind = 'Container'")
    drag = drag.select(F.col("x.ref.key").alias("geid"), F.lit(None).cast("string").alias("class_name"), F.when(F.col("x.capacity") > 0, F.col("x.capacity")).alias("capacity"), "ts", *_SEQ, "here", "account")
    at = e.select("session_id", "line_offset", "ingest_seq", "here", "account")
    touch = moves.select("session_id", "line_offset", "ts", "src_kind", "src_key", "tgt_kind", "tgt_key").join(at, ["session_id", "line_offset"]).select(F.explode(F.array(F.struct(F.col("src_kind").alias("k"), F.col("src_key").alias("g")), F.struct(F.col("tgt_kind").alias("k"), F.col("tgt_key").alias("g")))).alias("x"), "ts", *_SEQ, "here", "account").where("x.k = 'Container'")
    touch = touch.select(F.col("x.g").alias("geid"), F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("long").alias("capacity"), "ts", *_SEQ, "here", "account")
    seen = named.unionByName(drag).unionByName(touch)
    seq = F.struct(*_SEQ)
    place = F.when(F.col("here").isNotNull(), F.struct("ts", (-F.col("ingest_seq")).alias("s"), (-F.col("line_offset")).alias("o")))
    return seen.groupBy("account", "geid").agg(
        F.max_by("class_name", F.when(F.col("class_name").isNotNull(), seq)).alias("class_name"), F.max("ts").alias("last_seen"), F.max_by("here", place).alias("last_loc_id"),
        F.max_by("ts", place).alias("last_loc_ts"), F.max_by("capacity", F.when(F.col("capacity").isNotNull(), seq)).alias("capacity"),
    )


def vehicles(events: DataFrame) -> DataFrame:
    e = with_location(events).where(F.col("event_kind").isin("VehicleFlown", "VehicleRetrieved"))
    out = F.col("event_kind") == "VehicleRetrieved"
    newest = F.when(out, F.struct("ts", (-F.col("ingest_seq")).alias("s"), (-F.col("line_offset")).alias("o")))
    return e.groupBy(F.col("item_geid").alias("geid")).agg(F.max_by("item_class", F.when(F.col("item_class").isNotNull(), F.struct(*_SEQ))).alias("class_name"), F.max("ts").alias("last_seen"), F.max(F.when(out, F.col("ts"))).alias("retrieved_ts"), F.max_by("here", newest).alias("retrieved_loc_id"))


def sightings(events: DataFrame) -> DataFrame:
    """Persistent attachment lines with their burst, and for parts the item before them in it."""
    seen = events.where("event_kind = 'AttachmentSeen' AND status = 'persistent'").select("session_id", "ingest_seq", "line_offset", "ts", F.col("item_geid").alias("geid"), F.col("item_class").alias("class_name"), "port", is_placeholder("item_geid").alias("placeholder"))
    b = bursts(seen, "session_id", "line_offset", "ts", F.expr(BURST_GAP))
    w = Window.partitionBy("session_id", "burst_id").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(~is_part_port("port"), F.col("geid")), ignorenulls=True).over(w)
    return b.withColumn("parent_geid", F.when(is_part_port("port"), parent))


def attachments(seen: DataFrame) -> DataFrame:
    seq = F.struct(*_SEQ)
    return seen.where("NOT placeholder").groupBy("geid").agg(F.max_by("class_name", seq).alias("class_name"), F.max_by("port", seq).alias("port"), F.max("ts").alias("last_seen"))


def place_evidence(events: DataFrame) -> DataFrame:
    """(location_id, kind, value, hits, last_seen): route names, systems of assets, and quantum points of arrivals."""
    e = with_location(events)
    names = e.where("event_kind = 'PlaceNamed' AND here IS NOT NULL").where(~is_system_only(F.col("name"))).select(F.col("here").alias("location_id"), F.lit("name").alias("kind"), F.col("name").alias("value"), "ts")
    assets = e.where("event_kind = 'PlaceAssetSeen' AND here IS NOT NULL").where(_since("ts", "here_since") <= ASSET_S).select(F.col("here").alias("location_id"), F.lit("system").alias("kind"), F.col("name").alias("value"), "ts")
    w = Window.partitionBy("session_id").orderBy("line_offset")
    change = (F.col("event_kind") == "LocationChanged") & ((F.col("location_id") != "0") | (F.col("landing_id") != "0"))
    jumps = e.where(F.col("event_kind").isin("QuantumTargetSelected", "QuantumArrived") | change)
    point = F.last(F.when(F.col("event_kind") == "QuantumTargetSelected", F.col("name")), ignorenulls=True).over(w)
    jumps = jumps.withColumn("point", point).withColumn("p", F.lag(F.struct("event_kind", "ts")).over(w))
    arrived = jumps.where("event_kind = 'LocationChanged' AND p.event_kind = 'QuantumArrived' AND point IS NOT NULL").where((_since("ts", "p.ts") <= ARRIVAL_S) & ~F.lower("point").startswith("mission_"))
    arrived = arrived.select(F.coalesce(F.when(F.col("location_id") != "0", F.col("location_id")), "landing_id").alias("location_id"), F.lit("arrival").alias("kind"), F.col("point").alias("value"), "ts")
    return names.unionByName(assets).unionByName(arrived).groupBy("location_id", "kind", "value").agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))


def sessions(lines: DataFrame, events: DataFrame, cutoff: str) -> DataFrame:
    """A row for each session: first and last times, drift count, places, character reset."""
    from ..functions.events import split_lines

    shaped = split_lines(lines)
    cut = F.lit(cutoff).cast("timestamp")
    a = shaped.groupBy("session_id").agg(F.min_by("ts", "line_offset").alias("first_ts"), F.max_by(F.when(F.col("ts") >= cut, F.col("ts")), F.when(F.col("ts") >= cut, F.col("line_offset"))).alias("last_ts"), F.max("ts").alias("last_line_ts"), F.max("line_offset").alias("byte_offset"))
    to = F.when(F.col("location_id") != "0", F.col("location_id")).when(F.col("landing_id") != "0", F.col("landing_id"))
    e = events.withColumn("to", to)
    at = F.when(F.col("to").isNotNull(), F.col("line_offset"))
    creator = F.when(F.col("event_kind") == "CharacterCreatorOpened", F.struct("line_offset", "ts"))
    b = e.groupBy("session_id").agg(F.count_if((F.col("event_kind") == "UnrecognisedMove") | F.coalesce("list_cut", F.lit(False))).alias("unrecognised"), F.max_by(F.struct("to", "ts"), at).alias("cur"), F.min_by(F.struct("to", "ts", "line_offset"), at).alias("first"), F.min(creator).alias("creator"))
    reset = F.when(F.col("first").isNull() | (F.col("creator.line_offset") < F.col("first.line_offset")), F.col("creator.ts"))
    return a.join(b, "session_id", "left").select("session_id", "first_ts", "last_ts", "last_line_ts", "byte_offset", F.coalesce("unrecognised", F.lit(0)).alias("unrecognised"), F.col("cur.to").alias("cur_loc_id"), F.col("cur.ts").alias("cur_loc_since"), F.col("first.to").alias("first_loc_id"), F.col("first.ts").alias("first_loc_since"), reset.alias("char_reset_at"))


def game_updates(sessions_with_build: DataFrame) -> DataFrame:
    """Builds of each account by their first time played, where they are newer than all before and not the first: (account, build, at, spawn, left_from, reset_at).

    A row for each build is all that is ordered; sessions are summed first.
    """
    s = sessions_with_build.where("build IS NOT NULL").withColumn("at", F.coalesce("first_ts", "last_line_ts"))
    by = s.groupBy("account", "build").agg(F.min("at").alias("at"), F.min_by("first_loc_id", F.when(F.col("first_loc_id").isNotNull(), F.col("at"))).alias("spawn"), F.min("char_reset_at").alias("reset_at"), F.max_by("cur_loc_id", F.when(F.col("cur_loc_id").isNotNull(), F.col("at"))).alias("last_place"))
    w = Window.partitionBy("account").orderBy("at", "build").rowsBetween(Window.unboundedPreceding, -1)
    out = by.withColumn("best", F.max("build").over(w)).withColumn("left_from", F.last("last_place", ignorenulls=True).over(w))
    return out.where("best IS NOT NULL AND build > best").select("account", "build", "at", "spawn", "left_from", "reset_at")
