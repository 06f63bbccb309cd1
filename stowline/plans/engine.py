"""From lines to holdings. Tables that others read several times are computed once and kept in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.events import events as parse
from ..operators import dimensions as D, ledger as L
from ..operators.correlate import moves as correlate
from ..sources.gamelog import build_of, discover, read_log, sessions_of
from . import naming as N
from .holdings import chains, moved_the_player, score, update_factors
from .store import cut, keep

#: Fixed value: moves before it are of another game patch.
CUTOFF = "2026-07-16 00:00:00"


def derive(lines: DataFrame, builds: DataFrame, account: str | Column, cutoff: str = CUTOFF, finished: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of lines (session_id, ingest_seq, line_offset, line, ...); builds is (session_id, build).

    account is a name, or a column of the lines that gives one for each session (of their path, say): accounts run in
    parallel. Times of sessions count all lines; events before the cutoff do not count.
    """
    whose = account if isinstance(account, Column) else F.lit(account)
    seq = cut(lines.groupBy("session_id").agg(F.min("ingest_seq").alias("ingest_seq"), F.min(whose).alias("account")))
    number = {"seq": F.col("ingest_seq") * 10_000_000_000 + F.col("line_offset")}
    events = cut(parse(lines).where(F.col("ts") >= F.lit(cutoff).cast("timestamp")).join(seq, "session_id"))
    moves = cut(correlate(events, finished).join(seq, "session_id").withColumns(number))
    seen = cut(D.sightings(events).withColumns(number).join(seq.select("session_id", "account"), "session_id"))
    sessions = cut(D.sessions(lines, events, cutoff).join(builds, "session_id", "left").join(seq.select("session_id", "account"), "session_id"))
    updates = D.game_updates(sessions)
    containers, locations = cut(D.containers(events, moves)), cut(D.location_names(events))
    resets = updates.where("reset_at IS NOT NULL").select("account", F.col("at").alias("ts"), "build")
    timeline = keep(L.timeline(moves, seen, resets, containers), "timeline")
    rows = cut(L.ledger(timeline))
    return {"events": events, "moves": moves, "sightings": seen, "sessions": sessions, "updates": updates, "containers": containers, "vehicles": D.vehicles(events), "attachments": D.attachments(seen), "location_names": locations, "place_evidence": D.place_evidence(events), "resets": resets, "timeline": timeline, "ledger": rows}


def resolve(tables: dict[str, DataFrame], as_of: str, names: DataFrame | None = None, decisions: DataFrame | None = None, text: DataFrame | None = None, wiki: DataFrame | None = None) -> DataFrame:
    """Holdings with chain, score, confidence and caveats at a time.

    Places are called what their sources agree on: routes in the log, the game's text (key, value), places on record and the
    wiki's places (id, name, system), weighed with the decisions stored so far (``naming.decide_places``). A name that is not
    confirmed says so. names (class_name, display_name, type_label) is a catalogue of items, from which each holding gets
    ``display_name`` and ``type_label``.
    """
    rows, spark = tables["ledger"], tables["ledger"].sparkSession
    held = rows.where("row_kind = 'holding'").select("account", "geid", "item_class", "quantity", "kind", "key", "since", "arrived_by", "confirmed", "inferred", "duplicate_risk", "ambiguous")
    parents = rows.where("row_kind = 'parent'").select("account", "geid")
    given = lambda df, schema: df if df is not None else spark.createDataFrame([], schema)
    time = F.lit(as_of).cast("timestamp")
    decided = N.decide_places(tables["location_names"], tables["place_evidence"], given(text, N.TEXT), given(wiki, N.WIKI), given(decisions, N.DECISIONS), time)
    places = cut(N.place_catalogue(tables["location_names"], tables["place_evidence"], decided))
    called = places.select(F.explode("alias_ids").alias("location_id"), F.when(F.col("status") == "Confirmed", F.col("name")).otherwise(F.concat("name", F.lit(" (unconfirmed)"))).alias("name")).dropDuplicates(["location_id"])
    factors = moved_the_player(update_factors(rows.where("row_kind = 'check'"), tables["updates"]), places)
    out = score(chains(held, parents, tables["containers"], called), factors, time)
    if names is None:
        return out.withColumns({"display_name": F.lit(None).cast("string"), "type_label": F.lit(None).cast("string")})
    return N.name_by_stem(out, names).drop("dropped_parts")


def from_folder(spark: SparkSession, folder: str, account: str | Column = "me", cutoff: str = CUTOFF) -> dict[str, DataFrame]:
    """Tables of a folder of logs; all but the live log are finished. account may be a column of ``path``.

    The folder is read once. ``unread`` lists files that could not be read whole; they give no rows.
    """
    files = cut(discover(spark, folder, cutoff))
    raw, unread = read_log(spark, folder)
    lines, ids = sessions_of(raw, files)
    named = files.join(build_of(raw).withColumnRenamed("build", "_b"), "path", "left").select("path", "is_live", F.coalesce("build", "_b").alias("build"))
    ids = cut(ids.join(named, "path").select("session_id", "is_live", "build"))
    found = derive(lines, ids.select("session_id", "build"), account, cutoff, ids.where("NOT is_live").select("session_id"))
    return found | {"unread": unread}
