"""The read queries over holdings, moves, places and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import confidence_label, item_category
from .holdings import root, where_text


def chain() -> Column:
    return F.col("chain")


def root_kind() -> Column:
    """Kind of the outermost place."""
    return root(chain(), "kind")


def root_key() -> Column:
    return root(chain(), "key")


def contains_folded(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def by_root(holdings: DataFrame, find: str = "") -> DataFrame:
    """Holdings below their outermost place, places with most units first; ``find`` keeps classes that contain it."""
    h = holdings.where(contains_folded(F.col("item_class"), find)) if find else holdings
    pooled = h.groupBy("account", root_kind().alias("root_kind"), root_key().alias("root_key"), "item_class").agg(F.sum("quantity").alias("quantity"), F.min("rank").alias("rank"), F.max("since").alias("last_move"))
    total = F.sum("quantity").over(Window.partitionBy("account", "root_kind", "root_key"))
    return pooled.withColumn("root_quantity", total).withColumn("confidence", confidence_label(F.col("rank"))).drop("rank").orderBy(F.desc("root_quantity"), "root_kind", "root_key", "item_class")


def trace(moves: DataFrame, geid: str, locations: DataFrame, containers: DataFrame) -> DataFrame:
    """One entity's moves in order, both ends with the name of their own kind of place."""
    m = moves.where(F.col("item_geid") == geid)
    for side in ("src", "tgt"):
        loc = locations.select(F.col("location_id").alias("_l"), F.col("name").alias(f"{side}_place"))
        box = containers.select(F.col("geid").alias("_g"), F.col("class_name").alias(f"{side}_container"))
        m = m.join(loc, (F.col(f"{side}_kind") == "Location") & (F.col(f"{side}_key") == F.col("_l")), "left").drop("_l")
        m = m.join(box, (F.col(f"{side}_kind") == "Container") & (F.col(f"{side}_key") == F.col("_g")), "left").drop("_g")
    return m.orderBy("ts", "line_offset", "item_ix")


def item_history(moves: DataFrame, geid: str, resets: DataFrame) -> DataFrame:
    """One entity's moves since its account's last reset, newest first."""
    last = resets.groupBy("account").agg(F.max("ts").alias("_reset"))
    return moves.where(F.col("item_geid") == geid).join(last, "account", "left").where("_reset IS NULL OR ts >= _reset").drop("_reset").orderBy(F.desc("ts"), F.desc("line_offset"))


def item_page(holdings: DataFrame, moves: DataFrame, geid: str, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One entity: where it is, with score and caveats, and its history."""
    return holdings.where(F.col("geid") == geid), item_history(moves, geid, resets)


def stations(holdings: DataFrame, places: DataFrame) -> DataFrame:
    """Places that hold something, by system and name; aliases are one place."""
    held = holdings.where(root_kind() == "Location").select(root_key().alias("location_id")).distinct()
    ids = places.select("place_key", "name", "system", F.explode("alias_ids").alias("location_id"))
    return ids.join(held, "location_id", "left_semi").select("place_key", "name", "system").distinct().orderBy("system", "name")


def orphans(holdings: DataFrame, places: DataFrame) -> DataFrame:
    """Locations that hold something and are no known place."""
    held = holdings.where(root_kind() == "Location").select(root_key().alias("location_id")).distinct()
    return held.join(places.select(F.explode("alias_ids").alias("location_id")), "location_id", "left_anti")


def _below(holdings: DataFrame, path: list[tuple[str, str]], aliases: tuple[str, ...]) -> DataFrame:
    """Holdings at or below a path, with ``_out``, their chain from the outside in, ``category``, and ``_part``: a part of an item below the level.

    aliases are further keys of the path's first place.
    """
    ends = F.reverse(F.transform(chain(), lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"), F.concat(x["label_prefix"], x["label"]).alias("label"))))
    h, n = holdings.withColumns({"_out": ends, "category": item_category(F.col("type_label"))}), len(path)
    for i, (kind, key) in enumerate(path):
        at = F.get("_out", F.lit(i))
        h = h.where((at["kind"] == kind) & at["key"].isin(key, *(aliases if i == 0 else ())))
    # What is on an item that shows its parts (its link says so) is part of it.
    return h.withColumn("_part", (F.size("_out") > n) & F.coalesce(chain()[0]["label_prefix"] == "on ", F.lit(False)))


def level(holdings: DataFrame, path: list[tuple[str, str]], aliases: tuple[str, ...] = ()) -> DataFrame:
    """What is directly below a path of (kind, key), outermost first: loose items by class, and a row for each thing that holds others.

    A thing's own record says its class, units, date, rank and caveats; without one it counts once and goes by what it
    holds. ``inside`` is all that it holds; categories are its own and those of what it holds, parts aside. Holdings need
    ``type_label``.
    """
    n = len(path)
    below = _below(holdings, path, aliases)
    texts = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    inner = F.col("_out")[n]
    opens = below.where(F.size("_out") > n).groupBy(inner["key"].alias("key")).agg(
        F.min(inner["label"]).alias("_label"), F.sum("quantity").alias("inside"), F.min("rank").alias("_rank"), F.max("since").alias("_since"), texts("caveats").alias("_caveats"),
        F.collect_set(F.when(~F.col("_part"), F.col("category"))).alias("_kinds"), F.collect_set("category").alias("_all"),
    )
    here = below.where(F.size("_out") == n).select("geid", "item_class", "quantity", "rank", F.col("since").alias("last_move"), "caveats", "category")
    both = here.join(opens, F.col("geid") == F.col("key"), "full")
    holder = F.col("key").isNotNull()
    own = F.col("item_class").isNotNull()
    kinds = F.array_union("_kinds", F.when(own, F.array("category")).otherwise(F.array().cast("array<string>")))
    boxes = both.where(holder).select(
        F.lit("container").alias("row"), F.coalesce("item_class", "_label").alias("item_class"), "key", F.when(own, F.col("quantity")).otherwise(1).cast("long").alias("quantity"), "inside",
        F.when(own, F.col("rank")).otherwise(F.col("_rank")).alias("rank"), F.when(own, F.col("last_move")).otherwise(F.col("_since")).alias("last_move"),
        F.when(own, F.col("caveats")).otherwise(F.col("_caveats")).alias("caveats"), F.array_sort(F.when(F.size(kinds) > 0, kinds).otherwise(F.col("_all"))).alias("categories"),
    )
    loose = both.where(~holder).groupBy("item_class").agg(F.sum("quantity").alias("quantity"), F.min("rank").alias("rank"), F.max("last_move").alias("last_move"), texts("caveats").alias("caveats"), F.array_sort(F.collect_set("category")).alias("categories"))
    items = loose.select(F.lit("item").alias("row"), "item_class", F.lit(None).cast("string").alias("key"), "quantity", F.lit(None).cast("long").alias("inside"), "rank", "last_move", "caveats", "categories")
    return items.unionByName(boxes).withColumn("confidence", confidence_label(F.col("rank"))).drop("rank").orderBy(F.lower("item_class"), "key")


def level_categories(holdings: DataFrame, path: list[tuple[str, str]], aliases: tuple[str, ...] = ()) -> DataFrame:
    """Units at or below a path by category; parts of items below the level are no kind of their own."""
    return _below(holdings, path, aliases).where("NOT _part").groupBy("category").agg(F.sum("quantity").alias("quantity"))


def pool(holdings: DataFrame) -> DataFrame:
    """Rows of a class as one: units add up, the newest move, the least confidence, all caveats."""
    by = holdings.groupBy("item_class").agg(F.sum("quantity").alias("quantity"), F.max("since").alias("last_move"), F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("caveats")))).alias("caveats"))
    return by.withColumn("confidence", confidence_label(F.col("rank"))).drop("rank")


def search(holdings: DataFrame, text: str, category: str | None = None) -> DataFrame:
    """Holdings at stations, in ships or dropped, by class or display name; holdings need ``display_name`` and ``type_label``."""
    h = holdings.where(root_kind().isin("Location", "Ship", "World")).withColumn("category", item_category(F.col("type_label")))
    name = F.coalesce("display_name", "item_class")
    h = h.where(contains_folded(name, text) | contains_folded(F.col("item_class"), text))
    h = h.where(F.col("category") == category) if category else h
    return h.withColumn("where", where_text(chain())).orderBy(name, F.desc("since"))


def category_counts(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(item_category(F.col("type_label")).alias("category")).agg(F.count("*").alias("rows"))


def search_categories(holdings: DataFrame, text: str) -> DataFrame:
    """Rows that a search finds, by category."""
    return category_counts(search(holdings, text))


def dropped(holdings: DataFrame, places: DataFrame) -> DataFrame:
    """Dropped items by place, aliases folded, the newest place first."""
    ids = places.select("place_key", "name", F.explode("alias_ids").alias("root_key"))
    d = holdings.where(root_kind() == "World").withColumn("root_key", root_key()).join(ids, "root_key", "left")
    key = F.coalesce("place_key", "root_key")
    return d.groupBy(key.alias("place_key")).agg(F.first("name", ignorenulls=True).alias("name"), F.sum("quantity").alias("quantity"), F.max("since").alias("newest")).orderBy(F.desc("newest"))


def ships(holdings: DataFrame, vehicles: DataFrame, names: DataFrame) -> DataFrame:
    """Ships that hold something, by class whatever its case, with the last time each was fetched."""
    cls = F.lower(root(chain(), "label"))
    s = holdings.where(root_kind() == "Ship").groupBy(cls.alias("ship")).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("rows"))
    out = vehicles.groupBy(F.lower("class_name").alias("ship")).agg(F.max("retrieved_ts").alias("retrieved_ts"))
    label = names.select(F.lower("class_name").alias("ship"), F.col("name").alias("label"))
    return s.join(out, "ship", "left").join(label, "ship", "left").orderBy(F.coalesce("label", "ship"))


def sidebar(holdings: DataFrame) -> DataFrame:
    kind = root_kind()
    return holdings.agg(F.count_distinct(F.when(kind == "Location", root_key())).alias("stations"), F.count_distinct(F.when(kind == "Ship", F.lower(root(chain(), "label")))).alias("ships"), F.coalesce(F.sum(F.when(kind == "World", F.col("quantity"))), F.lit(0)).alias("dropped"))


def palette(entries: DataFrame, text: str, most: int = 40) -> DataFrame:
    """Entries (label, kind) with every word of the text in label or kind; the first ``most`` are the feature."""
    words = F.filter(F.split(F.lower(F.lit(text)), r"\s+"), lambda w: w != "")
    hay = F.lower(F.concat_ws(" ", "label", "kind"))
    return entries.where(F.forall(words, lambda w: F.contains(hay, w))).orderBy("kind", "label").limit(most)


def unnamed_stations(holdings: DataFrame, locations: DataFrame) -> DataFrame:
    at = holdings.where(root_kind() == "Location").withColumn("location_id", root_key())
    return at.join(locations.select("location_id"), "location_id", "left_anti").groupBy("location_id").agg(F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"))


def unknown_containers(holdings: DataFrame) -> DataFrame:
    return holdings.select(F.explode(chain()).alias("c")).where("c.kind = 'Container' AND c.item_class IS NULL").select("c.key", "c.label").distinct()


def nameless_items(holdings: DataFrame) -> DataFrame:
    return holdings.where("display_name IS NULL").select("item_class").distinct()


def moves_by_type(moves: DataFrame) -> DataFrame:
    return moves.groupBy("move_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "move_type")


def moves_per_session(sessions: DataFrame, moves: DataFrame) -> DataFrame:
    """Every session with its number of moves, none included; moves are counted before they are joined."""
    return sessions.join(moves.groupBy("session_id").agg(F.count("*").alias("moves")), "session_id", "left").na.fill(0, ["moves"])


def container_use(moves: DataFrame, containers: DataFrame) -> DataFrame:
    """One row: containers that moves went into, and how many of them are identified."""
    used = moves.where("tgt_kind = 'Container'").select(F.col("tgt_key").alias("geid")).distinct()
    known = containers.select("geid").distinct().withColumn("_known", F.lit(1))
    return used.join(known, "geid", "left").agg(F.count("*").alias("in_use"), F.count("_known").alias("identified"))


def store_summary(moves: DataFrame, sessions: DataFrame, location_names: DataFrame, containers: DataFrame) -> DataFrame:
    """One row: how much of each thing is stored."""
    m = moves.agg(
        F.count("*").alias("moves"), F.count_if(F.lower("result") == "succeed").alias("succeeded"), F.count_if(F.col("result").isNull()).alias("unconfirmed"), F.count_distinct("item_geid").alias("items"),
        F.count_distinct("item_class").alias("classes"), F.count("item_geid").alias("named_moves"), F.count_if(F.col("item_geid").isNull()).alias("class_moves"),
    )
    out = m.crossJoin(container_use(moves, containers))
    for name, df in (("sessions", sessions), ("location_names", location_names), ("containers", containers)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


def incomplete(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions (path, complete) of files (path, is_live) that are still there, not live, and not read to their end."""
    return sessions.where("NOT complete").join(files.where("NOT is_live"), "path", "left_semi")


def health(sessions: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: log files, those with lines since the cutoff, lines that changed shape, the newest line, moves."""
    s = sessions.agg(F.count("*").alias("files"), F.count("last_ts").alias("files_with_lines"), F.coalesce(F.sum("unrecognised"), F.lit(0)).alias("unrecognised"), F.max("last_line_ts").alias("newest_line"))
    return s.crossJoin(moves.agg(F.count("*").alias("moves")))


def banner(health: DataFrame, wipe: bool = False, built: bool = True) -> DataFrame:
    """health() with the one reason why nothing is shown, or none; wipe: whether the user has set a wipe date, built: whether logs were read."""
    since, nothing = F.lit(wipe), F.col("files_with_lines") == 0
    text = (
        F.when(~F.lit(built), "reading logs").when(F.col("files") == 0, "no logs found").when(nothing & F.col("newest_line").isNull(), "logs are still empty")
        .when(nothing & since, "no lines since the wipe date").when(nothing, "logs are of an earlier patch")
        .when((F.col("moves") == 0) & since, "no moves since the wipe date").when(F.col("moves") == 0, "no moves yet")
    )
    return health.withColumn("banner", text)


def resets(updates: DataFrame) -> DataFrame:
    """Character resets, newest first, with the day from which a wipe date that follows them counts."""
    return updates.where("reset_at IS NOT NULL").select("build", "at", "reset_at", F.date_trunc("day", "reset_at").alias("wipe_from")).orderBy(F.desc("at"))


def places_listing(places: DataFrame) -> DataFrame:
    return places.select("place_key", "name", "system", "status", F.bit_count("sources").alias("support"), F.size("alias_ids").alias("aliases")).orderBy("system", "name")


def suggestions(wiki_locations: DataFrame, system: str, types: list[str]) -> DataFrame:
    """Names in a system of types that can store things, by the type's beginning."""
    kind = F.lit(False)
    for t in types:
        kind = kind | F.lower("type").startswith(t.lower())
    return wiki_locations.where((F.lower("system") == system.lower()) & kind).select("name").distinct().orderBy("name")
