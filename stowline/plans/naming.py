"""Names by evidence: votes, agreeing sources, decisions, and lookups by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bits of the sources that can propose a place's name.
SOURCES = {"log": 1, "game_text": 2, "known_places": 4, "wiki": 8, "user": 16}
CLEAR_SHARE = 0.75
SYSTEMS = ["Stanton", "Pyro", "Nyx"]


def majority(votes: DataFrame, key: str, value: str, hits: str) -> DataFrame:
    """The value with the most hits for each key; of equal ones the smallest. Sums first, so a hot key is a few rows."""
    total = votes.groupBy(key, value).agg(F.sum(hits).alias(hits))
    return total.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(hits), value))).where("_n = 1").drop("_n")


def clear_majority(votes: DataFrame, key: str, value: str, hits: str, least: float = CLEAR_SHARE) -> DataFrame:
    """Values with at least ``least`` of their key's hits, with that share."""
    total = votes.groupBy(key, value).agg(F.sum(hits).alias(hits))
    shares = total.withColumn("share", F.col(hits) / F.sum(hits).over(Window.partitionBy(key)))
    return shares.where(F.col("share") >= least)


def canonical_places(raw_names: DataFrame, evidence: DataFrame) -> DataFrame:
    """location_id -> canonical id: ids with one raw name, cased or not, are one place; the best attested id stands for all."""
    weight = evidence.groupBy("location_id").agg(F.sum("hits").alias("hits"))
    known = raw_names.join(weight, "location_id", "left").withColumn("fold", F.lower("name")).withColumn("hits", F.coalesce("hits", F.lit(0)))
    best = known.groupBy("fold").agg(F.max("hits").alias("top")).join(known, "fold").where("hits = top").groupBy("fold").agg(F.min("location_id").alias("canonical_id"))
    aliases = known.groupBy("fold").agg(F.array_sort(F.collect_set("location_id")).alias("alias_ids"))
    return known.join(best, "fold").join(aliases, "fold").select("location_id", "canonical_id", "alias_ids", "name")


def resolve_names(proposals: DataFrame) -> DataFrame:
    """proposals (place_key, name, source, rank) -> name, sources, status of each place.

    Names are proposals, whatever their case, with their sources or-ed together; the one with more sources wins, then the better
    rank. It is spelled as the wiki lists it, or as its best proposer does. It is contested if another has two sources and as many,
    and confirmed if it has two and is not.
    """
    spelled = F.coalesce(F.min(F.when(F.col("source") == SOURCES["wiki"], F.col("name"))), F.min_by("name", F.struct("rank", "name")))
    by = proposals.groupBy("place_key", F.lower("name").alias("fold")).agg(spelled.alias("name"), F.bit_or("source").alias("sources"), F.min("rank").alias("rank")).withColumn("support", F.bit_count("sources"))
    w = Window.partitionBy("place_key").orderBy(F.desc("support"), "rank", "fold")
    ranked = by.withColumn("n", F.row_number().over(w)).withColumn("other", F.lead("support").over(w))
    contested = (F.coalesce("other", F.lit(0)) >= 2) & (F.col("other") == F.col("support"))
    return ranked.where("n = 1").select("place_key", "name", "sources", F.when(contested, "Contested").when(F.col("support") >= 2, "Confirmed").otherwise("Proposed").alias("status"))


def merge_decisions(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """Stored decisions with new ones: a user's always counts, an automatic one never replaces a confirmed one.

    Both have (place_key, name, status, sources, decided_by, updated_at); decided_by is ``user`` or ``auto``.
    """
    both = decisions.withColumn("_old", F.lit(1)).unionByName(found.withColumn("_old", F.lit(0)))
    weight = F.struct((F.col("decided_by") == "user").alias("u"), ((F.col("_old") == 1) & (F.col("status") == "Confirmed")).alias("c"), F.col("updated_at").alias("t"), F.col("name").alias("n"))
    row = F.struct(*[c for c in decisions.columns if c != "place_key"])
    return both.groupBy("place_key").agg(F.max_by(row, weight).alias("r")).select("place_key", "r.*")


def name_by_stem(items: DataFrame, names: DataFrame, drop: int = 3, keep: int = 2) -> DataFrame:
    """items (item_class, ...) with the display_name of their class, or of its longest stem that has one.

    Up to ``drop`` trailing parts go, ``keep`` stay. The catalogue is a dimension with a row for each class; each item asks
    for a few stems in one equi-join, folded by the item's class.
    """
    parts = F.split("item_class", "_")
    stems = F.transform(F.sequence(F.lit(0), F.lit(drop)), lambda n: F.struct(n.alias("n"), F.lower(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "_")).alias("stem"), (F.size(parts) - n >= F.when(n == 0, 1).otherwise(keep)).alias("ok")))
    asked = items.select("item_class").distinct().select("item_class", F.explode(stems).alias("s")).where("s.ok")
    extra = [c for c in ("type_label",) if c in names.columns]
    lower = names.groupBy(F.lower("class_name").alias("stem")).agg(F.min("display_name").alias("display_name"), *[F.min_by(c, "display_name").alias(c) for c in extra])
    hit = asked.join(lower, F.col("s.stem") == F.col("stem")).groupBy("item_class").agg(F.min_by("display_name", "s.n").alias("display_name"), *[F.min_by(c, "s.n").alias(c) for c in extra], F.min("s.n").alias("dropped_parts"))
    return items.join(hit, "item_class", "left")


def system_of_raw(raw: Column) -> Column:
    """The star system that a location's raw name speaks of: a jump gate's own side, or the first part that begins with one."""
    low = F.lower(raw)
    jump = F.regexp_extract(low, r"([a-z]+)\d*[-_]?jumppoint[-_]?([a-z]+)", 1)
    tokens = F.filter(F.split(low, "_"), lambda t: t.rlike("^(" + "|".join(s.lower() for s in SYSTEMS) + r")\d*[a-z]?$"))
    token = F.regexp_extract(F.element_at(tokens, 1), r"^([a-z]+?)\d*[a-z]?$", 1)
    return F.initcap(F.when(jump.isin(*[s.lower() for s in SYSTEMS]), jump).when(F.size(tokens) > 0, F.regexp_extract(F.element_at(tokens, 1), "^(" + "|".join(s.lower() for s in SYSTEMS) + ")", 1)).otherwise(F.lit(None)))


def is_system_only(name: Column) -> Column:
    """A route's name that is just a system, alone or with the word system behind it."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+system$", "").isin(*[s.lower() for s in SYSTEMS])


def place_catalogue(raw_names: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each place: canonical id, aliases, name, system, status.

    A decision's name comes first, then what most routes call it, its raw name, and ``near`` the point that clearly most
    arrivals went to; the system is that of the raw name, or most assets'.
    """
    ids = raw_names.join(evidence.select("location_id").distinct(), "location_id", "full").select("location_id", F.coalesce("name", F.lit(None)).alias("name"))
    folded = canonical_places(ids.where("name IS NOT NULL"), evidence)
    place = ids.join(folded.select("location_id", "canonical_id", "alias_ids"), "location_id", "left").select("location_id", F.coalesce("canonical_id", "location_id").alias("place_key"), F.coalesce("alias_ids", F.array("location_id")).alias("alias_ids"), F.col("name").alias("raw"))
    voted = evidence.join(place.select("location_id", "place_key"), "location_id").groupBy("place_key", "kind", F.lower("value").alias("fold")).agg(F.sum("hits").alias("hits"), F.min("value").alias("value"))
    best = majority(voted.where("kind = 'name'"), "place_key", "value", "hits").select("place_key", F.col("value").alias("route_name"))
    system = majority(voted.where("kind = 'system'"), "place_key", "value", "hits").select("place_key", F.col("value").alias("asset_system"))
    near = clear_majority(voted.where("kind = 'arrival'"), "place_key", "value", "hits").select("place_key", F.concat(F.lit("near "), "value").alias("near_name"))
    out = place.groupBy("place_key").agg(F.first("alias_ids").alias("alias_ids"), F.min("raw").alias("raw"))
    for side in (best, system, near, decisions.select("place_key", F.col("name").alias("decided"), "status", "sources")):
        out = out.join(side, "place_key", "left")
    named = out.withColumn("name", F.coalesce("decided", "route_name", "raw", "near_name")).where("name IS NOT NULL")
    return named.select("place_key", "alias_ids", "name", F.coalesce(system_of_raw(F.col("raw")), "asset_system").alias("system"), "raw", F.coalesce("status", F.lit("Proposed")).alias("status"), F.coalesce("sources", F.lit(0)).alias("sources"))


# Planets by system and orbit, station abbreviations, stations by planet and slot, places that fit no pattern.
PLANETS = {
    ("Stanton", 1): "Hurston", ("Stanton", 2): "Crusader", ("Stanton", 3): "ArcCorp", ("Stanton", 4): "microTech", ("Pyro", 1): "Pyro I", ("Pyro", 2): "Monox", ("Pyro", 3): "Bloom",
    ("Pyro", 4): "Pyro IV", ("Pyro", 5): "Pyro V", ("Pyro", 6): "Terminus", ("Nyx", 1): "Nyx I", ("Nyx", 2): "Nyx II", ("Nyx", 3): "Nyx III",
}
BODIES = {"HUR": ("Stanton", 1), "CRU": ("Stanton", 2), "ARC": ("Stanton", 3), "MIC": ("Stanton", 4), "P1": ("Pyro", 1), "P2": ("Pyro", 2), "P3": ("Pyro", 3), "P4": ("Pyro", 4), "P5": ("Pyro", 5), "P6": ("Pyro", 6)}
STATIONS = {
    "HUR_LEO": "Everus Harbor", "HUR_L1": "HUR-L1 Green Glade Station", "HUR_L2": "HUR-L2 Faithful Dream Station", "HUR_L3": "HUR-L3 Thundering Express Station", "HUR_L4": "HUR-L4 Melodic Fields Station", "HUR_L5": "HUR-L5 High Course Station",
    "CRU_LEO": "Seraphim Station", "CRU_L1": "CRU-L1 Ambitious Dream Station", "CRU_L4": "CRU-L4 Shallow Fields Station", "CRU_L5": "CRU-L5 Beautiful Glen Station",
    "ARC_LEO": "Baijini Point", "ARC_L1": "ARC-L1 Wide Forest Station", "ARC_L2": "ARC-L2 Lively Pathway Station", "ARC_L3": "ARC-L3 Modern Express Station", "ARC_L4": "ARC-L4 Faint Glen Station", "ARC_L5": "ARC-L5 Yellow Core Station",
    "MIC_LEO": "Port Tressler", "MIC_L1": "MIC-L1 Shallow Frontier Station", "MIC_L2": "MIC-L2 Long Forest Station", "MIC_L3": "MIC-L3 Endless Odyssey Station", "MIC_L4": "MIC-L4 Red Crossroads Station", "MIC_L5": "MIC-L5 Modern Icarus Station",
    "P2_L4": "Checkmate Station", "P3_LEO": "Orbituary", "P3_L1": "Starlight Service Station", "P3_L3": "Patch City", "P5_L2": "Gaslight", "P5_L4": "Rod's Fuel 'N Supplies", "P5_L5": "Rat's Nest",
    "P6_LEO": "Ruin Station", "P6_L3": "Endgame", "P6_L4": "Dudley & Daughters", "P6_L5": "Megumi Refueling",
}
ONE_OFFS = {"nyx_levski": ("Levski", "Delamar")}
_ZONE, _STATION = r"^([A-Za-z]+)([0-9]+)_(.+)$", r"(?i)^R[RS]_([A-Za-z]+[0-9]?)_(LEO|L[1-5])$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed table as a map of the plan."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def known_place(raw: Column) -> Column:
    """struct(place, planet) of an internal name on record: a landing zone of a planet, a station, or one that fits no pattern."""
    low = F.lower(raw)
    once = F.when(low.isin(*ONE_OFFS), F.struct(_lookup({k: v[0] for k, v in ONE_OFFS.items()}, low).alias("place"), _lookup({k: v[1] for k, v in ONE_OFFS.items()}, low).alias("planet")))
    planet = _lookup({f"{s.lower()}{n}": name for (s, n), name in PLANETS.items()}, F.concat(F.lower(F.regexp_extract(raw, _ZONE, 1)), F.regexp_replace(F.regexp_extract(raw, _ZONE, 2), "^0+(?=[0-9])", "")))
    zone = F.when(raw.rlike(_ZONE) & planet.isNotNull(), F.struct(F.translate(F.regexp_extract(raw, _ZONE, 3), "_", " ").alias("place"), planet.alias("planet")))
    body, slot = F.upper(F.regexp_extract(raw, _STATION, 1)), F.upper(F.regexp_extract(raw, _STATION, 2))
    name, world = _lookup(STATIONS, F.concat_ws("_", body, slot)), _lookup({b: PLANETS[at] for b, at in BODIES.items()}, body)
    station = F.when(raw.rlike(_STATION) & name.isNotNull(), F.struct(name.alias("place"), F.when(slot == "LEO", world).otherwise(F.concat_ws(" ", world, slot)).alias("planet")))
    return F.coalesce(once, zone, station)


def game_text_names(raw_names: DataFrame, text: DataFrame) -> DataFrame:
    """location_id, name: what the game's text (key, value) calls a raw name, by the key itself or by one of its patterns.

    Keys are asked for in order; the first that the text has counts, and a transfer station may be the only child of its key.
    """
    from ..sources.files import only_child

    raw, orbit, jump, social = F.col("name"), r"(?i)^R[RS]_([A-Za-z]+[0-9]?)_LEO$", r"^R[RS]_JP_([A-Z][a-z]+)([A-Z][a-z]+)$", r"(?i)^AsteroidClusterBase_([A-Za-z]+)_Social_[A-Za-z]+_([0-9]+)$"
    part = lambda p, n: F.regexp_extract(raw, p, n)
    number = _lookup({b: str(n) for b, (s, n) in BODIES.items() if s == "Stanton"}, F.upper(part(orbit, 1)))
    transfer = F.concat(F.lit("stanton"), number, F.lit("_transfer"))
    asked = F.array(raw, F.when(raw.rlike(orbit), F.concat(F.lit("rr_"), part(orbit, 1))), F.when(raw.rlike(orbit), transfer), F.when(raw.rlike(jump), F.concat(part(jump, 1), F.lit("_"), part(jump, 2), F.lit("_jpstation"))), F.when(raw.rlike(social), F.concat(part(social, 1), F.lit("_socialstation_"), part(social, 2))))
    keys = raw_names.select("location_id", F.posexplode(asked).alias("n", "k")).where("k IS NOT NULL").withColumn("key", F.lower("k"))
    own = keys.join(text.select(F.lower("key").alias("key"), "value"), "key").select("location_id", "n", "value")
    stems = raw_names.select("location_id", transfer.alias("stem")).where(raw.rlike(orbit) & F.col("stem").isNotNull())
    child = only_child(text, stems).join(text.select(F.lower("key").alias("key"), "value"), "key").join(stems, "stem").select("location_id", F.lit(9).alias("n"), "value")
    return own.unionByName(child).groupBy("location_id").agg(F.min_by("value", "n").alias("name"))


def wiki_place(names: DataFrame, wiki: DataFrame) -> DataFrame:
    """names (name, system, ...) with the first wiki row (id, name, system) of that name in that system; an unknown system matches none."""
    first = wiki.groupBy(F.lower("name").alias("_n"), F.lower("system").alias("_s")).agg(F.min("id").alias("wiki_id"), F.min_by("name", "id").alias("wiki_name"))
    return names.join(first, (F.lower("name") == F.col("_n")) & (F.lower("system") == F.col("_s")), "left").drop("_n", "_s")


def place_proposals(raw_names: DataFrame, evidence: DataFrame, text: DataFrame, wiki: DataFrame) -> DataFrame:
    """(place_key, name, source, rank) from route names, game text, known places and the wiki: what ``resolve_names`` weighs."""
    folded = canonical_places(raw_names, evidence).select("location_id", F.col("canonical_id").alias("place_key"))
    log = majority(evidence.where("kind = 'name'").join(folded, "location_id"), "place_key", "value", "hits").select("place_key", F.col("value").alias("name"), F.lit(SOURCES["log"]).alias("source"), F.lit(0).alias("rank"))
    told = game_text_names(raw_names, text).join(folded, "location_id").select("place_key", "name", F.lit(SOURCES["game_text"]).alias("source"), F.lit(1).alias("rank"))
    known = raw_names.select("location_id", known_place(F.col("name")).alias("k")).where("k IS NOT NULL").join(folded, "location_id").select("place_key", F.col("k.place").alias("name"), F.lit(SOURCES["known_places"]).alias("source"), F.lit(2).alias("rank"))
    found = log.unionByName(told).unionByName(known)
    system = raw_names.select("location_id", system_of_raw(F.col("name")).alias("system")).join(folded, "location_id").groupBy("place_key").agg(F.max("system").alias("system"))
    seconded = wiki_place(found.select("place_key", "name").distinct().join(system, "place_key"), wiki).where("wiki_id IS NOT NULL").select("place_key", F.col("wiki_name").alias("name"), F.lit(SOURCES["wiki"]).alias("source"), F.lit(3).alias("rank"))
    return found.unionByName(seconded).distinct()


#: Columns of stored decisions on names, of the game's text, and of the wiki's places.
DECISIONS, TEXT, WIKI = "place_key string, name string, status string, sources int, decided_by string, updated_at timestamp", "key string, value string", "id long, name string, system string"


def decide_places(raw_names: DataFrame, evidence: DataFrame, text: DataFrame, wiki: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Decisions on the names of all places: those stored, and what the sources say now; a confirmed name stays."""
    found = resolve_names(place_proposals(raw_names, evidence, text, wiki))
    return merge_decisions(decisions, found.select("place_key", "name", "status", F.col("sources").cast("int").alias("sources"), F.lit("auto").alias("decided_by"), now.alias("updated_at")))


def name_coverage(items: DataFrame, names: DataFrame) -> DataFrame:
    """How many item classes are named by their own class, by a stem, and not at all."""
    hit = name_by_stem(items.select("item_class").distinct(), names)
    kind = F.when(F.col("dropped_parts").isNull(), "none").when(F.col("dropped_parts") == 0, "exact").otherwise("stem")
    return hit.groupBy(kind.alias("match")).agg(F.count("*").alias("classes"))
