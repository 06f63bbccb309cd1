"""Holdings as users see them: chains, labels, scores, caveats. All joins and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring as S
from ..functions.text import is_apparel, is_consumable, is_lootable, ship_of_locker

HOPS = 6
LINK = "struct<kind:string,key:string,label:string,item_class:string,label_prefix:string>"


def _link(kind, key, label, item_class, prefix) -> Column:
    cast = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(cast(kind).alias("kind"), cast(key).alias("key"), cast(label).alias("label"), cast(item_class).alias("item_class"), cast(prefix).alias("label_prefix"))


def chains(rows: DataFrame, parents: DataFrame, containers: DataFrame, locations: DataFrame) -> DataFrame:
    """rows (account, kind, key, ...) with ``chain`` (outermost last), ``chain_factor`` and ``chain_caveats``.

    Each of up to six hops asks, by equi-joins on the account and the place's key, what holds the container, and notes what
    it saw; links, factors and caveats are made of the notes in the end. A container that nothing holds ends at where the
    player last opened it, or is unknown; one that is found loot has no place at all.
    """
    about = lambda c: (is_apparel(c), ship_of_locker(c))
    worn, ship = about("item_class")
    held = rows.where("geid IS NOT NULL").select("account", F.col("geid").alias("_g"), F.col("kind").alias("_k"), F.col("key").alias("_key"), F.col("item_class").alias("_c"), worn.alias("_w"), ship.alias("_s"), F.col("since").alias("_since"))
    worn, ship = about("class_name")
    known = containers.select("account", F.col("geid").alias("_g"), F.col("class_name").alias("_c2"), F.col("capacity").alias("_cap"), F.col("last_loc_id").alias("_loc"), worn.alias("_w2"), ship.alias("_s2"))
    boxes = held.join(known, ["account", "_g"], "full").join(parents.select("account", F.col("geid").alias("_g"), F.lit(True).alias("_part")), ["account", "_g"], "left")
    boxes = boxes.select("account", "_g", "_k", "_key", F.coalesce("_c", "_c2").alias("_c"), "_cap", "_loc", "_since", F.coalesce("_w", "_w2", F.lit(False)).alias("_w"), F.coalesce("_s", "_s2").alias("_s"), F.coalesce("_part", F.lit(False)).alias("_part"))
    loot = lambda x: is_lootable(x["cls"])
    out = rows.withColumns({"_nk": F.col("kind"), "_nkey": F.col("key"), "_loop": F.lit(False)})
    for depth in range(HOPS):
        j = out.withColumn("_g", F.when(F.col("_nk") == "Container", F.col("_nkey"))).join(boxes, ["account", "_g"], "left")
        box = F.col("_nk") == "Container"
        before = [(F.col(f"_p{d}.key") == F.col("_nkey")) & (F.col(f"_p{d}.kind") == "Container") for d in range(depth)]
        loop = F.lit(False)
        for x in before:
            loop = loop | F.coalesce(x, F.lit(False))
        note = F.when(F.col("_nk").isNotNull() & ~(box & loop), F.struct(F.col("_nk").alias("kind"), F.col("_nkey").alias("key"), F.lit(depth).alias("depth"), F.col("_c").alias("cls"), F.col("_cap").alias("cap"), F.coalesce("_w", F.lit(False)).alias("worn"), F.col("_s").alias("ship"), F.coalesce("_part", F.lit(False)).alias("part"), F.col("_k").isNotNull().alias("held"), F.col("_loc").alias("loc"), F.col("_since").alias("since")))
        j = j.withColumn(f"_p{depth}", note).withColumn("_loop", F.col("_loop") | F.coalesce(box & loop, F.lit(False)))
        p = F.col(f"_p{depth}")
        onward = (p["kind"] == "Container") & p["ship"].isNull()
        j = j.withColumns({
            "_nk": F.when(onward & p["held"], F.col("_k")).when(onward & p["worn"], "Equipped").when(onward & p["loc"].isNotNull() & ~loot(p), "Location"),
            "_nkey": F.when(onward & p["held"], F.col("_key")).when(onward & p["worn"], "").when(onward & p["loc"].isNotNull() & ~loot(p), F.col("_loc")),
        })
        out = j.drop("_g", "_k", "_key", "_c", "_cap", "_loc", "_since", "_w", "_s", "_part")
    notes = [f"_p{d}" for d in range(HOPS)]
    out = out.withColumn("notes", F.filter(F.array(*notes), lambda x: x.isNotNull())).withColumn("_deep", F.col("_nk").isNotNull()).drop("_nk", "_nkey", *notes)
    # A chain has one place with a name, its last: one join names it.
    last = F.element_at("notes", -1)
    spot = F.when((F.size("notes") > 0) & last["kind"].isin("Location", "World"), last["key"])
    out = out.withColumn("_l", spot).join(locations.select(F.col("location_id").alias("_l"), F.col("name").alias("_name")), "_l", "left")
    name = F.col("_name")
    # Worn apparel is no place: it is never shown, and what is in it is carried.
    hidden = lambda x: (x["kind"] == "Container") & x["ship"].isNull() & ~x["part"] & x["worn"]
    out = out.withColumns({"_carried": F.exists("notes", hidden), "_seen": F.coalesce(F.get(F.reverse(F.filter("notes", lambda x: (x["kind"] == "Container") & x["held"])), F.lit(0))["since"], F.col("since"))})

    def link(x: Column) -> Column:
        kind, key = x["kind"], x["key"]
        box = F.coalesce(x["cls"], S.size_label(x["cap"], key))
        ship = x["ship"].isNotNull()
        spot = F.coalesce(name, F.concat(F.lit("location "), key))
        worn = F.when(F.col("_carried"), "carried on your character").otherwise("equipped on your character")
        text = F.when(kind == "Location", spot).when(kind == "World", F.when(key == "", "dropped in the world").otherwise(spot)).when(kind == "Equipped", worn).when(kind == "LostTrack", "no longer on your character — whereabouts unknown").when(ship, x["ship"]).otherwise(box)
        prefix = F.when((kind == "World") & (key != ""), "dropped at ").when(ship, "in your ").when((kind == "Container") & ~ship & x["part"], "on ").otherwise("")
        return _link(F.when(ship, "Ship").otherwise(kind), key, text, x["cls"], prefix)

    def doubt(total: Column, x: Column) -> Column:
        box = (x["kind"] == "Container") & x["ship"].isNull()
        alone = box & ~x["held"]
        return (
            total * S.factor((x["kind"] == "Location") & name.isNull(), S.UNNAMED_LOCATION) * S.factor(x["kind"] == "LostTrack", S.LOST_TRACK)
            * S.factor(box & (x["depth"] > 0) & ~x["worn"] & ~x["part"], S.CONTAINER_HOP) * S.factor(alone & ~x["worn"] & x["loc"].isNotNull() & ~loot(x), S.OPENED_HERE)
            * S.factor(alone & x["worn"], S.NEVER_PLACED) * S.factor(alone & ~x["worn"] & (x["loc"].isNull() | loot(x)), S.UNKNOWN_CONTAINER)
        )

    def warned(x: Column) -> Column:
        """What is to be said of a place without a name, of lost track, and of a container that nothing holds."""
        alone = (x["kind"] == "Container") & x["ship"].isNull() & ~x["held"]
        label = F.coalesce(x["cls"], S.size_label(x["cap"], x["key"]))
        return (
            F.when((x["kind"] == "Location") & name.isNull(), "this station's id was never paired with a name")
            .when(x["kind"] == "LostTrack", F.concat(F.lit("last seen on your character "), F.date_format("_seen", "yyyy-MM-dd"), F.lit("; a later login no longer listed it, and no log line says where it went")))
            .when(alone & x["worn"], "in worn apparel that was never seen being stored anywhere, so assumed still carried")
            .when(alone & loot(x), F.concat(F.lit("'"), label, F.lit("' is a lootable container, not a tracked place")))
            .when(alone & x["loc"].isNotNull(), F.concat(F.lit("'"), label, F.lit("' was placed by where you last opened it, not by a recorded move")))
            .when(alone, F.concat(F.lit("we have never seen where '"), label, F.lit("' itself is kept")))
        )

    ends = F.array(F.when(F.col("_loop"), "container nesting loops back on itself"), F.when(F.col("_deep"), "container nesting was deeper than we follow"))
    caveats = F.filter(F.concat(F.transform("notes", warned), ends), lambda x: x.isNotNull())

    return out.withColumns({"chain": F.transform(F.filter("notes", lambda x: ~hidden(x)), link), "chain_factor": F.aggregate("notes", F.lit(1.0), doubt), "chain_caveats": caveats}).drop("notes", "_l", "_name", "_loop", "_deep", "_carried", "_seen")


def update_factors(checks: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (account, build, ...) with how many checked placements of their account spanned each, how many held, and the factor.

    A check spans the updates behind its first time up to its second: a stretch of the account's updates in their order. It
    adds one where the stretch begins and takes one where it ends; sums of these, and their prefix over an account's updates,
    are the counts. A check is two steps, however many updates it spans, and steps are summed before they are shuffled.
    """
    times = updates.groupBy("account").agg(F.sort_array(F.collect_set("at")).alias("times"))

    def passed(t: str) -> Column:
        """How many of the account's updates are not after t."""
        after = F.col(t) + F.expr("INTERVAL 1 MICROSECOND")
        return (F.array_position(F.sort_array(F.array_append("times", after)), after) - 1).cast("int")

    held = F.coalesce(F.col("same_place"), F.lit(False)).cast("int")
    spans = checks.where("since < at").join(times, "account").select("account", passed("since").alias("first"), passed("at").alias("end"), held.alias("held")).where("first < end")
    step = lambda i, sign: F.struct(F.col(i).alias("i"), F.lit(sign).alias("checked"), (sign * F.col("held")).alias("survived"))
    every = times.select("account", F.posexplode("times").alias("i", "at"))
    steps = spans.select("account", F.explode(F.array(step("first", 1), step("end", -1))).alias("s")).select("account", "s.*").unionByName(every.select("account", "i", F.lit(0).alias("checked"), F.lit(0).alias("survived")))
    so_far = Window.partitionBy("account").orderBy("i")
    summed = steps.groupBy("account", "i").agg(F.sum("checked").alias("c"), F.sum("survived").alias("s"))
    counts = summed.select("account", "i", F.sum("c").over(so_far).alias("checked"), F.sum("s").over(so_far).alias("survived"))
    by = updates.join(every.join(counts, ["account", "i"]).drop("i"), ["account", "at"], "left").na.fill(0, ["checked", "survived"])
    return by.select(*updates.columns, "checked", "survived").withColumn("factor", S.survival_factor("survived", "checked"))


def moved_the_player(updates: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """updates with ``moved``: whether the player spawned at another place than where they had left; null ends don't count.

    places (place_key, alias_ids) folds the ids of one place.
    """
    out = updates
    for end in ("spawn", "left_from"):
        if places is None:
            out = out.withColumn(f"_{end}", F.col(end))
        else:
            ids = places.select(F.explode("alias_ids").alias(end), F.col("place_key").alias(f"_{end}")).dropDuplicates([end])
            out = out.join(ids, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    moved = F.coalesce((F.col("_spawn") != F.col("_left_from")) & F.col("left_from").isNotNull() & F.col("spawn").isNotNull(), F.lit(False))
    return out.withColumn("moved", moved).drop("_spawn", "_left_from")


def update_caveat(u: Column) -> Column:
    """What is to be said of a placement before an update: (build, checked, survived, reset_at, spawn, left_from, moved)."""
    build = u["build"].cast("string")
    plain = F.concat(F.lit("placed before the game update to build "), build)
    return (
        F.when(u["checked"] >= S.SURVIVAL_LEAST, F.concat(plain, F.lit(", after which "), (u["checked"] - u["survived"]).cast("string"), F.lit(" of "), u["checked"].cast("string"), F.lit(" items checked were not where the ledger had them")))
        .when(u["reset_at"].isNotNull(), F.concat(F.lit("placed before the character reset of "), F.date_format(u["reset_at"], "yyyy-MM-dd"), F.lit(" (game build "), build, F.lit("), which cleared everything held before it")))
        .when(u["spawn"].isNull(), F.concat(plain, F.lit(", which came without a character reset — the logs do not say where the player spawned after it, and no later move has checked it")))
        .when(u["moved"], F.concat(plain, F.lit(", which came without a character reset — the player spawned somewhere new, and no later move has checked whether stored items stayed put")))
        .when(u["left_from"].isNull(), F.concat(plain, F.lit(", which no later move has checked — the logs do not say where the player logged out before it, so nothing says whether it moved anything")))
        .otherwise(F.concat(plain, F.lit(", which no later move has checked — the player picked up where they had logged out, so nothing says whether it moved anything")))
    )


def score(rows: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """rows of chains() with score, confidence and caveats at a given time; updates are those of update_factors() and moved_the_player()."""
    one = F.struct("at", "build", "factor", "checked", "survived", "reset_at", "spawn", "left_from", "moved")
    listed = updates.groupBy("account").agg(F.array_sort(F.collect_list(one)).alias("updates"))
    r = rows.join(listed, "account", "left")
    crossed = F.filter("updates", lambda u: (u["at"] > F.col("since")) & (u["at"] <= as_of))
    r = r.withColumn("crossed", F.coalesce(crossed, F.array().cast(r.schema["updates"].dataType)))
    worst = F.coalesce(F.array_min(F.transform("crossed", lambda u: u["factor"])), F.lit(1.0))
    # Seconds with their fraction: ages are rounded to days, and half a day less an instant is no half day.
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("since"))) / 1_000_000
    stale_food = is_consumable("item_class") & ~F.col("arrived_by").isin("Carry", "Drop") & (F.col("kind") != "Location") & (age > S.SHELF_DAYS * 86400)
    guess = F.col("inferred")
    factors = {
        "unconfirmed": (~F.col("confirmed"), S.UNCONFIRMED), "duplicate_risk": (guess & F.col("duplicate_risk"), S.DUPLICATE_RISK), "first_seen": (guess & ~F.col("duplicate_risk"), 1.0), "carried": (F.col("arrived_by") == "Carry", S.CARRIED),
        "stale_consumable": (stale_food, S.STALE_CONSUMABLE), "dropped": (F.col("arrived_by") == "Drop", S.DROPPED), "stale": (age > S.STALE_DAYS * 86400, 1.0), "ambiguous": (F.col("geid").isNotNull() & F.col("ambiguous"), 1.0),
    }
    total = S.product([S.factor(when, by) for when, by in factors.values()]) * worst * F.col("chain_factor")
    # Of several updates, the one that weighs most is told, the newest of equals.
    weight = lambda u: F.struct((-u["factor"]).alias("f"), u["at"].alias("at"), update_caveat(u).alias("text"))
    told = F.array_max(F.transform("crossed", weight))["text"]
    own = {name: F.when(when, S.caveat(name, age)) for name, (when, _) in factors.items()}
    # An update is told behind what it is about, before the placement's age.
    said = [*(own[n] for n in own if n not in ("stale", "ambiguous")), told, own["stale"], own["ambiguous"]]
    caveats = F.filter(F.concat(F.array(*said), "chain_caveats"), lambda x: x.isNotNull())
    return r.withColumns({"score": total, "confidence": S.confidence_label(S.confidence_rank(total)), "rank": S.confidence_rank(total), "caveats": caveats}).drop("updates", "crossed", "chain_factor", "chain_caveats")


def where_text(chain: Column) -> Column:
    text = F.array_join(F.transform(chain, lambda x: F.concat(x["label_prefix"], x["label"])), " → ")
    return F.when(F.size(chain) == 0, "unknown").otherwise(text)


def root(chain: Column, field: str) -> Column:
    return F.when(F.size(chain) > 0, F.element_at(chain, -1)[field])
