"""Queries over the star-schema tables, one for each relational operator of the ledger engine, with their SQL.

``user_id`` stands for a session or container, ``event_id`` for a line offset, ``event_type`` for a move type, and the
number in ``props`` for a location id, a request number or a piece of evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the number in props as k."""
    return read(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r'"k": (\d+)', 1).cast("int"))


K = "cast(regexp_extract(props, '\"k\": (\\d+)', 1) AS INTEGER)"
E = f"(SELECT *, {K} AS k FROM events)"


def place_chain(key) -> Column:
    """A chain of one place, which is called what its key says."""
    from .holdings import LINK, _link

    return F.array(_link("Location", key, key, None, "")).cast(f"array<{LINK}>")


@query(f"SELECT event_id, {K} AS k, {K} >= 50 AS high FROM events")
def parse_props(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "k", (F.col("k") >= 50).alias("high"))


@query("""SELECT event_id, regexp_extract(e, '^(.+?)_(\\d{6,})$', 1) AS class_name, regexp_extract(e, '^(.+?)_(\\d{6,})$', 2) AS geid
FROM (SELECT event_id, concat(event_type, '_01_', cast(700000000000 + event_id AS VARCHAR)) AS e FROM events)""")
def class_split(spark, sf_dir):
    from ..functions.text import entity_split

    e = F.concat("event_type", F.lit("_01_"), (F.lit(700000000000) + F.col("event_id")).cast("string"))
    parts = entity_split(e)
    return read(spark, sf_dir, "events").select("event_id", parts["class_name"].alias("class_name"), parts["geid"].alias("geid"))


@query(f"""SELECT event_id, last_value(CASE WHEN event_type = 'view' AND k % 10 > 0 THEN cast(k % 10 AS VARCHAR) WHEN event_type = 'view' AND k % 4 > 0 THEN concat('L', k % 4) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS location FROM {E}""")
def asof_location(spark, sf_dir):
    """Where the player was last: the location of a change, its landing where it names none, the one before where it names neither."""
    from ..operators.correlate import with_location

    change = F.col("event_type") == "view"
    e = events(spark, sf_dir).select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("line_offset"), "ts", F.when(change, (F.col("k") % 10).cast("string")).alias("location_id"), F.when(change, F.when(F.col("k") % 4 > 0, F.concat(F.lit("L"), F.col("k") % 4)).otherwise("0")).alias("landing_id"))
    return with_location(e).select("event_id", F.col("here").alias("location"))


@query(f"""SELECT event_id, unnest(CASE WHEN pk % 10 = 0 THEN [concat('L', pk % 4)] ELSE [cast(pk % 10 AS VARCHAR), concat('L', pk % 4)] END) AS location_id, concat('N', k % 3) AS name FROM (
SELECT *, lag(event_type) OVER w AS pe, lag(k) OVER w AS pk, lag(event_id) OVER w AS po FROM {E} WHERE event_type IN ('view', 'signup') WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id)) WHERE event_type = 'signup' AND pe = 'view' AND event_id - po <= 30""")
def first_name_within(spark, sf_dir):
    """The first name that follows a change of place within half a minute names both of its ids; an event is a second."""
    from ..operators.dimensions import location_bindings

    e, change = events(spark, sf_dir).where(F.col("event_type").isin("view", "signup")), F.col("event_type") == "view"
    kind = F.when(change, "LocationChanged").otherwise("LocationNamed")
    e = e.select("event_id", (F.col("user_id") % 5).alias("session_id"), F.lit(0).alias("ingest_seq"), F.col("event_id").alias("line_offset"), F.timestamp_seconds("event_id").alias("ts"), kind.alias("event_kind"), (F.col("k") % 10).cast("string").alias("location_id"), F.concat(F.lit("L"), F.col("k") % 4).alias("landing_id"), F.concat(F.lit("N"), F.col("k") % 3).alias("name"))
    return location_bindings(e).select(F.col("line_offset").alias("event_id"), "location_id", "name")


@query(f"""WITH e AS (SELECT *, event_id // 100 AS s FROM {E} WHERE event_type IN ('click', 'purchase')), m AS (SELECT *, lead(event_id) OVER (PARTITION BY s, k % 4 ORDER BY event_id) AS nxt FROM e WHERE event_type = 'click')
SELECT m.event_id AS move_id, max(b.event_id) AS completion_id FROM m JOIN e b ON b.event_type = 'purchase' AND b.s = m.s AND b.k % 4 = m.k % 4 AND b.event_id > m.event_id AND (m.nxt IS NULL OR b.event_id < m.nxt) AND (b.event_id - m.event_id) * 3 <= 120 GROUP BY 1""")
def interval_pairs(spark, sf_dir):
    """Completions of a request: its number, later in the log, within two minutes, before the number is used again; the last one counts.

    Each number is a session of its own here, so that none begins anew; an event is three seconds.
    """
    from ..functions.events import events as parse
    from ..operators.correlate import moves
    from .replays import log_line, queued

    e, at = events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")), F.col("event_id") * 3
    line = F.when(F.col("event_type") == "click", log_line(at, "Inventory Mgmt Request Queued", queued("7", "Move", "9:Location:1", "{{event_id}}:Container:0", "part"))).otherwise(log_line(at, "Inventory Request Completed", "Request[7] Player[P] Result[{{event_id}}] x"))
    session = F.floor(F.col("event_id") / 100) * 4 + F.col("k") % 4
    done = moves(parse(e.select(session.alias("session_id"), F.col("event_id").alias("line_offset"), line.alias("line")))).where("result IS NOT NULL")
    return done.select(F.col("line_offset").alias("move_id"), F.col("result").cast("long").alias("completion_id"))


def _bursts(e: DataFrame) -> DataFrame:
    from ..operators.sessions import bursts

    return bursts(e, "user_id", "event_id", "ts", F.expr("INTERVAL 2 HOURS"))


BURSTS = """(SELECT *, max(CASE WHEN new THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS burst_id FROM (
SELECT *, coalesce(NOT (ts >= lag(ts) OVER w AND ts - lag(ts) OVER w < INTERVAL 2 HOUR), true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))"""


@query(f"SELECT user_id, event_id, burst_id FROM {BURSTS}")
def bursts(spark, sf_dir):
    return _bursts(read(spark, sf_dir, "events")).select("user_id", "event_id", "burst_id")


@query(f"SELECT event_id, cast(sum(CASE WHEN k < p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {E})")
def generation(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).withColumn("restart", (F.col("k") < F.lag("k").over(w)).cast("int"))
    return e.select("event_id", F.coalesce(F.sum("restart").over(w), F.lit(0)).alias("generation"))


@query(f"""SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, burst_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM {BURSTS}""")
def parent_candidate(spark, sf_dir):
    w = Window.partitionBy("user_id", "burst_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return _bursts(read(spark, sf_dir, "events")).select("event_id", F.last(F.when(F.col("event_type") != "click", F.col("event_id")), ignorenulls=True).over(w).alias("parent_id"))


@query(f"""SELECT cast(user_id AS VARCHAR) AS geid, arg_max(cast(k AS VARCHAR), struct_pack(t := ts, i := event_id)) AS port, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS class_name, max(ts) AS last_seen FROM {E} WHERE k % 9 <> 0 GROUP BY user_id""")
def latest_wins(spark, sf_dir):
    """The last port and class seen of each entity, stand-ins aside."""
    from ..operators.dimensions import attachments

    seen = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("geid"), F.col("event_type").alias("class_name"), F.col("k").cast("string").alias("port"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ingest_seq"), F.col("event_id").alias("line_offset"), (F.col("k") % 9 == 0).alias("placeholder"))
    return attachments(seen)


@query(f"""SELECT concat('u', e.user_id) AS location_id, f.name, count(*) FILTER (WHERE e.event_type = f.name) AS evidence_count, count(*) FILTER (WHERE e.event_type <> f.name) AS conflicts FROM events e
JOIN (SELECT user_id, arg_min(event_type, struct_pack(t := ts, i := event_id)) AS name FROM events GROUP BY 1) f USING (user_id) GROUP BY 1, 2""")
def first_wins(spark, sf_dir):
    """The first name of a place stays; later ones agree or conflict. Each event is a change of place and its name."""
    from ..operators.dimensions import location_names

    pair = F.explode(F.array(F.lit("LocationChanged"), F.lit("LocationNamed"))).alias("event_kind")
    e = read(spark, sf_dir, "events").select("*", pair).select(F.col("event_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ingest_seq"), (F.col("event_id") * 2 + (F.col("event_kind") == "LocationNamed").cast("int")).alias("line_offset"), F.col("ts").cast("timestamp").alias("ts"), "event_kind", F.concat(F.lit("u"), "user_id").alias("location_id"), F.lit("0").alias("landing_id"), F.col("event_type").alias("name"))
    return location_names(e).select("location_id", "name", "evidence_count", "conflicts")


VOTES = f"SELECT user_id, k, count(*) AS hits FROM {E} GROUP BY 1, 2"


@query(f"SELECT user_id, k, hits FROM ({VOTES}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, k) = 1")
def evidence_votes(spark, sf_dir):
    from .naming import majority

    return majority(events(spark, sf_dir).groupBy("user_id", "k").agg(F.count("*").alias("hits")), "user_id", "k", "hits").select("user_id", "k", "hits")


DAY = "concat(user_id, '/', cast(cast(ts AS DATE) AS VARCHAR))"


def _by_day(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("unit", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.to_date("ts").cast("string")))


@query(f"SELECT unit, event_type, round(hits / total, 6) AS share FROM (SELECT {DAY} AS unit, event_type, count(*) AS hits, sum(count(*)) OVER (PARTITION BY {DAY}) AS total FROM events GROUP BY 1, 2) WHERE hits / total >= 0.75")
def clear_majority(spark, sf_dir):
    """The event type that has three quarters of a user's day."""
    from .naming import clear_majority as clear

    votes = _by_day(spark, sf_dir).groupBy("unit", "event_type").agg(F.count("*").alias("hits"))
    return clear(votes, "unit", "event_type", "hits").select("unit", "event_type", F.round("share", 6).alias("share"))


@query(f"SELECT {DAY} AS place_key, 'n' AS name, cast(bit_or(1 << (k % 5)) AS INTEGER) AS sources, CASE WHEN bit_count(bit_or(1 << (k % 5))) >= 2 THEN 'Confirmed' ELSE 'Proposed' END AS status FROM {E} WHERE k IS NOT NULL GROUP BY 1")
def source_bits(spark, sf_dir):
    """Sources that agree on a name, as bits of one number: a place for each user's day."""
    from .naming import resolve_names

    e = _by_day(spark, sf_dir).where("k IS NOT NULL")
    return resolve_names(e.select(F.col("unit").alias("place_key"), F.lit("n").alias("name"), F.expr("shiftleft(1, k % 5)").alias("source"), F.col("k").alias("rank")))


@query(f"""WITH b AS (SELECT user_id, k, min(ts) AS first_at FROM {E} GROUP BY 1, 2) SELECT cast(user_id AS VARCHAR) AS account, k AS build, first_at FROM (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY first_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b) WHERE k > best""")
def running_max_updates(spark, sf_dir):
    """Game updates: builds newer than all that were played before, at the time they were first played."""
    from ..operators.dimensions import game_updates

    none = F.lit(None).cast("string")
    s = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("account"), F.col("k").alias("build"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_line_ts"), none.alias("first_loc_id"), none.alias("cur_loc_id"), F.lit(None).cast("timestamp").alias("char_reset_at"))
    return game_updates(s).select("account", "build", F.col("at").alias("first_at"))


@query(f"""SELECT u.event_id AS build, count(c.event_id) AS checked, count(*) FILTER (WHERE c.k >= 50) AS survived,
round(CASE WHEN count(c.event_id) >= 5 THEN least(1.0, greatest(0.2, count(*) FILTER (WHERE c.k >= 50) / count(c.event_id))) ELSE 0.5 END, 6) AS factor
FROM (SELECT * FROM {E} WHERE event_type = 'signup' AND k < 20) u LEFT JOIN (SELECT * FROM {E} WHERE event_type = 'click') c ON c.user_id = u.user_id AND u.ts > c.ts - INTERVAL 1 DAY AND u.ts <= c.ts GROUP BY 1""")
def survival(spark, sf_dir):
    """Checks whose age spans an update, and the factor by which the update weighs."""
    from .holdings import update_factors

    e = events(spark, sf_dir).withColumn("account", F.col("user_id").cast("string"))
    updates = e.where("event_type = 'signup' AND k < 20").select("account", F.col("event_id").alias("build"), F.col("ts").alias("at"))
    checks = e.where("event_type = 'click'").select("account", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("since"), F.col("ts").alias("at"), (F.col("k") >= 50).alias("same_place"))
    return update_factors(checks, updates).select("build", "checked", "survived", F.round("factor", 6).alias("factor"))


@query(f"""WITH RECURSIVE e AS (SELECT event_id, CASE WHEN k > 0 AND event_id - k >= 0 THEN event_id - k END AS parent FROM {E}),
walk AS (SELECT event_id, event_id AS cur, 0 AS depth FROM e UNION ALL SELECT w.event_id, e.parent, w.depth + 1 FROM walk w JOIN e ON e.event_id = w.cur WHERE e.parent IS NOT NULL AND w.depth < 6)
SELECT event_id, arg_max(cur, depth) AS root, cast(max(depth) AS INTEGER) AS depth FROM walk GROUP BY 1""")
def container_chain(spark, sf_dir):
    from ..operators.chains import walk

    links = events(spark, sf_dir).where("k > 0 AND event_id - k >= 0").select(F.col("event_id").alias("node"), (F.col("event_id") - F.col("k")).alias("parent"))
    start = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    return walk(start, links, 6).select(F.col("node").alias("event_id"), F.element_at("chain", -1).alias("root"), (F.size("chain") - 1).alias("depth"))


@query(f"""SELECT event_id, round((CASE WHEN event_type = 'error' THEN 0.5 ELSE 1 END) * (CASE WHEN k < 20 THEN 0.8 ELSE 1 END) * (CASE WHEN value < 10 THEN 0.3 ELSE 1 END), 6) AS score FROM {E}""")
def score_product(spark, sf_dir):
    from ..functions.scoring import factor, product

    factors = [factor(F.col("event_type") == "error", 0.5), factor(F.col("k") < 20, 0.8), factor(F.col("value") < 10, 0.3)]
    return events(spark, sf_dir).select("event_id", F.round(product(factors), 6).alias("score"))


RANK = "CASE WHEN k / 100.0 >= 0.7 THEN 2 WHEN k / 100.0 >= 0.4 THEN 1 ELSE 0 END"


@query(f"""SELECT event_type, user_id, count(*) AS quantity, max(ts) AS last_move, CASE min({RANK}) WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS confidence, count(DISTINCT k % 7) AS caveats FROM {E} GROUP BY 1, 2""")
def confidence_pool(spark, sf_dir):
    """Rows pooled by class: quantities add, the newest move and the lowest confidence stand."""
    from ..functions.scoring import confidence_label, confidence_rank

    e = events(spark, sf_dir).withColumn("rank", confidence_rank(F.col("k") / 100))
    by = e.groupBy("event_type", "user_id").agg(F.count("*").alias("quantity"), F.max("ts").alias("last_move"), F.min("rank").alias("rank"), F.size(F.collect_set(F.col("k") % 7)).cast("long").alias("caveats"))
    return by.select("event_type", "user_id", "quantity", "last_move", confidence_label(F.col("rank")).alias("confidence"), "caveats")


@query("""SELECT category, count(*) AS rows FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN 'Armor' WHEN 'PROMO' THEN 'Clothing' WHEN 'SMALL' THEN 'Weapons' WHEN 'LARGE' THEN 'ShipParts' ELSE 'Other' END AS category FROM part) GROUP BY 1""")
def category_counts(spark, sf_dir):
    """Parts by category; three of their types stand for labels of the catalogue."""
    from .queries import category_counts as counts

    t = F.col("p_type")
    label = F.when(t == "ECONOMY", "Backpack").when(t == "PROMO", "Hat").when(t == "SMALL", "Grenade").when(t == "LARGE", "Cooler").otherwise(t)
    return counts(read(spark, sf_dir, "part").select(label.alias("type_label")))


@query("SELECT event_type AS move_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC")
def moves_by_type(spark, sf_dir):
    from .queries import moves_by_type as by_type

    return by_type(read(spark, sf_dir, "events").withColumnRenamed("event_type", "move_type"))


@query("""SELECT (SELECT count(*) FROM lineitem) AS moves, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS succeeded, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS unconfirmed, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_linestatus = 'O') AS items,
(SELECT count(DISTINCT l_partkey % 10) FROM lineitem) AS classes, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS named_moves, (SELECT count(*) FROM lineitem WHERE l_linestatus <> 'O') AS class_moves, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_linenumber = 1) AS in_use,
(SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND p_size > 25) AS identified, (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM nation) AS location_names, (SELECT count(*) FROM part WHERE p_size > 25) AS containers""")
def store_summary(spark, sf_dir):
    """Moves by outcome, distinct entities and classes (nulls don't count), containers in use and identified."""
    from .queries import store_summary as summary

    flag = F.col("l_returnflag")
    i = read(spark, sf_dir, "lineitem").select(F.when(flag == "R", "SUCCEED").when(flag == "A", "failed").alias("result"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("string")).alias("item_geid"), (F.col("l_partkey") % 10).cast("string").alias("item_class"), F.when(F.col("l_linenumber") == 1, "Container").otherwise("Location").alias("tgt_kind"), F.col("l_partkey").cast("string").alias("tgt_key"))
    boxes = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("geid"))
    return summary(i, read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation"), boxes)


@query("""SELECT (SELECT count(*) FROM orders) AS files, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS files_with_lines, (SELECT cast(sum(o_custkey % 3) AS BIGINT) FROM orders) AS unrecognised, (SELECT max(o_orderdate) FROM orders) AS newest_line, (SELECT count(*) FROM lineitem) AS moves""")
def health(spark, sf_dir):
    from .queries import health as of

    s = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_ts"), F.col("o_orderdate").alias("last_line_ts"), (F.col("o_custkey") % 3).alias("unrecognised"))
    return of(s, read(spark, sf_dir, "lineitem"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN p_name END AS src_container, CASE WHEN l_linestatus = 'O' THEN s_name END AS tgt_place FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 3""")
def trace(spark, sf_dir):
    """Moves of one entity, out of containers and to places, each end named by its own kind; the entity is that of an order's first three lines."""
    from .queries import trace as of

    i = read(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    moves = i.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") <= 3, "g").otherwise("h").alias("item_geid"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("line_offset"), F.col("l_linenumber").alias("item_ix"), F.when(F.col("l_returnflag") == "R", "Container").otherwise("World").alias("src_kind"), text("l_partkey").alias("src_key"), F.when(F.col("l_linestatus") == "O", "Location").otherwise("Equipped").alias("tgt_kind"), text("l_suppkey").alias("tgt_key"))
    places = read(spark, sf_dir, "supplier").select(text("s_suppkey").alias("location_id"), F.col("s_name").alias("name"))
    return of(moves, "g", places, read(spark, sf_dir, "part").select(text("p_partkey").alias("geid"), F.col("p_name").alias("class_name"))).select("l_orderkey", "l_linenumber", "src_container", "tgt_place")


@query("""SELECT r_name AS root_key, concat(n_name, ' items') AS item_class, cast(sum(cast(c_custkey % 5 + 1 AS BIGINT)) AS BIGINT) AS quantity, max(c_mktsegment) AS last_move, CASE min(CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS confidence,
cast(sum(sum(c_custkey % 5 + 1)) OVER (PARTITION BY r_name) AS BIGINT) AS root_quantity FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains(n_name, '1') GROUP BY 1, 2""")
def holdings_by_root(spark, sf_dir):
    """What each outermost place holds of the classes that contain a text."""
    from .queries import by_root

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    balance = F.col("c_acctbal")
    h = read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lit("me").alias("account"), F.concat("n_name", F.lit(" items")).alias("item_class"), (F.col("c_custkey") % 5 + 1).alias("quantity"), place_chain(F.col("r_name")).alias("chain"), F.col("c_mktsegment").alias("since"), F.when(balance > 5000, 2).when(balance > 0, 1).otherwise(0).alias("rank"))
    return by_root(h, "1").drop("account", "root_kind")


@query("""SELECT p_partkey, p_name AS display_name, concat('place ', p_size % 4) AS "where" FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_type = 'SMALL'""")
def search(spark, sf_dir):
    """Parts of one category by a text in their name or class, with where they are."""
    from .queries import search as find

    spot = F.concat(F.lit("place "), F.col("p_size") % 4)
    label = F.when(F.col("p_type") == "SMALL", "Weapon Attachment")
    h = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("display_name"), F.col("p_brand").alias("item_class"), label.alias("type_label"), place_chain(spot).alias("chain"), F.col("p_size").alias("since"))
    return find(h, "RING", "Weapons").select("p_partkey", "display_name", "where")


@query("SELECT s_name AS place_key, cast(s_nationkey AS VARCHAR) AS system FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def stations_semi(spark, sf_dir):
    """Suppliers that hold something, under either of their two ids."""
    from .queries import stations

    places = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("place_key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("system"), F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("old"), "s_suppkey")).alias("alias_ids"))
    key = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("old"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string"))
    return stations(read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(place_chain(key).alias("chain")), places).select("place_key", "system")


@query("SELECT DISTINCT cast(o_custkey AS VARCHAR) AS location_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0 WHERE c_custkey IS NULL")
def orphans_anti(spark, sf_dir):
    """Places with orders that are none of the known ones (customers in credit)."""
    from .queries import orphans

    known = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.array(F.col("c_custkey").cast("string")).alias("alias_ids"))
    return orphans(read(spark, sf_dir, "orders").select(place_chain(F.col("o_custkey").cast("string")).alias("chain")), known)


FINGERPRINTS = "SELECT user_id, k, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS n FROM {e} WHERE event_id % 10 <> {r}"


@query(f"""WITH a AS ({FINGERPRINTS.format(e=E, r=3)}), b AS ({FINGERPRINTS.format(e=E, r=4)})
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_live""")
def parity_sets(spark, sf_dir):
    """Fingerprints of two replays, repeats numbered; the replays leave out different events."""
    from .quality import parity

    e = events(spark, sf_dir)
    return parity(e.where("event_id % 10 <> 3"), e.where("event_id % 10 <> 4"), ["user_id", "k"], "event_id").select("shared", "either", "only_live")


@query("""SELECT caveat, count(*) AS n FROM (SELECT concat(event_type, ' ', chr(39), '…', chr(39), ' placed # days ago') AS caveat FROM events UNION ALL SELECT concat('build # in ', chr(39), '…', chr(39)) FROM events WHERE user_id % 2 = 0) GROUP BY 1""")
def caveat_histogram(spark, sf_dir):
    from .quality import caveat_shapes

    name = F.concat(F.lit("'item "), F.col("event_id"), F.lit("'"))
    caveats = F.array(F.concat("event_type", F.lit(" "), name, F.lit(" placed "), F.col("user_id"), F.lit(" days ago")), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("build "), F.col("event_id"), F.lit(" in "), name)))
    return caveat_shapes(read(spark, sf_dir, "events").select(F.filter(caveats, lambda x: x.isNotNull()).alias("caveats")))


@query(f"""SELECT age, crossed, count(*) AS checked, count(*) FILTER (WHERE k >= 50) AS held FROM (SELECT *, CASE WHEN s < 3600 THEN '< 1 h' WHEN s < 86400 THEN '1 h – 1 d' WHEN s < 604800 THEN '1 – 7 d' WHEN s < 2592000 THEN '7 – 30 d' ELSE '> 30 d' END AS age, user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00' AS crossed
FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-31 12:00:00' - ts) / 1000000 AS s FROM {E})) GROUP BY 1, 2""")
def age_buckets(spark, sf_dir):
    """Checks by age of the belief, within a build and across an update that half of the accounts had."""
    from .quality import crossed, placement_table

    time = lambda t: F.lit(t).cast("timestamp")
    checks = events(spark, sf_dir).select((F.col("user_id") % 2).cast("string").alias("account"), F.col("ts").cast("timestamp").alias("since"), time("2024-01-31 12:00:00").alias("at"), (F.col("k") >= 50).alias("same_place"))
    updates = spark.createDataFrame([("0", 0.5)], "account string, factor double").withColumn("at", time("2024-01-20 00:00:00"))
    return placement_table(crossed(checks, updates))


@query(f"""WITH r AS (SELECT *, dense_rank() OVER (ORDER BY d) AS rk, (SELECT count(DISTINCT cast(ts AS DATE)) FROM events) AS n FROM (SELECT event_type, k, cast(ts AS DATE) AS d FROM {E})),
c AS (SELECT event_type, avg(CASE WHEN k >= 50 THEN 1.0 ELSE 0.0 END) AS p FROM r WHERE rk <= greatest(1, least(n - 1, ceil(n * 0.7))) GROUP BY 1 HAVING count(*) >= 5)
SELECT r.event_type, count(*) AS n, round(avg(power(coalesce(c.p, 0.5) - CASE WHEN k >= 50 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM r LEFT JOIN c USING (event_type) WHERE rk > greatest(1, least(n - 1, ceil(n * 0.7))) GROUP BY 1""")
def holdout_brier(spark, sf_dir):
    from .quality import holdout_brier as brier

    checks = events(spark, sf_dir).select("event_type", F.to_date("ts").alias("day"), (F.col("k") >= 50).alias("survived"))
    return brier(checks, "event_type", "day", "survived").select("event_type", "n", F.round("brier", 6).alias("brier"))


@query("""WITH names AS (SELECT DISTINCT concat(r_name, '_', n_name) AS stem FROM nation JOIN region ON n_regionkey = r_regionkey),
i AS (SELECT s_suppkey, concat(r_name, '_', n_name, '_', s_suppkey % 3, '_', s_suppkey) AS cls FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, stem FROM i LEFT JOIN names ON lower(stem) = lower(regexp_replace(cls, '_[^_]*_[^_]*$', ''))""")
def name_stem(spark, sf_dir):
    from .naming import name_by_stem

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = n.select(F.concat_ws("_", "r_name", "n_name").alias("class_name")).distinct().withColumn("display_name", F.col("class_name"))
    items = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("_", "r_name", "n_name", (F.col("s_suppkey") % 3).cast("string"), F.col("s_suppkey").cast("string")).alias("item_class"))
    return name_by_stem(items, names).select("s_suppkey", F.col("display_name").alias("stem"))


@query(f"SELECT user_id, k, event_id, event_type FROM {E} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1")
def idempotent_dedupe(spark, sf_dir):
    """A row for each natural key: the first one read stays, whatever is read again."""
    from .store import first_of_key

    e = events(spark, sf_dir)
    return first_of_key(e.unionByName(e.where("event_id % 2 = 0")), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id", "event_type")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "value")


@query("SELECT n_name AS label, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(concat(n_name, ' ', r_name)), 'a') AND contains(lower(concat(n_name, ' ', r_name)), '_1') ORDER BY r_name, n_name LIMIT 40")
def command_palette(spark, sf_dir):
    """Every word in the label or its kind; the first forty are the feature."""
    from .queries import palette

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return palette(n.select(F.col("n_name").alias("label"), F.col("r_name").alias("kind")), "A _1")


# The log pipeline and the read queries on tables written in the log's terms.


def _lines(spark, sf_dir) -> DataFrame:
    """A queued move and a completion for each line item; completions of open lines come too late."""
    from .store import first_of_key

    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("n"), "l_linestatus")
    i = first_of_key(i, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "n", "l_linestatus"])
    i = i.withColumn("session_id", F.col("l_orderkey") % 64).withColumn("line_offset", F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10)
    at = lambda seconds: F.date_format(F.timestamp_seconds(1_785_542_400 + F.col("l_orderkey") * 300 + F.col("l_linenumber") + seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    queued = F.format_string("<%s> [Notice] <Inventory Mgmt Request Queued> Queued Request[%d] Type[Move] for 'P' [1] Source Inventory[9:Location:%d] Target Inventory[%d:Container:0]. Source[part_%d] amount[%d] rank[]. Target[NULL] amount[0] rank[]. Item[NONE] action[None]. x", at(0), "line_offset", "l_suppkey", "l_orderkey", "l_partkey", "n")
    done = F.format_string("<%s> [Notice] <Inventory Request Completed> Request[%d] Player[P] Result[succeed] x", F.when(F.col("l_linestatus") == "F", at(60)).otherwise(at(200)), "line_offset")
    pair = F.array(F.struct(F.lit(0).alias("o"), queued.alias("line")), F.struct(F.lit(1).alias("o"), done.alias("line")))
    return i.select("session_id", "line_offset", F.explode(pair).alias("x")).select("session_id", (F.col("line_offset") + F.col("x.o")).alias("line_offset"), "x.line")


OFFSET = "l_orderkey * 100 + l_linenumber * 10"
ITEMS = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_linestatus) = 1)"


@query(f"SELECT l_orderkey % 64 AS session_id, {OFFSET} AS line_offset, cast({OFFSET} AS INTEGER) AS request_no, concat('part_', l_partkey) AS item_class, cast(l_quantity AS INTEGER) AS amount, cast(l_suppkey AS VARCHAR) AS source_key, cast(l_orderkey AS VARCHAR) AS target_key FROM {ITEMS}")
def parse_moves(spark, sf_dir):
    """Moves of the lines. Numbers have 64 bits; SQL's have 32 and end it with an error from order 21,474,836 on."""
    from ..functions.events import events as parse

    e = parse(_lines(spark, sf_dir)).where("event_kind = 'ItemMoved'")
    return e.select("session_id", "line_offset", "request_no", "item_class", "amount", F.col("source.key").alias("source_key"), F.col("target.key").alias("target_key"))


@query(f"SELECT l_orderkey % 64 AS session_id, {OFFSET} AS line_offset, concat('part_', l_partkey) AS item_class, cast(l_orderkey AS VARCHAR) AS tgt_key, CASE WHEN l_linestatus = 'F' THEN 'succeed' END AS result FROM {ITEMS}")
def correlate_fold(spark, sf_dir):
    """Each move with the completion that came in time."""
    from ..functions.events import events as parse
    from ..operators.correlate import moves

    return moves(parse(_lines(spark, sf_dir))).select("session_id", "line_offset", "item_class", "tgt_key", "result")


def _moves(spark, sf_dir) -> DataFrame:
    i = read(spark, sf_dir, "lineitem")
    text = lambda x: F.lit(x)
    return i.select(
        F.col("l_suppkey").cast("string").alias("account"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(0).alias("item_ix"), text("Move").alias("move_type"),
        F.concat(text("part_"), F.col("l_partkey") % 10).alias("item_class"), F.lit(None).cast("string").alias("item_geid"), F.col("l_quantity").cast("int").alias("amount"), text("Invalid").alias("src_kind"), text("").alias("src_key"),
        text("Location").alias("tgt_kind"), (F.col("l_orderkey") % 20).cast("string").alias("tgt_key"), F.lit(None).cast("string").alias("action"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeed").alias("result"),
    )


@query("SELECT cast(l_suppkey AS VARCHAR) AS account, concat('part_', l_partkey % 10) AS item_class, cast(l_orderkey % 20 AS VARCHAR) AS place, cast(sum(cast(l_quantity AS INTEGER)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3")
def ledger_fold(spark, sf_dir):
    """Units by account, class and place after all moves that did not fail."""
    from ..operators.ledger import ledger, timeline

    none = lambda schema: spark.createDataFrame([], schema)
    seen = none("account string, session_id long, line_offset long, seq long, ts timestamp, geid string, class_name string, port string, placeholder boolean, parent_geid string")
    rows = ledger(timeline(_moves(spark, sf_dir), seen, none("account string, ts timestamp, build int"), none("account string, geid string, class_name string")), ["holding"])
    return rows.groupBy("account", "item_class", F.col("key").alias("place")).agg(F.sum("quantity").alias("quantity"))


EPOCHS = """WITH m AS (SELECT l_linestatus AS account, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, cast(l_partkey AS VARCHAR) AS geid, cast(l_suppkey AS VARCHAR) AS place FROM lineitem),
r AS (SELECT account, ts, row_number() OVER (PARTITION BY account ORDER BY ts) - 1 AS epoch FROM (SELECT DISTINCT l_linestatus AS account, date_trunc('month', o_orderdate) AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)),
e AS (SELECT m.*, (SELECT count(*) FROM r WHERE r.account = m.account AND r.ts <= m.ts) AS epoch FROM m)
SELECT r.account, 'reset' AS row_kind, NULL AS geid, NULL AS place, r.ts AS at, count(DISTINCT geid) AS quantity FROM r LEFT JOIN e ON e.account = r.account AND e.epoch = r.epoch GROUP BY r.account, r.ts
UNION ALL SELECT account, 'holding', geid, arg_max(place, (ts, seq)), max(ts), 1 FROM e WHERE epoch = (SELECT count(*) FROM r WHERE r.account = e.account) GROUP BY account, geid
UNION ALL SELECT account, 'stat', 'named_moves', NULL, NULL, count(*) FROM m GROUP BY account"""


@query(EPOCHS)
def ledger_epochs(spark, sf_dir):
    """Two accounts that hold all line items, wiped each month: what each reset took, what is left after the last, one counter over all."""
    from ..operators.ledger import counters, ledger, timeline
    from .store import keep

    i, none = read(spark, sf_dir, "lineitem"), lambda schema: spark.createDataFrame([], schema)
    moves = i.select(F.col("l_linestatus").alias("account"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit(0).alias("item_ix"), F.lit("Store").alias("move_type"), F.lit("part").alias("item_class"), F.col("l_partkey").cast("string").alias("item_geid"), F.lit(1).alias("amount"), F.lit("Invalid").alias("src_kind"), F.lit("").alias("src_key"), F.lit("Location").alias("tgt_kind"), F.col("l_suppkey").cast("string").alias("tgt_key"), F.lit("succeed").alias("result"))
    resets = i.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_linestatus").alias("account"), F.date_trunc("month", "o_orderdate").alias("ts")).distinct().withColumn("build", F.lit(1))
    seen = none("account string, session_id long, line_offset long, seq long, ts timestamp, geid string, class_name string, port string, placeholder boolean, parent_geid string")
    rows = keep(ledger(keep(timeline(moves, seen, resets, none("account string, geid string, class_name string")), "timeline"), ["reset", "holding", "stat"]), "epochs")
    kinds = rows.where("row_kind IN ('reset', 'holding')").select("account", "row_kind", "geid", F.col("key").alias("place"), F.coalesce("at", "since").alias("at"), F.col("quantity").cast("long").alias("quantity"))
    moved = counters(rows).where("detail = 'named_moves'").select("account", F.lit("stat").alias("row_kind"), F.col("detail").alias("geid"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("timestamp").alias("at"), "quantity")
    return kinds.unionByName(moved)


def _holdings(spark, sf_dir) -> DataFrame:
    """Line items as holdings: in a crate (the part) at a station (the nation of the supplier), dropped, or in a ship."""
    from .holdings import LINK, _link

    n = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    i = read(spark, sf_dir, "lineitem").join(n, F.col("s_suppkey") == F.col("l_suppkey"))
    crate = _link("Container", F.col("l_partkey") % 5, F.concat(F.lit("crate "), F.col("l_partkey") % 5), None, "")
    last = F.when(F.col("l_returnflag") == "R", _link("World", F.col("n_name"), F.col("n_name"), None, "dropped at ")).when(F.col("l_returnflag") == "A", _link("Ship", "s", F.concat(F.lit("ship "), F.col("l_linenumber")), None, "")).otherwise(_link("Location", F.col("n_name"), F.col("n_name"), None, ""))
    rank = F.when(F.col("l_discount") < 0.03, 2).when(F.col("l_discount") < 0.07, 1).otherwise(0)
    return i.select(F.lit("me").alias("account"), F.concat(F.lit("part_"), F.col("l_partkey") % 10).alias("item_class"), F.col("l_quantity").cast("int").alias("quantity"), F.array(crate, last).cast(f"array<{LINK}>").alias("chain"), F.col("l_shipdate").alias("since"), rank.alias("rank"), F.lit(None).cast("string").alias("geid"), F.array().cast("array<string>").alias("caveats"), F.when(F.col("l_linenumber") == 1, "Food").alias("type_label"))


H = """(SELECT concat('part_', l_partkey % 10) AS item_class, cast(l_quantity AS INTEGER) AS quantity, l_partkey % 5 AS crate, CASE l_returnflag WHEN 'R' THEN 'World' WHEN 'A' THEN 'Ship' ELSE 'Location' END AS root_kind, CASE WHEN l_returnflag = 'A' THEN 's' ELSE n_name END AS root_key, l_linenumber, l_shipdate AS since,
CASE WHEN l_discount < 0.03 THEN 2 WHEN l_discount < 0.07 THEN 1 ELSE 0 END AS rank FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
LABEL = "CASE min(rank) WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS confidence"


@query(f"SELECT root_kind, root_key, item_class, cast(sum(quantity) AS BIGINT) AS quantity, {LABEL}, cast(sum(sum(quantity)) OVER (PARTITION BY root_kind, root_key) AS BIGINT) AS root_quantity FROM {H} GROUP BY 1, 2, 3")
def q_by_root(spark, sf_dir):
    from . import queries as Q

    return Q.by_root(_holdings(spark, sf_dir)).drop("account", "last_move")


FIRST = f"{H} WHERE root_kind = 'World' AND root_key = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)"


@query(f"SELECT 'container' AS row, concat('crate ', crate) AS item_class, cast(crate AS VARCHAR) AS key, 1 AS quantity, cast(sum(quantity) AS BIGINT) AS inside, max(since) AS last_move, {LABEL}, array_to_string(list_sort(list(DISTINCT CASE WHEN l_linenumber = 1 THEN 'Consumables' ELSE 'Other' END)), ',') AS categories FROM {FIRST} GROUP BY crate")
def q_level(spark, sf_dir):
    """What is below one place: its crates, known by what they hold."""
    from . import queries as Q

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    first = n.agg(F.min("n_name")).first()[0]
    return Q.level(_holdings(spark, sf_dir), [("World", first)]).drop("caveats").withColumns({"quantity": F.col("quantity").cast("int"), "categories": F.array_join("categories", ",")})


@query(f"SELECT count(DISTINCT CASE WHEN root_kind = 'Location' THEN root_key END) AS stations, count(DISTINCT CASE WHEN root_kind = 'Ship' THEN l_linenumber END) AS ships, cast(sum(CASE WHEN root_kind = 'World' THEN quantity ELSE 0 END) AS BIGINT) AS dropped FROM {H}")
def q_sidebar(spark, sf_dir):
    from . import queries as Q

    return Q.sidebar(_holdings(spark, sf_dir))


@query(f"SELECT root_key AS place_key, root_key AS name, cast(sum(quantity) AS BIGINT) AS quantity, max(since) AS newest FROM {H} WHERE root_kind = 'World' GROUP BY 1")
def q_dropped(spark, sf_dir):
    from . import queries as Q

    places = read(spark, sf_dir, "nation").select(F.col("n_name").alias("place_key"), F.col("n_name").alias("name"), F.array("n_name").alias("alias_ids"))
    return Q.dropped(_holdings(spark, sf_dir), places)


@query(f"SELECT concat('ship ', l_linenumber) AS ship, cast(sum(quantity) AS BIGINT) AS quantity, count(*) AS rows FROM {H} WHERE root_kind = 'Ship' GROUP BY 1")
def q_ships(spark, sf_dir):
    from . import queries as Q

    none = spark.createDataFrame([], "class_name string, retrieved_ts timestamp, name string")
    return Q.ships(_holdings(spark, sf_dir), none, none).select("ship", "quantity", "rows")


@query("""SELECT n_name AS place_key, CASE WHEN bit_count(bit_or(src)) >= 2 THEN 'Confirmed' ELSE 'Proposed' END AS status, cast(bit_or(src) AS INTEGER) AS sources FROM (SELECT n_name, 1 << (s_suppkey % 3) AS src FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1""")
def resolve_sources(spark, sf_dir):
    """Names that several sources propose."""
    from .naming import resolve_names

    n = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return resolve_names(n.select(F.col("n_name").alias("place_key"), F.col("n_name").alias("name"), F.expr("shiftleft(1, cast(s_suppkey % 3 AS INT))").alias("source"), F.col("s_suppkey").alias("rank"))).select("place_key", "status", "sources")
