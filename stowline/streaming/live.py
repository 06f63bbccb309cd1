"""The account as logs grow: what a change reaches is replayed from a kept state, the rest stays as it is.

Each update takes the timeline as it is now. Of every account the first entry that differs from the stored timeline is
found (new lines at its end, a late file in its midst, a patch to an old move); the newest state kept before it is restored,
and only the entries behind that state run through the account again. An update writes the replayed stretch, the rows
it gave and the states kept on the way, for changed accounts alone; what an older version says of that stretch no longer counts.

What can be worn is known from all logs at once, yet matters only from the first entry on that speaks of the container: that
is where it stands in the timeline, so that a new item to wear does not undo the whole account.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.folds import fold
from ..operators.ledger import ROWS, Account
from ..plans.store import Snapshots, keep

#: Entries of an account between two kept states.
EVERY = 5000
KEPT = ROWS + ", place string, state binary"
_STATE = "state"


def placed(timeline: DataFrame) -> DataFrame:
    """The timeline with ``place``, a string in the order of the account's entries; wearables stand at their first mention."""
    keys = F.array_compact(F.array(F.when(F.col("src_kind") == "Container", F.col("src_key")), F.when(F.col("tgt_kind") == "Container", F.col("tgt_key")), "parent_geid"))
    mention = timeline.select("account", "ts", F.explode(keys).alias("item_geid")).groupBy("account", "item_geid").agg(F.min("ts").alias("ts"))
    wear = timeline.where("entry = 'wearable'").drop("ts").join(mention, ["account", "item_geid"])
    all_ = timeline.where("entry <> 'wearable'").unionByName(wear)
    return all_.withColumn("place", F.format_string("%020d|%d|%020d|%010d|%s", F.unix_micros("ts"), "rank", F.coalesce("seq", F.lit(0)), F.coalesce(F.col("sub") + 1, F.lit(0)), F.coalesce("item_geid", F.lit(""))))


class Resumed:
    """An account that can begin with a kept state, and keeps its state from time to time: never between entries of one place."""

    def __init__(self, every: int):
        self.every, self.held, self.since, self.last = every, Account(), 0, None

    def _keep(self) -> tuple:
        return (*self.held._row(_STATE), self.last, pickle.dumps(self.held))

    def step(self, e) -> list[tuple]:
        if e.entry == _STATE:
            self.held, self.last = pickle.loads(e.state), e.place
            return []
        out = []
        if self.since >= self.every and e.place != self.last:
            out.append(self._keep())
            self.since = 0
        out += [(*row, e.place, None) for row in self.held.step(e)]
        self.since, self.last = self.since + 1, e.place
        return out

    def end(self) -> list[tuple]:
        rows = [*self.held.end(), *(self.held._row("parent", geid=p) for p in sorted(self.held.parents))]
        return [*((*row, None, None) for row in rows), self._keep()]


class LiveLedger:
    """Versions of a ledger below one folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        self.spark, self.store, self.every = spark, Snapshots(spark, path), every

    def _current(self, name: str) -> DataFrame | None:
        """Rows of all versions that no later version has replaced: it replaced what stands behind its cut, and the end."""
        versions = self.store._versions("committed-")
        if not versions:
            return None
        read = lambda table: self.spark.read.option("basePath", self.store.path).parquet(*[f"{self.store.path}/v={v}/{table}" for v in versions])
        cuts = read("cuts").select(F.col("account").alias("_account"), F.col("v").alias("_v"), "upto")
        rows = read(name)
        gone = F.col("upto").isNull() | F.col("place").isNull() | (F.col("place") > F.col("upto"))
        return rows.join(cuts, (F.col("account") == F.col("_account")) & (F.col("_v") > F.col("v")) & gone, "left_anti").drop("v")

    def update(self, timeline: DataFrame) -> int | None:
        """Bring the ledger to the timeline (of ``ledger.timeline``); the new version, or None where nothing changed."""
        now = keep(placed(timeline), "live")
        before = self._current("entries")
        count = now.withColumn("n", F.lit(1))
        if before is not None:
            count = count.unionByName(before.withColumn("n", F.lit(-1)))
        differ = count.groupBy(*now.columns).agg(F.sum("n").alias("n")).where("n <> 0")
        changed = keep(differ.groupBy("account").agg(F.min("place").alias("first")), "changed")
        if changed.isEmpty():
            return None
        cuts = changed.withColumn("upto", F.lit(None).cast("string")).withColumn(_STATE, F.lit(None).cast("binary"))
        if before is not None:
            kept = self._current("rows").where(F.col("row_kind") == _STATE).join(changed, "account").where("place < first").groupBy("account").agg(F.max("place").alias("upto"), F.max_by(_STATE, "place").alias(_STATE))
            cuts = changed.join(kept, "account", "left")
        cuts = keep(cuts.select("account", "upto", _STATE), "cuts")
        behind = now.join(cuts.select("account", "upto"), "account").where("upto IS NULL OR place > upto").drop("upto")
        restored = cuts.where("upto IS NOT NULL").select("account", F.lit(_STATE).alias("entry"), F.col("upto").alias("place"), _STATE)
        rows = fold(behind.unionByName(restored, allowMissingColumns=True), ["account"], ["place"], lambda every=self.every: Resumed(every), KEPT)
        return self.store.publish({"entries": behind, "rows": rows, "cuts": cuts.select("account", "upto")})

    def rows(self) -> DataFrame:
        """The ledger's rows as they are now."""
        return self._current("rows").where(F.col("row_kind") != _STATE).drop("place", _STATE)

    def republished(self, version: int) -> DataFrame:
        """(account, upto): the accounts that a version changed, and the place up to which it left each as it was."""
        return self.store.read("cuts", version)
