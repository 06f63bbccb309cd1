"""Following logs: the pairing pass as keyed state of a stream, and moves settled from what it has emitted.

The state of a session is the same object that a batch pass uses, so a log that is read in any pieces gives the rows that
one pass gives. Batches go to folders of their own, written anew if a batch is tried again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.events import events as parse
from ..operators.correlate import FINISHED, PAIRED, Pairing, finished_rows, pairing_rows, settle
from ..operators.folds import plain
from ..sources.tail import TailSource

_NAMES = [c.strip().split()[0] for c in PAIRED.split(",")]
_NUMBER, _END = _NAMES.index("request_no"), "LogFinished"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a session's new lines. Lines at or before the last one seen are read again after a retry and change nothing;
    a log that was begun anew is another session, one that was renamed is the same. The mark of its end becomes a row."""
    held, seen = pickle.loads(state.get[0]) if state.exists else (Pairing(), -1)
    rows = pd.concat(list(batches)).sort_values("line_offset")
    out: list[tuple] = []
    for e in plain(rows):
        if e.event_kind == _END:
            known = {"session_id": e.session_id, "line_offset": e.line_offset, "item_ix": -1, "patch": FINISHED}
            out.append(tuple(known.get(n) for n in _NAMES))
        elif e.line_offset > seen:
            seen = e.line_offset
            out += held.step(e)
    state.update((pickle.dumps((held, seen)),))
    made = pd.DataFrame(out, columns=_NAMES)
    # Patches have no number: the column would be floats, which don't hold all numbers.
    made["request_no"] = pd.Series([row[_NUMBER] for row in out], dtype=object)
    yield made


def paired_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the pairing pass for the logs of a folder, as they grow."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("gamelog").load(folder).withColumn("session_id", F.xxhash64("file", "begun"))
    ends = lines.where("line IS NULL").select("session_id", "line_offset", F.lit(_END).alias("event_kind"), F.lit(0).cast("long").alias("request_no"))
    rows = pairing_rows(parse(lines.where("line IS NOT NULL"))).unionByName(ends, allowMissingColumns=True)
    return rows.groupBy("session_id").applyInPandasWithState(_step, PAIRED, "held binary", "append", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, folder: str, out: str, publish: Callable[[int], None] | None = None, **trigger):
    """Start a query that appends to the table at ``out``; trigger is that of writeStream (default: what there is now).

    ``publish(batch)`` is called after each batch that brought something: lines that change no holding give no rows.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        path = f"{out}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        if publish is not None and not rows.sparkSession.read.schema(PAIRED).parquet(path).isEmpty():
            publish(batch)

    return paired_stream(spark, folder).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(**(trigger or {"availableNow": True})).start()


def followed_moves(spark: SparkSession, out: str) -> DataFrame:
    """Moves as far as the stream has come."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    ends = F.col("patch") == FINISHED
    return settle(rows.where(~ends).unionByName(finished_rows(rows.where(ends)), allowMissingColumns=True))
