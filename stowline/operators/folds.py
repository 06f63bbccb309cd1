"""Order-dependent passes over sorted rows: one key at a time, in bounded memory, as part of a Spark plan."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType


def plain(batch: pd.DataFrame) -> Iterator[tuple]:
    """Rows as named tuples, with None where a value is missing."""
    row = namedtuple("Row", batch.columns)
    columns = []
    for name in batch.columns:
        column = batch[name]
        values = column.tolist()
        if column.dtype != object and column.isna().any():
            values = [None if gone else v for v, gone in zip(values, column.isna().tolist(), strict=True)]
        columns.append(values)
    return map(row, *columns) if columns else iter(())


#: Rows that are Python objects at a time, read or written: what a task holds beside its state.
PIECE = 2000
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary()}


def values(column: pa.Array) -> list:
    """A column as Python values, None where one is missing; times are those of UTC, without a zone."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us"))
    elif pa.types.is_integer(column.type) and column.null_count:
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def fold(rows: DataFrame, key: list[str], order: list[str], state: Callable[[], object], schema: str, reads: list[str] | None = None) -> DataFrame:
    """Deal rows by key, sort them, and feed each key's rows to a state of its own.

    ``state()`` makes an object with ``step(row) -> rows`` and ``end() -> rows``; ``reads`` names the columns that it looks at
    (all by default), so that those for the order alone stay behind. A key's rows stream through a task in sorted pieces and
    so does what comes of them: what is in memory is the state, never the history. Arrays of text or numbers go to the task as JSON:
    for every row that Spark adds to a batch, it walks the batch's absent arrays again.
    """
    fields = [c.strip().split() for c in schema.split(",")]
    made = pa.schema([(name, _TYPES[kind]) for name, kind in fields])
    taken = list(dict.fromkeys([*key, *(reads or rows.columns)]))
    of = attrgetter(*key)
    lists = {f.name for f in rows.schema if isinstance(f.dataType, ArrayType)}
    sent = [F.to_json(c).alias(c) if c in lists else F.col(c) for c in taken]

    def read(name: str, column: pa.Array) -> list:
        found = values(column)
        return [x and json.loads(x) for x in found] if name in lists else found

    def written(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), made.types, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("Row", taken)
        now, held, out = None, None, []
        for batch in batches:
            for begin in range(0, batch.num_rows, PIECE):
                for r in map(row, *map(read, taken, batch.slice(begin, PIECE).columns)):
                    if held is None or of(r) != now:
                        if held is not None:
                            out += held.end()
                        now, held = of(r), state()
                    out += held.step(r)
                    if len(out) >= PIECE:
                        yield written(out)
                        out = []
        if held is not None:
            out += held.end()
        if out:
            yield written(out)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).select(*sent).mapInArrow(run, schema)
