"""Tables on disk: idempotent rows, merged dimensions, snapshots that readers see whole."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA_VERSION, PARSER_VERSION = 19, 9
DIMENSIONS = ("wiki_item", "wiki_vehicle", "wiki_location", "place_name")


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the given order. Partial aggregates, so that a hot key is one row a task."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def insert_new(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the store lacks: what an insert that ignores conflicts adds."""
    return rows.dropDuplicates(key).join(store.select(*key).distinct(), key, "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir); only where none is set, as in tests, one is made."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the checkpoint folder: what is built on it has a short plan and outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written now as Parquet in the checkpoint folder: for tables of which readers want some columns or rows only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Versions of a set of tables below one folder; a version counts once its pointer file is there, which is written last.

    Pointers are never replaced: the current version is the highest one that has one. So a crash at any point leaves
    readers with the version before. Paths may be on any file system that Spark reads.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, prefix: str) -> list[int]:
        """Numbers behind the prefix of the folder's entries."""
        fs, p = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _meta(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/committed-{version}").first()[0])

    def current(self) -> int | None:
        return max(self._versions("committed-"), default=None)

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write the next version; folders of one that was never finished are not used again."""
        version = max([0, *self._versions("committed-"), *self._versions("v=")]) + 1
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.path}/v={version}/{name}")
        fs, tmp = self._fs(f"{self.path}/_new-{version}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": version, "schema": SCHEMA_VERSION, "parser": PARSER_VERSION}).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.path}/committed-{version}")[1]):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def stale(self) -> bool:
        """Whether the stored version was derived by other rules and must be derived anew."""
        version = self.current()
        if version is None:
            return True
        meta = self._meta(version)
        return (meta["schema"], meta["parser"]) != (SCHEMA_VERSION, PARSER_VERSION)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.current()}/{name}")

    def reset(self, keep: tuple[str, ...] = DIMENSIONS) -> None:
        """Derived tables go with the pointer; dimensions stay, as a version of their own."""
        version = self.current()
        if version is None:
            return
        fs, _ = self._fs(self.path)
        kept = {name: self.read(name, version) for name in keep if fs.exists(self._fs(f"{self.path}/v={version}/{name}")[1])}
        self.publish(kept)


def register(tables: dict[str, DataFrame]) -> None:
    """Views for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
