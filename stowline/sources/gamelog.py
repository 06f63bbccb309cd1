"""Log files as lines with byte offsets, and which files to read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.store import keep

# Fixed value: the first build whose logs are read.
FIRST_BUILD = 12232306


def split_bytes(data: bytes) -> Iterator[tuple[int, str]]:
    """(offset, text) of each line that ends in a line feed; one carriage return before it goes, and a BOM at the start.

    What stands behind the last line feed is not a line yet.
    """
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end]
        if line.endswith(b"\r"):
            line = line[:-1]
        if at == 0 and line.startswith(b"\xef\xbb\xbf"):
            line = line[3:]
        yield at, line.decode("utf-8", "replace")
        at = end + 1


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path (as a URI, like those of lines), modified and length of each log file; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), "length")


def discover(spark: SparkSession, folder: str, cutoff: str = "2026-07-16 00:00:00") -> DataFrame:
    """Files of a folder to read: path, is_live, build, modified, ingest_seq (by time of change, then path).

    A backup counts by the build in its name, or, without one, by its time of change; the live log always does.
    """
    name = F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1)
    build = F.regexp_extract(name, r"Build\((\d+)\)", 1)
    out = _files(spark, folder).select("path", (F.lower(name) == "game.log").alias("is_live"), F.when(build != "", build).cast("int").alias("build"), "modified", "length")
    wanted = F.col("is_live") | F.coalesce(F.col("build") >= FIRST_BUILD, F.col("modified") >= F.lit(cutoff).cast("timestamp"))
    return out.where(wanted).withColumn("ingest_seq", F.row_number().over(Window.orderBy("modified", F.lower("path"))))


def _text(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files: path, block (where their byte range begins), length of the file, n (bytes with the line feed), line.

    Spark cuts files into byte ranges (``spark.sql.files.maxPartitionBytes``), which begin at the first line feed in them;
    so a large file is many tasks, on any file system that Spark reads.
    """
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(folder)
    value = F.make_valid_utf8("value")
    line = F.when(value.endswith("\r"), F.expr("left(make_valid_utf8(value), length(make_valid_utf8(value)) - 1)")).otherwise(value)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("length"), (F.octet_length("value") + 1).cast("long").alias("n"), line.alias("line"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the bytes and the number of lines that stand before them in their range; the text passes through as it is."""
    now, begin, number = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(3).to_numpy()
        path, block = batch.column(0), batch.column(1).to_numpy()
        change = np.concatenate([[now != (path[0].as_py(), int(block[0]))], (block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)]).astype(bool)
        total, row = np.cumsum(n) - n + begin, np.arange(len(n)) + number
        first = np.maximum.accumulate(np.where(change, np.arange(len(n)), -1))
        own = first >= 0
        at, nth = np.where(own, total - total[first], total), np.where(own, row - row[first], row)
        now, begin, number = (path[-1].as_py(), int(block[-1])), int(at[-1] + n[-1]), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(nth, pa.int64())], names=[*batch.schema.names, "at", "number"])


def read_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lines (path, line_no, line_offset, line) of the log files below a folder; and the files not read whole (path, length, bytes).

    The logs are read once, into a table of the checkpoint folder; a line's offset is what stands before it in its range and
    what the file's earlier ranges hold. A file of which a part can't be read gives no lines at all, whatever else of it could
    be; it is listed, to be read the next time. What stands behind the last line feed is not a line yet (a live log may grow
    while it is read: what its listing did not count is left for the next time), and a byte order mark belongs to no line.
    """
    raw = keep(_text(spark, folder).mapInArrow(_placed, "path string, block long, length long, n long, line string, at long, number long"), "lines")
    ranges = raw.groupBy("path", "block").agg(F.max(F.col("at") + F.col("n")).alias("bytes"), F.count("*").alias("lines"), F.max("length").alias("length"))
    of_file = Window.partitionBy("path")
    before = [(F.sum(c).over(of_file.orderBy("block")) - F.col(c)).alias(f"{c}_before") for c in ("bytes", "lines")]
    ranges = ranges.select("path", "block", "length", *before, F.sum("bytes").over(of_file).alias("read"))
    # A mark of three bytes is read by nobody; a last line without a line feed is counted with one.
    mark = F.when((F.col("length") - F.col("read")).isin(2, 3), F.lit(3)).otherwise(F.lit(0))
    ranges = keep(ranges.withColumn("mark", mark).withColumn("whole", F.col("read") + F.col("mark") >= F.col("length")), "ranges")
    end, line_no = F.col("bytes_before") + F.col("at") + F.col("n") + F.col("mark"), F.col("lines_before") + F.col("number")
    lines = raw.drop("length").join(ranges.where("whole"), ["path", "block"]).where(end <= F.col("length"))
    lines = lines.select("path", line_no.alias("line_no"), F.when(line_no == 0, F.lit(0)).otherwise(end - F.col("n")).alias("line_offset"), "line")
    got = ranges.groupBy("path").agg(F.max("read").alias("bytes"), F.first("whole").alias("whole"))
    missed = _files(spark, folder).where("length > 0").join(got, "path", "left").where(~F.coalesce("whole", F.lit(False)))
    return lines, missed.select("path", "length", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files of a folder: path, line_offset, line."""
    return read_log(spark, folder)[0].drop("line_no")


def sessions_of(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with session_id, and (path, ingest_seq, session_id): a hash of the file's path and its first time, so that a file begun anew is another session."""
    from ..functions.events import split_lines

    first = split_lines(lines.withColumn("session_id", F.lit(0))).groupBy("path").agg(F.min_by("ts", "line_offset").alias("first_ts"))
    ids = keep(files.join(first, "path").select("path", "ingest_seq", F.xxhash64("path", F.col("first_ts").cast("string")).alias("session_id")), "sessions")
    return lines.join(ids, "path").select("session_id", "ingest_seq", "path", "line_offset", "line"), ids


def build_of(lines: DataFrame) -> DataFrame:
    """path -> build from the first 21 lines, for files whose name has none."""
    build = F.regexp_extract("line", r"Build\((\d+)\)", 1)
    return lines.where((F.col("line_no") < 21) & (build != "")).groupBy("path").agg(F.min_by(build.cast("int"), "line_offset").alias("build"))
