"""Growing log files as a stream of lines, resumed at byte offsets.

The folder is one that the machines which run the query see under the same path. A line is read once its line feed is there.
A log is known by its file (the number that the file system has for it) and the beginning of its first line: one that is
renamed goes on where it was, one that became shorter or begins otherwise was begun anew and is read from its start. A log that
is no longer the live one (``Game.log``) is finished: behind its lines comes a mark, a row whose ``line`` is null, which
may come more than once. A copy of a log is another log.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .gamelog import split_bytes

LINES = "path string, file long, begun string, line_offset long, line string"
LIVE = "game.log"


#: Bytes of the first line that tell a log from the one before it in the same file.
HEAD = 64


def _files(folder: str) -> dict[str, list]:
    """Length up to the last line feed, beginning of the first line, and file number of each log file."""
    out = {}
    for top, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".log"):
                path = os.path.join(top, name)
                try:
                    with open(path, "rb") as f:
                        f.seek(0)
                        head = f.read(HEAD).split(b"\n")[0].decode("utf-8", "replace")
                        out[path] = [_whole(f), head, os.fstat(f.fileno()).st_ino]
                except OSError:
                    continue  # tried again with the next batch
    return out


def _live(path: str) -> bool:
    return os.path.basename(path).lower() == LIVE


def _whole(f) -> int:
    at = f.seek(0, os.SEEK_END)
    while at:
        size = min(at, 1 << 16)
        f.seek(at - size)
        found = f.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


class _Part(InputPartition):
    def __init__(self, path: str, file: int, begun: str, start: int, end: int, finished: bool):
        self.path, self.file, self.begun, self.start, self.end, self.finished = path, file, begun, start, end, finished


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(_files(self.folder), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        before = {(file, head): (n, path) for path, (n, head, file) in json.loads(start["files"]).items()}
        parts = []
        for path, (n, head, file) in sorted(json.loads(end["files"]).items()):
            old, old_path = before.get((file, head), (0, None))
            begin = 0 if n < old else old
            finished = not _live(path) and (n > begin or old_path is not None and _live(old_path))
            if n > begin or finished:
                parts.append(_Part(path, file, head, begin, n, finished))
        return parts or [_Part("", 0, "", 0, 0, False)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        log = partition.path, partition.file, partition.begun
        for at, text in split_bytes(data):
            yield *log, partition.start + at, text.lstrip("\ufeff") if partition.start + at == 0 else text
        if partition.finished:
            yield *log, partition.end, None

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("gamelog").load(folder)``, once registered."""

    @classmethod
    def name(cls) -> str:
        return "gamelog"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
