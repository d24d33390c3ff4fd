"""Tailing of line files that grow: a streaming data source with an offset a file.

The driver lists files and finds the last line end of each; executors read the byte ranges. A file that shrank is
read from its start again; a line without its end waits.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one file that one task reads at most; ranges end at line ends.
RANGE_BYTES = 64 << 20
_BACK = 1 << 16


def last_line_end(path: str, size: int, low: int = 0) -> int:
    """The offset behind the last line end before size, or low if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > low:
            start = max(low, at - _BACK)
            f.seek(start)
            block = f.read(at - start)
            cut = block.rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            at = start
    return low


class _Bytes(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                size = os.path.getsize(path)
                before = self.last.get(path, 0)
                now[path] = last_line_end(path, size, before if before <= size else 0)
            except OSError:
                continue  # it went away between listing and reading
        self.last = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Bytes]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, high in now.items():
            low = was.get(path, 0)
            if high < low:
                low = 0  # the file shrank
            while high - low > self.range_bytes:
                cut = last_line_end(path, low + self.range_bytes, low)
                if cut == low:
                    break  # one line longer than a range
                out.append(_Bytes(path, low, cut))
                low = cut
            if high > low:
                out.append(_Bytes(path, low, high))
        return out or [_Bytes("", 0, 0)]

    def read(self, partition: _Bytes) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.low)
            at = partition.low
            while at < partition.high:
                line = f.readline()
                if not line:
                    return
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LineTail(DataSource):
    """readStream.format("line_tail").option("path", glob): file, pos (byte offset), line."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, pos long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the lines of all files of a glob; files must be visible to driver and executors alike."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", path).option("rangeBytes", str(range_bytes)).load()
