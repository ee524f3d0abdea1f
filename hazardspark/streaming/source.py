"""A stream source with offsets over a folder of append-only logs of JSON lines, as a Python data source.

An offset is how many bytes of each log have been taken. Only whole lines count. A batch is read by the executors, a part of a log a task, so a batch
that runs again reads the same lines. What a query has committed is written beside, so that its lag can be told. The folder must be mounted on all machines.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Part(InputPartition):
    def __init__(self, path: str, log: str, start: int, end: int):
        self.path, self.log, self.start, self.end = path, log, start, end


def ends(path: str) -> dict[str, int]:
    """Bytes of whole lines of each log."""
    found = {}
    for log in sorted(x for x in os.listdir(path) if x.endswith(".jsonl")):
        with open(os.path.join(path, log), "rb") as f:
            size = f.seek(0, os.SEEK_END)
            while size:  # back to the last line end
                step = min(size, 1 << 16)
                f.seek(size - step)
                at = f.read(step).rfind(b"\n")
                if at >= 0:
                    size += at + 1 - step
                    break
                size -= step
        found[log] = size
    return found


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.committed = options["path"], options.get("committed")
        self.latest, self.most = options.get("startingoffsets", "earliest") == "latest", int(options.get("maxbytesperpart", 64 << 20))

    def initialOffset(self) -> dict:
        return ends(self.path) if self.latest else {}

    def latestOffset(self) -> dict:
        return ends(self.path)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for log, stop in sorted(end.items()):
            begin = start.get(log, 0)
            out += [Part(self.path, log, a, min(stop, a + self.most)) for a in range(begin, stop, self.most)]
        return out

    def read(self, part: Part) -> Iterator[tuple[str, int, str]]:
        """The lines that begin in the part; one that goes on beyond it is read to its end."""
        with open(os.path.join(part.path, part.log), "rb") as f:
            f.seek(max(0, part.start - 1))
            if part.start and f.read(1) != b"\n":
                f.readline()
            while (at := f.tell()) < part.end:
                yield part.log, at, f.readline().rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        if self.committed:
            with open(f"{self.committed}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.committed}.new", self.committed)


class ReportLog(DataSource):
    """format("report_log") with path, startingOffsets (earliest, latest), committed and maxBytesPerPart."""

    @classmethod
    def name(cls) -> str:
        return "report_log"

    def schema(self) -> str:
        return "log string, offset long, value string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ReportLog)
    return spark.readStream.format("report_log").options(path=path, **options).load()


def lag(path: str, committed: str) -> dict[str, int]:
    """Bytes of each log that no committed batch has taken."""
    taken = {}
    if os.path.exists(committed):
        with open(committed) as f:
            taken = json.load(f)
    return {log: end - taken.get(log, 0) for log, end in ends(path).items()}
