"""A log of requests as a stream: files of JSON lines that grow, read by offsets, each request answered once.

Offsets are how far each file was read, in whole lines, so a file that is appended to goes on where it was left and a line that
is still being written waits. A restart continues from the checkpoint: a micro-batch that was planned is read again
as it was, and answers are written to a folder of its own number that a repetition replaces.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Bytes that are searched for the last end of a line at once.
TAIL = 1 << 16


def _store(path: str):
    """A file system that driver and executors open the log's folder by, and the folder's name in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    """Bytes ``[low, high)`` of a file."""

    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


class RequestReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        # bytes of a micro-batch at most (back-pressure), and of a task
        self.most, self.part = int(options.get("maxbytespertrigger", 1 << 30)), int(options.get("bytespertask", 16 << 20))
        self.names = schema.fieldNames()
        self.done: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _ends(self) -> dict[str, int]:
        """Every file's length up to its last whole line."""
        from pyarrow import fs

        store, folder = _store(self.path)
        out = {}
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(self.suffix):
                end = f.size
                with store.open_input_file(f.path) as data:
                    while end > 0:
                        low = max(0, end - TAIL)
                        data.seek(low)
                        at = data.read(end - low).rfind(b"\n")
                        if at >= 0:
                            end = low + at + 1
                            break
                        end = low
                out[f.base_name] = end
        return out

    def latestOffset(self) -> dict:
        """Files in order of their names, no more than a micro-batch may have beyond what was planned before."""
        room, out = self.most, dict(self.done)
        for name, end in sorted(self._ends().items()):
            low = out.get(name, 0)
            if end <= low or room <= 0:
                continue
            if end - low > room:
                end = self._line_end(name, low + room) or end
            out[name], room = end, room - (end - low)
        self.done = out
        return out

    def _line_end(self, name: str, at: int) -> int:
        """Behind the first line that ends at ``at`` or later."""
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{name}") as data:
            data.seek(at - 1)
            while block := data.read(TAIL):
                found = block.find(b"\n")
                if found >= 0:
                    return data.tell() - len(block) + found + 1
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """Ranges of whole lines, of about ``bytesPerTask`` each."""
        for name, x in end.items():  # after a restart planning goes on from here
            self.done[name] = max(x, self.done.get(name, 0))
        out = []
        for name, high in sorted(end.items()):
            low = start.get(name, 0)
            while low < high:
                cut = high if high - low <= self.part else min(high, self._line_end(name, low + self.part) or high)
                out.append(Part(name, low, cut))
                low = cut
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as data:
            data.seek(partition.low)
            rest = data.read(partition.high - partition.low)
        for line in rest.splitlines():
            try:
                record = json.loads(line)
            except ValueError:
                continue
            if isinstance(record, dict):
                yield tuple(record.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """Nothing to do: lines stay in the log."""


class RequestLog(DataSource):
    """``spark.readStream.format("request_log").schema(...).load(folder)``. Lines that aren't a JSON object are skipped, fields
    that a line lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return "qid BIGINT, question STRING"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RequestReader(schema, {k.lower(): v for k, v in self.options.items()})


def request_log(spark: SparkSession, path: str, schema: str = "qid BIGINT, question STRING", most_bytes: int = 1 << 30) -> DataFrame:
    """Requests of a folder of growing files of JSON lines, as a stream."""
    spark.dataSource.register(RequestLog)
    return spark.readStream.format("request_log").schema(schema).option("maxBytesPerTrigger", most_bytes).load(path)


def answer(requests: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Answer every request of the stream once: each micro-batch goes to ``search`` as a whole, and its answers as JSON lines to a folder
    of its number, which a repetition of the batch replaces. Without ``every`` (an interval) one micro-batch takes what
    there is, up to the log's bound, and the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def answers(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All answers that are written, with the number of their batch."""
    return spark.read.schema(schema + ", batch BIGINT").json(out)
