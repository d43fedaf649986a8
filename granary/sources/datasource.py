"""Chat exports as a data source of Spark: `spark.read.format("chat_export").load(folder)`, and chunking as a table function."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.functions import udtf

from granary.operators.chunking import MAX_TOKENS, count_tokens

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class ExportFile(InputPartition):
    """A day of a channel."""

    path: str
    channel: str
    day: str


class ChatExportReader(DataSourceReader):
    """Files of a folder for each channel, a partition each. Filters on channel and day leave out files before any is read."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("channel",), ("day",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[ExportFile]:
        system, root = pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = [ExportFile(f.path, *f.path.rsplit("/", 2)[-2:]) for f in found if f.is_file and f.base_name[0] not in "_."]
        kept = [f for f in files if all(getattr(f, name) in values for name, values in self.wanted.items())]
        return sorted(kept, key=lambda f: f.path)

    def read(self, partition: ExportFile | None) -> Iterator[tuple]:
        """Messages of each JSON array of a file, an array a line or one over many lines; what is no message is left out."""
        if partition is None:
            return
        system, _ = pyarrow.fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with system.open_input_stream(partition.path) as file:
            text = file.read().decode()
        decoder, at = json.JSONDecoder(), 0
        while at < len(text.rstrip()):
            while text[at].isspace():
                at += 1
            items, at = decoder.raw_decode(text, at)
            for pos, m in enumerate(items):
                if isinstance(m, dict) and m.get("type") == "message":
                    yield partition.channel, partition.day, pos, m.get("user") or m.get("username") or "unknown", m.get("text") or "", m.get("ts"), m.get("thread_ts") or "main"


class ChatExport(DataSource):
    """(channel, day, pos, speaker, text, ts, thread) of the messages of an export: a folder of JSON arrays for each channel."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return "channel string, day string, pos int, speaker string, text string, ts string, thread string"

    def reader(self, schema) -> ChatExportReader:
        return ChatExportReader(self.options["path"])


@udtf(returnType="doc_id long, ordinal int, first int, last int, text string")
class ChunkMessages:
    """Rows (doc_id, pos, line) of a partition in order, as runs of lines within a limit of tokens, each beginning with the
    last line of the run before. `SELECT * FROM chunk_messages(TABLE(t) PARTITION BY doc_id ORDER BY (pos), 128)`. Null lines
    are empty. A run's lines are all that is held."""

    def __init__(self) -> None:
        self.doc_id, self.lines, self.sizes = None, [], []
        self.first = self.ordinal = self.total = 0
        self.open = False

    def _run(self) -> tuple:
        return self.doc_id, self.ordinal, self.first, self.first + len(self.lines) - 1, "\n".join(self.lines)

    def eval(self, row: Row, limit: int = MAX_TOKENS) -> Iterator[tuple]:
        line = row["line"] or ""
        size = count_tokens(line)
        self.doc_id, self.open = row["doc_id"], True
        if self.lines and self.total + size > limit:
            yield self._run()
            self.first += len(self.lines) - 1
            self.lines, self.sizes = self.lines[-1:], self.sizes[-1:]
            self.total = self.sizes[0]
            self.ordinal += 1
        self.lines.append(line)
        self.sizes.append(size)
        self.total += size

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._run()


def register(spark: SparkSession) -> None:
    """Makes the data source and the table function known to a session."""
    spark.dataSource.register(ChatExport)
    spark.udtf.register("chunk_messages", ChunkMessages)
    spark.conf.set(PUSHDOWN, "true")
