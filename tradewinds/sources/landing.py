"""A folder of JSON lines as a stream of messages, so many a batch at most."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Messages a batch at most.
LIMIT = 250


class LandingReader(SimpleDataSourceStreamReader):
    """Reads files in the order of their names, line by line; an offset is a file and the number of its lines that were read.

    A file must be complete when it appears (write it under another name and rename it), and names must grow. Lines that hold
    no JSON object are passed over, but counted.
    """

    def __init__(self, folder: str, limit: int, fields: list[str]):
        self.folder, self.limit, self.fields = Path(folder), limit, fields

    def initialOffset(self) -> dict:
        return {"file": "", "line": 0}

    def _lines(self, start: dict) -> Iterator[tuple[dict, tuple | None]]:
        """(offset behind the line, row) from an offset on."""
        for path in sorted(self.folder.glob("*.json")):
            if path.name < start["file"]:
                continue
            skip = start["line"] if path.name == start["file"] else 0
            with path.open(encoding="utf-8", errors="replace") as lines:
                for n, line in enumerate(lines, 1):
                    if n > skip:
                        try:
                            found = json.loads(line)
                        except ValueError:
                            found = None
                        yield {"file": path.name, "line": n}, tuple(None if (v := found.get(f)) is None else str(v) for f in self.fields) if isinstance(found, dict) else None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for end, row in self._lines(start):
            if row is not None:
                rows.append(row)
            if len(rows) >= self.limit:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        last = (end["file"], end["line"])
        for at, row in self._lines(start):
            if (at["file"], at["line"]) > last:
                return
            if row is not None:
                yield row


class Landing(DataSource):
    """Format ``landing``: options ``path`` and ``limit``; the schema's columns are strings, named as the JSON fields."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "source_key string, player string, message string, posted_at string"

    def simpleStreamReader(self, schema) -> LandingReader:
        return LandingReader(self.options["path"], int(self.options.get("limit", LIMIT)), [f.name for f in schema.fields])


def read_messages(spark: SparkSession, path: str, limit: int = LIMIT):
    """The messages of a landing folder as a stream of at most ``limit`` a batch; a restart loses and repeats none."""
    spark.dataSource.register(Landing)
    return spark.readStream.format("landing").option("path", path).option("limit", limit).load()
