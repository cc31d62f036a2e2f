"""An object store as a Spark data source: listings in batches and as a stream, and one object for each key.

A client is made in each task by a factory (so that it needs no pickling) and has ``list(prefix, token) -> (objects, next token or
None)`` with objects as dicts (key, etag, size, content_type, modified: seconds), and ``put(key, content, content_type)``, which replaces the
object of that key. The reader has a partition for each prefix and follows its page tokens; the writer's
objects are the same whichever attempt of a task writes them, so that a repeated task changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import Row, StructType

LISTING = "key string, asset_team string, etag string, size long, content_type string, modified double"
OBJECTS = "key string, content binary, content_type string"
JSON_TYPE, BINARY_TYPE = "application/json", "application/octet-stream"


def unquoted(etag: str | None) -> str:
    """An entity tag without its quotes and without the mark of a weak one."""
    return (etag or "").removeprefix("W/").strip('"')


def is_placeholder(key: str, size: int) -> bool:
    """What stands for a folder only."""
    return key.endswith("/") and size == 0


def row_of(o: dict) -> tuple:
    return o["key"], o["key"].split("/")[0], unquoted(o.get("etag")), o.get("size", 0), o.get("content_type") or BINARY_TYPE, float(o.get("modified") or 0)


def pages(client: Any, prefix: str) -> Iterator[tuple]:
    """The listing's rows under a prefix, page after page; a token that doesn't move is an error."""
    token, seen = None, set()
    while True:
        objects, token = client.list(prefix, token)
        yield from (row_of(o) for o in objects if not is_placeholder(o["key"], o.get("size", 0)))
        if token is None:
            return
        if token in seen:
            raise ValueError(f"the listing of {prefix!r} comes back to token {token!r}")
        seen.add(token)


class Written(WriterCommitMessage):
    def __init__(self, n: int) -> None:
        self.n = n


def object_store(make_client: Callable[[], Any], name: str = "objects") -> type[DataSource]:
    """A data source to register: option ``prefixes`` is a JSON list (all objects without it)."""

    class Prefix(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, prefixes: list[str]) -> None:
            self.prefixes = prefixes

        def partitions(self) -> list[InputPartition]:
            return [Prefix(p) for p in self.prefixes]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from pages(make_client(), partition.value)

    class Stream(SimpleDataSourceStreamReader):
        """New and changed objects, by when they were modified; those of one moment come in one batch."""

        def __init__(self, prefixes: list[str]) -> None:
            self.prefixes = prefixes

        def initialOffset(self) -> dict:
            return {"modified": -1.0}

        def _between(self, after: float, until: float) -> list[tuple]:
            client = make_client()
            return [r for p in self.prefixes for r in pages(client, p) if after < r[5] <= until]

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = self._between(start["modified"], float("inf"))
            return iter(rows), {"modified": max([start["modified"], *(r[5] for r in rows)])}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(self._between(start["modified"], end["modified"]))

        def commit(self, end: dict) -> None:
            pass

    class Writer(DataSourceWriter):
        def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
            client, n = make_client(), 0
            for r in rows:
                client.put(r.key, bytes(r.content), r.content_type or BINARY_TYPE)
                n += 1
            return Written(n)

    class Objects(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTING

        def _prefixes(self) -> list[str]:
            found = sorted(set(json.loads(self.options.get("prefixes", '[""]'))))
            # a prefix within another would give its objects twice
            return [p for p in found if not any(p != q and p.startswith(q) for q in found)]

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self._prefixes())

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return Stream(self._prefixes())

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if [f.name for f in schema] != ["key", "content", "content_type"]:
                raise ValueError(f"objects are written from {OBJECTS}")
            return Writer()

    return Objects
