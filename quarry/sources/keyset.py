"""Paged scans by key (S15): a Python data source whose tasks ask for pages behind the last key until one comes short."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Store(Protocol):
    """A table that gives pages in the order of an integer key. Instances travel to the tasks."""

    def bounds(self) -> tuple[int, int] | None:
        """Smallest and largest key, None for an empty table."""

    def page(self, after: int, upto: int, limit: int) -> pa.Table:
        """At most ``limit`` rows with after < key <= upto in the order of the key."""

    def equal(self, key: int | None) -> pa.Table:
        """All rows of a key, or those without one."""


class ParquetStore:
    """Pages of Parquet files; conditions on the key reach the row groups' statistics."""

    def __init__(self, path: str, key: str, columns: list[str]) -> None:
        self.path, self.key, self.columns = path, key, columns

    def _table(self) -> ds.Dataset:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return ds.dataset(path, format="parquet", filesystem=system)

    def _rows(self, condition: ds.Expression) -> pa.Table:
        return self._table().to_table(columns=self.columns, filter=condition, use_threads=False)

    def bounds(self) -> tuple[int, int] | None:
        """From the statistics in the footers; a row group without them is read."""
        low, high = [], []
        for piece in self._table().get_fragments():
            for group in piece.row_groups:
                known = (group.statistics or {}).get(self.key)
                if known is None:
                    column = piece.subset(row_group_ids=[group.id]).to_table(columns=[self.key], use_threads=False).column(0)
                    known = pc.min_max(column).as_py()
                if known["min"] is not None:
                    low.append(known["min"])
                    high.append(known["max"])
        return (min(low), max(high)) if low else None

    def page(self, after: int, upto: int, limit: int) -> pa.Table:
        """Reads ever wider stretches of keys until they hold a page, so that no page reads all that is behind it."""
        key, width = ds.field(self.key), limit
        while True:
            top = min(upto, after + width)
            rows = self._rows((key > after) & (key <= top))
            if len(rows) >= limit or top == upto:
                return rows.take(pc.sort_indices(rows, [(self.key, "ascending")])[:limit])
            width *= 4

    def equal(self, key: int | None) -> pa.Table:
        return self._rows(ds.field(self.key).is_null() if key is None else ds.field(self.key) == key)


def pages(store: Store, key: str, after: int, upto: int, limit: int) -> Iterator[pa.Table]:
    """The rows with after < key <= upto, a page at a time; the first page with fewer rows than asked for is the last.

    A full page may end within rows of one key: these are taken whole in its place, so that none is lost behind the key.
    """
    while True:
        rows = store.page(after, upto, limit)
        if len(rows) < limit:
            if len(rows):
                yield rows
            return
        after = rows.column(key)[-1].as_py()
        yield pa.concat_tables([rows.filter(pc.less(rows.column(key), after)), store.equal(after)])


class Range(InputPartition):
    """Keys behind ``after`` up to ``upto``; both None for the rows without a key."""

    def __init__(self, after: int | None, upto: int | None) -> None:
        super().__init__((after, upto))
        self.after, self.upto = after, upto


def ranges(after: int, upto: int, n: int) -> list[Range]:
    """At most n ranges of nearly equal width that cover the keys behind ``after`` up to ``upto``."""
    n = max(1, min(n, upto - after))
    cuts = [after + (upto - after) * k // n for k in range(n + 1)]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class KeysetSource(DataSource):
    """Options: path, key (an integer column), columns (a DDL schema with the key), page (rows a request, 1,000 if not
    given), parts (key ranges read at once, 8 if not given).

    Batch: all rows, those without a key in a part of their own. Stream: rows whose keys are behind those already read; the
    offset is the largest key read, so a query that starts again goes on behind it. Rows without a key, and rows added later
    with keys already passed, aren't part of a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return KeysetReader(self._store(schema), self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return KeysetStream(self._store(schema), self.options)

    def _store(self, schema) -> Store:
        return ParquetStore(self.options["path"], self.options["key"], schema.fieldNames())


class _Pages:
    def __init__(self, store: Store, options: dict[str, Any]) -> None:
        self.store, self.key = store, options["key"]
        self.limit, self.parts = int(options.get("page", 1000)), int(options.get("parts", 8))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        loose = partition.after is None
        found = [self.store.equal(None)] if loose else pages(self.store, self.key, partition.after, partition.upto, self.limit)
        for table in found:
            yield from table.to_batches()


class KeysetReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        found = self.store.bounds()
        return [Range(None, None), *(ranges(found[0] - 1, found[1], self.parts) if found else [])]


class KeysetStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        found = self.store.bounds()
        return {"after": found[0] - 1 if found else -(2**62)}

    def latestOffset(self) -> dict:
        found = self.store.bounds()
        return {"after": found[1] if found else -(2**62)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(start["after"], end["after"], self.parts) if start["after"] < end["after"] else []

    def commit(self, end: dict) -> None:
        """Nothing to give back to the store."""
