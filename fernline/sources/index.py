"""Indexes of tables by a join key: copies that are bucketed and sorted by it, so that joins on the key don't move their rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..errors import QueryError
from .catalog import Catalog, Table


@dataclass(frozen=True)
class Index:
    source: str
    key: str
    buckets: int
    table: str
    original: Table


@dataclass
class Indexes:
    """The indexes of a catalog, by source path and key. A source has one at a time, since its rows lie in one order."""

    catalog: Catalog
    entries: dict[tuple[str, str], Index] = field(default_factory=dict)

    def build(self, name: str, key: str, buckets: int = 200) -> Index:
        """Write ``.name[]`` bucketed by the column ``key`` into the warehouse, and let queries read that copy.

        Tables that are to be joined without moving rows need as many buckets each.
        """
        table = self.catalog.tables.get(name)
        if table is None or key not in table.frame.columns:
            raise QueryError(f"there is no column {key} in .{name}[]")
        for entry in [e for e in self.entries.values() if e.source == f".{name}[]"]:
            self.remove(entry.source, entry.key)
            table = entry.original
        copy = f"fernline_index_{uuid.uuid4().hex}"
        # one file a bucket: the rows are dealt by the same hash beforehand
        table.frame.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(copy)
        rows = table.frame.sparkSession.table(copy)
        # where no key is null, saying so makes joins plain equalities, which the buckets serve
        required = frozenset() if rows.where(F.col(key).isNull()).limit(1).count() else frozenset({key})
        self.catalog.tables[name] = Table(rows, table.order, table.element, table.required | required)
        entry = Index(f".{name}[]", key, buckets, copy, table)
        self.entries[entry.source, key] = entry
        return entry

    def get(self, source: str, key: str) -> Index | None:
        return self.entries.get((source, key))

    def list(self) -> list[Index]:
        return [self.entries[k] for k in sorted(self.entries)]

    def remove(self, source: str, key: str) -> bool:
        """Forget an index, drop its copy and let queries read the source again."""
        entry = self.entries.pop((source, key), None)
        if entry is None:
            return False
        self.catalog.tables[source[1:-2]] = entry.original
        entry.original.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {entry.table}")
        return True
