"""The virtual document: named tables and JSON documents, addressed by paths.

A table ``orders`` is the array at ``.orders[]``. A JSON document contributes its top-level members.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

#: Documents above this size are read member by member, since one VARIANT holds at most 128 MiB.
WHOLE_BYTES = 64 << 20
#: The table in a converted folder that names the others.
LISTED = "tables.parquet"


class Table:
    """Rows of a path. ``order``: a column whose order is the document's; ``element``: the rows are single values in this column.

    ``frame`` may be given as a function, which is called when a query first needs the table. ``required``: columns that are never null.
    """

    def __init__(self, frame: DataFrame | Callable[[], DataFrame], order: str | None = None, element: str | None = None, required: frozenset[str] = frozenset()):
        self._frame, self.order, self.element, self.required = frame, order, element, required

    @property
    def frame(self) -> DataFrame:
        if not isinstance(self._frame, DataFrame):
            self._frame = self._frame()
        return self._frame


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    #: one row, one VARIANT column ``doc``: what paths that name no table start from
    document: DataFrame | None = None
    #: arrays below the first level that are tables, by their path
    nested: dict[tuple[str, ...], Table] = field(default_factory=dict)
    #: the array that is the whole document
    root: Table | None = None
    #: gives the document with one member, or with all for None, where it is too large to be read whole for every query
    members: Callable[[str | None], DataFrame] | None = None
    #: the names of the members that are no arrays, where there is ``members``
    plain: list[str] = field(default_factory=list)

    def table(self, path: list[str]) -> Table | None:
        """The table whose rows are the elements at a path of names."""
        return self.root if not path else self.tables.get(path[0]) if len(path) == 1 else self.nested.get(tuple(path))

    def document_for(self, name: str | None) -> DataFrame | None:
        """The document, or enough of it for paths that begin with the member ``name``."""
        return self.document if self.members is None else self.members(name)

    def add(self, name: str, frame: DataFrame, order: str | None = None) -> Catalog:
        """Expose a DataFrame, batch or streaming, as ``.name[]``; ``order`` names a column that gives the rows' order."""
        if order is not None and order not in frame.columns:
            raise QueryError(f"{name} has no column {order}")
        self.tables[name] = Table(frame, order)
        return self

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: list[str] | None = None, order: dict[str, str] | None = None) -> Catalog:
        """The Parquet tables of a folder (``name.parquet``); without ``names`` they are listed with Spark's own file system."""
        if names is None:
            jvm, path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            del jvm
            names = sorted(m[1] for s in fs.listStatus(path) if (m := re.fullmatch(r"(.+)\.parquet", s.getPath().getName())))
        out = Catalog()
        for n in names:
            out.tables[n] = Table(partial(spark.read.parquet, f"{folder.rstrip('/')}/{n}.parquet"), (order or {}).get(n))
        return out

    @staticmethod
    def json(spark: SparkSession, path: str, typed: bool = False) -> Catalog:
        """A JSON document (one value in one file, at any path that Spark reads).

        VARIANT by default, which keeps missing and null apart and allows mixed kinds. ``typed`` reads
        homogeneous top-level arrays into native columns instead. A document above WHOLE_BYTES is read
        member by member: its arrays, at any depth below objects, are tables of VARIANT, and a path that starts elsewhere reads
        the one member that it names.
        """
        size, first = _peek(spark, path)
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        if size <= WHOLE_BYTES and not typed:
            return Catalog(document=reader.option("singleVariantColumn", "doc").json(path))
        if first == "[":
            # the reader would take each element for a document: the array becomes a member of one
            whole = spark.read.text(path, wholetext=True).select(F.from_json(F.concat(F.lit('{"r":'), "value", F.lit("}")), "r array<variant>", {"mode": "FAILFAST"}).alias("d"))
            return Catalog(root=Table(whole.select(F.posexplode("d.r").alias("__pos", "__item")), "__pos", "__item"))
        inferred = reader.json(path).schema
        out = Catalog()

        def member(name: str | None) -> DataFrame:
            names = [f.name for f in inferred.fields if name in (None, f.name)]
            if not names:
                return reader.json(path).select(F.parse_json(F.lit("{}")).alias("doc"))
            rows = reader.schema(T.StructType([T.StructField(n, T.VariantType()) for n in names])).json(path)
            return rows.select(F.call_function("to_variant_object", F.struct(*[F.col(f"`{n}`") for n in names])).alias("doc"))

        def rows_at(names: tuple[str, ...], kind: T.ArrayType) -> DataFrame:
            schema: T.DataType = kind
            for n in reversed(names):
                schema = T.StructType([T.StructField(n, schema)])
            column = F.col(f"`{names[0]}`")
            for n in names[1:]:
                column = column.getField(n)
            return reader.schema(schema).json(path).select(F.posexplode(column).alias("__pos", "__item"))

        def arrays(fields: list[T.StructField], above: tuple[str, ...]) -> None:
            for f in fields:
                names = (*above, f.name)
                if isinstance(f.dataType, T.ArrayType):
                    own = f.dataType if typed else T.ArrayType(T.VariantType())
                    rows, element = rows_at(names, own), own.elementType
                    table = Table(rows.select("__pos", "__item.*"), "__pos") if isinstance(element, T.StructType) else Table(rows, "__pos", "__item")
                    if above:
                        out.nested[names] = table
                    else:
                        out.tables[f.name] = table
                elif isinstance(f.dataType, T.StructType) and not typed:
                    arrays(f.dataType.fields, names)

        arrays(inferred.fields, ())
        out.members, out.plain = member, [f.name for f in inferred.fields if not isinstance(f.dataType, T.ArrayType)]
        return out

    @staticmethod
    def json_text(spark: SparkSession, text: str) -> Catalog:
        """A JSON document given as text."""
        if not text.strip():
            raise QueryError("the document is empty")
        return Catalog(document=spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("doc")))

    @staticmethod
    def cached_json(spark: SparkSession, path: str, cache: str) -> Catalog:
        """A JSON document by way of a Parquet copy in the folder ``cache``, made anew when the file's size or time has changed."""
        file = status(spark, path)
        key = hashlib.sha256(f"{file.getPath()}|{file.getLen()}|{file.getModificationTime()}".encode()).hexdigest()[:24]
        folder = f"{cache.rstrip('/')}/{key}"
        if not _exists(spark, f"{folder}/{LISTED}"):
            Catalog.json(spark, path).convert(folder)
        return Catalog.converted(spark, folder)

    def convert(self, folder: str) -> Catalog:
        """Write every table as Parquet once and return a catalog of the copies: columnar, splittable and typed as loaded.

        A JSON document's arrays become tables first; its members that are no arrays are written as values, one row each.
        """
        tables: dict[tuple[str, ...], Table] = {(n,): t for n, t in self.tables.items()} | self.nested | ({(): self.root} if self.root is not None else {})
        spark, parts = None, [] if self.members is None else [self.members(n) for n in self.plain]
        if self.document is not None:
            tables |= _arrays(self.document)
            parts = [self.document]
        out: list[tuple[str, str | None, str | None, str]] = []
        for i, (names, t) in enumerate(tables.items()):
            t.frame.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/table-{i}.parquet")
            spark = t.frame.sparkSession
            out.append((json.dumps(names), t.order, t.element, f"table-{i}.parquet"))
        arrays = [n[0] for n in tables if len(n) == 1]
        for i, part in enumerate(parts):
            spark = part.sparkSession
            values = part.select(F.explode(F.try_variant_get("doc", "$", "map<string,variant>")).alias("name", "value"))
            values.where(~F.col("name").isin(arrays)).write.mode("append" if i else "overwrite").parquet(f"{folder.rstrip('/')}/members.parquet")
        if spark is None:
            return Catalog()
        # written last: it says that the copy is whole
        spark.createDataFrame(out, "path string, order string, element string, file string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{LISTED}")
        return Catalog.converted(spark, folder)

    @staticmethod
    def converted(spark: SparkSession, folder: str) -> Catalog:
        """The catalog of a folder that `convert` wrote."""
        out = Catalog()
        for r in spark.read.parquet(f"{folder.rstrip('/')}/{LISTED}").collect():
            names, table = tuple(json.loads(r["path"])), Table(partial(spark.read.parquet, f"{folder.rstrip('/')}/{r['file']}"), r["order"], r["element"])
            if not names:
                out.root = table
            elif len(names) == 1:
                out.tables[names[0]] = table
            else:
                out.nested[names] = table
        if _exists(spark, f"{folder.rstrip('/')}/members.parquet"):
            values = spark.read.parquet(f"{folder.rstrip('/')}/members.parquet")

            def member(name: str | None) -> DataFrame:
                some = values if name is None else values.where(F.col("name") == name)
                for n, t in out.tables.items():
                    if name in (None, n):
                        some = some.unionByName(t.frame.agg(F.call_function("to_variant_object", _in_order(t)).alias("value")).withColumn("name", F.lit(n)))
                pairs = F.map_from_entries(F.collect_list(F.struct("name", "value")))  # the members of one document
                return some.agg(F.call_function("to_variant_object", pairs).alias("doc"))

            out.members, out.plain = member, [r["name"] for r in values.select("name").collect()]
        return out


def _in_order(t: Table) -> Column:
    """The elements of a table as one array, as an aggregate."""
    listed = F.collect_list(F.struct(F.col(t.order).alias("at"), F.col(t.element).alias("item")))
    return F.transform(F.array_sort(listed, lambda a, b: a["at"] - b["at"]), lambda x: x["item"])


def status(spark: SparkSession, path: str):
    """Size and time of a file, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    except Py4JJavaError as e:
        raise QueryError(f"no such file: {path}") from e


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _peek(spark: SparkSession, path: str) -> tuple[int, str]:
    """A file's size and its first character that is no white space."""
    size = status(spark, path).getLen()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        while (c := stream.read()) in (9, 10, 13, 32, 0xEF, 0xBB, 0xBF):
            pass
    finally:
        stream.close()
    if c < 0:
        raise QueryError(f"{path} is empty")
    return size, chr(c)


def _arrays(document: DataFrame) -> dict[tuple[str, ...], Table]:
    """The arrays of a document that is a VARIANT: itself, or its members."""
    kind = document.select(F.schema_of_variant("doc").alias("k")).first()["k"]
    if kind.startswith("ARRAY"):
        return {(): Table(document.select(F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("__pos", "__item")), "__pos", "__item")}
    members = document.select(F.explode(F.try_variant_get("doc", "$", "map<string,variant>")).alias("name", "value"))
    found = {}
    for r in members.where(F.schema_of_variant("value").startswith("ARRAY")).select("name").collect():
        quoted = r["name"].replace("\\", "\\\\").replace('"', '\\"')
        rows = document.select(F.posexplode(F.try_variant_get("doc", f'$["{quoted}"]', "array<variant>")).alias("__pos", "__item"))
        found[(r["name"],)] = Table(rows, "__pos", "__item")
    return found
