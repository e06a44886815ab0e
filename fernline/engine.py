"""The engine: compile and run queries over a catalog."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .lang import ast
from .lang.format import format_query, query as query_text
from .lang.outline import outline
from .lang.parser import parse
from .plans.lower import Lowered, Lowerer
from .sinks import emit
from .sources.catalog import Catalog


@dataclass
class Result:
    rows: list[object]
    hit_limit: bool
    seconds: float
    scanned: int | None = None


class Engine:
    """Queries over one catalog: ``Engine(Catalog.parquet(spark, folder)).query("from .orders[] as o ...")``."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @staticmethod
    def json(spark: SparkSession, path: str, typed: bool = False) -> Engine:
        return Engine(Catalog.json(spark, path, typed))

    @staticmethod
    def json_text(spark: SparkSession, text: str) -> Engine:
        return Engine(Catalog.json_text(spark, text))

    @staticmethod
    def parquet(spark: SparkSession, folder: str, names: list[str] | None = None, order: dict[str, str] | None = None) -> Engine:
        return Engine(Catalog.parquet(spark, folder, names, order))

    def lower(self, text: str | ast.Query, params: dict[str, object] | None = None, ordered: bool = False, observe: bool = False) -> Lowered:
        """Compile a query. With ``observe`` the rows of its sources (not of subqueries) are counted while it runs."""
        tree = parse(text) if isinstance(text, str) else text
        try:
            return Lowerer(self.catalog, params, ordered, observe).query(tree)[0]
        except AnalysisException as e:
            raise QueryError(f"the query can't be compiled: {str(e).splitlines()[0]}") from e

    def query(self, text: str | ast.Query, params: dict[str, object] | None = None) -> DataFrame:
        """The result as a DataFrame, not run yet. Row order follows ``order by`` only."""
        return self.lower(text, params).df

    def run(self, text: str, params: dict[str, object] | None = None, limit: int | None = None, count_rows: bool = False) -> Result:
        """Rows as JSON data, in the order of the document; ``hit_limit`` says whether ``limit`` cut some off."""
        began = time.time()
        lowered = self.lower(text, params, ordered=True, observe=count_rows)
        rows = list(emit.values(lowered, None if limit is None else limit + 1))
        cut = limit is not None and len(rows) > limit
        return Result(rows[:limit] if cut else rows, cut, time.time() - began, lowered.scanned() if count_rows else None)

    def observe(self, text: str, params: dict[str, object] | None = None) -> tuple[DataFrame, Observation]:
        """The result, and an observation whose ``rows`` counts its rows while it is written or collected."""
        seen = Observation("result")
        return self.query(text, params).observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def explain(self, text: str, params: dict[str, object] | None = None, plan: bool = False) -> str:
        """The canonical query, its steps and its tree; with ``plan`` also Spark's physical plan. Reads no rows."""
        tree, lowered = parse(text), self.lower(text, params)
        out = query_text(tree) + "\n-- " + " > ".join(lowered.steps) + "\n" + "".join(f"-- {x}\n" for x in outline(tree))
        if plan:
            out += lowered.df._jdf.queryExecution().explainString(lowered.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return out

    @staticmethod
    def progress(spark: SparkSession) -> tuple[int, int]:
        """Finished and all tasks of the stages that are running now."""
        tracker = spark.sparkContext.statusTracker()
        infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s)) is not None]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)

    @staticmethod
    def format(text: str) -> str:
        return format_query(text)
