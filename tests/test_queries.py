"""Every registered query of the language against the same SQL in DuckDB, and the plans behind some of them."""

import glob
import json
import os
import subprocess
import sys

import duckdb
import pytest

from fernline import cli, explore, queries
from fernline.engine import Engine
from fernline.sinks import emit
from fernline.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def normal(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", queries.queries())
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    other = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(normal(r[i]) for i in at) for r in other.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    engine = Engine.parquet(spark, SF, ["orders", "lineitem", "pages"])
    p = plan(engine.query('from .orders[] as o where o.o_totalprice > 100000 and o.o_orderstatus == "F" select { k: o.o_orderkey }'))
    assert "GreaterThan(o_totalprice,100000.0)" in p and "EqualTo(o_orderstatus,F)" in p and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p
    p = plan(engine.query('from .pages[] as p where p.url matches "https*" aggregate { n: count() }'))
    assert "StringStartsWith(url,https)" in p and "html" not in p
    p = plan(engine.query("from .orders[] as o select { k: o.o_orderkey, p: o.o_totalprice } order by .p desc limit 3"))
    assert "TakeOrderedAndProject" in p
    p = plan(engine.query("from .lineitem[] as l join .orders[] as o on o.o_orderkey == l.l_orderkey where o.o_totalprice > 100 aggregate { n: count() } by l.l_returnflag"))
    assert "GreaterThan(o_totalprice,100.0)" in p and "Cartesian" not in p and "NestedLoop" not in p


def test_subqueries_become_joins(spark):
    engine = Engine.parquet(spark, SF, ["orders", "customer"])
    p = plan(engine.query("from .customer[] as c where (from .orders[] as o where o.o_custkey == c.c_custkey) exists select { k: c.c_custkey }"))
    assert "LeftSemi" in p and "NestedLoop" not in p
    p = plan(engine.query("from .customer[] as c where c.c_custkey not in (from .orders[].o_custkey as k) select { k: c.c_custkey }"))
    assert "LeftAnti" in p and "NestedLoop" not in p


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("json") / "doc.json"
    path.write_text(json.dumps({"items": [{"id": 1, "name": "Ärger", "tags": ["x"]}, {"id": 2, "name": "bö", "w": 1.5}, {"id": 3, "name": "Zoo"}], "weird key": {"n": None}}))
    return str(path)


def test_command_line(file, capsys, spark):
    assert cli.main([file, "from .items[] as i where i.id >= $k select { id: i.id, n: i.name }", "-p", "k=2", "-s"]) == 0
    out = capsys.readouterr()
    assert out.out == '{"id": 2, "n": "bö"}\n{"id": 3, "n": "Zoo"}\n' and f"rows 2, scanned 3, bytes {os.path.getsize(file)}," in out.err
    assert cli.main([file, "from .items[] as i aggregate { n: count(), s: sum(i.id) }"]) == 0
    assert capsys.readouterr().out == "3\n6\n"
    assert cli.main([file, "from .items[] as i", "-n", "1", "-f", "json"]) == 0
    assert capsys.readouterr().out == '[\n  {"id": 1, "name": "Ärger", "tags": ["x"]}\n]\n'
    assert cli.main([file, "from .items[].id as i", "-f", "csv"]) == 0
    assert capsys.readouterr().out == "path,type,preview\n[0],number,1\n[1],number,2\n[2],number,3\n"
    assert cli.main([file, "from .items[] as i where", "--format-only"]) == 2
    assert cli.main([file, "from .items[] as i where i.x == $p"]) == 2
    assert cli.main(["/nope.json", "from .x[] as x"]) == 1
    assert cli.main(["--nope"]) == 1
    capsys.readouterr()
    assert cli.main([file, "from .items[] as i limit 2", "-e"]) == 0
    assert capsys.readouterr().out == "from .items[] as i\nlimit 2\n-- source i > limit 2\n-- query i limit 2\n--   path: path .items[]\n"
    assert cli.main([file, "from  .items[]  as i   limit 2", "--format-only"]) == 0
    assert capsys.readouterr().out == "from .items[] as i\nlimit 2\n"
    assert cli.main([SF, "from .region[] as r where r.r_regionkey < 2 select { n: r.r_name } order by .n", "-S"]) == 0
    assert capsys.readouterr().out == ""


def test_parameters():
    assert [cli.parse_param(f"a={x}")[1] for x in ("true", "null", "5", "2.5", '"7"', "word")] == [True, None, 5, 2.5, "7", "word"]


def test_typed_json_and_conversion(spark, file, tmp_path):
    typed = Engine(Catalog.json(spark, file, typed=True))
    assert typed.run("from .items[] as i where i.name starts_with \"b\" select { w: i.w }").rows == [{"w": 1.5}]
    copy = Engine(Catalog.json(spark, file).convert(str(tmp_path / "copy")))
    assert copy.run("from .items[] as i where i.w exists select { id: i.id }").rows == [{"id": 2}]
    large = Catalog.json(spark, f"file://{file}")
    assert Engine(large).run("from .items[].tags[] as t").rows == ["x"]


def test_cached_copy_follows_the_file(spark, tmp_path):
    path, cache = tmp_path / "d.json", str(tmp_path / "cache")
    path.write_text('{"a": [1, 2]}')
    assert Engine(Catalog.cached_json(spark, str(path), cache)).run("from .a[] as x").rows == [1, 2]
    assert Engine(Catalog.cached_json(spark, str(path), cache)).run("from .a[] as x").rows == [1, 2] and len(os.listdir(cache)) == 1
    path.write_text('{"a": [1, 2, 3]}')
    assert Engine(Catalog.cached_json(spark, str(path), cache)).run("from .a[] as x").rows == [1, 2, 3]


def test_broken_json(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{ "key": }')
    with pytest.raises(Exception):
        Engine(Catalog.json(spark, str(bad))).run("from .key as k")
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError):
        Catalog.json(spark, str(tmp_path / "empty.json"))


def test_explore(spark, file):
    engine = Engine.json(spark, file)
    assert [(c["path"], c["kind"], c["children"]) for c in explore.children(engine)] == [(".items", "array", 3), ('.["weird key"]', "object", 1)]
    assert [c["path"] for c in explore.children(engine, ".items[1]")] == [".items[1].id", ".items[1].name", ".items[1].w"]
    assert explore.children(engine, ".items", 1, 1)[0]["key"] == 1
    assert explore.children(engine, ".items[0]")[1] == {"path": ".items[0].name", "key": "name", "kind": "string", "children": 0, "value": "Ärger"}
    assert explore.children(engine, ".items[0].id") == [] and explore.children(engine, ".nope") == []
    got = explore.node(engine, ".items[1]")
    assert (got["kind"], got["children"], got["parent"]) == ("object", 3, ".items") and explore.node(engine, '.["weird key"]')["parent"] == "." and explore.node(engine, ".nope") is None
    tables = Engine.parquet(spark, SF, ["region", "nation"])
    assert [(c["path"], c["children"]) for c in explore.children(tables)] == [(".nation", 25), (".region", 5)] and explore.node(tables, ".")["children"] == 2
    assert Engine.progress(spark) == (0, 0)
    assert explore.kind_counts(engine, ".items[].w") == {"number": 1}
    assert explore.sample_keys(engine, "from .items[] as i") == ["id", "name", "tags", "w"]
    assert explore.sample_kinds(engine, "from .items[].tags as t") == ["array"]
    table = explore.project_table(engine.run("from .items[] as i").rows)
    assert table["columns"] == ["id", "name", "tags", "w"] and table["rows"][1] == [2, "bö", None, 1.5]
    assert explore.project_table([1, 2]) is None
    assert explore.search(engine.catalog.document, "zOO").count() == 1 and explore.search(engine.catalog.document, "WEIRD k").count() == 1
    assert explore.search(engine.catalog.document, "nowhere").count() == 0
    got = engine.run("from .items[] as i", limit=2)
    assert len(got.rows) == 2 and got.hit_limit and not engine.run("from .items[] as i", limit=3).hit_limit
    assert engine.run("from .items[] as i", count_rows=True).scanned == 3


def test_sinks(tmp_path, spark, file):
    rows = [1, "a,\"b\"", None, {"k": [1.5, "é"]}, "t\tx\ny"]
    assert "".join(emit.csv(rows)).split("\n")[2] == '[1],string,"""a,\\""b\\"""""'
    assert "".join(emit.tsv(rows)).split("\n")[5] == '[4]\tstring\t"t\\tx\\ny"'
    assert emit.table([1, 2]).split("\n")[1] == "| path | value |" and "│" in emit.table([1], unicode=True)
    assert "".join(emit.json_array([])) == "[]\n" and emit.preview("x" * 200).endswith("...") and len(emit.preview("é" * 99).encode()) <= 80
    lowered = Engine.json(spark, file).lower("from .items[].id as i", ordered=True)
    assert emit.export(lowered, str(tmp_path / "out"), limit=2) == 2 and (tmp_path / "out").read_text() == "1\n2\n"
    emit.write_distributed(Engine.parquet(spark, SF, ["region"]).query("from .region[] as r"), str(tmp_path / "dir"))
    assert spark.read.json(str(tmp_path / "dir")).count() == 5


def test_streaming(spark, tmp_path):
    from fernline.streaming import append_windows, stream_query, write_stream

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    text = 'from .events[] as e where e.event_type == "click" and e.value > 0 select { id: e.event_id, twice: e.value * 2 }'
    write_stream(stream_query(stream, text), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    batch = Engine.parquet(spark, SF, ["events"]).query(text)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    windows = append_windows(stream, "ts", "1 hour", "10 minutes")
    grouped = stream_query(windows, "from .events[] as e aggregate { n: count(), v: sum(e.value) } by e.window_start, e.event_type")
    assert grouped.isStreaming
    with pytest.raises(ValueError):
        stream_query(stream, "from .events[] as e limit 5")


def test_the_rest_works_without_the_optional_operators(tmp_path):
    code = "import sys; sys.modules['fernline.llm'] = None; import __spark_entry__ as e; assert 'top_k' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, timeout=100).returncode == 0


@pytest.mark.parametrize("name, table", [("exists_in_select", "customer"), ("math_functions", "lineitem"), ("arithmetic_null", "lineitem"), ("object_and_array", "nation")])
def test_all_rows_are_computed(spark, name, table):
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["not_exists", "not_in_subquery", "left_join_unmatched", "type_test", "missing_and_null", "null_key_join", "correlated_groups", "json_document", "scalar_first"])
def test_queries_have_rows_that_tell(spark, name):
    assert queries.queries()[name](spark, SF).count() > 1


def test_distinct_by_reads_only_what_is_used(spark):
    engine = Engine.parquet(spark, SF, ["events"], queries.ORDER)
    p = plan(engine.query("from .events[] as e distinct by e.user_id select { u: e.user_id, v: e.value }"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in p and "SortAggregate" not in p and "HashAggregate" in p


def test_join_on_keys_that_are_never_null_is_an_equality(spark):
    from pyspark.sql import functions as F

    ids = spark.range(10).withColumnRenamed("id", "k")
    some = spark.range(10).select(F.when(F.col("id") > 2, F.col("id")).alias("k"), "id")
    engine = Engine(Catalog().add("a", ids).add("b", some).add("c", some))
    p = plan(engine.query("from .a[] as a join .b[] as b on b.k == a.k"))
    assert "isnull" not in p and "Filter (id" in p  # rows of b without a key go before the join
    assert engine.query("from .b[] as b join .c[] as c on c.k == b.k").count() == 7 + 9


def test_errors_of_spark_are_query_errors(spark, file, capsys, monkeypatch):
    from pyspark.errors import AnalysisException

    from fernline.plans.lower import Lowerer

    def broken(self, tree):
        raise AnalysisException("no such thing\nmore")

    monkeypatch.setattr(Lowerer, "query", broken)
    assert cli.main([file, "from .items[] as i"]) == 2
    assert "no such thing" in capsys.readouterr().err


def test_large_documents_and_urls_lose_nothing(spark, tmp_path, monkeypatch):
    doc = {"people": [{"id": 1, "likes": ["x"]}, {"id": 2}, 7, None], "about": {"edition": 2, "none": None, "odd key": {"deep": [1, {"a": 3}]}, "by": {"p": {"l": [1]}, "q": {"l": [2, 3]}}}, "n": 5, "z": None, "e": [], "s": ["a", "b"]}
    path, root = tmp_path / "d.json", tmp_path / "r.json"
    path.write_text(json.dumps(doc))
    root.write_text("\n " + json.dumps([1, 2, {"a": [3]}, [4]]))
    texts = [".people[]", ".people[].likes[]", ".about.edition", ".about", ".n", ".z", ".nope", ".about.none", '.about["odd key"].deep[]', ".about.by[].l[]", ".people[1].id", ".people[-1]", ".people[-4].id", ".people[9]", ".**.l[]", ".", ".s", ".e[]", ".about.by.p.l[0]", ".nope[]"]
    small = {t: Engine.json(spark, str(path)).run(f"from {t} as x").rows for t in texts}
    assert small[".about.edition"] == [2] and small["."] == [doc] and small[".people[-1]"] == [None]
    roots = [".[]", ".[0]", ".[-1]", ".[2].a[]", ".[].a[]"]
    whole = {t: Engine.json(spark, str(root)).run(f"from {t} as x").rows for t in roots}
    url = Engine.json(spark, f"file://{path}")
    assert {t: url.run(f"from {t} as x").rows for t in texts} == small
    copy = Engine(Catalog.json(spark, str(path)).convert(str(tmp_path / "c1")))
    assert {t: copy.run(f"from {t} as x").rows for t in texts} == small
    cached = Engine(Catalog.cached_json(spark, str(path), str(tmp_path / "cache")))
    assert cached.run("from .about.edition as x").rows == [2]
    monkeypatch.setattr("fernline.sources.catalog.WHOLE_BYTES", 1)
    for engine in (Engine.json(spark, str(path)), Engine(Catalog.json(spark, f"file://{path}").convert(str(tmp_path / "c2")))):
        assert {t: engine.run(f"from {t} as x").rows for t in texts} == small
    for engine in (Engine.json(spark, f"file://{root}"), Engine(Catalog.json(spark, str(root)).convert(str(tmp_path / "c3")))):
        assert {t: engine.run(f"from {t} as x").rows for t in roots} == whole
    assert Engine.json(spark, str(path), typed=True).run("from .about.edition as x").rows == [2]


def test_indexed_tables_join_without_moving_rows(spark):
    from fernline.errors import QueryError
    from fernline.sources.index import Indexes

    text = "from .orders[] as o join .customer[] as c on c.c_custkey == o.o_custkey aggregate { n: count() } by c.c_custkey"
    engine = Engine.parquet(spark, SF, ["orders", "customer"], queries.ORDER)
    expected = sorted(engine.query(text).collect())
    indexes = Indexes(engine.catalog)
    indexes.build("orders", "o_orderkey", 4)
    indexes.build("orders", "o_custkey", 4)  # takes the place of the other
    indexes.build("customer", "c_custkey", 4)
    assert [(i.source, i.key, i.buckets) for i in indexes.list()] == [(".customer[]", "c_custkey", 4), (".orders[]", "o_custkey", 4)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        p = plan(engine.query(text))
        assert p.count("Exchange") == 0 and "SortMergeJoin" in p
        assert sorted(engine.query(text).collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert indexes.get(".orders[]", "o_custkey") is not None and indexes.get(".orders[]", "o_orderkey") is None
    assert indexes.remove(".orders[]", "o_custkey") and not indexes.remove(".orders[]", "o_custkey")
    indexes.remove(".customer[]", "c_custkey")
    assert sorted(engine.query(text).collect()) == expected
    with pytest.raises(QueryError):
        indexes.build("orders", "nope")
