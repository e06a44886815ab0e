"""Queries over the supplied tables, one for each operator of the language, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

#: Columns that give the rows of a table their order.
ORDER = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "embeddings": "vec_id"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (query, SQL, parameters)
QUERIES: dict[str, tuple[str, str, dict]] = {
    "filter_project": (
        "from .orders[] as o where o.o_totalprice > 100000 select { k: o.o_orderkey, p: o.o_totalprice }",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000", {}),
    "top_k": (
        "from .orders[] as o where o.o_totalprice > 100000 select { k: o.o_orderkey, p: o.o_totalprice } order by .p desc, .k limit 10",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 ORDER BY p DESC, k LIMIT 10", {}),
    "order_multi": (
        "from .orders[] as o select { s: o.o_orderstatus, k: o.o_orderkey } order by .s desc, .k limit 50",
        "SELECT o_orderstatus AS s, o_orderkey AS k FROM orders ORDER BY s DESC, k LIMIT 50", {}),
    "order_by_alias": (
        "from .customer[] as c select { n: c.c_name } order by c.c_acctbal desc, c.c_custkey limit 20",
        "SELECT c_name AS n FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", {}),
    "limit_in_order": (
        "from .events[] as e where e.event_type == \"click\" select { id: e.event_id } limit 25",
        "SELECT event_id AS id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 25", {}),
    "whole_row": (
        "from .region[] as r",
        "SELECT r_regionkey, r_name FROM region", {}),
    "filter_count": (
        "from .lineitem[] as l where l.l_returnflag == \"R\" aggregate { n: count() }",
        "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'", {}),
    "group_sum": (
        "from .lineitem[] as l aggregate { qty: sum(l.l_quantity) } by l.l_returnflag",
        "SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag", {}),
    "group_multi_metric": (
        "from .lineitem[] as l aggregate { n: count(), qty: sum(l.l_quantity), low: min(l.l_extendedprice), high: max(l.l_extendedprice), mean: round(avg(l.l_quantity), 6) } by l.l_linestatus",
        "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_linestatus", {}),
    "group_two_keys": (
        "from .lineitem[] as l aggregate { n: count(), qty: sum(l.l_quantity) } by l.l_returnflag, l.l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL", {}),
    "agg_item_where_default": (
        "from .lineitem[] as l aggregate { big: count() where l.l_quantity > 45, none: sum(l.l_quantity) where l.l_quantity > 1000 ?? 0, qty: sum(l.l_quantity) where l.l_discount >= 0.05 } by l.l_returnflag",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 45) AS big, coalesce(sum(l_quantity) FILTER (WHERE l_quantity > 1000), 0.0) AS none, sum(l_quantity) FILTER (WHERE l_discount >= 0.05) AS qty FROM lineitem GROUP BY l_returnflag", {}),
    "agg_let_arith": (
        "from .lineitem[] as l let qty = sum(l.l_quantity), n = count(), mean = qty / n aggregate { mean: round(mean, 6), twice: mean * 0 + qty * 2, share: round((qty - n) / qty, 9) ?? 0 } by l.l_linestatus",
        "SELECT l_linestatus, round(sum(l_quantity) / count(*), 6) AS mean, sum(l_quantity) * 2 AS twice, round((sum(l_quantity) - count(*)) / sum(l_quantity), 9) AS share FROM lineitem GROUP BY l_linestatus", {}),
    "agg_nested_object": (
        "from .lineitem[] as l aggregate { s: { n: count(), q: { hi: max(l.l_quantity), none: sum(l.l_tax) } } } by l.l_returnflag select { f: .l_returnflag, n: .s.n, hi: .s.q.hi, tax: round(.s.q.none, 6) }",
        "SELECT l_returnflag AS f, count(*) AS n, max(l_quantity) AS hi, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag", {}),
    "agg_if_over_reducers": (
        "from .orders[] as o aggregate { level: if(count() > 4900, \"high\", \"low\"), some: count() > 0 and max(o.o_totalprice) > 1 } by o.o_orderstatus",
        "SELECT o_orderstatus, CASE WHEN count(*) > 4900 THEN 'high' ELSE 'low' END AS level, count(*) > 0 AND max(o_totalprice) > 1 AS some FROM orders GROUP BY o_orderstatus", {}),
    "having": (
        "from .orders[] as o aggregate { n: count(), total: round(sum(o.o_totalprice), 2) } by o.o_custkey having .n >= 12 and .total exists",
        "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12", {}),
    "rollup_two_keys": (
        "from .lineitem[] as l aggregate { n: count(), qty: sum(l.l_quantity) } by rollup(l.l_returnflag, l.l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", {}),
    "inner_join_group": (
        "from .orders[] as o join .customer[] as c on c.c_custkey == o.o_custkey aggregate { n: count(), total: round(sum(o.o_totalprice), 2) } by c.c_mktsegment",
        "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment", {}),
    "chained_join_group": (
        "from .customer[] as c join .nation[] as n on n.n_nationkey == c.c_nationkey join .region[] as r on r.r_regionkey == n.n_regionkey aggregate { n: count() } by r.r_name",
        "SELECT r_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name", {}),
    "left_join": (
        "from .customer[] as c left join .orders[] as o on o.o_custkey == c.c_custkey aggregate { rows: count(), orders: count(o.o_orderkey) } by c.c_mktsegment",
        "SELECT c_mktsegment, count(*) AS rows, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment", {}),
    "composite_join": (
        "from .lineitem[] as l join .lineitem[] as m on m.l_orderkey == l.l_orderkey and m.l_partkey == l.l_partkey where l.l_returnflag == \"A\" aggregate { n: count() } by m.l_linestatus",
        "SELECT m.l_linestatus, count(*) AS n FROM lineitem l JOIN lineitem m ON m.l_orderkey = l.l_orderkey AND m.l_partkey = l.l_partkey WHERE l.l_returnflag = 'A' GROUP BY m.l_linestatus", {}),
    "unnest_sum": (
        "from .embeddings[] as e unnest e.embedding as x aggregate { n: count(), total: round(sum(x), 3) } by e.label",
        "SELECT label, count(*) AS n, round(sum(x::double), 3) AS total FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label", {}),
    "join_unnest_filter": (
        "from .embeddings[] as e join .labels[] as l on l.doc_id == e.vec_id unnest e.embedding as x where x > 0 and l.quality == 1 aggregate { n: count() } by e.label order by .n desc",
        "SELECT label, count(*) AS n FROM (SELECT e.label, unnest(embedding) AS x FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality = 1) WHERE x > 0 GROUP BY label", {}),
    "stream_in_reducer": (
        "from .embeddings[] as e aggregate { n: count(e.embedding[]), low: round(min(e.embedding[]), 5), high: round(max(e.embedding[]), 5) } by e.label",
        "SELECT label, count(*) AS n, round(min(x::double), 5) AS low, round(max(x::double), 5) AS high FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label", {}),
    "stream_compare": (
        "from .embeddings[] as e where e.embedding[] > 0.3 select { id: e.vec_id, first: round(e.embedding[0], 5), last: round(e.embedding[-1], 5), n: length(e.embedding) }",
        "SELECT vec_id AS id, round(embedding[1]::double, 5) AS first, round(embedding[-1]::double, 5) AS last, len(embedding) AS n FROM embeddings WHERE list_max(embedding) > 0.3", {}),
    "from_nested": (
        "from .embeddings[].embedding[] as x aggregate { n: count(), pos: count() where x > 0 }",
        "SELECT count(*) AS n, count(*) FILTER (WHERE x > 0) AS pos FROM (SELECT unnest(embedding) AS x FROM embeddings)", {}),
    "distinct_rows": (
        "from .nation[] as n join .supplier[] as s on s.s_nationkey == n.n_nationkey distinct select { k: n.n_nationkey, name: n.n_name }",
        "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)", {}),
    "distinct_by_first": (
        "from .events[] as e distinct by e.event_type, e.user_id select { t: e.event_type, u: e.user_id, id: e.event_id }",
        "SELECT event_type AS t, user_id AS u, min(event_id) AS id FROM events GROUP BY event_type, user_id", {}),
    "distinct_then_aggregate": (
        "from .events[] as e distinct by e.user_id aggregate { users: count() } by e.event_type",
        "SELECT event_type, count(*) AS users FROM (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id) GROUP BY event_type", {}),
    "collect_by": (
        "from .nation[] as n collect by n.n_regionkey having length(.) > 0 select { n: length(.), first: .[0].n_name, last: .[-1].n_name }",
        "SELECT count(*) AS n, arg_min(n_name, n_nationkey) AS first, arg_max(n_name, n_nationkey) AS last FROM nation GROUP BY n_regionkey", {}),
    "exists": (
        "from .customer[] as c where (from .orders[] as o where o.o_custkey == c.c_custkey and o.o_totalprice > 400000) exists select { k: c.c_custkey }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", {}),
    "in_subquery": (
        "from .orders[] as o where o.o_custkey in (from .customer[].c_custkey as k where (from .customer[] as c where c.c_custkey == k and c.c_mktsegment == \"BUILDING\") exists) aggregate { n: count() }",
        "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", {}),
    "scalar_subquery": (
        "from .nation[] as n select { name: n.n_name, customers: (from .customer[] as c where c.c_nationkey == n.n_nationkey aggregate { n: count() }) }",
        "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation", {}),
    "exists_in_select": (
        "from .customer[] as c select { k: c.c_custkey, big: (from .orders[] as o where o.o_custkey == c.c_custkey and o.o_totalprice > 400000) exists }",
        "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer", {}),
    "exists_or": (
        "from .customer[] as c where c.c_acctbal > 9000 or (from .orders[] as o where o.o_custkey == c.c_custkey and o.o_totalprice > 450000) exists select { k: c.c_custkey }",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", {}),
    "reducer_over_subquery": (
        "from .nation[] as n aggregate { customers: sum((from .customer[] as c where c.c_nationkey == n.n_nationkey aggregate { n: count() })) } by n.n_regionkey",
        "SELECT n_regionkey, sum(n)::bigint AS customers FROM (SELECT n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation) GROUP BY n_regionkey", {}),
    "distinct_values": (
        "from .events[].event_type as t distinct",
        "SELECT DISTINCT event_type AS value FROM events", {}),
    "rollup_three_keys": (
        "from .customer[] as c join .nation[] as n on n.n_nationkey == c.c_nationkey join .region[] as r on r.r_regionkey == n.n_regionkey aggregate { n: count(), high: max(c.c_acctbal) } by rollup(r.r_name, n.n_name, c.c_mktsegment)",
        "SELECT r_name, n_name, c_mktsegment, count(*) AS n, max(c_acctbal) AS high FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)", {}),
    "join_on_expression": (
        "from .orders[] as o join .nation[] as n on mod(o.o_orderkey, 25) == n.n_nationkey aggregate { n: count() } by n.n_name",
        "SELECT n_name, count(*) AS n FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey GROUP BY n_name", {}),
    "left_join_composite": (
        "from .supplier[] as s left join .customer[] as c on c.c_nationkey == s.s_nationkey and c.c_custkey == s.s_suppkey aggregate { rows: count(), met: count(c.c_name), bal: round(sum(c.c_acctbal), 2) ?? 0 } by s.s_nationkey",
        "SELECT s_nationkey, count(*) AS rows, count(c_name) AS met, coalesce(round(sum(c_acctbal), 2), 0.0) AS bal FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_custkey = s_suppkey GROUP BY s_nationkey", {}),
    "string_ops": (
        "from .part[] as p where p.p_type contains \"BRASS\" or p.p_name starts_with \"a\" or p.p_brand ends_with \"3\" select { k: p.p_partkey }",
        "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'BRASS') OR starts_with(p_name, 'a') OR ends_with(p_brand, '3')", {}),
    "glob_match": (
        "from .pages[] as p where p.url matches \"http*://*.example.com/??/*\" select { id: p.page_id, u: p.url }",
        "SELECT page_id AS id, url AS u FROM pages WHERE url LIKE 'http%://%.example.com/__/%'", {}),
    "string_functions": (
        "from .part[] as p select { k: p.p_partkey, a: lower(p.p_brand), b: upper(p.p_type), c: substr(p.p_name, 2, 5), d: replace(p.p_brand, \"#\", \"-\"), e: length(p.p_name), f: trim(substr(p.p_type, 3, 8)) }",
        "SELECT p_partkey AS k, lower(p_brand) AS a, upper(p_type) AS b, substr(p_name, 3, 5) AS c, replace(p_brand, '#', '-') AS d, length(p_name) AS e, trim(substr(p_type, 4, 8)) AS f FROM part", {}),
    "math_functions": (
        "from .lineitem[] as l select { a: abs(l.l_discount - 0.05), b: floor(l.l_extendedprice), c: ceil(l.l_extendedprice), d: round(sqrt(l.l_quantity), 8), e: pow(l.l_quantity, 2), f: mod(l.l_quantity, 7), g: round(l.l_extendedprice, -2), h: -l.l_quantity }",
        "SELECT abs(l_discount - 0.05) AS a, floor(l_extendedprice) AS b, ceil(l_extendedprice) AS c, round(sqrt(l_quantity), 8) AS d, pow(l_quantity, 2) AS e, fmod(l_quantity, 7) AS f, round(l_extendedprice / 100) * 100 AS g, -l_quantity AS h FROM lineitem", {}),
    "arithmetic_null": (
        "from .lineitem[] as l select { q: round((l.l_extendedprice * (1 - l.l_discount)) / (l.l_linenumber - 1), 4), s: l.l_returnflag + 1 }",
        "SELECT round((l_extendedprice * (1 - l_discount)) / nullif(l_linenumber - 1, 0), 4) AS q, cast(NULL AS double) AS s FROM lineitem", {}),
    "if_truthy": (
        "from .part[] as p select { k: p.p_partkey, v: if(p.p_size > 25, \"large\", \"small\"), t: if(0, 1, 2), m: if(p.p_name is string and not (p.p_size < 10), p.p_size, -1) }",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS v, cast(1 AS bigint) AS t, CASE WHEN p_size >= 10 THEN p_size::double ELSE -1.0 END AS m FROM part", {}),
    "left_join_unmatched": (
        "from .customer[] as c left join .supplier[] as s on s.s_suppkey == c.c_custkey where s == null and c.c_acctbal > 0 select { k: c.c_custkey }",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)", {}),
    "not_exists": (
        "from .customer[] as c where not (from .orders[] as o where o.o_custkey == c.c_custkey and o.o_totalprice > 350000) exists select { k: c.c_custkey }",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)", {}),
    "not_in_subquery": (
        "from .customer[] as c where c.c_custkey not in (from .supplier[].s_suppkey as k) select { k: c.c_custkey }",
        "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)", {}),
    "scalar_first": (
        "from .customer[] as c where (from .orders[] as p where p.o_custkey == c.c_custkey and p.o_totalprice > 200000) exists select { k: c.c_custkey, first: (from .orders[] as o where o.o_custkey == c.c_custkey and o.o_totalprice > 200000 select { price: o.o_totalprice, id: o.o_orderkey }) }",
        "SELECT c_custkey AS k, (SELECT arg_min({'price': o_totalprice, 'id': o_orderkey}, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS first FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", {}),
    "correlated_groups": (
        "from .customer[] as c where (from .orders[] as o where o.o_custkey == c.c_custkey aggregate { n: count() } by o.o_orderstatus having .n > 5) exists select { k: c.c_custkey }",
        "SELECT DISTINCT o_custkey AS k FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) WHERE n > 5", {}),
    "in_list": (
        "from .events[] as e where e.event_type in [\"click\", \"view\"] and e.user_id not in [1, 2, 3] aggregate { n: count() } by e.event_type",
        "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3) GROUP BY event_type", {}),
    "field_set": (
        "fields M = { s_suppkey, s_nationkey } from .supplier[] as s where s.{...M} != null and s.{s_nationkey} >= 3 and s.{s_suppkey: 5, s_nationkey} > 2 select { k: s.s_suppkey }",
        "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL AND s_nationkey >= 3 AND s_suppkey > 5 AND s_nationkey > 2", {}),
    "params": (
        "from .orders[] as o where o.o_orderstatus == $status and o.o_totalprice >= $least aggregate { n: count() }",
        "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 250000", {"status": "F", "least": 250000}),
    "object_and_array": (
        "from .nation[] as n select { o: { a: n.n_name, b: [n.n_nationkey, n.n_regionkey] } }",
        "SELECT {'a': n_name, 'b': [n_nationkey, n_regionkey]} AS o FROM nation", {}),
}


_WORLD = "SELECT r_name, count(*) AS n, max(n_nationkey)::double AS last FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey >= 2 GROUP BY r_name"


def _mixed(spark: SparkSession, sf_dir: str) -> Engine:
    """Events with a VARIANT ``d``: of each six in a row one has a number, a text, a bool, a null, an object with a list, or nothing as ``v``."""
    from pyspark.sql import functions as F

    from .sources.catalog import Catalog

    k, number = F.col("event_id") % 6, F.col("event_id").cast("string")
    forms = [F.concat(F.lit('{"v":'), number, F.lit("}")), F.concat(F.lit('{"v":"'), F.col("event_type"), F.lit('"}')), F.lit('{"v":true}'), F.lit('{"v":null}'), F.concat(F.lit('{"v":{"in":[{"k":'), number, F.lit('},{"k":1}]}}')), F.lit("{}")]
    text = F.when(k == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        text = text.when(k == i, f)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.parse_json(text).alias("d"))
    return Engine(Catalog().add("events", events, "event_id"))


def type_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values are of each kind, and not of a kind (what isn't there is neither)."""
    return _mixed(spark, sf_dir).query(
        "from .events[] as e aggregate { num: count() where e.d.v is number, str: count() where e.d.v is string, bool: count() where e.d.v is bool, nul: count() where e.d.v is null, obj: count() where e.d.v is object, arr: count() where e.d.v.in is array, not_str: count() where e.d.v is not string } by e.event_type"
    )


def missing_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, null and present values under exists, comparison and negation."""
    return _mixed(spark, sf_dir).query(
        "from .events[] as e aggregate { there: count() where e.d.v exists, missing: count() where not e.d.v exists, eq: count() where e.d.v == null, ne: count() where e.d.v != null, not_one: count() where not (e.d.v == 1), not_and: count() where not (e.d.v == 1 and true), some: count(e.d.v) } by e.event_type"
    )


def null_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on keys that are null on both sides: null meets null, and a missing key meets nothing."""
    from pyspark.sql import functions as F

    from .sources.catalog import Catalog

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("key", F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")))
    region = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("key", F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")))
    engine = Engine(Catalog().add("nation", nation, "n_nationkey").add("region", region, "r_regionkey"))
    return engine.query("from .nation[] as n join .region[] as r on r.key == n.key select { n: n.n_name, r: r.r_name }")


def collect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows collected by key, in order, as JSON text."""
    from pyspark.sql import functions as F

    rows = Engine.parquet(spark, sf_dir, ["nation"], ORDER).query("from .nation[] as n collect by n.n_regionkey select { rows: . }")
    return rows.select(F.to_json("rows").alias("rows"))


def json_document(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Nations and regions written as one JSON file, and read back: arrays, a nested member and a scalar of one document."""
    from pyspark.sql import functions as F

    from .sources import catalog

    def listed(name: str) -> str:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return rows.agg(F.to_json(F.collect_list(F.struct("*")))).first()[0]  # 5 regions or 25 nations

    text = f'{{"world": {{"regions": {listed("region")}}}, "nations": {listed("nation")}, "meta": {{"least": 2}}}}'
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/world-{uuid.uuid4().hex}.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()
    if whole:
        engine = Engine.json(spark, path)
    else:
        most, catalog.WHOLE_BYTES = catalog.WHOLE_BYTES, 0
        try:
            engine = Engine.json(spark, path)
        finally:
            catalog.WHOLE_BYTES = most
    found = engine.query(
        "from .nations[] as n join .world.regions[] as r on r.r_regionkey == n.n_regionkey where n.n_regionkey >= (from .meta.least as k) aggregate { n: count(), last: max(n.n_nationkey) } by r.r_name"
    )
    return found.withColumn("r_name", F.col("r_name").cast("string"))


def json_document_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a document that is too large to be read whole."""
    return json_document(spark, sf_dir, whole=False)


def variant_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text in events.props as a VARIANT: sum of a field."""
    from pyspark.sql import functions as F

    from .sources.catalog import Catalog

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.parse_json("props").alias("props"))
    return Engine(Catalog().add("events", events, "event_id")).query("from .events[] as e where e.props.k is number aggregate { n: count(), total: sum(e.props.k) } by e.event_type")


def descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at any depth, by recursive descent through objects and lists."""
    return _mixed(spark, sf_dir).query("from .events[].d.** as x where x is number aggregate { n: count(), total: sum(x) }")


def descent_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field at any depth."""
    return _mixed(spark, sf_dir).query("from .events[].d.**.k as x aggregate { n: count(), total: sum(x) }")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the benchmark with a word in any value or key, case-insensitive for ASCII."""
    from .explore import search

    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "THE ").select("item_id")


def text_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the documents."""
    from .explore import search

    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), "THE ").select("doc_id")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _, params = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.parquet(spark, sf_dir, list(TABLES), ORDER).query(text, params)

    run.__name__, run.__doc__ = name, text
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = (variant_path, descent, descent_field, text_search, text_search_documents, type_test, missing_and_null, null_key_join, collect_rows, json_document, json_document_by_member)
    return {n: _run(n) for n in QUERIES} | {f.__name__: f for f in more}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql, _) in QUERIES.items()} | {
        "variant_path": "SELECT event_type, count(*) AS n, sum((props->>'$.k')::double) AS total FROM events GROUP BY event_type",
        "descent": "SELECT sum(CASE event_id % 6 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END)::bigint AS n, sum(CASE event_id % 6 WHEN 0 THEN event_id WHEN 4 THEN event_id + 1 ELSE 0 END)::double AS total FROM events",
        "descent_field": "SELECT count(*) * 2 AS n, sum(event_id + 1)::double AS total FROM events WHERE event_id % 6 = 4",
        "type_test": "SELECT event_type, count(*) FILTER (k = 0) AS num, count(*) FILTER (k = 1) AS str, count(*) FILTER (k = 2) AS bool, count(*) FILTER (k = 3) AS nul, count(*) FILTER (k = 4) AS obj, count(*) FILTER (k = 4) AS arr, count(*) FILTER (k IN (0, 2, 3, 4)) AS not_str FROM (SELECT *, event_id % 6 AS k FROM events) GROUP BY event_type",
        "missing_and_null": "SELECT event_type, count(*) FILTER (k <> 5) AS there, count(*) FILTER (k = 5) AS missing, count(*) FILTER (k = 3) AS eq, count(*) FILTER (k NOT IN (3, 5)) AS ne, count(*) FILTER (k <> 5 AND (k <> 0 OR event_id <> 1)) AS not_one, count(*) FILTER (k <> 0 OR event_id <> 1) AS not_and, count(*) FILTER (k NOT IN (3, 5)) AS some FROM (SELECT *, event_id % 6 AS k FROM events) GROUP BY event_type",
        "null_key_join": "SELECT n_name AS n, r_name AS r FROM (SELECT *, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS k FROM nation) n JOIN (SELECT *, CASE WHEN r_regionkey > 1 THEN r_regionkey END AS k FROM region) r ON n.k IS NOT DISTINCT FROM r.k",
        "collect_rows": "SELECT cast(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey} ORDER BY n_nationkey)) AS varchar) AS rows FROM nation GROUP BY n_regionkey",
        "json_document": _WORLD,
        "json_document_by_member": _WORLD,
        "text_search": "SELECT item_id FROM benchmark WHERE contains(lower(text), 'the ')",
        "text_search_documents": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ')",
    }
