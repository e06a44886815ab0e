"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fernline.engine import Engine
from fernline.queries import ORDER, TABLES

#: The nine shapes of the baseline, over the supplied tables.
HEADLINE = {
    "q1": "from .lineitem[] as l where l.l_extendedprice > 50000 select { id: l.l_orderkey, amount: l.l_extendedprice }",
    "q2": 'from .lineitem[] as l where l.l_returnflag == "R" aggregate { n: count() }',
    "q3": "from .lineitem[] as l aggregate { revenue: sum(l.l_extendedprice) } by l.l_returnflag",
    "q4": "from .lineitem[] as l aggregate { revenue: sum(l.l_extendedprice), n: count(), avg: avg(l.l_extendedprice) } by l.l_returnflag order by .revenue desc",
    "q5": "from .lineitem[] as l join .part[] as p on p.p_partkey == l.l_partkey aggregate { revenue: sum(l.l_extendedprice) } by p.p_brand order by .p_brand",
    "q6": "from .orders[] as o join .customer[] as c on c.c_custkey == o.o_custkey join .nation[] as n on n.n_nationkey == c.c_nationkey aggregate { revenue: sum(o.o_totalprice) } by n.n_name order by .n_name",
    "q7": "from .baskets[] as b unnest b.items as i aggregate { quantity: sum(i.l_quantity) } by i.l_returnflag order by .l_returnflag",
    "q8": 'from .baskets[] as b join .orders[] as o on o.o_orderkey == b.l_orderkey unnest b.items as i where o.o_orderstatus == "F" aggregate { lines: count(), quantity: sum(i.l_quantity) } by i.l_linestatus order by .quantity desc',
    "q9": 'from .lineitem[] as l where l.l_returnflag == "A" aggregate { revenue: sum(l.l_extendedprice), n: count() } by l.l_linestatus having .revenue > 400000 order by .revenue desc',
}
#: The same kind of query over one JSON document of EVENTS events, from reading the file on.
JSON = "from .events[] as e where e.value > 10 aggregate { n: count(), total: sum(e.value) } by e.event_type"
EVENTS, RUNS = 100_000, 3


def nested(spark: SparkSession, folder: str, to: str) -> None:
    """The line items of each order as one row with a list."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    items.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("items")).write.parquet(to)


def document(spark: SparkSession, folder: str, to: str) -> None:
    rows = spark.read.parquet(f"{folder}/events.parquet").orderBy("event_id").limit(EVENTS).toJSON().toLocalIterator()
    with open(to, "w", encoding="utf-8") as f:
        f.write('{"events": [')
        for i, r in enumerate(rows):
            f.write("," * (i > 0) + r)
        f.write("]}")


def timed(run) -> float:
    run()  # warm-up
    each = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        each.append(time.perf_counter() - began)
    return round(sorted(each)[RUNS // 2], 4)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine, times = Engine.parquet(spark, folder, list(TABLES), ORDER), {}
    with tempfile.TemporaryDirectory() as own:
        nested(spark, folder, f"{own}/baskets.parquet")
        document(spark, folder, f"{own}/events.json")
        engine.catalog.add("baskets", spark.read.parquet(f"{own}/baskets.parquet"))
        for name, text in HEADLINE.items():
            times[name] = timed(lambda text=text: engine.query(text).write.format("noop").mode("overwrite").save())
        from_json = timed(lambda: Engine.json(spark, f"{own}/events.json").query(JSON).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "json_document": from_json, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
