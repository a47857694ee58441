"""Queries that go through the engine's own operators, with the SQL that answers alike."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.connection import Connection
from tidewright.functions.registry import register_functions
from tidewright.operators import analysis, asof, compare, params, subset
from tidewright.plans import dialect, router
from tidewright.plans.text import tables_in
from tidewright.sources import text
from tidewright.sources.parquet import read_table, register_folder, schema_differences, schema_of
from tidewright.streaming import events as streams

TABLES = "region nation customer supplier part orders lineitem".split()
EDGES = subset.join_edges(
    ["SELECT 1 FROM customer c, orders, lineitem, supplier s, nation, region WHERE c.c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s.s_suppkey AND c.c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
     "SELECT 1 FROM part, lineitem WHERE p_partkey = l_partkey"],
    {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_suppkey", "l_partkey"], "supplier": ["s_suppkey", "s_nationkey"],
     "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "part": ["p_partkey"]})


def _frames(spark: SparkSession, sf_dir: str, tables=TABLES) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf_dir, t) for t in tables}


def _kept(spark: SparkSession, sf_dir: str, fraction: float) -> dict[str, DataFrame]:
    frames = _frames(spark, sf_dir)
    info = {t: {"rows": df.count()} for t, df in frames.items()}
    return subset.subset(frames, subset.plan_subset(info, EDGES, fraction, small=200), keys={"lineitem": ["l_orderkey"]})


def subset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a 10 % subset keeps of each table: rows, sum of keys, and rows of the anchor's side whose partner is gone (none)."""
    kept = _kept(spark, sf_dir, 0.1)
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    child = {e.right if e.left == t else e.left: e for t in ("lineitem",) for e in EDGES if t in (e.left, e.right)}
    out = []
    for t, k in keys.items():
        gone = subset.dangling(kept, subset.Edge("lineitem", t, tuple((a, b) for b, a in child[t].turned(t)[1]))) if t in child else 0
        out.append(kept[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("keys"), F.lit(gone).cast("long").alias("dangling")))
    return functools.reduce(DataFrame.unionAll, out)


def subset_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subset of everything is everything."""
    kept = _kept(spark, sf_dir, 1.0)
    counts = [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t, df in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


def scale_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers three times over still join in full."""
    f = subset.scale_up(_frames(spark, sf_dir, ["customer", "orders"]), 3, {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"]})
    return f["orders"].join(f["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_orders"))


def routed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameterised query served by a template and cross-checked."""
    con = Connection(spark, sf_dir, router.Policy(cross_check_rate=1.0))
    sql = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > [LOW] AND o_orderstatus = '[STATUS]' GROUP BY o_orderpriority"

    def build(s: SparkSession, v) -> DataFrame:
        return s.table("orders").where((F.col("o_totalprice") > v["LOW"]) & (F.col("o_orderstatus") == v["STATUS"])).groupBy("o_orderpriority").agg(F.count("*").alias("n"))

    con.router.registry.register(router.make_template(spark, "priorities", sql, build))
    con.execute("select o_orderpriority, count(*) as n from orders where o_totalprice > 100000 and o_orderstatus = 'F' group by o_orderpriority")
    if con.router.counters["routed"] != 1 or con.router.counters["mismatch"]:
        raise RuntimeError(con.router.traces[-1].reason)
    return spark.createDataFrame(con.result.table)


def dialect_query(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = set(tables_in(sql))
        register_folder(spark, sf_dir, [t for t in [*TABLES, "events"] if t in named])
        return spark.sql(dialect.to_spark(sql))

    return run


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase-like event with the user's last event of another kind."""
    e = read_table(spark, sf_dir, "events")
    kinds = "event_type = (SELECT min(event_type) FROM ev)"
    e.createOrReplaceTempView("ev")
    left = spark.sql(f"SELECT event_id, user_id, ts FROM ev WHERE {kinds}")
    right = spark.sql(f"SELECT user_id, ts, event_id AS before_id FROM ev WHERE NOT {kinds}")
    return asof.asof_join(left, right, "ts", ["user_id"], ["before_id"]).select("event_id", "before_id")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 5 - 2).alias("lo"), (F.col("id") * 5 + 4).alias("hi"))
    return asof.range_join(parts, bands, "p_size", "lo", "hi", 5.0).groupBy("band").agg(F.count("*").alias("n"))


def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two forms of one query disagree in, after one row is made to differ."""
    n = read_table(spark, sf_dir, "nation")
    other = n.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "CHANGED").otherwise(F.col("n_name")))
    return compare.frames_differ(n, other).select("n_nationkey", "n_name", "in_a", "in_b")


def closed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.closed_top(read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), [F.col("n").desc()], 5)


def log_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated shapes in a log of instances of the templates."""
    texts = [sql for t in params.tpch_templates().values() for _, sql in t.instances(5)]
    log = spark.createDataFrame([(x,) for x in texts], "sql string")
    return analysis.repeated(log).select("runs", "distinct_queries", "score")


def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a folder's tables differ from a declared schema that has another type, a column more and a column less."""
    declared = text.parse_ddl("CREATE TABLE region (r_regionkey bigint, r_name varchar(25)); CREATE TABLE nation (n_nationkey int, n_name text, n_comment text)")
    found = schema_differences(schema_of(spark, sf_dir, ["region", "nation"]), {t: dict(cols) for t, cols in declared.items()})
    return spark.createDataFrame(found, "table_name string, column_name string, here string, declared string")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.summarize(read_table(spark, sf_dir, "customer")).select("column_name", "count", "nulls")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows, as a stream would give them."""
    return streams.windowed(read_table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("user_sum").cast("long").alias("user_sum"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.sessions(read_table(spark, sf_dir, "events"), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User functions: a vectorised scalar, a vectorised aggregate and a table function."""
    register_functions(spark)
    register_folder(spark, sf_dir, ["nation"])
    return spark.sql("SELECT w.word, tw_geomean(t.n_nationkey + 1) AS g FROM (SELECT n_nationkey, n_regionkey, tw_initials(n_name) AS i FROM nation) t, LATERAL tw_words(t.i) w GROUP BY w.word").select("word", F.round("g", 6).alias("g"))


#: Quotients of columns, some by zero; DuckDB gives infinities for them.
DIVISION = (
    "SELECT c_custkey, c_acctbal / (c_nationkey - 3) AS q, c_nationkey * 2 / nullif(c_nationkey % 4, 1) / 3 AS r, "
    "CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END / (c_nationkey - 3) AS s FROM customer"
)

QUERIES = {
    "subset_closure": subset_closure, "subset_full": subset_full, "scale_up": scale_up, "routed_query": routed_query, "asof_join": asof_orders, "range_join": range_join,
    "result_diff": result_diff, "closed_top": closed_top, "log_shapes": log_shapes, "schema_check": schema_check, "summarize": summary, "stream_windows": stream_windows, "session_windows": session_windows, "python_functions": python_functions,
    "dialect_qualify": dialect_query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2"),
    "dialect_regex": dialect_query("SELECT c_custkey FROM customer WHERE c_name ~ '.*[13579]'"),
    "dialect_replace": dialect_query("SELECT s_suppkey, regexp_replace(s_name, '([0-9])', '<\\1>') AS one, regexp_replace(s_name, '[0-9]', '#', 'g') AS every, strlen(s_name) AS bytes FROM supplier"),
    "dialect_division": dialect_query(DIVISION),
    "dialect_from_first": dialect_query("FROM region"),
    "dialect_star_replace": dialect_query("SELECT * REPLACE (lower(r_name) AS r_name) FROM region"),
}
SQL = {
    "subset_closure": """WITH li AS (SELECT * FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < 100),
o AS (SELECT * FROM orders WHERE (SELECT count(*) FROM orders) <= 200 OR o_orderkey IN (SELECT l_orderkey FROM li)),
p AS (SELECT * FROM part WHERE (SELECT count(*) FROM part) <= 200 OR p_partkey IN (SELECT l_partkey FROM li)),
s AS (SELECT * FROM supplier WHERE (SELECT count(*) FROM supplier) <= 200 OR s_suppkey IN (SELECT l_suppkey FROM li)),
c AS (SELECT * FROM customer WHERE (SELECT count(*) FROM customer) <= 200 OR c_custkey IN (SELECT o_custkey FROM o)),
n AS (SELECT 'region' AS table_name, count(*) AS n, sum(r_regionkey) AS keys FROM region UNION ALL SELECT 'nation', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'customer', count(*), sum(c_custkey) FROM c
  UNION ALL SELECT 'supplier', count(*), sum(s_suppkey) FROM s UNION ALL SELECT 'part', count(*), sum(p_partkey) FROM p UNION ALL SELECT 'orders', count(*), sum(o_orderkey) FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey) FROM li)
SELECT table_name, n, CAST(keys AS BIGINT) AS keys, CAST(0 AS BIGINT) AS dangling FROM n""",
    "log_shapes": "SELECT CAST(n AS BIGINT) AS runs, CAST(n AS BIGINT) AS distinct_queries, CAST(n * n AS BIGINT) AS score FROM (SELECT CASE range WHEN 18 THEN 4 WHEN 21 THEN 3 ELSE 5 END AS n FROM range(1, 23)) t",
    "subset_full": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
    "scale_up": "SELECT c_mktsegment, 3 * count(*) AS n, 3 * count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "routed_query": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_orderpriority",
    "asof_join": """WITH k AS (SELECT min(event_type) AS m FROM events), r AS (SELECT user_id, ts, max(event_id) AS before_id FROM events, k WHERE event_type <> m GROUP BY user_id, ts)
SELECT l.event_id, r.before_id FROM (SELECT event_id, user_id, ts FROM events, k WHERE event_type = m) l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "range_join": "SELECT band, count(*) AS n FROM part JOIN (SELECT range AS band, range * 5 - 2 AS lo, range * 5 + 4 AS hi FROM range(10)) b ON p_size BETWEEN lo AND hi GROUP BY band",
    "result_diff": "SELECT n_nationkey, n_name, CAST(1 AS BIGINT) AS in_a, CAST(0 AS BIGINT) AS in_b FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 3, 'CHANGED', 0, 1",
    "closed_top": "SELECT c_nationkey, n FROM (SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_nationkey) t WHERE r <= 5",
    "schema_check": "SELECT * FROM (VALUES ('nation', 'n_comment', NULL, 'string'), ('nation', 'n_regionkey', 'int', NULL), ('region', 'r_regionkey', 'int', 'bigint')) AS d(table_name, column_name, here, declared)",
    "summarize": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS nulls FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS user_sum FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    "python_functions": "SELECT n_name[1] AS word, round(exp(avg(ln(n_nationkey + 1))), 6) AS g FROM nation GROUP BY 1",
    "dialect_qualify": "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2",
    "dialect_regex": "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, '.*[13579]')",
    "dialect_replace": "SELECT s_suppkey, regexp_replace(s_name, '([0-9])', '<\\1>') AS one, regexp_replace(s_name, '[0-9]', '#', 'g') AS every, CAST(strlen(s_name) AS INT) AS bytes FROM supplier",
    "dialect_division": DIVISION,
    "dialect_from_first": "FROM region",
    "dialect_star_replace": "SELECT * REPLACE (lower(r_name) AS r_name) FROM region",
}
