"""Every registered query against DuckDB, the router end to end, subsets, sources and sinks."""

import datetime as dt
import json

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.connection import Connection, WriteBlockedError
from tidewright.operators import analysis, subset
from tidewright.plans import catalog, router
from tidewright.sources import parquet, sinks, text
from tidewright.streaming import events as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture
def con(spark):
    spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "z"), (5, "z")], "a int, b string").createOrReplaceTempView("t")
    return Connection(spark, policy=router.Policy(), seed=1)


def test_routes_and_checks(spark, con):
    con.router.registry.register(router.make_template(spark, "by_b", "SELECT a FROM t WHERE b = '[B]' ORDER BY a"))
    assert con.execute("select a from t where b = 'y' order by a").fetchall() == [(2,), (3,)]
    assert con.execute("select a from t where b = ? order by a", ["z"]).fetchall() == [(4,), (5,)]
    assert con.router.counters["routed"] == con.router.counters["cross_checked"] == 2
    assert con.execute("select a from t where b = 'y'").fetchall() and con.router.traces[-1].reason == "no template matches"
    assert con.why("select a from t where b = 'q' order by a").startswith("would route to by_b")
    assert "blocked" in con.why("drop table t")


def test_mismatch_is_served_from_the_query(spark, con):
    con.router.registry.register(router.make_template(spark, "bad", "SELECT a FROM t WHERE b = '[B]'", lambda s, v: s.sql("SELECT 9 AS a")))
    assert con.execute("select a from t where b = 'x'").fetchall() == [(1,)]
    assert con.router.counters["mismatch"] == 1 and "put aside" in con.why("select a from t where b = 'x'")


def test_breaker(spark, con):
    def fail(s, v):
        raise RuntimeError("no")

    con.router.registry.register(router.make_template(spark, "fails", "SELECT count(*) AS n FROM t WHERE a > [A]", fail))
    for _ in range(4):
        assert con.execute("select count(*) as n from t where a > 3").fetchone() == (2,)
    assert con.router.counters["error"] == 3


def test_schema_drift_and_dirty_tables(spark, con):
    con.router.registry.register(router.make_template(spark, "d", "SELECT a FROM t WHERE a = [A]"))
    con.router.registry.mark_dirty(["T"])
    con.execute("select a from t where a = 1")
    assert con.router.traces[-1].reason.startswith("changed")
    con.router.registry.clean()
    spark.createDataFrame([(1, "x", 2)], "a int, b string, c int").createOrReplaceTempView("t")
    con.execute("select a from t where a = 1")
    assert con.router.traces[-1].reason == "the tables' columns differ"


def test_limit_ties(spark, con):
    con.router.registry.register(router.make_template(spark, "tie", "SELECT a, b FROM t WHERE a > [A] ORDER BY b LIMIT 2", lambda s, v: s.sql(f"SELECT a, b FROM t WHERE a > {v['A']} ORDER BY b, a DESC LIMIT 2")))
    assert con.execute("select a, b from t where a > 1 order by b limit 2").fetchall() == [(3, "y"), (2, "y")]
    assert con.router.traces[-1].equal


def test_refusals(spark, con):
    with pytest.raises(WriteBlockedError):
        con.execute("drop view t")
    with pytest.raises(router.UnsupportedError):
        router.make_template(spark, "x", "SELECT array(a) AS v FROM t")
    with pytest.raises(router.UnsupportedError):
        router.make_template(spark, "x", "DELETE FROM t")


def test_result_surface(con, tmp_path):
    con.execute("select a, b from t order by a")
    assert con.fetchone() == (1, "x") and con.fetchmany(2) == [(2, "y"), (3, "y")] and list(con) == [(4, "z"), (5, "z")]
    assert con.description[0][0] == "a" and con.arrow().read_all().num_rows == 5 and len(con.df()) == 5 and con.fetchnumpy()["a"].sum() == 15
    con.write_parquet(str(tmp_path / "r.parquet"))
    con.write_csv(str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().startswith('"a","b"') and "5 rows" in con.show()
    con.register("p", pd.DataFrame({"q": [1, 2]})).execute("FROM p")
    assert len(con.fetchall()) == 2
    assert con.execute("SUMMARIZE t").fetchone()[0] == "a"
    assert con.executemany("select a from t where a = ?", [[1], [2]]).fetchall() == [(2,)]


def test_publish_and_discover(spark, con, tmp_path):
    t = router.make_template(spark, "pub", "SELECT b FROM t WHERE a = [A]")
    assert router.validate(spark, t, [{"A": 1}, {"A": 3}]) == 2
    with pytest.raises(router.UnsupportedError):
        router.publish(tmp_path, [t], {})
    router.publish(tmp_path, [t], {"pub": 2})
    found = router.Discovery(spark, con.router.registry, tmp_path)
    assert found.poll() == 1 and found.poll() == 0
    assert con.execute("select b from t where a = 3").fetchall() == [("y",)] and con.router.counters["routed"] == 1


def test_subset_is_closed(spark):
    frames = {
        "nation": spark.range(5).select(F.col("id").alias("n_nationkey")), "island": spark.range(3).select(F.col("id").alias("x")),
        "customer": spark.range(50).select(F.col("id").alias("c_custkey"), (F.col("id") % 5).alias("c_nationkey")),
        "orders": spark.range(200).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey")),
        "lineitem": spark.range(1000).select(F.col("id").alias("l_id"), (F.col("id") % 200).alias("l_orderkey"))}
    edges = subset.join_edges(["select 1 from lineitem l join orders o on l.l_orderkey = o.o_orderkey, customer, nation where o_custkey = c_custkey and c_nationkey = n_nationkey"], {t: f.columns for t, f in frames.items()})
    assert {(e.left, e.right) for e in edges} == {("lineitem", "orders"), ("customer", "orders"), ("customer", "nation")}
    plan = subset.plan_subset({t: {"rows": f.count()} for t, f in frames.items()}, edges, 0.2, small=10)
    kept = subset.subset(frames, plan)
    assert plan.anchor == "lineitem" and kept["island"].count() == 3 and 0 < kept["lineitem"].count() < 500
    assert all(subset.dangling(kept, e) == 0 for e in [subset.Edge("lineitem", "orders", (("l_orderkey", "o_orderkey"),)), subset.Edge("orders", "customer", (("o_custkey", "c_custkey"),))])
    for bad in (0, 1.5, 0.0001):
        with pytest.raises(ValueError):
            subset.plan_subset({"a": {"rows": 1}}, [], bad)


def test_subset_composite_key(spark):
    frames = {"psupp": spark.createDataFrame([(1, 10), (1, 20), (2, 20)], "pk int, sk int"), "li": spark.createDataFrame([(1, 10, 0), (2, 20, 0), (2, 20, 1), (1, 10, 1)], "lp int, ls int, x int")}
    edge = subset.Edge("li", "psupp", (("lp", "pk"), ("ls", "sk")))
    kept = subset.subset(frames, subset.Plan("li", ["li", "psupp"], set(), 0.999, [edge]), {"li": ["x"]})
    assert sorted(map(tuple, kept["psupp"].collect())) == [(1, 10), (2, 20)]


def test_snapshot(spark, tmp_path):
    copy = subset.snapshot({"nation": parquet.read_table(spark, SF, "nation")}, f"file://{tmp_path}/sf1")
    assert copy["nation"].count() == 25 and subset.complete_subsets(str(tmp_path), ["nation"]) == [f"{tmp_path}/sf1"]
    subset.mark(f"{tmp_path}/sf1", "v1")
    assert not subset.is_stale(f"{tmp_path}/sf1", "v1") and subset.is_stale(f"{tmp_path}/sf1", "v2") and subset.fits_memory(f"{tmp_path}/sf1", 1 << 20)


def test_delimited_and_ddl(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\\ty\tt\t2020-01-02\n\\N\t\\\\N\tf\tbad\n")
    ddl = text.parse_ddl("CREATE TABLE a ( -- c\n id INTEGER NOT NULL, name VARCHAR(10) DEFAULT 'a,b', ok boolean, d DATE, PRIMARY KEY (id));")
    got = text.read_delimited(spark, f"file://{tmp_path}/a.tsv", ddl["a"]).collect()
    assert [tuple(r) for r in got] == [(1, "x\ty", True, dt.date(2020, 1, 2)), (None, "\\N", False, None)]
    assert text.read_delimited(spark, f"file://{tmp_path}/a.tsv").columns == ["col_0", "col_1", "col_2", "col_3"]
    assert text.spark_type("numeric(15,2)") == "decimal(15,2)" and text.spark_type("integer[]") == "array<int>"
    d = text.decode_integers(spark.range(1), ["id"]).first()
    assert d.id == dt.date(1970, 1, 1)


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 2 AS a")
    sinks.write_parquet(df, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").columns == ["a", "a_2"]
    sinks.write_rows([{"x": 1}], str(tmp_path / "r.jsonl"), "jsonl")
    sinks.write_rows([{"x": 1}], str(tmp_path / "r.pkl"), "pickle")
    assert sinks.read_rows(str(tmp_path / "r.jsonl")) == sinks.read_rows(str(tmp_path / "r.pkl")) == [{"x": 1}]
    sinks.write_arrow(pa.table({"x": [1]}), str(tmp_path / "t.arrow"))
    assert sinks.take_arrow(str(tmp_path / "t.arrow")).num_rows == 1 and not (tmp_path / "t.arrow").exists()
    sinks.append_bench(str(tmp_path / "b.csv"), [{"query_id": "1", "time_ms": 2}])
    assert (tmp_path / "b.csv").read_text().startswith("query_id,scale_factor")


def test_log_mining(spark, tmp_path):
    lines = [{"sql": "select a from t where x = 1 and y = 2"}, {"sql": "SELECT a FROM t WHERE y = 5 AND x = 3"}, {"sql": "select a from t where x = 1 and y = 2"}, {"sql": "select b from t"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (r,) = analysis.repeated(text.read_query_log(spark, f"file://{tmp_path}/log.jsonl")).collect()
    assert (r.runs, r.distinct_queries, r.score) == (3, 2, 6)
    look = analysis.Inspector(spark)
    assert "4" in look.query_data("select 2 + 2 as n")
    with pytest.raises(PermissionError):
        look.query_data("drop table t")


def test_streams(spark, tmp_path):
    e = parquet.read_table(spark, SF, "events")
    e.orderBy("ts").repartition(3).write.parquet(f"file://{tmp_path}/e")
    got = streams.replay(spark, f"file://{tmp_path}/e", e.schema, "w", lambda s: streams.windowed(s, late="40 days"), "complete").count()
    assert got == streams.windowed(e).count()
    assert streams.windowed(e, "1 hour", "30 minutes").count() > got
