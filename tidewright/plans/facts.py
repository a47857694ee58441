"""Queries that run the engine's own machinery on the tables and return what it did, row by row.

Each query's SQL states the same rows from the tables where they hold the answer, and as values where
the answer is a verdict.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.connection import Connection, NoResultError, WriteBlockedError
from tidewright.functions.handlers import Handlers, SparkEngine
from tidewright.operators import analysis, compare, params, subset, workload
from tidewright.plans import router
from tidewright.plans import text as T
from tidewright.sources import parquet, sinks, text
from tidewright.sources.parquet import read_table, register_folder

Facts = list[tuple[str, str]]


def frame(spark: SparkSession, facts: Facts) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in facts], "fact string, value string")


def values(facts: Facts) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in facts) + ") AS f(fact, value)"


def refusal(run: Callable[[], object]) -> str:
    """The name of the error that a call ends in, or "none"."""
    try:
        run()
    except Exception as e:
        return type(e).__name__
    return "none"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder under ``spark.checkpoint.dir`` that all executors share, or a local one where Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/') if base else 'file://' + tempfile.gettempdir()}/tidewright-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# texts ------------------------------------------------------------------------------------------

TEXT_FACTS: list[tuple[str, Callable[[], object], object]] = [
    ("kind of a commented query", lambda: T.statement_kind("-- all of it\n SELECT 1"), "read"),
    ("kind of an update", lambda: T.statement_kind("update t set a = 1"), "write"),
    ("read-only: two queries", lambda: T.is_read_only("select 1; select 2"), True),
    ("read-only: a query and a drop", lambda: T.is_read_only("select 1; drop table t"), False),
    ("read-only: a semicolon in a string", lambda: T.is_read_only("select '; drop table t'"), True),
    ("one select: with", lambda: T.is_select("with a as (select 1) select * from a"), True),
    ("one select: explain", lambda: T.is_select("explain select 1"), False),
    ("one key for other literals", lambda: T.normalize("SELECT a FROM t WHERE b = 5 -- five") == T.normalize("select a from t where b = 7"), True),
    ("another key for another column", lambda: T.normalize("select a from t where b = 5") == T.normalize("select a from t where c = 5"), False),
    ("literals in order", lambda: T.literals("select 'it''s', -2, 0.5 from t where d = date '1996-01-01'"), "[\"it's\", -2, 0.5, '1996-01-01']"),
    ("outer order by", lambda: T.has_order_by("select a from (select a from t order by a) x"), False),
    ("order keys", lambda: T.order_keys("select a, b as c from t order by c desc, 1", ["a", "c"]), [1, 0]),
    ("order key that is no output", lambda: T.order_keys("select a from t order by b", ["a"]), None),
    ("limit and offset", lambda: T.limit_offset("select a from t order by a limit 5 offset 7"), (5, 7)),
    ("widened", lambda: T.widened("select a from t order by a limit 5 offset 7", 24), "select a from t order by a LIMIT 24"),
    ("tables without cte names", lambda: T.tables_in("with x as (select * from b) select extract(year from d) from x, A join c on true"), ["a", "b", "c"]),
    ("string literals", lambda: [v for _, _, v in T.string_literals("select 'a''b' || 'c'")], ["a'b", "c"]),
    ("statements", lambda: T.statements("select 1; select ';' ;"), ["select 1", " select ';' "]),
    ("bound", lambda: T.bind("select a from t where b = [B] and c like '%[C]%'", "SELECT a FROM t WHERE b = -3 AND c LIKE '%x y%'"), {"B": -3, "C": "x y"}),
    ("bound twice to one value", lambda: T.bind("select [A] from t where b = [A]", "select 1 from t where b = 2"), None),
    ("a constant of another type", lambda: T.bind("select a from t where b = 1 and c = [C]", "select a from t where b = '1' and c = 2"), None),
    ("a list", lambda: T.bind("select a from t where b in [B]", "select a from t where b in (1, 2, 3)"), {"B": (1, 2, 3)}),
]


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-1 to RT-12: what the text functions say of small statements."""
    return frame(spark, [(k, f()) for k, f, _ in TEXT_FACTS])


def bound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation put into a template's holes (a number, a string, a pattern, a list) and bound back out of the text."""
    sql = "SELECT * FROM nation WHERE n_nationkey = [KEY] AND n_name = '[NAME]' AND n_name LIKE '%[PART]%' AND n_regionkey IN [REGIONS]"
    out = []
    for r in read_table(spark, sf_dir, "nation").collect():  # 25 rows
        made = params.substitute(sql, {"KEY": r.n_nationkey, "NAME": r.n_name, "PART": r.n_name[-2:].strip("_"), "REGIONS": [r.n_regionkey, r.n_regionkey + 1]})
        got = T.bind(sql, made.lower().replace(r.n_name.lower(), r.n_name))
        out.append((got["KEY"], got["NAME"], got["PART"], list(got["REGIONS"])[-1]))
    return spark.createDataFrame(out, "key int, name string, part string, next_region int")


def parameter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional and named parameters through a connection, and the last answer of several."""
    con = Connection(spark, sf_dir)
    a = con.execute("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > ? AND o_orderstatus = ? GROUP BY o_orderpriority", [200000, "F"]).fetchall()
    b = con.execute("SELECT 'named' AS p, count(*) AS n FROM orders WHERE o_totalprice <= :top", {"top": 200000}).fetchall()
    c = con.executemany("SELECT 'last' AS p, count(*) AS n FROM nation WHERE n_regionkey = ?", [[0], [3]]).fetchall()
    return spark.createDataFrame([*a, *b, *c], "kind string, n long")


def parameter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAR-1 to PAR-12: holes, domains, spaces, template files, extraction, over all 22 templates."""
    out: Facts = [("holes", params.placeholders("[A] [b] '[C]' [A]")), ("filled", params.substitute("a = [A] and b = '[B]' and c in [C]", {"A": 1.5, "B": "it's", "C": ["x", 2]})),
                  ("hoisted", params.hoist_quotes("a = [A]", [{"A": "'x'"}])), ("id", params.query_id("Query12b")), ("natural order", sorted(["q10", "q9", "q9b"], key=params.natural)),
                  ("uncovered", refusal(lambda: params.parse_space("[A]", {}))), ("empty range", refusal(lambda: params.steps(2, 1, 1))), ("null or in", "a IS NULL OR in" if workload.in_or_null(F.col("a"), [1, None]) is not None else "")]
    for t in params.tpch_templates().values():
        got = t.instances(5)
        fits = all({k: str(v) for k, v in T.bind(t.sql, q).items()} == {k: str(v) for k, v in v_.items()} for v_, q in got)
        out.append((f"template {t.query_id}", (len(got), len({T.normalize(q) for _, q in got}), fits, sorted(t.space.types().items()))))
    got = params.extract_templates([q for t in ("14", "11") for _, q in params.tpch_templates()[t].instances(4)])
    out.append(("extracted", [(len(v), len(v[0])) for _, v in got]))
    out.append(("parametrised", workload.parametrize("select * from t where a = 5 and b in ('x', 'y')")))
    with tempfile.TemporaryDirectory() as d:
        Path(d, "q2.sql").write_text("select [N]")
        Path(d, "q1.sql").write_text("select 1")
        Path(d, "params.json").write_text(json.dumps({"q2": {"params": {"N": {"type": "int", "min": 4, "max": 4}}}}))
        out.append(("files", [(k, t.instances(3)[0][1]) for k, t in params.load_templates(d).items()]))
    return frame(spark, out)


# subsets ---------------------------------------------------------------------------------------


def subset_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DS-1 to DS-16 without data: edges, plans, names, versions, refusals."""
    frames = {t: read_table(spark, sf_dir, t) for t in ("nation", "region")}
    edges = subset.join_edges(["select 1 from a x, b where x.i = b.j and x.k = b.l"], {"a": ["i", "k"], "b": ["j", "l"]}, ["b.m=c.m"])
    plan = subset.plan_subset({"a": {"rows": 50}, "b": {"rows": 90}, "c": {"rows": 3}, "d": {"rows": 40}}, edges, 0.5, small=10)
    with scratch(spark) as path:
        kept = subset.write_subset(frames, path)
        again = subset.snapshot({"nation": frames["nation"].where("n_nationkey < 7")}, f"{path}/snap")
        out: Facts = [("edges", [(e.left, e.right, e.pairs) for e in edges]), ("plan", (plan.anchor, plan.order, sorted(plan.whole))), ("own parent", refusal(lambda: subset.join_edges([], {}, ["a.x=a.y"]))),
                      ("too small", refusal(lambda: subset.plan_subset({"a": {"rows": 1}}, [], 0.0))), ("kept", sorted(subset.kept_shares(frames, kept).items())), ("snapshot", again["nation"].count()),
                      ("written twice", subset.snapshot({"nation": frames["nation"]}, f"{path}/snap")["nation"].count()), ("folder", subset.subset_folder("r", 0.02)), ("ladder", subset.ladder([2, 0.5, 1, 2]))]
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            version = subset.fingerprint(spark, [])
            out.append(("stale before", subset.is_stale(local, version)))
            subset.mark(local, version)
            out += [("stale after", subset.is_stale(local, version)), ("fits", (subset.fits_memory(local, 1 << 30), subset.fits_memory(local, 10)))]
    return frame(spark, out)


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent samples: small tables whole, of a large one about the share (told as a verdict)."""
    frames = {t: read_table(spark, sf_dir, t) for t in ("nation", "lineitem")}
    kept = subset.sample_down(frames, 0.3, small=1000)
    share = kept["lineitem"].count() / frames["lineitem"].count()
    return frame(spark, [("nation", kept["nation"].count()), ("lineitem near 0.3", abs(share - 0.3) < 0.03)])


# sources and sinks ------------------------------------------------------------------------------


def sinks_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through every sink and back: parquet, CSV, JSON Lines, Arrow, pickle, an export and a query to a file."""
    supplier = read_table(spark, sf_dir, "supplier")
    supplier.createOrReplaceTempView("supplier")
    found = {}
    with scratch(spark) as path, tempfile.TemporaryDirectory() as local:
        sinks.write_parquet(supplier, f"{path}/p", by=["s_nationkey"])
        found["parquet"] = spark.read.parquet(f"{path}/p")
        sinks.write_csv(supplier, f"{path}/c")
        found["csv"] = spark.read.csv(f"{path}/c", header=True, schema=supplier.schema)
        sinks.write_json(supplier, f"{path}/j")
        found["json"] = spark.read.schema(supplier.schema).json(f"{path}/j")
        sinks.export_tables(spark, ["supplier"], f"{path}/e")
        found["export"] = spark.read.parquet(f"{path}/e/supplier.parquet")
        sinks.transform(spark, f"{path}/e/supplier.parquet", "s_in", "SELECT * FROM s_in WHERE s_nationkey < 100", f"{path}/t")
        found["transform"] = spark.read.parquet(f"{path}/t")
        sinks.write_arrow(supplier.toArrow(), f"{local}/a.arrow")
        found["arrow"] = spark.createDataFrame(sinks.take_arrow(f"{local}/a.arrow"))
        rows = [r.asDict() for r in supplier.collect()]
        for kind, name in (("jsonl", "r.jsonl"), ("pickle", "r.pkl")):
            sinks.write_rows(rows, f"{local}/{name}", kind)
            found[kind] = spark.createDataFrame(pa.Table.from_pylist(sinks.read_rows(f"{local}/{name}")))
        con = Connection(spark, sf_dir).execute("SELECT * FROM supplier")
        con.write_parquet(f"{local}/w.parquet")
        found["connection"] = spark.createDataFrame(pa.parquet.read_table(f"{local}/w.parquet"))
        out = [(k, r.n, r.keys, r.names) for k, df in found.items() for r in [df.agg(F.count("*").alias("n"), F.sum("s_suppkey").cast("long").alias("keys"), F.max("s_name").alias("names")).first()]]
    return spark.createDataFrame(out, "sink string, n long, keys long, last_name string")


def delimited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as delimited text with nulls and escapes, read by the column list of a DDL text."""
    nation = read_table(spark, sf_dir, "nation")
    ddl = text.parse_ddl("CREATE TABLE n (k integer NOT NULL, name varchar(25), note text, flag boolean, big numeric(20,2), PRIMARY KEY (k));")
    lines = nation.select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.lit("a\\tb\\\\n"), F.when(F.col("n_regionkey") > 2, "t").otherwise("f"), F.when(F.col("n_regionkey") == 0, "\\N").otherwise("1.5")))
    with scratch(spark) as path:
        lines.write.text(path)
        got = spark.createDataFrame(text.read_delimited(spark, path, ddl["n"]).toArrow())
    return got.select("k", "name", "note", "flag", F.col("big").cast("double").alias("big"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON Lines log written from the templates, read and mined: runs of each repeated shape."""
    with scratch(spark) as path:
        rows = [(q, None) for t in ("6", "14", "11") for _, q in params.tpch_templates()[t].instances(6)] + [(None, ["select 1 from nation", f"select {k}"]) for k in range(3)]
        spark.createDataFrame(rows, "sql string, statements array<string>").write.json(path)
        log = text.read_query_log(spark, path)
        one = analysis.repeated(log.where("sql IS NOT NULL")).select(F.lit("query").alias("kind"), "runs", "distinct_queries", "score")
        many = analysis.repeated(log.where("statements IS NOT NULL"), "statements").select(F.lit("transaction").alias("kind"), "runs", "distinct_queries", "score")
        return spark.createDataFrame(one.unionAll(many).toArrow())


# router, results, workloads -----------------------------------------------------------------------


def router_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-13 to RT-34: what routed, what fell back and why, what was refused, put aside, published and found again."""
    con = Connection(spark, sf_dir, router.Policy(cross_check_rate=1.0), seed=1)
    sql = "SELECT n_name FROM nation WHERE n_regionkey = [R] ORDER BY n_name"
    t = router.make_template(spark, "by_region", sql)
    con.router.registry.register(t)
    out: Facts = []

    def run(name: str, query: str, parameters=None) -> None:
        con.execute(query, parameters)
        last = con.router.traces[-1]
        out.append((name, (last.outcome, last.reason, last.checked, last.equal, len(con.fetchall()))))

    run("a match", "select n_name from nation where n_regionkey = 2 order by n_name")
    run("a parameter", "select n_name from nation where n_regionkey = ? order by n_name", [3])
    run("another shape", "select n_name from nation where n_regionkey = 2")
    con.router.registry.mark_dirty(["nation"])
    run("a changed table", "select n_name from nation where n_regionkey = 2 order by n_name")
    con.router.registry.clean()
    tied = router.make_template(spark, "tied", "SELECT n_regionkey FROM nation WHERE n_nationkey >= [K] ORDER BY n_regionkey LIMIT 7", lambda s, v: s.sql(f"SELECT n_regionkey FROM nation WHERE n_nationkey >= {v['K']} ORDER BY n_regionkey, n_name DESC LIMIT 7"))
    con.router.registry.register(tied)
    run("ties at the limit", "select n_regionkey from nation where n_nationkey >= 0 order by n_regionkey limit 7")
    wrong = router.make_template(spark, "wrong", "SELECT count(*) AS n FROM region WHERE r_regionkey <> [K]", lambda s, v: s.sql("SELECT count(*) + 1 AS n FROM region"))
    con.router.registry.register(wrong)
    run("a wrong builder", "select count(*) as n from region where r_regionkey <> 1")
    run("put aside", "select count(*) as n from region where r_regionkey <> 1")
    broken = router.make_template(spark, "broken", "SELECT max(r_name) AS m FROM region WHERE r_regionkey < [K]", lambda s, v: s.sql("SELECT no_such_column FROM region"))
    con.router.registry.register(broken)
    run("a broken builder", "select max(r_name) as m from region where r_regionkey < 4")
    out += [("why", con.why("select n_name from nation where n_regionkey = 2 order by n_name").splitlines()[0]), ("why not", con.why("select 1")), ("counters", sorted(con.router.counters.items())),
            ("a write", refusal(lambda: con.execute("DROP VIEW nation"))), ("a refused type", refusal(lambda: router.make_template(spark, "x", "SELECT array(n_name) AS a FROM nation"))),
            ("no select", refusal(lambda: router.make_template(spark, "x", "SHOW TABLES"))), ("no result", refusal(lambda: Connection(spark).fetchall())), ("validated", router.validate(spark, t, [{"R": 1}, {"R": 4}])),
            ("prepared only", refusal(lambda: Connection(spark, policy=router.Policy(mode="prepared_only"), registry=con.router.registry).execute("select 1 from nation"))),
            ("a bad mode", refusal(lambda: router.Policy(mode="x"))), ("blocked", issubclass(WriteBlockedError, PermissionError) and issubclass(NoResultError, RuntimeError))]
    with tempfile.TemporaryDirectory() as d:
        out.append(("unpublished", refusal(lambda: router.publish(d, [t], {}))))
        router.publish(d, [t], {"by_region": 2})
        fresh = router.Registry()
        found = router.Discovery(spark, fresh, d)
        out.append(("discovered", (found.poll(force=True), found.poll(force=True), [x.output for x in fresh.templates()])))
    con.router.registry.unregister("by_region")
    run("after leaving", "select n_name from nation where n_regionkey = 2 order by n_name")
    return frame(spark, out)


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations fetched one by one, in lots, by iteration, as Arrow, pandas and numpy: each way its own rows of one answer."""
    con = Connection(spark, sf_dir)
    q = "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"
    con.execute(q)
    out = [("one", *con.fetchone()), *[("many", *r) for r in con.fetchmany(4)], *[("rest", *r) for r in con]]
    con.execute(q)
    out += [("arrow", *r.values()) for r in con.arrow(10).read_all().to_pylist()] + [("pandas", int(r.n_nationkey), r.n_name) for r in con.df().itertuples()]
    out += [("numpy", int(k), None) for k in con.fetchnumpy()["n_nationkey"]]
    con.register("mine", con.to_arrow_table())
    out += [("registered", *r) for r in con.cursor().execute("SELECT * FROM mine WHERE n_nationkey > 20").fetchall()]
    return spark.createDataFrame(out, "way string, n_nationkey int, n_name string")


def compare_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-1 to CMP-8: verdicts on pairs of results, at sizes on both sides of every former limit."""
    n = [tuple(r) for r in read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").collect()]
    near = [(k, p * (1 + 1e-9)) for k, p in reversed(n)]
    t = lambda rows: pa.table({"k": [r[0] for r in rows], "p": [r[1] for r in rows]})
    out: Facts = [("close, other order", compare.differences(t(near), t(n))), ("ordered by key", compare.differences(t(n), t(near), True, [0])[-1:] != []), ("one off", bool(compare.differences(t(near), t([(n[0][0], n[0][1] + 1), *n[1:]])))),
                  ("other columns", compare.differences(t(n), pa.table({"k": [1]}))[0].split(" [")[0]), ("null and empty", compare.cells_equal(None, "")), ("int and float", compare.multiset_equal([(i,) for i in range(200)], [(float(i),) for i in range(200)])),
                  ("contained", compare.multiset_contains(n, near[:50])), ("aligned", compare.align(["A", "b"], ["B", "a"])), ("ties", compare.differences(t([(1, 2.0)]), t([(1, 3.0)]), True, [0], candidates=t([(1, 2.0), (1, 3.0)])))]
    return frame(spark, out)


def workload_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MS-1 to MS-4, IN-1 to IN-3, SRC-4 to SRC-8: instances, the execution cache, timers, inspection, views and caching."""
    tables = register_folder(spark, sf_dir, ["nation", "region", "supplier", "customer", "orders", "lineitem", "part"])
    entries = workload.produce(params.tpch_templates(), "fast_check")
    calls = []
    run = lambda q: calls.append(q) or spark.sql(q).toArrow()
    timers = workload.Timers()
    with tempfile.TemporaryDirectory() as d:
        cache = workload.ExecutionCache(d)
        for _ in range(3):
            with timers.scope("run"):
                cache.run("spark", "SELECT count(*) AS n FROM nation", {"threads": 2}, run)
        report = workload.validate(spark, [workload.Entry("n", "SELECT n_name FROM nation ORDER BY n_regionkey LIMIT 3", ())], lambda q: spark.sql(q).toArrow(), cache)
    look = analysis.Inspector(spark)
    plans = workload.plans(spark, ["SELECT n_name FROM nation WHERE n_regionkey = 2"])
    con = Connection(spark, sf_dir)
    out: Facts = [("instances", (len(entries), entries == workload.produce(params.tpch_templates(), "fast_check"), len(workload.produce(params.tpch_templates(), "exhaustive", ["6"])))), ("cache", (cache.hits, cache.misses, len(calls))),
                  ("timers", dict(timers.counts)), ("report", report.ok), ("inspected", look.query_data("SELECT n_name FROM nation WHERE n_nationkey = 3").split()[-1]), ("inspected too much", look.query_data("SELECT * FROM lineitem", 2).splitlines()[-1]),
                  ("inspected a write", refusal(lambda: look.query_data("DELETE FROM nation"))), ("plan", "PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,2)]" in "".join(plans.values())), ("read schema", "ReadSchema: struct<n_name:string,n_regionkey:int>" in "".join(plans.values())),
                  ("registered", sorted(tables)), ("listed", {"nation", "orders"} <= set(parquet.list_tables(spark, sf_dir))), ("base tables", "nation" in parquet.base_tables(spark)), ("warmed", parquet.warm(spark, ["nation", "no_such_table"])),
                  ("explained", "AdaptiveSparkPlan" in con.explain("SELECT count(*) FROM nation")), ("kept in memory", workload.materialised(spark.table("region")).count())]
    spark.catalog.uncacheTable("nation")
    return frame(spark, out)


def handled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-1 to UDF-3: an engine's life, and statement and transaction handlers that return lists, iterators and async iterators."""
    engine = SparkEngine(spark, [])
    engine.load_data(sf_dir)
    t = router.make_template(spark, "names", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = [R]")
    wrong = router.make_template(spark, "wrong", "SELECT n_name FROM nation WHERE n_nationkey = [K]", lambda s, v: s.sql("SELECT 1 AS n_name"))
    engine.templates = {x.template_id: x for x in (t, wrong)}
    healthy = engine.health()
    rows = [("engine", r["n_nationkey"], r["n_name"]) for r in engine.run("names", {"R": 2}).to_pylist()]
    rows.append(("wrong types", None, refusal(lambda: engine.run("wrong", {"K": 1}))))
    names = {r.n_nationkey: r.n_name for r in read_table(spark, sf_dir, "nation").collect()}
    engine.close()
    rows += [("closed", None, refusal(lambda: engine.run("names", {"R": 2}))), ("healthy", None, f"{healthy}, {engine.health()}")]

    async def later(given):
        for k, in given[1:]:
            yield "transaction", k, names[k]

    handlers = Handlers(spark)
    schema = "way string, n_nationkey int, n_name string"
    handlers.on("select n_name from nation where n_nationkey = 1", schema, lambda v: [("statement", v[0], names[v[0]])])
    handlers.on("select n_name from nation where n_nationkey < 1", schema, lambda v: (("iterator", k, names[k]) for k in range(v[0])))
    handlers.on(["select 1", "select n_name from nation n where n.n_nationkey = 2"], schema, later)
    asked = ["SELECT n_name FROM nation AS x WHERE 7 = n_nationkey", "select n_name from nation where n_nationkey < 3", ["select 5", "SELECT n_name FROM nation WHERE nation.n_nationkey = 11"]]
    got = [handlers.answer(q) for q in asked]
    rows += [("unknown", None, str(handlers.answer("select 1 from region")))]
    return functools.reduce(DataFrame.unionAll, [spark.createDataFrame(rows, schema), *[g for g in got if g is not None]])


def shape_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AN-1: pairs of queries that are one shape, by the rule that makes them so, and pairs that are not."""
    return frame(spark, [(rule, analysis.structure(a) == analysis.structure(b)) for rule, a, b, _ in SHAPES])


SHAPES: list[tuple[str, str, str, bool]] = [
    ("placeholders and sides", "select a.x from t a where a.x = 5 and a.z > a.y", "SELECT t.x FROM t WHERE t.y < t.z AND 3 = t.x", True),
    ("inner joins, OR terms, BETWEEN", "select 1 from a, b where a.i = b.j and a.k between 1 and 2 and (a.z = 1 or b.y = 2)", "select 1 from b q join a p on q.j = p.i where (q.y = 7 or p.z = 3) and p.k between 4 and 5", True),
    ("operands and output names", "select sum(a * b + c) from t where x in (1, 2) group by d", "select sum(c + b * a) as s from t where x in (3) group by d", True),
    ("subqueries", "select 1 from a where exists (select 1 from b z where z.k = a.k and z.v = 1)", "select 1 from a where exists (select 1 from b where 4 = b.v and a.k = b.k)", True),
    ("unions", "select a from t union all select b as c from u where x = 1 and y = 2", "select a from t union all select b from u where y = 3 and x = 4", True),
    ("outer joins stay", "select 1 from a left join b on a.i = b.i", "select 1 from b left join a on a.i = b.i", False),
    ("differences stay", "select a - b from t", "select b - a from t", False),
    ("AND and OR stay apart", "select 1 from t where a = 1 or b = 2 and c = 3", "select 1 from t where (a = 1 or b = 2) and c = 3", False),
    ("columns stay", "select 1 from t a, t b where a.x < b.x", "select 1 from t a, t b where a.x < b.y", False),
    ("cases stay whole", "select sum(case when a = 1 or b = 2 then 1 else 0 end) from t", "select sum(case when b = 2 or a = 1 then 1 else 0 end) from t", False),
]


def benched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems timed on two entries: which rows come, not how long they took."""
    register_folder(spark, sf_dir, ["nation", "region"])
    entries = [workload.Entry(t, f"SELECT count(*) FROM {t}", ()) for t in ("nation", "region")]
    rows = workload.benchmark({"one": lambda q: spark.sql(q).collect(), "two": lambda q: spark.sql(q).toArrow()}, entries, 1)
    return spark.createDataFrame([(r["query_id"], r["system"], r["time_ms"] > 0) for r in rows], "query_id string, system string, timed boolean")


QUERIES = {
    "text_facts": text_facts, "bound_rows": bound_rows, "parameter_query": parameter_query, "parameter_facts": parameter_facts, "subset_facts": subset_facts, "sampled": sampled, "sinks_read_back": sinks_read_back,
    "delimited_source": delimited_source, "query_log": query_log, "router_facts": router_facts, "result_rows": result_rows, "compare_facts": compare_facts, "workload_facts": workload_facts, "benched": benched,
    "handled_rows": handled_rows, "shape_facts": shape_facts,
}

_HOLES = {
    "1": "[('DELTA', 'INTEGER')]", "2": "[('SIZE', 'INTEGER')]", "3": "[('DATE', 'DATE'), ('SEGMENT', 'VARCHAR')]", "4": "[('DATE', 'DATE')]", "5": "[('DATE', 'DATE'), ('REGION', 'VARCHAR')]",
    "6": "[('DATE', 'DATE'), ('DISCOUNT', 'DOUBLE'), ('QUANTITY', 'INTEGER')]", "7": "[('NATION1', 'VARCHAR'), ('NATION2', 'VARCHAR')]", "8": "[('NATION', 'VARCHAR'), ('SIZE', 'INTEGER')]",
    "9": "[('PIECE', 'VARCHAR')]", "10": "[('DATE', 'DATE')]", "11": "[('FRACTION', 'DOUBLE')]", "12": "[('DATE', 'DATE'), ('FLAGS', 'VARCHAR')]", "13": "[('WORD', 'VARCHAR')]", "14": "[('DATE', 'DATE')]",
    "15": "[('DATE', 'DATE')]", "16": "[('BRAND', 'VARCHAR'), ('SIZES', 'INTEGER')]", "17": "[('BRAND', 'VARCHAR')]", "18": "[('QUANTITY', 'INTEGER')]",
    "19": "[('QUANTITY1', 'INTEGER'), ('QUANTITY2', 'INTEGER'), ('TOP1', 'INTEGER')]", "20": "[('FACTOR', 'DOUBLE')]", "21": "[('STATUS', 'VARCHAR')]", "22": "[('STATUS', 'VARCHAR'), ('TOTAL', 'INTEGER')]",
}
#: Instances asked are 5; these spaces have fewer.
_FEW = {"18": 4, "21": 3}
_SINKS = ", ".join(f"('{x}')" for x in ("parquet", "csv", "json", "export", "transform", "arrow", "jsonl", "pickle", "connection"))
SQL = {
    "text_facts": values([(k, v) for k, _, v in TEXT_FACTS]),
    "bound_rows": "SELECT n_nationkey AS key, n_name AS name, replace(right(n_name, 2), '_', '') AS part, CAST(n_regionkey + 1 AS INTEGER) AS next_region FROM nation",
    "parameter_query": """SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' GROUP BY o_orderpriority
UNION ALL SELECT 'named', count(*) FROM orders WHERE o_totalprice <= 200000 UNION ALL SELECT 'last', count(*) FROM nation WHERE n_regionkey = 3""",
    "parameter_facts": values([
        ("holes", "['A', 'C']"), ("filled", "a = 1.5 and b = 'it''s' and c in ('x', 2)"), ("hoisted", """("a = '[A]'", [{'A': 'x'}])"""), ("id", "12b"), ("natural order", "['q9', 'q9b', 'q10']"), ("uncovered", "ValueError"),
        ("empty range", "ValueError"), ("null or in", "a IS NULL OR in"), *[(f"template {k}", f"({_FEW.get(k, 5)}, 1, True, {v})") for k, v in _HOLES.items()], ("extracted", "[(4, 2), (4, 1)]"),
        ("parametrised", "('select * from t where a = [A] and b in [B]', {'A': 5, 'B': ('x', 'y')})"), ("files", "[('1', 'select 1'), ('2', 'select 4')]")]),
    "subset_facts": values([
        ("edges", "[('a', 'b', (('i', 'j'), ('k', 'l'))), ('b', 'c', (('m', 'm'),))]"), ("plan", "('b', ['b', 'a', 'c', 'd'], ['c', 'd'])"), ("own parent", "ValueError"), ("too small", "ValueError"),
        ("kept", "[('nation', (25, 25, 100.0)), ('region', (5, 5, 100.0))]"), ("snapshot", 7), ("written twice", 25), ("folder", "r/fraction0.02"), ("ladder", "[0.5, 1, 2]"), ("stale before", True), ("stale after", False), ("fits", "(True, False)")]),
    "sampled": values([("nation", 25), ("lineitem near 0.3", True)]),
    "sinks_read_back": f"SELECT sink, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, max(s_name) AS last_name FROM supplier, (VALUES {_SINKS}) AS s(sink) GROUP BY sink",
    "delimited_source": "SELECT n_nationkey AS k, n_name AS name, 'a' || chr(9) || 'b\\n' AS note, n_regionkey > 2 AS flag, CAST(CASE WHEN n_regionkey = 0 THEN NULL ELSE 1.5 END AS DOUBLE) AS big FROM nation",
    "query_log": "SELECT 'query' AS kind, CAST(6 AS BIGINT) AS runs, CAST(6 AS BIGINT) AS distinct_queries, CAST(36 AS BIGINT) AS score FROM range(3) UNION ALL SELECT 'transaction', 3, 3, 9",
    "router_facts": values([
        ("a match", "('routed', '', True, True, 5)"), ("a parameter", "('routed', '', True, True, 5)"), ("another shape", "('fell back', 'no template matches', False, None, 5)"),
        ("a changed table", """('fell back', "changed: ['nation']", False, None, 5)"""), ("ties at the limit", "('routed', '', True, True, 7)"), ("a wrong builder", "('diverged', 'only got: (6,)', True, False, 1)"),
        ("put aside", "('fell back', 'put aside: differs: only got: (6,)', False, None, 1)"), ("a broken builder", "('fell back', 'error: AnalysisException', False, None, 1)"),
        ("why", "would route to by_region with {'R': 2}"), ("why not", "would fall back: no template matches"),
        ("counters", "[('blocked_writes', 0), ('cross_checked', 4), ('error', 1), ('fell_back', 4), ('mismatch', 1), ('routed', 3)]"), ("a write", "WriteBlockedError"), ("a refused type", "UnsupportedError"),
        ("no select", "UnsupportedError"), ("no result", "NoResultError"), ("validated", 2), ("prepared only", "UnsupportedError"), ("a bad mode", "ValueError"), ("blocked", True), ("unpublished", "UnsupportedError"),
        ("discovered", "(1, 0, [(('n_name', 'string'),)])"), ("after leaving", "('fell back', 'no template matches', False, None, 5)")]),
    "result_rows": """SELECT CASE WHEN n_nationkey = 0 THEN 'one' WHEN n_nationkey < 5 THEN 'many' ELSE 'rest' END AS way, n_nationkey, n_name FROM nation
UNION ALL SELECT way, n_nationkey, n_name FROM nation, (VALUES ('arrow'), ('pandas')) AS w(way) UNION ALL SELECT 'numpy', n_nationkey, NULL FROM nation UNION ALL SELECT 'registered', n_nationkey, n_name FROM nation WHERE n_nationkey > 20""",
    "compare_facts": values([("close, other order", []), ("ordered by key", True), ("one off", True), ("other columns", "columns"), ("null and empty", False), ("int and float", True), ("contained", True), ("aligned", [1, 0]), ("ties", [])]),
    "workload_facts": values([
        ("instances", "(22, True, 20)"), ("cache", "(2, 2, 1)"), ("timers", "{'run': 3}"), ("report", True), ("inspected", "NATION_3"), ("inspected too much", "(more than 2 rows)"), ("inspected a write", "PermissionError"), ("plan", True),
        ("read schema", True), ("registered", "['customer', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier']"), ("listed", True), ("base tables", False), ("warmed", 1), ("explained", True), ("kept in memory", 5)]),
    "handled_rows": """SELECT 'engine' AS way, n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'statement', n_nationkey, n_name FROM nation WHERE n_nationkey = 7
UNION ALL SELECT 'iterator', n_nationkey, n_name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'transaction', n_nationkey, n_name FROM nation WHERE n_nationkey = 11
UNION ALL VALUES ('wrong types', NULL, 'ExecutionError'), ('closed', NULL, 'UnsupportedError'), ('healthy', NULL, 'True, False'), ('unknown', NULL, 'None')""",
    "shape_facts": values([(rule, same) for rule, _, _, same in SHAPES]),
    "benched": "SELECT query_id, system, true AS timed FROM (VALUES ('nation'), ('region')) AS q(query_id), (VALUES ('one'), ('two')) AS s(system)",
}
