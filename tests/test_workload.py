"""Workload production, execution cache, validation and template extraction."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.operators import workload as W
from tidewright.operators.params import substitute, tpch_templates
from tidewright.plans import text as T
from tidewright.sources.parquet import register_folder

SF = "/root/testdata/sf0.001"


def test_produce_is_seeded():
    a, b = (W.produce(tpch_templates(), "exhaustive", ["1", "6"]) for _ in range(2))
    assert a == b and len({e.sql for e in a}) == len(a) == 40
    with pytest.raises(ValueError):
        W.produce({}, "x")


def test_validate_against_duckdb(spark, tmp_path):
    tables = register_folder(spark, SF, ["customer", "orders", "lineitem", "nation", "region", "supplier", "part"])
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    run = lambda sql: con.execute(sql).to_arrow_table()
    cache = W.ExecutionCache(tmp_path)
    entries = W.produce(tpch_templates(), "fast_check")
    report = W.validate(spark, entries, run, cache)
    assert report.ok, report.differences
    assert W.validate(spark, entries, run, cache).ok and cache.hits == cache.misses == len(entries)
    assert report.total_speedup() > 0 and report.average_speedup() > 0
    wrong = W.validate(spark, entries[:1], lambda sql: run(sql.replace("count(*)", "count(*) + 1")))
    assert not wrong.ok
    assert {r["system"] for r in W.benchmark({"duckdb": run}, entries[:2], 1)} == {"duckdb"}


def test_parametrize():
    sql = "select * from t where a = 5 and b in ('x', 'y') and c not in (1, 2) and d ilike '%z%' and a > 2"
    template, values = W.parametrize(sql)
    assert template == "select * from t where a = [A] and b in [B] and c not in [C] and d ilike '[D]' and a > [A_2]"
    assert values == {"A": 5, "B": ("x", "y"), "C": (1, 2), "D": "%z%", "A_2": 2}
    assert T.normalize(substitute(template, values)) == T.normalize(sql)


def test_in_or_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert df.where(W.in_or_null(F.col("a"), [1, None])).count() == 2 and df.where(W.in_or_null(F.col("a"), [None])).count() == 1
    timers = W.Timers()
    with timers.scope("x"):
        pass
    assert timers.counts["x"] == 1
