"""Rewrites of SQL text for Spark, held against DuckDB."""

import math

import duckdb
import pytest

from tidewright.connection import Connection
from tidewright.plans import dialect

SF = "/root/testdata/sf0.001"

QUOTIENTS = [
    "SELECT -1/0 AS x, 0/0 AS y, 1.5/0 AS z, NULL/0 AS w, 1/NULL AS v",
    "SELECT n_nationkey / n_regionkey FROM nation n ORDER BY n_nationkey",
    "SELECT n_nationkey, n_regionkey / (n_regionkey - 2) AS q, n_nationkey * 2 / n_regionkey / 3 + 1 AS r FROM nation ORDER BY 1",
    "SELECT sum(n.n_nationkey) / sum(n.n_regionkey) / count(*) q, 100.0 * sum(CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END) / CASE WHEN 1 = 1 THEN 0 ELSE 1 END AS z FROM nation n",
    "SELECT n_nationkey, n_nationkey::double / n_regionkey::double AS a, sum(n_nationkey) OVER (PARTITION BY n_regionkey) / sum(n_regionkey) OVER (PARTITION BY n_regionkey) AS b FROM nation ORDER BY 1",
    "SELECT a / b AS q, count(*) AS n FROM (SELECT n_nationkey a, n_regionkey b FROM nation) t WHERE (a + 1) / b > 1 GROUP BY a / b ORDER BY n DESC, q",
    "SELECT count(*) FILTER (WHERE n_regionkey = 1) / count(*) FILTER (WHERE n_regionkey > 9) AS q, abs(-3) / abs(0) AS r, max(n_nationkey / 2) AS h FROM nation",
    "SELECT n_nationkey / - n_regionkey x, '/' AS s, (SELECT 1) / (SELECT 0) AS sub FROM nation ORDER BY n_nationkey",
]


def _plain(rows):
    return [tuple("nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9) if not isinstance(v, str | None) else v for v in r) for r in rows]


@pytest.mark.parametrize("sql", QUOTIENTS)
def test_division_by_zero(spark, sql):
    con, duck = Connection(spark, SF), duckdb.connect()
    duck.execute(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    con.execute(sql)
    assert [d[0] for d in con.result.description] == [d[0] for d in duck.execute(sql).description]
    assert _plain(con.fetchall()) == _plain(duck.execute(sql).fetchall())


def test_divisions_that_stay():
    for sql in ("SELECT a / 7.0 FROM t", "SELECT '1/0' AS s", "SELECT a /* / */ FROM t", "SELECT 1"):
        assert dialect.divisions(sql) == sql


def test_division_by_a_parameter(spark):
    con = Connection(spark, SF)
    assert con.execute("SELECT n_nationkey / ? AS q FROM nation WHERE n_nationkey = 4", [2]).fetchall() == [(2.0,)]
    assert con.execute("SELECT n_nationkey / ? AS q FROM nation WHERE n_nationkey = 4", [0]).fetchall() == [(None,)]
