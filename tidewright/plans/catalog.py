"""Registered queries of the engine and the SQL that DuckDB answers alike."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import relational
from tidewright.plans.text import tables_in
from tidewright.sources.parquet import register_folder

TABLES = "region nation customer supplier part orders lineitem events".split()


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the parquet tables of a folder; those that the text names are registered as temporary views."""
    named = set(tables_in(text))
    register_folder(spark, sf_dir, [t for t in TABLES if t in named])
    return spark.sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidewright.plans import engine, facts

    return {name: functools.partial(run_sql, text=pair[0]) for name, pair in relational.texts().items()} | engine.QUERIES | facts.QUERIES


def oracle_sql() -> dict[str, str]:
    from tidewright.plans import engine, facts

    return {name: pair[1] for name, pair in relational.texts().items()} | engine.SQL | facts.SQL
