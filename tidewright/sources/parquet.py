"""Parquet folders as tables: views, caching, and what a folder holds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the ``<table>.parquet`` files and folders in a folder, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName()[:-8] for f in found if f.getPath().getName().endswith(".parquet"))


#: Schemas of files seen before, by application, path, change time and length: their footers need no second look.
_SCHEMAS: dict[tuple, StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. The schema of a single file is kept until the file changes; folders are looked at anew."""
    path = f"{folder}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isDirectory():
        return spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def register_folder(spark: SparkSession, folder: str, tables: Iterable[str] | None = None) -> list[str]:
    """Register a view for each table of a folder; returns their names. Views are replaced, data stay where they are."""
    names = list(tables) if tables is not None else list_tables(spark, folder)
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)
    return names


def base_tables(spark: SparkSession) -> list[str]:
    """Catalog tables without views."""
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType not in ("VIEW", "TEMPORARY"))


def warm(spark: SparkSession, tables: Iterable[str]) -> int:
    """Cache tables now; returns how many could be. Failures are skipped."""
    done = 0
    for name in tables:
        try:
            spark.sql(f"CACHE TABLE `{name}`")
            done += 1
        except Exception:
            continue
    return done


def schema_of(spark: SparkSession, folder: str, tables: Iterable[str]) -> dict[str, dict[str, str]]:
    """Column types of a folder's tables, by table and column."""
    return {t: dict(read_table(spark, folder, t).dtypes) for t in tables}


def schema_differences(one: Mapping[str, Mapping[str, str]], other: Mapping[str, Mapping[str, str]]) -> list[tuple[str, str, str | None, str | None]]:
    """(table, column, type in one, type in the other) where two sets of tables disagree; None for a missing column."""
    out = []
    for t in sorted(one.keys() | other.keys()):
        a, b = one.get(t, {}), other.get(t, {})
        out += [(t, c, a.get(c), b.get(c)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]
    return out
