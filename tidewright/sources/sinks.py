"""Sinks: parquet, CSV, JSON Lines, Arrow and pickle files, table exports and benchmark rows."""

from __future__ import annotations

import csv
import json
import pickle
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BENCH_COLUMNS = ["query_id", "scale_factor", "benchmark", "system", "num_threads", "time_ms", "hostname", "snapshot"]


def unique_names(df: DataFrame) -> DataFrame:
    """Columns with equal names get a number, as files cannot hold two of one name."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        k = seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if k == 1 else f"{c}_{k}")
    return df.toDF(*names)


def write_parquet(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    w = unique_names(df).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    unique_names(df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    unique_names(df).write.mode("overwrite").json(path)


def export_tables(spark: SparkSession, tables: Iterable[str], folder: str) -> None:
    for t in tables:
        write_parquet(spark.table(t), f"{folder}/{t}.parquet")


def transform(spark: SparkSession, source: str, view: str, sql: str, target: str) -> None:
    """Parquet to parquet through one query."""
    spark.read.parquet(source).createOrReplaceTempView(view)
    write_parquet(spark.sql(sql), target)


def _json_rows(rows: Iterable[Mapping], path: str) -> None:
    with Path(path).open("a", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(dict(r), default=str) + "\n")


def _pickle_rows(rows: Iterable[Mapping], path: str) -> None:
    Path(path).write_bytes(pickle.dumps([dict(r) for r in rows]))


#: Writers of small row sets on the driver's disk, by format.
ROW_WRITERS: dict[str, Callable[[Iterable[Mapping], str], None]] = {"jsonl": _json_rows, "pickle": _pickle_rows}


def write_rows(rows: Iterable[Mapping], path: str, kind: str) -> None:
    if kind not in ROW_WRITERS:
        raise ValueError(f"no row writer {kind!r}; there are {sorted(ROW_WRITERS)}")
    ROW_WRITERS[kind](rows, path)


def read_rows(path: str) -> list[dict]:
    if path.endswith((".pkl", ".pickle")):
        return pickle.loads(Path(path).read_bytes())
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x.strip()]


def write_arrow(table: pa.Table, path: str) -> None:
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)


def take_arrow(path: str) -> pa.Table:
    """Read an Arrow file once; it is deleted."""
    with pa.OSFile(path, "rb") as f:
        table = pa.ipc.open_file(f).read_all()
    Path(path).unlink()
    return table


def append_bench(path: str, rows: Iterable[Mapping]) -> None:
    new = not Path(path).exists()
    with Path(path).open("a", newline="") as f:
        w = csv.DictWriter(f, BENCH_COLUMNS)
        if new:
            w.writeheader()
        w.writerows(rows)
