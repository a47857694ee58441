"""Delimited text, DDL, database and log sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: PostgreSQL type names and the Spark types that hold them.
POSTGRES = {
    "smallint": "smallint", "int2": "smallint", "integer": "int", "int": "int", "int4": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "bigserial": "bigint",
    "real": "float", "float4": "float", "double precision": "double", "float8": "double", "boolean": "boolean", "bool": "boolean", "text": "string", "varchar": "string",
    "character varying": "string", "char": "string", "character": "string", "bpchar": "string", "uuid": "string", "json": "string", "jsonb": "string", "bytea": "binary",
    "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "time": "string",
}


def spark_type(name: str) -> str:
    low = re.sub(r"\s+", " ", name.strip().lower())
    if low.endswith("[]"):
        return f"array<{spark_type(low[:-2])}>"
    m = re.match(r"(?:numeric|decimal)\s*(?:\((\d+)\s*(?:,\s*(\d+))?\))?", low)
    if m:
        return f"decimal({min(38, int(m[1] or 38))},{m[2] or (0 if m[1] else 10)})"
    return POSTGRES.get(re.sub(r"\s*\(\d+\)", "", low), "string")


def parse_ddl(text: str) -> dict[str, list[tuple[str, str]]]:
    """(column, Spark type) lists of the CREATE TABLE statements of a text; table constraints are passed over."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", "", text, flags=re.DOTALL)
    out = {}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(", text, re.IGNORECASE):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        columns, part, depth = [], "", 0
        for c in text[m.end() : i - 1] + ",":
            depth += {"(": 1, ")": -1}.get(c, 0)
            if c == "," and not depth:
                w = re.match(r'\s*"?(\w+)"?\s+(.+)', part, re.DOTALL)
                if w and w[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key"):
                    kind = re.split(r"\s+(?:not|null|default|primary|references|unique|check|collate|generated|constraint)\b", w[2], flags=re.IGNORECASE)[0]
                    columns.append((w[1].lower(), spark_type(kind)))
                part = ""
            else:
                part += c
        out[m[1].strip('"').split(".")[-1].strip('"').lower()] = columns
    return out


def read_delimited(spark: SparkSession, path: str, columns: list[tuple[str, str]] | None = None, sep: str = "\t", null: str = "\\N") -> DataFrame:
    """Headerless, unquoted text. Columns are cast where they can be, else null; if the column list is
    missing or of another length, all are strings named col_0, col_1, ... An empty file has one column."""
    rows = spark.read.text(path).select(F.split("value", re.escape(sep), -1).alias("v"))
    first = rows.first()
    width = len(first["v"]) if first else 1
    if columns is None or len(columns) != width:
        columns = [(f"col_{i}", "string") for i in range(width)]

    def cell(i: int, kind: str):
        raw = F.get("v", i)
        x = F.when(raw != null, _unescape(raw))
        if kind == "boolean":
            return F.when(x.isin("t", "true"), True).when(x.isin("f", "false"), False)
        return x if kind == "string" else x.try_cast(kind)

    return rows.select(*[cell(i, k).alias(n) for i, (n, k) in enumerate(columns)])


def _unescape(x):
    """Backslash escapes of the copy format, the escaped backslash last of all."""
    x = F.replace(x, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.replace(x, F.lit("\x00"), F.lit("\\"))


def decode_integers(df: DataFrame, dates: list[str] = (), seconds: list[str] = ()) -> DataFrame:
    """Columns of days (seconds) since 1970 as dates (timestamps)."""
    new = {c: F.date_from_unix_date(F.col(c).cast("int")) for c in dates}
    new |= {c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz") for c in seconds}
    return df.withColumns(new)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, in parallel ranges of a numeric column if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


LOG = T.StructType([T.StructField("ts", T.StringType()), T.StructField("sql", T.StringType()), T.StructField("statements", T.ArrayType(T.StringType())), T.StructField("duration_ms", T.DoubleType())])


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON Lines query log: single statements in ``sql``, transactions in ``statements``."""
    return spark.read.schema(LOG).json(path)


def generate(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)
