"""A connection for read-only SQL with a DB-API-like result, over Spark and the template router."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tidewright.operators.analysis import summarize
from tidewright.plans import text as T
from tidewright.plans.router import Discovery, Policy, Registry, Router
from tidewright.sources import parquet


class WriteBlockedError(PermissionError):
    """A statement that is not read-only."""


class NoResultError(RuntimeError):
    """Nothing was executed yet."""


class Result:
    """One answer: an Arrow table, or a frame whose rows come partition by partition as they are fetched.

    ``fetchone``, ``fetchmany`` and iteration hold a partition of a frame at a time; only what asks for the
    whole answer (``table``, ``df``, ``arrow`` and the like) brings all of it to the driver.
    """

    def __init__(self, answer: pa.Table | DataFrame, seconds: float = 0.0):
        self._table = answer if isinstance(answer, pa.Table) else None
        self._frame = answer if self._table is None else None
        self.seconds, self._rows = seconds, None

    @property
    def table(self) -> pa.Table:
        if self._table is None:
            self._table = self._frame.toArrow()
        return self._table

    @property
    def schema(self) -> pa.Schema:
        return to_arrow_schema(self._frame.schema) if self._table is None else self._table.schema

    @property
    def description(self) -> list[tuple]:
        return [(f.name, str(f.type), None, None, None, None, f.nullable) for f in self.schema]

    @staticmethod
    def _tuples(batches) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True) if b.num_columns else ()

    def _cursor(self) -> Iterator[tuple]:
        if self._rows is None:
            self._rows = self._tuples(self._table.to_batches()) if self._table is not None else map(tuple, self._frame.toLocalIterator(prefetchPartitions=True))
        return self._rows

    def fetchone(self) -> tuple | None:
        return next(self._cursor(), None)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return list(itertools.islice(self._cursor(), size))

    def fetchall(self) -> list[tuple]:
        return list(self._cursor())

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.fetchone()) is not None:
            yield row

    def to_arrow_table(self) -> pa.Table:
        return self.table

    def arrow(self, batch_size: int = 1_000_000) -> pa.RecordBatchReader:
        return pa.RecordBatchReader.from_batches(self.table.schema, self.table.to_batches(max_chunksize=batch_size))

    fetch_record_batch = arrow

    def df(self):
        return self.table.to_pandas()

    def pl(self):
        """The answer as a Polars frame, where Polars is installed."""
        import polars

        return polars.from_arrow(self.table)

    def fetchnumpy(self) -> dict:
        return {n: c.to_numpy(zero_copy_only=False) for n, c in zip(self.table.column_names, self.table.columns, strict=True)}

    def show(self, rows: int = 20, width: int = 40) -> str:
        cut = lambda v: s if len(s := "NULL" if v is None else str(v)) <= width else s[: width - 1] + "…"
        body = [[cut(v) for v in r] for r in self._tuples(self.table.slice(0, rows).to_batches())]
        heads = [cut(n) for n in self.table.column_names]
        wide = [max(map(len, c)) for c in zip(heads, *body, strict=True)]
        line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True))
        foot = f"{self.table.num_rows} rows in {self.seconds:.3f} s"
        return "\n".join([line(heads), "-+-".join("-" * w for w in wide), *map(line, body), foot])


class Connection:
    """``execute`` may be served by a template; ``sql`` is a lazy DataFrame and never is."""

    def __init__(self, spark: SparkSession, folder: str | None = None, policy: Policy | None = None, registry: Registry | None = None, templates: str | None = None, seed: int | None = None):
        self.spark = spark
        self.tables = parquet.register_folder(spark, folder) if folder else []
        self.router = Router(spark, policy or Policy.from_env(), registry, seed)
        self.discovery = Discovery(spark, self.router.registry, templates) if templates else None
        self.result: Result | None = None

    def _gate(self, sql: str) -> None:
        if self.router.policy.block_writes and not T.is_read_only(sql):
            self.router.counters["blocked_writes"] += 1
            raise WriteBlockedError("only read-only statements are allowed")

    def execute(self, sql: str, parameters=None) -> Connection:
        self._gate(sql)
        if self.discovery:
            self.discovery.poll()
        began = time.perf_counter()
        if T.tokenize(sql) and T.tokenize(sql)[0].low == "summarize":
            table = self.summarize(sql.split(None, 1)[1].strip().rstrip(";")).toArrow()
        else:
            table, _ = self.router.route(sql, parameters)
            if table is None:
                for part in T.statements(sql)[:-1]:
                    self.router.plain(part)
                table = self.router.plain(T.statements(sql)[-1], parameters)
        self.result = Result(table, time.perf_counter() - began)
        return self

    def executemany(self, sql: str, rows: list) -> Connection:
        """Run once for each row of parameters, never routed; the last answer stays."""
        self._gate(sql)
        for r in rows:
            self.result = Result(self.router.plain(sql, r))
        return self

    def sql(self, sql: str, parameters=None) -> DataFrame:
        self._gate(sql)
        return self.router.plain(sql, parameters)

    query = sql

    def summarize(self, name_or_query: str) -> DataFrame:
        return summarize(self.spark.table(name_or_query) if " " not in name_or_query else self.sql(name_or_query))

    def register(self, name: str, data) -> Connection:
        """Make an Arrow table, a pandas or a Spark DataFrame a view."""
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        df.createOrReplaceTempView(name)
        return self

    def load_data(self) -> int:
        """Cache the registered tables; how many could be."""
        return parquet.warm(self.spark, self.tables)

    def why(self, sql: str, parameters=None) -> str:
        return self.router.why(sql, parameters)

    def explain(self, sql: str, mode: str = "formatted") -> str:
        self._gate(sql)
        return self.spark.sql(f"EXPLAIN {mode} {self.router.plain(sql) and T.statements(sql)[-1]}").first()[0]

    def _need(self) -> Result:
        if self.result is None:
            raise NoResultError("execute a query first")
        return self.result

    def write_parquet(self, path: str) -> None:
        """The current answer as one parquet file on the driver's disk."""
        import pyarrow.parquet as pq

        pq.write_table(self._need().table, path)

    def write_csv(self, path: str) -> None:
        import pyarrow.csv as pc

        pc.write_csv(self._need().table, path)

    def __getattr__(self, name: str):
        if name.startswith("fetch") or name in ("df", "pl", "arrow", "to_arrow_table", "description", "show"):
            return getattr(self._need(), name)
        raise AttributeError(name)

    def __iter__(self):
        return iter(self._need())

    def cursor(self) -> Connection:
        other = Connection.__new__(Connection)
        other.__dict__ = self.__dict__ | {"result": None}
        return other

    def close(self) -> None:
        self.result = None

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


_DEFAULT: list[Connection] = []


def connect(folder: str | None = None, spark: SparkSession | None = None, config: Mapping[str, str] | None = None, **more) -> Connection:
    spark = spark or SparkSession.builder.config(map={"spark.sql.session.timeZone": "UTC"} | dict(config or {})).getOrCreate()
    return Connection(spark, folder, **more)


def default_connection() -> Connection:
    if not _DEFAULT:
        _DEFAULT.append(connect())
    return _DEFAULT[0]


def sql(text: str) -> DataFrame:
    return default_connection().sql(text)


def execute(text: str, parameters=None) -> Connection:
    return default_connection().execute(text, parameters)
