"""Engines and handlers: what serves a query that is not served by its text."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import AsyncIterable, Callable, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewright.operators.analysis import structure
from tidewright.plans import text as T
from tidewright.plans.router import ExecutionError, Template, UnsupportedError
from tidewright.sources import parquet


class Engine(Protocol):
    """What the router asks of an engine."""

    def health(self) -> bool: ...

    def load_data(self, folder: str) -> list[str]: ...

    def run(self, query_id: str, values: Mapping[str, object]) -> pa.Table: ...

    def close(self) -> None: ...


class SparkEngine:
    """Templates run on a session. After ``close`` nothing runs and the engine is not healthy."""

    def __init__(self, spark: SparkSession, templates: Sequence[Template]):
        self.spark, self.templates, self.loaded, self.open = spark, {t.template_id: t for t in templates}, [], True

    def health(self) -> bool:
        try:
            return self.open and self.spark.range(1).count() == 1
        except Exception:
            return False

    def load_data(self, folder: str) -> list[str]:
        """Register a folder's tables; their names."""
        self.loaded = parquet.register_folder(self.spark, folder)
        return self.loaded

    def run(self, query_id: str, values: Mapping[str, object]) -> pa.Table:
        """The answer of a template, whose names and types must be those it was made with."""
        if not self.open or query_id not in self.templates:
            raise UnsupportedError(f"no query {query_id!r} here" if self.open else "the engine is closed")
        t = self.templates[query_id]
        df = t.build(self.spark, values)
        kinds = tuple((f.name, f.dataType.simpleString()) for f in df.schema)
        if t.output and kinds != t.output:
            raise ExecutionError(f"{query_id} gives {kinds}, not {t.output}")
        return df.toArrow()

    def close(self) -> None:
        for name in self.loaded:
            self.spark.catalog.dropTempView(name)
        self.loaded, self.open = [], False


class Handlers:
    """Functions that answer statements, or whole transactions, of a known shape with rows.

    A handler gets the literal values in order (for a transaction, those of each statement) and returns rows: a
    sequence, an iterable, an async iterable, or an awaitable of one. ``schema`` names and types them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    @staticmethod
    def _shape(statements: Sequence[str]) -> tuple[str | None, ...]:
        return tuple(structure(s) for s in statements)

    def on(self, example: str | Sequence[str], schema: str, fn: Callable) -> None:
        """Let ``fn`` answer statements shaped as the example; a list of examples is a transaction."""
        parts = [example] if isinstance(example, str) else list(example)
        if None in self._shape(parts):
            raise UnsupportedError("an example cannot be read")
        self.known[self._shape(parts)] = (schema, fn, isinstance(example, str))

    def answer(self, sql: str | Sequence[str]) -> DataFrame | None:
        """The handler's rows as a frame, or None if no handler knows the shape."""
        parts = T.statements(sql) if isinstance(sql, str) else list(sql)
        found = self.known.get(self._shape(parts))
        if found is None:
            return None
        schema, fn, single = found
        values = [T.literals(s) for s in parts]
        return self.spark.createDataFrame([tuple(r) for r in _rows(fn(values[0] if single else values))], schema)


def _rows(answer) -> list:
    async def gathered():
        got = await answer if inspect.isawaitable(answer) else answer
        return [r async for r in got] if isinstance(got, AsyncIterable) else list(got)

    return asyncio.run(gathered()) if inspect.isawaitable(answer) or isinstance(answer, AsyncIterable) else list(answer)
