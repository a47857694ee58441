"""Workloads: instances of templates, an execution cache, validation against a reference, timing."""

from __future__ import annotations

import contextlib
import hashlib
import json
import statistics
import time
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession

from tidewright.operators import compare
from tidewright.operators.params import Template
from tidewright.plans import dialect
from tidewright.plans import text as T

#: Run modes: (instances per query, repetitions, whether results are compared).
MODES = {"fast_check": (1, 1, True), "exhaustive": (20, 1, True), "ingest": (0, 1, False), "benchmark": (1, 3, False)}


@dataclass(frozen=True)
class Entry:
    query_id: str
    sql: str
    values: tuple


def produce(templates: Mapping[str, Template], mode: str = "fast_check", query_ids: list[str] | None = None, seed: int = 42) -> list[Entry]:
    """Distinct instances of the chosen templates, the same for the same seed."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {sorted(MODES)}")
    chosen = [t for k, t in templates.items() if query_ids is None or k in query_ids]
    return [Entry(t.query_id, sql, tuple(sorted(values.items()))) for t in chosen for values, sql in t.instances(MODES[mode][0], seed)]


class ExecutionCache:
    """Exact results of (system, query, settings) as parquet files on the driver's disk."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.hits = self.misses = 0

    def key(self, system: str, sql: str, settings: Mapping[str, object]) -> str:
        return hashlib.sha256(json.dumps([system, sql, settings], sort_keys=True, default=str).encode()).hexdigest()[:24]

    def run(self, system: str, sql: str, settings: Mapping[str, object], execute: Callable[[str], pa.Table]) -> tuple[pa.Table, float]:
        """The result and the milliseconds that its one execution took."""
        at = self.folder / f"{self.key(system, sql, settings)}.parquet"
        if at.exists():
            self.hits += 1
            t = pq.read_table(at)
            return t.replace_schema_metadata(None), float((t.schema.metadata or {}).get(b"elapsed_ms", b"0"))
        self.misses += 1
        began = time.perf_counter()
        t = execute(sql)
        ms = 1000 * (time.perf_counter() - began)
        part = at.with_suffix(".partial")
        pq.write_table(t.replace_schema_metadata({"elapsed_ms": str(ms)}), part)
        part.replace(at)
        return t, ms


@dataclass
class Report:
    """What a validation found: differences by entry, and times on both sides."""

    differences: dict[str, list[str]] = field(default_factory=dict)
    times: dict[str, list[tuple[float, float]]] = field(default_factory=lambda: defaultdict(list))

    @property
    def ok(self) -> bool:
        return not self.differences

    def total_speedup(self) -> float:
        """Reference time over ours, both summed over the queries' mean times."""
        ours = sum(statistics.mean(a for a, _ in v) for v in self.times.values())
        return sum(statistics.mean(b for _, b in v) for v in self.times.values()) / ours if ours else float("nan")

    def average_speedup(self) -> float:
        return statistics.mean(statistics.mean(b for _, b in v) / statistics.mean(a for a, _ in v) for v in self.times.values()) if self.times else float("nan")


def validate(spark: SparkSession, entries: list[Entry], reference: Callable[[str], pa.Table], cache: ExecutionCache | None = None, tolerance: float = 1e-5) -> Report:
    """Run every entry here and on a reference; columns are aligned by name, order and ties are minded, limits may end in other ties."""
    report = Report()
    for e in entries:
        began = time.perf_counter()
        got = spark.sql(dialect.to_spark(e.sql)).toArrow()
        mine = 1000 * (time.perf_counter() - began)
        if cache:
            want, theirs = cache.run("reference", e.sql, {}, reference)
        else:
            began = time.perf_counter()
            want = reference(e.sql)
            theirs = 1000 * (time.perf_counter() - began)
        report.times[e.query_id].append((mine, theirs))
        ordered = T.has_order_by(e.sql)
        keys = T.order_keys(e.sql, want.column_names) if ordered else None
        diffs = compare.differences(got, want, ordered, keys, tolerance=tolerance)
        limit, offset = T.limit_offset(e.sql)
        if diffs and limit is not None:
            diffs = compare.differences(got, want, ordered, keys, candidates=reference(T.widened(e.sql, None)), tolerance=tolerance)
        if diffs:
            report.differences[e.sql] = diffs
    return report


def ladder(frames_at: Callable[[float], None], sizes: list[float], check: Callable[[], Report]) -> tuple[float | None, Report | None]:
    """Validate at each size, small ones first, and stop at the first that fails: (that size or None, last report)."""
    report = None
    for size in sorted(sizes):
        frames_at(size)
        report = check()
        if not report.ok:
            return size, report
    return None, report


def benchmark(systems: Mapping[str, Callable[[str], object]], entries: list[Entry], repetitions: int = 3) -> list[dict]:
    """Median milliseconds of each entry on each system."""
    out = []
    for name, run in systems.items():
        for e in entries:
            times = []
            for _ in range(repetitions):
                began = time.perf_counter()
                run(e.sql)
                times.append(1000 * (time.perf_counter() - began))
            out.append({"query_id": e.query_id, "system": name, "time_ms": round(statistics.median(times), 3)})
    return out


class Timers:
    """Named scope timers and counters."""

    def __init__(self):
        self.ms: dict[str, float] = defaultdict(float)
        self.counts: dict[str, int] = defaultdict(int)

    @contextlib.contextmanager
    def scope(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] += 1000 * (time.perf_counter() - began)
            self.counts[name] += 1


def in_or_null(column: Column, values: list) -> Column:
    """``column IN (values)`` where a None among the values means IS NULL, never ``IN (NULL)``."""
    known = [v for v in values if v is not None]
    test = column.isin(known) if known else None
    if None in values:
        return column.isNull() if test is None else test | column.isNull()
    if test is None:
        raise ValueError("an empty list")
    return test


def parametrize(sql: str) -> tuple[str, dict[str, object]]:
    """A template of one query: literals that a column is compared with become holes named after the column.

    ``c IN (...)`` becomes one list hole; ``c IN (...) OR c IS NULL`` is left to ``in_or_null``.
    """
    from tidewright.operators.params import placeholders

    tokens, out, last, values = T.tokenize(sql), [], 0, {}

    def hole(column: str) -> str:
        base = "".join(ch if ch.isalnum() else "_" for ch in column.upper())
        base = base if base[:1].isalpha() else f"P{base}"
        name, k = base, 1
        while name in values:
            k += 1
            name = f"{base}_{k}"
        return name

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.low == "in" and i >= 1 and i + 2 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 2].kind in ("string", "number"):
            end = next(j for j in range(i + 2, len(tokens)) if tokens[j].text == ")" and tokens[j].depth == tokens[i + 1].depth)
            column = tokens[i - 2].text if tokens[i - 1].low == "not" else tokens[i - 1].text
            name = hole(column)
            values[name] = tuple(u.value for u in T.units(tokens[i + 2 : end]) if u.kind == "literal")
            out += [sql[last : tokens[i + 1].start], f"[{name}]"]
            last, i = tokens[end].end, end + 1
            continue
        if t.kind in ("string", "number") and i >= 2 and (tokens[i - 1].text in ("=", "<", ">", "<=", ">=", "<>") or tokens[i - 1].low in ("like", "ilike", "between")) and tokens[i - 2].kind in ("word", "quoted"):
            name = hole(tokens[i - 2].text if tokens[i - 2].low != "not" else tokens[i - 3].text)
            unit = T.units([t])[0]
            values[name] = unit.value
            out += [sql[last : t.start], f"'[{name}]'" if t.kind == "string" else f"[{name}]"]
            last = t.end
        i += 1
    template = "".join(out) + sql[last:]
    assert set(placeholders(template)) >= set(values)
    return template, values


def plans(spark: SparkSession, texts: list[str]) -> dict[str, str]:
    """Formatted plans of a batch of queries."""
    return {q: spark.sql("EXPLAIN FORMATTED " + dialect.to_spark(q)).first()[0] for q in texts}


def materialised(df: DataFrame) -> DataFrame:
    """A frame kept in memory, filled now."""
    df = df.cache()
    df.count()
    return df
