"""Template router: recognise a registered query shape, bind its values, serve it from a prepared plan.

A template is SQL with ``[NAME]`` holes and a plan builder ``fn(spark, values) -> DataFrame``. A query
that matches a template and passes every guard is served by the builder; a sample is compared with the
query's own answer. Any doubt - no match, a failing guard, an error, a difference - serves the plain
answer, and repeated failures put the template aside.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import random
import re
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewright.operators import compare
from tidewright.operators.params import literal, substitute
from tidewright.operators.subset import fingerprint
from tidewright.plans import dialect
from tidewright.plans import text as T

MODES = ("off", "sampled", "prepared_only")
#: Output types that a template may not have: their values would not survive exactly.
REFUSED = ("array", "map", "struct", "binary", "interval", "variant", "timestamp_ltz")
PREFIX = "TIDEWRIGHT_"


class RouterError(Exception):
    """Base of the router's errors."""


class UnsupportedError(RouterError):
    """The template or query cannot be served exactly."""


class ExecutionError(RouterError):
    """A plan builder failed."""


class DivergedError(RouterError):
    """A prepared answer differs from the plain one."""


class ResourceError(RouterError):
    """An answer is larger than the policy allows."""


@dataclass(frozen=True)
class Policy:
    mode: str = "sampled"
    enabled: bool = True
    block_writes: bool = True
    cross_check_rate: float = 0.1
    verify_first_n: int = 10
    breaker_threshold: int = 3
    max_result_bytes: int = 512 << 20
    allow: frozenset | None = None
    deny: frozenset = frozenset()
    verbose: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    @property
    def active(self) -> bool:
        return self.enabled and self.mode != "off"

    @classmethod
    def from_env(cls, **changes) -> Policy:
        """Defaults, then TIDEWRIGHT_ROUTER, _VERBOSE, _CROSS_CHECK, _VERIFY_FIRST_N, _BLOCK_WRITES, then ``changes``; unreadable values are passed over."""
        out: dict = {}
        flag = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        router = os.getenv(PREFIX + "ROUTER", "").strip().lower()
        if router in MODES:
            out |= {"mode": router, "enabled": router != "off"}
        elif router in flag:
            out |= {"enabled": flag[router]}
        for name, key in (("VERBOSE", "verbose"), ("BLOCK_WRITES", "block_writes")):
            raw = os.getenv(PREFIX + name, "").strip().lower()
            if raw in flag:
                out[key] = flag[raw]
        for name, key, kind in (("CROSS_CHECK", "cross_check_rate", float), ("VERIFY_FIRST_N", "verify_first_n", int)):
            try:
                out[key] = kind(os.environ[PREFIX + name])
            except (KeyError, ValueError):
                pass
        return cls(**(out | changes))


Builder = Callable[[SparkSession, Mapping[str, object]], DataFrame]


@dataclass
class Template:
    template_id: str
    sql: str
    builder: Builder | None = None
    tables: tuple[str, ...] = ()
    version: str = ""
    output: tuple[tuple[str, str], ...] = ()
    key: str = ""
    ready: bool = True

    def build(self, spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
        return self.builder(spark, values) if self.builder else spark.sql(dialect.to_spark(substitute(self.sql, values)))


def describe(spark: SparkSession, sql: str) -> tuple[tuple[str, str], ...]:
    """Output names and types of a template, by analysis alone: holes become typed nulls or, inside strings, nothing."""
    text, inside, last = [], False, 0
    for m in re.finditer(r"'|\[([A-Z][A-Z0-9_]*)\]", sql):
        text.append(sql[last : m.start()])
        if m.group() == "'":
            inside = not inside
            text.append("'")
        else:
            before = "".join(text).rstrip().lower()
            text.append("1995-01-01" if inside and before.endswith("date '") else "1" if inside else "(NULL)" if before.endswith(" in") else "1" if before.endswith(("limit", "offset")) else "NULL")
        last = m.end()
    schema = spark.sql(dialect.to_spark("".join(text) + sql[last:])).schema
    return tuple((f.name, f.dataType.simpleString()) for f in schema)


def make_template(spark: SparkSession, template_id: str, sql: str, builder: Builder | None = None) -> Template:
    """A template bound to the tables as they are now; refuses what is no SELECT or has refused output types."""
    if not T.is_select(sql):
        raise UnsupportedError("only SELECT statements can be templates")
    output = describe(spark, sql)
    bad = [f"{n} {t}" for n, t in output if t.startswith(REFUSED) or t == "timestamp"]
    if bad:
        raise UnsupportedError(f"output types are not exact: {', '.join(bad)}")
    tables = tuple(T.tables_in(sql))
    key = T.normalize(sql)
    if key is None:
        raise UnsupportedError("the template cannot be read")
    return Template(template_id, sql, builder, tables, fingerprint(spark, tables), output, key)


class Registry:
    """Templates by structural key, tables that changed, templates put aside. All under one lock."""

    def __init__(self):
        self._lock, self._by_key, self._dirty, self._aside = threading.RLock(), {}, set(), {}

    def __len__(self) -> int:
        return sum(map(len, self._by_key.values()))

    def register(self, t: Template) -> None:
        with self._lock:
            self.unregister(t.template_id)
            self._by_key.setdefault(t.key, []).append(t)
            self._aside.pop(t.template_id, None)

    def unregister(self, template_id: str) -> None:
        with self._lock:
            for key in list(self._by_key):
                self._by_key[key] = [t for t in self._by_key[key] if t.template_id != template_id]
                if not self._by_key[key]:
                    del self._by_key[key]

    def match(self, key: str) -> list[Template]:
        with self._lock:
            return [t for t in self._by_key.get(key, []) if t.template_id not in self._aside]

    def blocked(self, key: str) -> list[tuple[Template, str]]:
        with self._lock:
            return [(t, self._aside[t.template_id]) for t in self._by_key.get(key, []) if t.template_id in self._aside]

    def templates(self) -> list[Template]:
        with self._lock:
            return [t for ts in self._by_key.values() for t in ts]

    def mark_dirty(self, tables) -> None:
        with self._lock:
            self._dirty |= {t.lower() for t in tables}

    def clean(self) -> None:
        with self._lock:
            self._dirty.clear()

    def dirty(self, tables) -> set[str]:
        with self._lock:
            return self._dirty & {t.lower() for t in tables}

    def quarantine(self, template_id: str, reason: str) -> None:
        with self._lock:
            self._aside[template_id] = reason


@dataclass
class Trace:
    sql: str
    outcome: str = ""
    reason: str = ""
    template_id: str | None = None
    guards: list[tuple[str, bool, str]] = field(default_factory=list)
    values: dict | None = None
    prepared_ms: float | None = None
    plain_ms: float | None = None
    checked: bool = False
    equal: bool | None = None


def guards(spark: SparkSession, registry: Registry, t: Template, sql: str, parameters) -> list[tuple[str, bool, str]]:
    """Name, verdict and detail of each guard, up to the first that fails; an exception is a failure."""

    def arity() -> tuple[bool, str]:
        if isinstance(parameters, Mapping):
            return False, "named parameters are not routed"
        asked = sum(x.text == "?" for x in T.tokenize(sql))
        return len(parameters or ()) == asked, f"{len(parameters or ())} parameters for {asked} places"

    checks = (
        ("ready", lambda: (t.ready, "" if t.ready else "not ready")),
        ("select only", lambda: (T.is_select(sql), "")),
        ("tables unchanged", lambda: (not (d := registry.dirty(t.tables)), f"changed: {sorted(d)}" if d else "")),
        ("schema", lambda: (fingerprint(spark, t.tables) == t.version, "the tables' columns differ")),
        ("parameters", arity),
    )
    out = []
    for name, check in checks:
        try:
            ok, detail = check()
        except Exception as e:
            ok, detail = False, f"{type(e).__name__}: {e}"
        out.append((name, ok, "" if ok else detail or name))
        if not ok:
            break
    return out


class Router:
    def __init__(self, spark: SparkSession, policy: Policy | None = None, registry: Registry | None = None, seed: int | None = None):
        self.spark, self.policy, self.registry = spark, policy or Policy(), registry or Registry()
        self.counters = dict.fromkeys(("routed", "fell_back", "cross_checked", "mismatch", "error", "blocked_writes"), 0)
        self.reasons: dict[str, int] = {}
        self.traces: list[Trace] = []
        self._runs: dict[str, int] = {}
        self._failures: dict[str, int] = {}
        self._random = random.Random(seed)

    def plain(self, sql: str, parameters=None) -> DataFrame:
        text = dialect.to_spark(sql)
        return self.spark.sql(text, args=parameters) if parameters else self.spark.sql(text)

    def _finish(self, trace: Trace, outcome: str, reason: str = "") -> None:
        trace.outcome, trace.reason = outcome, reason
        if outcome == "fell back":
            self.counters["fell_back"] += 1
            self.reasons[reason] = self.reasons.get(reason, 0) + 1
        elif outcome == "routed":
            self.counters["routed"] += 1
        self.traces = [*self.traces[-999:], trace]
        if self.policy.verbose:
            print(f"[{outcome}] {trace.template_id or ''} {reason}")

    def _bound(self, t: Template, sql: str, parameters) -> dict | None:
        if parameters:
            it = iter(parameters)
            tokens = T.tokenize(sql)
            out, last = [], 0
            for x in tokens:
                if x.text == "?":
                    out += [sql[last : x.start], literal(next(it))]
                    last = x.end
            sql = "".join(out) + sql[last:]
        return T.bind(t.sql, sql)

    def _candidate(self, sql: str, parameters) -> tuple[Template | None, dict | None, list, str]:
        key = T.normalize(sql)
        if key is None:
            return None, None, [], "unreadable SQL"
        matched = [t for t in self.registry.match(key) if t.template_id not in self.policy.deny and (self.policy.allow is None or t.template_id in self.policy.allow)]
        if not matched:
            return None, None, [], "put aside: " + self.registry.blocked(key)[0][1] if self.registry.blocked(key) else "no template matches"
        results, reason = [], ""
        for t in matched:
            results = guards(self.spark, self.registry, t, sql, parameters)
            if not results[-1][1]:
                reason = results[-1][2]
                continue
            values = self._bound(t, sql, parameters)
            if values is not None:
                return t, values, results, ""
            reason = "a constant or the structure differs"
        return matched[0], None, results, reason

    def _should_check(self, template_id: str) -> bool:
        p = self.policy
        if p.mode == "prepared_only" or p.cross_check_rate <= 0:
            return False
        return self._runs.get(template_id, 0) <= p.verify_first_n or self._random.random() < p.cross_check_rate

    def _fail(self, t: Template, why: str) -> None:
        n = self._failures[t.template_id] = self._failures.get(t.template_id, 0) + 1
        if n >= self.policy.breaker_threshold:
            self.registry.quarantine(t.template_id, f"{n} failures in a row, the last: {why}")

    def route(self, sql: str, parameters=None) -> tuple[pa.Table | None, Trace]:
        """The prepared answer, or None where the caller is to run the query itself."""
        trace = Trace(sql)
        if not self.policy.active:
            self._finish(trace, "fell back", "router off")
            return None, trace
        if not len(self.registry):
            self._finish(trace, "fell back", "no templates")
            return None, trace
        t, values, trace.guards, reason = self._candidate(sql, parameters)
        trace.template_id, trace.values = t.template_id if t else None, values
        if values is None:
            if self.policy.mode == "prepared_only":
                raise UnsupportedError(reason)
            self._finish(trace, "fell back", reason)
            return None, trace
        try:
            began = time.perf_counter()
            got = t.build(self.spark, values).toArrow()
            trace.prepared_ms = 1000 * (time.perf_counter() - began)
            if got.nbytes > self.policy.max_result_bytes:
                raise ResourceError(f"{got.nbytes} bytes")
        except Exception as e:
            self.counters["error"] += 1
            self._fail(t, f"{type(e).__name__}: {e}"[:200])
            if self.policy.mode == "prepared_only":
                raise ExecutionError(str(e)) from e
            self._finish(trace, "fell back", f"error: {type(e).__name__}")
            return None, trace
        self._runs[t.template_id] = self._runs.get(t.template_id, 0) + 1
        if self._should_check(t.template_id):
            try:
                began = time.perf_counter()
                want = self.plain(sql, parameters).toArrow()
                trace.plain_ms = 1000 * (time.perf_counter() - began)
            except Exception:
                self._finish(trace, "fell back", "the plain query fails")
                return None, trace
            trace.checked = True
            self.counters["cross_checked"] += 1
            try:
                diffs = self._differences(sql, got, want, parameters)
            except Exception as e:
                diffs = [f"cannot compare: {e}"]
            trace.equal = not diffs
            if diffs:
                self.counters["mismatch"] += 1
                self.registry.quarantine(t.template_id, f"differs: {diffs[0]}")
                self._finish(trace, "diverged", diffs[0])
                return want, trace
        self._failures.pop(t.template_id, None)
        self._finish(trace, "routed")
        return got, trace

    def _differences(self, sql: str, got: pa.Table, want: pa.Table, parameters) -> list[str]:
        ordered = T.has_order_by(sql)
        keys = T.order_keys(sql, want.column_names) if ordered else None
        diffs = compare.differences(got, want, ordered, keys)
        limit, offset = T.limit_offset(sql)
        if diffs and limit is not None and not parameters and (keys or not ordered):
            n = limit + offset
            while True:  # ties at the edge of the limit: widen until the last tie is whole, at the latest at the last row
                n *= 2
                more = self.plain(T.widened(sql, n)).toArrow()
                if more.num_rows < n or keys and [more.column(k)[n - 1] for k in keys] != [want.column(k)[want.num_rows - 1] for k in keys]:
                    return compare.differences(got, want, ordered, keys, candidates=more)
        return diffs

    def why(self, sql: str, parameters=None) -> str:
        """What would happen to a query, without running it."""
        if not T.is_read_only(sql) and self.policy.block_writes:
            return "blocked: only read-only statements are allowed"
        if not self.policy.active:
            return "would fall back: router off"
        t, values, results, reason = self._candidate(sql, parameters)
        if values is None:
            return f"would fall back: {reason}"
        lines = [f"would route to {t.template_id} with {values}", *(f"  {'ok  ' if ok else 'FAIL'} {n} {d}".rstrip() for n, ok, d in results)]
        plan = t.build(self.spark, values)._jdf.queryExecution().simpleString()
        return "\n".join([*lines, plan])


# manifests -------------------------------------------------------------------------------------

#: Manifest versions that can be read; templates of version 1 have no output types.
VERSION = 2


def manifest(templates: list[Template]) -> dict:
    body = [{"id": t.template_id, "sql": t.sql, "tables": list(t.tables), "version": t.version, "output": [list(o) for o in t.output]} for t in sorted(templates, key=lambda t: t.template_id)]
    digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]
    return {"manifest": VERSION, "engine": digest, "templates": body}


def publish(folder: str | Path, templates: list[Template], receipts: Mapping[str, int]) -> Path:
    """Write a manifest under its content's name, in one step and under a lock; older ones go.

    Every template needs a receipt: the number of instances that ``validate`` found equal.
    """
    bad = [t.template_id for t in templates if receipts.get(t.template_id, 0) < 1]
    if bad:
        raise UnsupportedError(f"not validated: {bad}")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    m = manifest(templates)
    to = folder / f"{m['engine']}.json"
    with (folder / ".lock").open("w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        part = folder / f".{m['engine']}.{os.getpid()}.partial"
        part.write_text(json.dumps(m, indent=1))
        part.replace(to)
        for old in folder.glob("*.json"):
            if old != to:
                old.unlink()
    return to


def validate(spark: SparkSession, t: Template, samples: list[Mapping[str, object]]) -> int:
    """How many sample instances bind back to their values and get equal prepared and plain answers; 0 if any does not."""
    for values in samples:
        sql = substitute(t.sql, values)
        bound = T.bind(t.sql, sql)
        if bound is None or {k: str(v) for k, v in bound.items()} != {k: str(v) for k, v in values.items()}:
            return 0
        if compare.differences(t.build(spark, bound).toArrow(), spark.sql(dialect.to_spark(sql)).toArrow()):
            return 0
    return len(samples)


class Discovery:
    """Registers the manifests of a folder, looking at most once a second; what can never fit is remembered."""

    def __init__(self, spark: SparkSession, registry: Registry, folder: str | Path, builders: Mapping[str, Builder] | None = None, every: float = 1.0):
        self.spark, self.registry, self.folder, self.builders, self.every = spark, registry, Path(folder), builders or {}, every
        self._seen, self._refused, self._last = set(), {}, float("-inf")

    def poll(self, force: bool = False) -> int:
        """New templates registered now."""
        if not force and time.monotonic() - self._last < self.every:
            return 0
        self._last, n = time.monotonic(), 0
        for f in sorted(self.folder.glob("*.json")) if self.folder.is_dir() else []:
            if f.name.startswith(".") or f.name in self._seen or f.name in self._refused:
                continue
            try:
                m = json.loads(f.read_text())
            except (OSError, ValueError):
                continue  # being written; tried again
            if not 1 <= m.get("manifest", 0) <= VERSION:
                self._refused[f.name] = f"manifest version {m.get('manifest')}"
                continue
            waiting = False
            for x in m["templates"]:
                if fingerprint(self.spark, x["tables"]) != x["version"]:
                    waiting = True  # its tables may come
                    continue
                try:
                    self.registry.register(make_template(self.spark, x["id"], x["sql"], self.builders.get(x["id"])))
                    n += 1
                except Exception as e:
                    self._refused[x["id"]] = str(e)
            if not waiting:
                self._seen.add(f.name)
        return n
