"""Subsets and enlargements of a set of tables that keep joins alive.

The join graph comes from the queries' equalities. The largest table is sampled by a hash of its keys;
the other tables keep the rows that join what their kept neighbours keep. Every step is a declarative
semi-join; nothing but counts and names reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.text import tokenize

MODULUS = 1000
SMALL = 10_000


@dataclass(frozen=True)
class Edge:
    """Tables joined by one or more column pairs (a composite key has several)."""

    left: str
    right: str
    pairs: tuple[tuple[str, str], ...]

    def turned(self, table: str) -> tuple[str, tuple[tuple[str, str], ...]]:
        """The other table and (own column, other column) pairs, seen from ``table``."""
        if table == self.left:
            return self.right, self.pairs
        return self.left, tuple((b, a) for a, b in self.pairs)


def introspect(spark: SparkSession, tables: Iterable[str]) -> dict[str, dict]:
    """Row counts and columns of registered tables."""
    return {t: {"rows": spark.table(t).count(), "columns": spark.table(t).columns} for t in tables}


def join_edges(queries: Iterable[str], columns: Mapping[str, list[str]], declared: Iterable[str] = ()) -> list[Edge]:
    """Edges that equalities of columns in the queries show, and declared ``table.column=table.column`` pairs.

    Aliases are resolved within a query; an unqualified column belongs to the one table that has it.
    Equalities between the same two tables in one query are one composite key. A table's equality with
    itself is refused as an edge.
    """
    low = {t.lower(): [c.lower() for c in cs] for t, cs in columns.items()}
    owner: dict[str, list[str]] = {}
    for t, cs in low.items():
        for c in cs:
            owner.setdefault(c, []).append(t)
    found: dict[tuple[str, str], set[tuple[tuple[str, str], ...]]] = {}

    def add(pairs: list[tuple[str, str, str, str]]) -> None:
        by: dict[tuple[str, str], set[tuple[str, str]]] = {}
        for ta, ca, tb, cb in pairs:
            if ta == tb:
                continue
            (ta, ca), (tb, cb) = sorted([(ta, ca), (tb, cb)])
            by.setdefault((ta, tb), set()).add((ca, cb))
        for k, v in by.items():
            found.setdefault(k, set()).add(tuple(sorted(v)))

    for q in queries:
        tokens = tokenize(q)
        alias = {t: t for t in low}
        for i, t in enumerate(tokens[:-1]):
            if t.low in low and tokens[i - 1].text != "." and i and (tokens[i - 1].low in ("from", "join") or tokens[i - 1].text == ","):
                k = i + 1 + (tokens[i + 1].low == "as")
                if k < len(tokens) and tokens[k].kind == "word" and tokens[k].low not in ("where", "on", "join", "inner", "left", "right", "full", "cross", "group", "order", "using", "limit"):
                    alias[tokens[k].low] = t.low

        def column(i: int, step: int) -> tuple[str, str] | None:
            """The column that ends (step -1) or starts (step 1) at token i."""
            a = i - 2 if step < 0 and i >= 2 and tokens[i - 1].text == "." else i
            if step > 0 and i + 2 < len(tokens) and tokens[i + 1].text == ".":
                table, name = alias.get(tokens[i].low), tokens[i + 2].low
            elif step < 0 and a != i:
                table, name = alias.get(tokens[a].low), tokens[i].low
            else:
                name = tokens[i].low
                table = owner[name][0] if len(owner.get(name, [])) == 1 else None
            return (table, name) if table and name in low.get(table, []) else None

        pairs = []
        for i, t in enumerate(tokens):
            if t.text == "=" and 0 < i < len(tokens) - 1 and tokens[i - 1].kind in ("word", "quoted") and tokens[i + 1].kind in ("word", "quoted"):
                a, b = column(i - 1, -1), column(i + 1, 1)
                if a and b:
                    pairs.append((*a, *b))
        add(pairs)
    for d in declared:
        a, b = (x.strip().lower().split(".") for x in d.split("="))
        if a[0] == b[0]:
            raise ValueError(f"{d}: a table cannot be its own parent")
        add([(a[0], a[1], b[0], b[1])])
    return [Edge(a, b, p) for (a, b), many in sorted(found.items()) for p in sorted(many)]


@dataclass
class Plan:
    """What a subset does with each table, in order."""

    anchor: str
    order: list[str]
    whole: set[str]
    fraction: float
    edges: list[Edge] = field(default_factory=list)


def plan_subset(info: Mapping[str, dict], edges: list[Edge], fraction: float, small: int = SMALL) -> Plan:
    """Anchor: the largest table, ties by name. Small tables and tables that join nothing stay whole."""
    if not 0 < fraction <= 1 or round(fraction * MODULUS) < 1:
        raise ValueError(f"fraction {fraction} is not in [{1 / MODULUS}, 1]")
    if any(e.left == e.right for e in edges):
        raise ValueError("a table cannot be its own parent")
    anchor = min(info, key=lambda t: (-info[t]["rows"], t))
    depth, queue = {anchor: 0}, [anchor]
    for t in queue:
        for e in edges:
            if t in (e.left, e.right):
                other = e.turned(t)[0]
                if other not in depth:
                    depth[other] = depth[t] + 1
                    queue.append(other)
    whole = {t for t in info if t != anchor and (t not in depth or info[t]["rows"] <= small)}
    return Plan(anchor, sorted(info, key=lambda t: (depth.get(t, len(info)), t)), whole, fraction, edges)


def bucket(columns: Iterable[str]):
    """0 to 999 from the md5 of the columns' texts, so that other engines can draw the same sample."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % MODULUS


def subset(frames: Mapping[str, DataFrame], plan: Plan, keys: Mapping[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The kept rows of every table.

    The anchor keeps rows whose keys hash below the cut: its declared keys, else its join columns, else
    all columns. Another table keeps a row if it joins a kept row of any kept neighbour that is not kept
    whole: equal in all columns of a composite key, and by any one of several relationships.
    """
    out: dict[str, DataFrame] = {}
    for t in plan.order:
        df = frames[t]
        if t in plan.whole or plan.fraction == 1:
            out[t] = df
            continue
        if t == plan.anchor:
            by = (keys or {}).get(t) or sorted({c for e in plan.edges if t in (e.left, e.right) for c, _ in e.turned(t)[1]}) or df.columns
            out[t] = df.where(bucket(by) < round(plan.fraction * MODULUS))
            continue
        near = [e.turned(t) for e in plan.edges if t in (e.left, e.right)]
        near = [(o, pairs) for o, pairs in near if o in out and o not in plan.whole]
        if not near:
            out[t] = df
            continue
        flagged = df
        for i, (o, pairs) in enumerate(near):  # one left join by distinct keys for each relationship, then OR
            kept = out[o].select(*[F.col(b).alias(f"__k{i}_{j}") for j, (_, b) in enumerate(pairs)]).distinct().withColumn(f"__hit{i}", F.lit(True))
            on = [F.col(a) == F.col(f"__k{i}_{j}") for j, (a, _) in enumerate(pairs)]
            if len(near) == 1:
                flagged = flagged.join(kept, on, "left_semi")
            else:
                flagged = flagged.join(kept, on, "left")
        if len(near) > 1:
            flagged = flagged.where(" OR ".join(f"__hit{i}" for i in range(len(near)))).select(df.columns)
        out[t] = flagged
    return out


def kept_shares(frames: Mapping[str, DataFrame], kept: Mapping[str, int]) -> dict[str, tuple[int, int, float]]:
    """(kept rows, all rows, percentage) of each table, as a log of a subset would state them."""
    out = {}
    for t, n in kept.items():
        rows = frames[t].count()
        out[t] = (n, rows, round(100 * n / rows, 2) if rows else 100.0)
    return out


def write_subset(frames: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Write the tables as parquet folders; returns the kept rows of each."""
    spark = next(iter(frames.values())).sparkSession
    for t, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in frames}


def write_atomic(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Write to ``<folder>.partial`` and rename, so that a reader never sees half a subset; the old one goes last. Local and HDFS-like stores."""
    spark = next(iter(frames.values())).sparkSession
    write_subset(frames, f"{folder}.partial")
    jvm = spark.sparkContext._jvm
    src, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}.partial", folder))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{folder}.old")
    fs.delete(old, True)
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"cannot set {folder} aside")
    if not fs.rename(src, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"cannot rename to {folder}")
    fs.delete(old, True)


def snapshot(frames: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Copy tables as they are now; later reads use the copy."""
    write_atomic(frames, folder)
    spark = next(iter(frames.values())).sparkSession
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in frames}


def dangling(frames: Mapping[str, DataFrame], edge: Edge) -> int:
    """Rows of the edge's left table whose key is in no row of its right table."""
    a, b = frames[edge.left], frames[edge.right].select(*[F.col(y).alias(f"__{y}") for _, y in edge.pairs])
    return a.join(b, [F.col(x) == F.col(f"__{y}") for x, y in edge.pairs], "left_anti").count()


def scale_up(frames: Mapping[str, DataFrame], factor: int, key_columns: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """``factor`` copies of every row; key columns of copy i move by i times an offset above all their values.

    String keys get a suffix. One offset serves all tables, so foreign keys go on fitting. Tables
    without key columns stay as they are.
    """
    import functools

    tops = []
    for t, cols in key_columns.items():
        numeric = [c for c in cols if dict(frames[t].dtypes)[c] in ("int", "bigint", "smallint", "tinyint")]
        if numeric:
            tops += [v or 0 for v in frames[t].agg(*[F.max(c) for c in numeric]).first()]
    offset = max(tops, default=0) + 1
    out = {}
    for t, df in frames.items():
        cols = key_columns.get(t, [])
        if not cols:
            out[t] = df
            continue
        many = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
        kinds = dict(df.dtypes)
        out[t] = functools.reduce(lambda d, c: d.withColumn(c, F.when(F.col("__copy") == 0, F.col(c)).otherwise(F.concat(F.col(c), F.lit("_"), F.col("__copy"))) if kinds[c] == "string" else F.col(c).cast("long") + F.col("__copy").cast("long") * offset), cols, many).drop("__copy")
    return out


def sample_down(frames: Mapping[str, DataFrame], fraction: float, small: int = SMALL, seed: int = 42) -> dict[str, DataFrame]:
    """Independent samples of the large tables; foreign keys may dangle."""
    return {t: df if df.count() <= small else df.sample(fraction, seed) for t, df in frames.items()}


def subset_folder(root: str, size: float | int, kind: str = "fraction") -> str:
    """``<root>/fraction0.02`` or ``<root>/sf1``."""
    return f"{root}/{kind}{size:g}"


def complete_subsets(root: str, tables: Iterable[str]) -> list[str]:
    """Folders under a local root that hold all tables, smallest first."""
    need, found = set(tables), []
    for p in Path(root).iterdir() if Path(root).is_dir() else []:
        size = p.name.removeprefix("fraction").removeprefix("sf")
        if p.is_dir() and size != p.name and need <= {f.name.removesuffix(".parquet") for f in p.iterdir()}:
            found.append((float(size), str(p)))
    return [p for _, p in sorted(found)]


def ladder(sizes: Iterable[float]) -> list[float]:
    """Sizes to validate at, the target last."""
    return sorted(set(sizes))


def fingerprint(spark: SparkSession, tables: Iterable[str]) -> str:
    """16 hex digits of the tables' names and column types; a missing table counts as such."""
    parts = []
    for t in sorted(x.lower() for x in tables):
        if spark.catalog.tableExists(t):
            parts.append(t + "(" + ",".join(f"{c.lower()}:{k}" for c, k in spark.table(t).dtypes) + ")")
        else:
            parts.append(f"{t}<missing>")
    return hashlib.sha256(";".join(parts).encode()).hexdigest()[:16]


def is_stale(folder: str, version: str) -> bool:
    """Whether a local subset was made from another version; ``mark`` writes the version."""
    f = Path(folder) / "version.json"
    return not f.exists() or json.loads(f.read_text()).get("version") != version


def mark(folder: str, version: str) -> None:
    Path(folder, "version.json").write_text(json.dumps({"version": version}))


def fits_memory(folder: str, available: int, factor: float = 3.0) -> bool:
    """Whether a local folder's files times ``factor`` fit in ``available`` bytes."""
    return factor * sum(f.stat().st_size for f in Path(folder).rglob("*.parquet")) <= available


def remove_subset(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
