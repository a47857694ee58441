"""Comparison of results: exact but for floating point, order-aware, tie-aware.

Small results are Arrow tables compared on the driver. Large ones are compared where they are, by
counts of equal rows.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def cells_equal(a: object, b: object, tolerance: float = TOLERANCE) -> bool:
    """Null equals only null; a float on either side is close; all else is equal in value and kind."""
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, float) or isinstance(b, float):
        try:
            x, y = float(a), float(b)
        except (TypeError, ValueError):
            return False
        return x == y or math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def rows_equal(a: tuple, b: tuple, tolerance: float = TOLERANCE) -> bool:
    return len(a) == len(b) and all(cells_equal(x, y, tolerance) for x, y in zip(a, b, strict=True))


def _float_columns(*tables: list[tuple]) -> set[int]:
    """Columns that hold a float in any row of any table."""
    return {i for rows in tables for r in rows for i, v in enumerate(r) if isinstance(v, float)}


def _split(row: tuple, floats: set[int]) -> tuple[tuple, tuple]:
    number = [i in floats and isinstance(v, int | float | Decimal) and not isinstance(v, bool) for i, v in enumerate(row)]
    exact = tuple(("f",) if n else (isinstance(v, bool), v) for n, v in zip(number, row, strict=True))
    return exact, tuple(float(v) for n, v in zip(number, row, strict=True) if n)


def _match(left: list[tuple], right: list[tuple], tolerance: float) -> int:
    """How many rows of left can be paired with close rows of right, each used once: a largest matching.

    Sorted rows mostly pair in order. Those that do not are matched by augmenting paths over the rows
    whose first number is near, whatever the size of the groups.
    """
    key = lambda r: tuple((math.isnan(v), 0.0 if math.isnan(v) else v) for v in r)
    left, right = sorted(left, key=key), sorted(right, key=key)
    paired = sum(rows_equal(a, b, tolerance) for a, b in zip(left, right, strict=False))
    if paired == min(len(left), len(right)) or not left[0]:
        return paired
    heads = [math.inf if math.isnan(r[0]) else r[0] for r in right]

    def near(i: int) -> list[int]:
        v = math.inf if math.isnan(left[i][0]) else left[i][0]
        room = 0.0 if math.isinf(v) else 2 * tolerance * max(1.0, abs(v))
        return [j for j in range(bisect.bisect_left(heads, v - room), bisect.bisect_right(heads, v + room)) if rows_equal(left[i], right[j], tolerance)]

    partner: dict[int, int] = {}  # of rows of right
    for i in range(len(left)):
        came, todo, seen, end = {}, [i], set(), None
        while todo and end is None:
            k = todo.pop()
            for j in near(k):
                if j not in seen:
                    seen.add(j)
                    came[j] = k
                    if j not in partner:
                        end = j
                        break
                    todo.append(partner[j])
        while end is not None:  # turn the path over
            k = came[end]
            before = next((j for j, x in partner.items() if x == k), None)
            partner[end] = k
            if k == i:
                break
            end = before
    return len(partner)


def _groups(rows: list[tuple], floats: set[int]) -> dict[tuple, list[tuple]]:
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for r in rows:
        exact, numbers = _split(r, floats)
        out[exact].append(numbers)
    return out


def multiset_equal(a: list[tuple], b: list[tuple], tolerance: float = TOLERANCE) -> bool:
    """Same rows as often: columns with a float on either side matched one to one as numbers, others by value."""
    if len(a) != len(b):
        return False
    floats = _float_columns(a, b)
    x, y = _groups(a, floats), _groups(b, floats)
    return x.keys() == y.keys() and all(len(v) == len(y[k]) and _match(v, y[k], tolerance) == len(v) for k, v in x.items())


def multiset_contains(whole: list[tuple], part: list[tuple], tolerance: float = TOLERANCE) -> bool:
    """Whether every row of part is in whole at least as often."""
    floats = _float_columns(whole, part)
    x, y = _groups(whole, floats), _groups(part, floats)
    return all(len(v) <= len(x.get(k, [])) and _match(v, x[k], tolerance) == len(v) for k, v in y.items())


def ordered_equal(a: list[tuple], b: list[tuple], keys: list[int] | None = None, tolerance: float = TOLERANCE) -> bool:
    """Row by row; with key columns, the sequence of keys row by row and the rows as a multiset."""
    if len(a) != len(b):
        return False
    if keys is None:
        return all(rows_equal(x, y, tolerance) for x, y in zip(a, b, strict=True))
    pick = lambda r: tuple(r[k] for k in keys)
    return all(rows_equal(pick(x), pick(y), tolerance) for x, y in zip(a, b, strict=True)) and multiset_equal(a, b, tolerance)


def align(names: list[str], other: list[str]) -> list[int] | None:
    """Positions of ``names`` in ``other``, equal names in their order; None if the name multisets differ (case aside)."""
    low, used = [n.lower() for n in other], set()
    if Counter(n.lower() for n in names) != Counter(low):
        return None
    out = []
    for n in names:
        i = next(i for i, m in enumerate(low) if m == n.lower() and i not in used)
        used.add(i)
        out.append(i)
    return out


def table_rows(t: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in t.columns), strict=True)) if t.num_columns else []


def differences(got: pa.Table, want: pa.Table, ordered: bool = False, keys: list[int] | None = None, candidates: pa.Table | None = None, limit: int = 8, tolerance: float = TOLERANCE) -> list[str]:
    """Why two results differ, in at most ``limit`` lines and a total; empty if they agree.

    candidates: for a limited query, all rows that may fill the limit (ties at its edge included); then
    the keys must agree and the rows be among them.
    """
    at = align(got.column_names, want.column_names)
    if at is None:
        return [f"columns {got.column_names} against {want.column_names}"]
    if got.num_rows != want.num_rows:
        return [f"{got.num_rows} rows against {want.num_rows}"]
    a, b = table_rows(got), [tuple(r[i] for i in at) for r in table_rows(want)]
    if candidates is not None:
        more = [tuple(r[i] for i in align(got.column_names, candidates.column_names)) for r in table_rows(candidates)]
        pick = lambda rows: [tuple(r[k] for k in keys or []) for r in rows]
        if (not ordered or ordered_equal(pick(a), pick(b), None, tolerance)) and multiset_contains(more, a, tolerance):
            return []
    elif ordered_equal(a, b, keys, tolerance) if ordered else multiset_equal(a, b, tolerance):
        return []
    out = []
    if ordered and keys is None:
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            out += [f"row {i}, {got.column_names[k]}: {p!r} against {q!r}" for k, (p, q) in enumerate(zip(x, y, strict=True)) if not cells_equal(p, q, tolerance)]
    else:
        left, right = Counter(map(repr, a)), Counter(map(repr, b))
        out = [f"only got: {r}" for r in (left - right)] + [f"only wanted: {r}" for r in (right - left)]
    return [*out[:limit], f"{len(out)} differences"]


def frames_differ(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows that one frame has more often than the other, with both counts; floats agree within the tolerance.

    Equal rows cancel in one aggregation over both sides, counted on the map side, so equal rows,
    however many, are shuffled once per task. What is left over and has floats is put in order on each
    side, per value of the other columns, and compared place by place.
    """
    at = align(a.columns, b.columns)
    if at is None:
        raise ValueError(f"columns {a.columns} against {b.columns}")
    names = [f"c{i}" for i in range(len(a.columns))]
    sides = []
    for df, order, side in ((a, range(len(a.columns)), "a"), (b, at, "b")):
        renamed = df.toDF(*[f"x{i}" for i in range(len(df.columns))])
        sides.append(renamed.select(*[F.col(f"x{i}").alias(n) for i, n in zip(order, names, strict=True)], F.lit(int(side == "a")).alias("na"), F.lit(int(side == "b")).alias("nb")))
    both = sides[0].unionAll(sides[1])
    out = both.groupBy(names).agg(F.sum("na").alias("in_a"), F.sum("nb").alias("in_b")).where("in_a <> in_b")
    floats = [n for n, k in both.dtypes if k in ("double", "float")]
    if floats:
        exact = [n for n in names if n not in floats]
        extra = out.withColumn("side", F.col("in_a") > F.col("in_b")).withColumn("unit", F.explode(F.sequence(F.lit(1), F.abs(F.col("in_a") - F.col("in_b")))))
        place = F.row_number().over(Window.partitionBy(*exact, "side").orderBy(*floats, "unit"))
        extra = extra.withColumn("place", place)
        left, right = extra.where("side").drop("unit"), extra.where("NOT side").drop("unit").toDF(*[f"{n}_" for n in extra.drop("unit").columns])
        same = F.lit(True)
        for n in [*exact, "place"]:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
        room = lambda x, y: F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        close = F.lit(True)
        for n in floats:
            x, y = F.col(n), F.col(f"{n}_")
            close = close & F.coalesce(x.eqNullSafe(y) | (F.abs(x - y) <= room(x, y)), F.lit(False))
        met = left.join(right, same, "full").where(~F.coalesce(close & F.col("in_a").isNotNull() & F.col("in_a_").isNotNull(), F.lit(False)))
        old = [*names, "in_a", "in_b"]
        rows = F.array(F.when(F.col("in_a").isNotNull(), F.struct(*old)), F.when(F.col("in_a_").isNotNull(), F.struct(*[F.col(f"{n}_").alias(n) for n in old])))
        out = met.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*").distinct()
    return out.toDF(*a.columns, "in_a", "in_b")


def frame_contains(whole: DataFrame, part: DataFrame) -> bool:
    return part.exceptAll(whole.select(part.columns)).isEmpty()


def closed_top(df: DataFrame, keys: list, limit: int) -> DataFrame:
    """All rows that may fill a limit: those ranked up to it, ties at the edge included. ``keys`` are sort columns."""
    edge = df.orderBy(*keys).limit(limit).withColumn("__n", F.monotonically_increasing_id())
    last = edge.orderBy(F.col("__n").desc()).limit(1).drop("__n")
    if last.isEmpty():
        return df.limit(0)
    ranked = df.withColumn("__rank", F.rank().over(Window.orderBy(*keys)))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")
