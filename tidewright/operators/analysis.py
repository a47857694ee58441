"""Mining repeated query shapes from a log, and guarded inspection of data."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans import text as T


CLAUSES = ("with", "select", "from", "where", "group", "having", "qualify", "order", "limit", "offset")
SETS = ("union", "intersect", "except")
JOINS = (",", "join", "inner", "left", "right", "full", "outer", "cross", "natural")
FLIPPED = {"=": "=", "<>": "<>", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _tree(words: list[str]) -> list:
    """Words with what stands in parentheses as lists of their own."""
    stack: list[list] = [[]]
    for w in words:
        if w == "(":
            stack.append([])
        elif w == ")":
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(w)
    return stack[0]


def _flat(node: list | str) -> str:
    return node if isinstance(node, str) else " ".join(f"( {_flat(x)} )" if isinstance(x, list) else x for x in node)


def _split(node: list, at: tuple[str, ...]) -> tuple[list[list], list[str]]:
    """The parts of a node between words, and those words; the AND of a BETWEEN is none."""
    parts, words, between = [[]], [], False
    for x in node:
        if isinstance(x, str) and x in at and not (x == "and" and between):
            words.append(x)
            parts.append([])
        else:
            parts[-1].append(x)
        between = x == "between" or between and x != "and"
    return parts, words


def _renamed(node: list, names: dict[str, str]) -> list:
    out = []
    for i, x in enumerate(node):
        if isinstance(x, list):
            out.append(_renamed(x, names))
        else:
            out.append(names.get(x, x) if i + 1 < len(node) and node[i + 1] == "." else x)
    return out


def _expression(node: list) -> list:
    """Operands of + and of * in one order, in each run of one of them; what is in parentheses first."""
    node = [_query(x) if isinstance(x, list) else x for x in node]
    words = [x for x in node if isinstance(x, str)]
    if any(x in ("and", "or", "not", "in", "like", ",", "between", "case", "-", "||", *FLIPPED) for x in words):
        return node
    for op in ("+", "*"):
        if op in words and not (op == "*" and ("/" in words or "%" in words)):
            parts = [_expression(p) for p in _split(node, (op,))[0]]
            if all(parts):
                return [y for i, p in enumerate(sorted(parts, key=_flat)) for y in ([op] if i else []) + p]
    return node


def _condition(node: list) -> list[str]:
    """The AND terms of a condition, each in one form: sides of comparisons in order, OR terms sorted."""
    terms = []
    for part in _split(node, ("and",))[0] if len(_split(node, ("or",))[0]) == 1 else [node]:
        if len(part) == 1 and isinstance(part[0], list) and not any(x in CLAUSES for x in part[0] if isinstance(x, str)):
            inner = _split(part[0], ("or",))[0]
            if len(inner) == 1:
                terms += _condition(part[0])
                continue
            part = part[0]
        ors = _split(part, ("or",))[0]
        if len(ors) > 1:
            terms.append("( " + " or ".join(sorted(" and ".join(_condition(o)) for o in ors)) + " )")
            continue
        sides, ops = _split(part, tuple(FLIPPED))
        if len(ops) == 1 and "not" not in part and "case" not in part:
            left, right = (_flat(_expression(x)) for x in sides)
            terms.append(f"{left} {ops[0]} {right}" if left <= right else f"{right} {FLIPPED[ops[0]]} {left}")
        else:
            terms.append(_flat(_expression(part)))
    return sorted(terms)


def _query(node: list) -> list:
    """A query with its tables in place of aliases, inner joins and their conditions sorted; other nodes are expressions."""
    if "select" not in [x for x in node if isinstance(x, str)]:
        if "case" in node:
            return _expression(node)
        if any(x in ("and", "or") for x in node if isinstance(x, str)):
            return [" and ".join(_condition(node))]
        parts, commas = _split(node, (",",))
        return [y for i, p in enumerate(parts) for y in ([","] if i else []) + _expression(p)] if commas else _expression(node)
    if any(x in SETS for x in node if isinstance(x, str)):
        parts, words = _split(node, SETS)
        return [y for i, p in enumerate(parts) for y in ([words[i - 1]] if i else []) + (["all", *_query(p[1:])] if p[:1] == ["all"] else _query(p))]
    clauses: dict[str, list] = {}
    at = ""
    for x in node:
        if isinstance(x, str) and x in CLAUSES and x not in clauses:
            at = x
            clauses[at] = []
        else:
            clauses.setdefault(at, []).append(x)
    names, tables, extra, plain, kinds = {}, [], [], True, {}
    items, words = _split(clauses.get("from", []), JOINS)
    for item in (i for i in items if i):
        head, *on = _split(item, ("on",))[0]
        table = head[: next((k for k in range(1, len(head)) if isinstance(head[k], str) and head[k] != "." and head[k - 1] != "."), len(head))]
        alias = [x for x in head[len(table) :] if x != "as"]
        name = _flat([_query(x) if isinstance(x, list) else x for x in table]) if any(isinstance(x, list) for x in table) else _flat(table)
        kinds[name] = kinds.get(name, 0) + 1
        name = name if kinds[name] == 1 else f"{name} #{kinds[name]}"
        plain = plain and len(alias) <= 1 and isinstance(table[0], str)
        if len(alias) == 1 and isinstance(alias[0], str):
            names[alias[0]] = name
        tables.append(name)
        extra += on
    plain = plain and set(words) <= {",", "join", "inner"}
    if not plain:  # outer joins and derived tables stay where they are
        names = {k: v for k, v in names.items() if "(" not in v}
    out = []
    for c in clauses:
        body = _renamed(clauses[c], names)
        if c == "select":
            listed = []
            for part in _split(body, (",",))[0]:
                cut = part.index("as") if "as" in [x for x in part if isinstance(x, str)] else len(part)
                listed.append(_flat(_expression(part[:cut])))
            body = [" , ".join(listed)]
        elif c == "from" and plain:
            body = [" , ".join(sorted(tables))]
            if "where" not in clauses and extra:
                body += ["where", " and ".join(sorted(t for o in extra for t in _condition(_renamed(o, names))))]
        elif c == "where":
            body = [" and ".join(sorted([*_condition(body), *(t for o in extra for t in _condition(_renamed(o, names)) if plain)]))]
        elif c == "having":
            body = [" and ".join(_condition(body))]
        else:
            body = [_query(x) if isinstance(x, list) else x for x in body]
        out += [c, *body] if c else body
    return out


def structure(sql: str) -> str | None:
    """A query's shape: placeholders for literals, tables in place of aliases, no output names, and one order for the sides of
    comparisons, the operands of + and *, AND and OR terms, and inner joins, whose conditions count as conditions of the query."""
    key = T.normalize(sql)
    return None if key is None else _flat(_query(_tree(key.split())))


def _values(sql: str) -> str:
    try:
        return repr(T.literals(sql))
    except ValueError:
        return sql


def repeated(log: DataFrame, sql_col: str = "sql", least: int = 2) -> DataFrame:
    """Shapes that a log (``sql`` text or an array of a transaction's statements) repeats with different texts or values.

    (structure, runs, distinct_queries, distinct_values, score, example); score = runs times the larger
    of the distinct counts, at least 1. Equal texts are counted first, so Python sees each text once.
    """
    kind = dict(log.dtypes)[sql_col]
    one = F.col(sql_col) if kind == "string" else F.concat_ws(" ; ", F.col(sql_col))
    texts = log.select(one.alias("q")).where("q IS NOT NULL").groupBy("q").agg(F.count("*").alias("run_count"))

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = b["q"].map(T.statements)
            yield pd.DataFrame({
                "structure": parts.map(lambda ps: " ; ".join(s for p in ps if (s := structure(p)))), "q": b["q"], "values": parts.map(lambda ps: " ; ".join(map(_values, ps))), "run_count": b["run_count"]})

    s = texts.mapInPandas(shapes, "structure string, q string, values string, run_count long").where("structure <> ''")
    g = s.groupBy("structure").agg(F.sum("run_count").alias("runs"), F.count_distinct("q").alias("distinct_queries"), F.count_distinct("values").alias("distinct_values"), F.min("q").alias("example"))
    g = g.where((F.col("runs") >= least) & ((F.col("distinct_queries") > 1) | (F.col("distinct_values") > 1)))
    return g.withColumn("score", F.col("runs") * F.greatest("distinct_values", "distinct_queries", F.lit(1)))


class Inspector:
    """Read-only looks at data: one statement, few rows, bounded text and time; answers are kept."""

    def __init__(self, spark: SparkSession, max_chars: int = 10_000, seconds: float = 15.0):
        self.spark, self.max_chars, self.seconds, self.kept = spark, max_chars, seconds, {}

    def query_data(self, sql: str, max_rows: int = 100, dataset: str = "") -> str:
        if not T.is_read_only(sql) or len(T.statements(sql)) != 1:
            raise PermissionError("one read-only statement is allowed")
        rows = max(1, min(max_rows, 1000))
        key = (sql, rows, dataset)
        if key not in self.kept:
            self.kept[key] = self._run(sql, rows)
        return self.kept[key]

    def _run(self, sql: str, rows: int) -> str:
        import threading

        sc, tag, box = self.spark.sparkContext, f"inspect-{uuid.uuid4().hex}", {}

        def work() -> None:
            try:
                sc.addJobTag(tag)
                box["rows"] = self.spark.sql(sql).limit(rows + 1).toPandas()
            except Exception as e:
                box["error"] = e

        t, began = threading.Thread(target=work, daemon=True), time.time()
        t.start()
        t.join(self.seconds)
        if t.is_alive():
            sc.cancelJobsWithTag(tag)
            raise TimeoutError(f"no answer in {time.time() - began:.0f} s")
        if "error" in box:
            raise box["error"]
        out = box["rows"].head(rows).to_string(index=False)
        more = f"\n(more than {rows} rows)" if len(box["rows"]) > rows else ""
        return out[: self.max_chars] + ("\n(cut)" if len(out) > self.max_chars else "") + more


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: name, type, count, nulls, distinct (approximate), least and largest value, in one pass."""
    aggs, names = [], df.columns
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"), F.approx_count_distinct(x).alias(f"d{i}"), F.min(x).cast("string").alias(f"lo{i}"), F.max(x).cast("string").alias(f"hi{i}")]
    one = df.agg(F.count("*").alias("all"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(dict(df.dtypes)[c]).alias("column_type"), F.col(f"n{i}").alias("count"), (F.col("all") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("approx_unique"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
