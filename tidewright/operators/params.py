"""Typed parameter spaces of query templates: ``[NAME]`` holes, finite domains, sampling by number and substitution."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

HOLE = re.compile(r"\[([A-Z][A-Z0-9_]*)\]")


def placeholders(text: str) -> list[str]:
    """Names of the holes of a template, in order, once each. Lower-case brackets are data."""
    return list(dict.fromkeys(HOLE.findall(text)))


def is_placeholder_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Z][A-Z0-9_]*", name))


def render(value: object) -> str:
    """A value as it stands in SQL text between the template's own quotes; lists as a parenthesised list of literals."""
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError("an empty list has no SQL")
        return "(" + ", ".join(literal(v) for v in value) + ")"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dt.date, Decimal)):
        return str(value)
    return repr(value) if isinstance(value, float) else str(value)


def literal(value: object) -> str:
    """A value as an SQL literal of its own."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.date):
        return f"DATE '{value}'"
    return render(value)


def substitute(template: str, values: Mapping[str, object]) -> str:
    """The template with its holes filled; inside a string literal quotes of the value are doubled."""
    missing = [n for n in placeholders(template) if n not in values]
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    out, inside, last = [], False, 0
    for m in re.finditer(r"'|" + HOLE.pattern, template):
        out.append(template[last : m.start()])
        if m.group() == "'":
            inside = not inside
            out.append("'")
        else:
            v = values[m[1]]
            out.append(render(v).replace("'", "''") if inside else literal(v) if isinstance(v, (str, dt.date)) and not _is_sql(v) else render(v))
        last = m.end()
    return "".join(out) + template[last:]


class SQL(str):
    """Text that is SQL itself (a column, an operator)."""


def _is_sql(v: object) -> bool:
    return isinstance(v, SQL)


def hoist_quotes(template: str, samples: list[Mapping[str, object]]) -> tuple[str, list[dict[str, object]]]:
    """Move quoting from values such as ``'x'`` to the template; mixed or inner quotes are errors."""
    clean = [dict(s) for s in samples]
    for name in placeholders(template):
        vals = [s[name] for s in samples if name in s]
        quoted = [isinstance(v, str) and len(v) > 1 and v[0] == v[-1] == "'" for v in vals]
        if any(quoted):
            if not all(quoted):
                raise ValueError(f"{name} is quoted in some samples only")
            if any("'" in v[1:-1] for v in vals):
                raise ValueError(f"{name} has a quote inside")
            template = template.replace(f"[{name}]", f"'[{name}]'")
            for s in clean:
                if name in s:
                    s[name] = s[name][1:-1]
    return template, clean


class Domain:
    """A finite, numbered set of values: how many there are, and the one with a given number.

    Ranges, lists, rows and arrangements are all domains, so drawing a value is drawing a number.
    """

    def __init__(self, size: int, nth: Callable[[int], object], kind: str):
        if size < 1:
            raise ValueError("a domain has no values")
        self.size, self.nth, self.kind = size, nth, kind


def steps(low, high, step, value: Callable = lambda x: x, kind: str = "INTEGER") -> Domain:
    """low, low + step, ... up to high; ``value`` makes the value from the exact sum."""
    if low > high or not step > step - step:
        raise ValueError(f"nothing from {low} to {high} by {step}")
    return Domain((high - low) // step + 1, lambda i: value(low + i * step), kind)


def decimals(low, high, step) -> Domain:
    """Floats on an exact decimal grid."""
    low, high, step = (Decimal(str(x)) for x in (low, high, step))
    grid = steps(low, high, step, float, "DOUBLE")
    return Domain(int(grid.size), grid.nth, grid.kind)


def dates(low: str, high: str, step: int = 1) -> Domain:
    """ISO dates, ``step`` days apart."""
    first, last = dt.date.fromisoformat(low), dt.date.fromisoformat(high)
    return Domain(steps(0, (last - first).days, step).size, lambda i: str(first + dt.timedelta(step * i)), "DATE")


def listed(values: Sequence) -> Domain:
    if len({isinstance(v, (list, tuple)) for v in values}) > 1:
        raise ValueError("values mix lists and scalars")
    values = [tuple(v) if isinstance(v, list) else v for v in values]
    return Domain(len(values), values.__getitem__, infer_type(values))


def chosen(values: Sequence, low: int, high: int) -> Domain:
    """Lists of ``low`` to ``high`` distinct values, numbered by length, then in the order of the values."""
    values = list(dict.fromkeys(values))
    if not 1 <= low <= high <= len(values):
        raise ValueError(f"lists of {low} to {high} of {len(values)} values")

    def nth(i: int) -> tuple:
        k = low
        while i >= math.comb(len(values), k):
            i -= math.comb(len(values), k)
            k += 1
        out = []
        for at, v in enumerate(values):
            if len(out) == k:
                break
            with_it = math.comb(len(values) - at - 1, k - len(out) - 1)
            if i < with_it:
                out.append(v)
            else:
                i -= with_it
        return tuple(out)

    return Domain(sum(math.comb(len(values), k) for k in range(low, high + 1)), nth, infer_type(values))


def arranged(values: Sequence, k: int) -> Domain:
    """Rows of ``k`` different values."""
    values = list(dict.fromkeys(values))

    def nth(i: int) -> tuple:
        left, out = list(values), []
        for at in range(k):
            rest = math.perm(len(left) - 1, k - at - 1)
            out.append(left.pop(i // rest))
            i %= rest
        return tuple(out)

    if len(values) < k:
        raise ValueError(f"{len(values)} values for {k} holes")
    return Domain(math.perm(len(values), k), nth, infer_type(values))


def infer_type(values: Sequence) -> str:
    """The SQL type that holds all values."""
    if not values:
        return "VARCHAR"
    kinds = {type(v) for v in values}
    if kinds == {bool}:
        return "BOOLEAN"
    if kinds == {int}:
        return "INTEGER"
    if kinds <= {int, float}:
        return "DOUBLE"
    if kinds == {str} and all(re.fullmatch(r"\d{4}-\d\d-\d\d", v) for v in values):
        return "DATE"
    return "VARCHAR"


@dataclass
class Part:
    """Holes that are filled together from one domain; ``above``: an int added to the value of that hole."""

    names: tuple[str, ...]
    domain: Domain
    row: bool = False
    above: str | None = None


class Space:
    """The product of its parts' domains; every number below ``size`` is one set of values."""

    def __init__(self, parts: Sequence[Part]):
        self.parts = sorted(parts, key=lambda p: p.above is not None)  # what another hole is added to comes first
        self.size = math.prod(p.domain.size for p in parts)

    def nth(self, i: int) -> dict[str, object]:
        out: dict[str, object] = {}
        for p in self.parts:
            i, k = divmod(i, p.domain.size)
            v = p.domain.nth(k)
            out |= dict(zip(p.names, v, strict=True)) if p.row else {p.names[0]: v if p.above is None else out[p.above] + v}
        return out

    def draw(self, rng: random.Random, n: int = 1) -> list[dict[str, object]]:
        """``n`` different sets of values, or all there are."""
        numbers = rng.sample(range(self.size), min(n, self.size)) if self.size < 1 << 62 else [rng.randrange(self.size) for _ in range(n)]
        return [self.nth(i) for i in numbers]

    def names(self) -> list[str]:
        return [n for p in self.parts for n in p.names]

    def types(self) -> dict[str, str]:
        """The SQL type of each hole, as far as the domain's own type or, for rows, its values show it."""
        out = {}
        for p in self.parts:
            rows = [p.domain.nth(i) for i in range(p.domain.size)] if p.row and p.domain.kind == "ROW" else []
            out |= {n: infer_type([r[k] for r in rows]) if rows else p.domain.kind for k, n in enumerate(p.names)}
        return out


def rows_of(names: Sequence[str], rows: Sequence[Sequence]) -> Domain:
    """Rows with a value for each name."""
    rows = [tuple(r) for r in rows]
    if any(len(r) != len(names) for r in rows):
        raise ValueError(f"rows do not fit {tuple(names)}")
    return Domain(len(rows), rows.__getitem__, "ROW")


#: How each kind of a declaration makes its domain.
KINDS: dict[str, Callable[[Mapping], Domain]] = {
    "int": lambda s: steps(int(s["min"]), int(s["max"]), int(s.get("step", 1))),
    "int_uniform": lambda s: steps(int(s["low"]), int(s["high"]), int(s.get("step", 1))),
    "float": lambda s: decimals(s["min"], s["max"], s["step"]),
    "float_uniform": lambda s: decimals(s["low"], s["high"], Decimal(1).scaleb(-s.get("decimals", 2))),
    "date": lambda s: dates(s["min"], s["max"], int(s.get("step", 1))),
    "categorical": lambda s: listed(s["values"]),
    "choice": lambda s: listed(s["values"]),
    "choice_list": lambda s: chosen(s["values"], s["n_min"], s["n_max"]),
    "int_offset": lambda s: steps(s["low_offset"], s["high_offset"], 1),
}


def parse_space(template: str, spec: Mapping) -> Space:
    """A template's space from its declaration; every hole must be covered exactly once."""
    parts = []
    for name, s in (spec.get("params") or {}).items():
        kind = s.get("type") or s.get("kind")
        if kind not in KINDS:
            raise ValueError(f"{name}: unknown kind {kind!r}")
        try:
            parts.append(Part((name,), KINDS[kind](s), above=s["base"] if kind == "int_offset" else None))
        except (KeyError, TypeError) as e:
            raise ValueError(f"{name}: incomplete {kind} spec") from e
    for g in spec.get("param_groups") or []:
        names = tuple(g.get("names") or g.get("params") or ())
        if g.get("type") == "tuples" or "rows" in g:
            parts.append(Part(names, rows_of(names, g.get("rows") or g.get("values") or ()), row=True))
        elif g.get("type") == "sample" or "values" in g:
            parts.append(Part(names, arranged(g.get("values") or (), len(names)), row=True))
        else:
            raise ValueError(f"unknown group {g.get('type')!r}")
    space = Space(parts)
    given, need = Counter(space.names()), set(placeholders(template))
    wrong = [n for n in given if not is_placeholder_name(n)] or [n for n, k in given.items() if k > 1] or sorted(need ^ given.keys()) or [p.above for p in parts if p.above and p.above not in given]
    if wrong:
        raise ValueError(f"not one value for each placeholder: {wrong}")
    return space


def query_id(name: str) -> str:
    """"1", "q1", "Q1" and "query1" are one id: "1"; "2b" stays."""
    m = re.fullmatch(r"(?:query|q)?[_-]?(\d+[a-z]?)", name.strip().lower())
    return m[1] if m else name.strip()


def natural(name: str) -> tuple:
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name))


@dataclass
class Template:
    query_id: str
    sql: str
    space: Space

    def instances(self, n: int, seed: int = 42) -> list[tuple[dict, str]]:
        """``n`` instances with different values, or all that the space has."""
        return [(v, substitute(self.sql, v)) for v in self.space.draw(random.Random(f"{seed}:{self.query_id}"), n)]


def load_templates(path: str | Path) -> dict[str, Template]:
    """Templates of a ``queries.json`` or of a folder of ``*.sql`` files with ``params.json``, in natural order."""
    path = Path(path)
    if path.is_dir():
        specs = json.loads((path / "params.json").read_text()) if (path / "params.json").exists() else {}
        specs = {query_id(k): v for k, v in specs.items()}
        raw = [(f.stem, {"sql": f.read_text()} | specs.get(query_id(f.stem), {})) for f in path.glob("*.sql")]
    else:
        raw = list(json.loads(path.read_text()).items())
    out: dict[str, Template] = {}
    for name, entry in sorted(raw, key=lambda x: natural(query_id(x[0]))):
        entry = {"sql": entry} if isinstance(entry, str) else entry
        qid, sql = query_id(name), (entry.get("sql") or entry["template"]).strip().rstrip(";")
        if qid in out:
            raise ValueError(f"two queries are {qid!r}")
        rules = {"params": entry.get("params") or entry.get("generation_rules") or {}, "param_groups": entry.get("param_groups") or []}
        out[qid] = Template(qid, sql, parse_space(sql, rules))
    return out


def extract_templates(texts: list[str]) -> list[tuple[str, list[dict[str, object]]]]:
    """Templates of a query log: statements of one structure, with a hole where their literals vary.

    Statements are grouped by structural key; a literal that all share stays in the text. Groups that
    differ in one column name or one comparison only are one template, with a hole there too, whose
    values are SQL.
    """
    from tidewright.plans.text import Unit, normalize, tokenize, units

    by_key: dict[tuple, list[list[Unit]]] = {}  # lists of other lengths are other shapes here
    for text in texts:
        key, parts = normalize(text), units(tokenize(text)) if normalize(text) else []
        if key is not None:
            by_key.setdefault((key, len(parts)), []).append(parts)
    groups: list[list[list[Unit]]] = []
    for rows in by_key.values():
        near = next((g for g in groups if len(g[0]) == len(rows[0]) and len(_apart(g, rows)) == 1), None)
        if near is None:
            groups.append(list(rows))
        else:
            near += rows
    out = []
    for rows in groups:
        face = lambda u: repr(u.value) if u.kind == "literal" else u.text
        varying = [i for i in range(len(rows[0])) if len({face(r[i]) for r in rows}) > 1]
        names = {i: f"P{k + 1}" for k, i in enumerate(varying)}
        parts = [f"[{names[i]}]" if i in names else literal(u.value) if u.kind == "literal" else u.text for i, u in enumerate(rows[0])]
        out.append((" ".join(parts), [{n: r[i].value if r[i].kind == "literal" else SQL(r[i].text) for i, n in names.items()} for r in rows]))
    return out


def _apart(group: list, rows: list) -> set[int]:
    """Places where two groups of statements have other columns or comparisons; with -1 and -2 if they differ in anything else."""
    out = set()
    for i, (u, v) in enumerate(zip(group[0], rows[0], strict=True)):
        if u.kind != v.kind:
            return {-1, -2}
        faces = {r[i].text for r in (*group, *rows)} if u.kind != "literal" else {""}
        if len(faces) > 1:
            if not faces <= COMPARISONS and not all(re.fullmatch(r"[a-z_]\w*", f) and f not in WORDS for f in faces):
                return {-1, -2}
            out.add(i)
    return out


#: What may stand for one another in an extracted template, and words that are no columns.
COMPARISONS = {"=", "<", ">", "<=", ">=", "<>", "!="}
WORDS = set("select from where group order by having limit offset and or not in like ilike between is null as on join left right full inner outer cross union all distinct case when then else end exists asc desc with".split())


#: The parameter ranges of the 22 decision-support queries' public specification, as far as
#: they apply to the tables here.
_DATE = {"type": "date", "min": "1993-01-01", "max": "1997-10-01"}
_YEAR = {"type": "date", "min": "1993-01-01", "max": "1997-01-01"}
_STATUS = {"type": "categorical", "values": ["F", "O", "P"]}
_BRAND = {"type": "categorical", "values": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]}
_NATIONS = [f"NATION_{i}" for i in range(25)]
TPCH_SPACES: dict[str, dict] = {
    "1": {"params": {"DELTA": {"type": "int", "min": 60, "max": 120}}},
    "2": {"params": {"SIZE": {"type": "int", "min": 1, "max": 50}}},
    "3": {"params": {"SEGMENT": {"type": "categorical", "values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}, "DATE": {"type": "date", "min": "1995-03-01", "max": "1995-03-31"}}},
    "4": {"params": {"DATE": _DATE}},
    "5": {"params": {"REGION": {"type": "categorical", "values": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}, "DATE": _YEAR}},
    "6": {"params": {"DATE": _YEAR, "DISCOUNT": {"type": "float", "min": 0.02, "max": 0.09, "step": 0.01}, "QUANTITY": {"type": "int", "min": 24, "max": 25}}},
    "7": {"param_groups": [{"type": "sample", "names": ["NATION1", "NATION2"], "values": _NATIONS}]},
    "8": {"params": {"NATION": {"type": "categorical", "values": _NATIONS}, "SIZE": {"type": "int", "min": 1, "max": 49}}},
    "9": {"params": {"PIECE": {"type": "categorical", "values": list("aeiorst")}}},
    "10": {"params": {"DATE": {"type": "date", "min": "1993-02-01", "max": "1995-01-01"}}},
    "11": {"params": {"FRACTION": {"type": "float", "min": 0.001, "max": 0.02, "step": 0.001}}},
    "12": {"params": {"FLAGS": {"type": "choice_list", "values": ["A", "N", "R"], "n_min": 2, "n_max": 2}, "DATE": _YEAR}},
    "13": {"params": {"WORD": {"type": "categorical", "values": ["URGENT", "HIGH", "MEDIUM", "LOW", "NOT SPECIFIED"]}}},
    "14": {"params": {"DATE": _YEAR}},
    "15": {"params": {"DATE": _DATE}},
    "16": {"params": {"BRAND": _BRAND, "SIZES": {"type": "choice_list", "values": list(range(1, 51)), "n_min": 8, "n_max": 8}}},
    "17": {"params": {"BRAND": _BRAND}},
    "18": {"params": {"QUANTITY": {"type": "int", "min": 312, "max": 315}}},
    "19": {"params": {"QUANTITY1": {"type": "int", "min": 1, "max": 10}, "QUANTITY2": {"type": "int", "min": 10, "max": 20}, "TOP1": {"type": "int_offset", "base": "QUANTITY1", "low_offset": 10, "high_offset": 20}}},
    "20": {"params": {"FACTOR": {"type": "float", "min": 1.1, "max": 1.9, "step": 0.1}}},
    "21": {"params": {"STATUS": _STATUS}},
    "22": {"params": {"STATUS": _STATUS, "TOTAL": {"type": "int", "min": 100000, "max": 400000, "step": 50000}}},
}
TPCH_TEMPLATES: dict[str, str] = {
    "1": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '[DELTA]' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "3": "SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = '[SEGMENT]' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '[DATE]' AND l_shipdate > DATE '[DATE]' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate LIMIT 10",
    "4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '[DATE]' AND o_orderdate < DATE '[DATE]' + INTERVAL '3' MONTH AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "5": "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = '[REGION]' AND o_orderdate >= DATE '[DATE]' AND o_orderdate < DATE '[DATE]' + INTERVAL '1' YEAR GROUP BY n_name ORDER BY revenue DESC",
    "6": "SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= DATE '[DATE]' AND l_shipdate < DATE '[DATE]' + INTERVAL '1' YEAR AND l_discount BETWEEN [DISCOUNT] - 0.01 AND [DISCOUNT] + 0.01 AND l_quantity < [QUANTITY]",
    "18": "SELECT o_orderkey, sum(l_quantity) AS qty FROM orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > [QUANTITY]) AND o_orderkey = l_orderkey GROUP BY o_orderkey ORDER BY qty DESC, o_orderkey LIMIT 100",
}


#: The others are registered queries with holes where they have constants: (query, {constant: hole}).
TPCH_HOLES: dict[str, tuple[str, dict[str, str]]] = {
    "2": ("scalar_minimum", {"p_size = 15": "p_size = [SIZE]"}),
    "7": ("q7_volume_shipping", {"'NATION_3'": "'[NATION1]'", "'NATION_7'": "'[NATION2]'"}),
    "8": ("q8_market_share", {"'NATION_3'": "'[NATION]'", "p_size > 10": "p_size > [SIZE]"}),
    "9": ("q9_product_profit", {"'%e%'": "'%[PIECE]%'"}),
    "10": ("q10_returned", {"DATE '1996-10-01'": "DATE '[DATE]'", "DATE '1997-01-01'": "DATE '[DATE]' + INTERVAL '3' MONTH"}),
    "11": ("scalar_uncorrelated", {"0.011": "[FRACTION]"}),
    "12": ("q12_priorities", {"('A', 'R')": "[FLAGS]", "DATE '1996-01-01'": "DATE '[DATE]'", "DATE '1997-01-01'": "DATE '[DATE]' + INTERVAL '1' YEAR"}),
    "13": ("join_left_condition", {"'%URGENT%'": "'%[WORD]%'"}),
    "14": ("q14_promo", {"DATE '1996-09-01'": "DATE '[DATE]'", "DATE '1996-10-01'": "DATE '[DATE]' + INTERVAL '1' MONTH"}),
    "15": ("cte_used_twice", {"DATE '1996-01-01'": "DATE '[DATE]'"}),
    "16": ("anti_not_in", {"'Brand#2'": "'[BRAND]'", "(3, 9, 14, 19, 23, 36, 45, 49)": "[SIZES]"}),
    "17": ("scalar_correlated", {"'Brand#2'": "'[BRAND]'"}),
    "19": ("filter_or_blocks", {"l_quantity >= 1 AND l_quantity <= 21": "l_quantity >= [QUANTITY1] AND l_quantity <= [TOP1]", "l_quantity >= 10 AND l_quantity <= 40": "l_quantity >= [QUANTITY2] AND l_quantity <= [QUANTITY2] + 10"}),
    "20": ("q20_nested_average", {"1.5 *": "[FACTOR] *"}),
    "21": ("semi_anti_residual", {"o_orderstatus = 'F'": "o_orderstatus = '[STATUS]'"}),
    "22": ("q22_segments", {"o_orderstatus = 'F'": "o_orderstatus = '[STATUS]'", "300000": "[TOTAL]"}),
}


def with_holes(text: str, holes: Mapping[str, str]) -> str:
    for constant, hole in holes.items():
        if constant not in text:
            raise ValueError(f"{constant!r} is not in the query")
        text = text.replace(constant, hole)
    return text.strip()


def tpch_templates() -> dict[str, Template]:
    """All 22, in order."""
    from tidewright.plans.relational import texts

    known = texts()
    sql = TPCH_TEMPLATES | {k: with_holes(known[name][0], holes) for k, (name, holes) in TPCH_HOLES.items()}
    return {k: Template(k, sql[k], parse_space(sql[k], TPCH_SPACES[k])) for k in sorted(sql, key=natural)}
