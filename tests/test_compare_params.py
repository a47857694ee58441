"""Result comparison and parameter spaces."""

import json
import random
from decimal import Decimal

import pyarrow as pa
import pytest

from tidewright.operators import compare as C
from tidewright.operators import params as P


def test_cells():
    assert C.cells_equal(None, None) and not C.cells_equal(None, 0) and not C.cells_equal("", None)
    assert C.cells_equal(1.0, 1.0 + 1e-9) and not C.cells_equal(1.0, 1.001) and C.cells_equal(1, 1.0)
    assert not C.cells_equal(Decimal("1.10"), Decimal("1.11")) and not C.cells_equal(True, 1) and C.cells_equal(float("nan"), float("nan"))


def test_multisets_of_other_number_types():
    for n in (5, 65, 300):
        a = [(i, 2 * i, None) for i in range(n)]
        for b in ([(i, Decimal(2 * i), None) for i in range(n)], [(i, 2.0 * i, None) for i in range(n)]):
            assert C.multiset_equal(a, b) and C.multiset_contains(b, a) and not C.multiset_equal(a, [*b[1:], (0, 1, None)])
    assert not C.multiset_equal([(True,)], [(1,)]) and not C.multiset_equal([(True,), (1.0,)], [(1,), (1.0,)])


def test_multisets():
    assert C.multiset_equal([(1, 0.1), (1, 0.2)], [(1, 0.2 + 1e-9), (1, 0.1)])
    assert not C.multiset_equal([(1,), (1,), (2,)], [(1,), (2,), (2,)])
    assert C.multiset_contains([(1,), (1,), (2,)], [(1,), (1,)]) and not C.multiset_contains([(1,)], [(1,), (1,)])
    assert C.ordered_equal([(1, "a"), (1, "b")], [(1, "b"), (1, "a")], keys=[0]) and not C.ordered_equal([(1, "a"), (1, "b")], [(1, "b"), (1, "a")])


def test_differences():
    t = pa.table({"k": [1, 2], "v": ["a", "b"]})
    assert C.differences(t, pa.table({"V": ["b", "a"], "K": [2, 1]})) == []
    assert C.differences(t, pa.table({"k": [1, 2], "w": ["a", "b"]}))[0].startswith("columns")
    assert C.differences(t, pa.table({"k": [1, 2], "v": ["a", "c"]}))[-1] == "2 differences"
    more = pa.table({"k": [1, 2, 2], "v": ["a", "b", "c"]})
    assert C.differences(t, pa.table({"k": [1, 2], "v": ["a", "c"]}), True, [0], candidates=more) == []


def test_frames(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 0.5)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 0.5 + 1e-12)], "k int, v double")
    assert [tuple(r) for r in C.frames_differ(a, b).collect()] == [(1, None, 2, 1)]
    assert C.frame_contains(a, b.limit(1)) and not C.frame_contains(b, a)


def test_domains():
    every = lambda d: [d.nth(i) for i in range(d.size)]
    assert every(P.decimals(0.02, 0.05, 0.01)) == [0.02, 0.03, 0.04, 0.05] and every(P.steps(5, 9, 2)) == [5, 7, 9]
    assert every(P.dates("2024-02-27", "2024-03-02", 2)) == ["2024-02-27", "2024-02-29", "2024-03-02"]
    assert every(P.chosen("abc", 1, 2)) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")]
    assert sorted(every(P.arranged([1, 2, 3, 3], 2))) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    for bad in (lambda: P.steps(3, 1, 1), lambda: P.steps(1, 3, 0), lambda: P.dates("2020-01-01", "x"), lambda: P.listed([(1,), 2]), lambda: P.listed([]), lambda: P.arranged([1], 2), lambda: P.rows_of("AB", [(1,)]), lambda: P.chosen("a", 1, 2)):
        with pytest.raises(ValueError):
            bad()


def test_spaces():
    text = "select [N] + [M] from t where (s, k) = ('[S]', [K]) and d in [L]"
    space = P.parse_space(text, {"params": {"M": {"kind": "int_offset", "base": "N", "low_offset": 1, "high_offset": 2}, "N": {"type": "int", "min": 1, "max": 3}, "L": {"kind": "choice_list", "values": [7, 8], "n_min": 1, "n_max": 2}},
                                 "param_groups": [{"type": "tuples", "names": ["S", "K"], "rows": [["x", 1], ["y", 2]]}]})
    assert space.size == 2 * 3 * 3 * 2 and len({str(v) for v in space.draw(random.Random(1), 99)}) == 36
    assert all(v["M"] - v["N"] in (1, 2) and (v["S"], v["K"]) in (("x", 1), ("y", 2)) for v in space.draw(random.Random(1), 99))
    assert space.types() == {"N": "INTEGER", "M": "INTEGER", "L": "INTEGER", "S": "VARCHAR", "K": "INTEGER"}


def test_all_22_templates():
    templates = P.tpch_templates()
    assert list(templates) == [str(i) for i in range(1, 23)]
    for t in templates.values():
        got = t.instances(3)
        assert len({q for _, q in got}) == len(got) == min(3, t.space.size) and not any(P.placeholders(q) for _, q in got)


def test_large_groups_are_matched_not_zipped():
    rng = random.Random(4)
    a = [(float(i // 2), rng.random() * 1e-9 + (i % 2)) for i in range(300)]
    b = [(x + rng.uniform(-1, 1) * 5e-7, y) for x, y in a]  # the order of close rows is another on each side
    assert C.multiset_equal(a, b) and not C.multiset_equal(a, [*b[1:], (0.5, 0.0)])
    assert C._match([(1.0, 5.0), (1.0 + 1e-7, 2.0)], [(1.0, 2.0), (1.0 + 1e-7, 5.0)], 1e-6) == 2


def test_frames_differ_within_tolerance(spark):
    a = spark.createDataFrame([("k", 0.4999995, 1), ("k", 0.25, 2), ("n", None, 3), ("x", float("nan"), 4), ("k", 7.0, 5)], "k string, v double, n int")
    b = spark.createDataFrame([("k", 0.4999994999, 1), ("k", 0.25, 2), ("n", None, 3), ("x", float("nan"), 4), ("k", 7.1, 5)], "k string, v double, n int")
    assert sorted(tuple(r) for r in C.frames_differ(a, b).collect()) == [("k", 7.0, 5, 1, 0), ("k", 7.1, 5, 0, 1)]


@pytest.mark.parametrize("spec", [{}, {"params": {"A": {"type": "int", "min": 1, "max": 2}, "B": {"type": "int", "min": 1, "max": 2}}}, {"params": {"a": {"type": "int", "min": 1, "max": 2}}},
                                  {"params": {"A": {"type": "what"}}}, {"params": {"A": {"type": "int"}}}, {"params": {"A": {"type": "int", "min": 1, "max": 2}}, "param_groups": [{"type": "sample", "names": ["A"], "values": [1]}]}])
def test_space_errors(spec):
    with pytest.raises(ValueError):
        P.parse_space("select [A]", spec)


def test_files_and_extraction(tmp_path):
    (tmp_path / "q12.sql").write_text("select [WIDTH] from boats where name = '[low tide]';")
    (tmp_path / "query3.sql").write_text("select 5")
    (tmp_path / "params.json").write_text(json.dumps({"Q12": {"params": {"WIDTH": {"type": "categorical", "values": [4, 6]}}}}))
    t = P.load_templates(tmp_path)
    assert list(t) == ["3", "12"] and {s for _, s in t["12"].instances(9)} == {f"select {w} from boats where name = '[low tide]'" for w in (4, 6)}
    (tmp_path / "q3.sql").write_text("select 6")
    with pytest.raises(ValueError):
        P.load_templates(tmp_path)
    (text, values), = P.extract_templates(["select a from t where x < 1 order by a", "select a from t where x < 3 order by a", "select a from t where y < 2 order by a"])
    assert text == "select a from t where [P1] < [P2] order by a" and values == [{"P1": "x", "P2": 1}, {"P1": "x", "P2": 3}, {"P1": "y", "P2": 2}]
    assert P.substitute(text, values[2]) == "select a from t where y < 2 order by a"
    (text, values), = P.extract_templates(["select a from t where x < 1", "select a from t where x >= 1"])
    assert text == "select a from t where x [P1] 1" and [v["P1"] for v in values] == ["<", ">="]
    assert len(P.extract_templates(["select a from t where x < 1", "select a from t group by x"])) == 2
    (text, values), = P.extract_templates(["select a from t where x = 1 and y = 'k'", "SELECT a FROM t WHERE x = 2 AND y = 'k'"])
    assert text == "select a from t where x = [P1] and y = 'k'" and values == [{"P1": 1}, {"P1": 2}]
    assert P.hoist_quotes("a = [A]", [{"A": "'x'"}]) == ("a = '[A]'", [{"A": "x"}])
