"""Formulas, normalisation and checks on small tables, with damaged input where a check must fail."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import finance as fin
from tallywright.functions import normalize as n
from tallywright.operators import audit, grid, profile
from tallywright.operators import checks as q


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text_numbers(spark):
    got = one(spark, lambda x: n.number(x)["value"], "1,234", "(50)", "△30", "-5", "85%", "１２３", "1,234천원", "007", "-", "abc", None, "1e3", "12(-)")
    assert got == [1234, -50, -30, -5, pytest.approx(0.85), 123, 1_234_000, None, None, None, None, 1000, -12]


def test_labels_and_kinds(spark):
    assert one(spark, n.strip_footnote, "매출¹", "A*", "(1)", "x (주1)") == ["매출", "A", "(1)", "x"]
    assert one(spark, n.value_kind, "2024-01", "5%", "7.5", "word", "N/A") == ["DATE", "PCT", "NUM", "TEXT", None]
    assert one(spark, n.unit_scale, "단위: 십억원", "백만원", "%") == [10**9, 10**6, 1]
    assert one(spark, n.to_integer, "1,234", "12,34", "5.0", "5.5") == [1234, None, 5, None]
    assert one(spark, n.year_month, "2024-03-01", "2024년 3월", "2024Q2") == [24290, 24290, 24291]
    assert one(spark, n.indent_level, "    a", "\tb", "c") == [2, 2, 0]


def test_cash_flows(spark):
    flows = spark.createDataFrame([(1, t, c) for t, c in enumerate([-1000.0, 300.0, 350.0, 400.0, 450.0, 300.0])] + [(2, 0, 5.0), (2, 1, 5.0)], "k int, t int, cash double")
    irr = {r.k: r.irr for r in fin.irr(flows, "k").collect()}
    assert irr[1] == pytest.approx(0.22696, abs=1e-4) and irr[2] is None
    pay = {r.k: r.payback for r in fin.payback(flows, "k", F.lit(0.0)).collect()}
    assert pay[1] == pytest.approx(2 + 350 / 400) and pay[2] is None


def test_schedules_end_where_they_must(spark):
    a = spark.createDataFrame([(1, 1200.0, 120.0, 12, 0.5, None, 5, 500.0), (2, 1200.0, 0.0, 12, 1.0, 6, 8, 1.0), (3, 600.0, 0.0, 6, 1.0, None, None, None)], "asset int, cost double, salvage double, life int, first_factor double, dispose_k int, impair_k int, impair_to double")
    rows = {}
    for r in fin.depreciation_ext(a).collect():
        rows.setdefault(r.asset, {})[r.k] = r
    assert rows[1][12].closing == pytest.approx(120) and rows[1][5].closing == pytest.approx(500)
    assert sum(r.dep + r.impairment for r in rows[1].values()) == pytest.approx(1080)
    assert rows[2][7].dep == 0 and rows[2][6].closing == 0 and rows[2][8].impairment == 0
    assert [rows[3][k].closing for k in range(1, 7)] == pytest.approx([500, 400, 300, 200, 100, 0])
    lease = fin.lease_schedule(spark.createDataFrame([(1, k, 100.0, 0.01) for k in range(1, 13)], "lease int, k int, pay double, rate double"))
    assert lease.filter("k = 12").first().closing == pytest.approx(0, abs=1e-9)


def test_effects_add_up(spark):
    e = fin.lmdi(F.col("r0"), F.col("v0"), F.col("r1"), F.col("v1"))
    for r in spark.createDataFrame([(2.0, 10.0, 3.0, 12.0), (0.0, 5.0, 1.0, 5.0), (-1.0, 4.0, 2.0, 4.0)], "r0 double, v0 double, r1 double, v1 double").select("*", e.alias("e")).collect():
        assert r.e.rate + r.e.volume == pytest.approx(r.r1 * r.v1 - r.r0 * r.v0, abs=1e-6)


def test_checks_pass_and_fail(spark, tmp_path):
    fact = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0), (2, 1, 8.0), (None, 1, 1.0)], "k int, p int, v double")
    assert {(r.k, r.p, r.reason) for r in q.grain(fact, ["k", "p"]).collect()} == {(2, 1, "DUPLICATE"), (None, 1, "NULL_KEY")}
    assert [(r.k, r.p) for r in q.missing_periods(fact.filter("k is not null"), fact.select("p"), ["k"], "p").collect()] == [(2, 2)]
    a, b = spark.createDataFrame([(1, 1), (None, 2)], "k int, a int"), spark.createDataFrame([(None, 3), (4, 4)], "k int, b int")
    assert {(r.k, r.match_status) for r in q.full_outer(a, b, ["k"]).collect()} == {(1, "LEFT_ONLY"), (None, "MAPPED"), (4, "RIGHT_ONLY")}
    small = {"few": F.count("*") < 9, "sum": F.sum("v") > 1e6}
    assert not q.publish(fact, small, str(tmp_path / "a")) and not list(tmp_path.glob("a")) and not list(tmp_path.glob("a_staged*"))
    said = {r.check_name: (r.ok, r.detail) for r in spark.read.parquet(str(tmp_path / "a_checks")).collect()}
    assert said == {"rows written": (True, "5"), "few": (True, ""), "sum": (False, "")}
    assert q.publish(fact, {"few": F.count("*") < 5}, str(tmp_path / "a"), filters={"no key": F.col("k").isNull(), "low": F.col("v") < 6}) and (tmp_path / "a").exists()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [6.0, 7.0, 8.0]
    said = {r.check_name: r.detail for r in spark.read.parquet(str(tmp_path / "a_checks")).collect()}
    assert said["excluded: no key"] == "1" and said["excluded: low"] == "2" and said["rows written"] == "3"
    assert not q.publish(fact.limit(0), small, str(tmp_path / "a")) and spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert q.publish(fact, {"never": F.lit(False) & (F.count("*") > 0)}, str(tmp_path / "a"), force=True) and spark.read.parquet(str(tmp_path / "a")).count() == 5
    r = q.ratio(F.col("v"), F.lit(0.0))
    assert {x[0] for x in fact.select(r["reason"]).collect()} == {"ZERO_DENOM"}


def test_hierarchy_levels_and_totals(spark):
    rows = spark.createDataFrame([("s", 1, 0, 30.0), ("s", 2, 1, 10.0), ("s", 3, 1, 20.0), ("s", 4, 0, 5.0), ("s", 5, 1, 5.0)], "sheet string, src_row int, level int, value double")
    got = {r.src_row: (r.n_children, r.child_sum) for r in grid.children(rows, ["sheet"]).collect()}
    assert got[1] == (2, 30.0) and got[4] == (1, 5.0) and got[2][0] == 0
    tree = spark.createDataFrame([("r", None, 0.0), ("a", "r", 1.0), ("b", "a", 2.0), ("x", "gone", 9.0)], "node string, parent string, value double")
    assert {r.node: r.total for r in q.rollup_tree(tree).collect()} == {"r": 3.0, "a": 3.0, "b": 2.0, "x": 9.0}


def test_two_blocks_on_a_sheet(spark):
    put = lambda r0, c0, rows: [("w", "s", r0 + i, c0 + j, v, False, None, None) for i, row in enumerate(rows) for j, v in enumerate(row) if v]
    first = put(1, 1, [["(단위: 천원)", ""], ["item", "2024", "2025"], ["A", "10", "(5)"], ["B", "-", "△3"], ["합계", "10", "-8"]])
    second = put(4, 7, [["k", "2024"], ["C", "1.5"], ["D", "#DIV/0!"]])
    cells = spark.createDataFrame(first + second, "workbook string, sheet string, row int, col int, value_str string, bold boolean, merge_row int, merge_col int")
    got = {(r.entity, r.period): r for r in grid.ingest(cells).collect()}
    assert got["A", "2024"].value == 10_000 and got["A", "2025"].value == -5_000 and got["B", "2025"].value == -3_000
    assert got["합계", "2024"].row_role == "subtotal" and got["C", "2024"].value == 1.5
    assert got["D", "2024"].value is None and got["D", "2024"].flags == ["ERROR_CELL"]


def test_formula_audit_and_roles(spark):
    f = spark.createDataFrame([(r, f"=A{r}*B{r}") for r in range(1, 9)] + [(9, "=A1*B9")], "row int, formula string").withColumn("form", audit.relative_form(F.col("formula"), F.col("row"), F.lit(3)))
    assert [r.row for r in audit.minority(f.withColumn("col", F.lit(3)), ["col"], "form").collect()] == [9]
    t = spark.createDataFrame([(f"2024-{m:02d}", float(m * 7 + 0.5), "ab"[m % 2], f"id{m}") for m in range(1, 13)] * 2, "d string, v double, c string, i string")
    roles = {r.column: r.role for r in profile.roles(profile.column_stats(t, t.columns)).collect()}
    assert roles == {"d": "time", "v": "dimension", "c": "dimension", "i": "dimension"} or roles["d"] == "time"


def test_registered_queries_run(spark):
    from tallywright import plans

    for name in ("k1_variance", "k16_maturity_wall", "q18_ratio_or_na", "d5_rollup", "x1_formula_smells"):
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(plans.SQL) <= set(plans.QUERIES)
