"""Schedules, cash, board figures, unit costs and cell contracts on small tables, each with input that must fail."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.analyses import appraisal, schedules
from tallywright.operators import cell_rules, field_contracts, snapshots

ASSET = "asset long, cost double, salvage double, life int, in_service int, first_factor double, dispose int, impair int, impair_to double"


def by_hand(a, start, end):
    """One asset's ledger, kept month by month."""
    begun = start if a["in_service"] is None else a["in_service"]
    book, used, life, out = a["cost"], 0, a["life"] or 0, {}
    charge = (a["cost"] - a["salvage"]) / life if life > 0 else 0.0
    stays = a["dispose"]
    for month in range(min(begun, start), end + 1):
        loss = dep = 0.0
        hit = a["impair"] == month and a["impair_to"] is not None and month >= begun and (stays is None or month <= stays)
        if hit:
            loss, book = book - a["impair_to"], a["impair_to"]
            charge = max(book - a["salvage"], 0.0) / max(life - used, 1)
        opening, closed = book, stays is not None and month >= stays
        if month >= begun and not closed and used < life:
            first = 1.0 if a["first_factor"] is None else a["first_factor"]
            used += 1
            dep = book - a["salvage"] if used == life else charge * (first if month == begun else 1.0)
            book -= dep
        out[month] = (opening, dep, book, loss, month >= begun and not closed)
    return {m: v for m, v in out.items() if m >= start}


def test_asset_schedule_against_a_ledger_kept_by_hand(spark):
    r, rows = random.Random(3), []
    for k in range(400):
        begun = r.choice([None, r.randint(0, 30)])
        at = begun if begun is not None else 10
        event = lambda: r.choice([None, at + r.randint(0, 25)])
        rows.append((k, 1000.0 + k, r.choice([0.0, 100.0]), r.choice([None, 0, 1, 2, 7, 12, 60]), begun, r.choice([None, 0.5, 1.0]), event(), event(), r.choice([None, 50.0, 400.0])))
    assets = spark.createDataFrame(rows, ASSET)
    got = {(x.asset, x.period): x for x in schedules.asset_schedule(assets, 10, 45).collect()}
    assert len(got) == 400 * 36
    for a in (x.asDict() for x in assets.collect()):
        for month, want in by_hand(a, 10, 45).items():
            x = got[a["asset"], month]
            assert (x.opening, x.dep, x.closing, x.impairment) == pytest.approx(want[:4], abs=1e-6), (a, month)
            assert x.active == want[4], (a, month)
    assert schedules.asset_schedule(assets.limit(0), 10, 45).count() == 0


def test_missing_accruals_and_the_ledger(spark):
    a = spark.createDataFrame([(1, 120.0, 0.0, 12, 2, None, 5, None, None), (2, 60.0, 0.0, 6, 4, None, None, None, None)], ASSET)
    s = schedules.asset_schedule(a, 1, 6)
    booked = spark.createDataFrame([(1, 2, 10.0), (1, 4, 10.0), (2, 4, 10.0), (2, 5, 10.0), (2, 6, 13.0), (9, 8, 5.0), (1, 3, None)], "asset long, period int, amount double")
    assert [(r.asset, r.period, r.dep) for r in schedules.missing_accruals(s, booked).collect()] == [(1, 3, 10.0)]
    tie = {r.period: (r.missing, r.ok) for r in schedules.ledger_tie(s, booked).collect()}
    assert tie == {1: (0, True), 2: (0, True), 3: (1, True), 4: (0, True), 5: (0, True), 6: (0, False), 8: (None, False)}
    sales = spark.createDataFrame([(1, 5, 100.0), (2, 9, 1.0)], "asset long, period int, price double")
    assert {(r.asset, r.nbv, r.result) for r in schedules.disposal_results(s, sales).collect()} == {(1, 90.0, 10.0), (2, None, None)}


def test_cash_lines_balances_and_checks(spark):
    flows = spark.createDataFrame([("a", "in", "sales", 1, 5.0), ("a", "in", "sales", 1, 2.0), ("a", "out", "rent", 3, 9.0), ("a", "in", "sales", 40, 99.0)], "entity string, side string, line string, week int, amount double")
    openings = spark.createDataFrame([("a", 1.0)], "entity string, opening double")
    lines = schedules.cash_lines(flows, 3)
    assert lines.count() == 6 and lines.agg(F.sum("amount")).first()[0] == 16
    weeks = schedules.cash_weeks(lines, openings)
    assert [(r.opening, r.closing, r.lowest, r.short) for r in weeks.orderBy("week").collect()] == [(1, 8, 8, False), (8, 8, 8, False), (8, -1, -1, True)]
    bad = lambda df: {r.check: r.bad for r in schedules.check_cash(df, lines, openings, 3).collect() if not r.ok}
    assert bad(weeks) == {}
    assert bad(weeks.filter("week <> 2")) == {"WEEKS": 1}
    assert bad(weeks.union(weeks.filter("week = 2"))) == {"WEEKS": 1}
    assert bad(weeks.withColumn("opening", F.col("opening") + F.when(F.col("week") == 2, 1).otherwise(0))) == {"CHAIN": 1, "ROLL": 1}
    assert bad(weeks.withColumn("inflow", F.lit(0.0))) == {"ROLL": 1, "LINES": 1}
    assert schedules.check_cash(weeks.limit(0), lines, openings, 3).count() == 0


def test_board_and_unit_costs(spark):
    board = spark.createDataFrame([("a", 10.0, 8.0), ("b", 5.0, 10.0), ("c", 1.0, 0.0), ("d", 2.0, 2.0)], "kpi string, actual double, target double")
    source = spark.createDataFrame([("a", 4.0), ("a", 6.0), ("b", 5.5), ("e", 1.0), ("d", None)], "kpi string, value double")
    got = {r.kpi: (r.status, r.tie, r.attainment) for r in schedules.board_pack(board, source, ["kpi"]).collect()}
    assert got == {"a": ("MET", "TIED", 1.25), "b": ("MISSED", "OFF", 0.5), "c": ("NO_TARGET", "UNSOURCED", None), "d": ("MET", "OFF", 1.0), "e": (None, "UNSHOWN", None)}
    lines = spark.createDataFrame([("x", 100.0, 10.0, "EA", "EA"), ("x", 50.0, 40.0, "EA", "EA"), ("x", 9.0, 0.0, "EA", "EA"), ("y", 5.0, 2.0, "sqft", "m2")], "driver string, cost double, qty double, unit string, canonical_unit string")
    costs = schedules.unit_costs(lines)
    assert [(r.unit_cost, r.reason) for r in costs.orderBy("cost").collect()] == [(None, "UNIT_MISMATCH"), (None, "ZERO_DENOM"), (1.25, None), (10.0, None)]
    blended = {r.driver: (r.blended, r.valid, r.invalid) for r in schedules.blended_cost(costs, ["driver"]).collect()}
    assert blended == {"x": (3.0, 2, 1), "y": (None, 0, 1), None: (3.0, 2, 2)}


def box(r0, r1, c0, c1, sheet="s"):
    return (sheet, r0, r1, c0, c1)


def judged(spark, cells, *rules):
    names = [f.name for f in spark.createDataFrame([], cell_rules.RULES).schema]
    rows = [tuple({"rule": str(i), "sheet": "s", **dict(zip(("r0", "r1", "c0", "c1"), at)), "kind": kind, **more}.get(c) for c in names) for i, (kind, at, more) in enumerate(rules)]
    table = spark.createDataFrame(cells, "sheet string, row int, col int, value double, text string, formula string")
    got = {r.rule: r for r in cell_rules.judge(table, spark.createDataFrame(rows, cell_rules.RULES)).collect()}
    return [(got[str(i)].ok, got[str(i)].bad) for i in range(len(rules))]


def num(r, c, v, sheet="s"):
    return (sheet, r, c, float(v), str(v), None)


def word(r, c, v, sheet="s"):
    return (sheet, r, c, None, v, None)


def formula(r, c, v, sheet="s"):
    return (sheet, r, c, None, None, v)


def test_ties_and_ratios(spark):
    cells = [num(1, 1, 4), num(2, 1, 6), num(3, 1, 10), num(4, 1, 12), formula(5, 1, "=SUM($A$1:A2)"), formula(6, 1, "=A1+A2"), word(7, 1, "ten"), num(1, 2, 0), num(2, 2, 5), word(3, 2, "NA"), word(4, 2, "#DIV/0!"), num(5, 2, 1.2), formula(6, 2, '=IF(ISNUMBER(A1),A1/B2,"")'), formula(7, 2, "=A1/B2")]
    parts, cell = {"parts": box(1, 2, 1, 1), "parts_ref": "A1:A2"}, lambda r, c: (r, r, c, c)
    assert judged(spark, cells, ("tie", cell(3, 1), parts), ("tie", cell(4, 1), parts), ("tie", cell(5, 1), parts), ("tie", cell(6, 1), parts), ("tie", cell(7, 1), parts), ("tie", cell(3, 1), {"expected": 10.4}), ("tie", cell(3, 1), {"expected": 11.0}), ("tie", cell(9, 9), {"expected": 1.0}), ("tie", cell(1, 1), {"sheet": "none", "expected": 4.0})) == [
        (True, 0), (False, 1), (True, 0), (False, 1), (False, 1), (True, 0), (False, 1), (False, 1), (False, 1)
    ]
    over = lambda d: {"num": box(2, 2, 1, 1), "den": box(d, d, 2, 2)}
    assert judged(spark, cells, ("ratio", cell(5, 2), over(2)), ("ratio", cell(3, 1), over(2)), ("ratio", cell(3, 2), over(1)), ("ratio", cell(4, 2), over(1)), ("ratio", cell(3, 1), over(9)), ("ratio", cell(3, 2), over(2)), ("guard", cell(6, 2), {}), ("guard", cell(7, 2), {}), ("guard", cell(4, 2), {}), ("ratio", cell(1, 1), {"sheet": "none", **over(2)})) == [
        (True, 0), (False, 1), (True, 0), (False, 1), (False, 1), (False, 1), (True, 0), (False, 1), (False, 1), (None, None)
    ]


def test_regions(spark):
    labels = [word(r, 1, v) for r, v in enumerate(["a", "b", "a", "c", " "], 1)] + [word(r, 2, v) for r, v in enumerate(["a", "b", "d"], 1)]
    values = [num(r, 3, v) for r, v in enumerate([1, -5, 2000, 0], 1)] + [formula(1, 4, "=$A1 - b1"), formula(2, 4, "=A3-B2"), num(3, 4, 1)]
    heads = [word(1, c, m) for c, m in ((6, "Jan"), (7, "Feb"), (8, "Mar"))]
    got = judged(
        spark, labels + values + heads, ("grain", (1, 5, 1, 1), {}), ("grain", (1, 3, 2, 2), {}), ("scenario", (1, 5, 1, 1), {"parts": box(1, 3, 2, 2)}), ("expected_n", (1, 5, 1, 1), {"n": 4}),
        ("expected_n", (1, 5, 1, 1), {"n": 5}), ("field", (1, 4, 3, 3), {"sign": 1}), ("field", (1, 4, 3, 3), {"low": -5.0, "high": 1000.0}), ("field", (1, 4, 1, 1), {"accepted": ["a", "b"]}),
        ("formula_refs", (1, 3, 4, 4), {"left": "a", "op": "-", "right": "B"}), ("units", (1, 4, 3, 3), {}), ("units", (1, 2, 3, 3), {}), ("periods", (1, 1, 6, 8), {"ruler": ["Jan", "Feb", "Mar"]}),
        ("periods", (1, 1, 6, 8), {"ruler": ["Jan", "Mar", "Feb"]}), ("periods", (1, 1, 6, 9), {"ruler": ["Jan", "Feb", "Mar"]}), ("periods", (1, 1, 6, 8), {"ruler": ["Jan", "Feb", "Mar", "Apr"]}),
    )
    assert got == [(False, 1), (True, 0), (False, 2), (True, 0), (False, 1), (False, 1), (False, 1), (False, 1), (False, 1), (False, 1), (True, 0), (True, 0), (False, 2), (False, 1), (False, 1)]
    assert judged(spark, labels, ("units", (50, 60, 1, 1), {}), ("grain", (50, 60, 1, 1), {})) == [(True, 0), (True, 0)]


def test_coverage(spark):
    cells = [("s", 1, 1, 5.0, "5", None, True, True), ("s", 2, 1, 5.0, "5", None, True, False), ("s", 3, 1, None, None, "=A1/A2", False, False), ("s", 4, 1, None, None, "='a/b'!A1&\"x/y\"", False, False), ("t", 1, 1, 7.0, "7", None, True, True)]
    table = spark.createDataFrame(cells, "sheet string, row int, col int, value double, text string, formula string, bold boolean, top_border boolean")
    rules = spark.createDataFrame([("1", "tie", "t", 1, 1)], "rule string, kind string, sheet string, r0 long, c0 long")
    assert {(r.sheet, r.row, r.warning) for r in cell_rules.coverage(table, rules).collect()} == {("s", 1, "TOTAL_WITHOUT_TIE"), ("s", 3, "DIVISION_WITHOUT_RATIO")}


PROJECT = "project long, rate double, use_wacc boolean, equity double, debt double, cost_equity double, cost_debt double, tax double, terminal double"


def test_appraisal_and_tornado(spark):
    flows = spark.createDataFrame([(1, 0, -100.0), (1, 1, 60.0), (1, 2, 40.0), (2, 0, 10.0), (2, 1, 10.0), (3, 0, -50.0), (3, 1, 55.0)], "project long, t int, cash double")
    projects = spark.createDataFrame([(1, 0.2, True, 60.0, 40.0, 0.1, 0.05, 0.2, 20.0), (2, 0.1, False, None, None, None, None, None, None), (3, 0.1, True, 0.0, 0.0, 0.1, 0.1, 0.1, None)], PROJECT)
    e = appraisal.effective(flows, projects)
    a = {r.project: r for r in appraisal.appraise(e, 0.05, 0.06).collect()}
    assert a[1].rate == pytest.approx(0.6 * 0.1 + 0.4 * 0.05 * 0.8) and a[2].rate == 0.1 and a[3].rate == 0.1
    assert a[1].npv == pytest.approx(-100 + 60 / 1.076 + 60 / 1.076**2) and a[3].npv == pytest.approx(0.0) and a[3].irr == pytest.approx(0.1)
    assert (a[2].irr, a[2].status, a[2].mirr, a[2].payback) == (None, "none", None, None)
    frame = appraisal.appraise(e, 0.05, 0.06)
    assert {(r.project, r.check) for r in appraisal.check(e, frame, flows, projects).collect() if not r.ok} == {(2, "MIRR")}
    off = frame.withColumn("irr", F.lit(0.5))
    assert {(r.project, r.check) for r in appraisal.check(flows.join(e.select("project", "rate").distinct(), "project"), off, flows, projects).collect() if not r.ok} == {(1, "ROOT"), (2, "ROOT"), (3, "ROOT"), (1, "TERMINAL"), (2, "MIRR")}
    cases = spark.createDataFrame([(1, "price", -50.0, 50.0), (1, "cost", 30.0, 20.0), (1, "volume", None, 5.0), (1, "delay", 40.0, 60.0)], "project long, variable string, npv_low double, npv_high double")
    got = {r.variable: (r.rank, r.bracketed) for r in appraisal.tornado(cases, frame).collect()}
    assert got == {"price": (1, True), "delay": (2, False), "cost": (3, False), "volume": (4, False)}


def test_field_contracts(spark):
    rows = spark.createDataFrame([("q", v) for v in (1.0, 50.0, -1.0, None)] + [("r", v) for v in (1.0, 50.0, 51.0, 0.5, None)] + [("a", v) for v in (1.0, 4.0)] + [("n", 3.0), ("n", -3.0), ("other", 1.0)], "field string, value double")
    specs = spark.createDataFrame([("q", "quantity", None, None, 50.0, False, None, None, 50.2), ("r", "ratio", None, 1.0, 50.0, None, False, None, None), ("a", None, None, None, None, None, None, [1.0, 2.0], 6.0), ("n", "currency", "-", None, None, None, None, None, None), ("gone", None, None, None, None, None, None, None, 0.0)], field_contracts.SPECS)
    got = sorted((r.field, r.value, r.status, r.reason) for r in field_contracts.judge_fields(rows.filter("value is not null"), specs).collect())
    assert got == [
        ("a", 1.0, "OK", None), ("a", 4.0, "VIOLATION", "NOT_ACCEPTED"), ("n", -3.0, "OK", None), ("n", 3.0, "VIOLATION", "SIGN"), ("q", -1.0, "VIOLATION", "SIGN"), ("q", 1.0, "OK", None),
        ("q", 50.0, "VIOLATION", "HIGH"), ("r", 0.5, "VIOLATION", "LOW"), ("r", 1.0, "OK", None), ("r", 50.0, "OK", None), ("r", 51.0, "VIOLATION", "HIGH"),
    ]
    assert {(r.field, r.status, r.reason) for r in field_contracts.judge_fields(rows.filter("value is null"), specs).collect()} == {("q", "NO_DATA", None), ("r", "VIOLATION", "NULL")}
    assert {(r.field, r.ok) for r in field_contracts.field_totals(rows, specs).collect()} == {("q", True), ("a", False), ("gone", True)}


def test_workbook_diff(spark):
    kind = "w string, sheet string, row int, col int, text string, formula string"
    before = spark.createDataFrame([("w", "s", 1, 1, "amount", None), ("w", "s", 2, 1, "5", None), ("w", "s", 3, 1, "6", None), ("w", "s", 2, 2, None, "=A2"), ("w", "s", 3, 2, None, "=A3"), ("w", "s", 4, 2, None, "=A4"), ("w", "t", 1, 1, "x", None), ("v", "t", 1, 1, "x", None)], kind)
    after = spark.createDataFrame([("w", "s", 1, 1, "amount", None), ("w", "s", 1, 2, "new", None), ("w", "s", 3, 1, "#REF!", None), ("w", "s", 2, 2, None, "=A9"), ("w", "s", 3, 2, "6", None), ("v", "t", 1, 1, "x", None), ("w", "s", 9, 9, "more", None)], kind)
    got = sorted((r.w, r.sheet, r.row, r.col, r.finding) for r in snapshots.workbook_diff(before, after, ["w"]).filter("row is not null").collect())
    assert got == [("w", "s", 1, 2, "HEADER_CHANGED"), ("w", "s", 2, 1, "CELL_LOST"), ("w", "s", 2, 2, "FORMULA_CHANGED"), ("w", "s", 3, 1, "CELL_CHANGED"), ("w", "s", 3, 1, "ERROR_NEW"), ("w", "s", 3, 2, "FORMULA_LOST"), ("w", "s", 4, 2, "FORMULA_LOST")]
    assert [(r.w, r.sheet) for r in snapshots.workbook_diff(before, after, ["w"]).filter("finding = 'SHEET_LOST'").collect()] == [("w", "t")]
    assert snapshots.workbook_diff(before, before, ["w"]).count() == 0
