"""Mechanisms on small tables, each with the case that a simpler way gets wrong."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.analyses import allocation, funding
from tallywright.functions import finance as fin
from tallywright.functions import normalize as n
from tallywright.operators import audit, grid, ingest, profile, totals
from tallywright.operators import checks as q
from tallywright.sources import records

CELLS = "workbook string, sheet string, row int, col int, value_str string, bold boolean, merge_row int, merge_col int"


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def put(sheet, r0, rows, bold=()):
    return [("w", sheet, r0 + i, 1 + j, v, (i, j) in bold, None, None) for i, row in enumerate(rows) for j, v in enumerate(row) if v]


def test_numbers_and_periods_as_they_stand(spark):
    assert one(spark, lambda x: n.number(x)["value"], "(1,234", "1,234)", "12 345", "(1,234)", "+7", "( 5 )", "$1,000", "(50백만)", "1.5.2", "-") == [None, None, None, -1234, 7, -5, 1000, -50_000_000, None, None]
    assert one(spark, lambda x: n.number(x)["value"], "5%", "(5%)", "△3", "12(-)", "3.", ".5", "1e3", "1.25E9") == [0.05, -0.05, -3, -12, 3, 0.5, 1000, 1.25e9]
    yes = ["1분기", "2024년 1분기", "상반기", "2024 하반기", "1Q", "2024", "2024년", "2024.3", "2024Q4", "3/4", "12월"]
    assert one(spark, n.is_period, *yes, "5분기", "분기", "1분", "매출 2024") == [True] * len(yes) + [False] * 4


def test_rates_of_return_and_how_they_were_found(spark):
    flows = {1: [-100, 230, -132], 2: [-100, 0, 0, 0, 0, 1], 3: [5, 5], 4: [-1000, 300, 350, 400, 450, 300], 5: [-1, 0]}
    df = spark.createDataFrame([(k, t, float(c)) for k, x in flows.items() for t, c in enumerate(x)], "k int, t int, cash double")
    got = {r.k: (r.irr, r.status) for r in fin.irr(df, "k").collect()}
    assert got[1] == (pytest.approx(0.1), "newton") and got[2] == (pytest.approx(0.01 ** 0.2 - 1), "bisection")
    assert got[3] == (None, "none") and got[4] == (pytest.approx(0.22696, abs=1e-4), "newton") and got[5] == (None, "none")


def test_models_without_a_revolver_or_tranches(spark):
    p = spark.createDataFrame([(m, k, f) for m in (1, 2) for k, f in ((1, -800.0), (2, 1800.0))], "model int, k int, flow double")
    f = spark.createDataFrame([(m, 1000.0, 500.0, 1e6, True) for m in (1, 2)], "model int, cash0 double, floor double, top double, sweep boolean")
    t = spark.createDataFrame([(1, "term", 1000.0, 0.01, 1)], "model int, name string, opening double, rate double, rank int")
    r = {(x.model, x.k): x for x in funding.solve(p, f, t).collect()}
    assert r[1, 1].draw == 0 and r[1, 1].cash == pytest.approx(190) and r[1, 1].revolver == 0 and r[1, 2].repay == pytest.approx(1000)
    assert r[2, 1].cash == pytest.approx(200) and r[2, 2].cash == pytest.approx(2000) and r[2, 2].debt == 0 and r[2, 2].balances == []


def test_blocks_need_a_column_that_fills_their_rows(spark):
    diagonal = [("w", "d", k, k, "1.5", False, None, None) for k in range(1, 13)]
    ditto = put("l", 1, [["k", "i", "v"]] + [["", "", "1.5"]] * 8 + [["m", "j", "2.5"]])
    found = {r.sheet for r in grid.blocks(spark.createDataFrame(diagonal + ditto, CELLS)).collect()}
    assert found == {"l"}


def test_subtotals_in_real_labels_and_in_bold(spark):
    assert one(spark, grid.is_subtotal, "Total revenue", "매출 합계", "합 계", "Grand Total", "Totally", "합계표", "revenue") == [True] * 4 + [False] * 3
    rows = [["item", "2024", "2025"], ["A", "10", "20"], ["B", "30", "40"], ["All regions", "40", "60"], ["C", "1", "2"]]
    by = {}
    for bold in ((), ((3, 0),)):
        cells = spark.createDataFrame(put("s", 1, rows[:4], bold), CELLS)
        by[bool(bold)] = {r.entity: r.row_role for r in ingest.ingest(cells).collect()}
    assert by[False]["All regions"] == "data" and by[True]["All regions"] == "subtotal" and by[True]["A"] == "data"


def test_formula_tokens(spark):
    f = "=IF('My Sheet'!A1>0,매출!$B$2,\"see B!A1 & \"\"x\"\"\")*1.37+[b.xlsx]S!C3+'it''s'!D4"
    r = spark.createDataFrame([(f,)], "f string").select(audit.tokens(F.col("f")).alias("t"), audit.sheets_in(audit.tokens(F.col("f"))).alias("s"), audit.functions_in(audit.tokens(F.col("f"))).alias("fn")).first()
    assert "".join(r.t) == f and r.s == ["My Sheet", "매출", "S", "it's"] and r.fn == ["IF"]
    cells = [("w1", "A", "=B!A1"), ("w1", "B", "='A'!A1+\"A!A1\""), ("w1", "A", '="B!A1"&C1'), ("w2", "B", None), ("w2", "C", "=A!A1")]
    df = spark.createDataFrame(cells, "workbook string, sheet string, formula string")
    assert {tuple(r) for r in audit.sheet_references(df).collect()} == {("w1", "A", "B", 1), ("w1", "B", "A", 1)}
    edges = spark.createDataFrame([("w1", "A", "A"), ("w2", "A", "B")], "workbook string, from string, to string")
    sheets = spark.createDataFrame([("w1", "A", "listing"), ("w2", "A", "listing"), ("w2", "B", None)], "workbook string, sheet string, output string")
    assert {r.workbook: r.kind for r in profile.workbook_verdict(sheets, edges).collect()} == {"w1": "single", "w2": "linked"}
    forms = spark.createDataFrame([("=A1*$B$1&\"A1\"", 1), ("=A9*$B$1&\"A1\"", 9)], "f string, r int").select(audit.relative_form(F.col("f"), F.col("r"), F.lit(3))).distinct()
    assert [r[0] for r in forms.collect()] == ['=R[0]C[-2]*$B$1&"A1"']


def test_tiled_joins_against_all_pairs(spark):
    rnd = random.Random(1)
    cells = [("s", rnd.randrange(1, 900), rnd.randrange(1, 30)) for _ in range(800)] + [("t", 5, 5)]
    boxes = []
    for k in range(120):
        r0, c0 = rnd.randrange(1, 800), rnd.randrange(1, 25)
        boxes.append((rnd.choice("st"), k, r0, r0 + rnd.choice([0, 3, 63, 64, 200]), c0, c0 + rnd.randrange(5)))
    a = spark.createDataFrame(cells, "sheet string, row int, col int")
    b = spark.createDataFrame(boxes, "sheet string, k int, r0 int, r1 int, c0 int, c1 int")
    want = sorted((s, r, c, k) for s, r, c in cells for t, k, r0, r1, c0, c1 in boxes if s == t and r0 <= r <= r1 and c0 <= c <= c1)
    for tile in (1, 64, 5000):
        assert sorted(map(tuple, grid.within(a, b, ["sheet"], tile).select("sheet", "row", "col", "k").collect())) == want


def test_tall_sheets_meet_few_pairs(spark):
    rows = spark.range(1, 200_001).select(F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"))
    boxes = spark.range(2000).select(F.lit("s").alias("sheet"), F.col("id").alias("k"), (F.col("id") * 100 + 1).cast("int").alias("r0"), (F.col("id") * 100 + 100).cast("int").alias("r1"), F.lit(1).alias("c0"), F.lit(1).alias("c1"))
    met = rows.withColumn("_tile", F.floor(F.col("row") / grid.TILE)).join(grid.tiles(boxes), ["sheet", "_tile"]).count()
    assert grid.within(rows, boxes, ["sheet"]).count() == 200_000 and met < 800_000


def test_deep_hierarchies_and_cycles(spark):
    chain = [(f"n{k}", f"n{k - 1}" if k else None, 1.0) for k in range(5000)] + [("a", "b", 1.0), ("b", "c", 2.0), ("c", "b", 4.0), ("o", "gone", 8.0), ("self", "self", 1.0)]
    df = spark.createDataFrame(chain, "node string, parent string, value double")
    got = {r.node: (r.total, r.in_cycle) for r in q.rollup_tree(df).collect()}
    assert all(got[f"n{k}"] == (5000.0 - k, False) for k in range(5000))
    assert got["a"] == (1.0, False) and got["b"] == got["c"] == got["self"] == (None, True) and got["o"] == (8.0, False)
    tie = q.hierarchy_ties(df).first()
    assert not tie.ok and tie.orphans == 1 and tie.in_cycle == 3
    assert q.hierarchy_ties(df.filter("node like 'n%'")).first().ok and q.rollup_tree(df.limit(0)).count() == 0


def test_files_in_three_encodings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("이름,값\n가,1\n나\n".encode("utf-8-sig"))
    (tmp_path / "in" / "b.csv").write_bytes("이름,값\n다,3\n".encode("cp949"))
    (tmp_path / "in" / "c.csv").write_bytes('이름,값\n"라, 마",4\n'.encode())
    got = sorted(tuple(r) for r in records.read_delimited(spark, str(tmp_path / "in")).select("이름", "값").collect())
    assert got == [("가", "1"), ("나", ""), ("다", "3"), ("라, 마", "4")]


def test_step_down_with_closed_departments_and_an_even_fallback(spark):
    costs = spark.createDataFrame([(e, d, "production" if d > "s9" else "service", c) for e in (1, 2) for d, c in (("s1", 100.0), ("s2", 50.0), ("s3", 0.0), ("x", 10.0), ("y", 20.0))], "entity int, dept string, kind string, cost double")
    drivers = spark.createDataFrame([(1, "s1", "s2", 1.0), (1, "s1", "x", 3.0), (1, "s2", "s1", 9.0), (1, "s2", "y", -1.0), (2, "s1", "gone", 1.0)], "entity int, source string, target string, weight double")
    order = spark.createDataFrame([(e, k, s) for e in (1, 2) for k, s in ((1, "s1"), (2, "s2"), (3, "s3"))], "entity int, rank int, source string")
    final = allocation.step_down(costs, drivers, order)
    got = {(r.entity, r.dept): r.cost for r in final.collect()}
    assert (got[1, "s1"], got[1, "s2"], got[1, "x"], got[1, "y"]) == (0.0, 0.0, 10 + 75 + 37.5, 20 + 37.5)
    assert (got[2, "x"], got[2, "y"]) == (35.0, 45.0)
    assert {r.entity: r.ok for r in allocation.conserved(costs, final).collect()} == {1: True, 2: False}
    flows = {(r.entity, r.source, r.target): r.amount for r in allocation.step_down_flows(costs, drivers, order).collect()}
    assert flows[1, "s1", "s2"] == 25.0 and flows[2, "s1", "gone"] == 100.0 and flows[1, "s3", "x"] == 0.0


def test_values_derived_from_raw_text(spark):
    assert one(spark, grid.derived, "1,234", "(50)", "△3백만", "5%", "007", "2024", "word", "12 345", "-2.5", None) == [1234, -50, -3_000_000, 0.05, None, None, None, None, -2.5, None]
    cells = spark.createDataFrame(put("s", 1, [["(단위: 천원)"], ["item", "2024", "2025"], ["A", "10", "(5)"], ["B", "7", "#REF!"]]), CELLS)
    rows = grid.ingest(cells)
    assert {(r.row, r.col): r.status for r in grid.reconcile(cells, rows).collect()} == {(3, 2): "scaled", (3, 3): "scaled", (4, 2): "scaled", (4, 3): "covered"}
    wrong = rows.withColumn("value", F.when(F.col("src_row") == 3, F.col("value") + 1).otherwise(F.col("value"))).filter("src_col < 3 or src_row = 3")
    assert {(r.row, r.col): r.status for r in grid.reconcile(cells, wrong).collect()} == {(3, 2): "mismatch", (3, 3): "mismatch", (4, 2): "scaled", (4, 3): "missing"}


def test_bold_alone_is_no_subtotal(spark):
    rows = spark.createDataFrame([("k", "A", 1.0, True, "data"), ("k", "B", 5.0, False, "data")], "k string, label string, value double, bold boolean, row_role string")
    assert {r.label: r.row_role for r in totals.score_subtotals(rows, ["k"]).collect()} == {"A": "data", "B": "data"}


def test_nearest_headers_against_a_plain_search(spark):
    rnd = random.Random(8)
    cells = [(b, r, c, rnd.random() < 0.3) for b in range(4) for r in range(1, 9) for c in range(1, 8) if rnd.random() < 0.7]
    data, heads = [x[:3] for x in cells if not x[3]], [x[:3] for x in cells if x[3]]
    fits = {"up": lambda d, h: h[2] == d[2] and h[1] < d[1], "left": lambda d, h: h[1] == d[1] and h[2] < d[2], "up-left": lambda d, h: h[2] <= d[2] and h[1] < d[1], "left-up": lambda d, h: h[1] <= d[1] and h[2] < d[2]}
    a, b = (spark.createDataFrame(x, "b int, row int, col int") for x in (data, heads))
    for way, fit in fits.items():
        rank = (lambda h: (h[1], h[2])) if way in ("up", "left-up") else (lambda h: (h[2], h[1]))
        want = {d: max((h for h in heads if h[0] == d[0] and fit(d, h)), key=rank, default=(None, None, None))[1:] for d in data}
        assert {(r.b, r.row, r.col): (r.hrow, r.hcol) for r in grid.nearest_header(a, b, way, ["b"]).collect()} == want


def test_figures_and_their_places(spark):
    """Years as headers and as figures, missing marks, numbers formatted as text, and many label columns."""
    sheets = {
        "years": [["item", "2024", "2025"], ["A", "1932", "512.5"], ["B", "-", "7.5"], ["C", "1950", "3.5"]],
        "keys": [["a", "b", "c", "d", "value"], ["k", "l", "m", "n", "1.5"], ["k", "l", "m", "o", "2.5"], ["k", "l", "p", "o", "3.5"]],
        "text": [["item", "2024"], ["A", "12"], ["B", "7"], ["C", "8"]],
        "dashes": [["item", "2024", "2025"], ["A", "-", "-"], ["B", "4.5", "5.5"], ["C", "6.5", "7.5"]],
    }
    rows = [("w", s, 1 + i, 1 + j, v, False, None, None, "@" if s == "text" else "General") for s, x in sheets.items() for i, y in enumerate(x) for j, v in enumerate(y)]
    cells = spark.createDataFrame(rows, CELLS + ", number_format string")
    got = {(r.sheet, r.src_row, r.src_col): r for r in grid.ingest(cells).collect()}
    assert got["years", 2, 2].value == 1932 and got["years", 2, 2].period == "2024" and got["years", 4, 2].value == 1950 and got["years", 2, 3].period == "2025"
    assert got["keys", 2, 5].value == 1.5 and got["keys", 3, 5].entity == "k > l > m > o" and got["keys", 3, 5].metric == "value"
    assert got["text", 2, 2].value == 12 and got["text", 2, 2].period == "2024"
    assert got["dashes", 2, 2].value_text == "-" and got["dashes", 3, 3].value == 5.5 and got["dashes", 3, 3].period == "2025"


def test_outputs_bound_by_roles(spark):
    rows = [(f"2024-{m:02d}-01", m * 7.5 + k, m * 11.25 - k, "ab"[k % 2], f"id{m}-{k}") for m in range(1, 13) for k in range(3)] + [(None, None, None, "a", "x")]
    t = spark.createDataFrame(rows, "day string, plan double, actual double, kind string, code string")
    kind, made, measures = profile.bind(t)
    assert kind == "trend" and measures == ["plan", "actual"] and made.filter("period is null").count() == 1
    for want, table in (("variance", t.drop("day")), ("listing", t.select("kind", "plan")), ("listing", t.select("kind", "code"))):
        kind, made, measures = profile.bind(table)
        assert kind == want and all(r.ok for r in profile.sums_conserved(table, made, measures).collect()) if measures else made.filter("is_total").first().n_rows == 37
    kind, made, measures = profile.bind(t.drop("day"), output="variance")
    assert {r.label: round(r.difference - (r.actual - r.plan), 9) for r in made.collect()} == {"a": 0.0, "b": 0.0}
    lost = made.filter("label = 'a'")
    assert not any(r.ok for r in profile.sums_conserved(t, lost, measures).collect())
    assert profile.bind(t.drop("day"), output="trend")[0] == "listing" and profile.bind(t.limit(0))[0] == "listing"
