"""Header bands, subtotals, records and contract checks on small tables, with damaged input where a check must fail."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import normalize as n
from tallywright.operators import audit, dimensions, headers, profile, totals
from tallywright.operators import checks as q
from tallywright.sources import records

CELLS = "workbook string, sheet string, row int, col int, value_str string"
BLOCKS = "workbook string, sheet string, block_id long, r0 int, r1 int, c0 int, c1 int"


def put(r0, c0, rows):
    return [("w", "s", r0 + i, c0 + j, v) for i, row in enumerate(rows) for j, v in enumerate(row) if v]


def test_header_band_over_a_gap(spark):
    cells = spark.createDataFrame(put(1, 1, [["issued", "2024-01-02"]]) + put(3, 1, [["area", "A", "B", "C"], ["unit", "t", "t", "t"]]) + put(6, 1, [["x", "1", "2", "3"], ["y", "4", "5", "6"], ["z", "7", "8", "9"]]), CELLS)
    block = ("w", "s", 1, 6, 8, 1, 4)
    assert [r.r0 for r in headers.absorb_bands(cells, spark.createDataFrame([block], BLOCKS)).collect()] == [3]
    both = spark.createDataFrame([block, ("w", "s", 2, 3, 4, 1, 4)], BLOCKS)
    assert [(r.block_id, r.r0) for r in headers.absorb_bands(cells, both).collect()] == [(1, 3)]
    above = spark.createDataFrame(put(1, 1, [["p", "1", "2", "3"]] * 3) + put(6, 1, [["x", "1", "2", "3"]] * 3), CELLS)
    two = spark.createDataFrame([("w", "s", 1, 1, 3, 1, 4), ("w", "s", 2, 6, 8, 1, 4)], BLOCKS)
    assert {(r.block_id, r.r0) for r in headers.absorb_bands(above, two).collect()} == {(1, 1), (2, 6)}
    assert headers.absorb_bands(cells.limit(0), both.limit(0)).count() == 0


def test_repeated_and_doubtful_headers(spark):
    rows = put(1, 1, [["k", "Sales", "Cost"], ["a", "1", "2"], ["K", "sales", "cost"], ["b", "3", "4"]])
    body = spark.createDataFrame([(*r, 7, 1, 1) for r in rows], CELLS + ", block_id long, header_end int, label_end int")
    assert {r.row for r in headers.drop_repeated(body).select("row").distinct().collect()} == {1, 2, 4}
    assert headers.suspect_no_header(body).count() == 0
    numbers = spark.createDataFrame([(*r, 7, 1, 1) for r in put(1, 1, [["a", "1", "2"], ["b", "3", "4"]])], body.schema)
    assert headers.suspect_no_header(numbers).count() == 1
    twice = spark.createDataFrame([(*r, 7, 1, 1) for r in put(1, 1, [["k", "매출¹", "매출²"], ["a", "1", "2"]])], body.schema)
    assert [(r.key, r.columns) for r in headers.repeated_keys(twice).collect()] == [("매출", 2)]
    segments = spark.createDataFrame([("w", "s", 1, 1, 3, 1, 4, True), ("w", "s", 2, 6, 8, 2, 4, False), ("w", "s", 3, 6, 8, 9, 12, False)], BLOCKS + ", has_header boolean")
    assert {r.block_id: r.header_from for r in headers.propagate(segments).collect()} == {1: None, 2: 1, 3: None}


def test_subtotals_and_alarms(spark):
    rows = spark.createDataFrame([("p", "a", 1.0, False, "data"), ("p", "b", 2.0, False, "data"), ("p", "합계", 3.0, False, "data"), ("q", "통계", 3.0, True, "data"), ("q", "b", None, None, "data")], "period string, label string, value double, bold boolean, row_role string")
    assert {(r.period, r.label, r.score) for r in totals.score_subtotals(rows, ["period"]).filter("row_role = 'subtotal'").collect()} == {("p", "합계", 2)}
    tree = spark.createDataFrame([("s", 1, 0, 40.0, "subtotal"), ("s", 2, 1, 10.0, "data"), ("s", 3, 1, 20.0, "data"), ("s", 4, 0, 31.0, "subtotal"), ("s", 5, 1, 10.0, "data"), ("s", 6, 1, 20.0, "data")], "sheet string, src_row int, level int, value double, row_role string")
    assert [r.src_row for r in totals.subtotal_mismatches(tree, ["sheet"]).collect()] == [1]
    judged = spark.range(60).select((F.col("id") % 2).alias("workbook"), F.when(F.col("id") < 55, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    assert totals.reject_alarm(judged, []).count() == 1 and totals.reject_alarm(judged, ["workbook"]).count() == 0


def test_checks_fail_on_damage(spark):
    f = spark.createDataFrame([("a", True, "a = 1", 0), ("b", None, "b", 1), ("c", True, "", 1), ("d", True, "d", None)], "field string, declared boolean, header_text string, excluded_count int")
    assert {r.field for r in q.filters_declared(f).collect()} == {"b", "c", "d"}
    fact = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert not q.no_silent_drop(fact, ["k"]).first().ok and q.no_silent_drop(fact, ["k"], 3).first().ok and q.no_silent_drop(fact.limit(0), ["k"]).first().ok
    x = spark.createDataFrame([(5.0, 3.0, 2.0, 10.0), (11.5, -1.5, 0.0, 10.0), (5.0, 3.0, 0.0, 10.0), (None, 3.0, 0.0, 10.0)], "a double, b double, c double, t double")
    assert [r[0] for r in x.select(q.commitment(F.col("a"), F.col("b"), F.col("c"), F.col("t"))).collect()] == ["OK", "OVER_RECOGNIZED", "NOT_CONSERVED", "NOT_CONSERVED"]
    side = lambda *v: spark.createDataFrame(list(v), "k int, amount double")
    why = spark.createDataFrame([(2,)], "k int")
    assert {r.k: r.ok for r in q.master_to_ledger(side((1, 1.0), (2, 1.0), (3, 1.0)), side((1, 1.0), (2, 9.0)), ["k"], why).collect()} == {1: True, 2: True, 3: False}
    assert {r.k: r.ok for r in q.allocation_conserves(side((1, 4.0), (2, 4.0)), side((1, 1.0), (1, 3.0)), ["k"]).collect()} == {1: True, 2: False}
    axes = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "2")], "sheet string, axis string, key string")
    assert {(r.sheet, r.other) for r in dimensions.axis_conflicts(axes).collect()} == {("a", "c"), ("b", "c")}


def test_cell_rules(spark):
    c = spark.createDataFrame([("s", 1, 1, 5.0), ("s", 2, 1, 5000.0)], "sheet string, row int, col int, value double")
    rules = spark.createDataFrame([("s", 1, 1, "tie", 5.0), ("s", 2, 1, "magnitude", 5.0), ("s", 2, 1, "magnitude", 6.0), ("s", 9, 9, "tie", 0.0)], "sheet string, row int, col int, kind string, expected double")
    assert [r.ok for r in audit.cell_contract(c, rules).orderBy("row", "expected").collect()] == [True, False, True, False]
    digest = lambda df: df and audit.digest(df, ["sheet"], ["row", "value"]).first().digest
    assert digest(c) == digest(c.orderBy(F.desc("row"))) != digest(c.withColumn("value", F.col("value") + 1))
    v = spark.createDataFrame([(0.5,), (3.0,), (None,)], "v double")
    assert [r[0] for r in v.select(profile.in_band(F.col("v"), "share")).collect()] == [True, False, True]
    t = spark.createDataFrame([("2024.03",), ("4543.61",), ("2024-3-1",), ("2024.13",)], "x string")
    assert [r[0] for r in t.select(n.value_kind(F.col("x"))).collect()] == ["DATE", "NUM", "DATE", "NUM"]


def test_records_and_files(spark, tmp_path):
    r = spark.createDataFrame([("t", "A", "x", "202401", "i", "u", "1", 1), ("t", "A", "y", "202401", "i", "u", "2", 2), ("t", "B", "x", "202402", "i", "", "3", 3), ("t", "A", "x", "202401", "i", "u", "9", 4)], "table string, c1 string, c2 string, period string, item string, unit string, value string, ord int")
    w = records.wide_records(r, "table", ["c1", "c2"], ["2024.01|i", "2024.02|i"]).orderBy("ord").collect()
    assert [(x.c1_label, x.c2, x["2024.01|i"], x["2024.02|i"], x.unit) for x in w] == [("A", "x", "9", "-", "u"), ("", "y", "2", "-", "u"), ("B", "x", "-", "3", "u")]
    (tmp_path / "a.csv").write_bytes("﻿ k , v\n1,2\n3\n".encode())
    assert sorted(map(tuple, records.read_delimited(spark, str(tmp_path / "a.csv")).select("k", "v").collect())) == [("1", "2"), ("3", "")]
    many = spark.range(60).select(F.lit("K").alias("kind"), "id")
    top = records.findings_report(many, "kind", ["id"]).agg(F.count("*").alias("n"), F.max("total"), F.max("hidden")).first()
    assert tuple(top) == (50, 60, 10)
    assert dimensions.accepted_values(spark.createDataFrame([(None,), ("active",)], "status string"), {"status": dimensions.ACCEPTED["status"]}).first().n == 1
    assert pytest.approx(totals.accuracy(spark.createDataFrame([(1, 5.2)], "k int, value double"), spark.createDataFrame([(1, 5.0), (2, 1.0)], "k int, want double"), ["k"]).first().accuracy) == 0.5
