"""Every registered query against its SQL in DuckDB on the smallest tables, and the formulas that were wrong before."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallywright import plans
from tallywright.analyses import funding
from tallywright.functions import finance as fin
from tallywright.functions import normalize as n
from tallywright.operators import audit, components, grid, profile

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def shown(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float) or x.__class__.__name__ == "Decimal":
        return "nan" if math.isnan(x) else f"{float(x):.4g}"
    return f"{float(x):.4g}" if isinstance(x, int) else str(x)


@pytest.mark.parametrize("name", sorted(set(plans.SQL) & (set(vars(plans.packs)) | set(vars(plans.values))) | {"t16_invariants", "b16_grid_to_tidy", "t11_ingest_summary", "k7_scenario_sensitivity", "f2_irr", "f11_depreciation_events", "k17_runrate_normalized", "k24_step_down_allocation", "p5_kinds", "p6_measure_shape", "p7_choice_shape", "p10_profile", "q7_cross_tab", "x6_formula_consistency", "x9_text_in_numbers"}))
def test_queries_equal_their_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    rows = lambda all_, names: sorted(tuple(shown(r[names.index(c)]) for c in order) for r in all_)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_rate_of_return_takes_either_sign(spark):
    f = spark.createDataFrame([(1, 0, 1000.0), (1, 1, -600.0), (1, 2, -600.0), (2, 0, -1000.0), (2, 1, 600.0), (2, 2, 600.0), (3, 0, 1.0), (3, 1, 1.0)], "k int, t int, cash double")
    got = {r.k: r.irr for r in fin.irr(f, "k").collect()}
    assert got[1] == pytest.approx(0.1306624) and got[2] == pytest.approx(0.1306624) and got[3] is None


def test_amounts_are_no_keys(spark):
    t = spark.createDataFrame([(i, 100.5 + 37 * i, 1000 * i * i, f"t{i}") for i in range(200)], "id int, amount double, wide long, name string")
    assert {r.column: r.kind for r in profile.kinds(profile.column_stats(t, t.columns)).collect()} == {"id": "key", "amount": "measure", "wide": "measure", "name": "key"}


def test_short_units_and_missing_values(spark):
    x = spark.createDataFrame([("3,400억",), ("2조",), ("없음",), ("ns",)], "x string")
    assert [r[0] for r in x.select(n.number(F.col("x"))["value"]).collect()] == [3400e8, 2e12, None, None]


def test_revolver_sweeps_in_order(spark):
    p = spark.createDataFrame([(1, 1, -800.0), (1, 2, -500.0), (1, 3, 1800.0), (2, 1, 900.0)], "model int, k int, flow double")
    f = spark.createDataFrame([(1, 1000.0, 500.0, 1e6, True), (2, 1000.0, 500.0, 1e6, False)], "model int, cash0 double, floor double, top double, sweep boolean")
    t = spark.createDataFrame([(m, name, o, r, k) for m in (1, 2) for name, o, r, k in (("revolver", 0.0, 0.01, 1), ("term", 2000.0, 0.008, 2))], "model int, name string, opening double, rate double, rank int")
    r = {(x.model, x.k): x for x in funding.solve(p, f, t).collect()}
    assert r[1, 1].cash == pytest.approx(500) and r[1, 2].cash == pytest.approx(500) and r[1, 1].draw > 0
    assert r[1, 3].revolver == 0 and 0 < r[1, 3].debt < 2000 and r[1, 3].cash == pytest.approx(500)
    assert r[1, 1].interest == pytest.approx(0.01 * r[1, 1].revolver / 2 + 0.008 * 2000)
    assert r[2, 1].repay == 0 and r[2, 1].cash == pytest.approx(1000 + 900 - 16)


def test_components_by_either_way(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 7), (7, 8), (4, 4), (10, 1)], "a long, b long")
    roots = lambda one: {r.node: r.root for r in components.components(edges, one).collect() if r.node != r.root}
    assert roots(0) == roots(100) == {2: 1, 3: 1, 10: 1, 8: 7, 9: 7}


def test_claims_against_all_pairs(spark):
    texts = spark.createDataFrame([(1, "paid 1,000 in 2024, then 99.9 and 5"), (2, "about 1000.9 or 123"), (3, None)], "k int, text string")
    facts = spark.createDataFrame([(1000.0,), (100.0,)], "v double")
    got = {(r.k, r.raw): r.verified for r in audit.claims(texts, "k", F.col("text"), facts, "v").collect()}
    assert got == {(1, "1,000"): True, (1, "99.9"): True, (2, "1000.9"): True, (2, "123"): False}


def test_red_and_formats(spark):
    c = spark.createDataFrame([("FFFF0000",), ("C00000",), ("00FF00",), (None,)], "rgb string")
    assert [r[0] for r in c.select(grid.is_red(F.col("rgb"))).collect()] == [True, True, False, False]
    rows = [("w", "s", 1, 2, "1000", "#,##0"), ("w", "s", 1, 2, "600", "0.00"), ("w", "s", 1, 3, "7", "@"), ("w", "s", 1, 4, "5%", "0%"), ("w", "s", 1, 4, "5", "General")]
    long = spark.createDataFrame(rows, "workbook string, sheet string, block_id long, col int, value_str string, number_format string")
    assert {(r.col, r.kind) for r in grid.column_findings(long).collect()} == {(2, "MIXED_NUMBER_FORMAT"), (3, "TEXT_AS_NUM_SUSPECT")}
