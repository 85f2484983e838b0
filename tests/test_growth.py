"""Steps that must hold at size: what is sent through the driver, how often texts are read, and sums of large amounts."""

import datetime
import random

from pyspark.sql import functions as F

from tallywright import plans
from tallywright.analyses import schedules
from tallywright.functions import normalize
from tallywright.operators import field_contracts, grid, profile

ASSET = "asset long, cost double, salvage double, life int, in_service int, first_factor double, dispose int, impair int, impair_to double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_assets(spark):
    return spark.createDataFrame([(k, 120.0 + k, 0.0, 12, 2 + k % 3, None, 5, None, None) for k in range(30)], ASSET)


def test_disposals_send_no_schedule_and_write_sold_months_alone(spark):
    a = some_assets(spark)
    sales = spark.createDataFrame([(k, 3 + k % 4, 50.0) for k in range(0, 33, 3)] + [(3, 99, 1.0)], "asset long, period int, price double")
    whole = schedules.disposal_results(schedules.asset_schedule(a, 1, 12), sales)
    alone = schedules.asset_schedule(a, 1, 12, sales)
    assert "Broadcast" not in plan(whole) and "Broadcast" not in plan(alone)
    assert alone.count() == 10
    assert sorted(map(str, whole.collect())) == sorted(map(str, schedules.disposal_results(alone, sales).collect()))


def test_ledger_ties_send_no_schedule(spark):
    s = schedules.asset_schedule(some_assets(spark), 1, 12)
    booked = s.filter("active and (asset + period) % 5 > 0").select("asset", "period", F.col("dep").alias("amount"))
    assert "Broadcast" not in plan(schedules.missing_accruals(s, booked))
    by_asset = plan(schedules.ledger_tie(s, booked)).split("SortMergeJoin")
    assert any("[asset" in x[:200] for x in by_asset[1:])
    lost = s.filter("active and (asset + period) % 5 = 0").count()
    assert sum(r.missing for r in schedules.ledger_tie(s, booked).collect()) == lost == schedules.missing_accruals(s, booked).count()


def test_base_gate_of_large_sums_shows_no_rounding(spark, tmp_path):
    r = random.Random(1)
    day = lambda k: datetime.datetime(1996, 1 + k % 12, 1)
    orders = [(k, k % 40, round(r.uniform(1e12, 1e13), 2), day(k)) for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 7) for k in range(40)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {x.check_name: (x.ok, x.detail) for x in plans.QUERIES["s8_base_gate"](spark, str(tmp_path)).collect()}
    assert got["conserved:value"] == (True, "0.0")


def test_reconcile_sees_a_cent_in_billions(spark):
    cells = spark.createDataFrame([("w", "s", k, 1, "12,345,678,901.25") for k in (1, 2)] + [("w", "s", 3, 1, "12.5억"), ("w", "s", 4, 1, "0")], "workbook string, sheet string, row int, col int, value_str string")
    v = {1: 12345678901.25, 2: 12345678901.26, 3: 1.25e9, 4: 0.0}
    rows = [("w", "s", k, 1, "t", x, 1, []) for k, x in v.items()]
    rows = spark.createDataFrame(rows, "workbook string, sheet string, src_row int, src_col int, raw_value string, value double, scale_applied long, flags array<string>")
    assert {r.row: r.status for r in grid.reconcile(cells, rows).collect()} == {1: "covered", 2: "mismatch", 3: "covered", 4: "covered"}


def test_specs_go_to_the_rows(spark):
    specs = spark.createDataFrame([("a", "count", None, None, None, None, None, None, None)], field_contracts.SPECS)
    rows = spark.createDataFrame([("a", -1.0), ("a", 2.0), ("b", 1.0)], "field string, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = field_contracts.judge_fields(rows, specs)
        assert "hashpartitioning(field" not in plan(judged)
        assert sorted((r.value, r.status) for r in judged.collect()) == [(-1.0, "VIOLATION"), (2.0, "OK")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_columns_are_read_by_distinct_values(spark):
    rows = [(i // 3, "n/a" if i % 4 == 0 else f"{i % 4}.5%", None if i % 5 == 0 else f"2024-0{i % 3 + 1}", float(i % 2) * 1e9) for i in range(60)]
    t = spark.createDataFrame(rows, "k long, p string, d string, x double")
    s = profile.column_stats(t, t.columns)
    assert "Expand" not in plan(s) and plan(profile.profile(t, t.columns)).count("Scan") == plan(s).count("Scan")
    got = {r.column: (r.n, r.nulls, r.dates, r.numbers, r.card, r.whole, r.low, r.high) for r in s.collect()}
    assert got["k"] == (60, 0, 0.0, 1.0, 20, True, 0.0, 19.0)
    assert got["p"] == (60, 0, 0.0, 1.0, 4, False, 0.015, 0.035)
    assert got["d"] == (60, 12, 1.0, 0.0, 3, False, None, None)
    assert got["x"] == (60, 0, 0.0, 1.0, 2, True, 0.0, 1e9)


def test_amounts_of_stored_numbers(spark):
    t = spark.createDataFrame([(float("nan"), 1, "5%"), (float("inf"), None, "(2)"), (-1.5e12, 7, "x"), (None, -3, None)], "x double, k int, s string")
    for c in t.columns:
        made = t.select(profile.amount(t, c).alias("a"), normalize.lenient(F.col(c).cast("string")).alias("b")).collect()
        assert [r.a for r in made] == [r.b for r in made], c
    assert "rlike" not in plan(profile.trend(t, F.lit("p"), ["x", "k"])).lower()


def test_plain_digits_skip_the_long_patterns(spark):
    texts = ["12", "-0.5", "007", "-05", "1e5", "2024.03", "12억", "(3천)", "x", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    v = normalize.number(F.col("x"))
    got = t.select("i", v["value"].alias("v"), v["scale"].alias("s"), normalize.value_kind(F.col("x")).alias("k")).orderBy("i").collect()
    assert [r.v for r in got] == [12.0, -0.5, None, -5.0, 1e5, 2024.03, 1.2e9, -3000.0, None, None]
    assert [r.s for r in got] == [1, 1, 1, 1, 1, 1, 10**8, 1000, 1, 1]
    assert [r.k for r in got] == ["NUM", "NUM", "TEXT", "NUM", "NUM", "DATE", "NUM", "NUM", None, None]
    assert "(?!0" in str(v)


def test_grid_steps_send_no_cells(spark):
    kind = "workbook string, sheet string, row int, col int, value_str string, merge_row int, merge_col int"
    cells = spark.createDataFrame([("w", f"s{s}", r, c, f"{r}.5", None, None) for s in range(3) for r in range(1, 5) for c in (1, 2)], kind)
    full = grid.filled(grid.unmerge(cells))
    found = grid.blocks(full)
    placed = grid.in_blocks(full, found)
    for step in (full, found, placed, grid.strip_titles(placed)):
        assert "Broadcast" not in plan(step)
    assert sorted((r.sheet, r.r0, r.c0, r.r1, r.c1) for r in found.collect()) == [(f"s{s}", 1, 1, 4, 2) for s in range(3)]
