"""Contract checks: each returns findings or rows for a checks table (check_name, ok, detail)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallywright.operators.lineage import settle

C = F.col


def check(name: str, ok: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail")]


def missing_periods(fact: DataFrame, ruler: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Q1, Q16: each key's periods of the ruler that the fact lacks."""
    grid = fact.select(*keys).distinct().crossJoin(ruler.select(period).distinct())
    return grid.join(fact.select(*keys, period).distinct(), [*keys, period], "left_anti")


def full_outer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Q2: null keys match, presence decides match_status; columns of both sides must differ apart from the keys."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True)).withColumnsRenamed({k: f"_r_{k}" for k in on})
    j = a.join(b, reduce(Column.__and__, [C(k).eqNullSafe(C(f"_r_{k}")) for k in on]), "full")
    status = F.when(C("_l") & C("_r"), "MAPPED").when(C("_l"), "LEFT_ONLY").otherwise("RIGHT_ONLY")
    return j.withColumn("match_status", status).withColumns({k: F.when(C("_l"), C(k)).otherwise(C(f"_r_{k}")) for k in on}).drop("_l", "_r", *(f"_r_{k}" for k in on))


def last_wins(table: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """One row for each key: the one with the greatest ord."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), ord_).alias("_x")).select(*keys, "_x.*")


def grain(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat or are null, with the reason."""
    null = reduce(Column.__or__, [C(k).isNull() for k in keys])
    return fact.groupBy(*keys).agg(F.count("*").alias("n")).filter(null | (C("n") > 1)).withColumn("reason", F.when(null, "NULL_KEY").otherwise("DUPLICATE"))


def tie_out(source: Column, output: Column, tol: float) -> Column:
    """Q5: null fails."""
    return F.coalesce(F.abs(source - output) <= tol, F.lit(False))


def cross_tab(fact: DataFrame, index: DataFrame, columns: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """Q7: every declared row times every declared column; null where the fact has nothing."""
    cells = fact.groupBy(row, column).agg(value.alias("value"))
    return index.select(row).distinct().crossJoin(columns.select(column).distinct()).join(cells, [row, column], "left")


def ratio(num: Column, den: Column, unit: Column | None = None, expected: Column | None = None) -> Column:
    """Q18: value, or a reason: another unit before a missing numerator before a zero or missing denominator."""
    reason = F.when(num.isNull(), "MISSING_NUM").when(den.isNull() | (den == 0), "ZERO_DENOM")
    if unit is not None:
        reason = F.when(~unit.eqNullSafe(expected), "UNIT_MISMATCH").otherwise(reason)
    return F.struct(F.when(reason.isNull(), F.try_divide(num, den)).alias("value"), reason.alias("reason"))


def sign_steps(series: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """Q17: values against the mean of what came before, of the other sign and at least half as large."""
    before = F.avg(value).over(Window.partitionBy(*keys).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn("prior_mean", before).filter((F.signum(value) * F.signum("prior_mean") < 0) & (F.abs(C(value)) >= 0.5 * F.abs(C("prior_mean"))))


def elasticity(series: DataFrame, keys: list[str], cost: str, volume: str, limit: float = 0.3) -> DataFrame:
    """Q17: slope at the means; a cost told to be fixed is mislabelled above the limit."""
    e = F.try_divide(F.regr_slope(cost, volume) * F.avg(volume), F.avg(cost))
    return series.groupBy(*keys).agg(e.alias("elasticity")).withColumn("mislabeled", F.coalesce(C("elasticity") > limit, F.lit(False)))


def field_contract(value: Column, nullable: bool = True, accepted: list | None = None, low: float | None = None, high: float | None = None, sign: int | None = None) -> Column:
    """Q20: OK, NO_DATA or VIOLATION of one field."""
    tests = [F.lit(False)]
    tests += [~value.isin(accepted)] if accepted is not None else []
    tests += [value < low] if low is not None else []
    tests += [value > high] if high is not None else []
    tests += [F.signum(value) == -sign] if sign is not None else []
    return F.when(value.isNull(), "NO_DATA" if nullable else "VIOLATION").when(reduce(Column.__or__, tests), "VIOLATION").otherwise("OK")


def rollup_tree(nodes: DataFrame, node: str = "node", parent: str = "parent", value: str = "value") -> DataFrame:
    """Node, total of its own value and all below, and whether it is in a cycle (its total is null then).

    Pointers double: after k rounds a node has the sum of what is less than 2 ** k levels below it and its ancestor 2 ** k
    levels up, whose next sum takes this one. A chain of n nodes takes log2(n) rounds. Pointers that never end lead into
    cycles, and land on all their nodes. Repeated nodes add up; a parent that isn't there is none.
    """
    own = nodes.groupBy(C(node).alias("node")).agg(F.sum(value).alias("total"), F.min(parent).alias("up"))
    there = own.select(C("node").alias("up"), F.lit(True).alias("there"))
    state = settle(own.join(there, "up", "left").select("node", "total", F.when(C("there"), C("up")).alias("up")))
    many, reach = state.count(), 1
    while reach <= many and not state.filter("up is not null").isEmpty():
        below = state.filter("up is not null").groupBy(C("up").alias("node")).agg(F.sum("total").alias("more"))
        further = state.select(C("node").alias("up"), C("up").alias("next"))
        moved = state.join(below, "node", "left").join(further, "up", "left")
        state = settle(moved.select("node", F.when(C("more").isNull(), C("total")).otherwise(C("total") + C("more")).alias("total"), C("next").alias("up")))
        reach *= 2
    cycle = state.filter("up is not null").select(C("up").alias("node")).distinct().withColumn("in_cycle", F.lit(True))
    out = state.join(cycle, "node", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    return out.select("node", F.when(~C("in_cycle"), C("total")).alias("total"), "in_cycle")


def hierarchy_ties(nodes: DataFrame, tol: float = 0.01, node: str = "node", parent: str = "parent", value: str = "value") -> DataFrame:
    """Q11, one row: the sum of all values, whether the totals of the nodes without a parent tie to it, and how many nodes
    name a parent that isn't there or are in a cycle. What hangs below those is missing from the totals."""
    rolled = rollup_tree(nodes, node, parent, value)
    roots = nodes.filter(C(parent).isNull()).select(C(node).alias("node")).distinct()
    top = rolled.join(roots, "node", "left_semi").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("top"))
    known = nodes.select(C(node).alias("_p")).distinct()
    orphans = nodes.filter(C(parent).isNotNull()).join(known, C(parent) == C("_p"), "left_anti").agg(F.count("*").alias("orphans"))
    cycles = rolled.agg(F.count_if("in_cycle").alias("in_cycle"))
    # Each side is one row.
    one = nodes.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("leaf_sum")).crossJoin(top).crossJoin(orphans).crossJoin(cycles)
    return one.select("leaf_sum", tie_out(C("leaf_sum"), C("top"), tol).alias("ok"), "orphans", "in_cycle")


def leaves(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """D6."""
    return nodes.join(nodes.select(C(parent).alias("_p")).distinct(), C(node) == C("_p"), "left_anti")


def fiscal_calendar(spark, first: int, last: int, start_month: int = 1) -> DataFrame:
    """Months from year*12+month-1 numbers first to last, with fiscal year, period, quarter, label, cutoff."""
    c = spark.range(first, last + 1).withColumnRenamed("id", "ym")
    fm = C("ym") - (start_month - 1)
    c = c.withColumns({"fy": F.floor(fm / 12) + F.lit(1 if start_month > 1 else 0), "period": fm % 12 + 1})
    day = F.last_day(F.make_date(F.floor(C("ym") / 12).cast("int"), (C("ym") % 12 + 1).cast("int"), F.lit(1)))
    return c.withColumns({"quarter": F.floor((C("period") - 1) / 3) + 1, "cutoff": day, "label": F.format_string("FY%d-P%02d", "fy", "period"), "ordinal": C("fy") * 12 + C("period") - 1})


def calendar_445(spark, anchor: str, years: int, pattern: tuple[int, int, int] = (4, 4, 5)) -> DataFrame:
    """Cutoffs of 52-week years of 13-week quarters."""
    weeks = [sum(([*pattern] * 4)[: k + 1]) for k in range(12)]
    grid = spark.range(years * 12).select((C("id") / 12).cast("int").alias("y"), (C("id") % 12 + 1).cast("int").alias("period"))
    cut = F.element_at(F.array(*map(F.lit, weeks)), C("period"))
    return grid.select((C("y") + 1).alias("fy"), "period", F.date_add(F.lit(anchor).cast("date"), C("y") * 364 + cut * 7 - 1).alias("cutoff"))


def publish(table: DataFrame, checks: dict[str, Column], path: str, filters: dict[str, Column] | None = None, force: bool = False) -> bool:
    """Write the rows of the table to `path` only if every check holds for them, or when forced.

    checks: aggregates over the table's rows that give true or false (null fails). filters: conditions by name; a row that
    one of them excludes isn't written but counted. One pass writes the rows to a staging folder and observes checks and
    counts on the very rows that it writes, so nothing can change between the two; the folder is then renamed, or removed.
    What was observed goes to `<path>_checks` (check_name, ok, detail) either way; what stood in `path` before stays if a
    check fails.
    """
    spark, filters = table.sparkSession, filters or {}
    staged, seen, kept = f"{path}_staged_{uuid.uuid4().hex}", Observation(f"rows_{uuid.uuid4().hex}"), Observation(f"kept_{uuid.uuid4().hex}")
    rows = table
    if filters:
        rows = rows.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in filters.items()))
        rows = rows.filter(~reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in filters.values())))
    rows = rows.observe(kept, F.count(F.lit(1)).alias("rows written"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    rows.write.parquet(staged)
    held, excluded = kept.get, seen.get if filters else {}
    said = [("rows written", True, str(held["rows written"]))] + [(k, bool(held[k]), "") for k in checks] + [(f"excluded: {k}", True, str(n)) for k, n in excluded.items()]
    spark.createDataFrame(said, "check_name string, ok boolean, detail string").coalesce(1).write.mode("overwrite").parquet(f"{path}_checks")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, to = jvm(staged), jvm(path)
    files, good = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), force or all(ok for _, ok, _ in said)
    if not good:
        files.delete(at, True)
        return False
    files.delete(to, True)
    if not files.rename(at, to):
        raise OSError(f"{staged} can't be renamed to {path}")
    return True


def filters_declared(filters: DataFrame) -> DataFrame:
    """Q6: filters(field, declared, header_text, excluded_count) with any of the three missing."""
    whole = F.coalesce(C("declared"), F.lit(False)) & (F.coalesce("header_text", F.lit("")) != "") & C("excluded_count").isNotNull()
    return filters.filter(~whole).select("field")


def no_silent_drop(fact: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """Q8: the row count as expected, or else no repeated key."""
    n = fact.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))
    ok = C("rows") == (C("keys") if expected is None else F.lit(expected))
    return n.select(*check("no_silent_drop", ok, F.concat_ws("/", "rows", "keys")))


def gate(*checks: DataFrame) -> DataFrame:
    """Q8: all checks as one table."""
    return reduce(DataFrame.unionByName, checks)


def master_to_ledger(master: DataFrame, ledger: DataFrame, keys: list[str], reasons: DataFrame, tol: float = 0.0) -> DataFrame:
    """Q12: sums of both sides per key; a difference needs reasons(keys). master and ledger: keys, amount."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("amount").alias(name))
    j = full_outer(total(master, "master"), total(ledger, "ledger"), keys)
    why = reasons.groupBy(*keys).agg(F.count("*").alias("reasons"))
    j = j.join(why, keys, "left").fillna({"master": 0.0, "ledger": 0.0, "reasons": 0})
    return j.withColumn("ok", (F.abs(C("master") - C("ledger")) <= tol) | (C("reasons") > 0))


def allocation_conserves(before: DataFrame, after: DataFrame, keys: list[str], tol: float = 0.0) -> DataFrame:
    """Q13: pools before and after allocation. Both: keys, amount."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("amount").alias(name))
    j = full_outer(total(before, "pre"), total(after, "post"), keys).fillna({"pre": 0.0, "post": 0.0})
    return j.withColumn("ok", F.abs(C("pre") - C("post")) <= tol)


def commitment(recognized: Column, remaining: Column, cancelled: Column, total: Column, tol: float = 0.0) -> Column:
    """Q14: OK, OVER_RECOGNIZED or NOT_CONSERVED; a null fails."""
    kept = tie_out(recognized + remaining + cancelled, total, tol)
    return F.when(recognized > total + tol, "OVER_RECOGNIZED").when(~kept, "NOT_CONSERVED").otherwise("OK")


def anomalies_conserved(ledger: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Q15: findings of each type against those that the output shows. Both: anomaly_type."""
    count = lambda df, name: df.groupBy("anomaly_type").agg(F.count("*").alias(name))
    j = count(ledger, "ledger").join(count(surfaced, "surfaced"), "anomaly_type", "full").fillna(0)
    return j.withColumn("ok", C("ledger") == C("surfaced"))


def recurrence(active: DataFrame, fact: DataFrame, key: str, period: str) -> DataFrame:
    """Q16: expected periods without a fact. active: key, start, stop (both included), every (months)."""
    grid = active.filter("start <= stop").select(key, F.explode(F.sequence("start", "stop", "every")).alias(period))
    return grid.join(fact.select(key, period).distinct(), [key, period], "left_anti").withColumn("anomaly_type", F.lit("MISSING_ACCRUAL"))
