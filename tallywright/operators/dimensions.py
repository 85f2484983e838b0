"""Charts of accounts, nested records, accepted values and axes that sheets share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
# Accepted members of the dimensions.
ACCEPTED = {
    "scenario": ["Actual", "Budget", "FC1", "FC2", "PriorYear"],
    "behavior": ["fixed", "variable", "semi_fixed", "committed"],
    "domain": ["vehicle", "property", "utility", "fixed_parts"],
    "recurrence": ["monthly", "quarterly", "annual", "one_time"],
    "status": ["active", "terminated", "suspended"],
    "lifecycle": ["encumbered", "expended", "liquidated", "cancelled"],
}


def map_accounts(accounts: DataFrame, fallback: DataFrame, chart: DataFrame) -> DataFrame:
    """accounts(code, fs_line) by their own line, then the fallback's, then the chart's; unmapped stays null.

    fallback(code, fs_line) has unique codes; chart(code, fs_line, ord) may repeat one, and its last line counts.
    """
    last = chart.groupBy("code").agg(F.max_by("fs_line", "ord").alias("_chart"))
    j = accounts.join(fallback.withColumnRenamed("fs_line", "_fallback"), "code", "left").join(last, "code", "left")
    own = F.when(C("fs_line") != "", C("fs_line"))
    return j.withColumn("fs_line", F.coalesce(own, "_fallback", "_chart")).drop("_fallback", "_chart")


def chart_findings(chart: DataFrame, statements: list[str], signs: list[str]) -> DataFrame:
    """Code, problem, n of lines with a bad statement or sign, a parent that isn't there, or a repeated code."""
    codes = chart.select(C("code").alias("parent"), F.lit(True).alias("_there")).distinct()
    known = lambda c, of: F.coalesce(C(c).isin(of), F.lit(False))
    problems = F.array_compact(F.array(
        F.when(~known("statement", statements), "STATEMENT"), F.when(~known("sign", signs), "SIGN"), F.when(C("parent").isNotNull() & C("_there").isNull(), "PARENT"),
    ))
    rows = chart.join(codes, "parent", "left").select("code", F.explode(problems).alias("problem")).groupBy("code", "problem").agg(F.count("*").alias("n"))
    repeated = chart.groupBy("code").agg((F.count("*") - 1).alias("n")).filter("n > 0").select("code", F.lit("DUPLICATE").alias("problem"), "n")
    return rows.unionByName(repeated)


def assemble(rows: DataFrame, levels: list[str], item: Column) -> DataFrame:
    """One row per first key, with its members nested level by level, each sorted by key.

    A first key's whole tree is one value, so the key should bound it (a customer, not a region).
    """
    t = rows.groupBy(*levels).agg(F.sort_array(F.collect_list(item)).alias("items"))
    for k in range(len(levels) - 1, 0, -1):
        t = t.groupBy(*levels[:k]).agg(F.sort_array(F.collect_list(F.struct(C(levels[k]).alias("key"), C("items")))).alias("items"))
    return t


def accepted_values(table: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Field, value, n of values outside their list; null counts as outside."""
    v = table.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), C(f).cast("string").alias("value"), F.coalesce(C(f).isin(ok), F.lit(False)).alias("ok")) for f, ok in fields.items()))).alias("v")).select("v.*")
    return v.filter("not ok").groupBy("field", "value").agg(F.count("*").alias("n"))


def axis_conflicts(axes: DataFrame) -> DataFrame:
    """Axis and two sheets that both declare it without one common key. axes: sheet, axis, key.

    Pairs are of sheets of one report, which are few; the keys meet in an equi-join.
    """
    d = axes.select("sheet", "axis", "key").distinct()
    declared = d.select("sheet", "axis").distinct()
    other = lambda x: x.withColumnRenamed("sheet", "other")
    pairs = declared.join(other(declared), "axis").filter("sheet < other")
    shared = d.join(other(d), ["axis", "key"]).filter("sheet < other").select("axis", "sheet", "other").distinct()
    return pairs.join(shared, ["axis", "sheet", "other"], "left_anti")
