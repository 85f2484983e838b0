"""Profiles of tables: roles and kinds of columns, shapes of measures and choices, and rule-based tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.normalize import lenient, number, value_kind

C = F.col


def _distinct(table: DataFrame, column: str) -> DataFrame:
    """column, v (text) and k, how many rows have it: the values are counted as they are stored and become text after that."""
    as_is = isinstance(table.schema[column].dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType))
    v = C(column) if as_is else C(column).cast("string")
    return table.groupBy(v.alias("v")).agg(F.count("*").alias("k")).select(F.lit(column).alias("column"), C("v").cast("string").alias("v"), "k")


def column_stats(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, shares of dates and numbers, and distinct values of each column. Each column is counted by its values, so
    that texts are read once for each distinct value and not for each row."""
    each = reduce(DataFrame.unionByName, (_distinct(table, c) for c in columns))
    kinds = each.withColumns({"t": value_kind(C("v")), "x": number(C("v"))["value"]})
    rows = lambda when: F.coalesce(F.sum(F.when(when, C("k"))), F.lit(0))
    share = lambda *t: F.coalesce(rows(C("t").isin(*t)) / F.sum(F.when(C("t").isNotNull(), C("k"))), F.lit(0.0))
    return kinds.groupBy("column").agg(F.sum("k").alias("n"), rows(C("v").isNull()).alias("nulls"), share("DATE").alias("dates"), share("NUM", "PCT").alias("numbers"), F.count("v").alias("card"), F.coalesce(F.bool_and(C("x") == F.floor("x")), F.lit(False)).alias("whole"), F.min("x").alias("low"), F.max("x").alias("high"))


def amount(table: DataFrame, column: str) -> Column:
    """A column's numbers, zero for what is none: `lenient` of its text, which a stored number needn't become."""
    kind = table.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.DoubleType, T.DecimalType)):
        return lenient(C(column).cast("string"))
    x = C(column).cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def roles(stats: DataFrame) -> DataFrame:
    """Time, measure, dimension or id."""
    number = F.when((C("card") <= 20) & (C("card") / C("n") <= 0.5), "dimension").otherwise("measure")
    return stats.withColumn("role", F.when(C("dates") >= 0.8, "time").when(C("numbers") >= 0.8, number).when(C("card") > 0.9 * C("n"), "id").otherwise("dimension"))


def kinds(stats: DataFrame) -> DataFrame:
    """P5: date, measure, choice or key. Numbers are a key if they are whole, unique, not negative and dense: their range is at
    most one and a half times their count. Amounts spread wider."""
    dense = C("whole") & (C("card") == C("n") - C("nulls")) & (C("low") >= 0) & (C("high") - C("low") + 1 <= 1.5 * C("card"))
    return stats.withColumn("kind", F.when(C("dates") >= 0.8, "date").when(C("numbers") >= 0.8, F.when(dense, "key").otherwise("measure")).when(C("card") > 50, "key").otherwise("choice"))


def recommend(roles_: DataFrame) -> DataFrame:
    """Roles of a table grouped, and the output they suit."""
    g = roles_.agg(F.count_if(C("role") == "measure").alias("m"), F.count_if(C("role") == "time").alias("t"), *(F.sort_array(F.collect_list(F.when(C("role") == r, C("column")))).alias(r) for r in ("time", "measure", "dimension", "id")))
    return g.withColumn("output", F.when(C("m") == 0, "listing").when(C("t") > 0, "trend").when(C("m") >= 2, "variance").otherwise("listing")).drop("m", "t")


def workbook_verdict(sheets: DataFrame, edges: DataFrame) -> DataFrame:
    """Workbook and kind: linked if any sheet's formulas refer to another, else none, single or multi by its sheets with data.

    sheets: workbook, sheet, output (null: no data). edges: workbook, from, to; one from a
    sheet to itself links nothing.
    """
    g = sheets.groupBy("workbook").agg(F.count("output").alias("with_data"))
    linked = edges.filter(C("from") != C("to")).groupBy("workbook").agg(F.count("*").alias("links"))
    kind = F.when(C("with_data") == 0, "none").when(C("links") > 0, "linked").when(C("with_data") == 1, "single").otherwise("multi")
    return g.join(linked, "workbook", "left").fillna(0, ["links"]).withColumn("kind", kind)


def measure_shape(series: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """Trend per step, noise and AR(1) of a monthly series, from a log-linear fit; rates of nulls, negatives, zeros."""
    s = series.withColumn("_y", F.ln(F.when(C(value) > 0, C(value))))
    fit = s.groupBy(*keys).agg(F.regr_slope("_y", ord_).alias("b"), F.regr_intercept("_y", ord_).alias("a"), F.avg(C(value).isNull().cast("int")).alias("null_rate"), F.avg((C(value) < 0).cast("int")).alias("negative_rate"), F.avg((C(value) == 0).cast("int")).alias("zero_rate"))
    r = s.join(fit.select(*keys, "a", "b"), keys).withColumn("_r", C("_y") - C("a") - C("b") * C(ord_))
    month = r.withColumn("_r", C("_r") - F.avg("_r").over(Window.partitionBy(*keys, C(ord_) % 12)))
    lagged = month.withColumn("_p", F.lag("_r").over(Window.partitionBy(*keys).orderBy(ord_)))
    noise = lagged.groupBy(*keys).agg(F.stddev_samp("_r").alias("noise"), F.corr("_r", "_p").alias("ar1"))
    return fit.join(noise, keys).select(*keys, (F.exp("b") - 1).alias("trend"), "noise", "ar1", "null_rate", "negative_rate", "zero_rate")


def choice_shape(table: DataFrame, column: str) -> DataFrame:
    """How many members of a choice have each weight, without names; a row per weight."""
    g = table.groupBy(column).count()
    total = g.agg(F.sum("count").alias("total"), F.count("*").alias("card"))  # one row
    return g.groupBy("count").agg(F.count("*").alias("members")).crossJoin(F.broadcast(total)).select("card", F.round(C("count") / C("total"), 4).alias("weight"), "members")


def correlation(a: str, b: str, pairs: int = 3, least: float = 0.1) -> Column:
    """P8, an aggregate: null with too few pairs or too weak."""
    r = F.corr(a, b)
    return F.when((F.count_if(C(a).isNotNull() & C(b).isNotNull()) >= pairs) & (F.abs(r) >= least), r)


def tag(texts: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The tag whose patterns hit most; the first rule wins ties; null without a hit. Rules are a short literal."""
    hits = F.array(*(F.struct(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).alias("hits"), F.lit(-k).alias("o"), F.lit(name).alias("tag")) for k, (name, p) in enumerate(rules)))
    return texts.withColumn("_h", F.array_max(hits)).select(key, F.when(C("_h.hits") > 0, C("_h.tag")).alias("tag"), C("_h.hits").alias("hits"))


def date_range(table: DataFrame, day: str) -> DataFrame:
    """First and last month."""
    m = lambda f: F.date_format(F.trunc(f(C(day)), "month"), "yyyy-MM")
    return table.agg(m(F.min).alias("first_month"), m(F.max).alias("last_month"))


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """P10: a row per column with its kind, role and rates, without members or absolute values."""
    s = roles(kinds(column_stats(table, columns)))
    return s.select("column", "n", "card", F.round(C("nulls") / C("n"), 6).alias("null_rate"), "kind", "role")


def trend(table: DataFrame, period: Column, measures: list[str]) -> DataFrame:
    """Sums of the measures per period; what isn't a number counts as zero."""
    return table.groupBy(period.alias("period")).agg(*(F.sum(amount(table, m)).alias(m) for m in measures))


def listing(table: DataFrame, by: str | None, measures: list[str]) -> DataFrame:
    """Number of rows and sums of the measures per group and in all; `is_total` marks the last."""
    sums = [F.count("*").alias("n_rows"), *(F.sum(amount(table, m)).alias(m) for m in measures)]
    if by is None:
        return table.agg(*sums).withColumns({"label": F.lit(None).cast("string"), "is_total": F.lit(True)})
    named = table.select(C(by).cast("string").alias("label"), *measures)
    return named.rollup("label").agg(*sums, (F.grouping("label") == 1).alias("is_total"))


def variance(table: DataFrame, label: str | None, plan: str, actual: str) -> DataFrame:
    """Plan, actual and their difference per label."""
    of = C(label).cast("string") if label else F.lit("all")
    g = table.groupBy(of.alias("label")).agg(*(F.sum(amount(table, m)).alias(m) for m in (plan, actual)))
    return g.withColumn("difference", C(actual) - C(plan))


def bind(table: DataFrame, output: str | None = None) -> tuple[str, DataFrame, list[str]]:
    """The output that the roles of an unknown table's columns suit (or the one named), made from it, and the measures
    that it sums. Roles come from a count of each column's values; only the names of its columns come to the driver.

    A trend goes by the first time column; a listing by the first dimension; a variance takes the first two measures as plan
    and actual by the first dimension or id. What can't be made as named is listed.
    """
    summed = recommend(roles(column_stats(table, table.columns))).first()
    named = {r: [c for c in table.columns if c in summed[r]] for r in ("time", "measure", "dimension", "id")}
    kind, measures = output or summed["output"], named["measure"]
    if kind == "trend" and named["time"] and measures:
        return kind, trend(table, C(named["time"][0]).cast("string"), measures), measures
    if kind == "variance" and len(measures) >= 2:
        return kind, variance(table, next(iter(named["dimension"] + named["id"]), None), *measures[:2]), measures[:2]
    return "listing", listing(table, next(iter(named["dimension"]), None), measures), measures


def sums_conserved(table: DataFrame, made: DataFrame, measures: list[str], tol: float = 0.5) -> DataFrame:
    """Measure, source and output sums and whether they tie. A listing's total isn't added to its groups'."""
    if "is_total" in made.columns:
        alone = made.filter("not is_total")
        made = alone if not alone.isEmpty() else made

    def total(df: DataFrame) -> DataFrame:
        return df.agg(*(F.coalesce(F.sum(amount(df, m)), F.lit(0.0)).alias(m) for m in measures)).unpivot([], measures, "measure", "v")

    j = total(table).withColumnRenamed("v", "source").join(total(made).withColumnRenamed("v", "output"), "measure")
    return j.withColumn("ok", F.abs(C("source") - C("output")) <= tol)


# Plausible bands of kinds of quantity.
BANDS = {
    "rate": (-0.5, 2.0), "pct": (-1.0, 1.0), "margin": (-2.0, 1.0), "growth": (-1.0, 10.0), "multiple": (-100.0, 100.0),
    "ratio": (0.0, 1000.0), "share": (0.0, 1.0), "dscr": (1.0, 5.0), "terminal_growth": (-0.02, 0.05),
}


def in_band(value: Column, kind: str) -> Column:
    """Null and a kind without a band pass."""
    return F.coalesce(value.between(*BANDS[kind]), F.lit(True)) if kind in BANDS else F.lit(True)
