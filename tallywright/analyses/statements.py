"""Three statements, returns, consolidation, forecasts, cohorts and appraisals as functions of any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import finance as fin
from tallywright.operators.checks import ratio, tie_out

C = F.col


def variance(items: DataFrame, order: str, plan: str = "plan", actual: str = "actual", cost: str | None = None, report: tuple[str, ...] = ()) -> DataFrame:
    """K1: items with delta, delta_pct, signed (a cost's overrun counts against), base and cum of a bridge per report."""
    p, a = F.coalesce(C(plan), F.lit(0.0)), F.coalesce(C(actual), F.lit(0.0))
    signed = C("delta") if cost is None else F.when(C(cost), -C("delta")).otherwise(C("delta"))
    b = items.withColumn("delta", a - p).withColumn("delta_pct", fin.variance_pct(a, p)).withColumn("signed", signed)
    b = b.withColumn("cum", F.sum("signed").over(Window.partitionBy(*report).orderBy(order)))
    return b.withColumn("base", F.least("cum", C("cum") - C("signed")))


def check_variance(result: DataFrame, order: str, plan: str = "plan", actual: str = "actual", report: tuple[str, ...] = (), tol: float = 0.01) -> DataFrame:
    """K1: per report whether both scenarios have every item (R9) and the bridge ends at the signed total."""
    g = result.groupBy(*report).agg(F.count_if(C(plan).isNull() | C(actual).isNull()).alias("unmatched"), F.sum("signed").alias("total"), F.max_by("cum", order).alias("end"))
    return g.select(*report, "unmatched", (C("unmatched") == 0).alias("aligned"), tie_out(C("total"), C("end"), tol).alias("bridge_ok"))


def check_ruler(series: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Keys with how many periods they lack between their first and last one."""
    g = series.groupBy(*keys).agg(F.min(period).alias("first"), F.max(period).alias("last"), F.countDistinct(period).alias("n"))
    return g.select(*keys, (C("last") - C("first") + 1 - C("n")).alias("missing")).withColumn("ok", C("missing") == 0)


def check_partition(rows: DataFrame, keys: list[str], period: str, kind: str = "class") -> DataFrame:
    """K3: per key whether actuals and forecasts exclude each other, cover every period and don't mix."""
    p = rows.groupBy(*keys, period).agg(F.count_if(C(kind) == "actual").alias("a"), F.count_if(C(kind) == "forecast").alias("f"))
    g = p.groupBy(*keys).agg(
        F.count_if((C("a") > 0) & (C("f") > 0)).alias("both"), F.count_if((C("a") == 0) & (C("f") == 0)).alias("neither"),
        F.max(F.when(C("a") > 0, C(period))).alias("cut"), F.min(F.when(C("f") > 0, C(period))).alias("open"), (F.max(period) - F.min(period) + 1 - F.count("*")).alias("gaps"),
    )
    late = F.coalesce(C("open") > C("cut"), F.lit(True))
    return g.select(*keys, (C("both") == 0).alias("exclusive"), ((C("neither") == 0) & (C("gaps") == 0)).alias("exhaustive"), late.alias("contiguous"))


def statements(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """K8: gross to net income (tax on a profit alone), retained earnings, cash by the indirect way and both sides of the balance sheet.

    df: revenue, cogs, sga, da, interest, tax_rate, dividends, delta_nwc by period; cash0, other0, liabilities, paid_in, re0 by entity.
    """
    w = Window.partitionBy(*by).orderBy(order)
    s = df.withColumn("gross", C("revenue") - C("cogs")).withColumn("ebit", C("gross") - C("sga") - C("da")).withColumn("ebt", C("ebit") - C("interest"))
    s = s.withColumn("ni", C("ebt") - F.greatest("ebt", F.lit(0.0)) * C("tax_rate"))
    s = s.withColumn("retained", C("re0") + F.sum(C("ni") - C("dividends")).over(w))
    s = s.withColumn("cash", C("cash0") + F.sum(C("ni") + C("da") - C("delta_nwc") - C("dividends")).over(w))
    s = s.withColumn("assets", C("cash") + C("other0") + F.sum(C("delta_nwc") - C("da")).over(w))
    return s.withColumn("claims", C("liabilities") + C("paid_in") + C("retained"))


def check_statements(result: DataFrame, reported_cash: Column, tol: float = 0.01) -> DataFrame:
    """K8: per row whether assets equal claims and the cash flow's end is the balance sheet's cash."""
    return result.withColumn("balance_ok", tie_out(C("assets") - C("cash") + reported_cash, C("claims"), tol)).withColumn("cash_ok", tie_out(C("cash"), reported_cash, tol))


def cohort_curves(cells: DataFrame, cohort: str = "cohort", age: str = "age") -> DataFrame:
    """Grr and nrr of cohorts from (cohort, age, start, churn, contraction, expansion), against the start at age 0.

    Losses add up over ages; ages between the first and last that a cohort lacks are kept, without losses or gains.
    """
    base = cells.filter(C(age) == 0).groupBy(cohort).agg(F.sum("start").alias("base"))
    span = cells.groupBy(cohort).agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max(age).cast("long"))).alias(age))
    j = span.join(base, cohort).join(cells.select(cohort, C(age).cast("long").alias(age), "churn", "contraction", "expansion"), [cohort, age], "left").fillna(0.0)
    w = Window.partitionBy(cohort).orderBy(age)
    lost, won = F.sum(C("churn") + C("contraction")).over(w), F.sum("expansion").over(w)
    grr, nrr = ratio(C("base") - lost, C("base")), ratio(C("base") - lost + won, C("base"))
    return j.select(cohort, age, "base", grr["value"].alias("grr"), nrr["value"].alias("nrr"), grr["reason"].alias("reason"))


def check_cohorts(curves: DataFrame, cohort: str = "cohort", age: str = "age") -> DataFrame:
    """Per cohort whether gross retention never rises and never exceeds net retention."""
    rises = C("grr") > F.lag("grr").over(Window.partitionBy(cohort).orderBy(age)) + 1e-9
    g = curves.withColumn("_r", F.coalesce(rises, F.lit(False))).groupBy(cohort)
    return g.agg((~F.bool_or("_r")).alias("monotone"), F.bool_and(F.coalesce(C("grr") <= C("nrr") + 1e-9, F.lit(True))).alias("bounded"))


def appraisal_rows(flows: DataFrame, project: str, rate: Column, terminal: str | None = None) -> DataFrame:
    """Project, t, cash (with the terminal value in the last period), discounted and cumulative discounted cash."""
    last = F.max("t").over(Window.partitionBy(project))
    extra = F.when(C("t") == last, F.coalesce(C(terminal), F.lit(0.0))).otherwise(0.0) if terminal else F.lit(0.0)
    rows = flows.withColumn("cash", C("cash") + extra).withColumn("discounted", C("cash") / F.pow(1 + rate, C("t")))
    return rows.withColumn("cumulative", F.sum("discounted").over(Window.partitionBy(project).orderBy("t")))


def fx_split(factors: DataFrame, bridge: list[str]) -> DataFrame:
    """Per bridge base, end, sum of factors with currency effects apart, and whether base plus factors is the end."""
    g = factors.groupBy(*bridge).agg(F.max("base").alias("base"), F.max("end").alias("end"), F.sum(C("amount") - C("fx_effect")).alias("own"), F.sum("fx_effect").alias("fx"))
    return g.withColumn("ok", tie_out(C("base") + C("own") + C("fx"), C("end"), 1e-6 * 1e6))


def consolidate(entities: DataFrame, segment: str) -> DataFrame:
    """Per segment and in all (null) local amounts at their rates, eliminations apart and the rest."""
    at = C("local_amount") * C("fx_rate")
    gone = F.coalesce(C("is_elimination"), F.lit(False))
    g = entities.rollup(segment).agg(F.sum(F.when(~gone, at).otherwise(0.0)).alias("gross"), F.sum(F.when(gone, at).otherwise(0.0)).alias("eliminated"))
    return g.withColumn("net", C("gross") + C("eliminated"))


def returns(df: DataFrame) -> DataFrame:
    """Margin, turnover, leverage and roe; roic of ebit after tax over debt and equity, and its spread over the wacc."""
    r = lambda a, b: ratio(a, b)["value"]
    out = df.withColumns({"margin": r(C("net_income"), C("sales")), "turnover": r(C("sales"), C("assets")), "leverage": r(C("assets"), C("equity")), "roe": r(C("net_income"), C("equity"))})
    out = out.withColumn("roic", r(C("ebit") * (1 - C("tax_rate")), C("debt") + C("equity")))
    return out.withColumn("spread", C("roic") - C("wacc"))


def cross_ties(facts: DataFrame, rules: list[tuple[str, str, str]], model: str = "model", tol: float = 0.5) -> DataFrame:
    """Per model and rule whether two figures of a facts table (model, key, value) tie; a missing figure fails.

    rules: name, key of one side, key of the other. Models are many and rules a handful.
    """
    wide = facts.groupBy(model).agg(*(F.max(F.when(C("key") == k, C("value"))).alias(k) for k in sorted({k for _, a, b in rules for k in (a, b)})))
    each = F.array(*(F.struct(F.lit(n).alias("tie"), C(a).alias("left"), C(b).alias("right"), tie_out(C(a), C(b), tol).alias("ok")) for n, a, b in rules))
    return wide.select(model, F.inline(each))


def conserved(specs: list[tuple[str, DataFrame, Column, DataFrame, Column]], tol: float = 0.5) -> DataFrame:
    """Q19: name, raw, reported and ok of totals that are computed anew from the raw table and reported by an output.

    specs: name, raw table, aggregate over it, output table, aggregate over it. A total that is null fails.
    """
    one = lambda name, raw, a, out, b: raw.agg(a.cast("double").alias("raw")).crossJoin(out.agg(b.cast("double").alias("reported"))).select(F.lit(name).alias("name"), "raw", "reported", tie_out(C("raw"), C("reported"), tol).alias("ok"))
    return reduce(DataFrame.unionByName, (one(*s) for s in specs))
