"""Investment appraisal (K13) of many projects at once: effective rates, terminal values, measures, and sensitivities that must
hold the model's own value between their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import finance as fin
from tallywright.operators.checks import tie_out

C = F.col


def effective(flows: DataFrame, projects: DataFrame) -> DataFrame:
    """project, t, cash and rate: flows (project, t, cash) with the terminal value in the last period and the rate that counts.

    projects: project, rate, use_wacc, equity, debt, cost_equity, cost_debt, tax, terminal. The weighted cost of capital is the
    rate where it is asked for and there is capital; else `rate`. Projects without flows, and flows without a project, drop out.
    """
    own = fin.wacc(C("equity"), C("debt"), C("cost_equity"), C("cost_debt"), C("tax"))
    rate = F.when(C("use_wacc"), F.coalesce(own, C("rate"))).otherwise(C("rate"))
    p = projects.select("project", rate.alias("rate"), F.coalesce("terminal", F.lit(0.0)).alias("_more"))
    last = C("t") == F.max("t").over(Window.partitionBy("project"))
    return flows.join(p, "project").select("project", "t", (C("cash") + F.when(last, C("_more")).otherwise(0.0)).alias("cash"), "rate")


def appraise(flows: DataFrame, finance: float, reinvest: float) -> DataFrame:
    """project, rate, npv, irr, status, mirr and payback of flows as of `effective`."""
    g = flows.groupBy("project").agg(F.first("rate").alias("rate"), fin.npv(C("rate")).alias("npv"), fin.mirr(F.lit(finance), F.lit(reinvest)).alias("mirr"))
    root, back = fin.irr(flows.select("project", "t", "cash"), "project"), fin.payback(flows, "project", C("rate"))
    return g.join(root, "project", "left").join(back, "project", "left").select("project", "rate", "npv", "irr", "status", "mirr", "payback")


def tornado(cases: DataFrame, appraised: DataFrame) -> DataFrame:
    """project, variable, swing, rank and bracketed of cases (project, variable, npv_low, npv_high), widest first, ties by name.

    `bracketed` is false where the project's own net present value is outside of the two ends, or where one of these is null.
    """
    j = cases.join(appraised.select("project", "npv"), "project", "left").withColumn("swing", F.abs(C("npv_high") - C("npv_low")))
    inside = C("npv").between(F.least("npv_low", "npv_high"), F.greatest("npv_low", "npv_high"))
    both = C("npv_low").isNotNull() & C("npv_high").isNotNull()
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc_nulls_last("swing"), "variable"))
    return j.select("project", "variable", "swing", rank.alias("rank"), F.coalesce(both & inside, F.lit(False)).alias("bracketed"))


def check(flows: DataFrame, appraised: DataFrame, raw: DataFrame, projects: DataFrame, tol: float = 1e-4) -> DataFrame:
    """project, check and ok. ROOT: at the rate of return flows are worth nothing (within `tol` of the sum of their sizes); holds
    where there is none. TERMINAL: effective flows are the raw ones plus one terminal value. MIRR: there is one."""
    j = flows.join(appraised.select("project", "irr", "mirr"), "project")
    g = j.groupBy("project").agg(F.first("irr").alias("irr"), F.first("mirr").alias("mirr"), fin.npv(C("irr")).alias("at"), F.sum(F.abs("cash")).alias("size"), F.sum("cash").alias("sum"))
    plain = raw.groupBy("project").agg(F.sum("cash").alias("plain")).join(projects.select("project", F.coalesce("terminal", F.lit(0.0)).alias("more")), "project")
    g = g.join(plain, "project", "left")
    root = F.when(C("irr").isNull(), True).otherwise(F.abs("at") <= tol * C("size"))
    tests = {"ROOT": root, "TERMINAL": tie_out(C("sum"), C("plain") + C("more"), 0.01), "MIRR": C("mirr").isNotNull()}
    return g.select("project", F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in tests.items()))))
