"""The finance analyses over many entities, each as one DataFrame job, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.analyses import allocation
from tallywright.functions import finance as fin
from tallywright.operators import checks as q
from tallywright.plans.facts import BY, NM, NY, brand_years, month, nation_months, nation_years, rounded
from tallywright.plans.registry import Tables, query

C = F.col


@query(f"""WITH {BY}, i AS (SELECT brand, coalesce(max(revenue) FILTER (y=1996),0) AS plan, coalesce(max(revenue) FILTER (y=1997),0) AS actual FROM by_ GROUP BY brand),
b AS (SELECT *, actual-plan AS delta, sum(actual-plan) OVER (ORDER BY brand) AS cum FROM i)
SELECT brand, round(plan,2) AS plan, round(actual,2) AS actual, round(delta,2) AS delta, round(delta/nullif(abs(plan),0),4) AS delta_pct, round(least(cum,cum-delta),2) AS base, round(cum,2) AS cum FROM b""")
def k1_variance(t: Tables) -> DataFrame:
    """Plan (1996) against actual (1997) per brand with a running bridge; the bridge window spans the items of one report."""
    i = brand_years(t).groupBy("brand").pivot("y", [1996, 1997]).agg(F.sum("revenue")).select("brand", F.coalesce("1996", F.lit(0.0)).alias("plan"), F.coalesce("1997", F.lit(0.0)).alias("actual"))
    b = i.withColumn("delta", C("actual") - C("plan")).withColumn("cum", F.sum("delta").over(Window.orderBy("brand"))).withColumn("base", F.least("cum", C("cum") - C("delta")))
    return rounded(b.withColumn("delta_pct", F.round(fin.variance_pct(C("actual"), C("plan")), 4)), "plan", "actual", "delta", "base", "cum")


@query(f"""WITH {NM} SELECT nation, ym, round(value,2) AS value, round(value/nullif(lag(value) OVER w,0)-1,4) AS mom,
round(CASE WHEN count(*) OVER w12=12 THEN sum(value) OVER w12 END,2) AS trailing, round(avg(value) OVER (PARTITION BY nation, ym%12)/avg(value) OVER (PARTITION BY nation),4) AS season
FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ym), w12 AS (PARTITION BY nation ORDER BY ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def k2_period_trend(t: Tables) -> DataFrame:
    """Month on month, trailing twelve (null until full) and seasonal index per nation."""
    w = Window.partitionBy("nation").orderBy("ym")
    w12 = w.rowsBetween(-11, 0)
    s = nation_months(t).withColumns({
        "mom": F.round(F.try_divide("value", F.lag("value").over(w)) - 1, 4),
        "trailing": F.round(F.when(F.count("*").over(w12) == 12, F.sum("value").over(w12)), 2),
        "season": F.round(F.avg("value").over(Window.partitionBy("nation", C("ym") % 12)) / F.avg("value").over(Window.partitionBy("nation")), 4),
    })
    return s.select("nation", "ym", F.round("value", 2).alias("value"), "mom", "trailing", "season")


@query(f"""WITH {NM}, l AS (SELECT max(ym)-6 AS cut FROM nm), s AS (SELECT nation, ym, CASE WHEN ym<=cut THEN 'actual' ELSE 'forecast' END AS class, value, CASE WHEN ym<=cut THEN value ELSE value*1.05 END AS current_v FROM nm, l)
SELECT nation, ym//12 AS fy, round(sum(current_v),2) AS total, round(sum(current_v) FILTER (class='actual'),2) AS actual, round(sum(current_v) FILTER (class='forecast'),2) AS forecast, round(sum(current_v-value),2) AS version_delta FROM s GROUP BY 1,2""")
def k3_rolling_forecast(t: Tables) -> DataFrame:
    """Year totals of actuals up to a cut and forecasts after it, and the bridge to the prior version."""
    nm = nation_months(t)
    cut = nm.agg((F.max("ym") - 6).alias("cut"))
    s = nm.crossJoin(F.broadcast(cut)).withColumn("class", F.when(C("ym") <= C("cut"), "actual").otherwise("forecast")).withColumn("v", F.when(C("class") == "actual", C("value")).otherwise(C("value") * 1.05))
    part = lambda c: F.round(F.sum(F.when(C("class") == c, C("v"))), 2).alias(c)
    return s.groupBy("nation", F.floor(C("ym") / 12).alias("fy")).agg(F.round(F.sum("v"), 2).alias("total"), part("actual"), part("forecast"), F.round(F.sum(C("v") - C("value")), 2).alias("version_delta"))


@query("""WITH d AS (SELECT n_regionkey AS region, n_nationkey AS dept, count(c_custkey) AS headcount, avg(c_acctbal) AS unit FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2),
e AS (SELECT *, headcount*unit AS cost, CASE WHEN dept%2=0 THEN 'ZBB' ELSE 'incremental' END AS method, headcount*unit*0.95 AS prior FROM d)
SELECT coalesce(region,-1) AS region, coalesce(dept,-1) AS dept, round(sum(cost),2) AS cost, round(sum(CASE WHEN method='incremental' THEN cost-prior ELSE cost END),2) AS delta FROM e GROUP BY ROLLUP(e.region, e.dept)""")
def k4_budget_build(t: Tables) -> DataFrame:
    """Headcount times unit cost per department, zero-based or against the prior budget, with roll-ups."""
    d = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).groupBy(C("n_regionkey").alias("region"), C("n_nationkey").alias("dept")).agg(F.count("*").alias("headcount"), F.avg("c_acctbal").alias("unit"))
    e = d.withColumn("cost", C("headcount") * C("unit")).withColumn("delta", F.when(C("dept") % 2 == 0, C("cost")).otherwise(C("cost") - C("cost") * 0.95))
    return e.rollup("region", "dept").agg(F.round(F.sum("cost"), 2).alias("cost"), F.round(F.sum("delta"), 2).alias("delta")).fillna(-1, ["region", "dept"])


@query("""WITH b AS (SELECT CAST(floor((epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/ (86400*30.0/13)) AS INT) AS week, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS inflow, sum(CASE WHEN event_type='error' THEN value ELSE 0 END) AS outflow FROM events GROUP BY 1),
g AS (SELECT r AS week, coalesce(inflow,0) AS inflow, coalesce(outflow,0) AS outflow FROM range(13) x(r) LEFT JOIN b ON week=r)
SELECT CAST(week AS INT) AS week, round(inflow,2) AS inflow, round(outflow,2) AS outflow, round(1000+sum(inflow-outflow) OVER (ORDER BY week)-(inflow-outflow),2) AS opening, round(1000+sum(inflow-outflow) OVER (ORDER BY week),2) AS closing FROM g""")
def k5_cashflow_13w(t: Tables) -> DataFrame:
    """Thirteen periods of opening and closing cash; a period without events is there with zeros."""
    week = F.floor((F.unix_timestamp("ts") + F.expr("extract(second from ts) - floor(extract(second from ts))").cast("double") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (86400 * 30.0 / 13)).cast("int")
    side = lambda e: F.sum(F.when(C("event_type") == e, C("value")).otherwise(0.0))
    b = t.events.groupBy(week.alias("week")).agg(side("purchase").alias("inflow"), side("error").alias("outflow"))
    g = t.spark.range(13).select(C("id").cast("int").alias("week")).join(b, "week", "left").fillna(0.0)
    cum = F.sum(C("inflow") - C("outflow")).over(Window.orderBy("week"))
    out = g.withColumn("closing", 1000 + cum).withColumn("opening", C("closing") - C("inflow") + C("outflow"))
    return rounded(out, "inflow", "outflow", "opening", "closing")


@query("""WITH s AS (SELECT c_mktsegment AS segment, avg(o_totalprice)/12 AS arpu, 0.3+0.05*(length(c_mktsegment)%5) AS gm, 0.01*(1+length(c_mktsegment)%4) AS churn, avg(abs(c_acctbal)) AS cac FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY c_mktsegment)
SELECT segment, round(arpu*gm,2) AS contribution, round(arpu*gm*1.01/(churn+0.01),2) AS ltv, round(arpu*gm*1.01/(churn+0.01)/cac,4) AS ltv_cac, round(cac/(arpu*gm),4) AS payback_months, arpu*gm*1.01/(churn+0.01)/cac>=3 AS ltv_ok, cac/(arpu*gm)<=12 AS payback_ok FROM s""")
def k6_unit_economics(t: Tables) -> DataFrame:
    """Contribution, lifetime value, its ratio to acquisition cost and payback per segment."""
    n = F.length("c_mktsegment")
    s = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).groupBy("c_mktsegment").agg((F.avg("o_totalprice") / 12).alias("arpu"), F.avg(F.abs("c_acctbal")).alias("cac"))
    s = s.withColumn("m", C("arpu") * (0.3 + 0.05 * (n % 5))).withColumn("ltv", fin.discounted_ltv(C("m"), 0.01 * (1 + n % 4), F.lit(0.01)))
    return s.select(C("c_mktsegment").alias("segment"), F.round("m", 2).alias("contribution"), F.round("ltv", 2).alias("ltv"), F.round(C("ltv") / C("cac"), 4).alias("ltv_cac"), F.round(C("cac") / C("m"), 4).alias("payback_months"), (C("ltv") / C("cac") >= 3).alias("ltv_ok"), (C("cac") / C("m") <= 12).alias("payback_ok"))


@query(f"""WITH {BY}, d AS (SELECT brand AS driver, avg(qty) AS base, min(qty) AS low, max(qty) AS high, sum(revenue)/sum(qty) AS impact FROM by_ GROUP BY brand)
SELECT driver, round(abs(high-low)*impact,2) AS swing, row_number() OVER (ORDER BY abs(high-low)*impact DESC, driver) AS rank, round(1000+sum((low-base)*impact) OVER (),2) AS low_case, round(1000+sum((high-base)*impact) OVER (),2) AS high_case FROM d""")
def k7_scenario_sensitivity(t: Tables) -> DataFrame:
    """Low and high outcomes over all drivers and the tornado order by swing."""
    d = brand_years(t).groupBy(C("brand").alias("driver")).agg(F.avg("qty").alias("base"), F.min("qty").alias("low"), F.max("qty").alias("high"), (F.sum("revenue") / F.sum("qty")).alias("impact"))
    d = d.withColumn("swing", F.abs(C("high") - C("low")) * C("impact"))
    case = d.agg(*(F.round(1000 + F.sum((C(c) - C("base")) * C("impact")), 2).alias(f"{c}_case") for c in ("low", "high")))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("swing"), "driver"))).crossJoin(F.broadcast(case)).select("driver", F.round("swing", 2).alias("swing"), "rank", "low_case", "high_case")


@query(f"""WITH {NY}, p AS (SELECT nation, y, value AS revenue, closed*0.6 AS cogs, value*0.1 AS sga, value*0.05 AS da, open*0.02 AS interest FROM ny), s AS (SELECT *, revenue-cogs AS gross, revenue-cogs-sga-da AS ebit, revenue-cogs-sga-da-interest AS ebt FROM p), x AS (SELECT *, ebt-greatest(ebt,0)*0.25 AS ni FROM s)
SELECT nation, y, round(gross,2) AS gross, round(ebit,2) AS ebit, round(ebt,2) AS ebt, round(ni,2) AS ni, round(sum(ni*0.7) OVER (PARTITION BY nation ORDER BY y),2) AS retained FROM x""")
def k8_pnl_3statement(t: Tables) -> DataFrame:
    """Gross profit to net income (tax only on a profit) and the roll of retained earnings."""
    s = nation_years(t).select("nation", "y", (C("value") - C("closed") * 0.6).alias("gross"), (C("value") * 0.15).alias("opex"), (C("open") * 0.02).alias("interest"))
    s = s.withColumn("ebit", C("gross") - C("opex")).withColumn("ebt", C("ebit") - C("interest")).withColumn("ni", C("ebt") - F.greatest("ebt", F.lit(0.0)) * 0.25)
    s = s.withColumn("retained", F.sum(C("ni") * 0.7).over(Window.partitionBy("nation").orderBy("y")))
    return rounded(s.drop("opex", "interest"), "gross", "ebit", "ebt", "ni", "retained")


@query(f"""WITH {NY} SELECT nation, round(a.value,2) AS actual, round(b.value*1.02,2) AS target, round(a.value/(b.value*1.02),4) AS attainment, a.value>=b.value*1.02 AS met FROM ny a JOIN ny b USING (nation) WHERE a.y=1998 AND b.y=1997""")
def k9_board_kpi_pack(t: Tables) -> DataFrame:
    """Attainment of last year's value plus two per cent."""
    ny = nation_years(t)
    j = ny.filter("y = 1998").select("nation", C("value").alias("actual")).join(ny.filter("y = 1997").select("nation", (C("value") * 1.02).alias("target")), "nation")
    return rounded(j.withColumn("attainment", F.round(C("actual") / C("target"), 4)).withColumn("met", C("actual") >= C("target")), "actual", "target")


@query("""WITH f AS (SELECT o_custkey AS c, year(o_orderdate)*4+quarter(o_orderdate)-1 AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1,2), s AS (SELECT *, min(q) OVER (PARTITION BY c) AS cohort, max(CASE WHEN true THEN 0 END) OVER () AS z FROM f),
a AS (SELECT cohort, q-cohort AS age, c, v FROM s), base AS (SELECT cohort, c, v AS v0 FROM a WHERE age=0),
r AS (SELECT cohort, age, sum(v) AS mrr, sum(least(v,v0)) AS kept FROM a JOIN base USING (cohort, c) GROUP BY 1,2), g AS (SELECT cohort, sum(v0) AS base FROM base GROUP BY 1), m AS (SELECT max(q) AS mq FROM f),
grid AS (SELECT cohort, age FROM g, m, range(0,60) x(age) WHERE age<=mq-cohort)
SELECT cohort, CAST(age AS BIGINT) AS age, round(base,2) AS base, round(coalesce(mrr,0),2) AS mrr, round(coalesce(mrr,0)/base,4) AS nrr, round(coalesce(kept,0)/base,4) AS grr FROM grid JOIN g USING (cohort) LEFT JOIN r USING (cohort, age)""")
def k10_cohort_retention(t: Tables) -> DataFrame:
    """Net and gross retention per cohort of first quarters and age; ages without orders are there with zero."""
    f = t.orders.groupBy(C("o_custkey").alias("c"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("c").orderBy("q")
    a = f.select("c", "q", "v", F.first("q").over(w).alias("cohort"), F.first("v").over(w).alias("v0")).withColumn("age", (C("q") - C("cohort")).cast("long"))
    r = a.groupBy("cohort", "age").agg(F.sum("v").alias("mrr"), F.sum(F.least("v", "v0")).alias("kept"), F.sum(F.when(C("age") == 0, C("v"))).alias("b"))
    g = r.filter("age = 0").select("cohort", C("b").alias("base"))
    last = f.agg(F.max("q").alias("mq"))
    grid = g.crossJoin(F.broadcast(last)).select("cohort", "base", F.explode(F.sequence(F.lit(0).cast("long"), (C("mq") - C("cohort")).cast("long"))).alias("age"))
    o = grid.join(r, ["cohort", "age"], "left").fillna(0.0, ["mrr", "kept"])
    return o.select("cohort", "age", F.round("base", 2).alias("base"), F.round("mrr", 2).alias("mrr"), F.round(C("mrr") / C("base"), 4).alias("nrr"), F.round(C("kept") / C("base"), 4).alias("grr"))


@query(f"""WITH {NM} SELECT nation, ym, CAST(n AS BIGINT) AS headcount, round(n*(30000+100*nation)*(1+0.1+0.01*(nation%5))/12,2) AS monthly_cost FROM nm""")
def k11_headcount_plan(t: Tables) -> DataFrame:
    """Monthly cost of headcount at base salary and loading."""
    loaded = (30000 + 100 * C("nation")) * (1 + 0.1 + 0.01 * (C("nation") % 5))
    return nation_months(t).select("nation", "ym", C("n").alias("headcount"), F.round(C("n") * loaded / 12, 2).alias("monthly_cost"))


@query("""SELECT coalesce(n_regionkey,-1) AS region, coalesce(s_suppkey,-1) AS supplier, round(sum(s_acctbal),2) AS total, CAST(grouping(n_regionkey)+grouping(s_suppkey) AS INT) AS level FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY ROLLUP(n_regionkey, s_suppkey)""")
def k12_listing(t: Tables) -> DataFrame:
    """Rows with subtotals per group and a grand total."""
    s = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).select(C("n_regionkey").alias("region"), C("s_suppkey").alias("supplier"), "s_acctbal")
    return s.rollup("region", "supplier").agg(F.round(F.sum("s_acctbal"), 2).alias("total"), (F.grouping("region") + F.grouping("supplier")).cast("int").alias("level")).fillna(-1, ["region", "supplier"])


def flows(t: Tables) -> DataFrame:
    """project, t, cash: an outlay of three average years and then a nation's yearly values."""
    ny = nation_years(t).select(C("nation").alias("project"), (C("y") - 1994).alias("t"), C("value").alias("cash"))
    return ny.unionByName(ny.groupBy("project").agg(F.lit(0).alias("t"), (-3 * F.avg("cash")).alias("cash")))


FLOWS = f"{NY}, fl AS (SELECT nation AS project, y-1994 AS t, value AS cash FROM ny UNION ALL SELECT nation, 0, -3*avg(value) FROM ny GROUP BY nation)"


@query(f"""WITH {FLOWS}, r AS (SELECT *, 0.05+project/1000 AS rate FROM fl), d AS (SELECT *, sum(cash/pow(1+rate,t)) OVER w AS cum, cash/pow(1+rate,t) AS dcf FROM r WINDOW w AS (PARTITION BY project ORDER BY t)), p AS (SELECT *, lag(cum) OVER (PARTITION BY project ORDER BY t) AS prev FROM d)
SELECT project, round(sum(dcf),2) AS npv, round(min(CASE WHEN cum>=0 AND prev<0 THEN t-1+(-prev)/dcf END),4) AS payback,
round(pow(sum(CASE WHEN cash>0 THEN cash*pow(1.06, -t) END)*pow(1.06, max(t))/-sum(CASE WHEN cash<0 THEN cash/pow(1.05,t) END),1.0/max(t))-1,6) AS mirr FROM p GROUP BY project""")
def k13_investment_appraisal(t: Tables) -> DataFrame:
    """Net present value, discounted payback and modified rate of return per project."""
    f = flows(t).withColumn("rate", 0.05 + C("project") / 1000)
    a = f.groupBy("project").agg(F.round(fin.npv(C("rate")), 2).alias("npv"), F.round(fin.mirr(F.lit(0.05), F.lit(0.06)), 6).alias("mirr"))
    return a.join(fin.payback(f, "project", C("rate")), "project").withColumn("payback", F.round("payback", 4)).select("project", "npv", "payback", "mirr")


PLANTED = [(100, 0, -100.0), (100, 1, 230.0), (100, 2, -132.0), (200, 0, -100.0), (200, 5, 1.0), (300, 0, 1.0), (300, 1, 2.0)]


@query(f"""WITH RECURSIVE {FLOWS}, mean AS (SELECT nation, avg(value) AS m FROM ny GROUP BY nation),
every AS (FROM fl UNION ALL SELECT nation+p, t, m*f FROM mean, (VALUES {str(PLANTED)[1:-1]}) x(p, t, f)),
s AS (SELECT project, list(struct_pack(t := t, c := cash)) AS l, min(cash)<0 AND max(cash)>0 AS two FROM every GROUP BY project),
nw(project, l, rate, state, i) AS (SELECT project, l, CAST(0.1 AS DOUBLE), 0, 0 FROM s WHERE two UNION ALL
  SELECT project, l, CASE WHEN abs(f)<1e-7 OR new IS NULL OR new<=-0.999999 THEN rate ELSE new END,
  CASE WHEN abs(f)<1e-7 THEN 1 WHEN new IS NULL OR new<=-0.999999 THEN 2 WHEN abs(new-rate)<1e-7 THEN 1 ELSE 0 END, i+1
  FROM (SELECT *, rate-f/nullif(d,0) AS new FROM (SELECT *, list_sum([x.c/pow(1+rate,x.t) FOR x IN l]) AS f,
    list_sum([-x.t*x.c/pow(1+rate,x.t+1) FOR x IN l]) AS d FROM nw WHERE state=0 AND i<200))),
done AS (SELECT project, rate FROM nw WHERE state=1),
b(project, l, side, lo, hi, i) AS (SELECT project, l, sign(list_sum([x.c/pow(1-0.9999,x.t) FOR x IN l])), CAST(-0.9999 AS DOUBLE), CAST(10.0 AS DOUBLE), 0
  FROM s WHERE two AND project NOT IN (SELECT project FROM done) AND sign(list_sum([x.c/pow(1-0.9999,x.t) FOR x IN l]))*sign(list_sum([x.c/pow(11,x.t) FOR x IN l]))<0
  UNION ALL SELECT project, l, side, CASE WHEN v=side THEN m ELSE lo END, CASE WHEN v=side THEN hi ELSE m END, i+1
  FROM (SELECT *, (lo+hi)/2 AS m, sign(list_sum([x.c/pow(1+(lo+hi)/2, x.t) FOR x IN l])) AS v FROM b) WHERE i<80)
SELECT s.project, round(coalesce(done.rate, (lo+hi)/2),6) AS irr,
CASE WHEN done.rate IS NOT NULL THEN 'newton' WHEN lo IS NOT NULL THEN 'bisection' ELSE 'none' END AS status
FROM s LEFT JOIN done USING (project) LEFT JOIN (SELECT * FROM b WHERE i=80) b USING (project)""")
def f2_irr(t: Tables) -> DataFrame:
    """Internal rate of return and its status: nations' flows, and planted ones with two rates, with a rate that Newton's
    method misses, and without a change of sign."""
    mean = nation_years(t).groupBy("nation").agg(F.avg("value").alias("m"))
    rows = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(k).alias("t"), F.lit(f).alias("f")) for p, k, f in PLANTED))
    planted = mean.select("nation", "m", F.inline(rows)).select((C("nation") + C("p")).alias("project"), "t", (C("m") * C("f")).alias("cash"))
    return rounded(fin.irr(flows(t).unionByName(planted), "project"), "irr", places=6)


@query("""SELECT p_partkey AS asset, CAST(k AS INT) AS k, CAST(round(CAST(p_retailprice-(p_retailprice*0.9)/p_size*(k-1) AS DECIMAL(38,9)),6) AS DOUBLE) AS opening,
CAST(round(CAST(CASE WHEN k<p_size THEN p_retailprice*0.9/p_size ELSE p_retailprice*0.9-p_retailprice*0.9/p_size*(p_size-1) END AS DECIMAL(38,9)),6) AS DOUBLE) AS dep,
CAST(round(CAST(CASE WHEN k<p_size THEN p_retailprice-p_retailprice*0.9/p_size*k ELSE p_retailprice*0.1 END AS DECIMAL(38,9)),6) AS DOUBLE) AS closing FROM part, range(1,51) x(k) WHERE k<=p_size""")
def k14_depreciation_schedule(t: Tables) -> DataFrame:
    """Straight-line schedule of every asset and month."""
    a = t.part.select(C("p_partkey").alias("asset"), "p_size", C("p_retailprice").alias("cost"), (C("p_retailprice") * 0.1).alias("salvage"))
    return rounded(fin.depreciation(a, "cost", "salvage", "p_size"), "opening", "dep", "closing", places=6, ties=True).select("asset", "k", "opening", "dep", "closing")


@query("""WITH a AS (SELECT p_partkey AS asset, p_retailprice AS cost, p_retailprice*0.9 AS base, p_size AS life, CASE WHEN p_partkey%3=0 THEN ceil(p_size*0.7) END AS dk, CASE WHEN p_partkey%4=0 THEN ceil(p_size*0.4) END AS ik FROM part),
i AS (SELECT *, CASE WHEN ik IS NOT NULL AND (dk IS NULL OR ik<=dk) THEN cost*0.7-CASE WHEN ik>=life THEN base ELSE base/life*(ik-0.5) END ELSE 0 END AS imp, CASE WHEN dk IS NOT NULL THEN 0 WHEN ik=life THEN cost*0.3 ELSE cost*0.1 END AS closing,
CASE WHEN dk IS NULL THEN 0 WHEN ik<=dk THEN cost*0.3-CASE WHEN life>ik THEN cost*0.2*(dk-ik)/(life-ik) ELSE 0 END ELSE cost-CASE WHEN dk>=life THEN base ELSE base/life*(dk-0.5) END END AS left_ FROM a)
SELECT asset, CAST(round(CAST(cost-imp-closing-left_ AS DECIMAL(38,9)),2) AS DOUBLE) AS dep, CAST(round(CAST(imp AS DECIMAL(38,9)),2) AS DOUBLE) AS impairment,
CAST(round(CAST(closing AS DECIMAL(38,9)),2) AS DOUBLE) AS closing FROM i""")
def f11_depreciation_events(t: Tables) -> DataFrame:
    """Schedules with a part first month, impairments and disposals; cost = sum of dep, impairment and book at disposal."""
    a = t.part.select(C("p_partkey").alias("asset"), C("p_retailprice").alias("cost"), (C("p_retailprice") * 0.1).alias("salvage"), C("p_size").alias("life"), F.lit(0.5).alias("first_factor"), F.when(C("p_partkey") % 3 == 0, F.ceil(C("p_size") * 0.7).cast("int")).alias("dispose_k"), F.when(C("p_partkey") % 4 == 0, F.ceil(C("p_size") * 0.4).cast("int")).alias("impair_k"), (C("p_retailprice") * 0.3).alias("impair_to"))
    sums = fin.depreciation_ext(a).groupBy("asset").agg(F.sum("dep").alias("dep"), F.sum("impairment").alias("impairment"), F.max_by("closing", "k").alias("closing"))
    return rounded(sums, "dep", "impairment", "closing", ties=True)


@query(f"""WITH {BY}, f AS (SELECT a.brand AS factor, b.revenue-a.revenue AS amount, CASE WHEN b.revenue>a.revenue*1.1 THEN 'permanent' WHEN b.revenue>a.revenue*0.9 THEN 'timing' ELSE 'residual' END AS kind FROM by_ a JOIN by_ b USING (brand) WHERE a.y=1998 AND b.y=1999)
SELECT kind, count(*) AS n, round(sum(amount),2) AS amount, round(sum(abs(amount))/sum(sum(abs(amount))) OVER (),4) AS share FROM f GROUP BY kind""")
def k15_variance_bridge(t: Tables) -> DataFrame:
    """Factors between two years by kind and their share."""
    by = brand_years(t)
    f = by.filter("y = 1998").select("brand", C("revenue").alias("r0")).join(by.filter("y = 1999").select("brand", C("revenue").alias("r1")), "brand").withColumn("amount", C("r1") - C("r0"))
    f = f.withColumn("kind", F.when(C("r1") > C("r0") * 1.1, "permanent").when(C("r1") > C("r0") * 0.9, "timing").otherwise("residual"))
    g = f.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum(F.abs("amount")).alias("a"))
    return g.select("kind", "n", F.round("amount", 2).alias("amount"), F.round(C("a") / F.sum("a").over(Window.partitionBy()), 4).alias("share"))


def contracts(t: Tables) -> DataFrame:
    """contract, start and end months (null: evergreen), amount, recurrence in months and status of orders as contracts."""
    k = C("o_orderkey") % 60
    return t.orders.select(C("o_orderkey").alias("contract"), month("o_orderdate").alias("start"), F.when(k > 0, month("o_orderdate") + k).alias("stop"), (C("o_totalprice") / 12).alias("amount"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), 1).when(F.substring("o_orderpriority", 1, 1) == "3", 3).otherwise(12).alias("every"), C("o_orderstatus").alias("status"))


CONTRACTS = "ct AS (SELECT o_orderkey AS contract, year(o_orderdate)*12+month(o_orderdate)-1 AS start, CASE WHEN o_orderkey%60>0 THEN year(o_orderdate)*12+month(o_orderdate)-1+o_orderkey%60 END AS stop, o_totalprice/12 AS amount, CASE WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 1 WHEN substr(o_orderpriority,1,1)='3' THEN 3 ELSE 12 END AS every, o_orderstatus AS status FROM orders)"
ASOF = 1998 * 12


@query(f"""WITH {CONTRACTS}, a AS (SELECT *, stop-{ASOF} AS remaining FROM ct WHERE status<>'F' AND start<={ASOF} AND (stop IS NULL OR stop>{ASOF}))
SELECT CASE WHEN remaining IS NULL THEN 'rolling' WHEN remaining<=12 THEN '<=12' WHEN remaining<=24 THEN '13-24' WHEN remaining<=36 THEN '25-36' ELSE '>36' END AS bucket, count(*) AS n, round(sum(amount*12/every),2) AS annualised FROM a GROUP BY 1""")
def k16_maturity_wall(t: Tables) -> DataFrame:
    """Active contracts by months to maturity."""
    a = contracts(t).filter((C("status") != "F") & (C("start") <= ASOF) & (C("stop").isNull() | (C("stop") > ASOF))).withColumn("r", C("stop") - ASOF)
    bucket = F.when(C("r").isNull(), "rolling").when(C("r") <= 12, "<=12").when(C("r") <= 24, "13-24").when(C("r") <= 36, "25-36").otherwise(">36")
    return a.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(C("amount") * 12 / C("every")), 2).alias("annualised"))


@query(f"""WITH {NM}, p AS (SELECT *, (ym-min(ym) OVER (PARTITION BY nation))%12 AS pos, count(*) OVER (PARTITION BY nation) AS k FROM nm), v AS (SELECT *, CASE WHEN k>=24 THEN value/(avg(value) OVER (PARTITION BY nation, pos)/avg(value) OVER (PARTITION BY nation)) ELSE value END AS v FROM p),
q AS (SELECT nation, quantile_cont(v,0.5) AS med, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.75) AS q3 FROM v GROUP BY nation), d AS (SELECT v.*, med, q1, q3, quantile_cont(abs(v-med),0.5) OVER (PARTITION BY nation)*1.4826 AS mad FROM v JOIN q USING (nation)),
m AS (SELECT *, v<q1-1.5*(q3-q1)-1e-9*abs(med) OR v>q3+1.5*(q3-q1)+1e-9*abs(med) OR (mad>0 AND abs(v-med)>3*mad+1e-9*abs(med)) AS out_ FROM d)
SELECT nation, count(*) AS n, count(*) FILTER (out_) AS masked, round(avg(v) FILTER (NOT out_)*12,2) AS normalized, round(sum(value)*12/count(*)-avg(v) FILTER (NOT out_)*12,2)+0.0 AS one_off, 2*count(*) FILTER (out_)>count(*) AS over_masked FROM m GROUP BY nation""")
def k17_runrate_normalized(t: Tables) -> DataFrame:
    """Normalised run rate and one-off per nation."""
    return rounded(fin.run_rate(nation_months(t), ["nation"], "ym", "value"), "normalized", "one_off").withColumn("one_off", C("one_off") + 0.0)


@query(f"""WITH {CONTRACTS}, x AS (SELECT *, least(CASE WHEN stop>{ASOF} THEN stop-{ASOF} END, nullif(contract%7,0), nullif(contract%13,0)) AS exit_months FROM ct WHERE stop IS NULL OR stop>{ASOF}),
r AS (SELECT *, CASE WHEN status<>'O' THEN 'discretionary' WHEN exit_months<=1 THEN 'immediate' WHEN exit_months<=3 THEN 'short' WHEN exit_months<=12 THEN 'medium' ELSE 'locked' END AS rung FROM x)
SELECT rung, count(*) AS n, round(sum(amount*12),2) AS annual, round(sum(amount*12-amount*0.5),2) AS net FROM r GROUP BY rung""")
def k18_cuttability_ladder(t: Tables) -> DataFrame:
    """Contracts by the earliest month out and what leaving saves, net of a penalty."""
    nz = lambda m: F.when(C("contract") % m > 0, C("contract") % m)
    x = contracts(t).filter(C("stop").isNull() | (C("stop") > ASOF)).withColumn("e", F.least(C("stop") - ASOF, nz(7), nz(13)))
    rung = F.when(C("status") != "O", "discretionary").when(C("e") <= 1, "immediate").when(C("e") <= 3, "short").when(C("e") <= 12, "medium").otherwise("locked")
    return x.groupBy(rung.alias("rung")).agg(F.count("*").alias("n"), F.round(F.sum(C("amount") * 12), 2).alias("annual"), F.round(F.sum(C("amount") * 12 - C("amount") * 0.5), 2).alias("net"))


@query(f"""WITH {CONTRACTS} SELECT CAST(ym AS BIGINT) AS ym, count(*) AS expected, round(sum(amount),2) AS amount FROM ct, range({ASOF},{ASOF + 24}) x(ym) WHERE ym>=start AND (stop IS NULL OR ym<stop) AND (ym-start)%every=0 GROUP BY ym""")
def k19_expected_presence(t: Tables) -> DataFrame:
    """Contracts expected in each month of a window by their cadence."""
    lo, hi = F.greatest(C("start"), F.lit(ASOF)), F.least(F.coalesce(C("stop") - 1, F.lit(ASOF + 23)), F.lit(ASOF + 23))
    g = contracts(t).filter(lo <= hi).withColumn("ym", F.explode(F.sequence(lo, hi).cast("array<long>"))).filter((C("ym") - C("start")) % C("every") == 0)
    return g.groupBy("ym").agg(F.count("*").alias("expected"), F.round(F.sum("amount"), 2).alias("amount"))


@query("""WITH c AS (SELECT l_returnflag AS driver, l_linestatus AS account, CASE WHEN l_linenumber%2=0 THEN 'EA' ELSE 'KG' END AS unit, sum(l_extendedprice) AS cost, sum(l_quantity)*(CASE WHEN l_returnflag='A' THEN 0 ELSE 1 END) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus, 3)
SELECT driver, account, unit, CASE WHEN unit='EA' AND qty<>0 THEN round(cost/qty,4) END AS unit_cost, CASE WHEN unit<>'EA' THEN 'UNIT_MISMATCH' WHEN qty=0 THEN 'ZERO_DENOM' END AS reason FROM c""")
def k20_driver_unitcost(t: Tables) -> DataFrame:
    """Cost per unit, or why there is none."""
    c = t.lineitem.groupBy(C("l_returnflag").alias("driver"), C("l_linestatus").alias("account"), F.when(C("l_linenumber") % 2 == 0, "EA").otherwise("KG").alias("unit")).agg(F.sum("l_extendedprice").alias("cost"), F.sum(F.when(C("l_returnflag") == "A", 0.0).otherwise(C("l_quantity"))).alias("qty"))
    r = q.ratio(C("cost"), C("qty"), C("unit"), F.lit("EA"))
    return c.select("driver", "account", "unit", F.round(r["value"], 4).alias("unit_cost"), r["reason"].alias("reason"))


@query("""SELECT CAST(p_partkey%24+k AS BIGINT) AS period, count(*) AS assets, round(sum(p_retailprice*0.9/p_size),2) AS dep FROM part, range(1,51) x(k) WHERE k<=p_size AND p_partkey%24+k>12 GROUP BY 1""")
def k21_forward_da(t: Tables) -> DataFrame:
    """Depreciation ahead by period over all assets in service."""
    a = t.part.select(C("p_partkey").alias("asset"), "p_size", C("p_retailprice").alias("cost"), (C("p_retailprice") * 0.1).alias("salvage"), (C("p_partkey") % 24).alias("in_service"))
    g = fin.depreciation(a, "cost", "salvage", "p_size").withColumn("period", C("in_service") + C("k")).filter("period > 12")
    return g.groupBy("period").agg(F.count("*").alias("assets"), F.round(F.sum("dep"), 2).alias("dep"))


@query(f"""WITH {NM}, x AS (SELECT nation, ym, value AS add, lag(value,1,0) OVER (PARTITION BY nation ORDER BY ym)*1.1 AS want FROM nm), s AS (SELECT *, 5000+sum(add-want) OVER (PARTITION BY nation ORDER BY ym) AS s FROM x)
SELECT nation, ym, round(s-least(0,min(s) OVER (PARTITION BY nation ORDER BY ym)),4) AS ending FROM s""")
def k22_prepaid_rollforward(t: Tables) -> DataFrame:
    """Beginning plus additions less amortisation, which stops at what is there: a closed form over running minima."""
    w = Window.partitionBy("nation").orderBy("ym")
    s = nation_months(t).withColumn("want", F.coalesce(F.lag("value").over(w), F.lit(0.0)) * 1.1).withColumn("s", 5000 + F.sum(C("value") - C("want")).over(w))
    return s.select("nation", "ym", F.round(C("s") - F.least(F.lit(0.0), F.min("s").over(w)), 4).alias("ending"))


@query("""WITH l AS (SELECT s_suppkey AS lease, CAST(k AS INT) AS k, CASE WHEN k<=s_suppkey%3 THEN 0.0 ELSE 1000.0+s_suppkey END AS pay, 0.005+(s_suppkey%10)/1000.0 AS rate FROM supplier, range(1,25) x(k)),
d AS (SELECT *, sum(pay/pow(1+rate,k)) OVER (PARTITION BY lease ORDER BY k DESC) AS pv FROM l)
SELECT lease, k, round(pv*pow(1+rate,k-1),4) AS opening, round(pv*pow(1+rate,k-1)*rate,4) AS interest, round(pv*pow(1+rate,k-1)*(1+rate)-pay,4) AS closing, round(max(pv) OVER (PARTITION BY lease)/24,4) AS rou_dep FROM d""")
def k23_lease_ifrs16(t: Tables) -> DataFrame:
    """Lease liabilities with rent-free periods: opening, interest, closing and asset depreciation."""
    l = t.supplier.select(C("s_suppkey").alias("lease"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("k")).withColumns({"pay": F.when(C("k") <= C("lease") % 3, 0.0).otherwise(1000.0 + C("lease")), "rate": 0.005 + (C("lease") % 10) / 1000.0})
    return rounded(fin.lease_schedule(l), "opening", "interest", "closing", "rou_dep", places=4).select("lease", "k", "opening", "interest", "closing", "rou_dep")


SERVICES = [(1, 2), (2, 0), (3, 1)]  # rank and nation


@query("""WITH d AS (SELECT c_mktsegment AS entity, c_nationkey AS dept, count(*) AS n, sum(abs(c_acctbal)) AS cost FROM customer GROUP BY 1,2),
own AS (SELECT entity, coalesce(sum(cost) FILTER (dept=2),0) AS c2 FROM d GROUP BY 1),
one AS (SELECT d.entity, dept, n, CASE WHEN dept=2 THEN 0 ELSE cost+c2*(n*(1+dept%3))/(SELECT sum(x.n*(1+x.dept%3)) FROM d x WHERE x.entity=d.entity AND x.dept<>2) END AS cost FROM d JOIN own USING (entity)),
own0 AS (SELECT entity, coalesce(sum(cost) FILTER (dept=0),0) AS c0 FROM one GROUP BY 1),
two AS (SELECT one.entity, dept, n, CASE WHEN dept=0 THEN 0 WHEN dept>2 THEN cost+c0/(SELECT count(*) FROM d x WHERE x.entity=one.entity AND x.dept>2) ELSE cost END AS cost FROM one JOIN own0 USING (entity)),
own1 AS (SELECT entity, coalesce(sum(cost) FILTER (dept=1),0) AS c1 FROM two GROUP BY 1)
SELECT two.entity, dept, CASE WHEN dept<3 THEN 'service' ELSE 'production' END AS kind, round(CASE WHEN dept=1 THEN 0 WHEN dept>2 THEN
cost+c1*n/(SELECT sum(x.n) FROM d x WHERE x.entity=two.entity AND x.dept>2) ELSE cost END,2) AS cost FROM two JOIN own1 USING (entity)""")
def k24_step_down_allocation(t: Tables) -> DataFrame:
    """Segments as entities, nations as departments. Nation 2 passes on to all by weights; nation 0's only driver is nation 2,
    which is closed, so its cost goes evenly to production; nation 1's drivers are all, of which three are closed."""
    d = t.customer.groupBy(C("c_mktsegment").alias("entity"), C("c_nationkey").alias("dept")).agg(F.count("*").alias("n"), F.sum(F.abs("c_acctbal")).alias("cost"))
    costs = d.select("entity", "dept", F.when(C("dept") < 3, "service").otherwise("production").alias("kind"), "cost")
    to = d.select("entity", C("dept").alias("target"), "n")
    drivers = to.select("entity", F.lit(2).alias("source"), "target", (C("n") * (1 + C("target") % 3)).alias("weight")).unionByName(
        to.filter("target = 2").select("entity", F.lit(0).alias("source"), "target", C("n").alias("weight"))
    ).unionByName(to.select("entity", F.lit(1).alias("source"), "target", C("n").alias("weight")))
    order = d.select("entity").distinct().select("entity", F.inline(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(s).alias("source")) for r, s in SERVICES))))
    kind = d.schema["dept"].dataType
    return rounded(allocation.step_down(costs, drivers.withColumn("source", C("source").cast(kind)), order.withColumn("source", C("source").cast(kind))), "cost")


@query(f"""WITH {BY}, p AS (SELECT a.brand AS product, a.revenue/a.qty AS p0, a.qty AS q0, b.revenue/b.qty AS p1, b.qty AS q1 FROM by_ a JOIN by_ b USING (brand) WHERE a.y=1996 AND b.y=1997), s AS (SELECT *, sum(q0) OVER () AS t0, sum(q1) OVER () AS t1, sum(p0*q0) OVER ()/sum(q0) OVER () AS avg0 FROM p)
SELECT product, round((p1-p0)*q1,2) AS price, round((t1-t0)*q0/t0*avg0,2) AS volume, round((q1-q0)*p0-(t1-t0)*q0/t0*avg0,2) AS mix FROM s""")
def k25_pvm_bridge(t: Tables) -> DataFrame:
    """Price, volume and mix effects per product; they add up to the change."""
    by = brand_years(t)
    side = lambda y, k: by.filter(C("y") == y).select(C("brand").alias("product"), (C("revenue") / C("qty")).alias(f"p{k}"), C("qty").alias(f"q{k}"))
    p = side(1996, 0).join(side(1997, 1), "product")
    tot = p.agg(F.sum("q0").alias("t0"), F.sum("q1").alias("t1"), (F.sum(C("p0") * C("q0")) / F.sum("q0")).alias("avg0"))
    s = p.crossJoin(F.broadcast(tot)).withColumn("volume", (C("t1") - C("t0")) * C("q0") / C("t0") * C("avg0"))
    return s.select("product", F.round((C("p1") - C("p0")) * C("q1"), 2).alias("price"), F.round("volume", 2).alias("volume"), F.round((C("q1") - C("q0")) * C("p0") - C("volume"), 2).alias("mix"))


@query("""SELECT coalesce(n_regionkey,-1) AS segment, coalesce(n_nationkey,-1) AS entity, round(sum(c_acctbal*(1+n_nationkey/100)),2) AS amount FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY ROLLUP(n_regionkey, n_nationkey)""")
def k27_consolidation_fx(t: Tables) -> DataFrame:
    """Local amounts at their rates, rolled up by segment."""
    j = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
    return j.withColumns({"segment": C("n_regionkey"), "entity": C("n_nationkey")}).rollup("segment", "entity").agg(F.round(F.sum(C("c_acctbal") * (1 + C("n_nationkey") / 100)), 2).alias("amount")).fillna(-1, ["segment", "entity"])


@query(f"""WITH {NY} SELECT nation, y, round(open*0.2+closed*0.1-value*0.05,2) AS wc, round(open*0.2/nullif(value,0)*365,4) AS dso, round(closed*0.1/nullif(closed*0.6,0)*365,4) AS dio, round(value*0.05/nullif(closed*0.6,0)*365,4) AS dpo, round(open*0.2/nullif(value,0)*365+closed*0.1/nullif(closed*0.6,0)*365-value*0.05/nullif(closed*0.6,0)*365,4) AS ccc FROM ny""")
def k28_working_capital(t: Tables) -> DataFrame:
    """Working capital, days of receivables, inventory and payables, and the cash cycle."""
    d = lambda a, b: q.ratio(a, b)["value"] * 365
    ny = nation_years(t).withColumns({"dso": d(C("open") * 0.2, C("value")), "dio": d(C("closed") * 0.1, C("closed") * 0.6), "dpo": d(C("value") * 0.05, C("closed") * 0.6)})
    return ny.select("nation", "y", F.round(C("open") * 0.2 + C("closed") * 0.1 - C("value") * 0.05, 2).alias("wc"), *(F.round(C(c), 4).alias(c) for c in ("dso", "dio", "dpo")), F.round(C("dso") + C("dio") - C("dpo"), 4).alias("ccc"))


@query("""WITH w AS (SELECT n_regionkey AS pool, n_nationkey AS cc, count(c_custkey) AS weight FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1,2), p AS (SELECT n_regionkey AS pool, sum(s_acctbal) AS amount FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY 1),
s AS (SELECT pool, cc, amount, weight, sum(weight) OVER (PARTITION BY pool) AS tw, round(amount*weight/sum(weight) OVER (PARTITION BY pool),2) AS part, row_number() OVER (PARTITION BY pool ORDER BY cc DESC) AS back FROM w JOIN p USING (pool))
SELECT pool, cc, round(CASE WHEN back=1 THEN amount-coalesce(sum(part) OVER (PARTITION BY pool ORDER BY cc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) ELSE part END,2) AS share FROM s""")
def k29_cost_allocation(t: Tables) -> DataFrame:
    """Region pools to nations by customer counts; the last takes the remainder."""
    w = t.nation.join(t.customer, C("c_nationkey") == C("n_nationkey"), "left").groupBy(C("n_regionkey").alias("pool"), C("n_nationkey").alias("cc")).agg(F.count("c_custkey").alias("weight"))
    p = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).groupBy(C("n_regionkey").alias("pool")).agg(F.sum("s_acctbal").alias("amount"))
    return fin.allocate(w.join(p, "pool"), "pool", "cc", "weight", "amount").select("pool", "cc", F.round("share", 2).alias("share"))


@query(f"""WITH {NY} SELECT nation, y, round(closed*0.1/nullif(value,0),4) AS margin, round(value/nullif(open+closed,0),4) AS turnover, round((open+closed)/nullif(closed*0.5,0),4) AS leverage, round(closed*0.1/nullif(closed*0.5,0),4) AS roe FROM ny""")
def k30_dupont_roic(t: Tables) -> DataFrame:
    """Margin, turnover and leverage, whose product is the return on equity."""
    r = lambda a, b, n: F.round(q.ratio(a, b)["value"], 4).alias(n)
    return nation_years(t).select("nation", "y", r(C("closed") * 0.1, C("value"), "margin"), r(C("value"), C("open") + C("closed"), "turnover"), r(C("open") + C("closed"), C("closed") * 0.5, "leverage"), r(C("closed") * 0.1, C("closed") * 0.5, "roe"))


@query("""SELECT field, status, count(*) AS n FROM (SELECT 'c_acctbal' AS field, CASE WHEN c_acctbal IS NULL THEN 'VIOLATION' WHEN c_acctbal<0 OR c_acctbal>9000 THEN 'VIOLATION' ELSE 'OK' END AS status FROM customer UNION ALL SELECT 'c_mktsegment', CASE WHEN c_mktsegment IS NULL THEN 'NO_DATA' WHEN c_mktsegment NOT IN ('BUILDING','MACHINERY') THEN 'VIOLATION' ELSE 'OK' END FROM customer) GROUP BY 1,2""")
def k31_metric_table(t: Tables) -> DataFrame:
    """Q20: field contracts over a table."""
    c = t.customer.select(F.explode(F.array(F.struct(F.lit("c_acctbal").alias("field"), q.field_contract(C("c_acctbal"), False, low=0, high=9000).alias("status")), F.struct(F.lit("c_mktsegment").alias("field"), q.field_contract(C("c_mktsegment"), accepted=["BUILDING", "MACHINERY"]).alias("status")))).alias("x")).select("x.*")
    return c.groupBy("field", "status").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT round(sum(o_totalprice),2) AS v, count(*) AS n FROM orders), b AS (SELECT round(sum(o_totalprice),2) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey)
SELECT 'orders.total=board.total' AS tie, abs(a.v-b.v)<=1 AS ok FROM a,b UNION ALL SELECT 'orders.count=board.count', a.n=b.n FROM a,b""")
def k32_board_ties(t: Tables) -> DataFrame:
    """Tie rules over a facts table of exhibits."""
    figures = lambda df, x: df.agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("count")).unpivot([], ["total", "count"], "key", "value").withColumn("exhibit", F.lit(x))
    facts = figures(t.orders, "orders").unionByName(figures(t.orders.join(t.customer, C("o_custkey") == C("c_custkey")), "board"))
    a, b = facts.filter("exhibit = 'orders'"), facts.filter("exhibit = 'board'").select("key", C("value").alias("other"))
    return a.join(b, "key").select(F.concat(F.lit("orders."), "key", F.lit("=board."), "key").alias("tie"), q.tie_out(C("value"), C("other"), 1.0).alias("ok"))


@query(f"""WITH {BY}, p AS (SELECT a.brand, a.revenue/a.qty AS r0, a.qty AS v0, b.revenue/b.qty AS r1, b.qty AS v1 FROM by_ a JOIN by_ b USING (brand) WHERE a.y=1995 AND b.y=1996)
SELECT brand, round((r1*v1-r0*v0)/(ln(r1*v1)-ln(r0*v0))*ln(r1/r0),2) AS rate, round((r1*v1-r0*v0)/(ln(r1*v1)-ln(r0*v0))*ln(v1/v0),2) AS volume FROM p""")
def f15_lmdi(t: Tables) -> DataFrame:
    """Rate and volume effects by logarithmic means."""
    by = brand_years(t)
    side = lambda y, k: by.filter(C("y") == y).select("brand", (C("revenue") / C("qty")).alias(f"r{k}"), C("qty").alias(f"v{k}"))
    e = fin.lmdi(C("r0"), C("v0"), C("r1"), C("v1"))
    return side(1995, 0).join(side(1996, 1), "brand").select("brand", F.round(e["rate"], 2).alias("rate"), F.round(e["volume"], 2).alias("volume"))


@query(f"""WITH {NM}, s AS (SELECT nation, ln(value/lag(value) OVER w) AS dc, ln(n*1.0/lag(n) OVER w) AS da FROM nm WINDOW w AS (PARTITION BY nation ORDER BY ym)) SELECT nation, round(avg(dc/da) FILTER (da>0),4) AS up, round(avg(dc/da) FILTER (da<0),4) AS down FROM s WHERE dc IS NOT NULL AND da IS NOT NULL GROUP BY nation""")
def f16_stickiness(t: Tables) -> DataFrame:
    return rounded(fin.stickiness(nation_months(t), ["nation"], "ym", "value", "n"), "up", "down", places=4)


@query(f"""WITH {NM}, m AS (SELECT nation, quantile_cont(value,0.5) AS median, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM nm GROUP BY nation)
SELECT nation, round(any_value(median),2) AS median, round(1.4826*quantile_cont(abs(value-median),0.5),2) AS mad, round(any_value(q1-1.5*(q3-q1)),2) AS low, round(any_value(q3+1.5*(q3-q1)),2) AS high FROM nm JOIN m USING (nation) GROUP BY nation""")
def f12_robust(t: Tables) -> DataFrame:
    return rounded(fin.robust(nation_months(t), ["nation"], "value"), "median", "mad", "low", "high")


@query(f"""WITH {NY} SELECT a.nation, round(pow(b.value/a.value,1/4.0)-1,6) AS cagr FROM ny a JOIN ny b USING (nation) WHERE a.y=1996 AND b.y=2000""")
def f6_cagr(t: Tables) -> DataFrame:
    ny = nation_years(t)
    j = ny.filter("y = 1996").select("nation", C("value").alias("a")).join(ny.filter("y = 2000").select("nation", C("value").alias("b")), "nation")
    return j.select("nation", F.round(fin.cagr(C("a"), C("b"), F.lit(4)), 6).alias("cagr"))


@query("""SELECT s_suppkey AS firm, round(e/(e+d)*(0.08+s_suppkey%5/100.0)+d/(e+d)*0.05*(1-0.25),6) AS wacc FROM (SELECT s_suppkey, abs(s_acctbal)+1 AS e, 1000.0+s_suppkey AS d FROM supplier)""")
def f4_wacc(t: Tables) -> DataFrame:
    e, d = F.abs("s_acctbal") + 1, 1000.0 + C("s_suppkey")
    return t.supplier.select(C("s_suppkey").alias("firm"), F.round(fin.wacc(e, d, 0.08 + C("s_suppkey") % 5 / 100.0, F.lit(0.05), F.lit(0.25)), 6).alias("wacc"))
