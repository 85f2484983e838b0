"""Queries of analyses' checks, debt, linked packs and contracts, with rows that must fail beside those that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.analyses import funding, statements
from tallywright.operators import checks as q
from tallywright.operators import contracts as co
from tallywright.plans.facts import BY, NM, NY, brand_years, exact, nation_months, nation_years, rounded
from tallywright.plans.registry import Tables, query

C = F.col


@query(f"""WITH {BY}, i AS (SELECT left(brand,length(brand)-1) AS report, brand, max(revenue) FILTER (y=1996) AS plan, max(revenue) FILTER (y=1997 AND right(brand,1)<>'3') AS actual FROM by_ GROUP BY 1,2)
SELECT report, count(*) FILTER (plan IS NULL OR actual IS NULL) AS unmatched, count(*) FILTER (plan IS NULL OR actual IS NULL)=0 AS aligned, true AS bridge_ok,
round(sum(CASE WHEN right(brand,1)='2' THEN -1 ELSE 1 END*(coalesce(actual,0)-coalesce(plan,0))),2) AS total FROM i GROUP BY report""")
def k1_variance_checks(t: Tables) -> DataFrame:
    """A report per brand group: brands ending in 2 are costs, those ending in 3 have no actual, so their scenarios differ."""
    by = brand_years(t).withColumn("report", F.expr("left(brand, length(brand) - 1)"))
    of = lambda y, ok: F.max(F.when((C("y") == y) & ok, C("revenue")))
    items = by.groupBy("report", "brand").agg(of(1996, F.lit(True)).alias("plan"), of(1997, ~C("brand").endswith("3")).alias("actual")).withColumn("cost", C("brand").endswith("2"))
    v = statements.variance(items, "brand", cost="cost", report=("report",))
    total = v.groupBy("report").agg(F.round(F.sum("signed"), 2).alias("total"))
    return statements.check_variance(v, "brand", report=("report",)).join(total, "report")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS customer, year(o_orderdate) AS y FROM orders) SELECT customer, max(y)-min(y)+1-count(*) AS missing, max(y)-min(y)+1=count(*) AS ok FROM f GROUP BY customer""")
def k2_ruler(t: Tables) -> DataFrame:
    """Customers by the years that they lack between their first and last order."""
    return statements.check_ruler(t.orders.select(C("o_custkey").alias("customer"), F.year("o_orderdate").alias("y")), ["customer"], "y")


@query(f"""WITH {NM}, l AS (SELECT max(ym)-6 AS cut FROM nm) SELECT nation, NOT (nation%4=1 AND max(ym)>any_value(cut)) AS exclusive, max(ym)-min(ym)+1=count(*) AND nation%4<>2 AS exhaustive, NOT ((nation%4=1 AND max(ym)>any_value(cut)) OR (nation%4=3 AND count(*) FILTER (ym>cut)>=2)) AS contiguous FROM nm, l GROUP BY nation""")
def k3_partition(t: Tables) -> DataFrame:
    """Actuals up to a cut and forecasts after it; some nations have a month in both, one in neither or a late actual."""
    nm = nation_months(t)
    cut = nm.agg((F.max("ym") - 6).alias("cut"))
    ends = nm.groupBy("nation").agg(F.min("ym").alias("lo"), F.max("ym").alias("hi"))
    s = nm.select("nation", "ym").crossJoin(F.broadcast(cut)).join(ends, "nation").withColumn("class", F.when(C("ym") <= C("cut"), "actual").otherwise("forecast"))
    odd = C("nation") % 4
    s = s.withColumn("class", F.when((odd == 2) & (C("ym") == C("hi")), "none").when((odd == 3) & (C("ym") == C("hi")), "actual").otherwise(C("class")))
    both = s.filter((odd == 1) & (C("ym") == C("hi"))).withColumn("class", F.lit("actual"))
    return statements.check_partition(s.unionByName(both), ["nation"], "ym")


@query(f"""WITH {NY}, p AS (SELECT nation, y, value AS revenue, closed*0.6 AS cogs, value*0.1 AS sga, value*0.05 AS da, open*0.02 AS interest, value*0.01 AS nwc FROM ny),
n AS (SELECT *, revenue-cogs-sga-da-interest-greatest(revenue-cogs-sga-da-interest,0)*0.25 AS ni FROM p),
c AS (SELECT *, 1000+sum(ni+da-nwc-ni*0.3) OVER w AS cash, 500+sum(ni-ni*0.3) OVER w AS retained FROM n WINDOW w AS (PARTITION BY nation ORDER BY y))
SELECT nation, y, round(ni,2) AS ni, round(cash,2) AS cash, round(retained,2) AS retained, nation%5<>0 AS balance_ok, nation%5<>0 AS cash_ok FROM c""")
def k8_balance_and_cash(t: Tables) -> DataFrame:
    """Statements per nation and year; every fifth nation reports cash ten too high and fails both ties."""
    p = nation_years(t).select(
        "nation", "y", C("value").alias("revenue"), (C("closed") * 0.6).alias("cogs"), (C("value") * 0.1).alias("sga"), (C("value") * 0.05).alias("da"), (C("open") * 0.02).alias("interest"), (C("value") * 0.01).alias("delta_nwc"),
        F.lit(0.25).alias("tax_rate"), F.lit(1000.0).alias("cash0"), F.lit(800.0).alias("other0"), F.lit(700.0).alias("liabilities"), F.lit(600.0).alias("paid_in"), F.lit(500.0).alias("re0"),
    )
    ebt = C("revenue") - C("cogs") - C("sga") - C("da") - C("interest")
    s = statements.statements(p.withColumn("dividends", 0.3 * (ebt - F.greatest(ebt, F.lit(0.0)) * C("tax_rate"))), ["nation"], "y")
    done = statements.check_statements(s, C("cash") + F.when(C("nation") % 5 == 0, 10.0).otherwise(0.0))
    return rounded(done.select("nation", "y", "ni", "cash", "retained", "balance_ok", "cash_ok"), "ni", "cash", "retained")


@query(f"""WITH {NY}, f AS (SELECT nation, y-min(y) OVER (PARTITION BY nation) AS age, value, lag(value) OVER (PARTITION BY nation ORDER BY y) AS prev, first_value(value) OVER (PARTITION BY nation ORDER BY y) AS base FROM ny),
c AS (SELECT nation, age, base, CASE WHEN age>0 AND nation%6<>0 THEN greatest(prev-value,0) WHEN age=2 AND nation%6=0 THEN -100.0 ELSE 0 END AS lost, CASE WHEN age>0 THEN greatest(value-prev,0) ELSE 0 END AS won FROM f),
r AS (SELECT nation, age, (base-sum(lost) OVER w)/base AS grr, (base-sum(lost) OVER w+sum(won) OVER w)/base AS nrr FROM c WINDOW w AS (PARTITION BY nation ORDER BY age)),
l AS (SELECT *, grr>lag(grr) OVER (PARTITION BY nation ORDER BY age)+1e-9 AS rises FROM r)
SELECT nation AS cohort, round(min(grr),4) AS least_grr, NOT bool_or(coalesce(rises,false)) AS monotone, bool_and(grr<=nrr+1e-9) AS bounded FROM l GROUP BY nation""")
def k10_cohort_checks(t: Tables) -> DataFrame:
    """Nations as cohorts whose yearly falls are churn and rises expansion; in every sixth one a loss is booked as a gain."""
    w = Window.partitionBy("nation").orderBy("y")
    step = C("value") - F.lag("value").over(w)
    odd = C("nation") % 6 == 0
    f = nation_years(t).select("nation", (C("y") - F.min("y").over(Window.partitionBy("nation"))).cast("long").alias("age"), C("value").alias("start"), F.coalesce(step, F.lit(0.0)).alias("step"))
    cells = f.select(
        C("nation").alias("cohort"), "age", "start", F.when(odd, F.when(C("age") == 2, -100.0).otherwise(0.0)).otherwise(F.greatest(-C("step"), F.lit(0.0))).alias("churn"),
        F.lit(0.0).alias("contraction"), F.greatest("step", F.lit(0.0)).alias("expansion"),
    )
    curves = statements.cohort_curves(cells)
    return statements.check_cohorts(curves).join(curves.groupBy("cohort").agg(F.round(F.min("grr"), 4).alias("least_grr")), "cohort")


@query(f"""WITH {NY}, f AS (SELECT nation AS project, y-min(y) OVER (PARTITION BY nation) AS t, CASE WHEN y=min(y) OVER (PARTITION BY nation) THEN -3*value ELSE value END AS cash, max(y) OVER (PARTITION BY nation)=y AS last_, 1000.0*nation AS terminal FROM ny),
d AS (SELECT project, t, cash+CASE WHEN last_ THEN terminal ELSE 0 END AS cash FROM f)
SELECT project, CAST(t AS INT) AS t, round(cash,2) AS cash, round(cash/pow(1.08,t),2) AS discounted, round(sum(cash/pow(1.08,t)) OVER (PARTITION BY project ORDER BY t),2) AS cumulative FROM d""")
def k13_cash_flow_rows(t: Tables) -> DataFrame:
    """Discounted rows of every project with a terminal value in its last year."""
    first = F.min("y").over(Window.partitionBy("nation"))
    f = nation_years(t).select(C("nation").alias("project"), (C("y") - first).cast("int").alias("t"), F.when(C("y") == first, -3 * C("value")).otherwise(C("value")).alias("cash"), (1000.0 * C("nation")).alias("terminal"))
    rows = statements.appraisal_rows(f, "project", F.lit(0.08), "terminal")
    return rounded(rows.select("project", "t", "cash", "discounted", "cumulative"), "cash", "discounted", "cumulative")


@query(f"""WITH {NY}, x AS (SELECT a.nation, a.value AS base, b.value AS end_, CASE WHEN a.nation%7=0 THEN 5.0 ELSE 0 END AS off FROM ny a JOIN ny b USING (nation) WHERE a.y=1997 AND b.y=1998)
SELECT nation, round(base,2) AS base, round(end_,2) AS "end", round((end_-base)*0.8,2) AS own, round((end_-base)*0.2+off,2) AS fx, nation%7<>0 AS ok FROM x""")
def k15_fx_split(t: Tables) -> DataFrame:
    """A bridge per nation in two factors with their currency effect; every seventh doesn't close."""
    ny = nation_years(t)
    j = ny.filter("y = 1997").select("nation", C("value").alias("base")).join(ny.filter("y = 1998").select("nation", C("value").alias("end")), "nation")
    d = C("end") - C("base")
    off = F.when(C("nation") % 7 == 0, 5.0).otherwise(0.0)
    part = lambda n, amount, fx: F.struct(F.lit(n).alias("factor"), amount.alias("amount"), fx.alias("fx_effect"))
    f = j.select("nation", "base", "end", F.explode(F.array(part("price", d * 0.6, d * 0.2), part("volume", d * 0.4 + off, off))).alias("f")).select("nation", "base", "end", "f.*")
    return rounded(statements.fx_split(f, ["nation"]).select("nation", "base", "end", "own", "fx", "ok"), "base", "end", "own", "fx")


MODEL = f"{NM}, fl AS (SELECT nation AS model, ym, value-avg(value) OVER (PARTITION BY nation) AS flow, row_number() OVER (PARTITION BY nation ORDER BY ym) AS i FROM nm)"
SOLVED = f"""RECURSIVE_ {MODEL}, st(model, i, ym, cash, rev, term, draw, repay, interest) AS (
SELECT DISTINCT model, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1000.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(200000.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM fl
UNION ALL SELECT z.model, z.i, z.ym, z.cash+z.flow-((z.rev+z.draw/2-z.p1/2)*0.01+(z.term-z.p2/2)*0.008)+z.draw-z.p1-z.p2, z.rev+z.draw-z.p1, z.term-z.p2, z.draw, z.p1+z.p2, (z.rev+z.draw/2-z.p1/2)*0.01+(z.term-z.p2/2)*0.008
FROM (SELECT *, least(term, (greatest(-need,0)-p1*0.995)/0.996) AS p2 FROM (SELECT *, CASE WHEN need>0 THEN least(need/0.995, greatest(1e6-rev,0)) ELSE 0 END AS draw, least(rev, greatest(-need,0)/0.995) AS p1
FROM (SELECT s.model, f.i, f.ym, s.cash, s.rev, s.term, f.flow, 500-s.cash-f.flow+s.rev*0.01+s.term*0.008 AS need FROM st s JOIN fl f ON f.model=s.model AND f.i=s.i+1))) z)"""


def solved(t: Tables) -> DataFrame:
    """Per nation a revolver and a term loan over its months; flows are what is above or below the average."""
    m = nation_months(t).withColumn("flow", C("value") - F.avg("value").over(Window.partitionBy("nation")))
    models = m.select(C("nation").alias("model")).distinct()
    facilities = models.select("model", F.lit(1000.0).alias("cash0"), F.lit(500.0).alias("floor"), F.lit(1e6).alias("top"), F.lit(True).alias("sweep"))
    kind = lambda n, o, r, k: F.struct(F.lit(n).alias("name"), F.lit(o).alias("opening"), F.lit(r).alias("rate"), F.lit(k).alias("rank"))
    tranches = models.select("model", F.inline(F.array(kind("revolver", 0.0, 0.01, 1), kind("term", 200_000.0, 0.008, 2))))
    return funding.solve(m.select(C("nation").alias("model"), C("ym").alias("k"), "flow"), facilities, tranches)


@query(f"WITH {SOLVED} SELECT model, CAST(ym AS INT) AS k, round(draw,2) AS draw, round(repay,2) AS repay, round(rev,2) AS revolver, round(rev+term,2) AS debt, round(interest,2) AS interest, round(cash,2) AS cash FROM st WHERE i>0".replace("RECURSIVE_ ", "RECURSIVE "))
def k26_debt_revolver(t: Tables) -> DataFrame:
    """F19 per nation: draws, repayments in order, balances, interest on average debt and cash by month."""
    return rounded(solved(t).drop("balances"), "draw", "repay", "revolver", "debt", "interest", "cash")


@query(f"""WITH RECURSIVE {MODEL}, st(model, i, a, b, rev, a0, b0, r0, am, asw, bsw, rp, dr) AS (
SELECT DISTINCT model, CAST(0 AS BIGINT), CAST(100000.0 AS DOUBLE), CAST(50000.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM fl
UNION ALL SELECT model, i, a-am-asw, b-bsw, rev+dr-rp, a, b, rev, am, asw, bsw, rp, dr FROM (SELECT *, CASE WHEN c2>0 THEN least(c2, rev) ELSE 0 END AS rp, CASE WHEN c2<0 THEN -c2 ELSE 0 END AS dr FROM (SELECT *, c1-bsw AS c2 FROM (SELECT *, CASE WHEN c1>0 THEN least(c1, b) ELSE 0 END AS bsw FROM (SELECT *, flow-asw AS c1 FROM (SELECT *, CASE WHEN flow>0 THEN least(flow, a-am) ELSE 0 END AS asw FROM
(SELECT s.model, f.i, s.a, s.b, s.rev, f.flow, least(CASE WHEN f.i<=12 THEN 2000.0 ELSE 0 END, s.a) AS am FROM st s JOIN fl f ON f.model=s.model AND f.i=s.i+1)))))))
SELECT model AS facility, x.tranche, CAST(i AS INT) AS k, round(x.o,2) AS opening, round(x.o*x.r,2) AS interest, round(x.m,2) AS mandatory, round(x.s,2) AS sweep, round(x.d,2) AS draw, round(x.c,2) AS closing
FROM st, LATERAL (VALUES ('senior', a0, 0.008, am, asw, 0.0, a), ('junior', b0, 0.012, 0.0, bsw, 0.0, b), ('revolver', r0, 0.01, rp, 0.0, dr, rev)) x(tranche, o, r, m, s, d, c) WHERE i>0""")
def k26_debt_schedule(t: Tables) -> DataFrame:
    """Per nation a senior loan with twelve mandatory payments, a junior one and a revolver; surplus months sweep in order."""
    nm = nation_months(t)
    p = nm.select(C("nation").alias("facility"), F.row_number().over(Window.partitionBy("nation").orderBy("ym")).alias("k"), (C("value") - F.avg("value").over(Window.partitionBy("nation"))).alias("cash"))
    kind = lambda n, o, k, b, r, m: F.struct(F.lit(n).alias("tranche"), F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(b).alias("opening"), F.lit(r).alias("rate"), F.lit(True).alias("sweep_enabled"), F.array_repeat(F.lit(2000.0), m).alias("mandatory"))
    tr = nm.select(C("nation").alias("facility")).distinct().select("facility", F.inline(F.array(kind("senior", 1, "term", 100_000.0, 0.008, 12), kind("junior", 2, "term", 50_000.0, 0.012, 0), kind("revolver", 3, "revolver", 0.0, 0.01, 0))))
    return rounded(funding.schedule(p, tr), "opening", "interest", "mandatory", "sweep", "draw", "closing")


@query("""WITH e AS (SELECT n_regionkey AS segment, c_acctbal AS a, 1+n_nationkey/100.0 AS r, c_custkey%10=0 AS el FROM customer JOIN nation ON c_nationkey=n_nationkey)
SELECT coalesce(segment,-1) AS segment, round(sum(CASE WHEN NOT el THEN a*r ELSE 0 END),2) AS gross, round(sum(CASE WHEN el THEN -a*r ELSE 0 END),2) AS eliminated, round(sum(CASE WHEN el THEN -a*r ELSE a*r END),2) AS net FROM e GROUP BY ROLLUP(segment)""")
def k27_eliminations(t: Tables) -> DataFrame:
    """Customers' balances at their nation's rate by region; every tenth is an elimination with its sign turned."""
    e = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).withColumn("is_elimination", C("c_custkey") % 10 == 0)
    e = e.select(C("n_regionkey").alias("segment"), F.when(C("is_elimination"), -C("c_acctbal")).otherwise(C("c_acctbal")).alias("local_amount"), (1 + C("n_nationkey") / 100).alias("fx_rate"), "is_elimination")
    return rounded(statements.consolidate(e, "segment").fillna(-1, ["segment"]), "gross", "eliminated", "net")


@query(f"""WITH {NY} SELECT nation, y, round(closed*0.2*0.75/nullif(open*0.5+closed*0.5,0),4) AS roic, round(closed*0.2*0.75/nullif(open*0.5+closed*0.5,0)-0.08,4) AS spread FROM ny""")
def k30_roic(t: Tables) -> DataFrame:
    """Return on debt and equity after tax and its spread over the cost of capital."""
    df = nation_years(t).select("nation", "y", (C("closed") * 0.1).alias("net_income"), C("value").alias("sales"), (C("open") + C("closed")).alias("assets"), (C("closed") * 0.5).alias("equity"), (C("closed") * 0.2).alias("ebit"), (C("open") * 0.5).alias("debt"), F.lit(0.25).alias("tax_rate"), F.lit(0.08).alias("wacc"))
    return rounded(statements.returns(df).select("nation", "y", "roic", "spread"), "roic", "spread", places=4)


@query(f"""WITH {NM}, m AS (SELECT DISTINCT nation AS model FROM nm) SELECT model, k.tie, CASE k.tie WHEN 'balance' THEN model%5<>1 WHEN 'cash' THEN model%5<>1 WHEN 'debt' THEN model%5<>2 WHEN 'interest' THEN model%5<>3 ELSE model%5<>4 END AS ok FROM m, (VALUES ('balance'),('cash'),('debt'),('depreciation'),('interest')) k(tie)""")
def k33_pack_ties(t: Tables) -> DataFrame:
    """Five ties of a linked model per nation: its debt comes from F19 and its statements report one figure wrong in most nations."""
    s = solved(t)
    off = lambda k: F.when(C("model") % 5 == k, 7.0).otherwise(0.0)
    g = s.groupBy("model").agg(F.sum("interest").alias("paid"), F.sum("draw").alias("drawn"), F.sum("repay").alias("back"), F.max_by("debt", "k").alias("debt"), F.max_by("cash", "k").alias("cash"))
    flow = nation_months(t).withColumn("flow", C("value") - F.avg("value").over(Window.partitionBy("nation"))).groupBy(C("nation").alias("model")).agg(F.sum("flow").alias("flow"), F.count("*").alias("months"))
    lag = Window.partitionBy("model").orderBy("k")
    rate = s.withColumn("open", F.lag("balances", 1).over(lag)).withColumn("open", F.coalesce("open", F.array(F.lit(0.0), F.lit(200_000.0))))
    again = rate.groupBy("model").agg(F.sum((C("open")[0] + C("balances")[0]) / 2 * 0.01 + (C("open")[1] + C("balances")[1]) / 2 * 0.008).alias("charged"))
    j = g.join(flow, "model").join(again, "model")
    facts = j.select("model", F.inline(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {
        "assets": C("cash") + off(1), "claims": C("debt") + (1000.0 - 200_000.0) + C("flow") - C("paid"),
        "flow_cash": 1000.0 + C("flow") - C("paid") + C("drawn") - C("back"), "sheet_cash": C("cash") + off(1),
        "schedule_debt": 200_000.0 + C("drawn") - C("back"), "sheet_debt": C("debt") + off(2),
        "schedule_da": C("months") * 10.0, "income_da": C("months") * 10.0 + off(4), "charged": C("charged"), "income_interest": C("paid") + off(3),
    }.items()))))
    rules = [("balance", "assets", "claims"), ("cash", "flow_cash", "sheet_cash"), ("debt", "schedule_debt", "sheet_debt"), ("depreciation", "schedule_da", "income_da"), ("interest", "charged", "income_interest")]
    return statements.cross_ties(facts, rules).select("model", "tie", "ok")


@query("""SELECT 'orders' AS name, round(sum(o_totalprice),2) AS raw, round(sum(o_totalprice),2) AS reported, true AS ok FROM orders UNION ALL
SELECT 'discounted', round(sum(l_extendedprice),2), round(sum(l_extendedprice*(1-l_discount)),2), abs(sum(l_extendedprice*l_discount))<=0.5 FROM lineitem UNION ALL SELECT 'lines', count(*), count(*), true FROM lineitem""")
def q19_conserved(t: Tables) -> DataFrame:
    """Totals of outputs against the raw tables: orders by month, lines by part at the wrong price, and a count of lines by flag."""
    monthly = nation_months(t)
    parts = t.lineitem.groupBy("l_partkey").agg(F.sum(C("l_extendedprice") * (1 - C("l_discount"))).alias("v"))
    flags = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    specs = [("orders", t.orders, F.sum("o_totalprice"), monthly, F.sum("value")), ("discounted", t.lineitem, F.sum("l_extendedprice"), parts, F.sum("v")), ("lines", t.lineitem, F.count("*"), flags, F.sum("n"))]
    return rounded(statements.conserved(specs), "raw", "reported")


@query("""SELECT 'c_mktsegment' AS "column", 'EMPTY' AS problem, count(*) FILTER (c_custkey%9=0) AS n FROM customer UNION ALL SELECT 'c_acctbal', 'TYPE', count(*) FILTER (c_custkey%13=0) FROM customer UNION ALL SELECT 'c_rating', 'ABSENT', 0""")
def d11_required(t: Tables) -> DataFrame:
    """Customers with blank segments and balances written as words; one column isn't there at all."""
    k = C("c_custkey")
    c = t.customer.select(F.when(k % 9 == 0, " ").otherwise(C("c_mktsegment")).alias("c_mktsegment"), F.when(k % 13 == 0, "n.k.").when(k % 17 == 0, None).otherwise(C("c_acctbal").cast("string")).alias("c_acctbal"), k.alias("c_custkey"))
    return co.required(c, ["c_custkey", "c_mktsegment", "c_rating"], {"c_acctbal": "double", "c_custkey": "long"})


@query("""WITH s AS (SELECT CASE WHEN o_orderkey%10=0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS c, year(o_orderdate) AS y FROM orders) SELECT c, y, count(*) AS n, 'DUPLICATE' AS reason FROM s WHERE c<>' ' GROUP BY 1,2 HAVING count(*)>1 UNION ALL SELECT NULL, NULL, count(*), 'MISSING_KEY' FROM s WHERE c=' ' HAVING count(*)>0""")
def d10_shape_grain(t: Tables) -> DataFrame:
    """Customer and year as a key of orders, before anything is grouped; every tenth key is blank."""
    s = t.orders.select(F.when(C("o_orderkey") % 10 == 0, " ").otherwise(C("o_custkey").cast("string")).alias("c"), F.year("o_orderdate").alias("y"))
    return co.shape_grain(s, ["c", "y"])


@query(f"""WITH {NM} SELECT 'grain' AS check_name, true AS ok, '0' AS detail UNION ALL SELECT 'error_literals', count(*) FILTER (nation%10=0)=0, CAST(count(*) FILTER (nation%10=0) AS VARCHAR) FROM nm UNION ALL SELECT 'conserved:value', true, '0.0' UNION ALL SELECT 'ledger', false, count(*)||'/'||count(*) FILTER (nation%2=0) FROM nm""")
def s8_base_gate(t: Tables) -> DataFrame:
    """Months of nations as an output: some cells hold an error, and half of the findings don't come out. Sums are exact, so
    that a difference is money and not rounding."""
    nm = nation_months(t, decimals=True).withColumn("note", F.when(C("nation") % 10 == 0, "#REF!").otherwise("fine"))
    flags = nm.select("nation", F.lit("X").alias("anomaly_type"))
    return co.base_gate(nm, ["nation", "ym"], "value", F.sum("value"), t.orders, F.sum(exact("o_totalprice")), flags, flags.filter("nation % 2 = 0"), 0.01)
