"""Queries of schedules, cash, board figures, unit costs, appraisals and contracts over the given tables, and the SQL of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.analyses import appraisal, schedules
from tallywright.operators import cell_rules, field_contracts, snapshots
from tallywright.operators.lineage import settle
from tallywright.plans.analyses import FLOWS as NATION_FLOWS
from tallywright.plans.analyses import flows as nation_flows
from tallywright.plans.facts import NM, nation_months, nation_years, rounded
from tallywright.plans.registry import Tables, query

C = F.col
FIRST, LAST = 12, 59

#: Assets, and their schedules written month by month.
ASSETS = f"""a AS (SELECT p_partkey AS asset, p_retailprice AS cost, p_retailprice*0.1 AS salvage, p_size AS life, 6+p_partkey%24 AS begun,
  CASE WHEN p_partkey%5=0 THEN 0.5 ELSE 1.0 END AS f, CASE WHEN p_partkey%3=0 THEN 6+p_partkey%24+ceil(p_size*0.7) END AS dispose,
  CASE WHEN p_partkey%4=0 THEN 6+p_partkey%24+ceil(p_size*0.4) END AS impair, p_retailprice*0.3 AS impair_to FROM part),
r(asset, period, opening, dep, book, loss, done, monthly) AS (
  SELECT asset, begun-1, cost, CAST(0 AS DOUBLE), cost, CAST(0 AS DOUBLE), 0, (cost-salvage)/life FROM a
  UNION ALL SELECT asset, p, o, d, o-d, loss, CASE WHEN gone OR done>=life THEN done ELSE done+1 END, m FROM (
    SELECT *, CASE WHEN gone OR done>=life THEN 0 WHEN done=life-1 THEN o-salvage WHEN p=begun THEN m*f ELSE m END AS d FROM (
      SELECT *, CASE WHEN hit THEN impair_to ELSE book END AS o, CASE WHEN hit THEN book-impair_to ELSE 0 END AS loss,
        CASE WHEN hit THEN greatest(impair_to-salvage,0)/greatest(life-done,1) ELSE monthly END AS m FROM (
        SELECT r.asset, r.book, r.done, r.monthly, r.period+1 AS p, a.* EXCLUDE (asset), coalesce(dispose<=r.period+1, false) AS gone,
          coalesce(impair=r.period+1 AND (dispose IS NULL OR impair<=dispose), false) AS hit FROM r JOIN a USING (asset) WHERE r.period<{LAST})))),
sch AS (SELECT asset, CAST(period AS INT) AS period, opening, dep, book AS closing, loss AS impairment, dispose IS NULL OR period<dispose AS active
  FROM r JOIN a USING (asset) WHERE period>=begun AND period>={FIRST}
  UNION ALL SELECT asset, CAST(k AS INT), cost, 0, cost, 0, false FROM a, range({FIRST},{LAST + 1}) x(k) WHERE k<begun),
bk AS (SELECT asset, period, dep+CASE WHEN period%10=0 AND asset%50=0 THEN 100 ELSE 0 END AS amount FROM sch WHERE active AND (asset+period)%17<>0)"""


def _assets(t: Tables, only: DataFrame | None = None) -> DataFrame:
    begun, month = 6 + C("p_partkey") % 24, lambda x: F.ceil(C("p_size") * x).cast("int")
    a = t.part.select(
        C("p_partkey").alias("asset"), C("p_retailprice").alias("cost"), (C("p_retailprice") * 0.1).alias("salvage"), C("p_size").alias("life"),
        begun.cast("int").alias("in_service"), F.when(C("p_partkey") % 5 == 0, 0.5).alias("first_factor"),
        F.when(C("p_partkey") % 3 == 0, (begun + month(0.7)).cast("int")).alias("dispose"), F.when(C("p_partkey") % 4 == 0, (begun + month(0.4)).cast("int")).alias("impair"),
        (C("p_retailprice") * 0.3).alias("impair_to"),
    )
    return schedules.asset_schedule(a, FIRST, LAST, only)


def _booked(schedule: DataFrame) -> DataFrame:
    """Postings with holes, and some too large."""
    more = F.when((C("period") % 10 == 0) & (C("asset") % 50 == 0), 100.0).otherwise(0.0)
    return schedule.filter(C("active") & ((C("asset") + C("period")) % 17 != 0)).select("asset", "period", (C("dep") + more).alias("amount"))


def _four(*names: str) -> str:
    return ", ".join(f"CAST(round(CAST({n} AS DECIMAL(38,9)),4) AS DOUBLE) AS {n}" for n in names)


@query(f"WITH RECURSIVE {ASSETS} SELECT asset, period, {_four('opening', 'dep', 'closing', 'impairment')}, active FROM sch")
def k14_asset_events(t: Tables) -> DataFrame:
    """Every asset in every month: part first months, impairments, disposals, months before and after a life."""
    return rounded(_assets(t), "opening", "dep", "closing", "impairment", places=4, ties=True)


@query(f"""WITH RECURSIVE {ASSETS}, m AS (SELECT sch.period, sum(dep) AS scheduled, count(*) FILTER (active AND (asset+period)%17=0) AS missing,
  coalesce(sum(dep) FILTER (NOT (active AND (asset+period)%17=0)),0) AS accrued FROM sch GROUP BY 1), l AS (SELECT period, sum(amount) AS ledger FROM bk GROUP BY 1)
SELECT period, round(scheduled,2) AS scheduled, missing, round(accrued,2) AS accrued, round(coalesce(ledger,0),2) AS ledger, abs(accrued-coalesce(ledger,0))<=0.5 AS ok
FROM m LEFT JOIN l USING (period)""")
def k14_ledger_tie(t: Tables) -> DataFrame:
    """The schedule against the ledger by month; what isn't booked is counted apart."""
    s = settle(_assets(t))
    return rounded(schedules.ledger_tie(s, _booked(s)), "scheduled", "accrued", "ledger")


@query(f"""WITH RECURSIVE {ASSETS} SELECT a.asset, CAST(dispose AS INT) AS period, {_four('nbv')}, {_four('price')},
CAST(round(CAST(price-nbv AS DECIMAL(38,9)),4) AS DOUBLE) AS result
FROM (SELECT asset, dispose, cost*0.4 AS price FROM a WHERE dispose IS NOT NULL) a LEFT JOIN (SELECT asset, period, opening AS nbv FROM sch) s ON s.asset=a.asset AND s.period=a.dispose""")
def k14_disposals(t: Tables) -> DataFrame:
    """Gain or loss of disposals: price less the book value of their month; null outside of the schedule's months."""
    gone = C("p_partkey") % 3 == 0
    period = (6 + C("p_partkey") % 24 + F.ceil(C("p_size") * 0.7)).cast("int")
    sales = t.part.filter(gone).select(C("p_partkey").alias("asset"), period.alias("period"), (C("p_retailprice") * 0.4).alias("price"))
    return rounded(schedules.disposal_results(_assets(t, sales), sales), "nbv", "price", "result", places=4, ties=True)


#: Flows of entities by line and week, the full grid of lines, and balances.
FLOWS = """fl AS (SELECT user_id%25 AS entity, CASE WHEN event_type IN ('purchase','signup') THEN 'in' ELSE 'out' END AS side, event_type AS line,
  1+CAST(floor((epoch(ts)-epoch(TIMESTAMP '2024-01-01'))/(86400*30.0/13)) AS INT) AS week, value AS amount FROM events WHERE event_type<>'view'),
ln AS (SELECT g.entity, g.side, g.line, CAST(w AS INT) AS week, coalesce(sum(amount),0) AS amount FROM (SELECT DISTINCT entity, side, line FROM fl) g CROSS JOIN range(1,14) x(w)
  LEFT JOIN fl ON fl.entity=g.entity AND fl.line=g.line AND fl.week=w GROUP BY ALL),
op AS (SELECT CAST(c_nationkey AS BIGINT) AS entity, avg(c_acctbal)-4600 AS opening FROM customer GROUP BY 1),
wk AS (SELECT entity, week, sum(CASE WHEN side='in' THEN amount ELSE 0 END) AS inflow, sum(CASE WHEN side='out' THEN amount ELSE 0 END) AS outflow FROM ln GROUP BY 1,2),
ba AS (SELECT entity, week, inflow, outflow, coalesce(opening,0)+sum(inflow-outflow) OVER (PARTITION BY entity ORDER BY week) AS closing FROM wk LEFT JOIN op USING (entity))"""


def _cash(t: Tables) -> tuple[DataFrame, DataFrame]:
    second = F.unix_timestamp("ts") + F.expr("extract(second from ts) - floor(extract(second from ts))").cast("double")
    week = 1 + F.floor((second - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (86400 * 30.0 / 13)).cast("int")
    side = F.when(C("event_type").isin("purchase", "signup"), "in").otherwise("out")
    flows = t.events.filter("event_type <> 'view'").select((C("user_id") % 25).alias("entity"), side.alias("side"), C("event_type").alias("line"), week.alias("week"), C("value").alias("amount"))
    openings = t.customer.groupBy(C("c_nationkey").cast("long").alias("entity")).agg((F.avg("c_acctbal") - 4600).alias("opening"))
    return schedules.cash_lines(flows), openings


@query(f"WITH {FLOWS} SELECT entity, side, line, week, round(amount,2) AS amount FROM ln")
def k5_cash_lines(t: Tables) -> DataFrame:
    """Each line of each entity in thirteen periods."""
    return rounded(_cash(t)[0], "amount")


@query(f"""WITH {FLOWS} SELECT entity, week, round(inflow,2) AS inflow, round(outflow,2) AS outflow, round(closing-inflow+outflow,2) AS opening, round(closing,2) AS closing,
round(min(closing) OVER (PARTITION BY entity ORDER BY week),2) AS lowest, closing<0 AS short FROM ba""")
def k5_cash_balance(t: Tables) -> DataFrame:
    """Balances by entity, their lowest so far, and periods below zero."""
    return rounded(schedules.cash_weeks(*_cash(t)), "inflow", "outflow", "opening", "closing", "lowest")


@query(f"""WITH {FLOWS}, e AS (SELECT DISTINCT entity FROM fl), c AS (SELECT entity, CAST(entity%7=0 AS BIGINT) AS w, CAST(entity%5=0 AS BIGINT) AS c, CAST(entity%13=0 AS BIGINT) AS s,
  CAST(entity%11=0 AS BIGINT) AS l FROM e)
SELECT entity, k.name AS "check", CASE k.name WHEN 'WEEKS' THEN w WHEN 'CHAIN' THEN c WHEN 'START' THEN s WHEN 'ROLL' THEN c+s+l ELSE l END AS bad,
CASE k.name WHEN 'WEEKS' THEN w WHEN 'CHAIN' THEN c WHEN 'START' THEN s WHEN 'ROLL' THEN c+s+l ELSE l END=0 AS ok
FROM c, (VALUES ('WEEKS'),('CHAIN'),('START'),('ROLL'),('LINES')) k(name)""")
def k5_cash_checks(t: Tables) -> DataFrame:
    """Reports of cash, some with a lost last week, another opening, or a total that its lines don't give."""
    lines, openings = _cash(t)
    lines = settle(lines)
    entity, week = C("entity"), C("week")
    damaged = F.when((entity % 5 == 0) & (week == 5), 1.0).when((entity % 13 == 0) & (week == 1), 2.0).otherwise(0.0)
    report = schedules.cash_weeks(lines, openings).filter(~((entity % 7 == 0) & (week == 13))).withColumn("opening", C("opening") + damaged)
    report = report.withColumn("inflow", C("inflow") + F.when((entity % 11 == 0) & (week == 2), 3.0).otherwise(0.0))
    return schedules.check_cash(report.drop("lowest", "short"), lines, openings)


@query("""WITH y AS (SELECT c_nationkey AS nation, sum(o_totalprice) FILTER (year(o_orderdate)=1998) AS now, sum(o_totalprice) FILTER (year(o_orderdate)=1997) AS was
  FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1),
b AS (SELECT nation, now*CASE WHEN nation%6=0 THEN 1.01 ELSE 1 END AS actual, was*CASE WHEN nation%9=0 THEN 0 ELSE 1.02 END AS target FROM y WHERE nation%8<>1),
s AS (SELECT nation, now AS source FROM y WHERE nation%7<>0)
SELECT nation, round(actual,2) AS actual, round(target,2) AS target, round(actual/nullif(target,0),4) AS attainment,
CASE WHEN b.nation IS NULL THEN NULL WHEN coalesce(target,0)=0 THEN 'NO_TARGET' WHEN actual/target>=1 THEN 'MET' ELSE 'MISSED' END AS status, round(source,2) AS source,
CASE WHEN b.nation IS NULL THEN 'UNSHOWN' WHEN s.nation IS NULL THEN 'UNSOURCED' WHEN abs(actual-source)<=0.01 THEN 'TIED' ELSE 'OFF' END AS tie
FROM b FULL JOIN s USING (nation)""")
def k9_board_ties(t: Tables) -> DataFrame:
    """A board's figures against their target and their source: some off, without a source or target, or not shown."""
    of = lambda y: F.sum(F.when(C("y") == y, C("value")))
    y = settle(nation_years(t).groupBy("nation").agg(of(1998).alias("now"), of(1997).alias("was")))
    actual, target = C("now") * F.when(C("nation") % 6 == 0, 1.01).otherwise(1.0), C("was") * F.when(C("nation") % 9 == 0, 0.0).otherwise(1.02)
    board = y.filter("nation % 8 <> 1").select("nation", actual.alias("actual"), target.alias("target"))
    pack = schedules.board_pack(board, y.filter("nation % 7 <> 0").select("nation", C("now").alias("value")), ["nation"], 0.01)
    return rounded(rounded(pack, "attainment", places=4), "actual", "target", "source")


@query("""WITH c AS (SELECT l_suppkey%10 AS driver, CASE WHEN l_linenumber%3=0 THEN 'KG' ELSE 'EA' END AS unit, l_returnflag AS account, sum(l_extendedprice) AS cost,
  sum(CASE WHEN l_returnflag='A' AND l_suppkey%10<4 THEN 0 ELSE l_quantity END) AS qty FROM lineitem GROUP BY 1,2,3), v AS (SELECT *, unit='EA' AND qty<>0 AS valid FROM c)
SELECT driver, round(coalesce(sum(cost) FILTER (valid),0),2) AS cost, coalesce(sum(qty) FILTER (valid),0) AS qty, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid,
round(sum(cost) FILTER (valid)/nullif(sum(qty) FILTER (valid),0),4) AS blended FROM v GROUP BY ROLLUP(driver)""")
def k20_blended_cost(t: Tables) -> DataFrame:
    """Cost over quantity of valid lines by driver and in all."""
    driver = C("l_suppkey") % 10
    qty = F.when((C("l_returnflag") == "A") & (driver < 4), 0.0).otherwise(C("l_quantity"))
    lines = t.lineitem.groupBy(driver.alias("driver"), F.when(C("l_linenumber") % 3 == 0, "KG").otherwise("EA").alias("unit"), C("l_returnflag").alias("account"))
    lines = lines.agg(F.sum("l_extendedprice").alias("cost"), F.sum(qty).alias("qty")).withColumn("canonical_unit", F.lit("EA"))
    return rounded(rounded(schedules.blended_cost(schedules.unit_costs(lines), ["driver"]).drop("level"), "cost"), "blended", places=4)


def _label(ym: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(ym / 12), ym % 12 + 1)


def _sheets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A sheet per nation, and its first and last month, months and total: columns A to H hold month, value, count, rate, formula,
    quarter, planned month and a guarded formula; the total stands below. Each kind of fault is planted in some nations."""
    nm = nation_months(t)
    s = settle(nm.groupBy("nation").agg(F.min("ym").alias("lo"), F.max("ym").alias("hi"), F.count("*").alias("k"), F.sum("value").alias("total")))
    j = nm.join(F.broadcast(s.select("nation", "lo", "hi")), "nation")
    nation, ym, last = C("nation"), C("ym"), C("ym") == C("hi")

    def cell(col: int, value: Column | None = None, text: Column | None = None, formula: Column | None = None) -> Column:
        text = text if text is not None else (value.cast("string") if value is not None else F.lit(None).cast("string"))
        blank = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
        return F.struct(F.lit(col).alias("col"), blank(value, "double").alias("value"), text.alias("text"), blank(formula, "string").alias("formula"))

    place = ym.cast("string")
    crossed = (nation % 9 == 0) & (ym == C("lo"))
    difference = F.concat(F.when(crossed, "=$C").otherwise("=$B"), place, F.lit("-"), F.when(crossed, "B").otherwise("C"), place)
    divided = F.concat(F.lit("B"), place, F.lit("/C"), place)
    rate = C("value") / C("n") * F.when(nation % 3 == 0, 1.05).otherwise(1.0)
    quarter = F.when((nation % 7 == 0) & (ym % 12 == 11), "Q5").otherwise(F.concat(F.lit("Q"), F.floor(ym % 12 / 3) + 1))
    all_ = F.array(
        cell(1, text=_label(F.when((nation % 5 == 0) & last, C("lo")).otherwise(ym))), cell(2, C("value")), cell(3, C("n")), cell(4, F.when(last, rate)), cell(5, formula=difference),
        cell(6, text=quarter), cell(7, text=F.when(~((nation % 6 == 1) & (ym % 12 == 3)), _label(ym))),
        cell(8, formula=F.when(last, F.when(nation % 2 == 0, F.concat(F.lit("=IFERROR("), divided, F.lit(",0)"))).otherwise(F.concat(F.lit("="), divided)))),
    )
    body = j.select(nation.cast("string").alias("sheet"), ym.alias("row"), F.inline(all_)).withColumns({"bold": F.lit(False), "top_border": F.lit(False)})
    wrong = C("total") + F.when(nation % 4 == 0, 10.0).otherwise(0.0)
    total = s.select(nation.cast("string").alias("sheet"), (C("hi") + 1).alias("row"), F.inline(F.array(cell(2, wrong)))).withColumns({"bold": F.lit(True), "top_border": F.lit(True)})
    return body.filter("text is not null or formula is not null").unionByName(total), s


def _rules(t: Tables, s: DataFrame) -> DataFrame:
    sheet, lo, hi = C("nation").cast("string"), C("lo").cast("long"), C("hi").cast("long")

    def box(r0: Column, r1: Column, c: int) -> Column:
        names = {"sheet": sheet, "r0": r0, "r1": r1, "c0": F.lit(c).cast("long"), "c1": F.lit(c).cast("long")}
        return F.struct(*(v.alias(k) for k, v in names.items()))

    def rule(kind: str, r0: Column, r1: Column, c: int, name: str | None = None, **more: Column) -> DataFrame:
        own = box(r0, r1, c)
        return s.select(F.concat(F.lit(f"{name or kind}-"), sheet).alias("rule"), F.lit(kind).alias("kind"), *(own[k].alias(k) for k in ("sheet", "r0", "r1", "c0", "c1")), *(v.alias(k) for k, v in more.items()))

    months = F.transform(F.sequence(C("lo"), C("hi")), _label)
    made = [
        rule("tie", hi + 1, hi + 1, 2, parts=box(lo, hi, 2)), rule("grain", lo, hi, 1), rule("ratio", hi, hi, 4, num=box(hi, hi, 2), den=box(hi, hi, 3)),
        rule("field", lo, hi, 3, name="counts", low=F.lit(2.0), high=F.lit(12.0)), rule("field", lo, hi, 6, name="quarters", accepted=F.array(*(F.lit(f"Q{i}") for i in (1, 2, 3, 4)))),
        rule("scenario", lo, hi, 1, parts=box(lo, hi, 7)), rule("expected_n", lo, hi, 1, n=C("k") + F.when(C("nation") % 8 == 0, 1).otherwise(0)),
        rule("formula_refs", lo, hi, 5, left=F.lit("B"), op=F.lit("-"), right=F.lit("C")), rule("units", lo, hi, 2), rule("periods", lo, hi, 1, ruler=months), rule("guard", hi, hi, 8),
    ]
    empty = t.spark.createDataFrame([], cell_rules.RULES)
    return empty.unionByName(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made), allowMissingColumns=True)


@query(f"""WITH {NM}, s AS (SELECT nation, min(ym) AS lo, max(ym) AS hi, count(*) AS k, count(*) FILTER (n<2 OR n>12) AS counts, count(*) FILTER (ym%12=11) AS decembers,
  floor(log10(max(value)))-floor(log10(min(value)))>=3 AS mixed FROM nm GROUP BY 1),
lab AS (SELECT nation, CASE WHEN nation%5=0 AND ym=hi THEN lo ELSE ym END AS a, CASE WHEN NOT (nation%6=1 AND ym%12=3) THEN ym END AS b FROM nm JOIN s USING (nation)),
ap AS (SELECT coalesce(x.nation,y.nation) AS nation, count(*) FILTER (x.a IS NULL OR y.b IS NULL) AS apart FROM (SELECT DISTINCT nation, a FROM lab) x
  FULL JOIN (SELECT DISTINCT nation, b FROM lab WHERE b IS NOT NULL) y ON x.nation=y.nation AND x.a=y.b GROUP BY 1),
j AS (SELECT *, nation%5=0 AND lo<hi AS twin FROM s JOIN ap USING (nation)),
e AS (SELECT nation, unnest([{{'r':'tie','b':CAST(nation%4=0 AS INT)}},{{'r':'grain','b':CAST(twin AS INT)}},{{'r':'ratio','b':CAST(nation%3=0 AS INT)}},{{'r':'counts','b':counts}},
  {{'r':'quarters','b':CASE WHEN nation%7=0 THEN decembers ELSE 0 END}},{{'r':'scenario','b':apart}},{{'r':'expected_n','b':CAST(nation%8=0 AS INT)}},
  {{'r':'formula_refs','b':CAST(nation%9=0 AS INT)}},{{'r':'units','b':CAST(mixed AS INT)}},{{'r':'periods','b':hi-lo+1-k+CAST(twin AS INT)}},{{'r':'guard','b':nation%2}}]) AS u FROM j)
SELECT u.r||'-'||nation AS rule, CASE WHEN u.r IN ('counts','quarters') THEN 'field' ELSE u.r END AS kind, CAST(u.b AS BIGINT) AS bad, u.b=0 AS ok FROM e""")
def x13_contract_rules(t: Tables) -> DataFrame:
    """Eleven rules of nine kinds and more over every nation's sheet."""
    cells, s = _sheets(t)
    return cell_rules.judge(cells, _rules(t, s))


@query(f"""WITH {NM}, s AS (SELECT nation, max(ym) AS hi FROM nm GROUP BY 1)
SELECT CAST(nation AS VARCHAR) AS sheet, CAST(hi+1 AS BIGINT) AS row, 2 AS col, 'TOTAL_WITHOUT_TIE' AS warning FROM s WHERE nation%3=1
UNION ALL SELECT CAST(nation AS VARCHAR), hi, 8, 'DIVISION_WITHOUT_RATIO' FROM s WHERE nation%5<>2""")
def x13_coverage(t: Tables) -> DataFrame:
    """Totals and divisions that no rule looks at."""
    cells, s = _sheets(t)
    sheet = C("sheet").cast("int")
    told = ((C("kind") == "tie") & (sheet % 3 != 1)) | ((C("kind") == "guard") & (sheet % 5 == 2))
    return cell_rules.coverage(cells, _rules(t, s).filter(told)).withColumn("row", C("row").cast("long"))


#: Projects, their effective flows and measures.
PROJECTS = f"""{NATION_FLOWS}, pr AS (SELECT project, CASE WHEN project%2=0 AND project>0 THEN project*100/(project*100+500.0)*0.12+500/(project*100+500.0)*0.06*0.75
  ELSE 0.05+project/1000.0 END AS rate, CASE WHEN project%5>0 THEN 1e5*project ELSE 0 END AS more FROM (SELECT DISTINCT project FROM fl)),
ef AS (SELECT project, t, rate, cash+CASE WHEN t=max(t) OVER (PARTITION BY project) THEN more ELSE 0 END AS cash FROM fl JOIN pr USING (project) WHERE NOT (project%10=3 AND t=0)),
dc AS (SELECT *, cash/pow(1+rate,t) AS d, sum(cash/pow(1+rate,t)) OVER (PARTITION BY project ORDER BY t) AS cum FROM ef), pv AS (SELECT *, lag(cum) OVER (PARTITION BY project ORDER BY t) AS prev FROM dc),
ap AS (SELECT project, any_value(rate) AS rate, sum(d) AS npv, min(CASE WHEN cum>=0 AND prev<0 THEN t-1+(-prev)/d END) AS payback,
  pow(sum(CASE WHEN cash>0 THEN cash*pow(1.06,-t) END)*pow(1.06,max(t))/-sum(CASE WHEN cash<0 THEN cash/pow(1.05,t) END),1.0/max(t))-1 AS mirr FROM pv GROUP BY project)"""


def _projects(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw flows, projects and effective flows; every tenth project has no outlay, and project 0 no capital."""
    raw = settle(nation_flows(t).filter("not (project % 10 = 3 and t = 0)"))
    p = C("project")
    projects = raw.select("project").distinct().select(
        "project", (0.05 + p / 1000).alias("rate"), (p % 2 == 0).alias("use_wacc"), (p * 100.0).alias("equity"), F.when(p > 0, 500.0).otherwise(0.0).alias("debt"),
        F.lit(0.12).alias("cost_equity"), F.lit(0.06).alias("cost_debt"), F.lit(0.25).alias("tax"), F.when(p % 5 > 0, p * 1e5).alias("terminal"),
    )
    return raw, projects, appraisal.effective(raw, projects)


@query(f"WITH {PROJECTS} SELECT project, round(rate,6) AS rate, round(npv,2) AS npv, round(payback,4) AS payback, round(mirr,6) AS mirr FROM ap")
def k13_effective_appraisal(t: Tables) -> DataFrame:
    """Measures at the rate that counts, with terminal values."""
    a = appraisal.appraise(_projects(t)[2], 0.05, 0.06)
    return rounded(rounded(rounded(a, "rate", "mirr", places=6), "payback", places=4), "npv").select("project", "rate", "npv", "payback", "mirr")


@query(f"""WITH {PROJECTS}, c AS (SELECT project, v, npv, CASE WHEN (project+v)%5=0 THEN npv*1.01 ELSE npv*(1-0.1*((project+v)%4)) END AS lo, CASE WHEN (project+v)%5=0 THEN npv*1.2 ELSE npv*(1+0.07*v) END AS hi
  FROM ap, range(1,4) x(v))
SELECT project, 'v'||v AS variable, round(abs(hi-lo),2) AS swing, CAST(row_number() OVER (PARTITION BY project ORDER BY abs(hi-lo) DESC, v) AS INT) AS rank,
npv BETWEEN least(lo,hi) AND greatest(lo,hi) AS bracketed FROM c""")
def k13_tornado(t: Tables) -> DataFrame:
    """Three variables a project; some ends leave the project's own value outside."""
    a = settle(appraisal.appraise(_projects(t)[2], 0.05, 0.06))
    p, v, npv = C("project"), C("v"), C("npv")
    off = (p + v) % 5 == 0
    low, high = F.when(off, npv * 1.01).otherwise(npv * (1 - 0.1 * ((p + v) % 4))), F.when(off, npv * 1.2).otherwise(npv * (1 + 0.07 * v))
    cases = a.withColumn("v", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("project", F.concat(F.lit("v"), v).alias("variable"), low.alias("npv_low"), high.alias("npv_high"))
    return rounded(appraisal.tornado(cases, a), "swing")


@query(f"""WITH {PROJECTS} SELECT project, k.name AS "check", CASE k.name WHEN 'ROOT' THEN project%7<>2 OR project%10=3 WHEN 'TERMINAL' THEN project%6<>1 ELSE project%10<>3 END AS ok
FROM ap, (VALUES ('ROOT'),('TERMINAL'),('MIRR')) k(name)""")
def k13_checks(t: Tables) -> DataFrame:
    """Some rates of return moved by a hundredth, some raw flows changed after the fact."""
    raw, projects, effective = _projects(t)
    p = C("project")
    a = appraisal.appraise(effective, 0.05, 0.06).withColumn("irr", C("irr") + F.when(p % 7 == 2, 0.01).otherwise(0.0))
    changed = raw.withColumn("cash", C("cash") + F.when((p % 6 == 1) & (C("t") == 1), 5.0).otherwise(0.0))
    return appraisal.check(effective, a, changed, projects)


SPECS = [
    ("l_quantity", "quantity", None, 1.0, 50.0, False, True, None), ("l_discount", "ratio", None, None, None, None, True, [0.0, 0.01, 0.02, 0.03, 0.04, 0.05]),
    ("l_tax", "ratio", "any", 0.0, 0.05, True, True, None), ("l_extendedprice", "currency", None, None, 50_000.0, None, False, None), ("l_balance", "currency", None, None, None, None, None, None),
]
FIGURES = """v AS (SELECT 'l_quantity' AS field, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_tax', CASE WHEN l_orderkey%10>0 THEN l_tax END FROM lineitem UNION ALL SELECT 'l_extendedprice', CASE WHEN l_orderkey%100<>7 THEN l_extendedprice END FROM lineitem
  UNION ALL SELECT 'l_balance', l_extendedprice-30000 FROM lineitem)"""


def _figures(t: Tables) -> tuple[DataFrame, DataFrame]:
    x = t.lineitem.select(
        "l_quantity", "l_discount", F.when(C("l_orderkey") % 10 > 0, C("l_tax")).alias("l_tax"), F.when(C("l_orderkey") % 100 != 7, C("l_extendedprice")).alias("l_extendedprice"),
        (C("l_extendedprice") - 30_000).alias("l_balance"),
    )
    declared = t.lineitem.agg(F.sum("l_quantity").alias("l_quantity"), (F.sum("l_discount") + 1).alias("l_discount")).unpivot([], ["l_quantity", "l_discount"], "field", "tie_total")
    specs = t.spark.createDataFrame(SPECS, field_contracts.SPECS.rsplit(",", 1)[0]).join(declared, "field", "left")
    return x.unpivot([], x.columns, "field", "value"), specs


@query(f"""WITH {FIGURES}, j AS (SELECT field, CASE WHEN value IS NULL AND field='l_extendedprice' THEN 'NULL' WHEN field='l_discount' AND value NOT IN (0,0.01,0.02,0.03,0.04,0.05) THEN 'NOT_ACCEPTED'
  WHEN field='l_balance' AND value<0 THEN 'SIGN' WHEN field='l_quantity' AND value<=1 THEN 'LOW' WHEN (field='l_quantity' AND value>=50) OR (field='l_tax' AND value>0.05) OR (field='l_extendedprice' AND value>50000) THEN 'HIGH' END AS reason, value FROM v)
SELECT field, CASE WHEN reason IS NOT NULL THEN 'VIOLATION' WHEN value IS NULL THEN 'NO_DATA' ELSE 'OK' END AS status, reason, count(*) AS n FROM j GROUP BY 1,2,3""")
def q20_field_contracts(t: Tables) -> DataFrame:
    """Five contracts over every line's figures, by status and reason."""
    return field_contracts.judge_fields(*_figures(t)).groupBy("field", "status", "reason").agg(F.count("*").alias("n"))


@query("""SELECT 'l_quantity' AS field, round(sum(l_quantity),2) AS total, round(sum(l_quantity),2) AS tie_total, abs(sum(l_quantity)-sum(l_quantity))<=0.5 AS ok FROM lineitem
UNION ALL SELECT 'l_discount', round(sum(l_discount),2), round(sum(l_discount)+1,2), abs(sum(l_discount)-(sum(l_discount)+1))<=0.5 FROM lineitem""")
def q20_field_totals(t: Tables) -> DataFrame:
    """Declared totals: one holds, one is off by one."""
    return rounded(field_contracts.field_totals(*_figures(t)), "total", "tie_total")


@query("""WITH o AS (SELECT o_custkey%20 AS s, o_orderkey AS k FROM orders), f AS (
  SELECT s, CASE WHEN k%11=0 THEN 'CELL_LOST' WHEN k%13=0 OR k%29=0 THEN 'CELL_CHANGED' END AS finding FROM o
  UNION ALL SELECT s, CASE WHEN k%11<>0 AND k%13<>0 AND k%29=0 THEN 'ERROR_NEW' END FROM o
  UNION ALL SELECT s, CASE WHEN k%17=0 THEN 'FORMULA_LOST' WHEN k%19=0 THEN 'FORMULA_CHANGED' WHEN k%23=0 THEN 'FORMULA_LOST' END FROM o
  UNION ALL SELECT DISTINCT s, 'CELL_CHANGED' FROM o WHERE s=3 UNION ALL SELECT DISTINCT s, 'HEADER_CHANGED' FROM o WHERE s=3)
SELECT CAST(s AS VARCHAR) AS sheet, finding, count(*) AS n FROM f WHERE s<>19 AND finding IS NOT NULL GROUP BY 1,2
UNION ALL SELECT DISTINCT CAST(s AS VARCHAR), 'SHEET_LOST', 1 FROM o WHERE s=19""")
def x16_workbook_diff(t: Tables) -> DataFrame:
    """A sheet of prices and formulas for every twentieth customer, before and after: cells and formulas lost or changed, a lost
    sheet, another header, new errors."""
    o = t.orders.select((C("o_custkey") % 20).cast("string").alias("sheet"), C("o_orderkey").alias("k"), C("o_totalprice").cast("string").alias("price"))
    k, row = C("k"), (C("k") + 2).cast("int")
    formula = lambda times: F.concat(F.lit("=A"), row.cast("string"), F.lit(f"*{times}"))
    none = F.lit(None).cast("string")

    def cells(text: Column, f: Column, plain: Column, header: Column) -> DataFrame:
        a, b = F.struct(F.lit(1).alias("col"), text.alias("text"), none.alias("formula")), F.struct(F.lit(2).alias("col"), plain.alias("text"), f.alias("formula"))
        body = o.select("sheet", row.alias("row"), F.inline(F.array(a, b))).filter("text is not null or formula is not null")
        heads = o.select("sheet").distinct().select("sheet", F.lit(1).alias("row"), F.lit(1).alias("col"), header.alias("text"), none.alias("formula"))
        return body.unionByName(heads)

    before = cells(C("price"), formula(2), none, F.lit("amount"))
    text = F.when(k % 11 == 0, none).when(k % 13 == 0, F.concat("price", F.lit("1"))).when(k % 29 == 0, "#REF!").otherwise(C("price"))
    after = cells(text, F.when(k % 17 == 0, none).when(k % 19 == 0, formula(3)).when(k % 23 == 0, none).otherwise(formula(2)), F.when((k % 17 > 0) & (k % 19 > 0) & (k % 23 == 0), "5"), F.when(C("sheet") == "3", "sum").otherwise("amount"))
    found = snapshots.workbook_diff(before, after.filter("sheet <> '19'"), [])
    return found.groupBy("sheet", "finding").agg(F.count("*").alias("n"))
