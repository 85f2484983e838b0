"""Queries of the remaining dimension, check, header, subtotal, audit, profile and record operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators import audit, dimensions, grid, headers, profile, totals
from tallywright.operators import checks as q
from tallywright.operators.lineage import settle
from tallywright.plans.contracts import cells, formulas
from tallywright.plans.facts import NM, NY, month, nation_months, nation_years, rounded
from tallywright.plans.registry import Tables, query
from tallywright.sources import records

C = F.col


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey%3=0 THEN c_mktsegment ELSE coalesce('S'||s_nationkey, p_brand) END AS fs_line FROM customer LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey%3=1 THEN s_nationkey END AS s_nationkey FROM supplier) ON s_suppkey=c_custkey LEFT JOIN part ON p_partkey=c_custkey""")
def d7_account_lines(t: Tables) -> DataFrame:
    """Customers as accounts: an own line, else one by supplier number, else one by part number, else null."""
    accounts = t.customer.select(C("c_custkey").alias("code"), F.when(C("c_custkey") % 3 == 0, C("c_mktsegment")).alias("fs_line"))
    fallback = t.supplier.select(C("s_suppkey").alias("code"), F.when(C("s_suppkey") % 3 == 1, F.concat(F.lit("S"), "s_nationkey")).alias("fs_line"))
    return dimensions.map_accounts(accounts, fallback, t.part.select(C("p_partkey").alias("code"), C("p_brand").alias("fs_line"), C("p_size").alias("ord")))


@query("""WITH c AS (SELECT p_partkey-CASE WHEN p_partkey%10=9 THEN 1 ELSE 0 END AS code, p_partkey+1 AS parent, CASE WHEN p_size=50 THEN 'XX' ELSE 'IS' END AS statement, CASE WHEN p_size=1 THEN '' ELSE '+' END AS sign FROM part)
SELECT code, problem, count(*) AS n FROM (SELECT code, 'STATEMENT' AS problem FROM c WHERE statement='XX' UNION ALL SELECT code, 'SIGN' FROM c WHERE sign='' UNION ALL SELECT code, 'PARENT' FROM c WHERE parent NOT IN (SELECT code FROM c)) GROUP BY 1,2 UNION ALL SELECT code, 'DUPLICATE', count(*)-1 FROM c GROUP BY code HAVING count(*)>1""")
def d8_chart_findings(t: Tables) -> DataFrame:
    k = C("p_partkey")
    chart = t.part.select((k - F.when(k % 10 == 9, 1).otherwise(0)).alias("code"), (k + 1).alias("parent"), F.when(C("p_size") == 50, "XX").otherwise("IS").alias("statement"), F.when(C("p_size") == 1, "").otherwise("+").alias("sign"))
    return dimensions.chart_findings(chart, ["IS", "BS", "CFS"], ["+", "-"])


@query("""WITH o AS (SELECT o_custkey AS customer, o_orderkey AS k, string_agg(CAST(l_linenumber AS VARCHAR), '+' ORDER BY l_linenumber) AS items FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2) SELECT customer, string_agg(k||':'||items, ' ' ORDER BY k) AS tree FROM o GROUP BY customer""")
def d12_assemble(t: Tables) -> DataFrame:
    """Customers with their orders with their lines, written as text."""
    j = t.orders.join(t.lineitem, C("o_orderkey") == C("l_orderkey")).select(C("o_custkey").alias("customer"), C("o_orderkey").alias("order"), "l_linenumber")
    tree = dimensions.assemble(j, ["customer", "order"], C("l_linenumber"))
    return tree.select("customer", F.array_join(F.transform("items", lambda o: F.concat(o["key"].cast("string"), F.lit(":"), F.array_join(o["items"].cast("array<string>"), "+"))), " ").alias("tree"))


@query("SELECT 'status' AS field, 'paused' AS value, count(*) AS n FROM orders WHERE o_orderstatus='P' HAVING count(*)>0 UNION ALL SELECT 'recurrence', 'weekly', count(*) FROM orders WHERE o_orderpriority LIKE '5%' HAVING count(*)>0")
def d13_accepted_values(t: Tables) -> DataFrame:
    """Orders as contracts whose status or recurrence isn't in the list."""
    p = F.substring("o_orderpriority", 1, 1)
    c = t.orders.select(F.when(C("o_orderstatus") == "F", "active").when(C("o_orderstatus") == "P", "paused").otherwise("terminated").alias("status"), F.when(p.isin("1", "2"), "monthly").when(p == "3", "quarterly").when(p == "5", "weekly").otherwise("annual").alias("recurrence"))
    return dimensions.accepted_values(c, {f: dimensions.ACCEPTED[f] for f in ("status", "recurrence")})


@query("""WITH a AS (SELECT DISTINCT l_linenumber AS sheet, l_linenumber%2 AS key FROM lineitem) SELECT 'entity' AS axis, x.sheet, y.sheet AS other FROM a x, a y WHERE x.sheet<y.sheet AND x.key<>y.key""")
def d14_axis_conflicts(t: Tables) -> DataFrame:
    """Sheets by line number: all share months, odd and even ones have no entity in common."""
    line = t.lineitem.select(C("l_linenumber").alias("sheet"), F.explode(F.array(F.struct(F.lit("period").alias("axis"), F.year("l_shipdate").cast("string").alias("key")), F.struct(F.lit("entity").alias("axis"), (C("l_linenumber") % 2).cast("string").alias("key")))).alias("a"))
    return dimensions.axis_conflicts(line.select("sheet", "a.*")).select("axis", "sheet", "other")


@query("SELECT o_orderpriority AS field FROM orders GROUP BY 1 HAVING NOT (o_orderpriority<>'3-MEDIUM' AND count(*) FILTER (o_orderstatus='F')>0)")
def q6_filters_declared(t: Tables) -> DataFrame:
    """A filter per priority with the number of orders that it leaves out; one isn't declared."""
    f = t.orders.groupBy(C("o_orderpriority").alias("field")).agg(F.count_if(C("o_orderstatus") == "F").alias("out"))
    return q.filters_declared(f.select("field", (C("field") != "3-MEDIUM").alias("declared"), C("field").alias("header_text"), F.when(C("out") > 0, C("out")).alias("excluded_count")))


@query("SELECT 'no_silent_drop' AS check_name, count(*)=count(DISTINCT (l_orderkey, l_linenumber)) AS ok, count(*)||'/'||count(DISTINCT (l_orderkey, l_linenumber)) AS detail FROM lineitem UNION ALL SELECT 'no_silent_drop', count(*)=count(DISTINCT o_custkey), count(*)||'/'||count(DISTINCT o_custkey) FROM orders")
def q8_no_silent_drop(t: Tables) -> DataFrame:
    return q.gate(q.no_silent_drop(t.lineitem, ["l_orderkey", "l_linenumber"]), q.no_silent_drop(t.orders, ["o_custkey"]))


@query("""WITH m AS (SELECT o_custkey%100 AS account, sum(o_totalprice) AS master FROM orders GROUP BY 1), l AS (SELECT o_custkey%100 AS account, sum(l_extendedprice*(1+l_tax)*(1-l_discount)) AS ledger FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1), r AS (SELECT o_custkey%100 AS account, count(*) AS reasons FROM orders WHERE o_orderpriority='1-URGENT' AND o_custkey%100<50 GROUP BY 1)
SELECT account, round(coalesce(master,0),2) AS master, round(coalesce(ledger,0),2) AS ledger, coalesce(reasons,0) AS reasons, abs(coalesce(master,0)-coalesce(ledger,0))<=1 OR coalesce(reasons,0)>0 AS ok FROM m FULL JOIN l USING (account) LEFT JOIN r USING (account)""")
def q12_master_to_ledger(t: Tables) -> DataFrame:
    """Orders as contracts against their lines as the ledger, by account; urgent orders of low accounts are explained."""
    account = (C("o_custkey") % 100).alias("account")
    amount = (C("l_extendedprice") * (1 + C("l_tax")) * (1 - C("l_discount"))).alias("amount")
    ledger = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(account, amount)
    reasons = t.orders.filter("o_orderpriority = '1-URGENT' and o_custkey % 100 < 50").select(account)
    out = q.master_to_ledger(t.orders.select(account, C("o_totalprice").alias("amount")), ledger, ["account"], reasons, 1.0)
    return rounded(out.select("account", "master", "ledger", "reasons", "ok"), "master", "ledger")


@query("""WITH p AS (SELECT n_regionkey AS pool, sum(s_acctbal) AS pre FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY 1), w AS (SELECT DISTINCT n_regionkey AS pool FROM customer JOIN nation ON c_nationkey=n_nationkey)
SELECT pool, round(pre,2) AS pre, round(CASE WHEN w.pool IS NULL THEN 0 ELSE pre END,2) AS post, w.pool IS NOT NULL OR abs(pre)<=0.01 AS ok FROM p LEFT JOIN w USING (pool)""")
def q13_allocation_conserves(t: Tables) -> DataFrame:
    """Suppliers' balances of a region spread over its nations by customers: nothing leaks."""
    home = t.nation.select("n_nationkey", C("n_regionkey").alias("pool"))
    before = t.supplier.join(home, C("s_nationkey") == C("n_nationkey")).groupBy("pool").agg(F.sum("s_acctbal").alias("amount"))
    weight = t.customer.groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("w")).join(home, "n_nationkey")
    share = C("w") / F.sum("w").over(Window.partitionBy("pool"))
    after = weight.withColumn("share", share).join(before, "pool").select("pool", (C("amount") * C("share")).alias("amount"))
    return rounded(q.allocation_conserves(before, after, ["pool"], 0.01).select("pool", "pre", "post", "ok"), "pre", "post")


@query("""WITH l AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag<>'R' AND l_shipdate<DATE '1998-01-01' THEN l_extendedprice ELSE 0 END) AS rec, sum(CASE WHEN l_returnflag<>'R' AND l_shipdate>=DATE '1998-01-01' THEN l_extendedprice ELSE 0 END) AS rem, sum(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0 END) AS can, sum(l_extendedprice)*CASE WHEN l_orderkey%10=0 THEN 0.5 WHEN l_orderkey%10=1 THEN 1.5 ELSE 1 END AS total FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN rec>total+1 THEN 'OVER_RECOGNIZED' WHEN abs(rec+rem+can-total)>1 THEN 'NOT_CONSERVED' ELSE 'OK' END AS status, count(*) AS n FROM l GROUP BY 1""")
def q14_commitment(t: Tables) -> DataFrame:
    """Orders as commitments: shipped by 1998 is recognised, later remains, returned is cancelled; some totals are off."""
    back, done = C("l_returnflag") == "R", C("l_shipdate") < F.lit("1998-01-01").cast("date")
    part = lambda cond: F.sum(F.when(cond, C("l_extendedprice")).otherwise(0.0))
    off = F.when(C("l_orderkey") % 10 == 0, 0.5).when(C("l_orderkey") % 10 == 1, 1.5).otherwise(1.0)
    c = t.lineitem.groupBy("l_orderkey").agg(part(~back & done).alias("rec"), part(~back & ~done).alias("rem"), part(back).alias("can"), F.sum("l_extendedprice").alias("all")).withColumn("total", C("all") * off)
    return c.groupBy(q.commitment(C("rec"), C("rem"), C("can"), C("total"), 1.0).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT 'REVERSAL' AS anomaly_type, count(*) FILTER (l_returnflag='R') AS ledger, count(*) FILTER (l_returnflag='R' AND l_linenumber<7) AS surfaced FROM lineitem UNION ALL SELECT 'NO_DISCOUNT', count(*) FILTER (l_discount=0), count(*) FILTER (l_discount=0) FROM lineitem), LATERAL (SELECT ledger=surfaced AS ok) WHERE ledger>0")
def q15_anomalies_conserved(t: Tables) -> DataFrame:
    """Findings over the lines against the flags of an output that hides those of line 7."""
    kinds = lambda hide: F.array_compact(F.array(F.when((C("l_returnflag") == "R") & hide, "REVERSAL"), F.when(C("l_discount") == 0, "NO_DISCOUNT")))
    flags = t.lineitem.select("l_linenumber", F.explode(kinds(F.lit(True))).alias("anomaly_type"))
    return q.anomalies_conserved(flags, t.lineitem.select(F.explode(kinds(C("l_linenumber") < 7)).alias("anomaly_type")))


@query("""WITH f AS (SELECT DISTINCT o_custkey AS customer, year(o_orderdate)*12+month(o_orderdate)-1 AS ym FROM orders), a AS (SELECT customer, min(ym) AS s, max(ym) AS e FROM f GROUP BY 1), g AS (SELECT customer, unnest(range(s, e+1, 12)) AS ym FROM a)
SELECT customer, ym, 'MISSING_ACCRUAL' AS anomaly_type FROM (SELECT customer, ym FROM g EXCEPT SELECT customer, ym FROM f)""")
def q16_recurrence(t: Tables) -> DataFrame:
    """A yearly order of each customer from the first to the last month: the months without one."""
    f = t.orders.select(C("o_custkey").alias("customer"), month("o_orderdate").cast("long").alias("ym"))
    active = f.groupBy("customer").agg(F.min("ym").alias("start"), F.max("ym").alias("stop")).withColumn("every", F.lit(12).cast("long"))
    return q.recurrence(active, f, "customer", "ym")


def totalled(t: Tables) -> DataFrame:
    """Nations by year as tidy rows with a total row for each year: by its label in even years, in bold type in odd ones."""
    rows = nation_years(t).select(F.lit("w").alias("workbook"), C("y").cast("string").alias("period"), F.concat(F.lit("N"), "nation").alias("label"), "value", F.lit(False).alias("bold"), F.lit("data").alias("row_role"))
    sums = rows.groupBy("workbook", "period").agg(F.sum("value").alias("value")).select("workbook", "period", F.when(C("period") % 2 == 0, "합계").otherwise("All regions").alias("label"), "value", (C("period") % 2 == 1).alias("bold"), F.lit("data").alias("row_role"))
    return rows.unionByName(sums)


@query(f"WITH {NY} SELECT CAST(y AS VARCHAR) AS period, CASE WHEN y%2=0 THEN '합계' ELSE 'All regions' END AS label, round(sum(value),2) AS value, 2 AS score FROM ny GROUP BY y")
def t6_subtotals(t: Tables) -> DataFrame:
    """Rows that label and arithmetic show to be totals."""
    s = totals.score_subtotals(totalled(t), ["workbook", "period"])
    return s.filter("row_role = 'subtotal'").select("period", "label", F.round("value", 2).alias("value"), "score")


@query(f"WITH {NM} SELECT nation, count(*) AS n_children, round(sum(value)*1.02,2) AS value, round(sum(value),2) AS child_sum FROM nm WHERE nation%5=0 GROUP BY nation HAVING count(*)>=2")
def t8_subtotal_mismatches(t: Tables) -> DataFrame:
    """Nations over their months, every fifth with a total two per cent too high."""
    nm = nation_months(t)
    child = nm.select("nation", (C("ym") + 1).alias("src_row"), F.lit(1).alias("level"), "value", F.lit("data").alias("row_role"))
    top = nm.groupBy("nation").agg((F.sum("value") * F.when(C("nation") % 5 == 0, 1.02).otherwise(1.0)).alias("value")).select("nation", F.lit(0).alias("src_row"), F.lit(0).alias("level"), "value", F.lit("subtotal").alias("row_role"))
    return rounded(totals.subtotal_mismatches(child.unionByName(top), ["nation"]).select("nation", C("n_children").cast("long").alias("n_children"), "value", "child_sum"), "value", "child_sum")


@query("SELECT l_linenumber AS workbook, count(*) AS tried, count(*) FILTER (l_quantity<=CASE WHEN l_linenumber=3 THEN 5 ELSE 25 END) AS kept FROM lineitem GROUP BY 1 HAVING count(*)>=50 AND count(*) FILTER (l_quantity<=CASE WHEN l_linenumber=3 THEN 5 ELSE 25 END)<0.2*count(*)")
def t10_reject_alarm(t: Tables) -> DataFrame:
    """Workbooks by line number; number 3 keeps small quantities alone."""
    cut = F.when(C("l_linenumber") == 3, 5).otherwise(25)
    return totals.reject_alarm(t.lineitem.select(C("l_linenumber").alias("workbook"), F.array_compact(F.array(F.when(C("l_quantity") > cut, "TOO_MANY"))).alias("reasons")), ["workbook"])


_KEY = "CASE WHEN bool_and({c}=floor({c})) AND count(DISTINCT {c})=count({c}) AND min({c})>=0 AND max({c})-min({c})+1<=1.5*count(DISTINCT {c}) THEN 'key' ELSE 'measure' END"
_ROLE = "CASE WHEN count(DISTINCT {c})<=20 AND count(DISTINCT {c})/count(*)<=0.5 THEN 'dimension' ELSE 'measure' END"
_TEXT = "CASE WHEN count(DISTINCT {c})>0.9*count(*) THEN 'id' ELSE 'dimension' END"
ORDER_COLUMNS = [(c, _KEY.format(c=c), _ROLE.format(c=c)) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
ORDER_COLUMNS += [("o_orderdate", "'date'", "'time'"), *((c, f"CASE WHEN count(DISTINCT {c})>50 THEN 'key' ELSE 'choice' END", _TEXT.format(c=c)) for c in ("o_orderstatus", "o_orderpriority"))]

CELLS = "(SELECT 2*count(*) FROM (SELECT DISTINCT p_brand, year(l_shipdate) FROM lineitem JOIN part ON l_partkey=p_partkey))"


@query(f"SELECT 'w' AS workbook, (SELECT count(DISTINCT left(p_brand,length(p_brand)-1)) FROM part) AS blocks, {CELLS} AS kept, 0 AS rejected, {CELLS} AS covered, 0 AS uncovered")
def t11_ingest_summary(t: Tables) -> DataFrame:
    c = settle(cells(t))
    rows = grid.ingest(c)
    return totals.summary(grid.validate(rows), grid.reconcile(c, rows).withColumn("workbook", F.coalesce("workbook", F.lit("w"))), ["workbook"])


@query("WITH b AS (SELECT DISTINCT p_brand, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey=p_partkey) SELECT 0 AS no_entity, 2*count(*) FILTER (right(p_brand,1)='3') AS no_period, 0 AS no_metric, 0 AS leaks, 2*count(*) FILTER (right(p_brand,1)='3') AS rejected, 2*count(*) FILTER (right(p_brand,1)='2') AS unreconciled, false AS value_leak, false AS ok FROM b")
def t16_invariants(t: Tables) -> DataFrame:
    """An output that is damaged after the ingest: rows of items 3 lose their period, those of items 2 are lost."""
    c = settle(cells(t))
    whole = settle(grid.ingest(c).filter("not endswith(entity, '2')"))
    rows = whole.withColumn("period", F.when(~C("entity").endswith("3"), C("period")))
    return totals.invariants(grid.validate(rows), grid.reconcile(c, rows))


@query(f"WITH {NM} SELECT count(*) AS expected, count(*) FILTER (nation%7<>0) AS hits, count(*) FILTER (nation%7<>0)/count(*) AS accuracy FROM nm")
def t17_accuracy(t: Tables) -> DataFrame:
    """Monthly values against expectations that are one off for every seventh nation."""
    nm = nation_months(t)
    return totals.accuracy(nm, nm.select("nation", "ym", (C("value") + F.when(C("nation") % 7 == 0, 1.0).otherwise(0.0)).alias("want")), ["nation", "ym"])


@query("""WITH c AS (SELECT 'w'||(l_orderkey%2) AS workbook, l_linenumber AS line, l_orderkey%3 AS k FROM lineitem)
SELECT workbook, 'S '||line AS "from", 'S '||(line+1) AS "to", count(*) AS n FROM c WHERE k=0 AND EXISTS (SELECT 1 FROM c d WHERE d.workbook=c.workbook AND d.line=c.line+1) GROUP BY workbook, line
UNION ALL SELECT workbook, 'S '||line, '매출', count(*) FROM c WHERE k=2 AND workbook='w0' GROUP BY workbook, line""")
def x3_sheet_references(t: Tables) -> DataFrame:
    """Two workbooks with sheets of the same names, which hold blanks. A third of the formulas point at the next sheet, a third
    name it within a text only, and a third point at a sheet that only one workbook has."""
    k, s = C("l_orderkey") % 3, C("l_linenumber")
    f = F.when(k == 0, F.format_string("='S %d'!A%d*'S %d'!B1", s + 1, "l_orderkey", s)).when(k == 1, F.format_string("=\"see 'S %d'!A1\"&A%d", s + 1, "l_orderkey")).otherwise(F.format_string("=매출!B%d", "l_orderkey"))
    rows = t.lineitem.select(F.concat(F.lit("w"), C("l_orderkey") % 2).alias("workbook"), F.concat(F.lit("S "), s).alias("sheet"), f.alias("formula"))
    only = t.region.limit(1).select(F.lit("w0").alias("workbook"), F.lit("매출").alias("sheet"), F.lit(None).cast("string").alias("formula"))
    return audit.sheet_references(rows.unionByName(only))


@query("SELECT l_linenumber AS sheet, count(*) AS n FROM lineitem WHERE l_orderkey%97<5 AND l_orderkey BETWEEN 1 AND 1000000000 GROUP BY 1")
def x4_formula_rules(t: Tables) -> DataFrame:
    """Column C of every sheet must be A times B of its row."""
    rules = t.lineitem.select(C("l_linenumber").alias("sheet")).distinct().select("sheet", F.lit(3).alias("col"), F.lit(1).alias("r0"), F.lit(1_000_000_000).alias("r1"), F.lit("A").alias("left"), F.lit("*").alias("op"), F.lit("B").alias("right"))
    return audit.formula_rules(formulas(t), rules).groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey%89=5")
def x8_disallowed_formats(t: Tables) -> DataFrame:
    f = t.lineitem.select("l_orderkey", "l_linenumber", F.when(C("l_orderkey") % 89 == 5, "0.000000").when(C("l_linenumber") == 1, "0%").otherwise("#,##0").alias("number_format"))
    return audit.disallowed_formats(f, ["General", "#,##0", "0%"]).drop("number_format")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey%1000=7")
def x10_content_regions(t: Tables) -> DataFrame:
    """Totals must be numbers in the whole column; some are words."""
    v = F.when(C("o_orderkey") % 1000 == 7, "see note").otherwise(F.format_number("o_totalprice", 2))
    c = t.orders.select("o_orderkey", F.lit("s").alias("sheet"), C("o_orderkey").alias("row"), F.lit(1).alias("col"), grid.cell_type(v).alias("kind"))
    regions = t.orders.agg(F.min("o_orderkey").alias("r0"), F.max("o_orderkey").alias("r1")).select(F.lit("s").alias("sheet"), "r0", "r1", F.lit(1).alias("c0"), F.lit(1).alias("c1"), F.lit("numeric").alias("wants"))
    return audit.content_regions(c, regions, "kind").select("o_orderkey")


@query(f"WITH {NM} SELECT nation, ym, k.kind, CASE WHEN k.kind='tie' THEN nation%4<>0 ELSE nation%6<>0 END AS ok FROM nm, (VALUES ('tie'),('magnitude')) k(kind)")
def x13_cell_contract(t: Tables) -> DataFrame:
    """Every month's cell must tie to a figure and be of its size; some figures are off by ten or by 10,000 times."""
    nm = nation_months(t).select(C("nation").alias("sheet"), C("ym").alias("row"), F.lit(1).alias("col"), "value")
    want = F.when(C("kind") == "tie", C("value") + F.when(C("sheet") % 4 == 0, 10.0).otherwise(0.0)).otherwise(C("value") * F.when(C("sheet") % 6 == 0, 10_000.0).otherwise(1.5))
    rules = nm.withColumn("kind", F.explode(F.array(F.lit("tie"), F.lit("magnitude")))).withColumn("expected", want).drop("value")
    return audit.cell_contract(nm, rules).select(C("sheet").alias("nation"), C("row").alias("ym"), "kind", "ok")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount=0")
def x15_stale_formulas(t: Tables) -> DataFrame:
    return audit.stale_formulas(t.lineitem.withColumn("formula", F.lit("=A1*B1")), "l_discount").select("l_orderkey", "l_linenumber")


@query("SELECT l_linenumber AS sheet, CAST(sum(CAST('0x'||substr(md5(l_orderkey||chr(31)||l_partkey||chr(31)||l_suppkey),1,15) AS BIGINT)) AS VARCHAR) AS digest, count(*) AS n FROM lineitem GROUP BY 1")
def x17_digest(t: Tables) -> DataFrame:
    return audit.digest(t.lineitem.withColumn("sheet", C("l_linenumber")), ["sheet"], ["l_orderkey", "l_partkey", "l_suppkey"])


@query("SELECT l_linenumber AS sheet, count(*) FILTER (l_orderkey%5=0) AS numeric, count(*) FILTER (l_orderkey%5=1) AS character, count(*) FILTER (l_orderkey%5=2) AS date, count(*) FILTER (l_orderkey%5=3) AS formula, count(*) FILTER (l_orderkey%10=4) AS blank, count(*) FILTER (l_orderkey%10=9) AS error, 0 AS logical FROM lineitem GROUP BY 1")
def x19_type_counts(t: Tables) -> DataFrame:
    k = C("l_orderkey")
    v = F.when(k % 5 == 0, F.format_number("l_extendedprice", 2)).when(k % 5 == 1, "word").when(k % 5 == 2, "2024-01-31").when(k % 10 == 4, " ").when(k % 10 == 9, "#REF!")
    c = t.lineitem.select(C("l_linenumber").alias("sheet"), v.alias("v"), F.when(k % 5 == 3, "=A1").alias("formula"))
    return audit.type_counts(c, ["sheet"], grid.cell_type(C("v")))


@query("SELECT strftime(min(o_orderdate),'%Y-%m') AS first_month, strftime(max(o_orderdate),'%Y-%m') AS last_month FROM orders")
def p9_date_range(t: Tables) -> DataFrame:
    return profile.date_range(t.orders, "o_orderdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS card, round(count(*) FILTER ({c} IS NULL)/count(*),6) AS null_rate, {kind} AS kind, {role} AS role FROM orders" for c, kind, role in ORDER_COLUMNS))
def p10_profile(t: Tables) -> DataFrame:
    """A row per column of the orders."""
    return profile.profile(t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), t.orders.columns)


@query("""WITH o AS (SELECT sum(o_totalprice) AS whole, sum(o_totalprice) FILTER (o_orderdate>(SELECT min(o_orderdate) FROM orders)) AS later FROM orders)
SELECT 'orders' AS "table", 'trend' AS output, 'o_totalprice' AS measure, round(whole,2) AS source, round(whole,2) AS made, true AS ok FROM o
UNION ALL SELECT 'damaged', 'trend', 'o_totalprice', round(whole,2), round(later,2), abs(whole-later)<=0.5 FROM o
UNION ALL SELECT 'customer', 'listing', 'c_acctbal', round(sum(c_acctbal),2), round(sum(c_acctbal),2), true FROM customer
UNION ALL SELECT 'lineitem', 'variance', 'l_extendedprice', round(sum(l_extendedprice),2), round(sum(l_extendedprice),2), true FROM lineitem
UNION ALL SELECT 'lineitem', 'variance', 'l_partkey', round(sum(l_partkey),2), round(sum(l_partkey),2), true FROM lineitem""")
def p11_bound_outputs(t: Tables) -> DataFrame:
    """Outputs that tables' roles suit, bound without naming a column, and whether their sums are the tables' own; one trend
    loses its first day."""
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderstatus")
    tables = {"orders": o, "customer": t.customer.select("c_mktsegment", "c_acctbal"), "lineitem": t.lineitem.select("l_extendedprice", "l_partkey", "l_returnflag")}

    def said(name: str, table: DataFrame, kind: str, made: DataFrame, measures: list[str]) -> DataFrame:
        sums = profile.sums_conserved(table, made, measures).withColumnRenamed("output", "made")
        return sums.select(F.lit(name).alias("table"), F.lit(kind).alias("output"), "measure", F.round("source", 2).alias("source"), F.round("made", 2).alias("made"), "ok")

    bound = {name: profile.bind(table) for name, table in tables.items()}
    out = [said(name, tables[name], *b) for name, b in bound.items()]
    kind, made, measures = bound["orders"]
    first = o.agg(F.min("day").alias("period"))
    out.append(said("damaged", o, kind, made.join(F.broadcast(first), "period", "left_anti"), measures))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {NM}, g AS (SELECT nation, ym, value/nullif(lag(value) OVER (PARTITION BY nation ORDER BY ym),0)-1 AS growth FROM nm) SELECT nation, ym, round(growth,4) AS growth FROM g WHERE growth NOT BETWEEN -1 AND 10")
def p13_bands(t: Tables) -> DataFrame:
    """Months whose growth isn't plausible."""
    g = nation_months(t).withColumn("growth", F.try_divide("value", F.lag("value").over(Window.partitionBy("nation").orderBy("ym"))) - 1)
    return rounded(g.filter(~profile.in_band(C("growth"), "growth")).select("nation", "ym", "growth"), "growth", places=4)


@query("""WITH r AS (SELECT l_returnflag AS kind, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rank, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem) SELECT kind, l_orderkey, l_linenumber, CAST(rank AS INT) AS rank, total, greatest(total-50,0) AS hidden FROM r WHERE rank<=50""")
def s6_findings_report(t: Tables) -> DataFrame:
    """The first fifty findings of each kind and how many more there are."""
    return records.findings_report(t.lineitem.select(C("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber"), "kind", ["l_orderkey", "l_linenumber"])


S9_YEARS = range(1995, 2002)
_S9 = ", ".join(f"coalesce(max(CASE WHEN y={y} THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END),'-') AS v{y}" for y in S9_YEARS)


@query(f"""WITH {NY}, x AS (SELECT n_regionkey AS region, nation, y, CASE WHEN y<1998 OR nation%2=0 THEN value END AS value FROM ny JOIN nation ON n_nationkey=nation),
k AS (SELECT region, nation, {_S9} FROM x GROUP BY 1,2)
SELECT CASE WHEN lag(region) OVER (ORDER BY region, nation)=region THEN '' ELSE CAST(region AS VARCHAR) END AS region_label, nation, {", ".join(f"v{y}" for y in S9_YEARS)}, 'won' AS unit FROM k""")
def s9_wide_records(t: Tables) -> DataFrame:
    """Records of nations within regions by year as a sheet; odd nations' later values are missing."""
    ny = nation_years(t).join(t.nation.select(C("n_nationkey").alias("nation"), C("n_regionkey").alias("region")), "nation")
    value = F.when((C("y") < 1998) | (C("nation") % 2 == 0), F.round("value").cast("long").cast("string"))
    rec = ny.select(F.lit("t").alias("table"), "region", "nation", C("y").cast("string").alias("period"), F.lit("sales").alias("item"), F.when(C("y") == 1996, "").otherwise("won").alias("unit"), value.alias("value"), (C("region") * 1_000_000 + C("nation") * 10_000 + C("y")).alias("ord"))
    out = records.wide_records(rec, "table", ["region", "nation"], [f"{y}|sales" for y in S9_YEARS])
    return out.select("region_label", "nation", *(C(f"{y}|sales").alias(f"v{y}") for y in S9_YEARS), "unit")


@query("SELECT left(p_brand,length(p_brand)-1) AS sheet, 4 AS row, k.key, count(DISTINCT year(l_shipdate)) AS columns FROM lineitem JOIN part ON l_partkey=p_partkey, (VALUES ('revenue'),('qty')) k(key) GROUP BY 1,3")
def b19_repeated_keys(t: Tables) -> DataFrame:
    """Measures repeat in the second header row, once per year, and are told apart by the years above."""
    full = settle(grid.filled(grid.unmerge(cells(t))))
    body = grid.classify(settle(grid.strip_titles(settle(grid.in_blocks(full, settle(grid.blocks(full)))))))
    return headers.repeated_keys(body).select("sheet", "row", "key", "columns")
