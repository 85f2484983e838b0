"""Queries of the dimension, check, normalisation, grid, audit and profile operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import normalize as n
from tallywright.operators import audit, grid, profile
from tallywright.operators import checks as q
from tallywright.operators.lineage import settle
from tallywright.plans.facts import BY, NM, brand_years, month, nation_months, rounded
from tallywright.plans.registry import Tables, query

C = F.col


@query("""WITH r AS (SELECT min(year(o_orderdate)*12+month(o_orderdate)-1) AS a, max(year(o_orderdate)*12+month(o_orderdate)-1) AS b FROM orders), m AS (SELECT unnest(range(a,b+1)) AS ym FROM r)
SELECT ym, CAST((ym-3)//12+1 AS BIGINT) AS fy, (ym-3)%12+1 AS period, CAST((ym-3)%12//3+1 AS BIGINT) AS quarter, CAST(last_day(make_date(ym//12, ym%12+1, 1)) AS VARCHAR) AS cutoff, printf('FY%d-P%02d', (ym-3)//12+1, (ym-3)%12+1) AS label FROM m""")
def d1_fiscal_calendar(t: Tables) -> DataFrame:
    """Fiscal months from April over the span of the orders."""
    a, b = t.orders.agg(F.min(month("o_orderdate")), F.max(month("o_orderdate"))).first()
    return q.fiscal_calendar(t.spark, a, b, 4).select("ym", "fy", "period", "quarter", C("cutoff").cast("string").alias("cutoff"), "label")


@query("""WITH w AS (SELECT * FROM (VALUES (1,4),(2,8),(3,13),(4,17),(5,21),(6,26),(7,30),(8,34),(9,39),(10,43),(11,47),(12,52)) x(period, weeks)), s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), y AS (SELECT a, unnest(range(0, date_diff('day',a,b)//364+1)) AS y FROM s)
SELECT CAST(y+1 AS INT) AS fy, CAST(period AS BIGINT) AS period, CAST(CAST(a+CAST(y*364+weeks*7-1 AS INT) AS DATE) AS VARCHAR) AS cutoff FROM y, w""")
def d2_calendar_445(t: Tables) -> DataFrame:
    """4-4-5 cutoffs from the first order on."""
    a, years = t.orders.agg(F.min(C("o_orderdate").cast("date")).alias("a"), (F.date_diff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")) / 364).cast("int") + 1).first()
    return q.calendar_445(t.spark, str(a), years).withColumn("cutoff", C("cutoff").cast("string"))


@query("""WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), d AS (SELECT unnest(range(a, b+INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS d FROM s) SELECT CAST(d AS VARCHAR) AS day, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, strftime(d,'%Y-%m') AS year_month FROM d""")
def d4_date_dimension(t: Tables) -> DataFrame:
    span = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("d")).select(C("d").cast("string").alias("day"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"), F.date_format("d", "yyyy-MM").alias("year_month"))


def tree(t: Tables) -> DataFrame:
    """node, parent, value: the world, regions, nations and suppliers with their balances."""
    zero = F.lit(0.0).alias("value")
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), C("s_acctbal").alias("value"))
    nat = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), zero)
    return s.unionByName(nat).unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), zero))


TREE = "tr AS (SELECT 's'||s_suppkey AS node, 'n'||s_nationkey AS parent, s_acctbal AS value FROM supplier UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, 0 FROM nation UNION ALL SELECT 'r'||r_regionkey, NULL, 0 FROM region)"


@query(f"WITH RECURSIVE {TREE}, cl AS (SELECT node AS top, node FROM tr UNION ALL SELECT cl.top, tr.node FROM cl JOIN tr ON tr.parent=cl.node) SELECT top AS node, round(sum(value),2) AS total FROM cl JOIN tr ON tr.node=cl.node GROUP BY top")
def d5_rollup(t: Tables) -> DataFrame:
    return rounded(q.rollup_tree(tree(t)).select("node", "total"), "total")


@query(f"WITH {TREE} SELECT node FROM tr WHERE node NOT IN (SELECT parent FROM tr WHERE parent IS NOT NULL)")
def d6_leaves(t: Tables) -> DataFrame:
    return q.leaves(tree(t)).select("node")


@query(f"""WITH RECURSIVE {TREE}, two AS (SELECT 'whole' AS tree, * FROM tr UNION ALL SELECT 'damaged', * FROM tr WHERE node<>'n3'
  UNION ALL VALUES ('damaged', 'c1', 'c2', 5.0), ('damaged', 'c2', 'c1', 7.0), ('damaged', 'c3', 'c1', 9.0)),
reached AS (SELECT tree, node, value FROM two WHERE parent IS NULL UNION ALL SELECT b.tree, b.node, b.value FROM two b JOIN reached r ON b.tree=r.tree AND b.parent=r.node),
top AS (SELECT tree, sum(value) AS top FROM reached GROUP BY tree)
SELECT tree, round(sum(value),2) AS leaf_sum, abs(sum(value)-any_value(top))<=0.01 AS ok,
count(*) FILTER (parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM two p WHERE p.tree=b.tree AND p.node=b.parent)) AS orphans,
count(*) FILTER (node IN ('c1','c2')) AS in_cycle FROM two b JOIN top USING (tree) GROUP BY tree""")
def q11_hierarchy_ties(t: Tables) -> DataFrame:
    """Roots' totals against the sum of all, for the whole tree and for one without a nation and with a cycle."""
    whole = tree(t)
    more = t.spark.createDataFrame([("c1", "c2", 5.0), ("c2", "c1", 7.0), ("c3", "c1", 9.0)], "node string, parent string, value double")
    damaged = whole.filter("node <> 'n3'").unionByName(more)
    said = lambda name, nodes: q.hierarchy_ties(nodes).select(F.lit(name).alias("tree"), F.round("leaf_sum", 2).alias("leaf_sum"), "ok", "orphans", "in_cycle")
    return said("whole", whole).unionByName(said("damaged", damaged))


@query("SELECT l_partkey, l_suppkey, count(*) AS n, 'DUPLICATE' AS reason FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def q9_grain(t: Tables) -> DataFrame:
    return q.grain(t.lineitem, ["l_partkey", "l_suppkey"])


@query("WITH f AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders), g AS (SELECT * FROM (SELECT DISTINCT c FROM f), (SELECT DISTINCT y FROM f)) SELECT c, y FROM g EXCEPT SELECT c, y FROM f")
def q1_missing_periods(t: Tables) -> DataFrame:
    """Years of the ruler in which a customer has no orders."""
    f = t.orders.select(C("o_custkey").alias("c"), F.year("o_orderdate").alias("y"))
    return q.missing_periods(f, f.select("y"), ["c"], "y")


@query("SELECT coalesce(a.k,b.k) AS k, coalesce(a.n,0) AS customers, coalesce(b.n,0) AS suppliers, CASE WHEN b.k IS NULL THEN 'LEFT_ONLY' WHEN a.k IS NULL THEN 'RIGHT_ONLY' ELSE 'MAPPED' END AS match_status FROM (SELECT c_nationkey*2 AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)")
def q2_full_outer(t: Tables) -> DataFrame:
    a = t.customer.groupBy((C("c_nationkey") * 2).alias("k")).agg(F.count("*").alias("customers"))
    return q.full_outer(a, t.supplier.groupBy(C("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), ["k"]).fillna(0)


@query("SELECT 'population' AS check_name, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier))=(SELECT count(*) FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b USING (k)) AS ok")
def q3_full_population(t: Tables) -> DataFrame:
    a, b = t.customer.select(C("c_nationkey").alias("k")).distinct(), t.supplier.select(C("s_nationkey").alias("k")).distinct()
    return q.full_outer(a, b, ["k"]).agg(F.count("*").alias("n")).crossJoin(a.union(b).distinct().agg(F.count("*").alias("u"))).select(F.lit("population").alias("check_name"), (C("n") == C("u")).alias("ok"))


@query("SELECT o_orderstatus AS status, round(sum(o_totalprice),2) AS source, round(sum(s),2) AS output, round(sum(o_totalprice)-sum(s),2) AS difference, abs(sum(o_totalprice)-sum(s))<=1 AS ok, count(*) FILTER (s IS NULL) AS excluded FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice*(1+l_tax)*(1-l_discount)) AS s FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey GROUP BY 1")
def q4_q5_tie_out(t: Tables) -> DataFrame:
    """Order totals against their lines by status: counts, sums, difference and what has no lines."""
    l = t.lineitem.groupBy("l_orderkey").agg(F.sum(C("l_extendedprice") * (1 + C("l_tax")) * (1 - C("l_discount"))).alias("s"))
    j = t.orders.join(l, C("o_orderkey") == C("l_orderkey"), "left").groupBy(C("o_orderstatus").alias("status")).agg(F.sum("o_totalprice").alias("a"), F.sum("s").alias("b"), F.count_if(C("s").isNull()).alias("excluded"))
    return j.select("status", F.round("a", 2).alias("source"), F.round("b", 2).alias("output"), F.round(C("a") - C("b"), 2).alias("difference"), q.tie_out(C("a"), C("b"), 1.0).alias("ok"), "excluded")


@query("SELECT s AS segment, p AS priority, round(v,2) AS value FROM (SELECT * FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT DISTINCT o_orderpriority AS p FROM orders)) LEFT JOIN (SELECT c_mktsegment AS s, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2) USING (s,p)")
def q7_cross_tab(t: Tables) -> DataFrame:
    """Every segment times every priority."""
    f = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).select(C("c_mktsegment").alias("segment"), C("o_orderpriority").alias("priority"), "o_totalprice")
    return rounded(q.cross_tab(f, t.customer.select(C("c_mktsegment").alias("segment")), t.orders.select(C("o_orderpriority").alias("priority")), "segment", "priority", F.sum("o_totalprice")), "value")


@query("SELECT c_nationkey AS nation, round(sum(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE 0 END)/nullif(count(*) FILTER (o_orderpriority='1-URGENT'),0),4) AS value, CASE WHEN c_nationkey%7=0 THEN 'UNIT_MISMATCH' WHEN count(*) FILTER (o_orderpriority='1-URGENT')=0 THEN 'ZERO_DENOM' END AS reason FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey%7<>0 GROUP BY 1 UNION ALL SELECT DISTINCT c_nationkey, NULL, 'UNIT_MISMATCH' FROM customer JOIN orders ON o_custkey=c_custkey WHERE c_nationkey%7=0")
def q18_ratio_or_na(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).groupBy(C("c_nationkey").alias("nation")).agg(F.sum(F.when(C("o_orderstatus") == "F", C("o_totalprice")).otherwise(0.0)).alias("a"), F.count_if(C("o_orderpriority") == "1-URGENT").cast("double").alias("b"))
    r = q.ratio(C("a"), C("b"), F.when(C("nation") % 7 == 0, "EUR").otherwise("USD"), F.lit("USD"))
    return j.select("nation", F.round(r["value"], 4).alias("value"), r["reason"].alias("reason"))


@query(f"""WITH {NM}, s AS (SELECT nation, ym, value-lag(value) OVER (PARTITION BY nation ORDER BY ym) AS step FROM nm), e AS (SELECT *, avg(step) OVER (PARTITION BY nation ORDER BY ym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean FROM s)
SELECT nation, ym, round(step,2) AS step, round(prior_mean,6) AS prior_mean FROM e WHERE step*prior_mean<0 AND abs(step)>=0.5*abs(prior_mean)""")
def q17_sign_steps(t: Tables) -> DataFrame:
    s = nation_months(t).withColumn("step", C("value") - F.lag("value").over(Window.partitionBy("nation").orderBy("ym"))).select("nation", "ym", "step")
    return rounded(rounded(q.sign_steps(s, ["nation"], "ym", "step"), "step"), "prior_mean", places=6)


@query(f"WITH {NM} SELECT nation, round(regr_slope(value,n)*avg(n)/avg(value),4) AS elasticity, regr_slope(value,n)*avg(n)/avg(value)>0.3 AS mislabeled FROM nm GROUP BY nation")
def q17_elasticity(t: Tables) -> DataFrame:
    return rounded(q.elasticity(nation_months(t), ["nation"], "value", "n"), "elasticity", places=4)


@query(f"WITH {NM}, a AS (SELECT DISTINCT nation, ym FROM nm), g AS (SELECT nation, ym FROM (SELECT DISTINCT nation FROM nm), (SELECT DISTINCT ym FROM nm)) SELECT ym, count(*) AS nations FROM a GROUP BY ym HAVING count(*)<(SELECT count(DISTINCT nation) FROM nm)")
def q10_scenario_aligned(t: Tables) -> DataFrame:
    """Months whose population of nations isn't that of all months."""
    nm = nation_months(t)
    return nm.groupBy("ym").agg(F.count("*").alias("nations")).crossJoin(F.broadcast(nm.agg(F.countDistinct("nation").alias("all")))).filter("nations < all").select("ym", "nations")


@query("""SELECT l_linenumber AS line, round(sum(l_extendedprice) FILTER (NOT (l_orderkey%7=5 OR l_orderkey%7=6 AND l_extendedprice>=1000)),2) AS parsed,
count(*) FILTER (l_orderkey%7=5 OR l_orderkey%7=6 AND l_extendedprice>=1000) AS texts FROM lineitem GROUP BY 1""")
def n6_text_numbers(t: Tables) -> DataFrame:
    """Prices written as brackets, triangles, full-width digits, per cents and thousands, read back; a bracket without its
    fellow and thousands apart by blanks are texts."""
    x, k = C("l_extendedprice"), C("l_orderkey") % 7
    plain = F.format_number(x, 2)
    text = (
        F.when(k == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 1, F.concat(F.lit("△"), plain)).when(k == 2, F.translate(plain, n.ASCII[:94], n.FULL[:94]))
        .when(k == 3, F.concat(F.format_string("%.2f", x * 100), F.lit("%"))).when(k == 4, F.concat(F.format_string("%.5f", x / 1000), F.lit("천원")))
        .when(k == 5, F.concat(F.lit("("), plain)).otherwise(F.translate(plain, ",", " "))
    )
    v = n.number(text)
    read = t.lineitem.select(C("l_linenumber").alias("line"), F.when(v["negative"], -v["value"]).otherwise(v["value"]).alias("v"))
    return read.groupBy("line").agg(F.round(F.sum("v"), 2).alias("parsed"), F.count_if(C("v").isNull()).alias("texts"))


@query("""SELECT o_orderkey%10 AS form, o_orderkey%10<8 AS period, count(*) AS n FROM orders GROUP BY 1,2""")
def n14_periods(t: Tables) -> DataFrame:
    """Order dates as quarters, halves, months and years in the forms that headers have, and two that are none."""
    d, k = C("o_orderdate"), C("o_orderkey") % 10
    y, quarter, month_ = F.year(d).cast("string"), F.quarter(d).cast("string"), F.month(d).cast("string")
    half = F.when(F.month(d) <= 6, "상반기").otherwise("하반기")
    forms = [
        F.concat(quarter, F.lit("분기")), F.concat(y, F.lit("년 "), quarter, F.lit("분기")), half, F.concat(y, F.lit("년 "), half), F.concat(quarter, F.lit("Q")), F.concat(y, F.lit("."), month_),
        F.concat(y, F.lit("Q"), quarter), F.concat(month_, F.lit("월")), F.concat(quarter, F.lit("번")), C("o_orderpriority"),
    ]
    text = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return t.orders.groupBy(k.alias("form"), F.coalesce(n.is_period(text), F.lit(False)).alias("period")).agg(F.count("*").alias("n"))


def cells(t: Tables) -> DataFrame:
    """A sheet per brand group: title and unit row, a two-level merged header of years over measures, ditto labels, data."""
    by = brand_years(t).withColumn("group", F.regexp_extract("brand", r"^(.*?)\d$", 1)).withColumn("digit", F.regexp_extract("brand", r"(\d)$", 1).cast("int"))
    base = by.select(F.lit("w").alias("workbook"), C("group").alias("sheet"), "digit", (C("y") - 1995).alias("k"), "y", "revenue", "qty")
    body = base.select("workbook", "sheet", (C("digit") + 5 - (C("sheet") == "Brand#").cast("int")).alias("row"), F.explode(F.array(F.struct((3 + 2 * C("k")).alias("col"), F.format_number("revenue", 2).alias("value_str")), F.struct((4 + 2 * C("k")).alias("col"), F.concat(F.lit("("), F.format_string("%.1f", "qty"), F.lit(")")).alias("value_str")))).alias("x")).select("workbook", "sheet", "row", "x.*")
    sheets = base.select("workbook", "sheet").distinct()
    years = base.select("workbook", "sheet", "k", "y").distinct()
    heads = years.select("workbook", "sheet", F.explode(F.array(F.struct(F.lit(3).alias("row"), (3 + 2 * C("k")).alias("col"), C("y").cast("string").alias("value_str")), F.struct(F.lit(4).alias("row"), (3 + 2 * C("k")).alias("col"), F.lit("revenue¹").alias("value_str")), F.struct(F.lit(4).alias("row"), (4 + 2 * C("k")).alias("col"), F.lit("qty").alias("value_str")))).alias("x")).select("workbook", "sheet", "x.*")
    labels = base.select("workbook", "sheet", "digit").distinct().select("workbook", "sheet", F.explode(F.array(F.struct((C("digit") + 5 - (C("sheet") == "Brand#").cast("int")).alias("row"), F.lit(1).alias("col"), F.when((C("digit") == 0) | (C("sheet") == "Brand#") & (C("digit") == 1), C("sheet")).alias("value_str")), F.struct((C("digit") + 5 - (C("sheet") == "Brand#").cast("int")).alias("row"), F.lit(2).alias("col"), C("digit").cast("string").alias("value_str")))).alias("x")).select("workbook", "sheet", "x.*").withColumn("value_str", F.when(C("col") == 2, F.concat(F.lit("no "), "value_str")).otherwise(C("value_str")))
    fixed = sheets.select("workbook", "sheet", F.explode(F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("Sales").alias("value_str")), F.struct(F.lit(2).alias("row"), F.lit(1).alias("col"), F.lit("(단위: 원)").alias("value_str")), F.struct(F.lit(3).alias("row"), F.lit(1).alias("col"), F.lit("group").alias("value_str")), F.struct(F.lit(3).alias("row"), F.lit(2).alias("col"), F.lit("item").alias("value_str")))).alias("x")).select("workbook", "sheet", "x.*")
    return body.unionByName(heads).unionByName(labels).unionByName(fixed).withColumns({"row": C("row").cast("int"), "col": C("col").cast("int"), "bold": F.lit(False), "merge_row": F.lit(None).cast("int"), "merge_col": F.lit(None).cast("int")})


@query(f"WITH {BY} SELECT left(brand,length(brand)-1)||' > no '||right(brand,1) AS entity, CAST(y AS VARCHAR) AS period, 'revenue' AS metric, round(revenue,2) AS value FROM by_ UNION ALL SELECT left(brand,length(brand)-1)||' > no '||right(brand,1), CAST(y AS VARCHAR), 'qty', -round(qty,1) FROM by_")
def b16_grid_to_tidy(t: Tables) -> DataFrame:
    """Cells to tidy facts: blocks, titles, headers, ditto labels, bracketed negatives."""
    return grid.ingest(cells(t)).select("entity", "period", "metric", F.round("value", 2).alias("value"))


@query(f"""WITH {BY}, c AS (SELECT CASE WHEN y=1996 THEN right(brand,1) END AS d, m FROM by_, (VALUES ('revenue'),('qty')) m(m)),
s AS (SELECT CASE WHEN m='qty' OR d IS NULL THEN 'covered' WHEN d='1' THEN 'missing' WHEN d='2' THEN 'duplicate' WHEN d='3' THEN 'mismatch' WHEN d='4' THEN 'scaled' ELSE 'covered' END AS status FROM c
  UNION ALL SELECT 'extra' FROM c WHERE d='5' AND m='revenue')
SELECT status, count(*) AS n FROM s GROUP BY status""")
def t13_reconcile(t: Tables) -> DataFrame:
    """Tidy rows that are damaged after the ingest: of 1996, items 1 are lost, items 2 doubled, items 3 off by a hundredth,
    items 4 scaled by a thousand and say so, and items 5 come twice, once where no cell is."""
    c = settle(cells(t))
    rows = settle(grid.ingest(c))
    d = F.when((C("period") == "1996") & (C("metric") == "revenue"), F.right("entity", F.lit(1))).otherwise("")
    kept = rows.withColumn("_d", d).filter("_d <> '1'")
    off = F.when(C("_d") == "3", C("value") + 0.01).when(C("_d") == "4", C("value") * 1000).otherwise(C("value"))
    changed = kept.withColumns({"value": off, "scale_applied": F.when(C("_d") == "4", F.lit(1000).cast("long")).otherwise(C("scale_applied"))})
    more = kept.filter("_d = '2'").unionByName(kept.filter("_d = '5'").withColumn("src_row", C("src_row") + 1000))
    return grid.reconcile(c, changed.drop("_d").unionByName(more.drop("_d"))).groupBy("status").agg(F.count("*").alias("n"))


YEARS = range(1995, 2002)


@query(f"WITH {BY} SELECT brand, " + ", ".join(f"round(max(revenue) FILTER (y={y}),2) AS y{y}" for y in YEARS) + " FROM by_ GROUP BY brand")
def t15_to_mart(t: Tables) -> DataFrame:
    rows = brand_years(t).select("brand", F.concat(F.lit("y"), "y").alias("metric"), C("revenue").alias("value"), F.lit("data").alias("row_role"), F.lit(1).alias("src_row"))
    names = [f"y{y}" for y in YEARS]
    return rounded(grid.to_mart(rows, ["brand"], names), *names)


@query(f"WITH {NM} SELECT nation, CAST(ym//12 AS BIGINT) AS year, round(sum(value)+CASE WHEN (nation+ym//12)%6=1 THEN 10 ELSE 0 END,2) AS subtotal, (nation+ym//12)%6<>1 AS ok FROM nm GROUP BY nation, ym//12")
def t14_subtotal_islands(t: Tables) -> DataFrame:
    """Months with a yearly subtotal row behind each twelve; every sixth subtotal is off by ten."""
    nm = nation_months(t).select("nation", C("ym").cast("long").alias("ym"), "value").withColumn("y", F.floor(C("ym") / 12))
    data = nm.select("nation", (C("ym") * 2).alias("o"), "value", F.lit("data").alias("row_role"))
    wrong = F.when((C("nation") + C("y")) % 6 == 1, 10.0).otherwise(0.0)
    subs = nm.groupBy("nation", "y").agg(F.sum("value").alias("value")).withColumn("value", C("value") + wrong).select("nation", ((C("y") * 12 + 11) * 2 + 1).alias("o"), "value", F.lit("subtotal").alias("row_role"))
    g = grid.subtotal_islands(data.unionByName(subs), ["nation"], "o")
    first = nm.groupBy("nation").agg(F.min("y").alias("y0"))
    return g.join(first, "nation").select("nation", (C("y0") + C("island")).alias("year"), F.round("subtotal", 2).alias("subtotal"), "ok")


def formulas(t: Tables) -> DataFrame:
    """A formula cell per order line: mostly filled down, some with smells, some with a text that only looks like one."""
    r, k = C("l_orderkey").cast("int"), C("l_orderkey") % 97
    f = F.when(k == 0, F.format_string("=C%d/D%d", r, r)).when(k == 1, F.format_string("=[ext.xlsx]S!A%d+B%d", r, r)).when(k == 2, F.format_string("=A%d*1.37", r)).when(k == 3, F.format_string("=IF(IF(IF(IF(IF(A%d))))))", r)).when(k == 4, F.format_string('="IF(1/9.99,[x.xls]a!b)"&A%d', r)).otherwise(F.format_string("=A%d*B%d", r, r))
    return t.lineitem.select(C("l_linenumber").alias("sheet"), r.alias("row"), F.lit(3).alias("col"), f.alias("formula"))


@query("SELECT l_linenumber AS sheet, CASE l_orderkey%97 WHEN 0 THEN 'UNGUARDED_DIVISION' WHEN 1 THEN 'EXTERNAL' WHEN 2 THEN 'CONSTANT' ELSE 'NESTED' END AS kind, count(*) AS n FROM lineitem WHERE l_orderkey%97<4 GROUP BY 1,2")
def x1_formula_smells(t: Tables) -> DataFrame:
    return audit.formula_smells(formulas(t)).groupBy("sheet", "kind").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS sheet, count(*) AS n FROM lineitem WHERE l_orderkey%97<5 GROUP BY 1")
def x6_formula_consistency(t: Tables) -> DataFrame:
    """Formulas whose relative form differs from the column's."""
    f = formulas(t).withColumn("form", audit.relative_form(C("formula"), C("row"), C("col")))
    return audit.minority(f, ["sheet", "col"], "form").groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS sheet, fn, count(*) AS n FROM (SELECT l_linenumber, 'IF' AS fn FROM lineitem, range(5) WHERE l_orderkey%97=3) GROUP BY 1,2")
def x20_function_counts(t: Tables) -> DataFrame:
    return formulas(t).select("sheet", F.explode(audit.functions_in(audit.tokens(C("formula")))).alias("fn")).groupBy("sheet", "fn").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey%1000=7")
def x9_text_in_numbers(t: Tables) -> DataFrame:
    """Orders whose total is written as a word in a numeric column."""
    v = t.orders.select("o_orderkey", F.when(C("o_orderkey") % 1000 == 7, "see note").otherwise(C("o_totalprice").cast("string")).alias("v"), F.lit("total").alias("column"))
    return audit.text_in_numbers(v.withColumn("kind", n.value_kind(C("v"))), ["column"], "kind").select("o_orderkey")


@query(f"WITH {NM} SELECT nation, CAST(ym//12 AS BIGINT) AS year, count(*) AS n_above, (nation+ym//12)%7<>2 AS ok FROM nm GROUP BY nation, ym//12 HAVING count(*)>=2")
def x12_crossfoot(t: Tables) -> DataFrame:
    """Months and a total of each year; every seventh total is off by one."""
    nm = nation_months(t).withColumn("year", F.floor(C("ym") / 12).cast("long"))
    data = nm.select("nation", "year", F.row_number().over(Window.partitionBy("nation", "year").orderBy("ym")).cast("long").alias("row"), "value", F.lit(False).alias("total"))
    tot = nm.groupBy("nation", "year").agg(F.count("*").alias("m"), F.sum("value").alias("value"))
    tot = tot.withColumn("value", C("value") + F.when((C("nation") + C("year")) % 7 == 2, 1.0).otherwise(0.0)).select("nation", "year", (C("m") + 1).alias("row"), "value", F.lit(True).alias("total"))
    return audit.crossfoot(data.unionByName(tot), ["nation", "year"], "row", "value", "total").select("nation", "year", "n_above", "ok")


@query("WITH k AS (SELECT DISTINCT round(p_retailprice*s,2) AS v FROM part, (VALUES (1.0::DOUBLE),(1e3),(1e6),(1e-3),(1e-6)) x(s)) SELECT l_orderkey, l_linenumber FROM lineitem WHERE round(l_extendedprice,2) NOT IN (SELECT v FROM k)")
def x14_untraced(t: Tables) -> DataFrame:
    return audit.untraced(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), t.part, "l_extendedprice", "p_retailprice").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey%11=0 THEN 'LOST' ELSE 'CHANGED' END AS status FROM orders WHERE o_orderkey%11=0 OR o_orderkey%13=0")
def x16_snapshot_diff(t: Tables) -> DataFrame:
    a = t.orders.select(C("o_orderkey").alias("k"), C("o_totalprice").alias("v"))
    b = a.filter("k % 11 <> 0").withColumn("v", F.when(C("k") % 13 == 0, C("v") + 1).otherwise(C("v")))
    return audit.snapshot_diff(a, b, ["k"], "v")


@query()
def x18_claims(t: Tables) -> DataFrame:
    """Numbers in pages without their tags against part prices."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return audit.claims(t.pages, "page_id", text, t.part, "p_retailprice")


@query("SELECT CAST(sum(CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(*) AS n, count(DISTINCT o_orderstatus) AS card, 'dimension' AS status_role, 'measure' AS price_role FROM orders")
def p1_roles(t: Tables) -> DataFrame:
    """Roles of columns of the orders, from one pass over the whole table."""
    s = profile.roles(profile.column_stats(t.orders, ["o_totalprice", "o_orderstatus", "o_custkey"]))
    of = lambda c, what: F.max(F.when(C("column") == c, C(what)))
    return s.agg(of("o_totalprice", "nulls").alias("nulls"), of("o_totalprice", "n").alias("n"), of("o_orderstatus", "card").alias("card"), of("o_orderstatus", "role").alias("status_role"), of("o_totalprice", "role").alias("price_role"))


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KIND = "CASE WHEN bool_and({c}=floor({c})) AND count(DISTINCT {c})=count({c}) AND min({c})>=0 AND max({c})-min({c})+1<=1.5*count(DISTINCT {c}) THEN 'key' ELSE 'measure' END"
_KINDS = [(c, _KIND.format(c=c)) for c in _NUMBERS] + [(c, f"CASE WHEN count(DISTINCT {c})>50 THEN 'key' ELSE 'choice' END") for c in ("l_returnflag", "l_linestatus")] + [("l_shipdate", "'date'")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS card, {kind} AS kind FROM lineitem" for c, kind in _KINDS))
def p5_kinds(t: Tables) -> DataFrame:
    return profile.kinds(profile.column_stats(t.lineitem.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), t.lineitem.columns)).select("column", "n", "nulls", "card", "kind")


@query(f"""WITH {NM}, y AS (SELECT nation, ym, ln(value) AS y FROM nm WHERE value>0), f AS (SELECT nation, regr_slope(y,ym) AS b, regr_intercept(y,ym) AS a FROM y GROUP BY nation),
r AS (SELECT nation, ym, y-a-b*ym-avg(y-a-b*ym) OVER (PARTITION BY nation, ym%12) AS r FROM y JOIN f USING (nation)), l AS (SELECT *, lag(r) OVER (PARTITION BY nation ORDER BY ym) AS p FROM r)
SELECT nation, round(exp(any_value(b))-1,6) AS trend, round(stddev_samp(r),6) AS noise, round(corr(r,p),6) AS ar1, 0.0 AS null_rate, 0.0 AS negative_rate, 0.0 AS zero_rate FROM l JOIN f USING (nation) GROUP BY nation""")
def p6_measure_shape(t: Tables) -> DataFrame:
    """Trend, noise and AR(1) of each nation's months."""
    return rounded(profile.measure_shape(nation_months(t), ["nation"], "ym", "value"), "trend", "noise", "ar1", places=6)


@query("SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) AS card, round(k/(SELECT count(*) FROM customer),4) AS weight, count(*) AS members FROM (SELECT count(*) AS k FROM customer GROUP BY c_mktsegment) GROUP BY k")
def p7_choice_shape(t: Tables) -> DataFrame:
    return profile.choice_shape(t.customer, "c_mktsegment")


@query("SELECT CASE WHEN abs(corr(l_quantity,l_extendedprice))>=0.1 THEN round(corr(l_quantity,l_extendedprice),6) END AS quantity_price, CASE WHEN abs(corr(l_quantity,l_discount))>=0.1 THEN round(corr(l_quantity,l_discount),6) END AS quantity_discount FROM lineitem")
def p8_correlation(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(profile.correlation("l_quantity", "l_extendedprice"), 6).alias("quantity_price"), F.round(profile.correlation("l_quantity", "l_discount"), 6).alias("quantity_discount"))


@query("""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, 'License')) AS a, len(regexp_extract_all(text, '@')) AS b, len(regexp_extract_all(text, '[#$%]{3}')) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a,b,c)=0 THEN NULL WHEN a=greatest(a,b,c) THEN 'license' WHEN b=greatest(a,b,c) THEN 'contact' ELSE 'junk' END AS tag, CAST(greatest(a,b,c) AS INT) AS hits FROM h""")
def p12_tag_documents(t: Tables) -> DataFrame:
    return profile.tag(t.documents, "doc_id", "text", [("license", "License"), ("contact", "@"), ("junk", "[#$%]{3}")])
