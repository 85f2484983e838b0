"""Queries of value normalisation, header, workbook and formula operators that have none elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import finance as fin
from tallywright.functions import normalize as n
from tallywright.operators import audit, grid, headers, ingest, profile
from tallywright.plans.facts import NM, NY, nation_months, nation_years, rounded
from tallywright.plans.registry import Tables, query

C = F.col


def cycle(of: Column, values: list[str | None]) -> Column:
    """The values in turn, by the remainder of a key."""
    return F.try_element_at(F.array(*(F.lit(v).cast("string") for v in values)), (of % len(values) + 1).cast("int"))


def cycled(key: str, values: list) -> str:
    """The same as SQL: a case over the remainder of a key."""
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"CASE {key}%{len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


def counted(t: Tables, values: list[str | None], result: Column) -> DataFrame:
    """Results of values that stand in turn in the order table, by count."""
    return t.orders.select(cycle(C("o_orderkey"), values).alias("x")).groupBy(result.alias("result")).agg(F.count("*").alias("n"))


def counted_sql(wanted: list, cast: str) -> str:
    return f"SELECT CAST({cycled('o_orderkey', wanted)} AS {cast}) AS result, count(*) AS n FROM orders GROUP BY 1"


MISSING = ["없음", "ns", "..", ".", "x)", "**", " N/A ", "…", "nil", "12", "-"]


@query(counted_sql(["없음", "ns", "..", ".", "x)", "**", "n/a", "…", None, None, "-"], "VARCHAR"))
def n1_sentinels(t: Tables) -> DataFrame:
    return counted(t, MISSING, n.sentinel(C("x")))


@query(counted_sql([True, False, False, True, False], "BOOLEAN"))
def n3_identifiers(t: Tables) -> DataFrame:
    return counted(t, ["007", "70", "0", " 0123 ", "0.5"], n.is_identifier(C("x")))


SCALED = ["3,400억", "(50백만)", "1,234천원", "△2조", "85%", "007", "12억원", "7", "1.5만원", "word"]


@query(counted_sql([340000000000.0, -50000000.0, 1234000.0, -2000000000000.0, 0.85, None, 1200000000.0, 7.0, 15000.0, None], "DOUBLE"))
def n4_cell_scales(t: Tables) -> DataFrame:
    """Amounts with a unit behind them, short units too."""
    return counted(t, SCALED, n.number(C("x"))["value"])


@query(counted_sql([10**6, 10**9, 10**8, 10**12, 1, 1, 10**3], "BIGINT"))
def n5_unit_labels(t: Tables) -> DataFrame:
    return counted(t, ["(단위: 백만원)", "십억원", "억", "조원", "%", "USD", "천"], n.unit_scale(C("x")))


@query(counted_sql([1000, 1000000, 1, 1000, 1], "BIGINT"))
def n7_format_scales(t: Tables) -> DataFrame:
    return counted(t, ["#,##0,", "#,##0,,", "#,##0", '0"천원"', "0.00%"], n.format_scale(C("x")))


@query(counted_sql(["매출", "A", "(1)", "x", "영업이익", "no 7"], "VARCHAR"))
def n8_footnotes(t: Tables) -> DataFrame:
    return counted(t, ["매출¹", "A*", "(1)", "x (주1)", "영업이익†", "no 7"], n.strip_footnote(C("x")))


@query(counted_sql([0, 1, 2, 2, 1], "INTEGER"))
def n9_indents(t: Tables) -> DataFrame:
    return counted(t, ["a", "  a", "    a", "\ta", "   a"], n.indent_level(C("x")))


@query("""SELECT o_orderpriority AS priority, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'NUM' WHEN '2' THEN 'DATE' WHEN '3' THEN 'MIXED' WHEN '4' THEN 'TEXT' ELSE 'PCT' END AS type FROM orders GROUP BY 1""")
def n10_column_types(t: Tables) -> DataFrame:
    """A column per priority: numbers with missing values, dates, half numbers, nothing but dashes, and per cents."""
    k, p = C("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    price = F.format_number("o_totalprice", 2)
    half = F.when(F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(k)) % 2 == 0, price).otherwise("word")
    v = F.when(p == "1", F.when(k % 5 == 0, "-").otherwise(price)).when(p == "2", F.date_format("o_orderdate", "yyyy-MM-dd")).when(p == "3", half).when(p == "4", "-").otherwise(F.concat(F.format_number("o_totalprice", 1), F.lit("%")))
    return n.column_type(t.orders.select(C("o_orderpriority").alias("priority"), v.alias("v")), ["priority"], "v")


@query(counted_sql(["1234|1234.0||", "|12.5||", "||2024-03-01|", "|||true", "|||false", "|||", "|-7.25||"], "VARCHAR"))
def n11_coercions(t: Tables) -> DataFrame:
    """Whole numbers, numbers, days and flags from text; what doesn't fit is null."""
    x = C("x")
    made = [n.to_integer(x), n.to_double(x), n.to_day(x), n.to_flag(x)]
    return counted(t, ["1,234", "$12.5", "2024/03/01", "yes", "N", "12,34", "-7.25"], F.array_join(F.transform(F.array(*(m.cast("string") for m in made)), lambda y: F.coalesce(y, F.lit(""))), "|"))


@query(counted_sql([24290, 24290, 24291, None, 24299], "INTEGER"))
def n12_year_months(t: Tables) -> DataFrame:
    return counted(t, ["2024-03-01", "2024년 3월", "2024Q2", "2024-13", "2024.12"], n.year_month(C("x")))


@query(counted_sql([-50.0, 0.0, 1234.5, 0.0, 0.0], "DOUBLE"))
def n13_lenient_numbers(t: Tables) -> DataFrame:
    return counted(t, ["(50)", "word", "1,234.5", None, "-"], n.lenient(C("x")))


@query(f"""WITH {NY} SELECT nation, y, round((value-closed)/nullif(value,0),4) AS gross_margin, round(open*0.1/nullif(value,0),4) AS operating_margin, round(open/nullif(CASE WHEN nation%5=0 THEN 0 ELSE closed END,0),4) AS current_ratio, round(value/nullif(n*1.0,0),4) AS ltv_cac FROM ny""")
def f8_named_ratios(t: Tables) -> DataFrame:
    """Ratios per nation and year; some have no liabilities."""
    r = fin.named_ratios(C("value"), C("closed"), C("open") * 0.1, C("open"), F.when(C("nation") % 5 == 0, 0.0).otherwise(C("closed")), C("value"), C("n").cast("double"))
    return nation_years(t).select("nation", "y", *(F.round(c, 4).alias(k) for k, c in r.items()))


@query("SELECT CASE o_orderkey%4 WHEN 1 THEN 'absolute' WHEN 2 THEN 'relative' WHEN 3 THEN 'far' ELSE 'same' END AS kind, o_orderkey%4<>3 AS ok, count(*) AS n FROM orders GROUP BY 1,2")
def f9_close_values(t: Tables) -> DataFrame:
    """Prices against themselves, a little off and far off."""
    k, x = C("o_orderkey") % 4, C("o_totalprice")
    kind = F.when(k == 1, "absolute").when(k == 2, "relative").when(k == 3, "far").otherwise("same")
    other = F.when(k == 1, x + 5e-7).when(k == 2, x * (1 + 5e-7)).when(k == 3, x * 1.001 + 1).otherwise(x)
    return t.orders.groupBy(kind.alias("kind"), fin.close_to(x, other).alias("ok")).agg(F.count("*").alias("n"))


@query(f"""WITH {NM}, p AS (SELECT nation, ym, value, (ym-min(ym) OVER (PARTITION BY nation))%12 AS pos FROM nm) SELECT nation, ym, round(avg(value) OVER (PARTITION BY nation, pos)/avg(value) OVER (PARTITION BY nation),6) AS "index" FROM p""")
def f13_seasonal_index(t: Tables) -> DataFrame:
    return rounded(fin.seasonal(nation_months(t), ["nation"], "ym", "value").select("nation", "ym", "index"), "index", places=6)


@query("SELECT l_linenumber AS sheet, count(*) AS n FROM lineitem WHERE l_orderkey%31 IN (3,4) GROUP BY 1")
def x2_error_cells(t: Tables) -> DataFrame:
    v = F.when(C("l_orderkey") % 31 == 3, "#DIV/0!").when(C("l_orderkey") % 31 == 4, " #N/A ").otherwise(C("l_tax").cast("string"))
    return audit.error_cells(t.lineitem.select(C("l_linenumber").alias("sheet"), v.alias("value_str"))).groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS sheet, count(*) AS n FROM lineitem WHERE l_orderkey%41=2 GROUP BY 1")
def x7_format_outliers(t: Tables) -> DataFrame:
    """Cells whose number format few others of their column have."""
    f = t.lineitem.select(C("l_linenumber").alias("sheet"), F.lit(1).alias("col"), F.when(C("l_orderkey") % 41 == 2, "0.000").otherwise("#,##0").alias("fmt"))
    return audit.minority(f, ["sheet", "col"], "fmt").groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS sheet, count(*) AS n FROM lineitem WHERE l_orderkey%23=1 GROUP BY 1")
def x11_numbers_as_text(t: Tables) -> DataFrame:
    """Cells whose text is a number but whose format is text, by sheet."""
    c = t.lineitem.select(F.lit("w").alias("workbook"), C("l_linenumber").alias("sheet"), F.format_number("l_extendedprice", 2).alias("value_str"), F.when(C("l_orderkey") % 23 == 1, "@").otherwise("General").alias("number_format"))
    return audit.numbers_as_text(c).groupBy("sheet").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_linenumber AS VARCHAR) AS sheet, max(l_orderkey)*max(l_suppkey) AS area FROM lineitem GROUP BY 1 HAVING max(l_orderkey)*max(l_suppkey)>300000")
def s4_oversize_sheets(t: Tables) -> DataFrame:
    """Sheets by line number with a cell per order and supplier: those with too large an extent."""
    c = t.lineitem.select(F.lit("w").alias("workbook"), C("l_linenumber").cast("string").alias("sheet"), C("l_orderkey").alias("row"), C("l_suppkey").alias("col"))
    return grid.oversize(c, 300_000).select("sheet", "area")


@query("SELECT count(*) AS cells, count(DISTINCT p_brand) AS anchors, count(*) FILTER (p_partkey%2=0) AS changed FROM part WHERE p_partkey NOT IN (SELECT min(p_partkey) FROM part GROUP BY p_brand) OR true")
def b1_unmerge(t: Tables) -> DataFrame:
    """A merged range per brand over the rows of its parts: blank cells take what the first one says, others keep theirs."""
    first = F.min("p_partkey").over(Window.partitionBy("p_brand"))
    text = F.when(C("p_partkey") == first, C("p_brand")).when(C("p_partkey") % 2 == 0, " ").otherwise("own")
    c = t.part.select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), C("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"), text.alias("value_str"), first.cast("int").alias("merge_row"), F.lit(1).alias("merge_col"), "p_brand")
    out = grid.unmerge(c)
    filled = (C("value_str") == C("p_brand")) & ((C("row") % 2 == 0) | (C("row") == C("merge_row")))
    return out.agg(F.count("*").alias("cells"), F.countDistinct("p_brand").alias("anchors"), F.count_if(filled & (C("row") % 2 == 0)).alias("changed"))


def sheets(t: Tables) -> DataFrame:
    """A sheet per supplier, whatever their number, with all traits at once: a band of headings over a gap, a repeated heading, a
    loss in red, a unit in a cell, an error, and a total; a sheet of contents besides that must be left out."""
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("sheet"), (F.round(F.abs("s_acctbal")).cast("long") + 20_000).alias("v"))
    cell = lambda r, c, x, rgb=None: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), (x if isinstance(x, Column) else F.lit(x)).cast("string").alias("value_str"), F.lit(rgb).cast("string").alias("font_rgb"))
    v = C("v")
    rows = [
        cell(1, 1, "item"), cell(1, 2, "2023년"), cell(1, 3, "2024년"), cell(1, 4, "2025년"),
        cell(4, 1, "alpha"), cell(4, 2, v), cell(4, 3, v + 1), cell(4, 4, v + 2),
        cell(5, 1, "beta"), cell(5, 2, v + 5), cell(5, 3, v + 6), cell(5, 4, v + 7),
        cell(6, 1, "item"), cell(6, 2, "2023년"), cell(6, 3, "2024년"), cell(6, 4, "2025년"),
        cell(7, 1, "loss"), cell(7, 2, v + 3, "FFFF0000"), cell(7, 3, F.concat((v + 4).cast("string"), F.lit("천원"))), cell(7, 4, "#REF!"),
        cell(8, 1, "gamma"), cell(8, 2, v + 8), cell(8, 3, v + 9), cell(8, 4, v + 10),
    ]
    body = s.select("sheet", F.inline(F.array(*rows)))
    toc = t.spark.range(3).select(F.lit("Contents").alias("sheet"), (C("id") + 1).cast("int").alias("row"), F.lit(1).alias("col"), C("id").cast("string").alias("value_str"), F.lit(None).cast("string").alias("font_rgb"))
    none = {"workbook": F.lit("w"), "bold": F.lit(False), "merge_row": F.lit(None).cast("int"), "merge_col": F.lit(None).cast("int"), "number_format": F.lit("General")}
    return body.unionByName(toc).withColumns(none)


@query("SELECT 's'||s_suppkey AS sheet, 1 AS r0, 1+s_suppkey%4 AS c0, 9 AS r1, 3+s_suppkey%4 AS c1 FROM supplier WHERE s_suppkey%3>0")
def b2_blocks(t: Tables) -> DataFrame:
    """A sheet per supplier: cells on a diagonal, which are no block; a full block; and one with labels that aren't repeated
    and a full last column, which is thin but has a column that fills its rows."""
    k = C("s_suppkey")
    at = t.supplier.select(k.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("row"))
    off = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda c: c + C("k") % 4)
    cols = F.when(C("k") % 3 == 0, F.array(C("row"))).when(C("k") % 3 == 1, off).otherwise(F.when(C("row") % 4 == 1, off).otherwise(F.slice(off, 3, 1)))
    spread = F.when((C("k") % 3 == 2) & (C("row") % 4 != 1), F.array(3 + C("k") % 4)).otherwise(cols)
    c = at.select(F.lit("w").alias("workbook"), F.concat(F.lit("s"), "k").alias("sheet"), C("row").cast("int").alias("row"), F.explode(F.transform(spread, lambda x: x.cast("int"))).alias("col"), F.lit("1.5").alias("value_str"))
    return grid.blocks(c).select("sheet", "r0", "c0", "r1", "c1")


@query("""WITH c AS (SELECT s_suppkey AS sheet, r AS row, c AS col, (s_suppkey*31+r*7+c*3)%4=0 AS head FROM supplier, range(1,8) x(r), range(1,6) y(c)),
p AS (SELECT d.sheet, k.direction, d.row, d.col, max(CASE WHEN k.direction IN ('up','left-up') THEN h.row*100+h.col ELSE h.col*100+h.row END) AS best FROM c d
  CROSS JOIN (VALUES ('up'),('left'),('up-left'),('left-up')) k(direction) LEFT JOIN c h ON h.head AND h.sheet=d.sheet AND CASE k.direction WHEN 'up' THEN h.col=d.col AND h.row<d.row
  WHEN 'left' THEN h.row=d.row AND h.col<d.col WHEN 'up-left' THEN h.col<=d.col AND h.row<d.row ELSE h.row<=d.row AND h.col<d.col END WHERE NOT d.head GROUP BY ALL)
SELECT sheet, direction, row, col, CAST(CASE WHEN direction IN ('up','left-up') THEN best//100 ELSE best%100 END AS INT) AS hrow,
CAST(CASE WHEN direction IN ('up','left-up') THEN best%100 ELSE best//100 END AS INT) AS hcol FROM p""")
def b15_nearest_headers(t: Tables) -> DataFrame:
    """A sheet per supplier with headers strewn over it: each other cell's nearest in the four directions."""
    at = t.supplier.select(C("s_suppkey").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("row")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("col"))
    head = (C("sheet") * 31 + C("row") * 7 + C("col") * 3) % 4 == 0
    made = [grid.nearest_header(at.filter(~head), at.filter(head), d, ["sheet"]).withColumn("direction", F.lit(d)) for d in ("up", "left", "up-left", "left-up")]
    return reduce(DataFrame.unionByName, made).select("sheet", "direction", "row", "col", "hrow", "hcol")


@query("""SELECT s_suppkey%6 AS form, s_suppkey%6 IN (0,1,2) AS subtotal, count(*) AS n FROM supplier GROUP BY 1,2""")
def b7_subtotal_labels(t: Tables) -> DataFrame:
    """Suppliers' names with a subtotal's word before, behind or alone, within another word, or without one."""
    name, k = C("s_name"), C("s_suppkey") % 6
    forms = [F.concat(F.lit("Total "), name), F.concat(name, F.lit(" 합계")), F.lit("소 계"), F.concat(F.lit("Totally "), name), name, F.concat(name, F.lit(" 합계표"))]
    label = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return t.supplier.groupBy(k.alias("form"), grid.is_subtotal(label).alias("subtotal")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT 's'||s_suppkey AS sheet, CAST(round(abs(s_acctbal)) AS BIGINT)+20000 AS v FROM supplier)
SELECT s.sheet, x.entity, x.period, x.value, x.flag FROM s, LATERAL (VALUES ('alpha','2023년',CAST(v AS DOUBLE),''),('alpha','2024년',v+1,''),('alpha','2025년',v+2,''),('loss','2023년',-(v+3),'SIGN_FROM_COLOR'),('loss','2024년',(v+4)*1000,'CELL_SCALE'),('loss','2025년',NULL,'ERROR_CELL'),('beta','2023년',v+5,''),('beta','2024년',v+6,''),('beta','2025년',v+7,''),('gamma','2023년',v+8,''),('gamma','2024년',v+9,''),('gamma','2025년',v+10,'')) x(entity, period, value, flag)""")
def b3_ingest_traits(t: Tables) -> DataFrame:
    """The whole way from cells to facts over a sheet per supplier."""
    return ingest.ingest(sheets(t)).select("sheet", "entity", "period", "value", F.array_join("flags", ",").alias("flag"))


@query("""SELECT 's'||s_suppkey AS sheet, k.col, k.kind FROM supplier, (VALUES (3,'SCALE_HETEROGENEOUS')) k(col, kind)""")
def t5_column_findings(t: Tables) -> DataFrame:
    """Columns in which some cells bring their own unit."""
    c = sheets(t).filter("row in (4, 5, 7, 8) and col > 1").withColumn("block_id", F.lit(0).cast("long"))
    return grid.column_findings(c).select("sheet", "col", "kind")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS sheet, CASE WHEN l_linenumber%3=1 THEN NULL ELSE l_linenumber-(l_linenumber+2)%3 END AS header_from FROM lineitem GROUP BY l_linenumber")
def b17_shared_headers(t: Tables) -> DataFrame:
    """Blocks down one sheet, a header on every third: the others take it from the last above."""
    b = t.lineitem.select("l_linenumber").distinct().select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), C("l_linenumber").cast("long").alias("block_id"), (C("l_linenumber") * 10).cast("int").alias("r0"), F.lit(1).alias("c0"), F.lit(4).alias("c1"), (C("l_linenumber") % 3 == 1).alias("has_header"))
    return headers.propagate(b).select(C("block_id").cast("string").alias("sheet"), "header_from")


@query("SELECT 'n'||o_custkey AS sheet FROM orders GROUP BY o_custkey HAVING o_custkey%2=0")
def b18_doubtful_headers(t: Tables) -> DataFrame:
    """A block per customer: even ones have numbers where the header should be."""
    s = t.orders.select(C("o_custkey").alias("k")).distinct()
    cell = lambda r, c, x: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), x.cast("string").alias("value_str"))
    top = lambda x: F.when(C("k") % 2 == 0, x.cast("string")).otherwise("name")
    c = s.select(F.lit("w").alias("workbook"), F.concat(F.lit("n"), "k").alias("sheet"), F.lit(0).cast("long").alias("block_id"), F.lit(1).alias("header_end"), F.inline(F.array(cell(1, 1, F.lit("x")), cell(1, 2, top(C("k"))), cell(1, 3, top(C("k") + 1)), cell(2, 1, F.lit("y")), cell(2, 2, C("k")), cell(2, 3, C("k") + 3))))
    return headers.suspect_no_header(c).select("sheet")


@query("SELECT 'orders' AS \"table\", 'trend' AS output UNION ALL SELECT 'customer', 'listing' UNION ALL SELECT 'lineitem', 'variance'")
def p3_recommended_outputs(t: Tables) -> DataFrame:
    """What the roles of three tables' columns suit."""
    of = lambda name, df: profile.recommend(profile.roles(profile.column_stats(df, df.columns))).select(F.lit(name).alias("table"), "output")
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderstatus")
    return of("orders", o).unionByName(of("customer", t.customer.select("c_mktsegment", F.concat(F.lit("C"), "c_custkey").alias("code")))).unionByName(of("lineitem", t.lineitem.select("l_extendedprice", "l_partkey", "l_returnflag")))


@query("SELECT c_nationkey AS workbook, CASE WHEN c_nationkey%4=3 THEN 'none' WHEN c_nationkey%4=0 THEN 'linked' WHEN count(DISTINCT c_mktsegment)=1 OR c_nationkey%4=1 THEN 'single' ELSE 'multi' END AS kind FROM customer GROUP BY c_nationkey")
def p4_workbook_verdicts(t: Tables) -> DataFrame:
    """Nations as workbooks with a sheet per segment: some have no data, one sheet with data, or formulas across sheets; formulas that
    stay on their sheet link nothing."""
    s = t.customer.groupBy(C("c_nationkey").alias("workbook"), C("c_mktsegment").alias("sheet")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("workbook").orderBy("sheet")) == 1
    k = C("workbook") % 4
    s = s.withColumn("output", F.when((k == 0) | (k == 2) | ((k == 1) & first), "listing"))
    edges = s.filter("workbook % 4 in (0, 2)").select("workbook", C("sheet").alias("from"), F.when(k == 0, F.concat("sheet", F.lit(" 2"))).otherwise(C("sheet")).alias("to"))
    return profile.workbook_verdict(s, edges).select("workbook", "kind")
