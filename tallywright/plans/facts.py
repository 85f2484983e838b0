"""Facts that the analyses start from: monthly, yearly and keyed aggregates of the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.plans.registry import Tables

C = F.col


def month(day: str) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def exact(amount: str) -> Column:
    """An amount as a decimal, whose sums don't hang on the order of rows."""
    return C(amount).cast("decimal(28,9)")


def nation_months(t: Tables, decimals: bool = False) -> DataFrame:
    """nation, ym, value, n of orders; decimals: value is an exact sum."""
    amount = exact("o_totalprice") if decimals else C("o_totalprice")
    o = t.orders.select("o_custkey", month("o_orderdate").alias("ym"), amount.alias("o_totalprice"))
    return o.join(t.customer.select(C("c_custkey").alias("o_custkey"), C("c_nationkey").alias("nation")), "o_custkey").groupBy("nation", "ym").agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"))


def brand_years(t: Tables) -> DataFrame:
    """brand, y, revenue, qty of line items."""
    line = t.lineitem.select("l_partkey", F.year("l_shipdate").alias("y"), (C("l_extendedprice") * (1 - C("l_discount"))).alias("r"), "l_quantity")
    return line.join(t.part.select(C("p_partkey").alias("l_partkey"), C("p_brand").alias("brand")), "l_partkey").groupBy("brand", "y").agg(F.sum("r").alias("revenue"), F.sum("l_quantity").alias("qty"))


def nation_years(t: Tables) -> DataFrame:
    """nation, y, value, n, debt-like and cost-like figures by order status."""
    o = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice", "o_orderstatus")
    j = o.join(t.customer.select(C("c_custkey").alias("o_custkey"), C("c_nationkey").alias("nation")), "o_custkey")
    return j.groupBy("nation", "y").agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"), F.sum(F.when(C("o_orderstatus") == "O", C("o_totalprice")).otherwise(0.0)).alias("open"), F.sum(F.when(C("o_orderstatus") == "F", C("o_totalprice")).otherwise(0.0)).alias("closed"))


#: The same facts as common table expressions.
NM = "nm AS (SELECT c_nationkey AS nation, year(o_orderdate)*12+month(o_orderdate)-1 AS ym, sum(o_totalprice) AS value, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"
BY = "by_ AS (SELECT p_brand AS brand, year(l_shipdate) AS y, sum(l_extendedprice*(1-l_discount)) AS revenue, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)"
NY = "ny AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, sum(o_totalprice) AS value, count(*) AS n, sum(CASE WHEN o_orderstatus='O' THEN o_totalprice ELSE 0 END) AS open, sum(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE 0 END) AS closed FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2)"


def rounded(df: DataFrame, *names: str, places: int = 2, ties: bool = False) -> DataFrame:
    """ties: values that are exact halves go by nine decimals, so that their last binary digits don't decide."""
    exact = (lambda n: C(n).cast("decimal(38,9)")) if ties else C
    return df.withColumns({n: F.round(exact(n), places).cast("double") if ties else F.round(exact(n), places) for n in names})
