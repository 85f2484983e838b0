"""Allocation of service departments' cost down a declared order, for many entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def _folded(costs: DataFrame, drivers: DataFrame, order: DataFrame) -> DataFrame:
    """A row per entity with the departments' costs after the last service (`cur`) and the flows between departments."""
    weight = F.sum(F.greatest(C("weight").cast("double"), F.lit(0.0))).alias("weight")
    by = drivers.groupBy("entity", "source", "target").agg(weight)
    by = by.groupBy("entity", "source").agg(F.sort_array(F.collect_list(F.struct("target", "weight"))).alias("to"))
    listed = order.join(by, ["entity", "source"], "left").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "to"))).alias("services"))
    dept = costs.groupBy("entity", "dept").agg(F.sum(C("cost").cast("double")).alias("cost"), F.max("kind").alias("kind"))
    depts = dept.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("dept", "cost", "kind"))).alias("depts"))
    of_dept = costs.schema["dept"].dataType.simpleString()
    no_drivers = F.array().cast(f"array<struct<target:{of_dept},weight:double>>")
    no_flows = F.array().cast(f"array<struct<source:{of_dept},target:{of_dept},amount:double>>")

    def total(of: Column, name: str) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + x[name])

    def passed(a: Column, o: Column) -> Column:
        """The flows of one service: by its drivers to departments that are still open, else evenly to open production."""
        amount = total(F.filter(a["cur"], lambda d: d["dept"] == o["source"]), "cost")
        closed = F.concat(a["closed"], F.array(o["source"]))
        by_driver = F.filter(F.coalesce(o["to"], no_drivers), lambda d: (d["weight"] > 0) & ~F.array_contains(closed, d["target"]))
        open_ = F.filter("depts", lambda d: (d["kind"] == "production") & ~F.array_contains(closed, d["dept"]))
        evenly = F.transform(open_, lambda d: F.struct(d["dept"].alias("target"), F.lit(1.0).alias("weight")))
        # An array of one holds what is used more than once.
        held = F.array(F.struct(amount.alias("amount"), F.when(F.size(by_driver) > 0, by_driver).otherwise(evenly).alias("to")))

        def shared(x: Column) -> Column:
            part = lambda d: x["amount"] * d["weight"] / total(x["to"], "weight")
            return F.transform(x["to"], lambda d: F.struct(o["source"].alias("source"), d["target"].alias("target"), part(d).alias("amount")))

        return F.element_at(F.transform(held, shared), 1)

    def step(a: Column, o: Column) -> Column:
        def settled(new: Column) -> Column:
            got = lambda d: total(F.filter(new, lambda f: f["target"] == d["dept"]), "amount")
            left = lambda d: F.when(d["dept"] == o["source"], 0.0).otherwise(d["cost"]) + got(d)
            cur = F.transform(a["cur"], lambda d: F.struct(d["dept"].alias("dept"), left(d).alias("cost"), d["kind"].alias("kind")))
            return F.struct(cur.alias("cur"), F.concat(a["closed"], F.array(o["source"])).alias("closed"), F.concat(a["flows"], new).alias("flows"))

        return F.element_at(F.transform(F.array(passed(a, o)), settled), 1)

    start = F.struct(C("depts").alias("cur"), F.array().cast(f"array<{of_dept}>").alias("closed"), no_flows.alias("flows"))
    services = F.coalesce("services", F.array().cast(listed.schema["services"].dataType))
    return depts.join(listed, "entity", "left").select("entity", F.aggregate(services, start, step).alias("a"))


def step_down(costs: DataFrame, drivers: DataFrame, order: DataFrame) -> DataFrame:
    """Entity, dept, kind, cost: what stands in each department after all services have passed theirs on.

    costs: entity, dept, kind (production or another), cost. drivers: entity, source, target, weight. order: entity, rank,
    source. Services pass on what they have by then, in order of rank, to departments that aren't closed, by weight; a
    service closes before it passes. Without open targets of positive weight its cost goes evenly to open production; without
    these either it is lost, and `conserved` says so. An entity's departments are one row's arrays.
    """
    return _folded(costs, drivers, order).select("entity", F.inline("a.cur")).select("entity", "dept", "kind", "cost")


def step_down_flows(costs: DataFrame, drivers: DataFrame, order: DataFrame) -> DataFrame:
    """Entity, source, target, amount of each flow between departments."""
    return _folded(costs, drivers, order).select("entity", F.inline("a.flows"))


def conserved(costs: DataFrame, final: DataFrame, tol: float = 0.01) -> DataFrame:
    """Entity, input, final (what stands in production) and whether they tie."""
    given = costs.groupBy("entity").agg(F.sum("cost").alias("input"))
    left = final.filter("kind = 'production'").groupBy("entity").agg(F.sum("cost").alias("final"))
    j = given.join(left, "entity", "left").fillna(0.0, ["final"])
    return j.withColumn("ok", F.coalesce(F.abs(C("input") - C("final")) <= tol, F.lit(False)))
