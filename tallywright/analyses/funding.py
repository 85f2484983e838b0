"""Debt: a revolver with sweeps in order of rank, and schedules of tranches, for many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
REVOLVER = "revolver"


def _pick(of: Column, k: Column) -> Column:
    return F.try_element_at(of, k)


def solve(periods: DataFrame, facilities: DataFrame, tranches: DataFrame) -> DataFrame:
    """model, k, draw, repay, revolver, debt, interest, cash and balances (by rank).

    periods: model, k, flow (before interest and financing). facilities: model, cash0, floor, top (the revolver's limit),
    sweep (whether surplus cash repays). tranches: model, name, opening, rate, rank (null: never repaid by a sweep).

    A model without a tranche of that name has no revolver and draws nothing; one without tranches has cash alone.

    Interest falls on the average of opening and closing debt, which depends on what is drawn or repaid. Drawing d adds
    rate * d / 2 and repaying x saves rate * x / 2, so each period has its fixed point in closed form and nothing iterates.
    """
    s = periods.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("k", C("flow").cast("double").alias("flow")))).alias("s"))
    last = F.coalesce(C("rank"), F.lit(1 << 30))
    kind = F.struct(last.alias("order"), "name", C("opening").cast("double").alias("opening"), C("rate").cast("double").alias("rate"), "rank")
    t = tranches.groupBy("model").agg(F.sort_array(F.collect_list(kind)).alias("t"))
    j = s.join(facilities, "model").join(t, "model", "left")
    j = j.withColumn("t", F.coalesce("t", F.array().cast(t.schema["t"].dataType)))
    j = j.withColumn("n", F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t"))).otherwise(F.array().cast("array<int>"))).withColumn("at", F.array_position(F.transform("t", lambda x: x["name"]), REVOLVER).cast("int"))
    at, has = F.greatest(C("at"), F.lit(1)), C("at") > 0
    share = lambda i: 1 - _pick(C("t"), i)["rate"] / 2
    sum_ = lambda of: F.aggregate(of, F.lit(0.0), lambda a, x: a + x)

    def period(a: Column, x: Column) -> Column:
        standing = sum_(F.zip_with(a["debts"], C("t"), lambda d, y: d * y["rate"]))
        need = C("floor") - a["cash"] - x["flow"] + standing
        room = F.greatest(C("top") - _pick(a["debts"], at), F.lit(0.0))
        draw = F.when(has & (need > 0), F.least(need / share(at), room)).otherwise(0.0)

        def repay(b: Column, i: Column) -> Column:
            most = F.greatest(_pick(a["debts"], i), F.lit(0.0))
            pay = F.when(_pick(C("t"), i)["rank"].isNull(), 0.0).otherwise(F.least(most, b["left"] / share(i)))
            return F.struct((b["left"] - pay * share(i)).alias("left"), F.concat(b["paid"], F.array(pay)).alias("paid"))

        none = F.struct(F.when(C("sweep") & (need < 0), -need).otherwise(0.0).alias("left"), F.array().cast("array<double>").alias("paid"))
        paid = F.aggregate(C("n"), none, repay)["paid"]
        drawn = F.transform(C("n"), lambda i: F.when(i == C("at"), draw).otherwise(0.0))
        after = F.zip_with(F.zip_with(a["debts"], paid, lambda d, p: d - p), drawn, lambda d, p: d + p)
        interest = sum_(F.zip_with(F.zip_with(a["debts"], after, lambda d, e: (d + e) / 2), C("t"), lambda d, y: d * y["rate"]))
        cash = a["cash"] + x["flow"] - interest + draw - sum_(paid)
        row = F.struct(
            x["k"].alias("k"), draw.alias("draw"), sum_(paid).alias("repay"), F.when(has, _pick(after, at)).otherwise(0.0).alias("revolver"), sum_(after).alias("debt"),
            interest.alias("interest"), cash.alias("cash"), after.alias("balances"),
        )
        return F.struct(after.alias("debts"), cash.alias("cash"), F.concat(a["rows"], F.array(row)).alias("rows"))

    of_k = periods.schema["k"].dataType.simpleString()
    rows = f"array<struct<k:{of_k},draw:double,repay:double,revolver:double,debt:double,interest:double,cash:double,balances:array<double>>>"
    start = F.struct(F.transform("t", lambda x: x["opening"]).alias("debts"), C("cash0").cast("double").alias("cash"), F.array().cast(rows).alias("rows"))
    return j.select("model", F.inline(F.aggregate("s", start, period)["rows"]))


def schedule(periods: DataFrame, tranches: DataFrame) -> DataFrame:
    """Facility, tranche, k, opening, interest, mandatory, sweep, draw, closing.

    periods: facility, k (from 1), cash (surplus for sweeps; below zero is drawn). tranches: facility, tranche, ord, kind
    (term or revolver), opening, rate (on opening balances), sweep_enabled, mandatory (an array by period).
    Term tranches come first in their order, then revolvers, which take what cash is left.
    """
    s = periods.groupBy("facility").agg(F.sort_array(F.collect_list(F.struct("k", C("cash").cast("double").alias("cash")))).alias("s"))
    kind = F.struct((C("kind") == REVOLVER).alias("late"), "ord", "tranche", C("opening").cast("double").alias("opening"), C("rate").cast("double").alias("rate"), "sweep_enabled", "mandatory")
    t = tranches.groupBy("facility").agg(F.sort_array(F.collect_list(kind)).alias("t"))
    j = s.join(t, "facility").withColumn("n", F.sequence(F.lit(1), F.size("t")))
    zero = F.lit(0.0)
    of_k, of_t = (d.schema[c].dataType.simpleString() for d, c in ((periods, "k"), (tranches, "tranche")))
    rows = f"array<struct<tranche:{of_t},k:{of_k},opening:double,interest:double,mandatory:double,sweep:double,draw:double,closing:double>>"

    def period(a: Column, x: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            y, opening = _pick(C("t"), i), _pick(a["books"], i)
            due = F.least(F.greatest(F.coalesce(F.try_element_at(y["mandatory"], x["k"].cast("int")), zero), zero), F.greatest(opening, zero))
            sweep = F.when(~y["late"] & y["sweep_enabled"] & (b["cash"] > 0), F.least(b["cash"], F.greatest(opening - due, zero))).otherwise(zero)
            draw = F.when(y["late"] & (b["cash"] < 0), -b["cash"]).otherwise(zero)
            back = F.when(b["cash"] > 0, F.least(b["cash"], F.greatest(opening, zero))).otherwise(zero)
            paid = F.when(y["late"], back).otherwise(due)
            closing = opening - paid - sweep + draw
            left = b["cash"] - sweep - F.when(y["late"], back).otherwise(zero) + draw
            row = F.struct(y["tranche"].alias("tranche"), x["k"].alias("k"), opening.alias("opening"), (opening * y["rate"]).alias("interest"), paid.alias("mandatory"), sweep.alias("sweep"), draw.alias("draw"), closing.alias("closing"))
            return F.struct(left.alias("cash"), F.concat(b["books"], F.array(closing)).alias("books"), F.concat(b["rows"], F.array(row)).alias("rows"))

        inner = F.struct(x["cash"].alias("cash"), F.array().cast("array<double>").alias("books"), a["rows"].alias("rows"))
        done = F.aggregate(C("n"), inner, one)
        return F.struct(done["books"].alias("books"), done["rows"].alias("rows"))

    start = F.struct(F.transform("t", lambda y: y["opening"]).alias("books"), F.array().cast(rows).alias("rows"))
    return j.select("facility", F.inline(F.aggregate("s", start, period)["rows"]))


def check_schedule(rows: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Rows whose balance doesn't roll: opening - mandatory - sweep + draw = closing, which the next period opens with."""
    from pyspark.sql import Window

    after = F.lead("opening").over(Window.partitionBy("facility", "tranche").orderBy("k"))
    rolls = F.abs(C("opening") - C("mandatory") - C("sweep") + C("draw") - C("closing")) <= tol
    chains = F.coalesce(F.abs(after - C("closing")) <= tol, F.lit(True))
    return rows.withColumn("ok", rolls & chains).filter("not ok")
