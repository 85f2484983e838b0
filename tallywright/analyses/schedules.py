"""Schedules and packs with their checks, for many assets, entities or figures at once: assets with events (K14), weekly cash
(K5), board figures with their sources (K9) and unit costs (K20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.checks import ratio, tie_out

C = F.col


def asset_schedule(assets: DataFrame, start: int, end: int, only: DataFrame | None = None) -> DataFrame:
    """Asset, period, opening, dep, closing, impairment and active, a row per asset and month from start to end, or for
    the months of `only` (asset, period) among these alone.

    assets: asset, cost, salvage, life, in_service, first_factor, dispose, impair, impair_to; months are whole numbers
    (12 * year + month - 1) and null events are none. Nothing is written before the asset is in service, after its life and
    from the month of its disposal on, where the book value stays. An impairment sets that month's opening value, which
    spreads over what is left of the life; the last month of a life lands on the salvage value. Events after the disposal
    are ignored; an asset without a positive life keeps its cost. A null in_service is the first month, a null first_factor
    one. `active` is whether the ledger must show the month: in service and before the disposal.

    Spark takes a table of assets times months for as small as the assets' file, so joins with it are merges by hint: none of
    its sides is sent through the driver.
    """
    begun = F.coalesce(C("in_service"), F.lit(start))
    gone, hit = C("dispose") - C("_from"), C("impair") - C("_from")
    life = F.when(C("life") > 0, C("life"))
    a = assets.withColumn("_from", begun).withColumn("_gone", gone).withColumn("_life", life)
    counts = C("impair_to").isNotNull() & (hit >= 0) & (C("_gone").isNull() | (hit <= C("_gone")))
    a = a.withColumn("_hit", F.when(counts, hit)).withColumn("_f", F.coalesce(C("first_factor"), F.lit(1.0)))
    if only is None:
        months = a.repartition("asset").withColumn("period", F.explode(F.sequence(F.lit(start), F.lit(end))))
    else:
        months = a.join(only.filter(C("period").between(start, end)).select("asset", "period").distinct().hint("merge"), "asset")
    grid = months.withColumn("_i", C("period") - C("_from"))
    base, each = C("cost") - C("salvage"), (C("cost") - C("salvage")) / C("_life")
    rest = F.greatest(C("impair_to") - C("salvage"), F.lit(0.0)) / F.greatest(C("_life") - C("_hit"), F.lit(1))

    def plain(i: Column) -> Column:
        """The book value before month i without an impairment."""
        return C("cost") - F.when(C("_life").isNull() | (i <= 0), 0.0).when(i >= C("_life"), base).otherwise(each * (i - 1 + C("_f")))

    def reset(i: Column) -> Column:
        """The book value before month i after an impairment."""
        part = F.when(C("_hit") == 0, 1 - C("_f")).otherwise(0.0)
        done = C("_life").isNull() | (C("_hit") >= C("_life")) | (i <= C("_hit"))
        return F.when(done, C("impair_to")).when(i >= C("_life"), C("salvage")).otherwise(C("impair_to") - rest * (i - C("_hit") - part))

    def book(i: Column, at: Column) -> Column:
        return F.when(C("_hit").isNotNull() & (at >= C("_hit")), reset(i)).otherwise(plain(i))

    frozen = C("_gone").isNotNull() & (C("_i") >= C("_gone"))
    opening = F.when(frozen, book(C("_gone"), C("_gone"))).otherwise(book(C("_i"), C("_i")))
    closing = F.when(frozen, C("opening")).otherwise(book(C("_i") + 1, C("_i")))
    rows = grid.withColumn("opening", opening).withColumn("closing", closing).withColumn("dep", C("opening") - C("closing"))
    rows = rows.withColumn("impairment", F.when(C("_i") == C("_hit"), plain(C("_hit")) - C("impair_to")).otherwise(0.0))
    live = (C("_i") >= 0) & ~frozen
    return rows.select("asset", "period", "opening", "dep", "closing", "impairment", live.alias("active"))


def missing_accruals(schedule: DataFrame, booked: DataFrame) -> DataFrame:
    """Asset, period and dep of active months for which the ledger (asset, period, amount) has no amount."""
    there = booked.filter("amount is not null").select("asset", "period").distinct()
    return schedule.filter("active").join(there.hint("merge"), ["asset", "period"], "left_anti").select("asset", "period", "dep")


def disposal_results(schedule: DataFrame, sales: DataFrame) -> DataFrame:
    """Asset, period, nbv, price and result (a gain is positive) of sales (asset, period, price). A sale outside the
    schedule's months has no book value here and a null result."""
    nbv = schedule.select("asset", "period", C("opening").alias("nbv"))
    return sales.join(nbv.hint("merge"), ["asset", "period"], "left").select("asset", "period", "nbv", "price", (C("price") - C("nbv")).alias("result"))


def ledger_tie(schedule: DataFrame, booked: DataFrame, tol: float = 0.5) -> DataFrame:
    """Period, scheduled, missing (the count of months not booked), accrued, ledger and ok. What the ledger lacks is
    reported apart and isn't in `accrued`, which must tie; postings in months without a schedule fail."""
    there = booked.filter("amount is not null").select("asset", "period").distinct().withColumn("_there", F.lit(1))
    rows = schedule.join(there.hint("merge"), ["asset", "period"], "left").withColumn("_lacks", F.when(C("active") & C("_there").isNull(), 1))
    mine = rows.groupBy("period").agg(
        F.sum("dep").alias("scheduled"), F.count("_lacks").alias("missing"), F.coalesce(F.sum(F.when(C("_lacks").isNull(), C("dep"))), F.lit(0.0)).alias("accrued")
    )
    theirs = booked.groupBy("period").agg(F.sum("amount").alias("ledger"))
    both = mine.join(theirs, "period", "full")
    both = both.withColumn("ledger", F.when(C("scheduled").isNotNull(), F.coalesce("ledger", F.lit(0.0))).otherwise(C("ledger")))
    return both.withColumn("ok", tie_out(C("accrued"), C("ledger"), tol))


def cash_lines(flows: DataFrame, weeks: int = 13) -> DataFrame:
    """K5: entity, side, line, week (from 1) and amount: every line that an entity has, in every week, zero where it is still.

    flows: entity, side (in or out), line, week, amount. Flows outside of the weeks aren't in the forecast.
    """
    inside = flows.filter(C("week").between(1, weeks)).groupBy("entity", "side", "line", "week").agg(F.sum("amount").alias("amount"))
    keys = flows.select("entity", "side", "line").distinct()
    grid = keys.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    return grid.join(inside, ["entity", "side", "line", "week"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def cash_weeks(lines: DataFrame, openings: DataFrame, floor: float = 0.0) -> DataFrame:
    """K5: entity, week, inflow, outflow, opening, closing, lowest (closing so far) and short (closing below the floor).

    lines: as of cash_lines. openings: entity, opening; an entity without one starts at zero.
    """
    side = lambda s: F.sum(F.when(C("side") == s, C("amount")).otherwise(0.0))
    g = lines.groupBy("entity", "week").agg(side("in").alias("inflow"), side("out").alias("outflow")).join(openings, "entity", "left")
    w = Window.partitionBy("entity").orderBy("week")
    g = g.withColumn("closing", F.coalesce("opening", F.lit(0.0)) + F.sum(C("inflow") - C("outflow")).over(w))
    g = g.withColumn("opening", C("closing") - C("inflow") + C("outflow")).withColumn("lowest", F.min("closing").over(w))
    return g.select("entity", "week", "inflow", "outflow", "opening", "closing", "lowest", (C("closing") < floor).alias("short"))


def check_cash(report: DataFrame, lines: DataFrame, openings: DataFrame, weeks: int = 13, tol: float = 1e-6) -> DataFrame:
    """K5: entity, check, ok and bad (how many weeks fail) of a report (entity, week, inflow, outflow, opening, closing).

    WEEKS: each week of the ruler once. CHAIN: a week opens with what the one before closed with. START: the first opens with
    the opening balance. ROLL: opening, inflow and outflow give the closing. LINES: the lines of a side add up to its total.
    """
    side = lambda s: F.sum(F.when(C("side") == s, C("amount")).otherwise(0.0))
    parts = lines.groupBy("entity", "week").agg(side("in").alias("_in"), side("out").alias("_out"))
    w = Window.partitionBy("entity").orderBy("week")
    rows = report.withColumn("_before", F.lag("closing").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    rows = rows.join(parts, ["entity", "week"], "left").join(openings.select("entity", C("opening").alias("_open")), "entity", "left")
    off = lambda a, b: ~tie_out(a, b, tol)
    zero = lambda c: F.coalesce(C(c), F.lit(0.0))
    inside = F.count_if(C("week").between(1, weeks))
    distinct = F.count_distinct(F.when(C("week").between(1, weeks), C("week")))
    bad = {
        "WEEKS": F.lit(weeks) - distinct + F.count("*") - distinct,
        "CHAIN": F.count_if(~C("_first") & off(C("opening"), C("_before"))),
        "START": F.count_if(C("_first") & off(C("opening"), zero("_open"))),
        "ROLL": F.count_if(off(C("opening") + C("inflow") - C("outflow"), C("closing"))),
        "LINES": F.count_if(off(C("inflow"), zero("_in")) | off(C("outflow"), zero("_out"))),
    }
    g = rows.groupBy("entity").agg(*(b.cast("long").alias(k) for k, b in bad.items()), inside.alias("_n"))
    each = F.array(*(F.struct(F.lit(k).alias("check"), (C(k) == 0).alias("ok"), C(k).alias("bad")) for k in bad))
    return g.select("entity", F.inline(each))


def board_pack(board: DataFrame, source: DataFrame, keys: list[str], tol: float = 0.0) -> DataFrame:
    """K9: keys, actual, target, attainment (null for a zero target), status, source and tie of a board's figures.

    board: keys, actual, target. source: keys, value. status is MET from 100 % on, NO_TARGET without a target, else MISSED.
    tie is TIED or OFF; a figure without a source is its own and UNSOURCED, a source that the board doesn't show UNSHOWN.
    """
    own = board.withColumn("_b", F.lit(True))
    theirs = source.groupBy(*keys).agg(F.sum("value").alias("source")).withColumn("_s", F.lit(True))
    j = own.join(theirs, keys, "full").withColumn("attainment", F.try_divide("actual", "target"))
    status = F.when(C("_b").isNull(), None).when(C("target").isNull() | (C("target") == 0), "NO_TARGET").when(C("attainment") >= 1, "MET").otherwise("MISSED")
    tie = F.when(C("_b").isNull(), "UNSHOWN").when(C("_s").isNull(), "UNSOURCED").when(tie_out(C("actual"), C("source"), tol), "TIED").otherwise("OFF")
    return j.select(*keys, "actual", "target", "attainment", status.alias("status"), "source", tie.alias("tie"))


def unit_costs(lines: DataFrame) -> DataFrame:
    """Lines (cost, qty, unit, canonical_unit and any keys) with unit_cost, or the reason why there is none."""
    r = ratio(C("cost"), C("qty"), C("unit"), C("canonical_unit"))
    return lines.withColumns({"unit_cost": r["value"], "reason": r["reason"]})


def blended_cost(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and in all (null keys) cost and qty of lines with a unit cost, their blended cost, and how many lines
    have one or none. It is cost over quantity, never a sum or mean of unit costs; without a valid line it is null."""
    valid = C("reason").isNull()
    g = costs.rollup(*keys).agg(
        F.coalesce(F.sum(F.when(valid, C("cost"))), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(F.when(valid, C("qty"))), F.lit(0.0)).alias("qty"),
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.grouping_id().alias("level"),
    )
    return g.filter(C("level").isin(0, 2 ** len(keys) - 1)).withColumn("blended", F.try_divide("cost", "qty"))
