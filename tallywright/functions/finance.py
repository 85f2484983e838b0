"""Finance formulas as Column expressions and grouped DataFrame functions, for many entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def npv(rate: Column, t: str = "t", cash: str = "cash") -> Column:
    """F1, an aggregate: the cash flow at t = 0 is not discounted."""
    return F.sum(C(cash) / F.pow(1 + rate, C(t)))


def irr(
    flows: DataFrame, key: str, t: str = "t", cash: str = "cash", low: float = -0.9999, high: float = 10.0, guess: float = 0.1, tol: float = 1e-7, steps: int = 200
) -> DataFrame:
    """key, irr and status, from the flows in order of t.

    Newton's method goes from `guess` until the value or the step is below `tol` (status newton). Where it breaks off, for
    want of a slope, at a rate of -100 % or after `steps`, bisection between low and high takes over (status bisection).
    Null, with status none, without flows of both signs or a change of sign between low and high.
    """
    series = flows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(C(t).cast("double").alias("t"), C(cash).cast("double").alias("c")))).alias("s"), (F.min(cash) < 0).alias("out"), (F.max(cash) > 0).alias("in")
    )

    def value(rate: Column) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, x: a + x["c"] / F.pow(1 + rate, x["t"]))

    def slope(rate: Column) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, x: a - x["t"] * x["c"] / F.pow(1 + rate, x["t"] + 1))

    state = lambda rate, ended: F.struct(rate.alias("rate"), F.lit(ended).alias("ended"))

    def newton(a: Column) -> Column:
        # An array of one holds what is used more than once.
        held = F.array(F.struct(value(a["rate"]).alias("f"), slope(a["rate"]).alias("d")))

        def move(x: Column) -> Column:
            new = a["rate"] - F.try_divide(x["f"], x["d"])
            broken = new.isNull() | F.isnan(new) | (new <= -0.999999)
            return F.when(F.abs(x["f"]) < tol, state(a["rate"], 1)).when(broken, state(a["rate"], 2)).when(F.abs(new - a["rate"]) < tol, state(new, 1)).otherwise(state(new, 0))

        return F.when(a["ended"] > 0, a).otherwise(F.element_at(F.transform(held, move), 1))

    def halve(a: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        up = F.signum(value(mid)) == C("side")
        return F.struct(F.when(up, mid).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"))

    both = C("out") & C("in")
    tried = series.withColumn("n", F.when(both, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(guess), 0), lambda a, _: newton(a))))
    open_ = both & (C("n.ended") != 1)
    sided = tried.withColumn("side", F.when(open_, F.signum(value(F.lit(low)))))
    crosses = open_ & (C("side") * F.signum(value(F.lit(high))) < 0)
    # 80 halvings of the bracket leave less than a double can tell apart.
    found = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), lambda a, _: halve(a))
    halved = sided.withColumn("b", F.when(crosses, (found["lo"] + found["hi"]) / 2))
    rate = F.when(C("n.ended") == 1, C("n.rate")).otherwise(C("b"))
    status = F.when(C("n.ended") == 1, "newton").when(C("b").isNotNull(), "bisection").otherwise("none")
    return halved.select(key, rate.alias("irr"), status.alias("status"))


def mirr(finance: Column, reinvest: Column, t: str = "t", cash: str = "cash") -> Column:
    """F3, an aggregate over whole series: null without flows of both signs."""
    n = F.max(t)
    out = F.sum(F.when(C(cash) < 0, C(cash) / F.pow(1 + finance, C(t))))
    back = F.sum(F.when(C(cash) > 0, C(cash) * F.pow(1 + reinvest, -C(t)))) * F.pow(1 + F.first(reinvest), n)
    return F.when((out < 0) & (back > 0) & (n > 0), F.pow(back / -out, 1 / n) - 1)


def wacc(equity: Column, debt: Column, cost_equity: Column, cost_debt: Column, tax: Column) -> Column:
    """F4."""
    total = equity + debt
    return F.when(total > 0, equity / total * cost_equity + debt / total * cost_debt * (1 - tax))


def payback(flows: DataFrame, key: str, rate: Column, t: str = "t", cash: str = "cash") -> DataFrame:
    """key and the time at which the discounted running sum first reaches zero, interpolated; null if never."""
    w = Window.partitionBy(key).orderBy(t)
    run = flows.withColumn("_d", C(cash) / F.pow(1 + rate, C(t))).withColumn("_c", F.sum("_d").over(w)).withColumn("_p", F.lag("_c").over(w))
    hit = (C("_c") >= 0) & (C("_p") < 0) & (C(t) > 0)
    return run.groupBy(key).agg(F.min(F.when(hit, F.struct(C(t), (C(t) - 1 + F.try_divide(-C("_p"), C("_d"))).alias("at"))))["at"].alias("payback"))


def cagr(begin: Column, end: Column, periods: Column) -> Column:
    """null for a begin or number of periods that isn't positive, and for a negative end."""
    return F.when((begin > 0) & (periods > 0) & (end >= 0), F.pow(end / begin, 1 / periods) - 1)


def variance_pct(actual: Column, plan: Column) -> Column:
    """F7."""
    return F.try_divide(actual - plan, F.abs(plan))


def named_ratios(revenue: Column, cogs: Column, operating: Column, assets: Column, liabilities: Column, ltv: Column, cac: Column) -> dict[str, Column]:
    """F8: gross and operating margin, current ratio and lifetime value over acquisition cost; null for a zero denominator."""
    return {"gross_margin": F.try_divide(revenue - cogs, revenue), "operating_margin": F.try_divide(operating, revenue), "current_ratio": F.try_divide(assets, liabilities), "ltv_cac": F.try_divide(ltv, cac)}


def close_to(a: Column, b: Column, rel: float = 1e-6, abs_: float = 1e-6) -> Column:
    """F9."""
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def depreciation(assets: DataFrame, cost: str, salvage: str, life: str) -> DataFrame:
    """a row per asset and month k = 1..life with opening, dep and closing; the last month lands on salvage."""
    base = C(cost) - C(salvage)
    grid = assets.filter(C(life) > 0).withColumn("k", F.explode(F.sequence(F.lit(1), C(life).cast("int"))))
    dep = F.when(C("k") < C(life), base / C(life)).otherwise(base - base / C(life) * (C(life) - 1))
    closing = F.when(C("k") < C(life), C(cost) - base / C(life) * C("k")).otherwise(C(salvage))
    return grid.withColumns({"dep": dep, "opening": C(cost) - base / C(life) * (C("k") - 1), "closing": closing})


def depreciation_ext(assets: DataFrame) -> DataFrame:
    """cost, salvage, life, first_factor, dispose_k, impair_k, impair_to (nulls: none), a row per month.

    A first month may count in part; the rest spreads to the end. From the month after an impairment the book value
    spreads over what is left of the life. After a disposal nothing is written; events after it are ignored.
    """
    impair = F.when(C("dispose_k").isNull() | (C("impair_k") <= C("dispose_k")), C("impair_k"))
    grid = assets.withColumn("_i", impair).withColumn("k", F.explode(F.sequence(F.lit(1), C("life").cast("int"))))
    base, month = C("cost") - C("salvage"), (C("cost") - C("salvage")) / C("life")

    def before(k: Column) -> Column:
        return C("cost") - F.when(k >= C("life"), base).when(k <= 0, 0.0).otherwise(month * (k - 1 + C("first_factor")))

    def book(k: Column) -> Column:
        left = C("life") - C("_i")
        after = C("impair_to") - F.when(left > 0, (C("impair_to") - C("salvage")) * (k - C("_i")) / left).otherwise(0.0)
        return F.when(C("_i").isNotNull() & (k >= C("_i")), after).otherwise(before(k))

    gone = C("dispose_k").isNotNull() & (C("k") > C("dispose_k"))
    opening, closing = book(C("k") - 1), book(C("k"))
    loss = F.when(C("k") == C("_i"), before(C("k")) - C("impair_to")).otherwise(0.0)
    rows = grid.withColumns({"opening": F.when(gone, 0.0).otherwise(opening), "closing": F.when(gone | (C("k") == C("dispose_k")), 0.0).otherwise(closing), "impairment": F.when(gone, 0.0).otherwise(loss)})
    return rows.withColumn("dep", F.when(gone, 0.0).otherwise(opening - closing - C("impairment"))).drop("_i")


def robust(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with median, mad (times 1.4826) and Tukey fences by linear quantiles."""
    q = series.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    mad = series.join(q, keys).groupBy(*keys).agg((1.4826 * F.percentile(F.abs(C(value) - C("median")), 0.5)).alias("mad"))
    return q.join(mad, keys).select(*keys, "median", "mad", (C("q1") - 1.5 * (C("q3") - C("q1"))).alias("low"), (C("q3") + 1.5 * (C("q3") - C("q1"))).alias("high"))


def seasonal(series: DataFrame, keys: list[str], ord_: str, value: str, season: int = 12) -> DataFrame:
    """adds `index`, the mean of a position in the season over the mean; 1 for short series or a mean of zero."""
    whole = Window.partitionBy(*keys)
    placed = series.withColumn("_pos", (C(ord_) - F.min(ord_).over(whole)) % season)
    part = Window.partitionBy(*keys, "_pos")
    mean = F.avg(value).over(whole)
    return placed.withColumn("index", F.when((F.count("*").over(whole) < season) | (mean == 0), 1.0).otherwise(F.avg(value).over(part) / mean)).drop("_pos")


def run_rate(series: DataFrame, keys: list[str], ord_: str, value: str, season: int = 12) -> DataFrame:
    """keys, n, masked, normalized (a year's worth of what isn't masked), one_off and over_masked.

    Series of at least two seasons are deseasonalised; values outside the Tukey fences or three deviations from the
    median are masked.
    """
    enough = F.count("*").over(Window.partitionBy(*keys)) >= 2 * season
    flat = seasonal(series, keys, ord_, value, season).withColumn("_v", F.when(enough, F.coalesce(F.try_divide(C(value), C("index")), C(value))).otherwise(C(value)))
    slack = 1e-9 * F.abs(C("median"))
    marked = flat.join(robust(flat, keys, "_v"), keys).withColumn("_out", (C("_v") < C("low") - slack) | (C("_v") > C("high") + slack) | ((C("mad") > 0) & (F.abs(C("_v") - C("median")) > 3 * C("mad") + slack)))
    sums = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_out").alias("masked"), F.avg(F.when(~C("_out"), C("_v"))).alias("_m"), F.sum(value).alias("actual"))
    return sums.select(*keys, "n", "masked", (C("_m") * season).alias("normalized"), (C("actual") * season / C("n") - C("_m") * season).alias("one_off"), (2 * C("masked") > C("n")).alias("over_masked"))


def log_mean(a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b) <= 1e-12 * F.greatest(F.abs(a), F.abs(b)), a).otherwise((a - b) / (F.ln(a) - F.ln(b)))


def lmdi(rate0: Column, volume0: Column, rate1: Column, volume1: Column) -> Column:
    """rate and volume effects that add up to the change; zero counts as 1e-20, negatives go the arithmetic way."""
    r0, v0, r1, v1 = (F.when(x == 0, 1e-20).otherwise(x) for x in (rate0, volume0, rate1, volume1))
    weight = log_mean(r1 * v1, r0 * v0)
    fine = F.least(rate0, volume0, rate1, volume1) >= 0
    rate = F.when(fine, weight * F.ln(r1 / r0)).otherwise((rate1 - rate0) * (volume0 + volume1) / 2)
    volume = F.when(fine, weight * F.ln(v1 / v0)).otherwise((volume1 - volume0) * (rate0 + rate1) / 2)
    return F.struct(rate.alias("rate"), volume.alias("volume"))


def stickiness(series: DataFrame, keys: list[str], ord_: str, cost: str, activity: str) -> DataFrame:
    """F16: mean log elasticity of cost on steps where activity rises and where it falls."""
    w = Window.partitionBy(*keys).orderBy(ord_)
    step = series.select(*keys, F.ln(F.when((C(cost) > 0) & (F.lag(cost).over(w) > 0), C(cost) / F.lag(cost).over(w))).alias("dc"), F.ln(F.when((C(activity) > 0) & (F.lag(activity).over(w) > 0), C(activity) / F.lag(activity).over(w))).alias("da"))
    e = F.try_divide("dc", "da")
    return step.filter("dc is not null and da is not null").groupBy(*keys).agg(F.avg(F.when(C("da") > 0, e)).alias("up"), F.avg(F.when(C("da") < 0, e)).alias("down"))


def lease_schedule(leases: DataFrame) -> DataFrame:
    """payments (lease, k, pay, rate) to liability, interest, principal and straight-line asset per period."""
    ahead = Window.partitionBy("lease").orderBy(F.desc("k"))
    whole = Window.partitionBy("lease")
    disc = leases.withColumn("_pv", F.sum(C("pay") / F.pow(1 + C("rate"), C("k"))).over(ahead))
    rows = disc.withColumn("opening", C("_pv") * F.pow(1 + C("rate"), C("k") - 1)).withColumn("interest", C("opening") * C("rate"))
    return rows.withColumns({"principal": C("pay") - C("interest"), "closing": C("opening") + C("interest") - C("pay"), "pv": F.max("_pv").over(whole), "rou_dep": F.max("_pv").over(whole) / F.count("*").over(whole)}).drop("_pv")


def allocate(weights: DataFrame, pool: str, ord_: str, weight: str, amount: str) -> DataFrame:
    """share of the pool's amount by weight; the last key takes the remainder; null where weights sum to nothing."""
    w, all_ = Window.partitionBy(pool).orderBy(ord_), Window.partitionBy(pool)
    total = F.sum(weight).over(all_)
    part = weights.withColumn("_s", F.when(total > 0, F.round(C(amount) * C(weight) / total, 2)))
    before = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.row_number().over(w) == F.count("*").over(all_)
    return part.withColumn("share", F.when(last & (total > 0), C(amount) - F.coalesce(before, F.lit(0.0))).otherwise(C("_s"))).drop("_s")


def discounted_ltv(margin: Column, churn: Column, rate: Column) -> Column:
    """F20."""
    return F.try_divide(margin * (1 + rate), churn + rate)
