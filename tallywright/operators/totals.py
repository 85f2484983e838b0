"""Subtotals of tidy rows, alarms and summaries of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.normalize import SENTINELS
from tallywright.operators.grid import children, is_subtotal

C = F.col


def score_subtotals(rows: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """Rows with label, bold, value; a score of label, bold and arithmetic, and the role from two signals on.

    Arithmetic: the value is the sum of the other rows of its keys whose label isn't a subtotal's. Sums are made per
    key and joined back, so a hot key is aggregated before it is shuffled.
    """
    label = F.coalesce(is_subtotal(C("label")), F.lit(False))
    sums = rows.groupBy(*keys).agg(F.sum(F.when(~label, C("value"))).alias("_s"), F.count(F.when(~label, C("value"))).alias("_k"), F.count("value").alias("_n"))
    own = F.when(label, 0.0).otherwise(C("value"))
    others = C("_k") - (~label).cast("int")
    sums_up = (C("_n") >= 2) & (others >= 1) & (F.abs(C("value") - (C("_s") - own)) <= tol * (F.abs("value") + 1))
    score = label.cast("int") + F.coalesce(C("bold"), F.lit(False)).cast("int") + F.coalesce(sums_up, F.lit(False)).cast("int")
    j = rows.join(sums.hint("merge"), keys, "left").withColumn("score", score)
    return j.withColumn("row_role", F.when(C("score") >= 2, "subtotal").otherwise(C("row_role"))).drop("_s", "_k", "_n")


def subtotal_mismatches(rows: DataFrame, keys: list[str], absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """Subtotals with two or more deeper rows below that don't add up to them."""
    c = children(rows, keys).filter((C("row_role") == "subtotal") & (C("n_children") >= 2) & C("value").isNotNull())
    return c.filter(F.abs(C("value") - C("child_sum")) > F.greatest(F.lit(absolute), relative * (F.abs("value") + F.abs("child_sum"))))


def reject_alarm(judged: DataFrame, by: list[str], tried: int = 50, share: float = 0.2) -> DataFrame:
    """Workbooks of at least `tried` rows of which less than the share was kept. judged: reasons."""
    g = judged.groupBy(*by).agg(F.count("*").alias("tried"), F.count_if(F.size("reasons") == 0).alias("kept"))
    return g.filter((C("tried") >= tried) & (C("kept") < share * C("tried")))


def summary(judged: DataFrame, recon: DataFrame, by: list[str]) -> DataFrame:
    """Blocks, kept and rejected rows and covered and other coordinates of each workbook."""
    a = judged.groupBy(*by).agg(F.countDistinct("sheet", "block_id").alias("blocks"), F.count_if(F.size("reasons") == 0).alias("kept"), F.count_if(F.size("reasons") > 0).alias("rejected"))
    covered = C("status").isin("covered", "scaled")
    b = recon.groupBy(*by).agg(F.count_if(covered).alias("covered"), F.count_if(~covered).alias("uncovered"))
    return a.join(b, by, "full").fillna(0)


def invariants(judged: DataFrame, recon: DataFrame) -> DataFrame:
    """Counts of what must be zero in an ingest's output, and whether single numeric metrics are most of it."""
    data = judged.filter("row_role = 'data'")
    bad = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    leak = F.greatest(*(F.coalesce(F.lower(F.trim(c)).isin(SENTINELS), F.lit(False)) for c in ("entity", "metric", "period")))
    one = data.agg(bad("entity").alias("no_entity"), bad("period").alias("no_period"), F.count_if(C("metric").isNull()).alias("no_metric"), F.count_if(leak).alias("leaks"), F.count("*").alias("n"))
    single = data.groupBy("metric").agg(F.count("*").alias("k")).filter((C("k") == 1) & C("metric").rlike(r"^[-+]?[\d,.]+$")).agg(F.count("*").alias("single"))
    rejected = judged.agg(F.count_if(F.size("reasons") > 0).alias("rejected"))
    recon_bad = recon.agg(F.count_if(~C("status").isin("covered", "scaled", "extra")).alias("unreconciled"))
    out = one.crossJoin(single).crossJoin(rejected).crossJoin(recon_bad).withColumn("value_leak", C("single") > 0.5 * C("n"))
    zero = C("no_entity") + C("no_period") + C("no_metric") + C("leaks") + C("rejected") + C("unreconciled") == 0
    return out.withColumn("ok", zero & ~C("value_leak")).drop("single", "n")


def accuracy(rows: DataFrame, expected: DataFrame, keys: list[str], tol: float = 0.5) -> DataFrame:
    """Share of expected(keys, want) that the rows give within the tolerance."""
    got = rows.groupBy(*keys).agg(F.max("value").alias("_v"))
    hit = F.coalesce(F.abs(C("_v") - C("want")) <= tol, F.lit(False))
    return expected.join(got, keys, "left").agg(F.count("*").alias("expected"), F.count_if(hit).alias("hits")).withColumn("accuracy", F.try_divide("hits", "expected"))
