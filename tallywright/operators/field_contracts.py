"""Q20: contracts of figures as rows of a specs table, judged against label x field x value rows in one plan.

specs: field, kind, sign, low, high, inclusive, nullable, accepted (array<double>) and tie_total; all but field may be null.
A null sign is the kind's own, a null inclusive or nullable is true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.checks import tie_out
from tallywright.operators.lineage import small

C = F.col

# Kinds of fields whose figures may not be negative.
POSITIVE = ["quantity", "currency", "count"]

SPECS = "field string, kind string, sign string, low double, high double, inclusive boolean, nullable boolean, accepted array<double>, tie_total double"


def _reason() -> Column:
    """Why a figure breaks its contract, the first of its tests, or null."""
    sign = F.coalesce("sign", F.when(C("kind").isin(POSITIVE), "+").otherwise("any"))
    closed, v = F.coalesce("inclusive", F.lit(True)), C("value")
    under = F.when(closed, v < C("low")).otherwise(v <= C("low"))
    over = F.when(closed, v > C("high")).otherwise(v >= C("high"))
    return (
        F.when(v.isNull(), F.when(~F.coalesce("nullable", F.lit(True)), "NULL")).when(~F.array_contains("accepted", v), "NOT_ACCEPTED")
        .when(((sign == "+") & (v < 0)) | ((sign == "-") & (v > 0)), "SIGN").when(under, "LOW").when(over, "HIGH")
    )


def judge_fields(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """rows with status (OK, NO_DATA, VIOLATION) and reason. rows: field, value and any keys; fields without a spec go.

    Few fields hold all rows, so specs are sent to the rows, which stay where they are."""
    j = rows.join(small(specs), "field").withColumn("reason", _reason())
    status = F.when(C("reason").isNotNull(), "VIOLATION").when(C("value").isNull(), "NO_DATA").otherwise("OK")
    return j.withColumn("status", status).select(*rows.columns, "status", "reason")


def field_totals(rows: DataFrame, specs: DataFrame, tol: float = 0.5) -> DataFrame:
    """field, total, tie_total and ok of the specs that declare a total; a field without rows has a total of zero."""
    sums = rows.groupBy("field").agg(F.sum("value").alias("total"))
    j = specs.filter("tie_total is not null").select("field", "tie_total").join(sums, "field", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return j.select("field", "total", "tie_total", tie_out(C("total"), C("tie_total"), tol).alias("ok"))
