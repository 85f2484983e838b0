"""Contracts of inputs and outputs: required columns and types, blank keys, and the gate common to every output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.normalize import ERRORS
from tallywright.operators.checks import check, tie_out

C = F.col


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""


def shape_grain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Before anything is grouped, keys that repeat, and the number of rows with a null or blank key (keys null)."""
    bad = reduce(Column.__or__, [blank(C(k)) for k in keys])
    twice = rows.filter(~bad).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("reason", F.lit("DUPLICATE"))
    none = rows.filter(bad).agg(F.count("*").alias("n")).filter("n > 0")
    gone = none.select(*(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), "n", F.lit("MISSING_KEY").alias("reason"))
    return twice.unionByName(gone)


def required(rows: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    """Column, problem and n. A required column must be there and have a value; a typed one must parse where it has one.

    Null passes the type policy: that a value is there is the other rule's business.
    """
    lost = sorted({c for c in [*columns, *types] if c not in rows.columns})
    tests = [(c, "EMPTY", blank(C(c))) for c in columns if c not in lost]
    tests += [(c, "TYPE", ~blank(C(c)) & C(c).cast("string").try_cast(t).isNull()) for c, t in types.items() if c not in lost]
    counted = rows.agg(*(F.count_if(t).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)), F.lit(0).alias("none"))
    each = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), C(f"c{i}").cast("long").alias("n")) for i, (c, p, _) in enumerate(tests)]
    each += [F.struct(F.lit(c).alias("column"), F.lit("ABSENT").alias("problem"), F.lit(0).cast("long").alias("n")) for c in lost]
    return counted.select(F.inline(F.array(*each))).filter("n > 0 or problem = 'ABSENT'")


def base_gate(out: DataFrame, keys: list[str], value: str, reported: Column, raw: DataFrame, total: Column, ledger: DataFrame | None = None, surfaced: DataFrame | None = None, tol: float = 1e-6) -> DataFrame:
    """Checks common to every output: its grain is unique and whole, no cell holds an error literal, its total is what the
    raw table gives anew, and findings of the ledger (anomaly_type) all come out."""
    bad = reduce(Column.__or__, [blank(C(k)) for k in keys])
    g = out.groupBy(*keys).agg(F.count("*").alias("n"), F.max(bad).alias("bad")).agg(F.count_if((C("n") > 1) | C("bad")).alias("x"))
    checks = [g.select(*check("grain", C("x") == 0, C("x")))]
    texts = [f.name for f in out.schema if f.dataType.simpleString() == "string"]
    wrong = reduce(Column.__or__, [F.coalesce(F.trim(c).isin(ERRORS), F.lit(False)) for c in texts], F.lit(False))
    checks.append(out.agg(F.count_if(wrong).alias("x")).select(*check("error_literals", C("x") == 0, C("x"))))
    sums = out.agg(reported.cast("double").alias("a")).crossJoin(raw.agg(total.cast("double").alias("b")))
    checks.append(sums.select(*check(f"conserved:{value}", tie_out(C("a"), C("b"), tol), F.round(C("a") - C("b"), 2))))
    if ledger is not None and surfaced is not None:
        both = ledger.agg(F.count("*").alias("a")).crossJoin(surfaced.agg(F.count("*").alias("b")))
        checks.append(both.select(*check("ledger", C("a") == C("b"), F.concat_ws("/", "a", "b"))))
    return reduce(DataFrame.unionByName, checks)
