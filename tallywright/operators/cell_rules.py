"""Contracts of workbooks as rows of a rules table, judged by one plan over all cells.

cells: sheet, row, col, value (double, null unless a number), text (the cell as text) and formula (null unless a formula).
rules: rule (an id of its own), kind, sheet, r0, r1, c0, c1 and the columns that the kind reads; the others may be null:

- tie: the cell is `expected`, and the sum of the numbers of the `parts` rectangle, where either is given (within `tol`, 0.5).
  A formula in the cell must be a SUM over the parts, whose place in letters is `parts_ref`.
- grain: no text stands twice. expected_n: `n` cells aren't empty.
- ratio: the cell is `num` over `den` (within `tol`, 0.01, or that share); over zero or nothing it may be neither number nor error.
- guard: a formula has ISNUMBER, IFERROR or IFNA; another cell is no error.
- field: numbers keep to `sign` (1 or -1), `low` and `high`; cells that aren't formulas to the list `accepted`.
- scenario: the texts here are those of `parts`.
- formula_refs: each formula is `left`, row, `op`, `right`, row.
- units: the decades of the numbers that aren't zero differ by less than three.
- periods: the texts in order of rows and columns are the list `ruler`, none left out or over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.normalize import ERRORS
from tallywright.operators.grid import within

C = F.col

RECTANGLE = "struct<sheet:string,r0:long,r1:long,c0:long,c1:long>"

#: The columns of a rules table.
RULES = (
    f"rule string, kind string, sheet string, r0 long, r1 long, c0 long, c1 long, expected double, tol double, parts {RECTANGLE}, parts_ref string, "
    f"num {RECTANGLE}, den {RECTANGLE}, n long, sign int, low double, high double, accepted array<string>, left string, op string, right string, ruler array<string>"
)


def _places(rules: DataFrame) -> DataFrame:
    """A row per rule and rectangle that it reads: rule, role (own, parts, num or den) and the rectangle."""
    own = F.struct(F.lit("own").alias("role"), *(C(c).cast("string" if c == "sheet" else "long").alias(c) for c in ("sheet", "r0", "r1", "c0", "c1")))
    others = [F.struct(F.lit(p).alias("role"), *(C(p)[c].alias(c) for c in ("sheet", "r0", "r1", "c0", "c1"))) for p in ("parts", "num", "den")]
    return rules.select("rule", F.inline(F.array(own, *others))).filter("r0 is not null")


def judge(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, kind, ok and bad (how many cells, texts or conditions fail) of every rule.

    A rule on a sheet without cells fails if it is a tie; else it isn't judged (ok null). Cells meet the rectangles by tiles,
    and texts are counted per rule before they are brought together, so a large region is never one task's.
    """
    place = _places(rules)
    at = within(cells.withColumn("sheet", C("sheet").cast("string")).select("sheet", "row", "col", "value", "text", "formula"), place, ["sheet"])
    wanted = rules.select("rule", "kind", "sign", "low", "high", "accepted", "left", "op", "right", "ruler")
    j = at.join(wanted, "rule")
    own, plain = C("role") == "own", C("formula").isNull()
    filled = plain & C("text").isNotNull() & (F.trim("text") != "")
    label = F.when(filled & C("value").isNull() & C("kind").isin("grain", "scenario"), C("text"))
    want = F.concat(F.lit("="), F.upper("left"), C("row").cast("string"), C("op"), F.upper("right"), C("row").cast("string"))
    crossed = ~plain & (F.upper(F.regexp_replace("formula", r"[$\s]", "")) != want)
    number = plain & C("value").isNotNull()
    broken = number & ((F.signum("value") == -C("sign")) | (C("value") < C("low")) | (C("value") > C("high")))
    strange = plain & C("text").isNotNull() & ~F.array_contains("accepted", C("text"))
    index = (C("row") - C("r0")) * (C("c1") - C("c0") + 1) + C("col") - C("c0")
    decade = F.when(number & (C("value") != 0), F.floor(F.log10(F.abs("value"))))
    true = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    first = j.groupBy("rule", label.alias("_label")).agg(
        F.sum(F.when((C("role") == "parts") & number, C("value"))).alias("parts"), F.count_if(own).alias("here"), F.count_if(C("role") == "parts").alias("there"),
        *(F.max(F.when((C("role") == r) & number, C("value"))).alias(f"v_{r}") for r in ("own", "num", "den")),
        F.max(F.when(own, C("formula"))).alias("f"), F.max(F.when(own & plain, C("text"))).alias("t"), F.count_if(own & (filled | ~plain)).alias("filled"),
        true(own & broken).alias("broken"), true(own & strange).alias("strange"), true(own & crossed).alias("crossed"),
        F.min(F.when(own, decade)).alias("low_"), F.max(F.when(own, decade)).alias("high_"), true(own & (F.get("ruler", index.cast("int")) == C("text"))).alias("met"),
        true(own & ~plain & ~F.upper("formula").rlike("ISNUMBER|IFERROR|IFNA")).alias("unguarded"), true(own & plain & F.trim("text").isin(ERRORS)).alias("errors"),
    )
    named = C("_label").isNotNull()
    g = first.groupBy("rule").agg(
        *(F.sum(c).alias(c) for c in ("parts", "filled", "broken", "strange", "crossed", "met", "unguarded", "errors")),
        *(F.max(c).alias(c) for c in ("v_own", "v_num", "v_den", "f", "t", "high_")), F.min("low_").alias("low_"),
        F.count_if(named & (C("here") > 1)).alias("twice"), F.count_if(named & ((C("here") == 0) != (C("there") == 0))).alias("apart"),
    ).withColumnsRenamed({"parts": "sum_parts"})
    known = cells.select(C("sheet").cast("string").alias("sheet")).distinct().withColumn("_known", F.lit(True))
    all_ = rules.join(g, "rule", "left").join(known, "sheet", "left")
    bad = F.coalesce(_bad(), F.lit(0)).cast("long")
    bad = F.when(C("_known").isNotNull(), bad).when(C("kind") == "tie", F.lit(1).cast("long"))
    return all_.select("rule", "kind", (bad == 0).alias("ok"), bad.alias("bad"))


def _bad() -> Column:
    """How many conditions of a rule fail, from what its rectangles hold."""
    zero = lambda c: F.coalesce(C(c), F.lit(0))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    tol, summed = F.coalesce("tol", F.lit(0.5)), F.coalesce("sum_parts", F.lit(0.0))
    is_number, has_formula = C("v_own").isNotNull() & C("f").isNull(), C("f").isNotNull()
    flat = F.upper(F.regexp_replace("f", r"[\s$]", ""))
    covers = F.contains(flat, F.lit("SUM(")) & F.contains(flat, F.upper(F.regexp_replace("parts_ref", r"[\s$]", "")))
    declared, given = C("parts").isNotNull(), C("expected").isNotNull()
    tie = one(given & ~is_number) + one(given & is_number & (F.abs(C("v_own") - C("expected")) > tol))
    tie = tie + one(declared & has_formula & ~F.coalesce(covers, F.lit(False))) + one(declared & is_number & (F.abs(summed - C("v_own")) > tol))
    tie = tie + one(declared & ~given & ~is_number & ~has_formula)
    near, rate = F.coalesce("tol", F.lit(0.01)), F.try_divide("v_num", "v_den")
    no_den = C("v_den").isNull() | (C("v_den") == 0)
    off = one(is_number & (F.abs(C("v_own") - rate) > F.greatest(near, F.abs(rate) * near))) + one(~is_number)
    ratio = F.when(no_den, one(is_number | F.trim("t").isin(ERRORS))).when(C("v_num").isNotNull(), off)
    by_kind = {
        "tie": tie, "grain": zero("twice"), "ratio": ratio, "guard": zero("unguarded") + zero("errors"), "field": zero("broken") + zero("strange"),
        "scenario": zero("apart"), "expected_n": F.abs(zero("filled") - C("n")), "formula_refs": zero("crossed"), "units": one(C("high_") - C("low_") >= 3),
        "periods": F.greatest(F.size("ruler"), ((C("r1") - C("r0") + 1) * (C("c1") - C("c0") + 1)).cast("int")) - zero("met"),
    }
    return reduce(lambda a, kv: a.when(C("kind") == kv[0], kv[1]), by_kind.items(), F.when(F.lit(False), 0))


def coverage(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """sheet, row, col and warning: numbers that look like totals (bold under a border: columns bold, top_border) without a tie,
    and formulas that divide without a rule on their ratio. A division sign within a text or a sheet's name is none."""
    outside = F.regexp_replace("formula", r"""("(?:[^"]|"")*"|'(?:[^']|'')*')""", "")
    seen = F.when(C("bold") & C("top_border") & C("value").isNotNull() & C("formula").isNull(), "TOTAL_WITHOUT_TIE")
    found = cells.withColumn("sheet", C("sheet").cast("string")).withColumn("warning", F.coalesce(F.when(F.contains(outside, F.lit("/")), "DIVISION_WITHOUT_RATIO"), seen))
    told = F.when(C("kind") == "tie", "TOTAL_WITHOUT_TIE").when(C("kind").isin("ratio", "guard"), "DIVISION_WITHOUT_RATIO")
    covered = rules.select(C("sheet").cast("string").alias("sheet"), C("r0").alias("row"), C("c0").alias("col"), told.alias("warning"))
    return found.filter("warning is not null").select("sheet", "row", "col", "warning").join(covered.distinct(), ["sheet", "row", "col", "warning"], "left_anti")
