"""What a workbook lost or changed between two snapshots of its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.normalize import ERRORS

C = F.col


def workbook_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sheet, row, col and finding. Cells: keys, sheet, row, col, text and formula (null unless a formula).

    SHEET_LOST (row and col null), instead of findings on its cells. CELL_LOST, CELL_CHANGED: of cells without a formula before.
    FORMULA_LOST: gone or a plain cell now. FORMULA_CHANGED. HEADER_CHANGED: a cell of the first row, besides. ERROR_NEW: an
    error literal where there was none. Nulls and blanks differ; added cells are no finding unless they stand in the header
    or are errors. One full join on the coordinate, one on sheets.
    """
    place = [*keys, "sheet", "row", "col"]
    a, b = (df.select(*place, F.coalesce("formula", "text").alias("_v"), C("formula").alias("_f"), F.lit(True).alias("_is")) for df in (before, after))
    both = a.join(b.select(*place, C("_v").alias("_w"), C("_f").alias("_g"), F.lit(True).alias("_there")), place, "full")
    sheets = [df.select(*keys, "sheet").distinct() for df in (before, after)]
    lost = sheets[0].join(sheets[1], [*keys, "sheet"], "left_anti")
    was, gone = C("_is").isNotNull(), C("_there").isNull()
    plain, differs = was & C("_f").isNull(), ~C("_v").eqNullSafe(C("_w"))
    new = F.trim("_w").isin(ERRORS) & ~F.coalesce(F.trim("_v").isin(ERRORS), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(plain & gone, "CELL_LOST"), F.when(plain & ~gone & differs, "CELL_CHANGED"),
        F.when(was & ~plain & C("_g").isNull(), "FORMULA_LOST"), F.when(was & ~plain & (C("_g") != C("_f")), "FORMULA_CHANGED"),
        F.when((C("row") == 1) & (differs | gone | ~was), "HEADER_CHANGED"), F.when(new, "ERROR_NEW"),
    ))
    rest = both.join(lost, [*keys, "sheet"], "left_anti").select(*place, F.explode(kinds).alias("finding"))
    whole = lost.select(*keys, "sheet", *(F.lit(None).cast(before.schema[c].dataType).alias(c) for c in ("row", "col")), F.lit("SHEET_LOST").alias("finding"))
    return rest.unionByName(whole)
