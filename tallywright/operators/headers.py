"""Header bands of blocks: bands over a gap, repeated rows, bands that later segments share, and doubtful ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import normalize as n
from tallywright.operators.grid import SHEET, TILE, cell_type, filled, tiles

C = F.col
BLOCK = [*SHEET, "block_id"]


def absorb_bands(cells: DataFrame, found: DataFrame, gap: int = 4, most: int = 6) -> DataFrame:
    """Blocks that reach up over rows of headings, across at most `gap` blank rows each.

    A row joins if it fills a third of the block's columns (three at least) and is at most half numbers. Up to `most`
    loose rows join; rows of another block join while they are headings, and that block goes. Only the rows within
    reach of a block meet it.
    """
    reach = most * (gap + 1)
    numeric = cell_type(C("value_str")).isin("numeric", "date").cast("int")
    c = filled(cells).select(*SHEET, "row", "col", numeric.alias("_v"))
    inside = C("col").between(C("c0"), C("c1"))
    above = tiles(found.select(*BLOCK, "c0", "c1", (C("r0") - reach).alias("r0"), (C("r0") - 1).alias("r1")))
    near = c.withColumn("_tile", F.floor(C("row") / TILE)).join(above.hint("merge"), [*SHEET, "_tile"]).filter("row between r0 and r1").withColumn("r0", C("r1") + 1).drop("_tile", "r1")
    rows = near.groupBy(*BLOCK, "r0", "c0", "c1", "row").agg(F.count_if(inside).alias("_k"), F.sum(F.when(inside, C("_v")).otherwise(0)).alias("_n"))
    owner = found.select(*SHEET, C("block_id").alias("_owner"), C("r0").alias("_o0"), C("r1").alias("_o1"))
    owner = tiles(owner.withColumnsRenamed({"_o0": "r0", "_o1": "r1"})).withColumnsRenamed({"r0": "_o0", "r1": "_o1"})
    owned = rows.withColumn("_tile", F.floor(C("row") / TILE)).join(owner.hint("merge"), [*SHEET, "_tile"]).filter((C("row").between(C("_o0"), C("_o1"))) & (C("_owner") != C("block_id")))
    rows = rows.join(owned.groupBy(*BLOCK, "row").agg(F.min("_owner").alias("_owner")).hint("merge"), [*BLOCK, "row"], "left")
    up = Window.partitionBy(*BLOCK).orderBy(F.desc("row"))
    blank = F.coalesce(F.lag("row").over(up), C("r0")) - C("row") - 1
    first = F.first("_owner", True).over(up)
    heading = (C("_k") >= F.greatest(F.lit(3), F.floor((C("c1") - C("c0") + 1) / 3))) & (C("_n") <= 0.5 * C("_k"))
    placed = F.when(first.isNull(), F.row_number().over(up) <= most).otherwise(F.coalesce(C("_owner") == first, F.lit(False)))
    joins = rows.withColumn("_ok", heading & placed & (blank <= gap)).withColumn("_ok", F.min("_ok").over(up)).filter("_ok")
    top = joins.groupBy(*BLOCK).agg(F.min("row").alias("_top"))
    gone = joins.filter("_owner is not null").select(*SHEET, C("_owner").alias("block_id")).distinct()
    return found.join(top.hint("merge"), BLOCK, "left").withColumn("r0", F.coalesce("_top", "r0")).drop("_top").join(gone.hint("merge"), BLOCK, "left_anti").select(found.columns)


def drop_repeated(body: DataFrame) -> DataFrame:
    """Rows below the header that say the same as one of its rows, without a number, go."""
    number = cell_type(C("value_str")) == "numeric"
    text = F.when(~number, F.struct("col", F.lower(F.regexp_replace("value_str", r"\s+", "")).alias("t")))
    rows = body.groupBy(*BLOCK, "row").agg(F.sort_array(F.collect_list(text)).alias("_s"), F.max(number).alias("_v"), F.max("header_end").alias("_h")).filter(F.size("_s") > 0)
    again = rows.filter("row > _h and not _v").join(rows.filter("row <= _h").select(*BLOCK, "_s").distinct().hint("merge"), [*BLOCK, "_s"], "left_semi")
    return body.join(again.select(*BLOCK, "row").hint("merge"), [*BLOCK, "row"], "left_anti")


def propagate(found: DataFrame) -> DataFrame:
    """The block whose header a block without one takes: the last above it with headers, if columns overlap.

    found: blocks with has_header. Null where there is none, or the block has its own.
    """
    w = Window.partitionBy(*SHEET).orderBy("r0", "block_id")
    h = F.last(F.when(C("has_header"), F.struct("block_id", "c0", "c1")), True).over(w)
    overlap = (C("_h.c0") <= C("c1")) & (C("_h.c1") >= C("c0"))
    return found.withColumn("_h", h).withColumn("header_from", F.when(~C("has_header") & overlap, C("_h.block_id"))).drop("_h")


def suspect_no_header(body: DataFrame) -> DataFrame:
    """Blocks whose last header row has numbers and, in half the columns, the types of the first data row."""
    c = body.filter("row in (header_end, header_end + 1)").withColumn("_t", cell_type(C("value_str")))
    of = lambda row: F.max(F.when(C("row") == row, C("_t")))
    cols = c.groupBy(*BLOCK, "col").agg(of(C("header_end")).alias("h"), of(C("header_end") + 1).alias("d"))
    g = cols.groupBy(*BLOCK).agg(F.avg(F.coalesce(C("h") == C("d"), F.lit(False)).cast("int")).alias("same"), F.max(F.coalesce(C("h").isin("numeric", "date"), F.lit(False))).alias("numbers"))
    return g.filter("numbers and same >= 0.5").select(*BLOCK)


def repeated_keys(body: DataFrame) -> DataFrame:
    """Header texts that more than one column of a header row has once footnote marks are gone."""
    h = body.filter("row <= header_end and col > label_end").select(*BLOCK, "row", "col", n.strip_footnote(C("value_str")).alias("key"))
    return h.groupBy(*BLOCK, "row", "key").agg(F.countDistinct("col").alias("columns")).filter("columns > 1")
