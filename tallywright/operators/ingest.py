"""The whole way from cells to tidy facts, with header bands, repeated and shared headers, subtotals and their mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators import grid, headers, totals
from tallywright.operators.lineage import settle

C = F.col
# Whole names of sheets that hold no data.
META = [
    "introduction", "intro", "content", "contents", "table of contents", "toc", "note", "notes", "information", "info", "correction", "corrections",
    "cover", "about", "index", "metadata", "meta", "foreword", "preface", "readme", "legend", "definition", "definitions", "glossary", "source",
    "sources", "목차", "안내", "일러두기", "표지", "개요", "유의사항", "주석", "설명", "범례", "용어",
]


def with_data(cells: DataFrame) -> DataFrame:
    """Sheets whose whole name says that they hold no data are left out."""
    return cells.filter(~F.lower(F.trim("sheet")).isin(META))


def share_headers(body: DataFrame) -> DataFrame:
    """Blocks without a header get the header cells of the block that they take it from. body: classified cells."""
    spans = body.groupBy(*headers.BLOCK).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.max("header_end").alias("header_end"), F.max("label_end").alias("label_end"))
    takes = headers.propagate(spans.withColumn("has_header", C("header_end") >= C("r0"))).filter("header_from is not null")
    takes = takes.select(*grid.SHEET, C("block_id").alias("_to"), C("header_from").alias("block_id"), C("header_end").alias("_h"), C("label_end").alias("_l"))
    lent = body.filter("row <= header_end").join(takes.hint("merge"), headers.BLOCK)
    lent = lent.withColumns({"block_id": C("_to"), "header_end": C("_h"), "label_end": C("_l")}).select(body.columns)
    return body.unionByName(lent)


def ingest(cells: DataFrame) -> DataFrame:
    """Tidy rows of all sheets with data. Subtotals have two of three signals: label, bold type and arithmetic; one that its
    deeper rows don't add up to is flagged SUBTOTAL_ARITH_MISMATCH."""
    full = settle(grid.filled(grid.unmerge(with_data(cells))))
    found = settle(headers.absorb_bands(full, settle(grid.blocks(full))))
    body = settle(grid.classify(settle(grid.strip_titles(settle(grid.in_blocks(full, found))))))
    rows = settle(grid.tidy(grid.unpivot(settle(headers.drop_repeated(share_headers(body))))))
    labelled = rows.withColumns({"label": F.coalesce("entity", F.lit("")), "bold": C("label_bold"), "_p": F.coalesce("period", F.lit("")), "_m": F.coalesce("metric", F.lit(""))})
    scored = settle(totals.score_subtotals(labelled, [*headers.BLOCK, "_p", "_m"]).drop("label", "bold", "score"))
    wrong = totals.subtotal_mismatches(scored, [*headers.BLOCK, "_p", "_m"]).select(*headers.BLOCK, "src_row", "src_col", F.lit(True).alias("_w"))
    marked = scored.join(wrong.hint("merge"), [*headers.BLOCK, "src_row", "src_col"], "left")
    flags = F.when(C("_w"), F.concat("flags", F.array(F.lit("SUBTOTAL_ARITH_MISMATCH")))).otherwise(C("flags"))
    return marked.withColumn("flags", flags).select(rows.columns)
