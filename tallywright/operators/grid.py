"""Grids of cells to tidy facts, for many workbooks at once.

cells: workbook, sheet, row, col, value_str (text as shown), bold, merge_row, merge_col, and where known font_rgb and
number_format. All work is keyed by workbook
and sheet, so a cluster spreads over sheets. Cells may come out of a small file, by which Spark takes them for few: they are dealt
out by sheet first, and joins are merges by hint, so that no side goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import normalize as n
from tallywright.operators.components import components
from tallywright.operators.lineage import settle

C = F.col
SHEET = ["workbook", "sheet"]
# Font colours that mark a loss, and words that mark subtotals and totals.
RED = ["FF0000", "C00000"]
SUBTOTALS = ["합계", "합 계", "소계", "소 계", "총계", "총 계", "누계", "계", "total", "subtotal", "grand total", "sum"]
#: An own addition.
MORE_SUBTOTALS = ["sub-total"]
#: Rows of a tile, by which cells and rectangles meet.
TILE = 64


def filled(cells: DataFrame) -> DataFrame:
    """Cells that aren't blank, inside the sheet's extent."""
    return cells.filter("value_str is not null and trim(value_str) <> ''")


def cell_type(x: Column) -> Column:
    """S2."""
    t = F.trim(x)
    kinds = F.create_map(*map(F.lit, ("DATE", "date", "NUM", "numeric", "PCT", "numeric")))
    return F.when(x.isNull() | (t == ""), "blank").when(t.isin(n.ERRORS), "error").when(F.lower(t).isin("true", "false"), "logical").otherwise(F.coalesce(F.try_element_at(kinds, n.value_kind(x)), F.lit("character")))


def oversize(cells: DataFrame, cap: int = 3_000_000) -> DataFrame:
    """Sheets whose extent is over the cap."""
    return cells.groupBy(*SHEET).agg((F.max("row").cast("long") * F.max("col")).alias("area")).filter(C("area") > cap)


def unmerge(cells: DataFrame) -> DataFrame:
    """S3, B1: blank cells of a merged range take the value of its anchor."""
    anchor = cells.select(*SHEET, C("row").alias("merge_row"), C("col").alias("merge_col"), C("value_str").alias("_a"))
    j = cells.repartition(*SHEET).join(anchor.hint("merge"), [*SHEET, "merge_row", "merge_col"], "left")
    return j.withColumn("value_str", F.when(F.coalesce(F.trim("value_str"), F.lit("")) == "", C("_a")).otherwise(C("value_str"))).drop("_a").select(cells.columns)


def row_runs(cells: DataFrame) -> DataFrame:
    """Unbroken runs of filled cells within a row."""
    w = Window.partitionBy(*SHEET, "row").orderBy("col")
    return filled(cells).withColumn("_g", C("col") - F.row_number().over(w)).groupBy(*SHEET, "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n")).drop("_g")


def blocks(cells: DataFrame) -> DataFrame:
    """B2: bounding boxes of connected cells (eight neighbours) of at least two columns, three rows and enough density: 55 % of
    the cells filled, or nine rows of ten with a column that half the rows fill.

    Runs that start in one column of consecutive rows touch and are one strip; touching strips are edges, and their
    components are found in rounds until nothing changes.
    """
    w = Window.partitionBy(*SHEET, "c0").orderBy("row")
    runs = row_runs(cells).withColumn("_g", C("row") - F.row_number().over(w))
    runs = settle(runs.withColumn("id", F.xxhash64(*SHEET, "c0", "_g")).drop("_g"))
    up = runs.select(*SHEET, (C("row") + 1).alias("row"), C("c0").alias("u0"), C("c1").alias("u1"), C("id").alias("up"))
    edge = runs.join(up.hint("merge"), [*SHEET, "row"]).filter("u0 <= c1 + 1 and u1 >= c0 - 1 and id <> up").select(C("id").alias("a"), C("up").alias("b"))
    root = components(edge).select(C("node").alias("id"), "root")
    label = runs.select("id").distinct().join(root.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
    placed = runs.join(label.hint("merge"), "id")
    column = placed.select(*SHEET, C("label").alias("block_id"), F.explode(F.sequence("c0", "c1")).alias("col")).groupBy(*SHEET, "block_id", "col").agg(F.count("*").alias("k"))
    fullest = column.groupBy(*SHEET, "block_id").agg(F.max("k").alias("fullest"))
    box = placed.groupBy(*SHEET, C("label").alias("block_id")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("n").alias("n"), F.countDistinct("row").alias("rows"))
    box = box.join(fullest.hint("merge"), [*SHEET, "block_id"])
    tall = C("r1") - C("r0") + 1
    area = (C("r1") - C("r0") + 1) * (C("c1") - C("c0") + 1)
    return box.filter((C("c1") > C("c0")) & (C("r1") - C("r0") >= 2) & ((C("n") / area >= 0.55) | (C("rows") / tall >= 0.9) & (C("fullest") >= 0.5 * tall))).drop("n", "rows", "fullest")


def in_blocks(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells with their block."""
    return within(cells, found, SHEET)


def tiles(rectangles: DataFrame, tile: int = TILE) -> DataFrame:
    """rectangles (r0, r1) with a row for each tile of rows that they reach into."""
    return rectangles.withColumn("_tile", F.explode(F.sequence(F.floor(C("r0") / tile), F.floor(C("r1") / tile))))


def within(cells: DataFrame, rectangles: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Cells with the rectangles (r0, r1, c0, c1) of their keys that they lie in.

    Both sides are cut into tiles of rows and meet by an equi-join on keys and tile, so that a cell meets the rectangles
    near it and not all of its sheet. A tile doesn't hold more cells than its rows and columns, so no key is hot.
    """
    dealt = cells.withColumn("_tile", F.floor(C("row") / tile))
    return dealt.join(tiles(rectangles, tile).hint("merge"), [*keys, "_tile"]).filter("row between r0 and r1 and col between c0 and c1").drop("_tile")


def value_like(x: Column) -> Column:
    """Numbers, per cents, dates and errors, but not plain years."""
    return n.value_kind(x).isin("NUM", "PCT", "DATE") & ~F.trim(x).rlike(r"^(19|20)\d{2}$") | F.trim(x).isin(n.ERRORS)


def strip_titles(placed: DataFrame) -> DataFrame:
    """Title rows above (at most two cells, no value) and note rows below go; `unit` is what a title says."""
    key = [*SHEET, "block_id"]
    row = placed.groupBy(*key, "row").agg(F.count("*").alias("k"), F.max(value_like(C("value_str"))).alias("v"), F.max("value_str").alias("t"), F.max(C("c1") - C("c0")).alias("wide"))
    down, back = Window.partitionBy(*key).orderBy("row"), Window.partitionBy(*key).orderBy(F.desc("row"))
    title = (C("k") <= 2) & ~C("v") & (C("wide") >= 2)
    note = (C("k") == 1) & ~C("v")
    marked = row.withColumn("_t", F.min(title).over(down)).withColumn("_n", F.min(note).over(back))
    unit = marked.filter("_t").groupBy(*key).agg(F.max(F.regexp_extract("t", r"단위\s*[:：]\s*([^)]+)", 1)).alias("unit"))
    keep = marked.filter("not _t and not _n").select(*key, "row")
    return placed.join(keep.hint("merge"), [*key, "row"]).join(unit.hint("merge"), key, "left")


# Texts that stand for a missing figure and take its place in the grid.
DATA_SENTINELS = ["-", "–", "—", "...", "…", "N/A", "n/a", "na", "X", "x", "."]


def value_slots(body: DataFrame) -> DataFrame:
    """Body with `_v`, whether a cell holds a figure or a figure's place, and `_main`, whether figures are more than
    texts in its column.

    Figures are numbers, per cents, dates, errors, lone missing marks and numbers in cells formatted as text. A whole number
    from 1900 to 2099 is a figure too, if figures dominate its column and one stands above it or in its row; two or more such
    in a row without a figure are a header of years, and in cells formatted as text they are labels.
    """
    key = [*SHEET, "block_id"]
    t = F.trim("value_str")
    as_text = F.coalesce(C("number_format") == "@", F.lit(False)) if "number_format" in body.columns else F.lit(False)
    year = t.rlike(r"^(19|20)\d{2}$")
    figure = value_like(C("value_str")) | as_text & ~year & t.rlike(r"^-?\d[\d,]*\.?\d*$")
    marked = body.withColumns({"_f": F.coalesce(figure, F.lit(False)), "_y": F.coalesce(year & ~as_text, F.lit(False))})
    marked = marked.withColumn("_s", C("_f") | F.coalesce(t.isin(DATA_SENTINELS), F.lit(False)))
    main = marked.groupBy(*key, "col").agg((F.count_if("_s") > F.count_if(~C("_s") & ~C("_y"))).alias("_main"))
    row = Window.partitionBy(*key, "row")
    above = Window.partitionBy(*key, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumns({"_r": F.max("_f").over(row), "_a": F.coalesce(F.max("_f").over(above), F.lit(False))}).join(main.hint("merge"), [*key, "col"])
    return seen.withColumn("_v", C("_s") | C("_y") & C("_main") & C("_r") | C("_y") & C("_main") & C("_a") & (F.count_if("_y").over(row) < 2)).drop("_f", "_y", "_s", "_r", "_a")


def classify(body: DataFrame) -> DataFrame:
    """Adds header_end (last header row) and label_end (last label column) of each block.

    Rows are judged from the first column on that figures dominate, or from the second where none is, so that many label
    columns don't outweigh few figures.
    """
    key = [*SHEET, "block_id"]
    judged = value_slots(body)
    v = C("_v").cast("int")
    first = judged.groupBy(*key).agg(F.coalesce(F.min(F.when(C("_main") & (C("col") > C("c0")), C("col"))), F.min("c0") + 1).alias("_first"))
    judged = settle(judged.join(first.hint("merge"), key))
    rows = judged.groupBy(*key, "row").agg(F.avg(F.when(C("col") >= C("_first"), v)).alias("f"))
    w = Window.partitionBy(*key).orderBy("row")
    start = rows.withColumn("ok", (C("f") >= 0.5) & (F.coalesce(F.lead("f").over(w), C("f")) >= 0.5)).filter("ok").groupBy(*key).agg((F.min("row") - 1).alias("header_end"))
    b = judged.join(start.hint("merge"), key)
    cols = b.filter("row > header_end").groupBy(*key, "col").agg(F.avg(v).alias("f")).filter("f >= 0.5").groupBy(*key).agg((F.min("col") - 1).alias("label_end"))
    return b.join(cols.hint("merge"), key).drop("_v", "_main", "_first")


def _corner(data: DataFrame, heads: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """keys, row, col of data with `_hrow`, `_hcol`: of the headers at or left of the column and above the row, the rightmost
    column's lowest. Two ordered passes: the last column along a row that has a header above it, then the last of its
    headers down that column."""
    at = data.select(*keys, C(row).alias("_r"), C(col).alias("_c")).distinct()
    tops = heads.groupBy(*keys, C(col).alias("_c")).agg(F.min(row).alias("_top"))
    begun = at.select(*keys, "_r").distinct().join(tops, keys).filter("_top < _r").select(*keys, "_r", "_c", C("_c").alias("_hcol"), F.lit(0).alias("_o"))
    along = Window.partitionBy(*keys, "_r").orderBy("_c", "_o")
    asked = at.select(*keys, "_r", "_c", F.lit(None).cast(heads.schema[col].dataType).alias("_hcol"), F.lit(1).alias("_o"))
    found = begun.unionByName(asked).withColumn("_hcol", F.last("_hcol", True).over(along)).filter("_o = 1").drop("_o")
    marks = heads.select(*keys, C(col).alias("_hcol"), C(row).alias("_r"), C(row).alias("_hrow")).distinct().withColumns({"_c": F.lit(None).cast(heads.schema[col].dataType), "_o": F.lit(1)})
    down = Window.partitionBy(*keys, "_hcol").orderBy("_r", "_o")
    asked = found.withColumns({"_hrow": F.lit(None).cast(heads.schema[row].dataType), "_o": F.lit(0)})
    out = marks.unionByName(asked).withColumn("_hrow", F.last("_hrow", True).over(down)).filter("_o = 0")
    return out.filter("_hrow is not null").select(*keys, C("_r").alias(row), C("_c").alias(col), "_hrow", "_hcol")


def nearest_header(data: DataFrame, heads: DataFrame, direction: str, keys: list[str]) -> DataFrame:
    """Data (keys, row, col) with hrow and hcol of the nearest header of heads (keys, row, col), or null.

    up and left: the last in its own column or row. up-left: of those above, at or left of its column, the rightmost
    column's lowest. left-up: of those left, at or above its row, the lowest row's rightmost. Work grows with the rows times
    header columns of a block (left-up: columns times header rows), which its grid has cells for.
    """
    if direction == "up-left":
        found = _corner(data, heads, keys, "row", "col").withColumnsRenamed({"_hrow": "hrow", "_hcol": "hcol"})
    elif direction == "left-up":
        found = _corner(data, heads, keys, "col", "row").withColumnsRenamed({"_hrow": "hcol", "_hcol": "hrow"})
    elif direction in ("up", "left"):
        line, along = ("col", "row") if direction == "up" else ("row", "col")
        place = F.struct(C("row").alias("hrow"), C("col").alias("hcol"))
        marks = heads.select(*keys, "row", "col").distinct().select(*keys, "row", "col", place.alias("h"), F.lit(1).alias("_o"))
        asked = data.select(*keys, "row", "col").distinct().select(*keys, "row", "col", F.lit(None).cast(marks.schema["h"].dataType).alias("h"), F.lit(0).alias("_o"))
        w = Window.partitionBy(*keys, line).orderBy(along, "_o")
        found = marks.unionByName(asked).withColumn("h", F.last("h", True).over(w)).filter("_o = 0 and h is not null").select(*keys, "row", "col", "h.hrow", "h.hcol")
    else:
        raise ValueError(f"no such direction: {direction}")
    return data.join(found, [*keys, "row", "col"], "left")


def unpivot(body: DataFrame) -> DataFrame:
    """A row per data cell with all header levels above (nearest to the left) and labels (filled down), or none."""
    key = [*SHEET, "block_id"]
    data = body.filter("row > header_end and col > label_end")
    heads = body.filter("row <= header_end and col > label_end").select(*key, C("row").alias("hr"), "col", C("value_str").alias("h"))
    grid = data.select(*key, "col").distinct().join(heads.select(*key, "hr").distinct().hint("merge"), key).join(heads.hint("merge"), [*key, "hr", "col"], "left")
    w = Window.partitionBy(*key, "hr").orderBy("col")
    col_hdrs = grid.withColumn("h", F.last("h", True).over(w)).groupBy(*key, "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("hr", "h"))), lambda x: n.strip_footnote(x["h"])).alias("col_hdrs"))
    bold = F.coalesce(C("bold"), F.lit(False)) if "bold" in body.columns else F.lit(False)
    labels = body.filter("row > header_end and col <= label_end").select(*key, "row", C("col").alias("lc"), C("value_str").alias("l"), bold.alias("lb"))
    all_rows = data.select(*key, "row").distinct().join(labels.select(*key, "lc").distinct().hint("merge"), key).join(labels.hint("merge"), [*key, "row", "lc"], "left")
    w = Window.partitionBy(*key, "lc").orderBy("row")
    row_hdrs = all_rows.withColumn("l", F.last("l", True).over(w)).groupBy(*key, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("lc", "l"))), lambda x: n.strip_footnote(F.trim(x["l"]))).alias("row_hdrs"), F.min_by(n.indent_level(C("l")), "lc").alias("level"), F.coalesce(F.max("lb"), F.lit(False)).alias("label_bold"))
    none = F.array().cast("array<string>")
    long = data.join(col_hdrs.hint("merge"), [*key, "col"], "left").join(row_hdrs.hint("merge"), [*key, "row"], "left")
    return long.withColumns({"col_hdrs": F.coalesce("col_hdrs", none), "row_hdrs": F.coalesce("row_hdrs", none), "level": F.coalesce("level", F.lit(0)), "label_bold": F.coalesce("label_bold", F.lit(False))})


def is_subtotal(label: Column) -> Column:
    """A word of the list as a whole word of the label, or as the label with its blanks removed."""
    low, listed = F.lower(label), [*SUBTOTALS, *MORE_SUBTOTALS]
    bare = F.regexp_replace(low, r"\s+", "").isin([w.replace(" ", "") for w in listed])
    return bare | F.exists(F.split(low, r"[\s()\[\]:,/>]+"), lambda w: w.isin(listed))


def is_red(rgb: Column) -> Column:
    """A red of the list, whatever its opacity."""
    return F.coalesce(F.upper(F.right(rgb, F.lit(6))).isin(RED), F.lit(False))


def column_findings(long: DataFrame) -> DataFrame:
    """T5: block and column with SCALE_HETEROGENEOUS (cells' own units differ), TEXT_AS_NUM_SUSPECT (numbers in cells
    formatted as text) or MIXED_NUMBER_FORMAT. long: data cells with value_str and number_format."""
    num = n.number(C("value_str"))
    ok, f = num["value"].isNotNull(), F.coalesce("number_format", F.lit("General"))
    plain = ok & ~C("value_str").contains("%")
    g = long.groupBy(*SHEET, "block_id", "col").agg(
        F.size(F.collect_set(F.when(plain, num["scale"]))).alias("scales"), F.count_if(ok & (f == "@")).alias("texts"),
        F.size(F.collect_set(F.when(~f.isin("General", "@", ""), f))).alias("formats"),
    )
    kinds = F.array_compact(F.array(F.when(C("scales") >= 2, "SCALE_HETEROGENEOUS"), F.when(C("texts") > 0, "TEXT_AS_NUM_SUSPECT"), F.when(C("formats") >= 2, "MIXED_NUMBER_FORMAT")))
    return g.select(*SHEET, "block_id", "col", F.explode(kinds).alias("kind"))


def tidy(long: DataFrame) -> DataFrame:
    """Entity, period, metric, value scaled once, role and flags, with where it came from."""
    period = F.try_element_at(F.filter(F.concat("col_hdrs", "row_hdrs"), lambda x: n.is_period(x)), F.lit(1))
    rest = lambda x: F.array_join(F.filter(x, lambda y: ~F.coalesce(n.is_period(y), F.lit(False))), " > ")
    num = n.number(C("value_str"))
    block = n.unit_scale(F.coalesce("unit", F.lit("")))
    scale = F.when(num["scale"] != 1, F.lit(1)).when(C("value_str").contains("%"), F.lit(1)).otherwise(block)
    error = F.trim("value_str").isin(n.ERRORS)
    red = (is_red(C("font_rgb")) if "font_rgb" in long.columns else F.lit(False)) & (num["value"] > 0) & ~num["negative"]
    red = F.coalesce(red, F.lit(False))
    return long.select(
        "workbook", "sheet", "block_id", rest(C("row_hdrs")).alias("entity"), period.alias("period"), rest(C("col_hdrs")).alias("metric"),
        F.when(~error, num["value"] * scale * F.when(red, -1).otherwise(1)).alias("value"), F.when(num["value"].isNull(), C("value_str")).alias("value_text"), "unit",
        F.when(F.exists(F.concat("row_hdrs", "col_hdrs"), lambda x: F.coalesce(is_subtotal(x), F.lit(False))), "subtotal").otherwise("data").alias("row_role"), "level", C("row").alias("src_row"), C("col").alias("src_col"),
        scale.alias("scale_applied"), C("value_str").alias("raw_value"), F.array_compact(F.array(F.when(error, "ERROR_CELL"), F.when(num["scale"] != 1, "CELL_SCALE"), F.when(red, "SIGN_FROM_COLOR"))).alias("flags"),
        "label_bold",
    )


def ingest(cells: DataFrame) -> DataFrame:
    """Cells to tidy rows."""
    full = settle(filled(unmerge(cells)))
    body = settle(strip_titles(settle(in_blocks(full, settle(blocks(full))))))
    return tidy(unpivot(settle(classify(body))))


def validate(rows: DataFrame) -> DataFrame:
    """Rows with the reasons to reject them; none keeps a row."""
    return rows.withColumn("reasons", F.array_compact(F.array(F.when(F.coalesce(C("entity"), F.lit("")) == "", "NO_ENTITY"), F.when(C("period").isNull(), "NO_PERIOD"), F.when(C("value").isNull() & (F.size("flags") == 0), "NOT_NUMERIC"))))


def derived(text: Column) -> Column:
    """What a cell's own text says, apart from how the ingest reads numbers: the digits that are left without marks,
    times the sign, unit and per cent that its marks mean. Null where more than digits is left."""
    t = F.trim(text)
    unit = F.regexp_extract(t, "(" + "|".join(sorted(n.UNITS, key=len, reverse=True)) + r")\s*\)?$", 1)
    bare = F.regexp_replace(F.regexp_replace(n.ascii_digits(t), "(" + "|".join(sorted(n.UNITS, key=len, reverse=True)) + r")\s*(\)?)$", "$2"), r"[,\s()△▲−+₩$€£%-]", "")
    digits = F.when(bare.rlike(r"^(\d+\.?\d*|\.\d+)$") & ~bare.rlike(r"^0\d+$") & ~t.rlike(r"^(19|20)\d{2}$|\d\s+\d|\d-\d"), bare).try_cast("double")
    sign = F.when(t.rlike(r"^\(.*\)$|^[△▲−-]|\(-\)$"), -1).otherwise(1)
    factor = F.coalesce(*(F.when(unit == u, F.lit(float(k))) for u, k in n.UNITS.items()), F.lit(1.0))
    return digits * sign * factor / F.when(t.contains("%"), 100).otherwise(1)


def reconcile(cells: DataFrame, rows: DataFrame, tol: float = 2.0**-50) -> DataFrame:
    """A status per coordinate of figures in the cells and of tidy rows.

    covered: one row, whose value is the text's own (`derived`), or whose raw text is an error's or a date's. scaled: it is
    the text's times the row's scale or with the sign of its colour, and the row says so. mismatch: it is neither. missing:
    no row; duplicate: more than one; extra: a row without such a cell. Two readings of one text differ by the rounding of a few
    products at most, so values are the same within that (`tol`, relative) and a cent in billions isn't lost. Cells are read
    twice: sums must be settled before, or their last cents may differ.
    """
    own = derived(C("value_str"))
    other = C("value_str").isNotNull() & (F.trim("value_str").isin(n.ERRORS) | (n.value_kind(C("value_str")) == "DATE"))
    truth = filled(cells).select(*SHEET, "row", "col", C("value_str").alias("want"), own.alias("own"), other.alias("other")).filter("own is not null or other")
    got = rows.groupBy(*SHEET, C("src_row").alias("row"), C("src_col").alias("col")).agg(
        F.count("*").alias("k"), F.max("raw_value").alias("raw"), F.max("value").alias("value"), F.max("scale_applied").alias("scale"), F.bool_or(F.array_contains("flags", "SIGN_FROM_COLOR")).alias("red")
    )
    j = truth.join(got, [*SHEET, "row", "col"], "full")
    near = lambda x: F.coalesce(F.abs(C("value") - x) <= tol * F.abs(x), F.lit(False))
    same = F.when(C("own").isNull() | C("other"), C("raw") == C("want")).otherwise(near(C("own")))
    told = near(C("own") * C("scale") * F.when(C("red"), -1).otherwise(1))
    status = F.when(C("k").isNull(), "missing").when(C("want").isNull(), "extra").when(C("k") > 1, "duplicate").when(same, "covered").when(told, "scaled").otherwise("mismatch")
    return j.select(*SHEET, "row", "col", "want", "own", "k", "raw", "value", status.alias("status"))


def subtotal_islands(rows: DataFrame, keys: list[str], ord_: str, tol: float = 0.01) -> DataFrame:
    """Each subtotal against the sum of the data rows since the one before."""
    w = Window.partitionBy(*keys).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    i = rows.withColumn("island", F.coalesce(F.count_if(C("row_role") == "subtotal").over(w), F.lit(0)))
    g = i.groupBy(*keys, "island").agg(F.sum(F.when(C("row_role") == "data", C("value"))).alias("summed"), F.max(F.when(C("row_role") == "subtotal", C("value"))).alias("subtotal"))
    return g.filter("subtotal is not null").withColumn("ok", F.coalesce(F.abs(C("summed") - C("subtotal")) <= tol, F.lit(False)))


def children(rows: DataFrame, keys: list[str], ord_: str = "src_row") -> DataFrame:
    """Each row with the sum of the deeper rows below it, up to the next of its level or above."""
    w = Window.partitionBy(*keys).orderBy(ord_)
    r = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum("value").over(w))
    levels = [x[0] for x in r.select("level").distinct().orderBy("level").collect()]  # a few indent levels
    behind = Window.partitionBy(*keys).orderBy(F.desc(ord_)).rowsBetween(Window.unboundedPreceding, -1)  # the rows below, nearest last
    stop = None
    for lv in levels:
        s = F.min(F.when(C("level") <= lv, C("_rn"))).over(behind)
        stop = F.when(C("level") == lv, s) if stop is None else stop.when(C("level") == lv, s)
    r = r.withColumn("_stop", F.coalesce(stop, F.max("_rn").over(Window.partitionBy(*keys)) + 1))
    upto = r.select(*keys, C("_rn").alias("_e"), C("_sum").alias("_se"))
    return r.withColumn("_e", C("_stop") - 1).join(upto, [*keys, "_e"]).withColumns({"n_children": C("_stop") - C("_rn") - 1, "child_sum": C("_se") - C("_sum")}).drop("_rn", "_sum", "_stop", "_e", "_se")


def to_mart(rows: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Data rows to one column per metric; the last value wins."""
    return rows.filter("row_role = 'data'").groupBy(*dims).pivot("metric", metrics).agg(F.max_by("value", "src_row"))
