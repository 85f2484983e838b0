"""Tall sheets and blocks without a header."""

from tallywright.operators import grid

CELLS = "workbook string, sheet string, row int, col int, value_str string, bold boolean, merge_row int, merge_col int"


def put(sheet, r0, rows):
    return [("w", sheet, r0 + i, 1 + j, v, False, None, None) for i, row in enumerate(rows) for j, v in enumerate(row)]


def test_tall_and_headerless_sheets(spark):
    tall = put("tall", 1, [["item", "2024", "2025"], *([f"k{i}", f"{i}.5", str(i)] for i in range(4000))])
    bare = put("bare", 1, [["a", "1.5", "2.5"], ["b", "3.5", "4.5"], ["c", "5.5", "6.5"]])
    numbers = put("numbers", 1, [["1.5", "2.5"], ["3.5", "4.5"], ["5.5", "6.5"]])
    cells = spark.createDataFrame(tall + bare + numbers, CELLS)
    found = {r.sheet: (r.r0, r.r1, r.c0, r.c1) for r in grid.blocks(cells).collect()}
    assert found == {"tall": (1, 4001, 1, 3), "bare": (1, 3, 1, 3), "numbers": (1, 3, 1, 2)}
    rows = grid.ingest(cells).collect()
    got = {(r.sheet, r.src_row, r.src_col): r for r in rows}
    assert len(rows) == len(got) == 8000 + 6 + 6
    assert got["tall", 4001, 2].entity == "k3999" and got["tall", 4001, 2].period == "2024" and got["tall", 4001, 2].value == 3999.5
    assert got["bare", 2, 3].entity == "b" and got["bare", 2, 3].period is None and got["numbers", 3, 1].value == 5.5


def test_stairs_are_one_block(spark):
    stairs = [("w", "s", r, c, "1.5", False, None, None) for r in range(1, 61) for c in range(r, r + 60)]
    assert [(r.r0, r.r1, r.c0, r.c1) for r in grid.blocks(spark.createDataFrame(stairs, CELLS)).collect()] == [(1, 60, 1, 119)]
