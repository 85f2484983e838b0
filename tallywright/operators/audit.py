"""Audits of cells and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.normalize import ERRORS, number
from tallywright.operators.grid import within
from tallywright.operators.lineage import small

C = F.col
BENIGN = ["0", "1", "2", "4", "12", "100", "365", "1000"]


#: What a formula is made of: texts, quoted and plain sheet names with their mark, files, words (functions, names and
#: references), numbers, and other characters.
TOKEN = r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!?|\[[^\]]*\]|[\p{L}_$\\][\p{L}\p{N}_.$]*!?|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|.)"""
REFERENCE = r"^\$?[A-Za-z]{1,3}\$?\d+$"


def tokens(formula: Column) -> Column:
    """The tokens of a formula in order; what stands within quotes is one of them."""
    return F.regexp_extract_all(formula, F.lit(TOKEN), 1)


def sheets_in(parts: Column) -> Column:
    """The names of the sheets that tokens refer to, without their quotes, each once."""
    named = F.filter(parts, lambda x: x.endswith("!") & (F.length(x) > 1))
    bare = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    return F.array_distinct(F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(bare(x), "^'|'$", ""), "''", "'")))


def functions_in(parts: Column) -> Column:
    """The functions that tokens call, upper-cased: words before an opening bracket."""
    called = F.transform(parts, lambda x, k: F.when(x.rlike(r"^[\p{L}_][\p{L}\p{N}_.]*$") & (F.get(parts, k + 1) == "("), F.upper(x)))
    return F.array_compact(called)


def formula_depth(f: Column) -> Column:
    """The deepest nesting of brackets outside texts."""
    step = lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "(", 1).otherwise(0)).alias("m"))
    return F.aggregate(F.filter(tokens(f), lambda x: x.isin("(", ")")), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)["m"]


def formula_smells(cells: DataFrame) -> DataFrame:
    """External files, deep nesting, many sheets, constants that aren't benign, unguarded division."""
    f, parts = C("formula"), tokens(C("formula"))
    outside = F.array_join(F.filter(parts, lambda x: ~x.startswith('"')), "")
    numbers = F.array_except(F.filter(parts, lambda x: x.rlike(r"^\d")), F.array(*map(F.lit, BENIGN)))
    kinds = F.array_compact(F.array(
        F.when(outside.rlike(r"\[[^\]]+\.xls"), "EXTERNAL"), F.when(formula_depth(f) > 4, "NESTED"), F.when(F.size(sheets_in(parts)) > 3, "MANY_SHEETS"),
        F.when(F.size(numbers) > 0, "CONSTANT"), F.when(F.array_contains(parts, "/") & ~outside.rlike("(?i)IFERROR|IF\\("), "UNGUARDED_DIVISION"),
    ))
    return cells.filter("formula is not null").withColumn("kind", F.explode(kinds))


def error_cells(cells: DataFrame, value: str = "value_str") -> DataFrame:
    """X2."""
    return cells.filter(F.trim(value).isin(ERRORS))


def relative_form(formula: Column, row: Column, col: Column) -> Column:
    """References as offsets, so that a filled-down formula has one form; texts and absolute references stay."""
    letter = lambda s, k: F.ascii(F.substring(s, k, 1)) - 64

    def one(x: Column) -> Column:
        name = F.regexp_extract(x, r"^[A-Z]{1,3}", 0)
        place, long = F.substring(x, F.length(name) + 1, F.length(x)).try_cast("int"), F.length(name)
        index = F.when(long == 1, letter(name, 1)).when(long == 2, letter(name, 1) * 26 + letter(name, 2)).otherwise((letter(name, 1) * 26 + letter(name, 2)) * 26 + letter(name, 3))
        return F.when(x.rlike(r"^[A-Z]{1,3}\d+$"), F.concat(F.lit("R["), place - row, F.lit("]C["), index - col, F.lit("]"))).otherwise(x)

    return F.array_join(F.transform(tokens(formula), one), "")


def minority(cells: DataFrame, keys: list[str], what: str, at_least: int = 3) -> DataFrame:
    """Rows whose form is rare (at most a third, or one) beside a majority of at least `at_least`."""
    forms = cells.groupBy(*keys, what).agg(F.count("*").alias("_k"))
    tops = small(forms.groupBy(*keys).agg(F.max("_k").alias("_top"), F.sum("_k").alias("_n")))
    rare = forms.join(tops, keys).filter((C("_top") >= at_least) & (C("_k") < C("_top")) & (C("_k") <= F.greatest(F.lit(1), F.floor(C("_n") / 3))))
    return cells.join(small(rare.select(*keys, what)), [*keys, what], "left_semi")


def text_in_numbers(cells: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Text cells of columns that are mostly numbers."""
    mostly = cells.groupBy(*keys).agg(F.avg((C(kind) == "NUM").cast("int")).alias("_f")).filter("_f > 0.5").select(*keys)
    return cells.filter(C(kind) == "TEXT").join(small(mostly), keys, "left_semi")


def crossfoot(cells: DataFrame, keys: list[str], row: str, value: str, total: str, tol: float = 0.01) -> DataFrame:
    """Marked totals against the sum of the numbers straight above them, two at least."""
    w = Window.partitionBy(*keys).orderBy(row)
    i = cells.withColumn("_i", C(row) - F.row_number().over(w))
    up = Window.partitionBy(*keys, "_i").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    part = i.withColumn("_s", F.coalesce(F.count_if(total).over(up), F.lit(0)))
    above = Window.partitionBy(*keys, "_i", "_s").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return part.withColumns({"above": F.sum(value).over(above), "n_above": F.count("*").over(above)}).filter(C(total) & (C("n_above") >= 2)).withColumn("ok", F.abs(C("above") - C(value)) <= tol).drop("_i", "_s")


def untraced(numbers: DataFrame, source: DataFrame, value: str, of: str) -> DataFrame:
    """Numbers that no source value gives at scale 1, a thousand or a million, either way."""
    scales = F.explode(F.array(*(F.lit(x) for x in (1.0, 1e3, 1e6, 1e-3, 1e-6))))
    known = source.select(C(of).alias("_v")).distinct().withColumn("_s", scales).select(F.round(C("_v") * C("_s"), 2).alias("_k")).distinct()
    return numbers.join(known, F.round(C(value), 2) == C("_k"), "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coordinates lost, added or changed."""
    a, b = before.select(*keys, C(value).alias("_a"), F.lit(1).alias("_l")), after.select(*keys, C(value).alias("_b"), F.lit(1).alias("_r"))
    status = F.when(C("_r").isNull(), "LOST").when(C("_l").isNull(), "ADDED").when(~C("_a").eqNullSafe(C("_b")), "CHANGED")
    return a.join(b, keys, "full").withColumn("status", status).filter("status is not null").select(*keys, "status")


def claims(texts: DataFrame, key: str, text: Column, facts: DataFrame, fact: str, rel: float = 0.001, least: float = 0.5) -> DataFrame:
    """Numbers in texts and whether a fact is within the tolerance; years and numbers under 10 aren't claims.

    Facts and numbers meet on buckets as wide as the largest tolerance allows, so the range join is an equi-join.
    """
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d[\d,]*(?:\.\d+)?)(?![\w])"), 1))).alias("raw")).withColumn("x", F.regexp_replace("raw", ",", "").try_cast("double"))
    found = found.filter("x >= 10 and not (x between 1900 and 2100 and x = floor(x))")
    # Below `turn` the tolerance is `least`, above it a share of the value: buckets are as wide as it is, at each place.
    turn = least / rel
    bucket = lambda v: F.when(v < turn, F.floor(v / least)).otherwise(F.floor(turn / least + F.ln(v / turn) / rel))
    known = facts.select(C(fact).alias("v")).filter("v > 0").distinct().withColumn("_b", bucket(C("v")))
    near = found.withColumn("_b", F.explode(F.array(bucket(C("x")) - 1, bucket(C("x")), bucket(C("x")) + 1)))
    hit = near.join(known, "_b").filter(F.abs(C("x") - C("v")) <= F.greatest(rel * C("v"), F.lit(least))).select(key, "raw").distinct().withColumn("verified", F.lit(True))
    return found.join(hit, [key, "raw"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def sheet_references(cells: DataFrame) -> DataFrame:
    """From, to, n (and workbook, where cells have one): formulas of a sheet that refer to another sheet that exists in
    the same workbook. cells: sheet, formula. A name within a text is no reference; quoted names may hold blanks."""
    book = [c for c in ("workbook",) if c in cells.columns]
    ref = cells.select(*book, C("sheet").cast("string").alias("from"), F.explode(sheets_in(tokens(C("formula")))).alias("to"))
    edges = ref.filter(C("from") != C("to")).groupBy(*book, "from", "to").agg(F.count("*").alias("n"))
    return edges.join(cells.select(*book, C("sheet").cast("string").alias("to")).distinct(), [*book, "to"], "left_semi").select(*book, "from", "to", "n")


def formula_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells of a rule's region whose formula isn't left op right of their own row; one that's no formula fails.

    rules: sheet, col, r0, r1, left, op, right. Marks of absolute references, blanks and case don't count.
    """
    want = F.concat(F.lit("="), F.upper("left"), C("row").cast("string"), C("op"), F.upper("right"), C("row").cast("string"))
    j = cells.filter("formula is not null").join(rules, ["sheet", "col"]).filter("row between r0 and r1")
    return j.filter(F.upper(F.regexp_replace("formula", r"[$\s]", "")) != want)


def numbers_as_text(cells: DataFrame) -> DataFrame:
    """X11: cells formatted as text whose text is a number."""
    return cells.filter((C("number_format") == "@") & number(C("value_str"))["value"].isNotNull())


def disallowed_formats(cells: DataFrame, allowed: list[str], of: str = "number_format") -> DataFrame:
    """Cells whose number format isn't allowed."""
    return cells.filter(C(of).isNotNull() & ~C(of).isin(allowed))


def content_regions(cells: DataFrame, regions: DataFrame, kind: str) -> DataFrame:
    """Cells whose kind differs from what their region wants. regions: sheet, r0, r1, c0, c1, wants."""
    return within(cells, regions, ["sheet"]).filter(~C(kind).eqNullSafe(C("wants")))


def cell_contract(cells: DataFrame, rules: DataFrame, tol: float = 0.01, decades: float = 3.0) -> DataFrame:
    """rules(sheet, row, col, kind, expected) against cells(sheet, row, col, value): ties within the tolerance,
    magnitudes within so many decades; a missing cell fails."""
    size = F.abs(F.log10(F.abs(F.try_divide("value", "expected")))) < decades
    ok = F.when(C("kind") == "tie", F.abs(C("value") - C("expected")) <= tol).when(C("kind") == "magnitude", size)
    return rules.join(cells, ["sheet", "row", "col"], "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def stale_formulas(cells: DataFrame, value: str) -> DataFrame:
    """Formula cells whose stored value is null or zero."""
    return cells.filter(C("formula").isNotNull() & (C(value).isNull() | (C(value) == 0)))


def digest(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A digest of each key's cells that doesn't depend on their order: the sum of 60-bit digests of the rows."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(C(c).cast("string"), F.lit("\x00")) for c in columns)))
    return cells.groupBy(*keys).agg(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"), F.count("*").alias("n"))


def type_counts(cells: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """Cells of each column by type, over all its rows; a formula counts as one, whatever its value."""
    t = F.when(C("formula").isNotNull(), "formula").otherwise(kind)
    names = ["numeric", "character", "date", "formula", "blank", "error", "logical"]
    g = cells.groupBy(*keys, t.alias("_t")).agg(F.count("*").alias("_n"))
    return g.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(C("_t") == x, C("_n"))), F.lit(0)).alias(x) for x in names))
