"""Delimited files, statistics records and reports of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col


def encodings(spark: SparkSession, path: str, other: str = "cp949") -> DataFrame:
    """File and encoding: UTF-8, with or without a mark at its start, where all of its lines are valid; else the other."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("file").agg(F.when(F.bool_and("valid"), "UTF-8").otherwise(other).alias("encoding"))


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as text, names trimmed; short rows end in empty texts and cells stay as written.

    Without a declared encoding each file of the folder is read in its own; a mark of byte order at a file's start goes.
    Files of both encodings have one header. The list of files goes through the driver, their contents don't.
    """

    def read(where: str | list[str], how: str) -> DataFrame:
        if how.upper().replace("-", "") != "UTF8":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # encodings beyond Spark's own few
        df = spark.read.options(header=True, encoding=how, multiLine=False, mode="PERMISSIVE", nullValue="\x00", emptyValue="").csv(where)
        return df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns)).fillna("")

    if encoding:
        return read(path, encoding)
    files: dict[str, list[str]] = {}
    for r in encodings(spark, path).collect():
        files.setdefault(r.encoding, []).append(r.file)
    parts = [read(sorted(names), how) for how, names in sorted(files.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna("") if parts else read(path, "UTF-8")


def findings_report(findings: DataFrame, kind: str, order: list[str], most: int = 50) -> DataFrame:
    """The first `most` findings of each kind, with the number of all and of those not shown."""
    w = Window.partitionBy(kind).orderBy(*order)
    shown = findings.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= most)
    return shown.join(findings.groupBy(kind).agg(F.count("*").alias("total")), kind).withColumn("hidden", F.greatest(C("total") - most, F.lit(0)))


def write_tidy(rows: DataFrame, path: str) -> None:
    """Tidy rows by workbook."""
    rows.write.mode("overwrite").partitionBy("workbook").parquet(path)


def period_label(p: Column) -> Column:
    """Yyyymm as yyyy.mm."""
    return F.regexp_replace(p, r"^(\d{4})(\d{2})$", "$1.$2")


def wide_records(records: DataFrame, table: str, dims: list[str], columns: list[str]) -> DataFrame:
    """records(table, dims, period, item, unit, value text, ord) to a row per key and a column per period and item.

    Rows keep the order in which keys come first (`ord`), outer keys that repeat are blank (a key inside starts anew when
    one outside changes), a missing value is a dash, and `unit` is the table's most frequent one. columns: "period|item".
    The windows are per statistics table, which is a sheet that people read.
    """
    g = records.withColumn("_s", F.concat_ws("|", period_label(C("period")), C("item"))).groupBy(table, *dims).pivot("_s", columns).agg(F.max_by("value", "ord"))
    about = records.groupBy(table, *dims).agg(F.min("ord").alias("ord"))
    w = Window.partitionBy(table).orderBy("ord")
    named, same = {}, F.row_number().over(w) > 1
    for d in dims[:-1]:
        same = same & C(d).eqNullSafe(F.lag(d).over(w))
        named[f"{d}_label"] = F.when(same, "").otherwise(C(d).cast("string"))
    unit = records.groupBy(table).agg(F.mode("unit").alias("unit"))
    return g.join(about, [table, *dims]).withColumns(named).withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in columns}).join(unit, table)
