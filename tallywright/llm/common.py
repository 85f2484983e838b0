"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tallywright.operators.lineage import settle, shared_folder, small

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "append", "fresh", "memo", "numbered", "settle", "shared_folder", "small", "table"]

#: Rows and bytes of an Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


_memo: dict = {}


def memo(owner: str) -> dict:
    """What a Python worker remembers between batches. Workers outlive stages, so another owner's memory is dropped, and
    what the allocator holds of it goes back to the system."""
    if _memo.get("owner") != owner:
        _memo.clear()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _memo.update(owner=owner, kept={})
    return _memo["kept"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet."""
    out = []
    for name in names:
        while name in df.columns:
            name = "_" + name
        out.append(name)
    return out


def append(df: DataFrame, inputs: list[str], added: str, fn: Callable[..., list], only: list[str] | None = None) -> DataFrame:
    """df (or its columns `only`) with the columns `added` that fn makes of the Arrow arrays of `inputs`."""
    keep = df.columns if only is None else only
    new = _parse_datatype_string(added)
    new_arrow = to_arrow_schema(new)
    at, back = [df.columns.index(c) for c in inputs], [df.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = fn(*(b.column(i) for i in at))
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, new_arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in back), *made], names=[*keep, *new.names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *new.fields]))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, per_bucket: int = 50_000) -> DataFrame:
    """df with a gapless number from 0 within each value of `by`, in no particular order of buckets.

    Rows are dealt to hash buckets by `order`, numbered there, and shifted by the sizes of the buckets before,
    so that a value with most of the rows doesn't meet in one task.
    """
    bucket, within, before = fresh(df, "bucket", "within", "before")
    many = max(1, df.count() // per_bucket)
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(many)))
    by_sql, order_sql = ", ".join(f"`{c}`" for c in by), ", ".join(f"`{c}`" for c in order)
    sizes = dealt.groupBy(*by, bucket).count().withColumn(
        before, F.expr(f"coalesce(sum(count) over (partition by {by_sql} order by `{bucket}` rows between unbounded preceding and 1 preceding), 0)")
    ).drop("count")
    ranked = dealt.withColumn(within, F.expr(f"row_number() over (partition by {by_sql}, `{bucket}` order by {order_sql}) - 1"))
    return ranked.join(sizes, [*by, bucket]).withColumn(name, F.col(within) + F.col(before)).drop(bucket, within, before)
