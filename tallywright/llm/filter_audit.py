"""Audit of how filters of documents act together, in every order in which they can be applied.

Each row is reduced to the mask of the filters that it fails, and rows to counted cells (part, mask). A recursive common
table expression then extends prefixes of filters by unused letters: each of its rows is a prefix and a mask, carries the
bits applied so far, and says what that step does with the mask, so a level of the recursion is a step of all orders. It
has at most 326 x 32 rows for five filters, whatever the data; cells join it by their mask.

Defined results: null texts are empty, a null part is ""; rows with one id are as many documents, and none is a copy of
itself; a row without an id is a copy of none and none is a copy of it; of repeated labels one that says 1 counts; a null
label says nothing; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import append, settle

#: Least words, least distinct words and most capitals in percent, and the characters of filter D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_odd = re.compile(r"[#$%&*|]")
LETTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: str) -> int:
    """Bits 1, 2, 4 and 8 where a text fails filter A, B, C or D."""
    raw = text.encode()
    words = raw.split()
    few = len(words) < LEAST_WORDS
    poor = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITALS_PERCENT * len(text)
    return few | poor << 1 | loud << 2 | bool(_odd.search(text)) << 3


def _marks(x: pa.Array) -> list:
    texts = [v or "" for v in x.to_pylist()]
    return [[text_mask(t) for t in texts], [hashlib.sha256(t.encode()).digest() for t in texts]]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of filters A to E), good and toxic (0 or 1), a row for each row of docs (doc_id, part, text).

    Copies are found by the digest of the text. Only the first id of each text is joined back, by text and id, so that a
    text with most of the rows is spread over the tasks by its ids.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.col("text"))
    rows = settle(append(docs, ["text"], "mask int, digest binary", _marks, ["doc_id", "part"]))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic")))
    )
    out = rows.join(first, ["digest", "doc_id"], "left").join(says, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return out.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def steps(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """prefix, letter, step, mask, stays, gone, again, alone: what the last filter of each prefix does with each mask."""
    if len(set(letters)) < len(letters):
        raise ValueError("each filter needs a letter of its own")
    listed = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE grown(prefix, letter, step, mask, before, bit) AS (
          SELECT '', '', 0, CAST(id AS INT), 0, 0 FROM range({1 << len(letters)})
          UNION ALL
          SELECT concat(prefix, own.letter), own.letter, step + 1, mask, before | grown.bit, own.bit
          FROM grown LATERAL VIEW explode(filter(array({listed}), x -> ((before | grown.bit) & x.bit) = 0)) each AS own
          WHERE step < {len(letters)})
        SELECT prefix, letter, step, mask, (mask & (before | bit)) = 0 AS stays, (mask & before) = 0 AND (mask & bit) <> 0 AS gone,
          (mask & before) <> 0 AND (mask & bit) <> 0 AS again, mask = bit AS alone
        FROM grown WHERE step > 0""")


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and what that step does: rows of cells are part, mask, good, toxic (0 or 1).

    Each prefix of an order is computed once for a part; orders share them. shapley adds a filter's removals over all
    orders: a prefix of k of n filters begins (n - k)! of them.
    """
    n, every = len(letters), settle(steps(cells.sparkSession, letters))
    counted = cells.groupBy("part", "mask").agg(F.count("*").alias("many"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    add = lambda test, of: F.sum(F.when(F.col(test), F.col(of)).otherwise(0)).cast("long")
    made = [add("stays", "many"), add("gone", "many"), add("again", "many"), add("alone", "many"), add("gone", "good"), add("gone", "toxic")]
    each = counted.join(F.broadcast(every), "mask").groupBy("part", "prefix", "letter", "step").agg(*(c.alias(x) for c, x in zip(made, COUNTS, strict=True)))
    orders = F.element_at(F.array(*(F.lit(math.factorial(n - k)) for k in range(1, n + 1))), F.col("step"))
    each = each.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "letter")).cast("long"))
    whole = every.filter(F.col("step") == n).select(F.col("prefix").alias("filter_order")).distinct()
    begun = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).select("filter_order", F.expr("left(filter_order, k)").alias("prefix"))
    return each.join(F.broadcast(begun), "prefix").select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """The interactions of filters A to E over docs, for each part."""
    return interactions(masked(docs.select(F.col(doc_id).alias("doc_id"), F.col(part).alias("part"), F.col(text).alias("text")), labels))
