"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators are words, shapes of words (case, marks around them, repetition of what came before) and pairs and triples
of shapes, hashed to `2 ** BITS` slots. On a bounded sample of labelled rows (`sample`, the rows with the smallest hash
of their id), each slot's indicator is scaled by its class log-count ratio, and a linear model with hinge loss is fitted
by dual coordinate descent. Scores are a logistic function of the margin.

The model is a vector of fixed size, so it is sent to all tasks. Labels, language, source and id are never features.

Defined results: a null text is empty and gets the score of the intercept; labels that are null or of rows without a
document are not used; without labels of both classes every score is 0.5; equal texts get equal scores.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import append, memo

BITS, SAMPLE, FOLDS, CUT = 18, 6000, 5, 0.3
_shape = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def _word(w: str, known: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Slots of a word and of its shape."""
    if (x := known.get(w)) is None:
        if len(known) > 100_000:
            known.clear()
        before, core, after = _shape.match(w).groups()
        case = "0" if not core else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "1" if core.isdigit() else "X" if core[:1].isupper() else "m"
        shape = f"{before[:3]} {case} {after[:3]}"
        x = known[w] = zlib.crc32(core.lower().encode()), zlib.crc32(shape.encode(), 7) | 1
    return x


def indicators(text: str) -> np.ndarray:
    """The slots that a text sets."""
    words = text.split()
    bucket = [zlib.crc32(b"size%d" % min(12, len(words).bit_length()))]
    if not words:
        return np.array(bucket, np.int64) & ((1 << BITS) - 1)
    known = memo("classifier")
    both = np.array([_word(w, known) for w in words], np.uint64)
    own, shape = both[:, 0], both[:, 1].copy()
    shape[1:][own[1:] == own[:-1]] = 0x5EED
    pairs = (shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]) >> np.uint64(20)
    triples = (pairs[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + shape[2:]) >> np.uint64(18)
    if len(words) > 3:
        g = own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + own[2:]
        again = 1 - len(np.unique(g)) / len(g)
        bucket += [zlib.crc32(b"again%d" % k) for k in range(int(10 * again) + 1)]
    share = np.unique(shape, return_counts=True)
    often = share[0][10 * share[1] > len(words)] ^ np.uint64(0xABCDEF)
    slots = np.concatenate([own, shape, pairs, triples, often, np.array(bucket, np.uint64)])
    return np.unique((slots & np.uint64((1 << BITS) - 1)).astype(np.int64))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights of the slots and the intercept. Rows of indicators, labels 0 and 1."""
    size = 1 << BITS
    sums = np.ones((2, size))
    for x, y in zip(rows, labels, strict=True):
        sums[int(y), x] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    w, bias = np.zeros(size), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(labels == 1, 1.0, -1.0)
    scaled = [ratio[x] for x in rows]
    share = max(1, (labels == 1).sum()) / max(1, (labels == 0).sum())
    most = np.where(labels == 1, cost, cost * min(10.0, share))
    norm = np.array([v @ v + 1 for v in scaled])
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            new = min(most[i], max(0.0, alpha[i] - (sign[i] * (w[x] @ v + bias) - 1) / norm[i]))
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[x] += step * v
                bias += step
                alpha[i] = new
    return (w * ratio).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Fit on at most `sample` labelled rows outside the held-out fold, in one task; of rows with one id the least text counts."""
    kind = "string" if "string" in (docs.schema[doc_id].dataType.typeName(), labels.schema[doc_id].dataType.typeName()) else "long"
    named = F.col(doc_id).cast(kind).alias("id")
    told = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).select(named, F.col(label).cast("int").alias("y")).distinct()
    chosen = told.orderBy(F.xxhash64("id"), "y").limit(sample)
    near = docs.select(named, F.col(text).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    made = append(near, ["text"], "slots array<int>", lambda x: [[indicators(v or "").astype(np.int32) for v in x.to_pylist()]], ["id", "y"])

    def run(batches):
        rows, ys, ids = [], [], []
        for b in batches:
            rows += [v.values.to_numpy() for v in b.column("slots")]
            ys += b.column("y").to_pylist()
            ids += b.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], rows[i].tobytes()))
        y = np.array([ys[i] for i in order])
        if len(set(ys)) == 2:
            w, bias = fit([rows[i] for i in order], y)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    got = made.repartition(1).mapInArrow(run, "w binary, bias double").first()  # a vector of fixed size
    return None if got is None else (np.frombuffer(bytes(got["w"]), np.float32), got["bias"])


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep`) with held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array) -> list:
        if sent.value is None:
            return [np.full(len(texts), 0.5)]
        w, bias = sent.value
        margins = np.array([float(w[indicators(x or "")].sum(dtype=np.float64)) + bias for x in texts.to_pylist()])
        return [1 / (1 + np.exp(-np.clip(2 * margins, -60, 60)))]

    out = append(docs, [text], "score double", fn, keep)
    return out.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= CUT).cast("int")})
