"""SimHash near-duplicates with covering locality-sensitive hashing.

Each bit of a fingerprint gets a vector of radius + 1 bits, and each nonzero vector v gives a table whose mask keeps the
bits whose vector has an odd product with v. `radius` differing bits span at most `radius` dimensions, so some v is
orthogonal to all of them: that table's key is the same for both, and no pair within the radius is missed.

Buckets up to `direct` distinct fingerprints are compared in place, in blocks, and give a spanning set of links.
Larger ones are linked through shared variants: each member emits itself with up to two free bits flipped; members at
one variant are within three bits of each other unless both flipped two, so all hang below the member with the fewest
flips if that flipped less than two. The work there grows with the bucket and not with its square.

Defined results: null and empty texts have the fingerprint zero and link like any other; texts of fewer words than a
shingle hash as one; equal rows share a component; component_id is null only where all linked ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import append, fresh, settle
from tallywright.operators.components import components

RADIUS, DIRECT = 3, 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 values (seed 42) of word shingles, as a signed 64-bit number."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.r_[0, ends[:-1]]
        shingles = [joined[s:e] for s, e in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks over 64 bits: bits take the nonzero vectors in turn, so each mask keeps about half."""
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(64) if ((i % (top - 1) + 1) & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all members of one bucket reachable through pairs within the radius."""
    up = np.arange(len(fps))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i in range(1, len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius).tolist():
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _links_within(groups: DataFrame, radius: int) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for g in b.column(0):
                fps = np.sort(g.values.to_numpy())
                for i, j in _near(fps.view(np.uint64), radius):
                    a.append(int(fps[i]))
                    z.append(int(fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(fn, "a long, b long")


def _links_by_variant(members: DataFrame, all_masks: list[int]) -> DataFrame:
    """Links of members (t, fp) of large buckets through variants of up to two flipped free bits (radius 3)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for m in all_masks:
            one = [1 << i for i in range(64) if not m >> i & 1]
            two = [x | y for k, x in enumerate(one) for y in one[:k]]
            flips.append((np.array([0, *one, *two], np.uint64), np.array([0] + [1] * len(one) + [2] * len(two), np.int32)))
        for b in batches:
            for t, fp in zip(b.column(0).to_pylist(), b.column(1).to_numpy(), strict=True):
                bits, n = flips[t]
                near = (np.uint64(fp.view(np.uint64)) ^ bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(near), pa.array(n), pa.array(np.full(len(n), fp))], names=["t", "variant", "n", "fp"])

    made = members.mapInArrow(fn, "t int, variant long, n int, fp long")
    best = made.groupBy("t", "variant").agg(F.min(F.struct("n", "fp")).alias("low"), F.count("*").alias("many")).filter("many > 1 and low.n < 2").select("t", "variant", F.col("low.fp").alias("b"))
    return made.join(best, ["t", "variant"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_links(fps: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that keep every component of the pairs within the radius whole.
    Large buckets are linked through variants that are made for radius 3, so another radius is refused, whatever the data."""
    if radius != RADIUS:
        raise ValueError(f"radius {RADIUS} only")
    every = masks(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(every)))
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key").count().filter("count > 1")
    met = settle(dealt.join(sizes, ["t", "key"]))
    small = met.filter(F.col("count") <= direct).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = _links_within(small, radius)
    large = met.filter(F.col("count") > direct).select("t", "fp")
    if not large.isEmpty():
        links = links.unionByName(_links_by_variant(large, every))
    return links


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the fingerprint fp of each row."""
    (fp,) = fresh(docs, "fp")
    return append(docs.select(doc_id, text), [text], f"{fp} long", lambda x: [[fingerprint(v or b"") for v in x.cast(pa.binary()).to_pylist()]], [doc_id]).withColumnRenamed(fp, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable through links), a row for each row."""
    marked = settle(fingerprints(docs, text, doc_id))
    seen = marked.groupBy("fp").agg(F.min(doc_id).alias("low"))
    roots = components(near_links(seen.select("fp"), radius, direct))
    placed = seen.join(roots, seen.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = placed.join(placed.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(ids, "fp").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_links_of(find: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A search for near-duplicates by fingerprints to which the links of `find` are added: components of both together. Ids
    must be different."""

    def both(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        has_id = F.col(doc_id).isNotNull()
        mine = settle(near_duplicates(docs, text, doc_id).filter(has_id).select(doc_id, "component_id"))
        links = mine.unionByName(find(docs, text, doc_id).filter(has_id).select(doc_id, "component_id"))
        roots = components(links.select(F.col(doc_id).alias("a"), F.col("component_id").alias("b")))
        return mine.select(doc_id).join(roots, mine[doc_id] == roots.node, "left").select(doc_id, F.coalesce("root", doc_id).alias("component_id"))

    return both


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The document with the smallest id of each component stays; of rows with one id, one. Rows without an id stay."""
    first = settle(find(docs, text, doc_id).filter(F.col(doc_id) == F.col("component_id")).groupBy(doc_id).count())
    kept = docs.filter(F.col(doc_id).isNotNull()).join(first.select(doc_id), doc_id, "left_semi")
    if not first.filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id])
    return kept.unionByName(docs.filter(F.col(doc_id).isNull()))
