"""Near-duplicates by the Jaccard similarity of their sets of word shingles, without missed pairs.

Two sets with a similarity of `share` = p/q or more have at least ceil(p/q * n) members in common, so under any total
order of shingles their prefixes of n - ceil(p/q * n) + 1 members meet. Shingles that a sample of the texts repeats come
last in that order, so that prefixes hold rare ones; the sample decides on work alone. Sets that share a prefix member
form a list. A list links possible partners: a set's sketch flips a bit per member, so two sketches differ in no more
bits than their sets in members; it has bits for twice the members, so that it tells long texts apart too. Each component of these links is compared in one place, with exact similarities, until
all members not yet compared with the rest are in one component. Lists and components over `direct` members are cut into
pairs of their blocks.

Defined results: null, empty and blank texts are alike; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import append, fresh, settle
from tallywright.llm.suffix_dedup import Likely
from tallywright.operators.components import components

WORDS, SHARE, DIRECT = 5, (4, 5), 2048
#: One text of so many is sampled for repeated shingles, and so many of these are sent.
SAMPLE, COMMON = 16, 200_000
#: Bits of the smallest sketch; larger sets get twice their members, rounded up to a power of two.
BITS = 512


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 values (seed 42) of a text's word shingles."""
    parts = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.r_[0, ends[:-1]]
    spans = zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, len(parts) - words + 1))


def node_of(of: np.ndarray) -> int:
    """One number for a set: equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(of.tobytes(), 7)).view(np.int64))


def prefix(of: np.ndarray, common: np.ndarray, counts: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The first members of a set by (count in the sample, value)."""
    n = len(of)
    k = n + share[0] * n * -1 // share[1] + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, of), len(common) - 1)
        of = of[np.lexsort((of, np.where(common[at] == of, counts[at], 0)))]
    return of[:k]


def sketch(of: np.ndarray) -> bytes:
    """Each member flips one bit, so that differing bits are never more than differing members. The number of bits grows
    with the set, or else the bits of long texts would say nothing."""
    bits = max(BITS, 1 << (2 * len(of) - 1).bit_length())
    return np.packbits(np.bincount((of >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches; the larger is folded to the smaller's bits."""
    a, b = sorted((a, b), key=len)
    while len(b) > len(a):
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def possible(n: np.ndarray, sketches: list[bytes], share: tuple[int, int] = SHARE) -> list[tuple[int, int]]:
    """Links that join all sets reachable through possible partners: differing members are at most (q - p) / (q + p) of both sizes.
    A sketch of half the bits is met by folding the larger one, whose upper half then flips the lower."""
    p, q = share
    if len(n) == 2:
        return [(0, 1)] if q * min(n) >= p * max(n) and (q + p) * _apart(*sketches) <= (q - p) * int(n[0] + n[1]) else []
    root, out = np.arange(len(n)), []
    size = np.fromiter(map(len, sketches), np.int64, len(n))
    kinds = {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
    stacked = {k: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1) for k, at in kinds.items()}
    place = {int(i): r for at in kinds.values() for r, i in enumerate(at)}
    for k, at in kinds.items():
        for i in at.tolist():
            own = stacked[k][place[i]]
            for m in (k, k // 2):
                if m not in kinds:
                    continue
                other = kinds[m][: place[i]] if m == k else kinds[m]
                near = other[(root[other] != root[i]) & (q * np.minimum(n[other], n[i]) >= p * np.maximum(n[other], n[i]))]
                if len(near):
                    rows = stacked[m][: place[i]] if m == k else stacked[m]
                    rows = rows if len(near) == len(other) else rows[np.isin(other, near)]
                    mine = own if m == k else own[: len(own) // 2] ^ own[len(own) // 2 :]
                    apart = np.bitwise_count(rows ^ mine).sum(axis=1, dtype=np.int64)
                    for j in near[(q + p) * apart <= (q - p) * (n[near] + n[i])].tolist():
                        if root[j] != root[i]:
                            out.append((i, j))
                            root[root == root[j]] = root[i]
    return out


def links_of(sets: list[np.ndarray], share: tuple[int, int] = SHARE) -> list[tuple[int, int]]:
    """Links that join all sets reachable through pairs of the similarity or more."""
    p, q = share
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if q * both >= p * (size[0] + size[1] - both) else []
    whose = np.repeat(np.arange(n), size)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(member, kind="stable")
    has, start = whose[order], np.r_[0, np.cumsum(np.bincount(member))]
    first = np.r_[0, np.cumsum(size)]
    root, todo, out = np.arange(n), np.ones(n, bool), []
    while True:
        left = np.flatnonzero(todo)
        many = np.bincount(root, minlength=n)
        if len(left) == 0 or (root[left] == root[left[0]]).all():
            return out
        i = left[np.argmin(many[root[left]])]
        todo[i] = False
        m = member[first[i] : first[i + 1]]
        met = np.concatenate([has[start[x] : start[x + 1]] for x in m.tolist()])
        both = np.bincount(met, minlength=n)
        for j in np.flatnonzero(q * both >= p * (size + size[i] - both)).tolist():
            if root[j] != root[i]:
                out.append((int(i), j))
                root[root == root[j]] = root[i]


def _possible_within(groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for g in b.column(0):
                node, n = g.values.field("node").to_pylist(), g.values.field("n").to_numpy()
                for i, j in possible(n, g.values.field("sketch").to_pylist(), share):
                    a.append(node[i])
                    z.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(fn, "a long, b long")


def _links_within(groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for g in b.column(0):
                rows = g.values
                nodes, lists = rows.field("node").to_pylist(), rows.field("has")
                sets = [x.values.to_numpy().view(np.uint64) for x in lists]
                for i, j in links_of(sets, share):
                    a.append(nodes[i])
                    z.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(fn, "a long, b long")


def _placed(lists: DataFrame, direct: int) -> DataFrame:
    """list, node of the lists `members`, those over `direct` as pairs of their blocks."""
    half = max(1, direct // 2)
    blocks = f"""case when size(members) <= {direct} then array(members) else flatten(transform(sequence(0, int(ceil(size(members) / {half})) - 2),
        i -> transform(sequence(i + 1, int(ceil(size(members) / {half})) - 1), j -> concat(slice(members, i * {half} + 1, {half}), slice(members, j * {half} + 1, {half}))))) end"""
    return lists.select(F.explode(F.expr(blocks)).alias("members")).select(F.xxhash64("members").alias("list"), F.explode("members").alias("node"))


def _common(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, sorted, and how many."""
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(text).distinct()
    has = append(some, [text], "_has array<long>", lambda x: [[shingles(v or b"", words).view(np.int64) for v in x.cast(pa.binary()).to_pylist()]], [])
    top = has.select(F.explode("_has").alias("h")).groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, share: tuple[int, int] = SHARE, direct: int = DIRECT) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable through pairs), a row for each row that has an id."""
    docs = docs.select(doc_id, text).filter(F.col(doc_id).isNotNull())
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, text, words))

    def mark(x: pa.Array) -> list:
        every = [shingles(v or b"", words) for v in x.cast(pa.binary()).to_pylist()]
        return [[node_of(s) for s in every], [len(s) for s in every], [sketch(s) for s in every], [prefix(s, *sent.value, share).view(np.int64) for s in every]]

    node, n, bits, first = fresh(docs, "node", "n", "sketch", "first")
    marked = settle(append(docs, [text], f"{node} long, {n} long, {bits} binary, {first} array<long>", mark, [doc_id]).toDF("id", "node", "n", "sketch", "first"))
    seen = marked.groupBy("node").agg(F.min("id").alias("low"), *(F.any_value(c).alias(c) for c in ("n", "sketch", "first")))
    dealt = seen.select("node", F.explode("first").alias("h")).repartition("h")
    shared = dealt.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("h")
    lists = dealt.join(shared, "h").groupBy("h").agg(F.sort_array(F.collect_list("node")).alias("members")).select("members").distinct()
    placed = _placed(lists, direct)
    about = placed.join(seen.select("node", "n", "sketch"), "node").groupBy("list").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("g")).select("g")
    may = components(_possible_within(about, share))
    whole_lists = may.groupBy("root").agg(F.sort_array(F.array_union(F.collect_list("node"), F.array("root"))).alias("members")).select("members")
    placed = settle(_placed(whole_lists, direct))
    one = settle(marked.join(placed.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id")).select("id", F.lit(0).cast("long").alias("check")))
    (zero,) = fresh(docs, "zero")

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        every = [shingles(v or b"", words) for v in b.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(s) for s in every], pa.int64()), pa.array([s.view(np.int64) for s in every], pa.list_(pa.int64()))], names=["id", "node", "has"])

    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, node long, has array<long>"
    sets = Likely(one).of(docs.withColumn(zero, F.lit(0).cast("long")), True, doc_id, zero, whole, kind)
    sets = sets.join(one.select("id"), "id", "left_semi").select("node", "has").dropDuplicates(["node"])
    groups = placed.join(sets, "node").groupBy("list").agg(F.collect_list(F.struct("node", "has")).alias("g")).select("g")
    roots = components(_links_within(groups, share))
    near = seen.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = near.join(near.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return marked.select(F.col("id").alias(doc_id), "node").join(named, "node").select(doc_id, "component_id")
