"""Repeated substrings over a whole corpus by prefix-free parsing.

Minima of a rolling hash are triggers. The string of `length` bytes at a start is named by its first trigger (the
leftmost minimum among its first `window` grams) and by the phrase there, of length - window + 1 bytes: both lie inside
the string, so equal strings have the same phrase at the same distance. Neighbouring starts with one trigger form a
run, so the corpus order of suffixes is made for runs, about one per half window, and not for bytes:

1. the parse: a row per run with a digest of its phrase and one of all its bytes (up to the end of its last string);
2. runs whose phrase occurs once go; sorting by digests brings equal ones together;
3. runs equal as a whole repeat at each of their starts, and one of each stands for all;
4. where one phrase has different runs (edges of repeats), these are parsed again with a smaller window, down to a window
   of one start, where phrase and string are the same.

Only digests and places are shuffled, and the texts of documents that have repeats. Digests are 64 bits for candidates
and 128 bits for decisions. A bitmap of fixed size tells which documents may have repeats; it only saves shuffling.
Keys of many runs are joined from written tables on both sides, so that Spark can split their partitions.

`unit` says what a text is a string of: its bytes, or its words `[^\x20\x09-\x0D]+`, whatever stands between them. Places
and lengths count in units; what is removed is bytes, from the first byte of a passage's first unit to its last unit's last.

Defined results: a null text is empty; texts shorter than `length` keep all; equal rows count as copies of each other;
an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallywright.llm.common import append, fresh, settle

BYTES, WORDS = "bytes", "words"
#: Steps by which a rolling hash doubles: grams of 16 bytes or of 4 words.
STEPS, TILE = {BYTES: (1, 2, 4, 8), WORDS: (1, 2)}, 1 << 18
_word = re.compile(rb"[^ \t-\r]+")
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = [int(x) | 5 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept between batches."""
    size = 1 << max(12, (n - 1).bit_length())
    if (base, size) not in _powers:
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _powers[base, size] = out
    return _powers[base, size][:n]


def symbols(text: bytes, unit: str = BYTES) -> np.ndarray:
    """The units of a text as numbers: its bytes, or digests of its words."""
    if unit == BYTES:
        return np.frombuffer(text, np.uint8)
    digest, parts = xxhash.xxh64_intdigest, text.split()
    return np.fromiter(map(digest, parts), np.uint64, len(parts))


def _spread(data: np.ndarray, lane: int) -> np.ndarray:
    """A random odd number for each symbol."""
    if data.dtype == np.uint8:
        return _VALUES[lane][data]
    x = data * _VALUES[lane][1]
    return (x ^ (x >> np.uint64(31))) * _VALUES[lane][2] | np.uint64(1)


class Digests:
    """Digests of any substring of `data` from prefix sums, in two independent lanes."""

    def __init__(self, data: np.ndarray):
        self.prefix, self.n = [], len(data)
        for lane in range(2):
            p = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_spread(data, lane) * _power(_BASES[lane], len(data)), out=p[1:])
            self.prefix.append(p)
        self.back = [pow(b, -1, 1 << 64) for b in _BASES]

    def of(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.prefix[lane][end] - self.prefix[lane][start]) * _power(self.back[lane], self.n + 1)[start]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def _minima(data: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window of grams, the place of the leftmost gram with the smallest hash."""
    h = _spread(data, 0) >> np.uint64(32)
    for k, mult in zip(STEPS[BYTES if data.dtype == np.uint8 else WORDS], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=False):
        h = (h[:-k] * np.uint64(mult) + h[k:]) & np.uint64(0xFFFFFFFF)
    h = ((h * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)) << np.uint64(32)
    h |= np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= window:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    if k < window:
        h = np.minimum(h[: len(h) - (window - k)], h[window - k :])
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def tiles(texts: list[np.ndarray], length: int, size: int = TILE) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts end to end in pieces of bounded size: symbols, and (text, its offset, place in the piece, starts) per part."""
    parts, spans, at = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text) - length + 1, size):
            part = text[lo : lo + size + length - 1]
            parts.append(part)
            spans.append((i, lo, at, len(part) - length + 1))
            at += len(part)
            if at >= size:
                yield np.concatenate(parts), spans
                parts, spans, at = [], [], 0
    if parts:
        yield np.concatenate(parts), spans


def parse(texts: list[np.ndarray], length: int, window: int, parts: list | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts with one trigger: text, first start, number of starts, digest of the phrase, digest of the run.
    parts: arrays of first starts and numbers of starts per text, if not all starts are wanted."""
    phrase = length - window + 1
    for data, spans in tiles(texts, length):
        n = len(data) - length + 1
        first, own = _minima(data, window)[:n], np.full(n, -1, np.int64)
        for k, (i, lo, at, many) in enumerate(spans):
            if parts is None:
                own[at : at + many] = k
                continue
            start, stop = np.maximum(parts[i][0] - lo, 0), np.minimum(parts[i][0] + parts[i][1] - lo, many)
            start, stop = start[start < stop], stop[start < stop]
            edge = np.zeros(many + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, stop, -1)
            own[at : at + many][np.cumsum(edge[:-1]) > 0] = k
        new = np.ones(n, bool)
        new[1:] = (first[1:] != first[:-1]) | (own[1:] != own[:-1])
        start = np.flatnonzero(new)
        size = np.diff(start, append=n)
        good = own[start] >= 0
        start, size = start[good], size[good]
        if len(start):
            d, k, table = Digests(data), own[start], np.array(spans, np.int64)
            yield table[k, 0], start - table[k, 2] + table[k, 1], size, d.of(0, first[start], first[start] + phrase), d.of(1, start, start + size + length - 1)


def _utf8(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def runs(keyed: DataFrame, length: int, window: int, unit: str = BYTES) -> DataFrame:
    """The parse of documents (id, check, text, and the wanted starts if there is a fourth column): a row per run."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, checks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            parts = [[x.values.field(f).to_numpy() for f in (0, 1)] for x in b.column(3)] if b.num_columns > 3 else None
            for doc, start, n, key, whole in parse([symbols(x, unit) for x in _utf8(b.column(2))], length, window, parts):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whole), pa.array(ids[doc]), pa.array(checks[doc]), pa.array(start), pa.array(n.astype(np.int32))], names=["key", "whole", "id", "check", "start", "n"])

    return keyed.mapInArrow(fn, "key long, whole long, id long, check long, start long, n int")


class Likely:
    """Which documents (id, check) of a table there may be: a bitmap of 2 ** 24 bits, whatever the table's size."""

    BITS = 1 << 24

    def __init__(self, table: DataFrame):
        bit = F.pmod(F.xxhash64("id", "check"), F.lit(self.BITS))
        rows = table.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        bits = np.zeros((self.BITS >> 15) + 1, "V4096")
        for r in rows.collect():
            bits[r["k"] - 1] = bytes(r["bits"])
        self.sent = table.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def of(self, docs: DataFrame, want: bool, id_: str = "id", check: str = "check", then=None, schema=None) -> DataFrame:
        """The documents that may be in the table, or those that aren't; `then` turns each batch of them into `schema`."""
        (bit,) = fresh(docs, "bit")
        sent, columns = self.sent, docs.columns

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(len(columns)).to_numpy()
                hit = (sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                b = pa.RecordBatch.from_arrays(b.columns[:-1], names=columns).filter(pa.array(hit == want))
                if b.num_rows:
                    yield then(b) if then else b

        # a position counts from 0 in its bucket, buckets from 1
        dealt = docs.withColumn(bit, F.pmod(F.xxhash64(id_, check), F.lit(self.BITS)))
        dealt = dealt.withColumn(bit, (F.bitmap_bucket_number(bit) - 1) * 32768 + F.bitmap_bit_position(bit))
        return dealt.mapInArrow(fn, schema or docs.schema)


def repeated_starts(keyed: DataFrame, length: int = 400, windows: tuple[int, ...] | None = None, unit: str = BYTES) -> DataFrame:
    """id, check, start, end: strings of `length` units that also start elsewhere cover these ranges."""
    windows = windows or (length // 2, *((length // 20,) if length >= 100 else ()), 1)
    covered, texts = [], keyed
    for window in windows:
        parsed = runs(texts, length, window, unit)
        again = settle(parsed.groupBy("key").count().filter("count > 1").select("key"))
        found = settle(parsed.join(again, "key"))
        wholes = settle(found.groupBy("key", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("id", "check", "start", "n")).alias("one")))
        equal = found.join(wholes.filter("copies > 1").select("key", "whole"), ["key", "whole"])
        covered.append(equal.select("id", "check", "start", (F.col("start") + F.col("n") + length - 1).alias("end")))
        if window > 1:
            mixed = settle(wholes.groupBy("key").count().filter("count > 1").select("key"))
            todo = settle(wholes.join(mixed, "key").select("one.*").groupBy("id", "check").agg(F.collect_list(F.struct("start", "n")).alias("todo")))
            texts = Likely(todo).of(keyed, True).join(todo, ["id", "check"])
    out = covered[0]
    for more in covered[1:]:
        out = out.unionByName(more)
    return out


def _key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """Two numbers that name a row: its id (a digest of it, if ids aren't numbers) and a digest of its text."""
    number = F.xxhash64(doc_id) if docs.schema[doc_id].dataType.typeName() == "string" else F.col(doc_id).cast("long")
    return F.coalesce(number, F.lit(-(1 << 62))), F.xxhash64(text)


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id", windows: tuple[int, ...] | None = None, unit: str = BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, the removed ranges, the remaining bytes `kept` and
    their text, without characters that a range's end cuts in two; other columns stay."""
    id_, check, spans = fresh(docs, "id", "check", "spans")
    a, b = _key(docs, doc_id, text)
    covered = repeated_starts(docs.select(a.alias("id"), b.alias("check"), F.col(text).alias("text")), length, windows, unit)
    listed = settle(covered.groupBy("id", "check").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    likely, keyed = Likely(listed), docs.withColumns({id_: a, check: b})
    added = "n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary, kept_text string"
    touched = likely.of(keyed, True, id_, check).join(listed.withColumnsRenamed({"id": id_, "check": check, "spans": spans}), [id_, check], "left")
    touched = append(touched, [text, spans], added, lambda x, r: _cut(x, r, unit), docs.columns)
    kinds, at, names = to_arrow_schema(touched.schema), keyed.columns.index(text), docs.columns

    def untouched(b: pa.RecordBatch) -> pa.RecordBatch:
        made = _cut(b.column(at), None)
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), *(pa.array(x, f.type) for x, f in zip(made, list(kinds)[len(names) :], strict=True))], names=kinds.names)

    return touched.unionByName(likely.of(keyed, False, id_, check, untouched, touched.schema))


def _cut(texts: pa.Array, ranges: pa.Array | None, unit: str = BYTES) -> list:
    n_bytes, removed, n_spans, kept, merged = [], [], [], [], []
    for i, raw in enumerate(_utf8(texts)):
        out, gone, at = [], [], 0
        if ranges is not None and ranges[i].is_valid:
            r = ranges[i].values
            order = np.argsort(s := r.field(0).to_numpy(), kind="stable")
            s, e = s[order], np.maximum.accumulate(r.field(1).to_numpy()[order])
            new = np.r_[True, s[1:] > e[:-1]]
            s, e = s[new], e[np.r_[new[1:], True]]
            if unit == WORDS:
                place = np.array([m.span() for m in _word.finditer(raw)], np.int64)
                s, e = place[s, 0], place[e - 1, 1]
            gone = list(zip(s.tolist(), e.tolist(), strict=True))
        for lo, hi in gone:
            out.append(raw[at:lo])
            at = hi
        kept.append(b"".join([*out, raw[at:]]))
        n_bytes.append(len(raw))
        removed.append(len(raw) - len(kept[-1]))
        n_spans.append(len(gone))
        merged.append([{"start": lo, "end": hi} for lo, hi in gone])
    return [n_bytes, removed, n_spans, merged, kept, [k.decode(errors="ignore") for k in kept]]
