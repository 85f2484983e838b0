"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length (1 to `size`) matters for a plan, so tasks tokenize and cut, Spark counts the
lengths, and the plan is made from that histogram, whose size is fixed: from the longest length down, indexes of
single, pair and triple length sums, kept under the counts that are left, find combinations that exactly fill the gap,
taken as often as the counts allow; where none does, the closest sum from below is the best fit, and its gap is filled on. The plan lists ranges of pieces per length, and a range join gives
each piece its sequence. Full pieces need no partner.

A document's ids are its text's ids and the end id. Documents longer than `size` are cut from the end, so only the first
piece can be shorter. Texts are split at white space before tokenizing, where this vocabulary's pattern always splits
too, so each different word of a batch is encoded once and ids equal those of the whole text.

Defined results: null and empty texts are the end id alone; equal rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.bpe import byte_letters
from tallywright.llm.common import append, fresh, memo, numbered, settle

SIZE, END = 1024, 2
WHITE = "\t-\r \x85\xa0  -     　"
_chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
_kept: dict = {}


class Encoder:
    """Texts to their ids as little-endian 32-bit numbers.

    A batch of texts is split at spaces, and each different word that isn't remembered is encoded once: those of Latin
    letters in one call of a second library with the same vocabulary, all others by the file's own library. A space
    before a character that isn't white always opens a token, so words can be encoded side by side. Texts with a
    space between white characters, where that space doesn't open one, and with special tokens are cut into chunks.
    """

    def __init__(self, path: str, bound: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.bound = path, bound
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        self.latin = tiktoken.Encoding("latin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.n_bytes[list(ranks.values())] = [len(b) for b in ranks]

    def __call__(self, text: str) -> bytes:
        return self.all(pa.array([text]))[0]

    def all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Words that a batch has twice are remembered for the next ones, up to a bound."""
        kept = memo(self.path)
        words, chunks = kept.setdefault("words", {}), kept.setdefault("chunks", {})
        if len(words) + len(chunks) > self.bound:
            words.clear()
            chunks.clear()
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, f"[{WHITE}] (?:[{WHITE}]|$)")
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        split = pc.split_pattern(pc.if_else(hard, "", texts), " ")
        found = split.flatten().dictionary_encode()
        at, ends, listed = found.indices.to_numpy(), split.offsets.to_numpy().tolist(), _strings(found.dictionary)
        ids = list(map(words.get, listed))
        lost = np.array([k for k, x in enumerate(ids) if x is None], np.int64)
        often = np.bincount(at, minlength=len(listed)) > 1
        for k, x in zip(lost.tolist(), self._words(found.dictionary.take(pa.array(lost)), chunks), strict=True):
            ids[k] = x
            if often[k]:
                words[listed[k]] = x
        first = self._chunks([listed[at[lo]] for lo in ends[:-1]], chunks)  # no space before it
        out = [x + b"".join(map(ids.__getitem__, at[lo + 1 : hi].tolist())) for x, lo, hi in zip(first, ends[:-1], ends[1:], strict=True)]
        for k, x in zip(np.flatnonzero(hard).tolist(), self._chunks(_strings(texts.filter(hard)), chunks), strict=True):
            out[k] = x
        return out

    def _words(self, words: pa.Array, known: dict[str, bytes]) -> list[bytes]:
        """The ids of each word with a space before it."""
        other = np.asarray(pc.match_substring_regex(words, f"^(?:[{WHITE}]|$)|[^\\x00-\u024f]"))
        plain, out = words.filter(pa.array(~other)), np.empty(len(words), object)
        ids = np.array(self.latin("".join(" " + w for w in _strings(plain))), "<u4")
        last = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(pc.binary_length(plain).to_numpy() + 1)) + 1
        ends, raw = [0, *(4 * last).tolist()], ids.tobytes()
        out[~other] = [raw[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        out[other] = self._chunks([" " + w for w in _strings(words.filter(pa.array(other)))], known)
        return out.tolist()

    def _chunks(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, cut at white space, where the vocabulary's pattern always splits."""
        cut = []
        for text in texts:
            parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
            cut.append([c for p in parts for c in ([p] if p in self.special else _chunks(p))])
        new = {c for chunks in cut for c in chunks if c not in known}
        other = [c for c in new if max(c) > "\u024f" or c in self.special]
        for c in new.difference(other):
            known[c] = np.array(self.latin(c), "<u4").tobytes()
        for c, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


def encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked for) of every document."""
    (made,) = fresh(docs, "made")
    kind = "start:long,length:long,ids_crc32:long" + ",ids:array<int>" * with_ids
    last = np.array([end], "<u4").tobytes()

    def fn(texts: pa.Array) -> list:
        out = []
        for ids in encoder(path).all(texts):
            ids += last
            out.append([{"start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])} | ({"ids": np.frombuffer(ids[4 * s : 4 * (s + n)], "<u4").astype(np.int32).tolist()} if with_ids else {}) for s, n in cut(len(ids) // 4, size)])
        return [out]

    return append(docs.select(doc_id, text), [text], f"{made} array<struct<{kind}>>", fn, [doc_id]).select(doc_id, F.posexplode(made).alias("piece", made)).select(doc_id, "piece", f"{made}.*")


class Sums:
    """By sum, how many combinations of one, two and three pieces there are among the pieces left of each length."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        self.of = np.zeros((4, size + 1), np.int64)
        for length, n in counts.items():
            self.change(length, n)

    def change(self, x: int, n: int) -> None:
        """n more pieces (or fewer) of length x; only combinations with one, two or three of them come or go."""
        before, self.left[x] = self.left[x], self.left[x] + n
        for k in (1, 2, 3):
            if before < k <= self.left[x]:
                self._count(x, k, 1)
        for k in (3, 2, 1):
            if self.left[x] < k <= before:
                self._count(x, k, -1)

    def _count(self, x: int, k: int, sign: int) -> None:
        """Combinations with exactly k pieces of length x come (1) or go (-1); those with more aren't counted just now."""
        _, one, two, three = self.of
        top = len(one) - x * k
        if top <= 0:
            return
        others = one.copy()
        others[x] = 0
        if k == 1:
            if sign < 0:
                two[x:] -= others[:top]
            three[x:] += sign * two[:top]
            if sign > 0:
                two[x:] += others[:top]
            one[x] += sign
        elif k == 2:
            two[2 * x] += sign
            three[2 * x :] += sign * others[:top]
        else:
            three[3 * x] += sign

    def _pair(self, total: int) -> tuple[int, int] | None:
        for a in np.flatnonzero(self.of[1, (total + 1) // 2 : total])[::-1] + (total + 1) // 2:
            if self.left[total - a] > (2 * a == total):
                return int(a), int(total - a)
        return None

    def closest(self, gap: int, most: int) -> tuple[int, ...]:
        """At most `most` (up to three) of the lengths left, with the largest sum that isn't over the gap."""
        sums = np.flatnonzero(self.of[1 : most + 1, : gap + 1].any(axis=0))
        if not len(sums):
            return ()
        total = int(sums[-1])
        if self.of[1, total]:
            return (total,)
        if self.of[2, total]:
            return self._pair(total)
        for a in np.flatnonzero(self.of[1, :total])[::-1].tolist():
            if self.of[2, total - a]:
                self.change(a, -1)
                pair = self._pair(total - a)
                self.change(a, 1)
                if pair:
                    return (a, *pair)
        raise AssertionError("a sum without a combination")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences of those that combine up to three, two or one length at a time."""
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences take each, from the number of pieces of each length.

    The longest length left opens a sequence. Its gap is filled exactly by up to `most` lengths if their counts
    allow it, else as closely as they can, and so on with the gap that remains; the combination is then taken as often
    as the counts last.
    """
    sums, out = Sums(counts, size), []
    for length in range(size, 0, -1):
        while sums.left[length]:
            sums.change(length, -1)
            combination, gap = [length], size - length
            while gap and (more := sums.closest(gap, most)):
                for x in more:
                    sums.change(x, -1)
                combination += more
                gap -= sum(more)
            uses = Counter(combination)
            n = 1 + min(sums.left[x] // k for x, k in uses.items())
            for x, k in uses.items():
                sums.change(x, -k * (n - 1))
            out.append((tuple(combination), n))
    return out


def ranges(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first rank, number of ranks, first sequence, offset: rank first + k stands in sequence first + k."""
    out, used, sequence = [], {}, 0
    for combination, n in planned:
        offset = 0
        for length in combination:
            out.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return out


def pack(cut_pieces: DataFrame, doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    cut_pieces = settle(cut_pieces)
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # one row per length
    rows = ranges(plan(counts, size))
    by_length: dict[int, list[dict]] = {}
    for length, first, n, sequence, offset in rows:
        by_length.setdefault(length, []).append({"first": first, "n": n, "sequence": sequence, "offset": offset})
    schema = "length long, at array<struct<first:long,n:long,sequence:long,offset:long>>"
    where = spark.createDataFrame([(k, v) for k, v in by_length.items()], schema)
    ranked = numbered(cut_pieces, ["length"], [doc_id, "piece", "ids_crc32"], "rank").join(where, "length")

    def place(ranks: pa.Array, at: pa.Array) -> list:
        r, sequence, offset = ranks.to_numpy(), np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        parents = at.value_lengths().to_numpy()
        ends = np.cumsum(parents)
        fields = [f.to_numpy() for f in at.flatten().flatten()]
        for i in range(len(r)):
            lo, hi = ends[i] - parents[i], ends[i]
            k = lo + int(np.searchsorted(fields[0][lo:hi], r[i], "right")) - 1
            sequence[i], offset[i] = fields[2][k] + r[i] - fields[0][k], fields[3][k]
        return [sequence, offset]

    return append(ranked, ["rank", "at"], "sequence_id long, offset long", place, cut_pieces.columns)
