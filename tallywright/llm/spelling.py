"""Spelling variants: words one inserted, deleted or replaced letter apart, and the commoner form of each.

Words are laid out in a trie by how many of their letters fall in each of `GROUPS` letter groups, a group a level. Near
words' count vectors differ by a surplus and a deficit of one at most, so a depth-first search that spends these two
budgets meets all of them at the trie's leaves, where words are verified letter by letter.

Spark deals the trie out by its upper levels: words that share their first counts make a cell, as many counts as it takes
for the fullest cell to hold `CELL` words. A word goes to its own cell and visits those that its budgets reach, only
upwards, so each pair meets once. Cells that stay fuller with all counts are linked by an equi-join instead, on the place
and the rest of a word without one letter, which gives the same pairs and has no group to hold in memory.

Defined results: null and empty texts have no words; equal rows count as often as they stand; a null id reads as an empty
one; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import settle

GROUPS, CELL = 12, 50_000
LEAST_LENGTH, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
#: Distinct words that a task counts before it hands them on.
GATHER = 200_000
_runs = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: str, text: str) -> Counter:
    """Counts of a text's runs of letters, A-Z lower-cased; a run loses a letter where DROP divides its checksum."""
    seen = Counter(_runs.findall(text.encode().lower().decode()))
    before, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in seen.items():
        h = zlib.crc32(run.encode(), before)
        if h % DROP == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def count_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of docs (doc_id, text) that occur at least `least` times."""

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update(words_of(i, text or ""))
                if len(seen) > GATHER:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    return rows.mapInArrow(fn, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def vector(word: str) -> bytes:
    """How many letters fall in each group, 255 at most, which keeps differences of one or less."""
    counts = [0] * GROUPS
    for letter in word:
        counts[ord(letter) % GROUPS] += 1
    return bytes(min(c, 255) for c in counts)


class Leaf:
    """The words of one vector, found again by what is left of them without one letter. Words are (word, n)."""

    def __init__(self, words: list[tuple]):
        self.whole, self.lengths = {w: (w, n) for w, n in words}, {len(w) for w, _ in words}
        self.rests: dict[str, list] = {}
        for x in words:
            for at, rest in enumerate(rests_of(x[0])):
                self.rests.setdefault(rest, []).append((at, x))

    def near(self, word: str, rests: list[str]) -> Iterator[tuple]:
        """The words that differ from this one by exactly one inserted, deleted or replaced letter, some more than once.

        rests: what is left of the word without each of its letters."""
        n = len(word)
        if n in self.lengths:
            for at, rest in enumerate(rests):
                for place, x in self.rests.get(rest, ()):
                    if place == at and x[0] != word and len(x[0]) == n:
                        yield x
        if n - 1 in self.lengths:
            for rest in rests:
                if rest in self.whole:
                    yield self.whole[rest]
        if n + 1 in self.lengths:
            for _, x in self.rests.get(word, ()):
                yield x


def rests_of(word: str) -> list[str]:
    return [word[:at] + word[at + 1 :] for at in range(len(word))]


def reached(counts: bytes) -> list[bytes]:
    """The other counts within a surplus and a deficit of one."""
    out = []
    for up in range(-1, len(counts)):
        for down in range(-1, len(counts)):
            if up != down and (up < 0 or counts[up] < 255) and (down < 0 or counts[down] > 0):
                moved = bytearray(counts)
                if up >= 0:
                    moved[up] += 1
                if down >= 0:
                    moved[down] -= 1
                out.append(bytes(moved))
    return out


def trie(vectors: Iterator[bytes]) -> dict:
    """Nested dictionaries, a level for each count."""
    root: dict = {}
    for v in vectors:
        node = root
        for c in v:
            node = node.setdefault(c, {})
    return root


def search(root: dict, leaves: dict, counts: bytes) -> Iterator[bytes]:
    """The leaves' vectors within a surplus and a deficit of one of `counts`; with both spent the rest of the way is known."""
    waiting = [(root, b"", 1, 1)]
    while waiting:
        node, way, surplus, deficit = waiting.pop()
        if not surplus and not deficit or len(way) == len(counts):
            whole = way + counts[len(way) :]
            if whole in leaves:
                yield whole
            continue
        want = counts[len(way)]
        if want in node:
            waiting.append((node[want], way + counts[len(way) : len(way) + 1], surplus, deficit))
        if surplus and want + 1 in node:
            waiting.append((node[want + 1], way + bytes([want + 1]), 0, deficit))
        if deficit and want - 1 in node:
            waiting.append((node[want - 1], way + bytes([want - 1]), surplus, 0))


def pairs_within(own: dict[bytes, list], visiting: dict[bytes, list]) -> Iterator[tuple]:
    """Near pairs of the words of a cell, and of its words and visiting ones; words are (word, n), by vector."""
    root, leaves = trie(own), {v: Leaf(words) for v, words in own.items()}
    for queries, inside in ((own, True), (visiting, False)):
        for v, asked in queries.items():
            found = [leaf for leaf in search(root, leaves, v) if not inside or leaf >= v]
            for a in asked:
                rests = rests_of(a[0])
                for leaf in found:
                    for b in set(leaves[leaf].near(a[0], rests)):
                        if not (inside and leaf == v and b < a):
                            yield *a, *b


def _by_cells(words: DataFrame, depth: int) -> DataFrame:
    """a, an, b, bn: near pairs found in the cells of words (word, n, vec)."""
    names = ["cell", "word", "n", "own"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for word, n, vec in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cell = vec[:depth]
                rows.append((cell, word, n, True))
                rows += ((other, word, n, False) for other in reached(cell) if other > cell)
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], names=names)

    def meet(t: pa.Table) -> pa.Table:
        sides: tuple = defaultdict(list), defaultdict(list)
        for word, n, own in zip(*(t[c].to_pylist() for c in names[1:]), strict=True):
            sides[not own][vector(word)].append((word, n))
        found = list(zip(*pairs_within(*sides), strict=True)) or [[]] * 4
        return pa.table({k: pa.array(x, pa.string() if len(k) == 1 else pa.int64()) for k, x in zip(("a", "an", "b", "bn"), found, strict=True)})

    return words.select("word", "n", "vec").mapInArrow(deal, "cell binary, word string, n long, own boolean").groupBy("cell").applyInArrow(meet, "a string, an long, b string, bn long")


def _by_rest(words: DataFrame, others: DataFrame) -> DataFrame:
    """The near pairs of words and others by equal rests: both without the letter at one place, or the longer without one."""

    def rests(of: DataFrame, a: str) -> DataFrame:
        at = F.sequence(F.lit(1), F.char_length("word"))
        out = of.select(F.col("word").alias(a), F.col("n").alias(a + "n"), F.explode(at).alias("at"))
        return out.withColumn("rest", F.expr(f"concat(left({a}, at - 1), substring({a}, at + 1))"))

    whole = lambda of, a: of.select(F.col("word").alias(a), F.col("n").alias(a + "n"), F.col("word").alias("rest"))
    a, b, columns = rests(words, "a"), rests(others, "b"), ["a", "an", "b", "bn"]
    replaced = a.join(b, ["at", "rest"]).filter("a <> b").select(columns)
    return replaced.unionByName(a.join(whole(others, "b"), "rest").select(columns)).unionByName(whole(words, "a").join(b, "rest").select(columns)).distinct()


def depth_of(words: DataFrame, cell: int) -> int:
    """The fewest counts by which the fullest cell has at most `cell` words, or all."""
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(GROUPS)), lambda k: F.struct(k.alias("k"), F.substring(F.hex("vec"), F.lit(1), 2 * k).alias("p")))).alias("s"))
    fullest = prefixes.groupBy("s.k", "s.p").count().groupBy("k").agg(F.max("count").alias("most"))
    return fullest.filter(F.col("most") <= cell).agg(F.coalesce(F.min("k"), F.lit(GROUPS))).first()[0]


def near_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """a, an, b, bn: every unordered pair of near words (word, n) once, with their counts."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([vector(w) for w in b.column(0).to_pylist()], pa.binary())], names=["word", "n", "vec"])

    laid = settle(words.select("word", "n").mapInArrow(fn, "word string, n long, vec binary"))
    depth = depth_of(laid, cell)
    if depth < GROUPS:
        return _by_cells(laid, depth)
    full = F.broadcast(settle(laid.groupBy("vec").count().filter(F.col("count") > cell).select("vec")))
    hot, rest = laid.join(full, "vec", "left_semi"), laid.join(full, "vec", "left_anti")
    among = _by_rest(hot, hot).filter("a < b")
    return _by_cells(rest, depth).unionByName(among).unionByName(_by_rest(hot, rest))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root: the commonest near word where it is `times` as common, and the last by forms."""
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("less"), F.col("b").alias("near")).alias("s")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("an")).alias("less"), F.col("a").alias("near")).alias("s"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("s").alias("best"))
    fits: Column = -F.col("best.less") >= times * F.col("n")
    out = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        # Each round doubles the way that is followed; counts grow by `times` at each form, so ways are short and end.
        roots = settle(roots)
        if roots.filter("moved").isEmpty():
            break
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
    return out.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs."""
    words = settle(count_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    return forms(words, near_pairs(words, cell)).select("word", "form", "root", "n", "n_near", "form_n")
