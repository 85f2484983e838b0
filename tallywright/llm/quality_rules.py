"""Quality rules: text statistics, then perplexity under an n-gram model that Spark counts over the whole corpus.

The model is an interpolated modified Kneser-Ney model of order 4 over the code points of the running text, one per
language: words are joined by one space, so n-grams cross the ends of words; three start marks stand before a text and an
end mark behind it. Tasks count the 4-grams of their texts and Spark sums the counts; lower orders (continuation
counts), discounts and interpolation weights are joins and aggregations over all of them, whatever their number.

Texts are scored with arrays of sorted 64-bit hashes of 4-grams. The commonest ones, `SENT` at most, are sent to all tasks;
texts name the others that they have, which meet the model by an equi-join on the hash. Every 4-gram has its own
log-probability so, whatever the size of the corpus, and what is sent is bounded.

Bands: per language, the median of the texts' mean negative log-probability, and the median distance from it, both from
histograms; a text outside median +- `width` distances (`LEAST` at least) is rejected. Only texts of at least `MIN_WORDS`
words shape the bands.

Defined results: a null text has no words and fails the base rules; a null language is its own language ""; equal rows
get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import append, fresh, memo, settle, small

MIN_WORDS, WIDTH, LEAST, STEP, SENT = 50, 8.0, 0.05, 0.001, 1 << 21
#: Marks beyond the last code point, and the bits of a symbol in a packed context.
START, END, WIDE = 0x110000, 0x110001, 21
SPACE = "\t\n\x0b\x0c\r "
#: Code points that a task gathers before it counts their 4-grams.
GATHER = 1 << 19
_symbols = re.compile(r"[#*$%&|<>]")


def running(text: str | None) -> str:
    """The words of a text joined by one space."""
    return b" ".join((text or "").encode().split()).decode()


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        many, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if many[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - sum(map(text.count, SPACE)), len(_symbols.findall(text)), len(lines) - len(set(lines)), covered


def _texts(x: pa.Array) -> list[str]:
    return [v or "" for v in x.to_pylist()]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of running texts end to end, each with its end mark; their places in their text; and each text's number of symbols."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    points[points == 10] = END
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return points, np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n), n


def _packed(points: np.ndarray, place: np.ndarray, start: int, wide: int, back: int) -> np.ndarray:
    """The `back` symbols before each one, the nearest lowest, `wide` bits each."""
    out = np.zeros(len(points), np.uint64)
    for k in range(1, back + 1):
        before = np.full(len(points), start, np.uint64)
        before[k:][place[k:] >= k] = points[:-k][place[k:] >= k]
        out |= before << np.uint64(wide * (k - 1))
    return out


def hashes(context: np.ndarray, symbol: np.ndarray, lang: str) -> np.ndarray:
    """The 64-bit hash of each 4-gram of a language."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(xxhash.xxh64_intdigest(lang))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tally(points: np.ndarray, place: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, symbols and counts of the distinct 4-grams that end in lo..hi. The symbols there are numbered in 16 bits,
    so that a 4-gram is one number to sort; a stretch with more symbols than that is cut in two."""
    there = np.zeros(END + 1, bool)
    there[points[max(0, lo - 3) : hi]] = True
    there[START] = True
    known = np.flatnonzero(there)
    if len(known) > 1 << 16:
        parts = [tally(points, place, a, b) for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    number = np.zeros(END + 1, np.uint64)
    number[known] = np.arange(len(known), dtype=np.uint64)
    own = number[points[max(0, lo - 3) : hi]]
    g = np.sort((_packed(own, place[max(0, lo - 3) : hi], int(number[START]), 16, 3) << np.uint64(16) | own)[min(3, lo) :])
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    g, count = g[first], np.diff(first, append=len(g))
    part = [known[(g >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.uint64) for k in range(4)]
    return part[1] | part[2] << np.uint64(WIDE) | part[3] << np.uint64(2 * WIDE), part[0].astype(np.int64), count


def count_grams(docs: DataFrame, text: str, lang: Column) -> DataFrame:
    """lang, context, symbol, key, c: the 4-grams of the corpus, their hashes and their counts."""

    def flush(name: str, texts: list[str]) -> pa.RecordBatch:
        points, place, _ = symbols(texts)
        context, symbol, c = tally(points, place, 0, len(points))
        columns = {"lang": pa.array([name]).take(pa.array(np.zeros(len(c), np.int32))), "context": context.view(np.int64), "symbol": symbol.astype(np.int32), "key": hashes(context, symbol, name).view(np.int64), "c": c}
        return pa.RecordBatch.from_pydict(columns)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        many = 0
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x := running(x):
                    seen.setdefault(name, []).append(x)
                    many += len(x)
                    if many > GATHER:
                        yield from (flush(*kept) for kept in seen.items())
                        seen, many = {}, 0
        yield from (flush(*kept) for kept in seen.items())

    made = docs.select(lang.alias("lang"), text).mapInArrow(fn, "lang string, context long, symbol int, key long, c long")
    return made.groupBy("lang", "context", "symbol").agg(F.min("key").alias("key"), F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, context, symbol, p: the interpolated modified Kneser-Ney probability of the symbol after its context."""
    counts = counts.select("lang", "context", "symbol", "c")
    short = lambda order: F.col("context").bitwiseAND(F.lit((1 << WIDE * (order - 1)) - 1))
    levels = {4: counts}
    for order in (3, 2, 1):
        levels[order] = settle(levels[order + 1].groupBy("lang", short(order).alias("context"), "symbol").agg(F.count("*").alias("c")))
    lower = small(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("q")))
    for order in (1, 2, 3, 4):
        of = [F.sum((F.col("c") == k).cast("double")) for k in (1, 2, 3, 4)]
        y = F.try_divide(of[0], of[0] + 2 * of[1])
        discount = [F.greatest(F.lit(0.0), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.try_divide(of[k], of[k - 1]), F.lit(0.5 * k)))) for k in (1, 2, 3)]
        d = small(levels[order].groupBy("lang").agg(*(x.alias(f"d{k}") for k, x in enumerate(discount, 1))))
        own = levels[order].join(d, "lang").withColumns({"d": F.expr("least(c, case c when 1 then d1 when 2 then d2 else d3 end)"), "suffix": short(max(1, order - 1))})
        sums = settle(own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("free")))
        own = own.join(small(sums) if order == 1 else sums, ["lang", "context"])
        own = own.join(lower, "lang") if order == 1 else own.join(lower.select("lang", F.col("context").alias("suffix"), "symbol", F.col("p").alias("q")), ["lang", "suffix", "symbol"])
        lower = settle(own.select("lang", "context", "symbol", ((F.col("c") - F.col("d") + F.col("free") * F.col("q")) / F.col("total")).alias("p")))
    return lower


class Scores:
    """Log-probabilities behind sorted hashes. A hash's leading bits say where its like begin."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp = np.append(keys[order], np.uint64(2**64 - 1)), np.append(logp[order], np.nan)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The log-probability of each hash; not a number where it isn't there."""
        at = self.first[keys >> self.shift]
        there = self.keys[at]
        out = np.where(there == keys, self.logp[at], np.nan)
        todo = np.flatnonzero(there < keys)
        at = at[todo]
        while len(todo):
            at, want = at + 1, keys[todo]
            there = self.keys[at]
            out[todo] = np.where(there == want, self.logp[at], np.nan)
            further = there < want
            todo, at = todo[further], at[further]
        return out


class Sent:
    """What tasks need to score texts, and the table (key, logp) of what isn't sent to them, or none."""

    def __init__(self, counts: DataFrame, model: DataFrame, most: int = SENT):
        both = settle(counts.join(model, ["lang", "context", "symbol"]).select("key", "c", F.log("p").alias("logp")))
        levels = range(48)
        *many, least = both.agg(*(F.count_if(F.col("c") >= 1 << k) for k in levels), F.coalesce(F.min("logp"), F.lit(0.0))).first()
        rarest = next((1 << k for k in levels if many[k] <= most), 1 << 48)
        rows = both.filter(F.col("c") >= rarest).select("key", "logp").toArrow().combine_chunks()
        arrays = rows["key"].to_numpy().view(np.uint64), rows["logp"].to_numpy()
        self.arrays: Broadcast = model.sparkSession.sparkContext.broadcast(arrays)
        self.others = both.filter(F.col("c") < rarest).select("key", "logp") if rarest > 1 else None
        self.least, self.name = least, uuid.uuid4().hex


def log_likelihood(texts: list[str], langs: list[str], scores: Scores, least: float | None) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """Each running text's sum of log-probabilities, number of symbols, and the hashes that aren't there with their counts;
    with `least` given, those count as that and none is named."""
    sums, many, others = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [[] for _ in texts]
    for name in set(langs):
        todo, size = [], 0
        mine = [i for i, x in enumerate(langs) if x == name and texts[i]]
        for k, i in enumerate(mine):
            todo.append(i)
            size += len(texts[i])
            if size > GATHER // 2 or k == len(mine) - 1:
                points, place, n = symbols([texts[j] for j in todo])
                keys = hashes(_packed(points, place, START, WIDE, 3), points, name)
                p, starts = scores.of(keys), np.cumsum(n) - n
                missing = np.flatnonzero(np.isnan(p))
                p[missing] = least or 0.0
                sums[todo], many[todo] = np.add.reduceat(p, starts), n
                if least is None and len(missing):
                    owner = np.searchsorted(starts, missing, side="right") - 1
                    for j in np.unique(owner).tolist():
                        found = np.unique(keys[missing[owner == j]].view(np.int64), return_counts=True)
                        others[todo[j]] = [{"key": key, "n": c} for key, c in zip(*(x.tolist() for x in found), strict=True)]
                todo, size = [], 0
    return sums, many, others


def bands(surprise: DataFrame, width: float = WIDTH) -> DataFrame:
    """lang, low, high from rows (lang, bin, n) of a histogram of STEP wide bins: median +- width times the median distance from it."""

    def median(of: DataFrame, name: str) -> DataFrame:
        counts = of.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        upto = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("lang").orderBy("bin")), "total": F.sum("n").over(Window.partitionBy("lang"))})
        return small(upto.filter("upto * 2 >= total").groupBy("lang").agg(F.min("bin").alias(name)))

    surprise = settle(surprise.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    mid = median(surprise, "mid")
    away = median(surprise.join(mid, "lang").select("lang", F.abs(F.col("bin") - F.col("mid")).alias("bin"), "n"), "away")
    reach = F.greatest(width * STEP * (F.col("away") + 1), F.lit(LEAST))
    return small(mid.join(away, "lang").select("lang", (F.col("mid") * STEP - reach).alias("low"), (F.col("mid") * STEP + reach).alias("high")))


class Rules:
    """The model of a corpus."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", sent: int = SENT):
        self.text, self.lang = text, lang
        counts = settle(count_grams(docs.select(self._lang().alias("lang"), F.col(text).alias("text")), "text", F.col("lang")))
        self.model = kneser_ney(counts)
        self.sent = Sent(counts, self.model, sent)

    def _lang(self) -> Column:
        return F.coalesce(F.col(self.lang).cast("string"), F.lit(""))

    def measure(self, docs: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
        """The columns `keep` and seven more, by the given names: the five statistics, base_failed and the surprise, which is
        the mean negative log-probability of a symbol of the running text (0 for an empty one)."""
        arrays, name, least = self.sent.arrays, self.sent.name, self.sent.least if self.sent.others is None else None
        lang, total, many, others = fresh(docs, "lang_", "total_", "many_", "others_")

        def fn(x: pa.Array, langs: pa.Array) -> list:
            kept = memo(name)
            if "scores" not in kept:
                kept["scores"] = Scores(*arrays.value)
            texts = _texts(x)
            stats = list(zip(*map(base_statistics, texts), strict=True))
            n, repeated = np.array(stats[0]), np.array(stats[4])
            return [*map(list, stats), (n < MIN_WORDS) | (100 * repeated > 50 * n), *log_likelihood(list(map(running, texts)), langs.to_pylist(), kept["scores"], least)]

        kinds = ["long"] * 5 + ["boolean", "double", "long", "array<struct<key: long, n: long>>"]
        out = append(docs.withColumn(lang, self._lang()), [self.text, lang], ", ".join(f"{a} {b}" for a, b in zip([*names[:6], total, many, others], kinds, strict=True)), fn, keep)
        if self.sent.others is not None:
            out = self._with_others(out, total, others)
        return out.select(*keep, *names[:6], F.when(F.col(many) == 0, 0.0).otherwise(-F.col(total) / F.col(many)).alias(names[6]))

    def _with_others(self, out: DataFrame, total: str, others: str) -> DataFrame:
        """Adds to `total` the log-probabilities of the 4-grams that texts name. Only texts that name some are shuffled."""
        row, key = fresh(out, "row_", "key_")
        plain, naming = out.filter(F.size(others) == 0), settle(out.filter(F.size(others) > 0).withColumn(row, F.monotonically_increasing_id()))
        named = naming.select(row, F.explode(others).alias("named")).select(row, F.col("named.key").alias(key), F.col("named.n").alias("n"))
        logp = self.sent.others.select(F.col("key").alias(key), "logp")
        found = named.join(logp, key, "left").groupBy(row).agg(F.sum(F.col("n") * F.coalesce("logp", F.lit(self.sent.least))).alias("more"))
        added = naming.join(found.select(F.col(row).alias(key), "more"), F.col(row) == F.col(key)).withColumn(total, F.col(total) + F.col("more"))
        return plain.unionByName(added.select(out.columns))


def judged(measured: DataFrame, of: DataFrame, names: list[str], lang: str) -> DataFrame:
    """measured with a last column by the name names[7]: whether no rule rejects the row. of: bands."""
    other, low, high = fresh(measured, "other_", "low_", "high_")
    own = of.select(F.col("lang").alias(other), F.col("low").alias(low), F.col("high").alias(high))
    out = measured.join(own, F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col(other), "left")
    inside = F.coalesce(F.col(names[6]).between(F.col(low), F.col(high)), F.lit(True))
    return out.withColumn(names[7], ~F.col(names[5]) & inside).drop(other, low, high)


def bands_of(measured: DataFrame, names: list[str], lang: str, width: float) -> DataFrame:
    """The bands from measured rows of at least MIN_WORDS words."""
    shaping = measured.filter(F.col(names[0]) >= MIN_WORDS)
    return bands(shaping.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.floor(F.col(names[6]) / STEP).alias("bin"), F.lit(1).alias("n")), width)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "surprise", "kept"]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", width: float = WIDTH, sent: int = SENT) -> DataFrame:
    """A row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity and kept.
    Texts are read twice: to count, and to measure; the bands come from what was measured."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = settle(Rules(docs, sent=sent).measure(docs, NAMES, ["doc_id", "lang"]))
    out = judged(measured, bands_of(measured, NAMES, "lang", width), NAMES, "lang")
    return out.select("doc_id", *NAMES[:6], F.exp("surprise").alias("perplexity"), "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH, sent: int = SENT) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' own columns. Texts are measured once for the bands and again to
    judge, so that they needn't be written beside what was measured."""
    names = fresh(docs, *NAMES)
    rules = Rules(docs, text, lang, sent)
    of = bands_of(rules.measure(docs, names, [lang]), names, lang, width)
    return judged(rules.measure(docs, names, docs.columns), of, names, lang).filter(F.col(names[7])).select(docs.columns)
