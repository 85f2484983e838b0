"""Resampling and features, classifier, differencing, packing sums and the chat log against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.llm import chat, media, packing, quality_classifier, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


def plain_resample(x):
    """Zeros put between samples, one long filter, and every DOWN-th value of what comes out."""
    half = media.TAPS * max(media.UP, media.DOWN)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(media.UP, media.DOWN)) * np.hanning(2 * half + 3)[1:-1]
    wide = np.zeros(len(x) * media.UP)
    wide[:: media.UP] = x
    return np.convolve(wide, h * media.UP / h.sum())[half : half + len(wide)][:: media.DOWN]


def plain_mel(samples):
    rate, f, hop = media.RATE * media.UP / media.DOWN, media.FRAME, media.HOP
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(f // 2 + 1), np.arange(f)) / f)
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / (f - 1)) for k in range(f)])
    out = []
    for k in range(max(1, math.ceil((len(samples) - f) / hop) + 1)):
        part = np.zeros(f)
        own = samples[k * hop : k * hop + f]
        part[: len(own)] = own
        power = np.abs(wave @ (part * window)) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            row.append(sum(p * max(0.0, min((b * rate / f - lo) / (mid - lo), (hi - b * rate / f) / (hi - mid))) for b, p in enumerate(power)))
        out.append([math.log(v + 1e-6) for v in row])
    return np.array(out)


def plain_segments(energy, upper=0.5, lower=-0.5):
    mean, spread, out, since = sum(energy) / len(energy), np.std(energy) + 1e-6, [], None
    for k, e in enumerate(energy):
        z = (e - mean) / spread
        if since is None and z > upper:
            since = k
        elif since is not None and z < lower:
            out.append((since, k))
            since = None
    return out + ([(since, len(energy))] if since is not None else [])


def test_op6_features_equal_plain_ones():
    rng = np.random.default_rng(4)
    assert media.UP > 1 and media.DOWN > 1
    for n in (64, 640, 6400):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        y = plain_resample(x)
        assert np.allclose(media.resample(x.astype(np.float32)), y, atol=1e-5) and len(y) == math.ceil(n * media.UP / media.DOWN)
        want = plain_mel(y)
        tensors, spans, found = media.analyse(payload)
        flat = tensors.reshape(-1, media.MELS)
        assert np.allclose(flat[: len(want)], want, atol=1e-2) and np.allclose(flat[len(want) :], math.log(1e-6))
        second = media.HOP * media.DOWN / (media.RATE * media.UP)
        assert len(spans) == math.ceil(len(want) / media.TENSOR) and math.isclose(spans[-1][1], len(want) * second)
        assert found == [(a * second, b * second) for a, b in plain_segments(flat[: len(want)].mean(axis=1))]


def test_op6_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_media_columns(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        back = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))
        assert r.media_bytes == 44 + len(back) and r.feature.startswith(f"{math.ceil(max(1, math.ceil((math.ceil(len(back) * 2 / 3) - 256) / 128) + 1) / 64)}x64x32:")


def test_op7_fit_equals_a_plain_one():
    rnd = random.Random(2)
    rows = [sorted(rnd.sample(range(40), 8)) for _ in range(30)]
    labels = [int(sum(x) > 150) for x in rows]
    cost, size = 0.1, 1 << quality_classifier.BITS
    r = []
    for j in range(40):
        p, q = (1 + sum(j in x for x, y in zip(rows, labels) if y == side) for side in (1, 0))
        p_all, q_all = (size + 8 * labels.count(side) for side in (1, 0))
        r.append(math.log(p / p_all) - math.log(q / q_all))
    w, bias, alpha = [0.0] * 40, 0.0, [0.0] * 30
    weight = min(10.0, max(1, sum(labels)) / max(1, len(labels) - sum(labels)))
    order = np.random.default_rng(11)
    for _ in range(12):
        for i in order.permutation(30):
            side = 1 if labels[i] else -1
            slope = side * (sum(w[j] * r[j] for j in rows[i]) + bias) - 1
            new = min(cost if labels[i] else cost * weight, max(0.0, alpha[i] - slope / (1 + sum(r[j] ** 2 for j in rows[i]))))
            for j in rows[i]:
                w[j] += (new - alpha[i]) * side * r[j]
            bias += (new - alpha[i]) * side
            alpha[i] = new
    got, b = quality_classifier.fit([np.array(x) for x in rows], np.array(labels))
    assert np.allclose(got[:40], [x * y for x, y in zip(w, r)], atol=1e-5) and abs(b - bias) < 1e-9 and not got[40:].any()


def test_op7_trains_on_odd_rows(spark):
    docs = spark.createDataFrame([(f"d{k}", None if k == 7 else "good words here" if k % 2 else "### $$$", k) for k in range(60)] * 2, "doc_id string, text string, id long")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(60)] * 2 + [(None, 1), ("d1", None), ("d2", 7)], "doc_id string, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == 120 and all(r.predicted == r.id % 2 for r in got if r.text)
    assert quality_classifier.train(docs.limit(0), labels) is None and quality_classifier.train(docs, labels, sample=1) is None


def plain_differencing(sizes, k):
    """The two partitions of largest spread are combined, the fullest part of one with the emptiest of the other."""
    heap = [(i, sorted([(s, [i])] + [(0, [])] * (k - 1), key=lambda p: p[0])) for i, s in enumerate(sizes)]
    made = len(heap)
    while len(heap) > 1:
        heap.sort(key=lambda h: (-(h[1][-1][0] - h[1][0][0]), h[0]))
        (_, a), (_, b) = heap[:2]
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: p[0])
        heap = [*heap[2:], (made, joined)]
        made += 1
    return [p[0] for p in heap[0][1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=25), st.integers(2, 5))
def test_op10_block_equals_plain_differencing(sizes, k):
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    total, where = sharding.differencing(sums)
    assert total.tolist() == plain_differencing(sizes, k)
    loads = Counter()
    for s, w in zip(sizes, where):
        loads[int(w[0])] += s
    assert [loads[p] for p in range(k)] == total.tolist()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 4), max_size=7), st.lists(st.tuples(st.integers(1, 20), st.integers(-4, 4)), max_size=8), st.integers(1, 24))
def test_op5_sums_equal_all_combinations(counts, steps, gap):
    index, left = packing.Sums(counts, 24), Counter(counts)
    for x, n in steps:
        n = max(n, -left[x])
        index.change(x, n)
        left[x] += n
    bag = [x for x, n in left.items() for _ in range(min(n, 3))]
    combos = defaultdict(set)
    for i in range(len(bag)):
        combos[1].add((bag[i],))
        for j in range(i):
            combos[2].add(tuple(sorted((bag[i], bag[j]))))
            for k in range(j):
                combos[3].add(tuple(sorted((bag[i], bag[j], bag[k]))))
    for n in (1, 2, 3):
        by_sum = Counter(sum(c) for c in combos[n])
        assert index.of[n].tolist() == [by_sum[s] for s in range(25)]
    for most in (1, 2, 3):
        fits = [sum(c) for n in range(1, most + 1) for c in combos[n] if sum(c) <= gap]
        found = index.closest(gap, most)
        assert sum(found) == max(fits, default=0) and len(found) <= most and (not found or tuple(sorted(found)) in combos[len(found)])


def test_op8_log_gives_back_the_rows(spark):
    said = [("user", "a"), ("assistant", "ab😀d\\<|end|>"), ("assistant", ""), (None, None), ("tool", "xy"), ("assistant", "q" * 70_001)]
    rows = [(1, k % 3, r, t, k) for k, (r, t) in enumerate(said * 2)] + [(None, 0, "user", "n", 0), (2, None, "assistant", "z", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long").withColumns({"kind": F.lit("edit"), "log": F.lit(1), "at": F.lit(2), "e": F.lit(3)})
    events = chat.as_events(table.select("conv_id", "turn", "role", "text"))
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    shown = chat.render(chat.fold(events)).select("conv_id", chat.read(F.col("formatted")).alias("m")).collect()
    want = defaultdict(list)
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conv_id: [tuple(m) for m in r.m] for r in shown} == want


def test_op3_empty_and_long(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://" + "a." * 300 + "com/de/" + "p" * 200_000), (2, "x://com/fr/")] * 2, "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    got = url_filter.judge_urls(pages, rules).collect()
    assert sorted((r.page_id, r.rule, r.verdict, len(r.path)) for r in got) == [(1, "com/de/", "block", 200_004)] * 2 + [(2, "com/fr/", "allow", 4)] * 2
