"""The pipeline's near-duplicates: SimHash links count, exact ones are added, and chains over both are one group."""

import random
from pathlib import Path

import corpus_pipeline
from tallywright.llm import similar, simhash
from tallywright.operators import components
from tallywright.operators.lineage import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_simhash_links_count_and_join_with_exact_ones(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(600)]
    texts = {0: base, 1: [w.upper() for w in base], 9: [f"z{k}" for k in range(300)]}
    # Three words of a hundred differ: some pairs are near in fingerprints alone.
    for i in range(2, 60):
        texts[i + 20] = [w if r.random() > 0.03 else f"q{r.randint(0, 10**6)}" for w in base]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in texts.items()] + [(None, "x y", "en", "s", 3)], DOCS)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    exact = {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert any(exact[a] != exact[b] for a, b in pairs)
    for a, b in pairs + list(exact.items()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted({root(i) for i in ids}) and got.count(None) == 1


def test_rows_with_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "other text of its own", "en", "s", 21), (2, "third text", "en", "s", 10)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


def test_few_links_are_solved_in_one_written_table(spark):
    written = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("rdd-*")}
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(7, 7), (3, 2), (100, 101)], "a long, b long")
    for find in (simhash.components, similar.components):
        before = written()
        assert {r.node: r.root for r in find(chain).collect()} == {k: 0 for k in range(1, 61)} | {101: 100}
        assert len(written() - before) <= 1


def test_links_between_texts_by_either_way(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z"), ("😀", "\uffee"), (None, "c"), ("x", "x")], "a string, b string")
    for one in (components.ONE_TASK, 0):
        got = components.components(edges, one)
        assert {r.node: r.root for r in got.collect()} == {"b": "a", "c": "a", "é": "z", "😀": "\uffee"}
        assert components.components(edges.limit(0), one).count() == 0
