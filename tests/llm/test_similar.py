"""The pipeline's near-duplicates against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def brute(texts):
    sets, up = word_sets(texts), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def edited(rnd, words, edits):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = f"e{rnd.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def made():
    """Bases with copies of more and more edits, a dense group, texts that share a passage, and odd ones."""
    rnd, out = random.Random(5), {}
    passage = [f"p{k}" for k in range(30)]
    for _ in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(90, 300))]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            out[len(out)] = edited(rnd, base, edits)
        out[len(out)] = " ".join(passage + base[:20])
    dense = [f"d{k}" for k in range(200)]
    for _ in range(40):
        out[len(out)] = edited(rnd, dense, rnd.randint(0, 4))
    for t in (None, "", "  ", "a b", "A  b", "a b c d e", "a b c d e f"):
        out[len(out)] = t
    return out


@pytest.mark.parametrize("direct", [2, 7, 2048])
def test_pairs_of_the_similarity_meet(spark, made, direct):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made.items()], DOCS)
    got = {r.doc_id: r.component_id for r in similar.similar(docs, direct=direct).collect()}
    assert got == brute(made)


def test_pipeline_stage_drops_edited_copies(spark, made):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made.items()] + [(None, "x y", "en", "s", 3)], DOCS)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(brute(made).values())) and got.count(None) == 1


def test_stage_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.component_id for r in similar.similar(docs.withColumn("has", F.lit(1))).collect()}
    assert got == brute(texts)
