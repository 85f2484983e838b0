"""op1's query on planted passages: texts stay whole or lose exactly what repeats; n_bytes is the input's length either way."""

import hashlib
import random

from tallywright.llm import queries


def test_op1_query_on_planted_passages(spark, tmp_path):
    r = random.Random(5)
    words = lambda n, size: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzéß", k=size)) for _ in range(n))
    # 55 words: of 9 letters over 400 bytes, of 4 letters under 400 bytes, where the contract's rule doesn't reach.
    docs, long, short = {k: words(120, 6) for k in range(40)}, {}, {}
    for i, (size, into) in enumerate([(9, long), (4, short)] * 6):
        passage = words(55, size)
        for k in (3 * i, 3 * i + 1):
            docs[k], into[k] = f"{words(20, 6)}\n{passage}\n{words(30, 6)}", passage
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs) and long and short
    for k, x in got.items():
        assert x.n_bytes == len(docs[k].encode())
        want = docs[k]
        if k in long:
            # The line ends on both sides are the same in all copies, so they belong to the repeat.
            want = want.replace(f"\n{long[k]}\n", "")
            assert len(docs[k].encode()) - len(want.encode()) == x.n_removed >= 400 and x.n_spans == 1
        else:
            assert x.n_removed == x.n_spans == 0
        assert x.kept_sha256 == hashlib.sha256(want.encode()).hexdigest()
