"""op5's ids of batches of texts, and how often a batch asks a library for them."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PART = st.sampled_from([" ", "  ", "\n", "\t ", "\x85", "\xa0", "　", "\x1c", "a", "it's", "'s", "12", "#|", "é", "ɏ", "ɐ", "Σ", "犬", "😀", "\0", "<|endoftext|>", "the", "of"])
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(PART | st.text(max_size=3), max_size=12).map("".join), min_size=1, max_size=8), st.integers(0, 2))
def test_op5_ids_of_batches_are_the_library_s(texts, twice):
    batch = pa.array(["x", *texts * (1 + twice)], pa.string())[1:]  # a slice, as batches can be
    for _ in range(2):  # the second time from memory
        got = packing.encoder(PATH).all(batch)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in batch.to_pylist()]


def test_op5_memory_is_bounded_and_ids_stay():
    small = packing.Encoder(PATH, bound=5)
    for k in range(30):
        texts = [f"w{k}x{j} w{k}x{j} é{j}  犬{k}" for j in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.all(pa.array(texts))] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    kept = packing.memo(PATH)
    assert len(kept["words"]) + len(kept["chunks"]) < 30


def test_op5_encodes_different_words_in_one_call(monkeypatch):
    """Not in one call for each word, which took most of op5's CPU seconds."""
    calls, plain = Counter(), tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.update(n=1) or plain(self, text))
    monkeypatch.setattr(packing, "_kept", {})
    text = " ".join(f"wört{k}e{k * k}" for k in range(5000))
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert 0 < calls["n"] < 10
