"""Byte-pair encoding and decoding from a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds (rank, place) of the pairs that may merge, and
entries whose symbols have changed since are skipped. Normalisation (NFC, white space, lower case), the pattern of
pieces and the word-end mark come from the file's kind: a word-level BPE over bytes with ends of words. White space is
dropped and always parts pieces, so tasks keep results by word and piece: the last `bound` (counted
between texts) and as many before. Decoding concatenates vocabulary strings, joined as the
file's (absent) decoder asks.

Defined results: a null text is empty and has no ids; special strings in a text are their own ids, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallywright.llm.common import append, memo

_odd_space = re.compile("[\x1c-\x1f]")
_split_space = re.compile("[^\t-\r \x85\xa0  -     　]+").findall


def byte_letters() -> dict[int, str]:
    """A visible letter for each byte: printable Latin-1 stands for itself, the rest for what follows 0xFF in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Kinds(dict):
    """A stand-in of the same kind (letter, number, other) for each character outside ASCII. The kind is the library's:
    its own splitter is asked once for each character, so that a newer or older character database makes no difference.
    Matching goes on stand-ins."""

    def __missing__(self, point: int) -> str:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        kinds = (r"\p{L}", "\u00e9"), (r"\p{N}", "\u00b2")
        self.setdefault("ask", [(Split(Regex(p), "removed"), shown) for p, shown in kinds])
        if 0x1F < point < 0x80:
            self[point] = chr(point)
        else:
            self[point] = next((shown for split, shown in self["ask"] if not split.pre_tokenize_str(chr(point))), "\u00a7")
        return self[point]


class _Lower(dict):
    """Each character's lower case, as the library has it."""

    def __missing__(self, point: int) -> str:
        from tokenizers.normalizers import Lowercase

        c = chr(point)
        self[point] = c.lower() if c < "\u0250" else Lowercase().normalize_str(c)
        return self[point]


_kinds, _lower = _Kinds(), _Lower()


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, bound: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"] or ""
        number = dict(self.vocab)
        self.letters = byte_letters()
        most = max(number.values())
        for x in (*self.letters.values(), *(c + self.end for c in self.letters.values()), *(x for m in model["merges"] for x in (*m, "".join(m)))):
            number.setdefault(x, most + len(number))
        self.first = [number[self.letters[b]] for b in range(256)]
        self.last = [number[self.letters[b] + self.end] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(model["merges"]):
            self.rank[number[a] << 32 | number[b]] = k
            self.made.append(number[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.path, self.bound = path, bound

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece. Symbols are numbers: their ids, or more than any id. An entry of the queue is rank * size +
        place; it is stale if `now` has another entry there."""
        raw, first = piece.encode(), self.first
        s: list[int | None] = [first[b] for b in raw]
        s[-1] = self.last[raw[-1]]
        size, rank, made = len(s), self.rank.get, self.made
        ranks = [rank(a << 32 | b) for a, b in zip(s, s[1:])]
        now: list[int | None] = [None if r is None else r * size + i for i, r in enumerate(ranks)]
        queue = [e for e in now if e is not None]
        now.append(None)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            e = pop(queue)
            i = e % size
            if now[i] != e:
                continue
            j = right[i]
            x = s[i] = made[e // size]
            k = right[i] = right[j]
            s[j] = now[j] = now[i] = None
            if k < size:
                left[k] = i
                if (r := rank(x << 32 | s[k])) is not None:
                    now[i] = r = r * size + i
                    push(queue, r)
            if (h := left[i]) >= 0:
                if (r := rank(s[h] << 32 | x)) is None:
                    now[h] = None
                else:
                    now[h] = r = r * size + h
                    push(queue, r)
        return [x for x in s if x is not None and x in self.strings]

    def word(self, word: str, pieces: dict[str, tuple[str, str]], before: dict[str, tuple[str, str]]) -> tuple[str, str]:
        """Decimal ids and strings of a text without white space, each joined by spaces; pieces met before are kept."""
        if word.isascii():
            word = shown = word.lower()
            shown = shown if shown.isprintable() else shown.translate(_kinds)
        else:
            word = unicodedata.normalize("NFC", word).translate(_lower)
            shown = word.translate(_kinds)
        found = []
        for m in self.pattern.finditer(shown):
            piece = word[m.start() : m.end()]
            if (x := pieces.get(piece)) is None:
                if (x := before.get(piece)) is None:
                    ids = self.merge(piece)
                    x = " ".join(map(str, ids)), self.decode(ids)
                pieces[piece] = x
            if x[0]:
                found.append(x)
        return found[0] if len(found) == 1 else (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        parts = self.at_special.split(text) if self.at_special and any(x in text for x in self.special) else [text]
        kept = memo(self.path)
        for name in "words", "pieces":
            if len(kept.setdefault(name, {})) > self.bound or name + " before" not in kept:
                kept[name], kept[name + " before"] = {}, kept[name]
        known, before = kept["words"], kept["words before"]
        found = []
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
                continue
            for w in _split_space(part) if _odd_space.search(part) else part.split():
                if (x := known.get(w)) is None:
                    x = known[w] = before.get(w) or self.word(w, kept["pieces"], kept["pieces before"])
                found.append(x)
        found = [x for x in found if x[0]]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text; with_ids: the ids and the decoded text too."""

    def fn(texts: pa.Array) -> list:
        bpe, out = loaded(path), []
        for x in texts.to_pylist():
            ids, decoded = bpe.encode(x or "")
            row = [ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
            out.append(row + [list(map(int, ids.split())), decoded] * with_ids)
        return list(map(list, zip(*out, strict=True)))

    return append(docs, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids, fn, keep)
