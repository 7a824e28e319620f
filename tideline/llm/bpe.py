"""Byte-level BPE encoding by dynamic programming over prefixes.

The encoding of a prefix is determined by its last token: it is the one token
that ends there, whose start is a prefix with its own last token, and for which
the pair of the two is compatible - merging byte pairs by rank would never
choose a merge across their border. An automaton over the vocabulary gives, at
each position, all tokens that end there; the first compatible one is stored,
and back-pointers give the ids. This is linear in the length of a pre-token
times the tokens that end at a position, with no merge loop.

The pre-tokens of a corpus repeat, so each worker keeps the ids of those it has
met; the memory is bounded and emptying it changes no result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Folder of the vocabulary files unless a parameter names another.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pre-tokens that a worker remembers, and the longest one that it remembers.
MEMORY, LONGEST = 400_000, 64
#: Characters worked on before a batch of rows is handed on.
BATCH_CHARS = 1_000_000

#: Fixed value: how the vocabulary splits a text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without the characters of ``_UNLIKE``.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: Outside these characters ``re`` and the pattern may class a character differently.
_UNLIKE = re.compile("[^\t\n\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder(dict):
    """Maps a pre-token to its ids, and computes those it hasn't met."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick
        import regex

        self.full = regex.compile(PATTERN)

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab, merges = model["vocab"], model["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size: dict[int, int] = {}
        self.whole: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton()
        for word, ident in vocab.items():
            if any(c not in alphabet for c in word):
                continue
            data = raw(word)
            self.size[ident], self.whole[data] = len(data), ident
        #: The merge that joins two tokens, by its rank, and the tokens that a token was joined from.
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.joined[x, y] = k
            if z not in self.parts:
                self.parts[z], self.rank[z] = (x, y), k
        # special tokens have no merge and are longer than a byte: ordinary text never gives them
        self.whole = {d: t for d, t in self.whole.items() if t in self.parts or len(d) == 1}
        for data, t in self.whole.items():
            automaton.add_word(data.decode("latin-1"), (len(data), t))
        automaton.make_automaton()
        self.automaton = automaton
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps ``a`` and ``b`` side by side: no merge across their border comes in time.

        Both are taken apart again, the one that was joined later first. A merge
        across the border at that moment happens before the parts are joined if
        its rank is lower (to the right of the border: lower or equal, as the
        leftmost of equal merges goes first).
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit, ok = a, b, 1 << 60, True
        while True:
            k = self.joined.get((x, y))
            if k is not None and k < limit:
                ok = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, self.parts[x][1]
            else:
                limit, y = ry + 1, self.parts[y][0]
        if len(self.fits) >= 2 * MEMORY:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.whole.get(data)
        if whole is not None:
            return (whole,)
        last = [-1] * (len(data) + 1)
        compatible = self.compatible
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - size
                if not start or (last[start] >= 0 and compatible(last[start], token)):
                    last[end + 1] = token
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(reversed(out))

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        return (self.full if _UNLIKE.search(text) else _PLAIN).findall(text)

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY, folder: str = FOLDER) -> Encoder:
    """The worker's encoder of a vocabulary, loaded once."""
    path = os.path.join(folder, f"{name}.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut by the length of the texts, so that neither many nor long texts fill the memory."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // BATCH_CHARS
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.array([], int)
    for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True):
        yield batch.slice(int(a), int(b - a))


def _texts(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(text).to_pylist()


def _encode(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    e = encoder(name, folder)
    for batch in batches:
        for part in _slices(batch, "text"):
            flat, ends = [], [0]
            for text in _texts(part, "text"):
                one = np.fromiter(chain.from_iterable(map(e.__getitem__, e.words(text))), np.int32) if text else np.empty(0, np.int32)
                flat.append(one)
                ends.append(ends[-1] + len(one))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids], names=["id", "ids"])


def _count(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    e = encoder(name, folder)
    size = e.__getitem__
    for batch in batches:
        for part in _slices(batch, "text"):
            n = [sum(map(len, map(size, e.words(text)))) if text else 0 for text in _texts(part, "text")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(n, pa.int64())], names=[*(c for c in part.schema.names if c != "text"), "n_tokens"])


def encode_corpus(docs: DataFrame, ident: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``ident`` and ``ids``, one row per row of ``docs``, without a shuffle.

    Without special tokens: a text that looks like one is ordinary text; nothing
    is trimmed or normalised. An empty and a null text give an empty list. Spark
    hands whole batches to a worker; ``session.bounded_batches`` makes them small.
    Repeated rows give repeated rows, a null ``ident`` stays null.
    """
    x = docs.selectExpr(f"cast(`{ident}` as bigint) as id", f"cast(`{text}` as string) as text")
    return x.mapInArrow(lambda b: _encode(b, name, folder), "id bigint, ids array<int>").withColumnRenamed("id", ident)


def count_tokens(docs: DataFrame, *keep: str, text: str = "text", name: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, one row per row of ``docs``, without a shuffle."""
    x = docs.select(*keep, docs[text].cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "text")
    return x.mapInArrow(lambda b: _count(b, name, folder), f"{schema}, n_tokens bigint")
