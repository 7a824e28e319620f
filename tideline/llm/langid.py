"""Language of articles and of their paragraphs, with a confidence.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability in a language is the sum over all its segmentations into
pieces, by a forward pass; a paragraph's is the product over its words. The
piece probabilities are fitted by expectation maximisation over the same
segmentations, on labelled sentences of a bounded number.

Words repeat, so a worker keeps the eight scores of those it has met.
"""

from __future__ import annotations

import os
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import FOLDER, _slices
from .prose import GAP, prose

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
PIECES = "piece_bpe_32k.model"
#: The most labelled sentences that the fit takes.
SAMPLES = 20_000
#: Full sentences that a paragraph in another language needs.
SENTENCES = 2
#: Words that a worker remembers.
MEMORY = 500_000
_START = "\u2581"
_TOKEN = re.compile(rf"[^\W\d_]+|[.!?\u2026]+(?=[\s)\]\"'\u00bb\u201d\u2019]|\Z)|{GAP}")
_WORD = re.compile(r"[^\W\d_]+")

#: Other names of the languages.
NAMES = {
    "de": ("deu", "ger", "german"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"),
}


def named(label: Column) -> Column:
    """The code of the language that a label names in some spelling, else null."""
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    base = F.regexp_extract(plain, r"^([a-z]+)(?:[-_].*)?$", 1)
    table = {code: code for code in LANGUAGES} | {n: code for code, names in NAMES.items() for n in names}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), base)


class Unigrams:
    """Piece probabilities per language, and the forward pass over segmentations."""

    def __init__(self, pieces: list[str], sentences: list[tuple[str, str]], rounds: int = 4, own: float = 0.02, pooled: float = 0.3):
        self.vocabulary = frozenset(p for p in pieces if _WORD.fullmatch(p.removeprefix(_START) or "a") and p == p.lower())
        self.longest = max(map(len, self.vocabulary), default=1)
        words = {lang: Counter(w for code, s in sentences if code == lang for w in _WORD.findall(s.lower())) for lang in LANGUAGES}
        size = len(self.vocabulary) + 1
        prob: dict[str, dict[str, float]] = {lang: {} for lang in LANGUAGES}
        floor = dict.fromkeys(LANGUAGES, 1.0 / size)
        for _ in range(rounds):
            counts = {}
            for lang in LANGUAGES:
                c: Counter = Counter()
                for w, n in words[lang].items():
                    self._expected(w, n, prob[lang], floor[lang], c)
                counts[lang] = c
            everywhere = sum((Counter(c) for c in counts.values()), Counter())
            total = sum(everywhere.values()) or 1.0
            for lang in LANGUAGES:
                mass = sum(counts[lang].values()) + pooled * 100 + own * size
                floor[lang] = own / mass
                prob[lang] = {p: (counts[lang].get(p, 0.0) + pooled * 100 * everywhere[p] / total + own) / mass for p in everywhere}
        seen = sorted(set().union(*prob.values()))
        self.floor = np.array([floor[x] for x in LANGUAGES])
        self.table = {p: np.array([prob[x].get(p, floor[x]) for x in LANGUAGES]) for p in seen}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((2, len(LANGUAGES)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words, self.scores = {}, np.zeros((2, len(LANGUAGES)))

    def _arcs(self, word: str) -> Iterator[tuple[int, int, str | None]]:
        """Start, end and piece of all pieces in the marked word; one letter always passes."""
        w = _START + word
        for end in range(1, len(w) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = w[start:end]
                if piece in self.vocabulary:
                    yield start, end, piece
                elif end - start == 1:
                    yield start, end, None

    def _expected(self, word: str, n: float, prob: dict[str, float], floor: float, into: Counter) -> None:
        arcs = [(a, b, p, prob.get(p, floor) if p else floor * 1e-3) for a, b, p in self._arcs(word)]
        size = len(word) + 1
        ahead, back = [1.0] + [0.0] * size, [0.0] * size + [1.0]
        for a, b, _, q in arcs:
            ahead[b] += ahead[a] * q
        for a, b, _, q in reversed(arcs):
            back[a] += q * back[b]
        if ahead[size] > 0:
            for a, b, p, q in arcs:
                if p:
                    into[p] += n * ahead[a] * q * back[b] / ahead[size]

    def score(self, word: str) -> np.ndarray:
        """Log probability of a word of any length in each language, summed over all segmentations."""
        k, w = len(LANGUAGES), _START + word
        # probabilities of the prefixes that a piece can begin after, over a common scale that keeps them from vanishing
        ahead, scale = deque([np.ones(k)], maxlen=self.longest), np.zeros(k)
        for end in range(1, len(w) + 1):
            total = np.zeros(k)
            for start in range(max(0, end - self.longest), end):
                piece = w[start:end]
                if piece in self.vocabulary:
                    total += ahead[start - end] * self.table.get(piece, self.floor)
                elif end - start == 1:
                    total += ahead[-1] * self.floor * 1e-3
            ahead.append(total)
            if end % 16 == 0:
                most = np.max(ahead, axis=0)
                scale += np.log(most)
                ahead = deque((a / most for a in ahead), maxlen=self.longest)
        return np.log(ahead[-1]) + scale

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """0 for a gap, 1 for a sentence's end, else the row of the word's scores."""
        known = self.words
        new = set(tokens) - known.keys()
        if new:
            if len(known) + len(new) > MEMORY or not known:
                known.clear()
                known[GAP] = 0
                self.scores = np.zeros((2, len(LANGUAGES)))
                new = set(tokens) - {GAP}
            rows, at = [], len(self.scores)
            for w in new:
                if w[0].isalpha():
                    known[w] = at + len(rows)
                    rows.append(self.score(w))
                else:
                    known[w] = 1
            if rows:
                self.scores = np.concatenate([self.scores, np.array(rows)])
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def fit(samples: DataFrame, folder: str = FOLDER, most: int = SAMPLES) -> Unigrams:
    """Fit on labelled sentences (columns lang, text), of which there may be at most ``most``."""
    import sentencepiece

    rows = samples.filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("lang", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled sentences; choose a sample")
    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
    return Unigrams([sp.id_to_piece(k) for k in range(sp.get_piece_size())], sorted((r.lang, r.text) for r in rows))


def paragraphs(model: Unigrams, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all paragraphs of prose: text's index, number, language, confidence, words, sentences."""
    many: list[list[str]] = []
    first = np.ones(len(texts), np.int64)
    for k, text in enumerate(texts):
        tokens: list[str] = []
        if text:
            first[k], t = prose(text)
            tokens = _TOKEN.findall(t.lower())
        tokens.append(GAP)
        many.append(tokens)
    ids, sizes = model.numbers([w for tokens in many for w in tokens]), np.cumsum([len(tokens) for tokens in many])
    many.clear()
    return _score(model, np.split(ids, sizes[:-1]) if len(sizes) else [], first)


def _score(model: Unigrams, flat: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, ...]:
    ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    gaps = np.array([int((f == 0).sum()) for f in flat], np.int64)
    para = np.cumsum(ids == 0) - (ids == 0)
    n = int(gaps.sum())
    words = np.bincount(para[ids > 1], minlength=n)[:n]
    ends = np.bincount(para[ids == 1], minlength=n)[:n]
    used = ids[ids > 1]
    at = para[ids > 1]
    total = np.stack([np.bincount(at, weights=model.scores[used, j], minlength=n)[:n] for j in range(len(LANGUAGES))], axis=1) if n else np.zeros((0, len(LANGUAGES)))
    best = total.argmax(axis=1) if n else np.zeros(0, np.int64)
    sure = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if n else np.zeros(0)
    doc = np.repeat(np.arange(len(flat)), gaps)
    number = np.arange(n) - np.repeat(np.cumsum(gaps) - gaps, gaps) + first[doc]
    keep = words > 0
    return doc[keep], number[keep], best[keep], sure[keep], words[keep], ends[keep]


_SCHEMA = "id bigint, segment int, lang string, confidence double, words bigint, sentences bigint"


def _label(batches: Iterator[pa.RecordBatch], model: Unigrams) -> Iterator[pa.RecordBatch]:
    names = np.array(LANGUAGES)
    for batch in batches:
        for part in _slices(batch, "text"):
            doc, number, lang, sure, words, ends = paragraphs(model, part.column("text").to_pylist())
            n, k = part.num_rows, len(LANGUAGES)
            votes = np.bincount(doc * k + lang, minlength=n * k).reshape(n, k)
            weight = np.bincount(doc * k + lang, weights=words, minlength=n * k).reshape(n, k)
            total = np.maximum(weight.sum(axis=1), 1)
            main = (votes + 0.5 * weight / total[:, None]).argmax(axis=1)
            some = np.flatnonzero(votes.sum(axis=1) > 0)
            agree = np.bincount(doc, weights=sure * words * (lang == main[doc]), minlength=n) / total
            other = (lang != main[doc]) & (ends >= SENTENCES)
            at = np.concatenate([some, doc[other]])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(at)),
                    pa.array(np.concatenate([np.zeros(len(some), np.int64), number[other]]), pa.int32()),
                    pa.array(names[np.concatenate([main[some], lang[other]])], pa.string()),
                    pa.array(np.concatenate([agree[some], sure[other]])),
                    pa.array(np.concatenate([total[some].astype(np.int64), words[other]]), pa.int64()),
                    pa.array(np.concatenate([np.bincount(doc, weights=ends, minlength=n)[some].astype(np.int64), ends[other]]), pa.int64()),
                ],
                names=["id", "segment", "lang", "confidence", "words", "sentences"],
            )


def label_documents(docs: DataFrame, samples: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``doc_id``, ``segment``, ``lang``, ``confidence``, ``words``, ``sentences``, without a shuffle.

    Segment 0: the document, with the language of most of its paragraphs of prose
    (of as many, the one with more words). Other segments: paragraphs in another
    language with at least two full sentences, by the number of the piece. A
    confidence is the paragraph's posterior; a document's is the part of its words
    in paragraphs of its language, weighted by their posteriors. Documents
    without prose, null and empty texts have no rows; repeated rows repeat.
    """
    model = fit(samples, folder)
    x = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(lambda b: _label(b, model), _SCHEMA).withColumnRenamed("id", "doc_id")


def found(docs: DataFrame, samples: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``doc_id``, ``segment``, ``lang``: wrong or missing labels, and passages in another language."""
    model = fit(samples, folder)
    x = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), named(F.col("lang")).alias("named")).alias("id"), F.col("text").cast("string").alias("text"))
    out = x.mapInArrow(lambda b: _label(b, model), _SCHEMA.replace("id bigint", "id struct<doc_id:bigint,named:string>"))
    wrong = (F.col("segment") > 0) | ~F.col("id.named").eqNullSafe(F.col("lang"))
    return out.filter(wrong).select(F.col("id.doc_id").alias("doc_id"), "segment", "lang")
