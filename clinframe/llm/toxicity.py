"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(w . x + b), x being the
hashed words and word beginnings that occur in it; a document is toxic with probability
1 - prod(1 - p), the noisy-or of its sentences. Only documents carry labels: the gradient of the
document's likelihood goes to each sentence by its share. The fitted weights then locate the
offending sentences.

Fitting uses a bounded sample of labelled documents (``SAMPLE`` of them and ``SAMPLE_CHARS``
characters of text, taken in the order of a hash), read by one task. Scoring reads every text
whole; no other column enters a score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinframe.session import stored

#: Labelled documents that fitting may use, and their characters in all.
SAMPLE = 6000
SAMPLE_CHARS = 24_000_000
#: Hashed features.
DIM = 1 << 18
#: Lengths of word beginnings that are features beside the word.
STEMS = (4, 5, 6)
#: Documents of the sample a feature must occur in.
SEEN = 3
#: Standard deviations by which toxic documents must hold it more often than others.
EXCESS = 4.0
EPOCHS = 200
RATE = 0.3
DECAY = 2e-5
BIAS = -5.0
#: Words after which a text without sentence marks is cut.
LONGEST = 40
#: Words a task remembers the weight of, and words whose features the fit remembers.
REMEMBERED = 150_000
FIT_REMEMBERED = 50_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence, at most ``LONGEST`` words long."""
    for found in _SENTENCE.finditer(text or ""):
        words = _WORDS.findall(found.group().lower())
        for start in range(0, len(words), LONGEST):
            yield found.start(), found.end(), words[start : start + LONGEST]


def features(word: str) -> list[int]:
    own = [crc32(b"w" + word.encode()) % DIM]
    return own + [crc32(b"%d" % n + word[:n].encode()) % DIM for n in STEMS if len(word) >= n]


class _Features(dict):
    """Features of words, remembered up to a bound; only those in ``kept``, if given."""

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= FIT_REMEMBERED:
            self.clear()
        found = features(word)
        value = self[word] = tuple(found if self.kept is None else (f for f in found if self.kept[f]))
        return value


def _telling(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Which features enough documents hold, toxic ones more often than chance would give. One pass
    that keeps two counts per feature."""
    seen, bad, known = np.zeros(DIM, np.int32), np.zeros(DIM, np.int32), _Features()
    for text, y in zip(texts, toxic.tolist(), strict=True):
        words = {word for *_, row in sentences(text) for word in row}
        own = np.fromiter({f for word in words for f in known[word]}, np.int32)
        seen[own] += 1
        bad[own] += y
    share, positive = seen / max(len(texts), 1), toxic.mean() if len(toxic) else 0.0
    # How many standard deviations more toxic documents hold a feature than chance would give.
    spread = np.sqrt(np.maximum(seen * positive * (1 - positive) * (1 - share), 1e-9))
    return (seen >= SEEN) & ((bad - seen * positive) / spread >= EXCESS)


def _bags(texts: list[str], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept features of all sentences, the sentence of each, and the document of each sentence."""
    index, of_sentence, of_document, known = array("i"), array("i"), array("i"), _Features(kept)
    for k, text in enumerate(texts):
        for *_, words in sentences(text):
            row = {f for word in words for f in known[word]}
            index.extend(row)
            of_sentence.extend([len(of_document)] * len(row))
            of_document.append(k)
    return tuple(np.frombuffer(a, np.int32) if len(a) else np.empty(0, np.int32) for a in (index, of_sentence, of_document))


def fit(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Weights (``DIM`` of them, then the bias) by Adagrad on the documents' log-likelihood. Only
    features that tell are stored, so memory beside the texts stays small."""
    weights = np.zeros(DIM + 1, np.float32)
    weights[-1] = BIAS
    if not 0 < toxic.sum() < len(toxic):
        return weights
    index, of_sentence, of_document = _bags(texts, _telling(texts, toxic))
    if not len(of_document):
        return weights
    n_sentences = len(of_document)
    squares = np.full(DIM + 1, 1e-3)
    for _ in range(EPOCHS):
        z = np.bincount(of_sentence, weights[index], n_sentences) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(of_document, np.log1p(-p), len(texts)))
        some = np.maximum(1 - none, 1e-12)
        g = np.where(toxic[of_document] == 1, -p * (none / some)[of_document], p)
        gradient = np.bincount(index, g[of_sentence], DIM + 1) / len(texts) + DECAY * np.r_[weights[:-1], 0]
        gradient[-1] = g.sum() / len(texts)
        squares += gradient**2
        weights -= (RATE * gradient / np.sqrt(squares)).astype(np.float32)
    return weights


def train(docs: DataFrame, labels: DataFrame, in_training: Column) -> bytes:
    """Fit on labelled rows of ``docs`` that meet ``in_training``. A document with several labels
    counts as toxic if one of them says so; null labels, ids and texts are left out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where(in_training).withColumn("at", order).orderBy("at", "doc_id").limit(SAMPLE)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(stored(chosen)), "doc_id")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, room = [], [], SAMPLE_CHARS
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if len(text) <= room:
                    room -= len(text)
                    texts.append(text)
                    toxic.append(int(y))
        yield pa.RecordBatch.from_pydict({"weights": [fit(texts, np.array(toxic)).tobytes()]})

    one = rows.select("text", "toxic", "at", "doc_id").repartition(1).sortWithinPartitions("at", "doc_id", "text")
    found = one.mapInArrow(fitted, "weights binary").first()
    return found["weights"] if found else fit([], np.zeros(0)).tobytes()


class Scorer:
    """Weights of words, remembered while a task meets them again."""

    def __init__(self, weights: bytes):
        self.weights = np.frombuffer(weights, np.float32)
        self.seen: dict[str, float] = {}

    def word(self, word: str) -> float:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        value = self.seen[word] = float(self.weights[features(word)].sum())
        return value

    def sentence(self, words: list[str]) -> float:
        get = self.seen.get
        z = float(self.weights[-1])
        for word in set(words):
            w = get(word)
            z += self.word(word) if w is None else w
        return z

    def document(self, text: str | None) -> tuple[float, int, int]:
        """Noisy-or of the sentences, and where the most offending sentence is. A text without
        sentences counts as one sentence without words."""
        found = [(self.sentence(words), start, end) for start, end, words in sentences(text)]
        found = found or [(float(self.weights[-1]), 0, 0)]
        z = np.clip(np.array([f[0] for f in found]), -30, 30)
        score = -np.expm1(-np.logaddexp(0, z).sum())
        _, start, end = max(found, key=lambda f: (f[0], -f[1]))
        return float(score), start, end


def score(docs: DataFrame, weights: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (struct: score in 0..1, start and end of the worst sentence).

    Null and empty texts get the score of a sentence without words. Repeated rows score alike.
    """
    given = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("score double, worst_start long, worst_end long")
    def scored(column: pa.Array) -> pa.Array:
        scorer = Scorer(given.value)
        rows = [scorer.document(v.as_py()) for v in column]
        fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
        return pa.StructArray.from_arrays(fields, ["score", "worst_start", "worst_end"])

    return docs.withColumn("toxicity", scored(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, taken of their text, is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
