"""Quality classifier: supervised embeddings of hashed words and character n-grams.

Each word of a document, each n-gram of the bytes of a word with its boundaries,
and each immediate repetition of a word is a feature, hashed into BUCKETS
learned vectors. A document is the average of its features' vectors; a softmax
layer over the average gives the probability of label 1. Both layers are trained
by plain stochastic gradient descent in numpy.

Training uses a bounded sample of labelled rows (SAMPLE_DOCS per label, of long
texts a window of SAMPLE_CHARS); the loss weighs labels by their share of all labelled
rows. Scoring reads whole texts: as the layers are linear, a trained model is one
number per bucket, and a document's score is the logistic of their mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prorrata.llm.common import id_remainder, sample_window, shared_value, smallest_hashes, whole_text
from prorrata.sources.workarea import written

SAMPLE_DOCS = 1200  # labelled documents per label, at most
SAMPLE_CHARS = 16_000  # of a longer document a window of so many characters, at a place given by its hash
BUCKETS = 1 << 18
DIMENSION = 8
NGRAMS = (3, 4, 5)
STEPS = 20_000  # documents that training looks at, each of the sample equally often
RATE = 0.5
BOUND = 40.0  # weights stay within, so that no sample can make the steps run away
THRESHOLD = 0.3  # least score of a document that is predicted 1
_CHUNK_CHARS = 1_000_000  # characters whose features are computed at a time
_WHITE = " \t\n\v\f\r"
_CUT = re.compile(f"[{_WHITE}]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = 64  # bytes of a word that get a factor of their own; factors recur in longer words
_END, _AGAIN = 1, 2  # hashes of the features "end of document" and "same word again"


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _FACTOR) >> np.uint64(46)).astype(np.int32)  # the upper 18 bits


def ends(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature "end of document" of *count* documents."""
    return np.arange(count), _buckets(np.full(count, _END, dtype=np.uint64), 0)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, bucket) of all features of *texts*, one pair of arrays per kind of feature."""
    yield ends(len(texts))
    yield from inner_features(texts)


def inner_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`features` without the ends of documents."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(encoded) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) + 1)
    document = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))  # of each byte but the first
    space = _SPACE[data]
    wide = np.where(space, np.uint64(32), data.astype(np.uint64))

    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = stops - starts
    powers = np.cumprod(np.full(_POWERS, _FACTOR, dtype=np.uint64))
    place = (np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))) % _POWERS
    weighted = np.where(space, np.uint64(0), wide * powers[place])
    words = np.add.reduceat(weighted, starts) + lengths.astype(np.uint64)
    owner = document[starts - 1]
    yield owner, _buckets(words, 1)
    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    yield owner[1:][again], _buckets(np.full(int(again.sum()), _AGAIN, dtype=np.uint64), 0)

    rolling, inner = wide, np.zeros(len(data), dtype=bool)  # inner: white space after the first byte of the window
    for n in range(2, max(NGRAMS) + 1):
        if len(data) < n:
            return
        rolling = rolling[:-1] * _FACTOR + wide[n - 1 :]
        inner = inner[:-1] if n == 2 else inner[:-1] | space[n - 2 : n - 2 + len(inner) - 1]
        if n in NGRAMS:
            at = np.flatnonzero(~inner)
            yield document[np.minimum(at, len(document) - 1)], _buckets(rolling[at], n)


class Model:
    """Trained weights, folded into one number per bucket."""

    def __init__(self, evidence: np.ndarray):
        self.evidence = evidence

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text; null counts as empty."""
        found = np.empty(len(texts))
        first = 0
        while first < len(texts):
            chunk, size = [], 0
            while first + len(chunk) < len(texts) and (not chunk or size + len(texts[first + len(chunk)] or "") <= _CHUNK_CHARS):
                chunk.append(texts[first + len(chunk)] or "")
                size += len(chunk[-1])
            of = long_features(chunk[0]) if size > _CHUNK_CHARS else features(chunk)
            total, count = np.zeros(len(chunk)), np.zeros(len(chunk))
            for owner, buckets in of:
                total += np.bincount(owner, weights=self.evidence[buckets], minlength=len(chunk))
                count += np.bincount(owner, minlength=len(chunk))
            found[first : first + len(chunk)] = 1.0 / (1.0 + np.exp(-np.clip(total / count, -500, 500)))
            first += len(chunk)
        return found


def long_pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about *size* characters; all but the first begin with white space."""
    begin = 0
    while begin < len(text):
        cut = _CUT.search(text, begin + size) if begin + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


def long_features(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of one very long text, piece by piece, so that memory does not grow with it.

    They are those of the whole text: n-grams lie within a word and the white
    space around it, the end counts once, and the last word of a piece is
    compared with the first one of the next.
    """
    yield ends(1)
    last = None
    for piece in long_pieces(text, _CHUNK_CHARS):
        yield from inner_features([piece])
        words = piece.strip(_WHITE)
        if words:
            first = _CUT.split(words, maxsplit=1)[0]
            if first == last:
                yield np.zeros(1, dtype=np.int64), _buckets(np.full(1, _AGAIN, dtype=np.uint64), 0)
            last = words[max(words.rfind(c) for c in _WHITE) + 1 :]


def train(texts: list[str], labels: list[int], shares: tuple[float, float]) -> Model:
    """Model from texts with labels 0 and 1; *shares* are the labels' shares of all labelled rows.

    With only one label, or none, the evidence is the same for every text.
    """
    present = [labels.count(v) for v in (0, 1)]
    if not all(present):
        constant = 0.0 if not any(present) else (4.0 if present[1] else -4.0)
        return Model(np.full(BUCKETS, constant))
    documents = []
    for text in texts:
        buckets, counts = np.unique(np.concatenate([b for _, b in features([text])]), return_counts=True)
        documents.append((buckets, (counts / counts.sum()).astype(np.float32)))
    weight = [shares[v] * len(labels) / present[v] for v in (0, 1)]
    random = np.random.default_rng(0)
    vectors = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer = np.zeros((DIMENSION, 2), dtype=np.float32)
    epochs, done = -(-STEPS // len(labels)), 0
    steps = epochs * len(labels)
    for _ in range(epochs):
        for i in random.permutation(len(labels)):
            buckets, part = documents[i]
            mean = part @ vectors[buckets]
            logits = mean @ layer
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1.0
            error *= RATE * (1 - done / steps) * min(weight[labels[i]], 5.0)
            back = layer @ error
            layer = np.clip(layer - np.outer(mean, error), -BOUND, BOUND)
            # Averaged features get a gradient of 1 / count each; it is restored here, else rare ones never move.
            step = np.minimum(part * len(buckets), 4.0)[:, None] * back
            vectors[buckets] = np.clip(vectors[buckets] - step, -BOUND, BOUND)
            done += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from *docs* (doc_id, text) and *labels* (doc_id, quality); only qualities 0 and 1 count.

    The sample holds the labelled ids with the smallest hashes, so it does not
    depend on partitioning. Labels without a document do not count.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = written(docs.select("doc_id").join(known, "doc_id").distinct(), "labelled-ids")
    counts = {r["_quality"]: r["count"] for r in known.groupBy("_quality").count().collect()}
    chosen = smallest_hashes(known, "_quality", "doc_id", counts, SAMPLE_DOCS)
    # Bounded: SAMPLE_DOCS ids for each of two labels.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "_quality", sample_window(whole_text(), SAMPLE_CHARS).alias("text"))
    sample = rows.groupBy("doc_id", "_quality").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r["doc_id"])
    total = max(1, sum(counts.values()))
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total)
    return train([r["text"] for r in sample], [r["_quality"] for r in sample], shares)


def score_of(docs: DataFrame, text: Column, model: Model) -> Column:
    """Score of a text column; the model is BUCKETS numbers."""
    shared = shared_value(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared()
        for texts in batches:
            yield pd.Series(model.scores(list(texts)))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every row of *docs* (doc_id, text; other columns are ignored).

    Learns only from labels whose crc32(doc_id) mod 5 is not 0. Null and empty
    texts have one feature, the end of the document. Repeated rows score alike.
    With no labelled row every score is 0.5; an empty table gives no rows.
    """
    model = learn(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), score_of(docs, F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
