"""LM scoring by a weighted backoff automaton over word n-grams.

A state is a history that occurs in the training text. It has an arc for every
word seen after it, and a failure arc to the history without its first word. Arcs
carry smoothed logarithms: with prior strength s, an arc weighs
(c(hw) + s * p(w|shorter)) / (c(h) + s) and a failure arc s / (c(h) + s), so the
words after a state share a probability of one. The last state, without a
history, adds one to the count of every word and of one unknown word. The prior
strength is the one of PRIORS that makes the training text likeliest when each
token is predicted without its own occurrence (leave-one-out), over all tokens.

The automaton grows with the corpus, so it is never gathered:

1. Documents become chunks of about CHUNK_TOKENS tokens (word hashes by XXH64),
   written once. A document of any length is cut into pieces whose first words
   are preceded by the history they need.
2. Every chunk asks for its distinct n-grams, sorted by key and cut into key
   ranges (shards), with its own training counts. A shard sums the counts and
   answers every chunk that asked, in the order it asked.
3. The answers of a chunk are the part of the automaton that its texts can reach.
   Its tokens run through it from left to right, carrying the state; a token
   without an arc follows failure arcs. All tokens of a chunk take a step at a time.

Keys are 64-bit hashes; a collision, improbable below billions of n-grams, would
add two counts. Shards grow in number with the tokens, chunks in number with the
input, and both are bounded in size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prorrata.llm.common import id_remainder, whole_text
from prorrata.sources.workarea import written

ORDER = 2  # words of the longest n-gram
CHUNK_TOKENS = 1 << 21
SHARD_TOKENS = 1 << 21
PRIORS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0)
_SLICE_BYTES = 8 << 20  # bytes of a text that are cut into words at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# No word holds a space, so these are the hashes of no word.
START, END = (xxhash.xxh64_intdigest(x) for x in (b" start", b" end"))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_PIECE = "struct<row: long, held_out: boolean, begins: boolean, lead: int, length: int, id: {}>"
_ASK = "part int, shard int, chunk long, keys binary, counts binary"
_ANSWER = "chunk long, part int, shard int, totals binary, known long"


def word_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the words of a text in order, A-Z lower-cased, a slice of the text at a time."""
    begin = 0
    while begin < len(text):
        cut = _SPACE.search(text, begin + _SLICE_BYTES) if begin + _SLICE_BYTES < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[begin:end].lower().split()
        yield np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        begin = end


def pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed: the upper planes of small numbers take no room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, order: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Documents (row, id, held_out, text) as chunks; a chunk's words stand in the order of their frequency."""
    number = 0
    first_chunk = TaskContext.get().partitionId() << 33
    hashes: list[np.ndarray] = []
    pieces: list[dict] = []
    tokens = 0

    def chunk() -> pa.RecordBatch:
        nonlocal number, hashes, pieces, tokens
        words, of_token, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), dtype=np.uint32)
        place[by_count] = np.arange(len(words), dtype=np.uint32)
        piece = pa.struct([("row", pa.int64()), ("held_out", pa.bool_()), ("begins", pa.bool_()), ("lead", pa.int32()), ("length", pa.int32()), ("id", id_kind)])
        trained = sum(p["length"] for p in pieces if not p["held_out"])
        begun = sum(p["begins"] and not p["held_out"] for p in pieces)
        columns = [
            pa.array([first_chunk + number]), pa.array([tokens]), pa.array([trained]), pa.array([begun]), pa.array([pieces], type=pa.list_(piece)),
            pa.array([words[by_count].tobytes()], type=pa.binary()), pa.array([pack(place[of_token])], type=pa.binary()),
        ]
        number += 1
        hashes, pieces, tokens = [], [], 0
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_tokens", "train_tokens", "train_docs", "pieces", "words", "tokens"])

    for batch in batches:
        for row, doc_id, held_out, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "held_out", "text"))):
            lead, begins = np.array([START], dtype=np.uint64), True
            rest = [*word_hashes(text), np.array([END], dtype=np.uint64)]
            words = np.concatenate(rest)
            at = 0
            while at < len(words):
                part = words[at : at + size - tokens]
                hashes += [lead, part]
                pieces.append({"row": row, "held_out": held_out, "begins": begins, "lead": len(lead), "length": len(part), "id": doc_id})
                at, tokens, begins = at + len(part), tokens + len(part), False
                lead = np.concatenate([lead, part])[-max(1, order - 1) :]
                if tokens >= size:
                    yield chunk()
    if pieces:
        yield chunk()


class Grams:
    """The distinct n-grams of a chunk, order by order."""

    def __init__(self, row: dict, order: int):
        pieces = row["pieces"]
        words = np.frombuffer(row["words"], dtype=np.uint64)
        tokens = unpack(row["tokens"], np.uint32)
        self.lead = np.array([p["lead"] for p in pieces])
        self.length = np.array([p["length"] for p in pieces])
        self.held_out = np.array([p["held_out"] for p in pieces])
        size = self.lead + self.length
        starts = np.cumsum(size) - size
        place = np.arange(len(tokens)) - np.repeat(starts, size)
        self.scored = place >= np.repeat(self.lead, size)
        trained = np.repeat(~self.held_out, size)
        begins = np.repeat(np.array([p["begins"] for p in pieces]), size) & (place == 0)
        # Per order: key, training count in this chunk, history and shorter n-gram (both one order below), n-gram of
        # each token (-1 where none ends).
        self.keys, self.counts = [(words ^ (words >> np.uint64(32))) * _A], [np.bincount(tokens[trained & (self.scored | begins)], minlength=len(words))]
        self.history, self.shorter, self.of_token = [None], [None], [tokens.astype(np.int64)]
        for n in range(2, order + 1):
            before = self.of_token[-1]
            ends = np.flatnonzero(place >= n - 1)
            pairs = (before[ends - 1] << 32) | tokens[ends]
            unique, first, of = np.unique(pairs, return_index=True, return_inverse=True)
            history = unique >> 32
            key = (self.keys[-1][history] + _B) * _A ^ (self.keys[0][unique & 0xFFFFFFFF] >> np.uint64(7))
            key = (key ^ (key >> np.uint64(29))) * _B
            self.keys.append(key ^ (key >> np.uint64(32)))
            self.counts.append(np.bincount(of[(trained & self.scored)[ends]], minlength=len(unique)))
            self.history.append(history)
            self.shorter.append(before[ends][first])
            here = np.full(len(tokens), -1, dtype=np.int64)
            here[ends] = of
            self.of_token.append(here)


def _asks(batches: Iterator[pa.RecordBatch], shards: int, order: int) -> Iterator[pa.RecordBatch]:
    """Per order and range of keys: the chunk's distinct n-grams and their training counts, in the order of keys."""
    bounds = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    for batch in batches:
        for row in batch.to_pylist():
            grams = Grams(row, order)
            found: list[tuple] = []
            for part, (keys, counts) in enumerate(zip(grams.keys, grams.counts)):
                by_key = np.argsort(keys)
                keys, counts = keys[by_key], counts[by_key].astype(np.uint32)
                ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                for shard, (a, b) in enumerate(zip(ends, ends[1:])):
                    if b > a:
                        found.append((part, shard, row["chunk"], pack_sorted(keys[a:b]), pack(counts[a:b])))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            names = ["part", "shard", "chunk", "keys", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*found), kinds)], names=names)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all chunks for a partition of asks that is sorted by order and shard."""

    def answered(asks: list[dict]) -> pa.RecordBatch:
        keys = [unpack_sorted(a["keys"]) for a in asks]
        counts = np.concatenate([unpack(a["counts"], np.uint32) for a in asks]).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        by_key = np.argsort(every)
        new = np.ones(len(every), dtype=bool)
        new[1:] = every[by_key][1:] != every[by_key][:-1]
        sums = np.add.reduceat(counts[by_key], np.flatnonzero(new))
        total = np.empty(len(every), dtype=np.uint64)
        total[by_key] = sums[np.cumsum(new) - 1]
        known = [int((sums > 0).sum())] + [0] * (len(asks) - 1)
        totals = [pack(t) for t in np.split(total, ends[:-1])]
        columns = [
            pa.array([a["chunk"] for a in asks]), pa.array([a["part"] for a in asks], type=pa.int32()),
            pa.array([a["shard"] for a in asks], type=pa.int32()), pa.array(totals, type=pa.binary()), pa.array(known),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "shard", "totals", "known"])

    held: list[dict] = []
    for batch in batches:
        for ask in batch.to_pylist():
            if held and (held[0]["part"], held[0]["shard"]) != (ask["part"], ask["shard"]):
                yield answered(held)
                held = []
            held.append(ask)
    if held:
        yield answered(held)


def run_automaton(grams: Grams, totals: list[np.ndarray], first: np.ndarray, prior: float, without: int = 0) -> list[np.ndarray]:
    """Weight (log10) of leaving each n-gram's history by its last word, order by order.

    *first* are the probabilities in the state without a history. A history with
    an arc for the word takes it; another takes its failure arc and goes on from
    the shorter history. *without* is taken off the counts of n-grams and histories.
    """
    weights = [np.log10(first)]
    for n in range(1, len(totals)):
        count = np.maximum(totals[n].astype(np.float64) - without, 0.0)
        history = np.maximum(totals[n - 1][grams.history[n]].astype(np.float64) - without, 0.0)
        below = weights[-1][grams.shorter[n]]
        failed = np.log10(prior / (history + prior)) + below
        arc = np.log10((count + prior * np.power(10.0, below)) / (history + prior))
        weights.append(np.where(count > 0, arc, failed))
    return weights


def _scored(row: dict, answers: list[dict], id_kind: pa.DataType, order: int, train_tokens: int, words: int, priors: tuple[float, ...]) -> pa.Table:
    """Sums of every piece of a chunk for each prior strength, and the chunk's leave-one-out likelihoods."""
    grams = Grams(row, order)
    totals = []
    for part, keys in enumerate(grams.keys):
        of_part = sorted((a for a in answers if a["part"] == part), key=lambda a: a["shard"])
        total = np.empty(len(keys), dtype=np.uint64)
        total[np.argsort(keys)] = np.concatenate([unpack(a["totals"], np.uint64) for a in of_part])
        totals.append(total)
    everything = train_tokens + words + 1
    first = (totals[0] + 1.0) / everything
    ends = np.cumsum(grams.length)
    starts = ends - grams.length

    def of_tokens(values: list[np.ndarray]) -> np.ndarray:
        """The value of the longest n-gram that ends at each token."""
        found = values[0][grams.of_token[0][grams.scored]]
        for n in range(1, len(values)):
            at = grams.of_token[n][grams.scored]
            found = np.where(at >= 0, values[n][at], found)
        return found

    base = np.add.reduceat(np.log10(first)[grams.of_token[0][grams.scored]], starts)
    known = np.add.reduceat((totals[0] > 0)[grams.of_token[0][grams.scored]].astype(np.int64), starts)
    scores, fit = [], []
    held = np.repeat(grams.held_out, grams.length)
    for prior in priors:
        scores.append(np.add.reduceat(of_tokens(run_automaton(grams, totals, first, prior)), starts))
        alone = run_automaton(grams, totals, np.maximum(totals[0], 1).astype(np.float64) / everything, prior, without=1)
        fit.append(float(of_tokens(alone)[~held].sum()))
    pieces = row["pieces"]
    count = len(pieces)
    return pa.table({
        "row": pa.array([p["row"] for p in pieces], type=pa.int64()),
        "doc_id": pa.array([p["id"] for p in pieces], type=id_kind),
        "held_out": pa.array([p["held_out"] for p in pieces]),
        "n_tokens": pa.array(grams.length.astype(np.int64)),
        "n_known": pa.array(known),
        "base_score": pa.array(base),
        "scores": pa.array(list(np.stack(scores, axis=1)), type=pa.list_(pa.float64())),
        "fit": pa.array([fit] + [None] * (count - 1), type=pa.list_(pa.float64())),
    })


def score_documents(
    docs: DataFrame, order: int = ORDER, priors: tuple[float, ...] = PRIORS, chunk_tokens: int = CHUNK_TOKENS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of *docs* (doc_id, text).

    Learns from the rows whose crc32(doc_id) mod 7 is not 2 (a null id counts as
    the empty text). A null or empty text is its end alone. Repeated rows are
    learnt as often as they occur and scored alike. Without a training row all
    scores are 0. Other columns are ignored; an empty table gives no rows.
    """
    id_kind = docs.schema["doc_id"].dataType
    held_out = id_remainder("doc_id", 7) == 2
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), held_out.alias("held_out"),
        whole_text().cast("binary").alias("text"),
    )
    piece = _PIECE.format(id_kind.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("id").type
            break
        else:
            return
        def every() -> Iterator[pa.RecordBatch]:
            yield batch
            yield from batches
        yield from _chunks(every(), chunk_tokens, order, kind)

    chunks = written(
        rows.mapInArrow(cut, f"chunk long, n_tokens long, train_tokens long, train_docs long, pieces array<{piece}>, words binary, tokens binary"), "chunks"
    )
    total = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "train_tokens", "train_docs")]).first()
    shards = max(1, -(-total["n_tokens"] // shard_tokens))
    asks = chunks.mapInArrow(lambda batches: _asks(batches, shards, order), _ASK)
    in_order = asks.repartition("part", "shard").sortWithinPartitions("part", "shard", "chunk")
    answers = written(in_order.mapInArrow(_answers, _ANSWER), "answers")
    known = answers.filter("part = 0").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("n")).first()["n"]
    # The start of a text is a history, but no word.
    train_tokens, words = total["train_tokens"], known - (total["train_docs"] > 0)

    def score(of_chunk: pa.Table, of_answers: pa.Table) -> pa.Table:
        id_kind = of_chunk.schema.field("pieces").type.value_type.field("id").type
        return _scored(of_chunk.to_pylist()[0], of_answers.to_pylist(), id_kind, order, train_tokens, words, priors)

    result = (
        f"row long, doc_id {id_kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double,"
        " scores array<double>, fit array<double>"
    )
    pieces = written(
        chunks.groupBy("chunk").cogroup(answers.drop("known").groupBy("chunk")).applyInArrow(score, result), "piece-scores"
    )
    fits = pieces.agg(*[F.sum(F.col("fit")[i]).alias(str(i)) for i in range(len(priors))]).first()
    best = max(range(len(priors)), key=lambda i: fits[i] or 0.0) if any(fits) else 0
    return pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum(F.col("scores")[best]).alias("score"),
    ).drop("row")
