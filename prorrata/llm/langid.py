"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text accepts every substring
of that text. A document is parsed greedily into the longest phrases that occur
in a language's text; the more foreign the text, the more phrases. Phrase counts
are normalised to bits per character, phrases * log2(reference length) / length,
and the language with the fewest bits wins.

The references are built from a bounded sample of labelled rows: at most
SAMPLE_DOCS per language, of each an equal share of the REFERENCE_CHARS, more of
the others where one is short. Automata are kept as hash tables of their edges,
so their size depends on the length of the references alone, not on the number
of letters. Predictions read whole texts. Documents are cut into blocks of BLOCK characters that are parsed side by side,
one numpy step per character position; a phrase ends with its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prorrata.llm.common import id_remainder, sample_window, shared_value, smallest_hashes

SAMPLE_DOCS = 96  # labelled documents per language, at most
SAMPLE_CHARS = 4_000  # of a longer document a window of so many characters, at a place given by its hash
REFERENCE_CHARS = 24_000  # characters of reference text per language, at most
ALL_REFERENCE_CHARS = 4_000_000  # of all languages together; with more than 166 languages each gets an equal share
ALL_SAMPLE_DOCS = 16_000  # of all languages together, and at least one of each
MAX_LANGUAGES = 4_096  # values of lang that are learned, the most frequent ones
BLOCK = 512
TEMPERATURE = 8.0  # bits of evidence per factor of two in the score
_CHUNK_CHARS = 1_500_000  # characters that are parsed at a time
_SEPARATOR, _UNKNOWN, _FIRST_LETTER = 0, 1, 2
_STATE_BITS = 20  # of an edge's entry for the next state; automata have at most 2 * REFERENCE_CHARS states
_STATE_MASK = (1 << _STATE_BITS) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letter_classes(texts: list[str]) -> np.ndarray:
    """Class of every code point: separator, letter outside the sample, or a letter of its own."""
    classes = np.zeros(0x110000, dtype=np.int32)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    classes[letters] = _UNKNOWN
    for number, letter in enumerate(sorted({c for text in texts for c in text.lower() if c.isalpha()})):
        classes[ord(letter)] = _FIRST_LETTER + number
    return classes


def encode(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in one array, and where each text starts (one more entry at the end).

    Letters are lower-cased; a run of other characters is one separator, and
    none stands before the first letter.
    """
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    kinds = classes[points]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    separator = kinds == _SEPARATOR
    before = np.empty_like(separator)
    before[1:] = separator[:-1]
    before[starts[:-1][lengths > 0]] = True
    keep = ~(separator & before)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kinds[keep], kept[starts]


def suffix_automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 spell the substrings of *sequence*."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in sequence.tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[state] = copy
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
        last = state
    return following


def equal_shares(lengths: list[int], total: int) -> list[int]:
    """How much of each length to take, so that all are *total* at most and none is cut while a longer one is not."""
    taken = [0] * len(lengths)
    for rank, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        taken[i] = min(lengths[i], total // (len(lengths) - rank))
        total -= taken[i]
    return taken


def reference(texts: list[str], classes: np.ndarray, total: int) -> np.ndarray:
    """Classes of at most *total* characters of *texts*, an equal share of each; a separator stands between texts."""
    sequence, starts = encode(texts, classes)
    found: list[np.ndarray] = []
    for text, start, length, share in zip(texts, starts, np.diff(starts), equal_shares(np.diff(starts).tolist(), total)):
        if share:
            first = start + zlib.crc32(text.encode()) % (int(length) - share + 1)
            found += [np.array([_SEPARATOR], dtype=classes.dtype)] if found else []
            found.append(sequence[first : first + share])
    return np.concatenate(found)[:total] if found else sequence[:0]


class Automaton:
    """A suffix automaton as a table of its edges, with open addressing.

    An entry holds state * symbols + symbol above _STATE_BITS, and the next
    state below. At most a third of the slots are taken.
    """

    def __init__(self, sequence: np.ndarray, symbols: int):
        following = suffix_automaton(sequence)
        assert len(following) <= _STATE_MASK
        self.symbols = symbols
        self.root = np.zeros(symbols, dtype=np.int64)
        for symbol, state in following[0].items():
            self.root[symbol] = state
        keys = np.fromiter((s * symbols + x for s, e in enumerate(following) for x in e), dtype=np.int64)
        states = np.fromiter((t for e in following for t in e.values()), dtype=np.int64, count=len(keys))
        size_bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size_bits), (1 << size_bits) - 1
        self.slots = np.full(1 << size_bits, -1, dtype=np.int64)
        entries, slot, left = (keys << _STATE_BITS) | states, self._slot(keys), np.arange(len(keys))
        while len(left):
            open_ = left[self.slots[slot[left]] < 0]
            _, first = np.unique(slot[open_], return_index=True)
            self.slots[slot[open_[first]]] = entries[open_[first]]
            left = left[self.slots[slot[left]] != entries[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of the greedy parse: the next states, which lanes end phrases there, and how many each of them ends.

        None ends while the match goes on; one when it breaks, and one more if the
        breaking symbol does not occur in the reference at all.
        """
        keys = states * self.symbols + symbols
        slot = self._slot(keys)
        entries = self.slots[slot]
        hit = (entries >> _STATE_BITS) == keys
        left = np.flatnonzero(~hit & (entries >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            entries[left] = tried = self.slots[slot[left]]
            hit[left] = same = (tried >> _STATE_BITS) == keys[left]
            left = left[~same & (tried >= 0)]
        broken = np.flatnonzero(~hit)
        following = entries & _STATE_MASK
        following[broken] = again = self.root[symbols[broken]]
        return following, broken, (states[broken] != 0).astype(np.int64) + (again == 0)


class Languages:
    """The references of all languages, ready for parsing."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        self.classes = letter_classes([t for name in self.names for t in samples[name]])
        symbols = int(self.classes.max()) + 1
        most = min(REFERENCE_CHARS, ALL_REFERENCE_CHARS // max(1, len(self.names)))
        self.automata, bits = [], []
        for name in self.names:
            sequence = reference(samples[name], self.classes, most)
            self.automata.append(Automaton(sequence, symbols))
            bits.append(np.log2(max(2, len(sequence))))
        self.bits = np.array(bits)

    def phrases(self, sequence: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        lengths = np.diff(starts)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + within * BLOCK
        size = np.minimum(starts[owner + 1] - begin, BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        counts = np.zeros((len(lengths), len(self.names)), dtype=np.int64)
        if not len(owner):
            return counts
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        symbols = np.zeros((size[0], len(owner)), dtype=np.int64)
        for step, lanes in enumerate(active):
            symbols[step, :lanes] = sequence[begin[:lanes] + step]
        for number, automaton in enumerate(self.automata):
            state = np.zeros(len(owner), dtype=np.int64)
            found = np.ones(len(owner), dtype=np.int64)  # the phrase that the block's end closes
            for step, lanes in enumerate(active):
                state[:lanes], broken, ended = automaton.step(state[:lanes], symbols[step, :lanes])
                found[broken] += ended
            np.add.at(counts[:, number], owner, found)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` with score 0 without letters or without languages."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t] if self.names else []
        while known:
            total, upto = 0, 0
            while upto < len(known) and (upto == 0 or total + len(texts[known[upto]]) <= _CHUNK_CHARS):
                total += len(texts[known[upto]])
                upto += 1
            chunk, known = known[:upto], known[upto:]
            sequence, starts = encode([texts[i] for i in chunk], self.classes)
            spent = self.phrases(sequence, starts) * self.bits
            best = spent.argmin(axis=1)
            weight = np.exp2((spent.min(axis=1, keepdims=True) - spent) / TEMPERATURE)
            score = 1.0 / weight.sum(axis=1)
            for row, i in enumerate(chunk):
                if starts[row + 1] > starts[row]:
                    names[i], scores[i] = self.names[best[row]], score[row]
        return names, scores


def learn(labelled: DataFrame) -> Languages:
    """References from a bounded sample of (doc_id, text, lang) rows.

    Per language the rows with the smallest hash of their id are taken, so the
    sample does not depend on partitioning; of a long text a window is taken.
    Rows without a language or a text are no part of it.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    frequent = {r["lang"]: r["count"] for r in most.collect()}
    if not frequent:
        return Languages({})
    chosen = smallest_hashes(rows, "lang", "doc_id", frequent, min(SAMPLE_DOCS, max(1, ALL_SAMPLE_DOCS // len(frequent))))
    # Bounded: ALL_SAMPLE_DOCS ids.
    picked = rows.join(F.broadcast(chosen.withColumnsRenamed({"lang": "_lang", "doc_id": "_id"})),
                       (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    windows = picked.select("lang", "doc_id", sample_window(F.col("text"), SAMPLE_CHARS).alias("text"))
    texts = windows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(texts, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0)):
        samples.setdefault(row["lang"], []).append(row["text"])
    return Languages({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)})


def language_of(docs: DataFrame, text: Column, model: Languages) -> Column:
    """struct(lang_pred, score) of a text column. The model's size is bounded by ALL_REFERENCE_CHARS."""
    shared = shared_value(docs.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared()
        for texts in batches:
            names, scores = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every row of *docs* (doc_id, text, lang; other columns are ignored).

    Learns only from rows whose crc32(doc_id) mod 3 is not 1. A null or empty
    text, or one without a letter, is ``und`` with score 0; so is every text if
    there is no labelled row. Ties go to the first language by name. Repeated
    rows are predicted alike; an empty table gives no rows.
    """
    remainder = id_remainder("doc_id", 3)
    model = learn(docs.filter(remainder != 1))
    rows = docs.select("doc_id", (remainder == 1).alias("held_out"), language_of(docs, F.col("text"), model).alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
