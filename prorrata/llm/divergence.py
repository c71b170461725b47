"""Quality rules by distribution divergence from language references.

A reference of a language holds two histograms over all its documents: character
classes, and common words. A document fails if the Jensen-Shannon distance
(square root of the base-2 divergence, 0 to 1) of one of its own histograms from
the reference exceeds a limit. A histogram of few items is mostly noise, so each
distance is judged only from a minimum length on.

Languages of LANGUAGE_SHARE of all bytes or more get a reference. Common words are
all words that make up COMMON_SHARE of a language or more. They are found exactly
without a count per distinct word: each task keeps a mergeable frequent-items
summary of SUMMARY_WORDS counters per language, summaries are merged in a tree,
and a word of that share cannot be missing from the result; a second pass counts
the words left over everywhere. So references have at most 1 / COMMON_SHARE words
for each of 1 / LANGUAGE_SHARE languages, and a task or the driver holds at most
SUMMARY_WORDS for each, whatever the input. Documents of other languages, or of
none, are held against the nearest reference.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from prorrata.llm.common import process_cache, shared_value, whole_text
from prorrata.sources.workarea import written

COMMON_SHARE = 1 / 200
LANGUAGE_SHARE = 1 / 500
MIN_CHARS = 200  # least characters for the distance of character classes
MIN_WORDS = 40  # least words for the distance of common words
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
MIN_BASE_WORDS = 10
WINDOW = 5
SUMMARY_WORDS = 1000  # counters of a summary; more than 1 / COMMON_SHARE
_MERGED = 64  # summaries that one task merges
_EDGE = b".,;:!?\"'()[]"
_SYMBOLS = str.maketrans("", "", "[#*$%&|<>]")
# Character classes: lower, upper and other letters, marks, numbers, sentence punctuation, other
# punctuation, symbols, everything else.
CLASSES = 9


def _class_of(point: int) -> int:
    letter = chr(point)
    if letter in ".,;:!?'\"()-":
        return 5
    kind = unicodedata.category(letter)
    return {"Ll": 0, "Lu": 1}.get(kind, {"L": 2, "M": 3, "N": 4, "P": 6, "S": 7}.get(kind[0], 8))


def class_table() -> np.ndarray:
    cache = process_cache("classes")
    if "table" not in cache:
        cache["table"] = np.fromiter(map(_class_of, range(0x110000)), dtype=np.uint8, count=0x110000)
    return cache["table"]


def class_counts(text: str) -> np.ndarray:
    return np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)], minlength=CLASSES)


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; what is left empty is no word."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode().split()) if w]


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one of them is empty."""
    if not a.sum() or not b.sum():
        return 1.0
    p, q = a / a.sum(), b / b.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / middle), 0).sum() + np.where(q > 0, q * np.log2(q / middle), 0).sum()
    return math.sqrt(min(1.0, max(0.0, float(terms) / 2)))


@dataclass
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]  # bin of each common word; the last bin holds all other words
    counts: np.ndarray

    def distances(self, classes: np.ndarray, words: Counter) -> tuple[float, float]:
        own = np.zeros(len(self.counts))
        for word, place in self.words.items():
            own[place] = words.get(word, 0)
        own[-1] = words.total() - own.sum()
        return distance(classes, self.classes), distance(own, self.counts)


def summary(counts: Counter, size: int = SUMMARY_WORDS) -> Counter:
    """At most *size* counters: the (size + 1)th largest count is taken off all.

    Whatever is taken off is taken off more than *size* words at a time, so
    over any order of additions and merges a counter falls short of the word's
    count by at most all words / (size + 1).
    """
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


_SUMMARY = "lang string, part int, word string, n long"


def _summary_rows(part: int, counts: dict[str, Counter], totals: Counter) -> pd.DataFrame:
    """A summary as rows; the count of all words of a language stands with the word null."""
    found = [(lang, part, w.decode(), n) for lang, words in counts.items() for w, n in summary(words).items()]
    found += [(lang, part, None, n) for lang, n in totals.items()]
    return pd.DataFrame(found, columns=["lang", "part", "word", "n"]).astype({"part": "int32", "n": "int64"})


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary a task."""
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = plain_words(text)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(words)
            if len(own) > 50 * SUMMARY_WORDS:
                counts[lang] = summary(own)
    task = TaskContext.get()
    yield _summary_rows(task.partitionId() if task else 0, counts, totals)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The summary of the summaries of one language."""
    lang, part = rows["lang"].iloc[0], int(rows["part"].iloc[0]) // _MERGED
    words: Counter = Counter()
    for word, n in zip(rows["word"], rows["n"]):
        if word is not None:
            words[word.encode()] += int(n)
    return _summary_rows(part, {lang: words}, Counter({lang: int(rows["n"][rows["word"].isna()].sum())}))


def candidate_words(rows: DataFrame) -> dict[str, list[bytes]]:
    """Per language of *rows* (lang, text) all words of the share COMMON_SHARE, and perhaps some rarer ones, in order."""
    found = written(rows.mapInPandas(_summaries, _SUMMARY), "word-summaries")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        found = found.groupBy("lang", F.floor(F.col("part") / _MERGED)).applyInPandas(_merged, _SUMMARY)
        parts = -(-parts // _MERGED)
        if parts == 1:
            break
    counted, totals = {}, {}
    for r in found.collect():  # at most SUMMARY_WORDS for each of 1 / LANGUAGE_SHARE languages
        if r["word"] is None:
            totals[r["lang"]] = r["n"]
        else:
            counted.setdefault(r["lang"], {})[r["word"].encode()] = r["n"]
    candidates = {}
    for lang, total in totals.items():
        words = counted.get(lang, {})
        short = (total - sum(words.values())) / (SUMMARY_WORDS + 1)
        candidates[lang] = sorted(w for w, n in words.items() if n + short >= COMMON_SHARE * total * (1 - 1e-9))
    return candidates


def frequent_languages(docs: DataFrame) -> list[str]:
    """Languages of LANGUAGE_SHARE of the bytes of all tagged texts or more: at most 1 / LANGUAGE_SHARE."""
    sizes = docs.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    sizes = written(sizes, "language-sizes")
    whole = sizes.agg(F.sum("size")).first()[0] or 0
    return sorted(r["lang"] for r in sizes.filter((F.col("size") > 0) & (F.col("size") >= LANGUAGE_SHARE * whole)).collect())


def references(docs: DataFrame) -> dict[str, Reference]:
    """References of all frequent languages of *docs* (text, lang); rows without either give nothing."""
    rows = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.filter(F.col("lang").isin(frequent_languages(docs)))
    candidates = {lang: {w: i for i, w in enumerate(words)} for lang, words in candidate_words(rows).items()}
    if not candidates:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per language: class counts, counts of the proposed words, and all words."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                bins = shared.value.get(lang)
                if bins is None:
                    continue
                words = Counter(plain_words(text))
                row = sums.setdefault(lang, np.zeros(CLASSES + len(bins) + 1, dtype=np.int64))
                row[:CLASSES] += class_counts(text)
                for word in words.keys() & bins.keys():
                    row[CLASSES + bins[word]] += words[word]
                row[-1] += words.total()
        found = [(lang, place, int(n)) for lang, row in sums.items() for place, n in enumerate(row)]
        yield pd.DataFrame(found, columns=["lang", "place", "n"]).astype({"place": "int32", "n": "int64"})

    summed = rows.mapInPandas(totals, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows_of: dict[str, np.ndarray] = {}
    for r in summed.collect():
        row = rows_of.setdefault(r["lang"], np.zeros(CLASSES + len(candidates[r["lang"]]) + 1))
        row[r["place"]] = r["n"]
    found = {}
    for lang, row in rows_of.items():
        total, counts = row[-1], row[CLASSES:-1]
        if total:
            common = [(w, counts[i]) for w, i in candidates[lang].items() if counts[i] >= COMMON_SHARE * total]
            own = np.array([n for _, n in common] + [total - sum(n for _, n in common)])
            found[lang] = Reference(row[:CLASSES], {w: i for i, (w, _) in enumerate(common)}, own)
    return found


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    characters = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    lines, duplicates = set(), 0
    for line in text.split("\n"):
        if line.encode().strip():
            duplicates += line in lines
            lines.add(line)
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        starts = np.flatnonzero(np.fromiter((w in often for w in windows), dtype=bool, count=len(windows)))
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
        repeated = int((np.cumsum(covered) > 0).sum())
    return len(words), characters, len(text) - len(text.translate(_SYMBOLS)), duplicates, repeated


_JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " char_distance double, word_distance double, kept boolean"
)


def judge(text: str, lang: str | None, found: dict[str, Reference]) -> tuple:
    """The columns of _JUDGED for one text. A distance is null below its minimum length, or without references."""
    counts = base_counts(text)
    failed = counts[0] < MIN_BASE_WORDS or 100 * counts[4] > 20 * counts[0]
    chars = words = None
    if found and (len(text) >= MIN_CHARS or counts[0] >= MIN_WORDS):
        classes, own = class_counts(text), Counter(plain_words(text))
        near = [found[lang]] if lang in found else list(found.values())
        chars, words = min((r.distances(classes, own) for r in near), key=lambda d: (d[1], d[0]))
        chars = chars if len(text) >= MIN_CHARS else None
        words = words if counts[0] >= MIN_WORDS else None
    far = (chars is not None and chars > MAX_CHAR_DISTANCE) or (words is not None and words > MAX_WORD_DISTANCE)
    return (*counts, failed, chars, words, not failed and not far)


def verdict_of(docs: DataFrame, text: Column, lang: Column, found: dict[str, Reference]) -> Column:
    """Struct of the verdict on a text column. The references are bounded (see the module's text)."""
    shared = shared_value(docs.sparkSession, found)
    names = [part.split()[0] for part in _JUDGED.split(",")]

    @F.pandas_udf(_JUDGED)
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = shared()
        for texts, langs in batches:
            rows = [judge(t, x, found) for t, x in zip(texts, langs)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"char_distance": "float64", "word_distance": "float64", "base_failed": bool, "kept": bool})

    return verdict(text, lang)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and verdict for every row of *docs* (doc_id, text, lang; other columns are ignored).

    A null text counts as empty: no words, so it fails the base rules. A null
    lang, or one without a reference, takes the nearest reference by common
    words. Repeated rows are judged alike; an empty table gives no rows.
    """
    found = references(docs)
    rows = docs.select("doc_id", verdict_of(docs, whole_text(), F.col("lang"), found).alias("_v"))
    return rows.select("doc_id", "_v.*")
