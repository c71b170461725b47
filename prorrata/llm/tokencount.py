"""Token counts of texts of any length by overlapping chunks.

A text of at most CHUNK characters is encoded as a whole, by the rank encoder
(see bytebpe). A longer one is cut into chunks that overlap; each chunk is
encoded by the library with offsets, and
two neighbours are spliced at a stable position (see bytebpe) inside their
overlap at which both encodings begin a token: left of it the first chunk's
tokens hold, from it on the second's. Where no such position exists, the overlap
is widened up to the whole chunk, and then a chunk of twice its length replaces
it; so a text that offers no stable position is encoded about twice in all.
Memory is bounded by the chunk, unless the text itself offers no such position.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from prorrata.llm.bytebpe import RankEncoder, stable_positions
from prorrata.llm.common import whole_text

CHUNK = 16_384  # characters
OVERLAP = 256  # characters that neighbours share at first
LIMIT = 1024  # tokens from which a document is over the limit


def _encoded(tokenizer, text: str) -> tuple[list[int], int]:
    """Start offsets of the tokens of a chunk, in characters of the chunk, and their number."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    return [start for start, _ in encoding.offsets], len(encoding.offsets)


def splice_point(text: str, left: list[int], left_at: int, right: list[int], right_at: int, end: int) -> int:
    """Last stable position of [right_at + 1, end) at which both chunks begin a token; -1 if there is none.

    *left* and *right* are the token starts of chunks that begin at left_at and
    right_at; the left one ends at *end*. The overlap's last character is left
    out: what follows it was not seen by the left chunk.
    """
    for place in reversed(stable_positions(text, right_at + 1, end - 1)):
        in_left = bisect.bisect_left(left, place - left_at)
        in_right = bisect.bisect_left(right, place - right_at)
        if in_left < len(left) and in_right < len(right) and left[in_left] == place - left_at and right[in_right] == place - right_at:
            return place
    return -1


def count_long(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks; equal to encoding it whole."""
    total, begin, valid = 0, 0, 0  # tokens before `valid` are counted; the chunk at hand begins at `begin`
    end = min(begin + chunk, len(text))
    left, count = _encoded(tokenizer, text[begin:end])
    while end < len(text):
        shared, place, start = overlap, -1, max(begin, end - overlap)
        while start > begin and place <= valid:
            if stable_positions(text, start + 1, end - 1):
                stop = min(end + chunk, len(text))
                right, right_count = _encoded(tokenizer, text[start:stop])
                place = splice_point(text, left, begin, right, start, end)
            if place <= valid:
                shared *= 2
                start = max(begin, end - shared)
        if place <= valid:  # nothing in the whole chunk is stable: one of twice its length replaces it
            place, start, stop = valid, begin, min(2 * end - begin, len(text))
            right, right_count = _encoded(tokenizer, text[start:stop])
        total += bisect.bisect_left(left, place - begin) - bisect.bisect_left(left, valid - begin)
        valid, begin, end, left, count = place, start, stop, right, right_count
    return total + count - bisect.bisect_left(left, valid - begin)


def count_texts(texts: list[str], encoder: RankEncoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    return [
        count_long(t, encoder.tokenizer, chunk, overlap) if len(t) > chunk else len(encoder.ids(t)) for t in texts
    ]


def tokens_of(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = RankEncoder(path)
        for texts in batches:
            yield pd.Series(count_texts(list(texts), encoder, chunk, overlap), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of *docs* (doc_id, text; other columns are ignored).

    *path* is a byte-level BPE file of the tokenizers library, readable on every
    worker. A null text counts as empty: no bytes, no tokens. Special strings in
    a text are read as the library does by default. Repeated rows count alike; an
    empty table gives no rows. The text does not leave the scan.
    """
    text = whole_text()
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens_of(text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
