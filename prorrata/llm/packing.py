"""Packing of documents into sequences of WINDOW tokens by best-fit decreasing.

A document is its token ids and an end id. What fills whole windows is cut off
first, one sequence per window; what remains, shorter than a window, is packed
longest first into the open sequence with the least sufficient room. Open
sequences are found by a segment tree indexed by remaining capacity.

Only lengths and checksums of pieces are shuffled, never ids or texts. Pieces are
packed in blocks of about BLOCK_PIECES, independent of each other, so the number
of tasks grows with the input and a repeated document is as good as any other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prorrata.llm.bytebpe import RankEncoder
from prorrata.llm.common import whole_text
from prorrata.sources.workarea import written

WINDOW = 1024
END_ID = 0
BLOCK_PIECES = 8192
_SEGMENT = 1_000_000  # characters of a long text that are encoded at a time
_STABLE = re.compile(r"(?<=\S) (?=\S)")

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def document_ids(text: str, encode: Callable[[str], np.ndarray], segment: int = _SEGMENT) -> np.ndarray:
    """Ids of a whole text and the end id; long texts are encoded in segments between stable positions (see bytebpe)."""
    found, begin = [], 0
    while len(text) - begin > segment and (stable := _STABLE.search(text, begin + segment)):
        found.append(encode(text[begin : stable.start()]))
        begin = stable.start()
    found.append(encode(text[begin:]))
    return np.concatenate([*found, np.array([END_ID], dtype="<u4")])


def cut(ids: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of the full windows of a document and of what remains."""
    return [
        (start, min(window, len(ids) - start), zlib.crc32(ids[start : start + window].tobytes()))
        for start in range(0, len(ids), window)
    ]


def pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of *docs* (doc_id, text), with their ids on demand."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = RankEncoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids = document_ids(text, encoder.encode)
                for start, length, crc in cut(ids):
                    row = (None if pd.isna(doc_id) else doc_id, start, length, crc, len(ids))
                    rows.append((*row, ids[start : start + length].astype(np.int32)) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"doc_id": "Int64"}) if id_type in ("bigint", "int") else frame

    schema = f"doc_id {id_type}, {_PIECE}" + ", ids array<int>" * with_ids
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(tokenised, schema)


class Openings:
    """Open sequences by remaining capacity; a segment tree finds the least sufficient one."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open sequences below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the tightest opening for *length*, which is closed; None if none is wide enough."""
        tree, node = self.tree, self.leaves + length
        while not tree[node]:  # climb until a subtree to the right has an opening
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not tree[node]:
                node += 1
        capacity = node - self.leaves
        while node:
            tree[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are taken longest first, equal ones in the given order."""
    sequences, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    openings, count = Openings(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = openings.take(length) if length < window else None
        if found is None:
            capacity, sequence = window, count
            count += 1
        else:
            capacity, sequence = found
        sequences[i], offsets[i] = sequence, window - capacity
        if capacity > length:
            openings.put(capacity - length, sequence)
    return sequences, offsets


def pack_pieces(found: DataFrame, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """*found* (with a column length) with sequence_id and offset. Blocks are drawn from the rows' written places."""
    placed = written(found.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-placed.count() // block_pieces))
    columns = placed.columns[:-1]

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_at", kind="stable", ignore_index=True)
        sequences, offsets = best_fit(block["length"].to_numpy())
        block["sequence_id"] = block["_block"].to_numpy() * (1 << 32) + sequences
        block["offset"] = offsets
        return block[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "_at")
    return (
        placed.withColumn("_block", F.pmod(F.xxhash64("_at"), F.lit(blocks)))
        .groupBy("_block")
        .applyInPandas(pack, f"{schema}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of *docs* (doc_id, text; other columns are ignored).

    *path* is a byte-level BPE file. A null text counts as empty: one piece that
    holds the end id. A null doc_id is kept. Repeated rows are packed each by
    itself; an empty table gives no rows. Sequences are gapless from offset 0.
    """
    return pack_pieces(pieces(docs, path, with_ids))
