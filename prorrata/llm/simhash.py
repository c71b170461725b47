"""SimHash fingerprints and exact near-duplicate classes by tiled comparison.

Fingerprints within RADIUS differing bits are linked. They are compared in tiles:
numpy exclusive-or of two tiles and bit counts of the result. Tiles hold
fingerprints sorted by population count, and a pair of tiles is skipped when the
counts differ by more than the radius.

Which fingerprints meet in tiles follows from the pigeonhole principle, so that
no link is lost: of BLOCKS blocks of bits, RADIUS differing bits spare at least
BLOCKS - RADIUS. Every choice of that many blocks is a key, and only
fingerprints with an equal key are compared. Equal texts and equal fingerprints
are one class representative throughout. A key of more than TILE_ROWS
fingerprints is split into tiles by population count and hash, whose pairs are
spread over the cluster.

Links leave a task as spanning forests, never as all pairs. Components are found
by contraction in rounds written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from prorrata.llm.common import whole_text
from prorrata.sources.workarea import written

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = (13, 13, 13, 13, 12)  # widths of the blocks of bits, 64 together
TILE_ROWS = 8192  # most fingerprints of a key, or of a part of a hot key, in one tile group
_TILE = 256  # rows of a tile that numpy compares at a time
_FOREST_LINKS = 200_000  # links kept before they are reduced to a spanning forest


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash over word shingles of the lower-cased (A-Z) text; 0 without a word.

    Words are runs of bytes other than ASCII white space. Shingles count as
    often as they occur; a text of fewer words is one shingle. A bit is 1 if it
    is set in over half of the shingles' XXH64 (seed 42).
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles, count = iter([b" ".join(found)]), 1
    else:
        shingles, count = map(b" ".join, zip(*(found[i:] for i in range(words)))), len(found) - words + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=count)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, 65_536):
        part = hashes[start : start + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprint_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The 64 bits of a text's fingerprint as a long."""
    return _fingerprint_column(text)


def _keys(fingerprint_column: Column) -> Column:
    """One long per choice of the blocks that stay equal: the choice's number above, the equal bits below."""
    offsets = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key, filled = F.lit(number), 0
        for block in chosen:
            width = BLOCKS[block]
            bits = F.shiftrightunsigned(fingerprint_column, offsets[block]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key.cast("long"), width).bitwiseOR(bits)
            filled += width
        keys.append(key.cast("long"))
    return F.array(*keys)


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row linked to each of *count* rows, directly or over others."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def tile_links(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of equal group, as two arrays of row numbers.

    Rows must be sorted by group and population count.
    """
    ones = np.bitwise_count(prints).astype(np.int16)
    count = len(prints)
    kept: list[np.ndarray] = []
    total = 0
    for a in range(0, count, _TILE):
        a_end = min(a + _TILE, count)
        for b in range(a, count, _TILE):
            b_end = min(b + _TILE, count)
            if groups[b] != groups[a_end - 1]:
                if b > a:
                    break  # no row of the two tiles shares a group
            elif groups[a] == groups[b_end - 1] and ones[b] - ones[a_end - 1] > radius:
                break  # one group: this tile and all after it have too many ones
            near = np.bitwise_count(prints[a:a_end, None] ^ prints[None, b:b_end]) <= radius
            near &= groups[a:a_end, None] == groups[None, b:b_end]
            if a == b:
                near = np.triu(near, 1)
            left, right = np.nonzero(near)
            if len(left):
                kept.append(np.stack([left + a, right + b]))
                total += len(left)
                if total > _FOREST_LINKS:
                    kept, total = [_forest(count, kept)], 0
    links = _forest(count, kept) if kept else np.zeros((2, 0), dtype=np.int64)
    return links[0], links[1]


def _forest(count: int, kept: list[np.ndarray]) -> np.ndarray:
    links = np.concatenate(kept, axis=1)
    root = _roots(count, links[0], links[1])
    rows = np.flatnonzero(root != np.arange(count))
    return np.stack([rows, root[rows]])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within groups of a partition that is sorted by group and population count."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (rows["key"] == rows["key"].iloc[-1]) & (rows["pair"] == rows["pair"].iloc[-1])
        rest = rows[last]
        yield from _links_of(rows[~last])
    if rest is not None:
        yield from _links_of(rest)


def _links_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(rows) < 2:
        return
    key, pair = rows["key"].to_numpy(), rows["pair"].to_numpy()
    groups = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))])
    prints = rows["print"].to_numpy()
    left, right = tile_links(groups, prints.view(np.uint64))
    if len(left):
        yield pd.DataFrame({"a": prints[left], "b": prints[right]})


def fingerprint_links(prints: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print) that connect all within the radius."""
    keyed = prints.select("print", F.explode(_keys(F.col("print"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = written(
        keyed.join(counts, "key").select("key", "print", F.bit_count("print").alias("ones"), (F.col("rows") > tile_rows).alias("hot")),
        "shared-keys",
    )
    cold = shared.filter("NOT hot").select("key", F.lit(0).cast("long").alias("pair"), "print", "ones")
    hot = shared.filter("hot")
    parts = hot.groupBy("key", "ones").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))
    placed = hot.join(parts, ["key", "ones"]).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")))
    others = parts.select(F.col("key").alias("_key"), F.col("ones").alias("_ones"), F.col("parts").alias("_parts"))
    tile = F.col("ones") * F.lit(1 << 24) + F.col("part")
    other = F.col("_ones") * F.lit(1 << 24) + F.col("_part")
    crossed = (
        placed.join(others, (F.col("key") == F.col("_key")) & (F.abs(F.col("ones") - F.col("_ones")) <= RADIUS))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select("key", (F.least(tile, other) * F.lit(1 << 31) + F.greatest(tile, other) + 1).alias("pair"), "print", "ones")
    )
    tiles = cold.unionByName(crossed).repartition("key", "pair").sortWithinPartitions("key", "pair", "ones", "print")
    return tiles.mapInPandas(_compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected *links* (a, b): equal roots mean one component.

    Each round every node points to the smallest of itself and its neighbours
    (in the order of a hash, so that chains shrink by a constant factor), the
    links are redrawn between the nodes pointed to, and links within one node
    go. Rounds are logarithmic in the size of the largest component.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    current = written(both, "links")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        first = current.groupBy("a").agg(F.min(order("b")).alias("_b"))
        step = written(
            first.select(F.col("a").alias("node"), F.least(order("a"), F.col("_b"))["v"].alias("parent")), "parents"
        )
        steps.append(step)
        to = lambda c: step.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}"))
        moved = current.join(to("a"), "a").join(to("b"), "b")
        current = written(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "links")
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select("node", F.col("parent").alias("root"))
    for step in steps[1:]:
        up = step.select(F.col("node").alias("_node"), F.col("parent").alias("_up"))
        found = found.join(up, F.col("root") == F.col("_node"), "left").select(
            "node", F.coalesce("_up", "root").alias("root")
        )
    return found


def near_duplicates(docs: DataFrame, tile_rows: int = TILE_ROWS, id_column: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, component_id of every row of *docs* (id, text; other columns are ignored).

    component_id is the smallest id that links reach. Null and empty texts, and
    texts without a word, have fingerprint zero and are linked like any other. A
    null id is ignored when the smallest id is sought (null if there is no
    other). Repeated rows stay; an empty table gives no rows.
    """
    prints = written(
        docs.select(F.col(id_column).alias("doc_id"), fingerprint_of(whole_text()).alias("print")), "fingerprints"
    )
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(fingerprint_links(classes.select("print"), tile_rows))
    rooted = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    linked = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.select("print", "root").join(linked, "root").select("print", "component_id")
    return prints.join(members, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
