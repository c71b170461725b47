"""Conversation prefix trie by bursting containers.

A conversation is a sequence of turn ids of _LETTER bytes each (MD5 of role and
text, then the bytes of the text), so sequences compare as binary strings. Equal
sequences are one entry with the number of its conversations.

At first one container under the root holds all entries. A container of more
than CONTAINER_ROWS entries, or CONTAINER_BYTES of suffixes, bursts: the turns that
all its entries share and the node they end in become trie heads, and each next
turn id gets a container of its own. Rounds go on until no container is too
large; an entry alone never bursts. The containers left are sorted and swept
into nodes: neighbours share as many nodes as turns, so the path at hand is a
stack, and a node is complete when the sweep leaves it. Leaves and saved tokens of
the heads are summed over their containers, from the last round to the first.

Memory: a conversation's sequence (_LETTER bytes a turn) is one value; a container
is bounded unless it is one entry; ids of equal conversations are hashed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.llm.common import crc32_of, whole_text
from prorrata.sources.workarea import written

CONTAINER_ROWS = 512
CONTAINER_BYTES = 4 << 20
BLOCK_IDS = 10_000  # ids of equal conversations that are joined at a time
FAMILY, SHARED_TURNS = 5, 9  # the rebuilding rule of the query's contract
_LETTER = 24
_BATCH_ROWS = 50_000
_NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string"
)
_SWEPT = f"{NODE}, up binary"  # with up: the sums of a container for the head above it


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, letters: the turn ids of every conversation in order, in hexadecimal digits.

    Turns are ordered by number, null first; turns of one number by role, then text.
    """
    role, text = whole_text("role"), whole_text("text")
    letter = F.concat(
        F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8")),
        F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"),
    )
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), letter.alias("letter"),
        role.alias("role"), text.alias("text"),
    )

    def gathered(rows: DataFrame, place: Column) -> DataFrame:
        item = F.struct("numbered", "turn", place.alias("place"), "letter")
        return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    first = written(gathered(turns, F.lit(0)), "turn-sequences")
    before, after = F.slice("items", 1, F.size("items") - 1), F.slice("items", 2, F.size("items") - 1)

    def differ(a: Column, b: Column) -> Column:
        return (a["numbered"] == b["numbered"]) & (a["turn"] == b["turn"]) & (a["letter"] != b["letter"])

    tied = F.exists(F.zip_with(before, after, differ), lambda x: x)
    ids = written(first.filter(tied).select("conv_id"), "tied")
    if ids.isEmpty():
        return first.select("conv_id", F.transform("items", lambda x: x["letter"]).alias("letters"))
    # Only conversations in which a number has different turns are read again, with their texts.
    again = turns.join(ids, "conv_id", "left_semi")
    place = F.dense_rank().over(W.partitionBy("conv_id", "numbered", "turn").orderBy("role", "text"))
    ranked = gathered(again.withColumn("place", place).drop("role", "text"), F.col("place"))
    every = first.filter(~tied).unionByName(ranked)
    return every.select("conv_id", F.transform("items", lambda x: x["letter"]).alias("letters"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c mod FAMILY, h = crc32(c) mod SHARED_TURNS."""
    place = F.pmod(F.col("conv_id"), F.lit(FAMILY))
    heads = sequences.filter(place == 0).select(
        F.col("conv_id").alias("_family"), F.slice("letters", 1, SHARED_TURNS - 1).alias("_head")
    )
    shared = F.pmod(crc32_of(F.col("conv_id").cast("string")), F.lit(SHARED_TURNS)).cast("int")
    family = F.col("conv_id") - place
    own = F.slice("letters", F.col("_h") + 1, F.greatest(F.size("letters") - F.col("_h"), F.lit(0)))
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), F.col("_h"))
    return sequences.withColumn("_h", shared).join(heads, family == F.col("_family"), "left").select(
        "conv_id", F.concat(head, own).alias("letters")
    )


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id, joined to blocks of ids of one key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key"), batch.column("conv_id").to_numpy().tolist()
        plain = keys.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), len(ids)]
        cuts = [(i, min(i + BLOCK_IDS, b)) for a, b in zip(starts, starts[1:]) for i in range(a, b, BLOCK_IDS)]
        at = pa.array([a for a, _ in cuts])
        joined = pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], type=pa.string())
        yield pa.RecordBatch.from_arrays([keys.take(at), pa.array([ids[a] for a, _ in cuts]), joined], names=["key", "first", "ids"])


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each key, which come in order and may spread over batches."""
    key, running = None, None
    for batch in batches:
        done: list[tuple] = []
        for next_key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if next_key != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = next_key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _hashes(done)
    if running is not None:
        yield _hashes([(key, running.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], type=pa.string()), pa.array([h for _, h in rows], type=pa.string())], names=["key", "ends"]
    )


def entries(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of *conversations* (conv_id, letters): seq, conv_id, n, ends.

    conv_id is the smallest, n the number of conversations, ends the hash of
    their ids. Ids are sorted by ranges, so a sequence that very many
    conversations share is sorted by many tasks; its blocks are hashed in one stream.
    """
    seq = F.unhex(F.array_join("letters", ""))
    rows = written(conversations.select("conv_id", seq.alias("seq")).withColumn("key", F.sha2("seq", 256)), "sequences")
    order = ["key", "conv_id"]
    blocks = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _id_blocks, "key string, first long, ids string"
    )
    ends = blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_blocks, "key string, ends string")
    classes = rows.groupBy("key").agg(F.min("seq").alias("seq"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    return classes.join(ends, "key").drop("key")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    most, at = min(len(a), len(b)) // _LETTER, 0
    while at < most and a[at * _LETTER : (at + 1) * _LETTER] == b[at * _LETTER : (at + 1) * _LETTER]:
        at += 1
    return at


def _bytes_of(seq: bytes, depth: int) -> int:
    """Bytes of the text of the turn at *depth*; the root has none."""
    return int.from_bytes(seq[depth * _LETTER - 8 : depth * _LETTER], "big") if depth else 0


class Nodes:
    """Node rows, column by column."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(9)]

    def add(self, *values) -> int:
        for column, value in zip(self.columns, values):
            column.append(value)
        return len(self.columns[0]) - 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        names = [part.split()[0] for part in _SWEPT.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(self.columns, kinds)], names=names)


class Sweep:
    """One container, swept entry by entry in the order of sequences, from its head at *depth* down."""

    def __init__(self, depth: int, parent: int | None, up: bytes | None, out: Nodes):
        self.depth, self.parent, self.up, self.out = depth, parent, up, out
        self.before: bytes | None = None
        self.path: list[dict] = []

    def _leave(self) -> None:
        node = self.path.pop()
        depth = self.depth + len(self.path)
        leaves = node["leaves"] if node["kids"] else 1
        saved = node["saved"] + (node["n"] - 1) * _bytes_of(self.before, depth)
        for row in node["kids"]:
            self.out.columns[2][row] = node["low"]
        at_head = not self.path
        row = self.out.add(
            node["low"], depth, self.parent if at_head else None, node["n"], len(node["kids"]), leaves, saved,
            node["ends"], self.up if at_head else None,
        )
        if not at_head:
            above = self.path[-1]
            above["kids"].append(row)
            above["low"] = node["low"] if above["low"] is None else min(above["low"], node["low"])
            above["n"] += node["n"]
            above["leaves"] += leaves
            above["saved"] += saved

    def enter(self, seq: bytes, conv_id: int, n: int, ends: str) -> None:
        turns = len(seq) // _LETTER
        shared = self.depth if self.before is None else common_turns(self.before, seq)
        while self.depth + len(self.path) - 1 > shared:
            self._leave()
        while self.depth + len(self.path) - 1 < turns:
            self.path.append({"low": None, "n": 0, "leaves": 0, "saved": 0, "kids": [], "ends": _NO_IDS})
        end = self.path[-1]
        end["low"] = conv_id if end["low"] is None else min(end["low"], conv_id)
        end["n"] += n
        end["ends"] = ends
        self.before = seq

    def close(self) -> None:
        while self.path:
            self._leave()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of a partition that is sorted by head and sequence."""
    out, at, head = Nodes(), None, None
    for batch in batches:
        for row in batch.to_pylist():
            if at is None or row["head"] != head:
                if at is not None:
                    at.close()
                    if len(out.columns[0]) >= _BATCH_ROWS:
                        yield out.batch()
                        out = Nodes()
                head, at = row["head"], Sweep(row["depth"], row["parent"], row["up"], out)
            at.enter(row["seq"], row["conv_id"], row["n"], row["ends"])
    if at is not None:
        at.close()
    yield out.batch()


def _with_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each bursting container the number of turns that all its suffixes share."""
    for batch in batches:
        pairs = zip(batch.column("low_rest").to_pylist(), batch.column("high_rest").to_pylist())
        common = pa.array([common_turns(a, b) for a, b in pairs], type=pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, common], names=[*batch.schema.names, "common"])


_HEAD = (
    "head binary, depth int, parent long, up binary, entries long, bytes long, low long, n long, top binary,"
    " low_rest binary, high_rest binary"
)


def _containers(open_rows: DataFrame) -> DataFrame:
    rest = F.substring("seq", F.col("depth") * _LETTER + 1, F.octet_length("seq"))
    return open_rows.groupBy("head").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("up").alias("up"),
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length(rest)).cast("long").alias("bytes"),
        F.min("conv_id").alias("low"), F.sum("n").alias("n"),
        F.min(F.substring("seq", F.greatest(F.col("depth") - 1, F.lit(0)) * _LETTER + 1, F.lit(_LETTER))).alias("top"),
        F.min(rest).alias("low_rest"), F.max(rest).alias("high_rest"),
    )


def _head_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a burst container's shared turns, from the one its containers hang on up to its head."""
    out = Nodes()
    for batch in batches:
        for r in batch.to_pylist():
            saved, chain = r["saved"], (r["top"] if r["depth"] else b"") + r["low_rest"][: r["common"] * _LETTER]
            for step in range(r["common"], -1, -1):
                last, first = step == r["common"], step == 0
                depth = r["depth"] + step
                saved += (r["n"] - 1) * (_bytes_of(chain, step + (r["depth"] > 0)) if depth else 0)
                out.add(
                    r["low"], depth, r["parent"] if first else r["low"], r["n"], r["children"] if last else 1, r["leaves"],
                    saved, r["ends"] if last and r["ends"] else _NO_IDS, r["up"] if first else None,
                )
    yield out.batch()


def trie(found: DataFrame, container_rows: int = CONTAINER_ROWS, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """All nodes (NODE) of the trie over *found* (seq, conv_id, n, ends), one row per distinct sequence."""
    rows = found.select(
        F.lit(b"").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.lit(None).cast("binary").alias("up"), "seq", "conv_id", "n", "ends",
    )
    rows = written(rows, "open-containers")
    closed, bursts = [], []
    while True:
        sizes = _containers(rows)
        large = (F.col("entries") > container_rows) | ((F.col("bytes") > container_bytes) & (F.col("entries") > 1))
        big = written(sizes.filter(large).mapInArrow(_with_common, f"{_HEAD}, common int"), "bursting")
        if big.isEmpty():
            closed.append(rows)
            break
        marks = big.select("head", F.col("low").alias("_low"), "common")
        # One join decides; rows that stay and rows that go on are told apart by the folder they lie in.
        marked = written(
            rows.join(marks, "head", "left").withColumn("goes", F.col("common").isNotNull()), "burst", ("goes",)
        )
        closed.append(marked.filter("NOT goes").select(rows.columns))
        end = (F.col("depth") + F.col("common")) * _LETTER
        going = marked.filter("goes").withColumn("_end", end)
        ended = going.filter(F.octet_length("seq") == F.col("_end")).select("head", "ends")
        bursts.append((big, ended))
        child = F.unhex(F.md5(F.substring("seq", F.lit(1), F.col("_end") + _LETTER)))
        rows = going.filter(F.octet_length("seq") > F.col("_end")).select(
            child.alias("head"), (F.col("depth") + F.col("common") + 1).alias("depth"), F.col("_low").alias("parent"),
            F.col("head").alias("up"), "seq", "conv_id", "n", "ends",
        )
    every = reduce(DataFrame.unionByName, closed).repartition("head").sortWithinPartitions("head", "seq")
    swept = written(every.mapInArrow(_sweep, _SWEPT), "swept")
    parts = [swept]
    for big, ended in reversed(bursts):
        below = reduce(DataFrame.unionByName, parts).filter("up IS NOT NULL")
        sums = below.groupBy(F.col("up").alias("head")).agg(
            F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        summed = big.join(sums, "head").join(ended, "head", "left")
        parts.append(written(summed.mapInArrow(_head_nodes, _SWEPT), "heads"))
    return reduce(DataFrame.unionByName, parts).drop("up")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over all rebuilt conversations of *conversations* (conv_id, turn, role, text).

    Null roles and texts are empty; a null turn comes first; turns of one number
    are ordered by role and text, and repeated rows are turns of their own. Rows
    without a conv_id take no part. A conversation that is rebuilt without turns
    is a member of the root only. Other columns are ignored; an empty table gives
    no rows.
    """
    return trie(entries(rebuilt(turn_sequences(conversations))))
