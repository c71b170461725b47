"""Sharding by a hierarchical tree of weighted hash draws.

A tree has the levels region, rack and shard. A row starts at the root; at
each level every child draws log(u) / weight, with u a hash of the row's key
and the child's name, and the largest draw wins. A child's weight is the sum of
its shards. A draw depends on nothing but its own child, so when weights change
rows move only between subtrees whose weights change and the rest of the tree.

The law of the placement is ``key``: key and tree decide, nothing else. A tree
grows by a new region, which draws against the old regions as a whole; the rows
it wins move into it and no other row moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prorrata.llm.common import crc32_of, number_within, whole_text


@dataclass(frozen=True)
class Node:
    """A region, a rack, or (without children) a shard."""

    name: str
    children: tuple["Node", ...] = ()
    own_weight: float = 0.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def shard_node(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard{shard}", (), weight, shard)


def regular_tree(regions: int, racks: int, shards: int) -> Node:
    """*regions* regions of *racks* racks of *shards* shards of equal weight, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(
                f"region{r}",
                tuple(Node(f"region{r}/rack{k}", tuple(shard_node(next(number)) for _ in range(shards))) for k in range(racks)),
            )
            for r in range(regions)
        ),
    )


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """*tree* with one more shard, in a region and rack of its own."""
    region = f"region{len(tree.children)}"
    return Node(tree.name, (*tree.children, Node(region, (Node(f"{region}/rack0", (shard_node(shard, weight),)),))))


def _draw(key: Column, child: Node) -> Column:
    hashed = F.xxhash64(key, F.lit(child.name))
    unit = (F.shiftrightunsigned(hashed, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.log(unit) / F.lit(child.weight)


def place(key: Column, node: Node) -> Column:
    """The shard of a key: descends from *node* to the child with the largest draw."""
    if not node.children:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return place(key, children[0])
    draws = [_draw(key, c) for c in children]
    best = F.greatest(*draws)
    cases = list(zip(draws, children))
    start = F.when(cases[0][0] == best, place(key, cases[0][1]))
    return reduce(lambda case, at: case.when(at[0] == best, place(key, at[1])), cases[1:], start)


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None) -> DataFrame:
    """One row per row of *docs* (doc_id, text; other columns are ignored).

    A null text counts as empty (size 1, crc32 0). A null doc_id is one more
    key: all rows with it share a shard. Repeated rows share a shard and get
    slots of their own. An empty table gives no rows.

    Nothing of the text leaves the scan but its size and checksum; slots need
    one shuffle of these small rows (see number_within).
    """
    key = F.col("doc_id")
    small = docs.select(
        "doc_id",
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        crc32_of(whole_text()).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return number_within(small, "shard", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
