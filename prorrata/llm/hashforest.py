"""Nearest neighbours by inner product in a forest of hash prefixes.

Each tree gives every vector a hash string of 64 bits, the signs of projections.
Rows are sorted by hash string, so that rows sharing a prefix with a query lie
side by side. A query descends to its longest match in every tree; then all trees
ascend together, one bit at a time, until the matches of all trees are enough.
These candidates are compared exactly.

Inner products become angles by one more coordinate: rows are divided by the
largest norm and filled up to norm 1, queries get a 0.

How many matches are enough is measured, not guessed: for a bounded sample of
queries (SAMPLE) the exact neighbours among all rows, and the level at which each
is met, are found in one pass; the number is the smallest that reaches
TARGET_RECALL on the sample. The lowest level a sample query needs is the floor
of the ascent. Groups of (tree, prefix of floor bits) are what the cluster
spreads; groups of more than ROW_PART rows or QUERY_PART queries are split.

Queries outside the sample can need less than the floor. Those that have not
matches enough there, or fewer neighbours than wanted among their matches, are
compared with all rows, QUERY_BLOCK queries in a pass. So no query ends with
fewer neighbours than wanted while the table has more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.sources.workarea import written

TREES = 20
BITS = 64
NEIGHBOURS = 20
SAMPLE = 64  # queries that the number of candidates is fitted on
TARGET_RECALL = 0.95
MAX_FLOOR = 16
LEVELS = 24  # levels above the floor that are told apart
ROW_PART, QUERY_PART = 4096, 4096
QUERY_BLOCK = 2048  # about so many queries are compared with all rows in one pass


def projections(dimension: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Directions of all trees, (trees * bits, dimension + 1); orthogonal ones as far as the dimension allows."""
    random = np.random.default_rng(dimension)
    wanted, found = trees * bits, []
    while sum(map(len, found)) < wanted:
        square, _ = np.linalg.qr(random.standard_normal((dimension + 1, dimension + 1)))
        found.append(square.T)
    return np.concatenate(found)[:wanted]


def hash_strings(vectors: np.ndarray, directions: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows, trees) hash strings; the first sign is the highest bit."""
    signs = (vectors @ directions.T) > 0
    packed = np.packbits(signs.reshape(len(vectors), trees, bits), axis=2)
    return packed.view(">u8")[:, :, 0].astype(np.uint64)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of 64-bit hash strings."""
    x = a ^ b
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return (BITS - np.bitwise_count(x)).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _codes(column: pa.ChunkedArray | pa.Array, trees: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, trees)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not zero, and holds finite numbers only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


@dataclass
class Forest:
    """Hash strings of all rows and queries, and when a query has candidates enough."""

    coded: DataFrame  # vec_id, embedding, is_query, codes, query_codes
    dimension: int
    matches: int
    floor: int


def _coded(rows: DataFrame, is_query: Column, dimension: int, largest: float, trees: int) -> DataFrame:
    directions = projections(dimension, trees)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), dimension)
            scaled = vectors / largest
            norms = np.linalg.norm(scaled, axis=1, keepdims=True)
            as_row = np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - norms**2))])
            as_query = np.hstack([scaled / np.maximum(norms, 1e-300), np.zeros((len(vectors), 1))])
            lists = [
                pa.array(list(hash_strings(side, directions, trees).view(np.int64)), type=pa.list_(pa.int64()))
                for side in (as_row, as_query)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "codes", "query_codes"])

    kind = rows.schema["embedding"].dataType.simpleString()
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    marked = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    schema = f"vec_id {id_kind}, embedding {kind}, is_query boolean, codes array<long>, query_codes array<long>"
    return written(marked.mapInArrow(code, schema).withColumn("_at", F.monotonically_increasing_id()), "hash-strings")


def _sample_pass(coded: DataFrame, sample: list, dimension: int, trees: int, neighbours: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Matches of each sample query by level (summed over trees), and the levels at which its neighbours are met."""
    queries = np.array([r["embedding"] for r in sample], dtype=np.float64)
    codes = np.array([r["query_codes"] for r in sample], dtype=np.int64).view(np.uint64)
    own = np.array([r["_at"] for r in sample])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sample), BITS + 1), dtype=np.int64)
        best = [np.zeros((3, 0)) for _ in sample]
        for batch in batches:
            vectors, strings = _matrix(batch.column("embedding"), dimension), _codes(batch.column("codes"), trees)
            at = batch.column("_at").to_numpy()
            for q in range(len(sample)):
                common = common_prefix(strings, codes[q])
                counts[q] += np.bincount(common.ravel(), minlength=BITS + 1)
                other = at != own[q]
                scores = vectors[other] @ queries[q]
                every = np.hstack([best[q], np.stack([scores, common[other].max(axis=1), at[other]])])
                best[q] = every[:, np.argsort(-every[0], kind="stable")[:neighbours]]
        rows = [(q, -1, float(level), float(n)) for q in range(len(sample)) for level, n in enumerate(counts[q]) if n]
        rows += [(q, 0, float(s), float(level)) for q in range(len(sample)) for s, level, _ in best[q].T]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["q", "kind", "a", "b"])

    found = coded.select("embedding", "codes", "_at").mapInArrow(scan, "q int, kind int, a double, b double")
    found = written(found, "sample-matches")
    counts = np.zeros((len(sample), BITS + 1))
    for r in found.filter("kind = -1").groupBy("q", "a").agg(F.sum("b").alias("n")).collect():
        counts[r["q"], int(r["a"])] = r["n"]
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("a"), F.desc("b")))
    levels: list[list[float]] = [[] for _ in sample]
    for r in found.filter("kind = 0").withColumn("_rank", rank).filter(F.col("_rank") <= neighbours).collect():
        levels[r["q"]].append(r["b"])
    return counts[:, ::-1].cumsum(axis=1)[:, ::-1], [np.array(x) for x in levels]


def enough(matches: np.ndarray, levels: list[np.ndarray], target: float) -> tuple[int, int]:
    """Smallest number of matches that reaches the target recall on the sample, and the lowest level it leads to."""
    total = sum(map(len, levels))

    def at(number: float) -> np.ndarray:
        return np.array([max((int(x) for x in np.flatnonzero(row >= number)), default=0) for row in matches])

    def recall(number: float) -> float:
        return sum(int((x >= level).sum()) for x, level in zip(levels, at(number))) / max(1, total)

    numbers = np.unique(matches)
    low, high = 0, len(numbers) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(numbers[middle]) >= target else (middle + 1, high)
    return int(numbers[low]), int(at(numbers[low]).min(initial=BITS))


def build(vectors: DataFrame, is_query: Column, trees: int = TREES, target: float = TARGET_RECALL, neighbours: int = NEIGHBOURS) -> Forest | None:
    """The forest over all usable rows of *vectors* (vec_id, embedding); None if there is no row or no query.

    Shorter vectors count as filled up with zeros to the longest one's length.
    """
    fine = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = fine.agg(F.max(F.size("embedding")).alias("n"), F.max(norm).alias("norm")).first()
    dimension = most["n"]
    if dimension is None:
        return None
    element = vectors.schema["embedding"].dataType.elementType
    filled = F.concat("embedding", F.array_repeat(F.lit(0).cast(element), F.lit(dimension) - F.size("embedding")))
    whole = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(filled)
    coded = _coded(fine.withColumn("embedding", whole), is_query, dimension, most["norm"], trees)
    # Bounded: SAMPLE queries.
    sample = coded.filter("is_query").orderBy(F.xxhash64("vec_id"), "_at").limit(SAMPLE).collect()
    if not sample:
        return None
    number, floor = enough(*_sample_pass(coded, sample, dimension, trees, neighbours), target)
    return Forest(coded, dimension, number, min(floor, MAX_FLOOR))


def _grouped(forest: Forest) -> tuple[DataFrame, DataFrame]:
    """Rows and queries once per tree, with the key (tree, prefix, rp, qp) under which they meet."""
    prefix = F.shiftrightunsigned("code", BITS - forest.floor) if forest.floor else F.lit(0).cast("long")
    rows = forest.coded.select("vec_id", "embedding", "_at", F.posexplode("codes").alias("tree", "code")).withColumn("prefix", prefix)
    queries = (
        forest.coded.filter("is_query")
        .select(
            F.col("vec_id").alias("query_id"),
            F.col("embedding").alias("query"),
            F.col("_at").alias("own"),
            F.posexplode("query_codes").alias("tree", "code"),
        )
        .withColumn("prefix", prefix)
    )

    def part_counts(side: DataFrame, size: int, name: str) -> DataFrame:
        counts = side.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
        return counts

    parts = written(part_counts(rows, ROW_PART, "rps").join(part_counts(queries, QUERY_PART, "qps"), ["tree", "prefix"]), "forest-parts")

    def spread(side: DataFrame, at: str, own: str, owns: str, other: str, others: str) -> DataFrame:
        return (
            side.join(parts, ["tree", "prefix"])
            .withColumn(own, F.pmod(F.xxhash64(at), F.col(owns)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
            .drop("rps", "qps")
        )

    return spread(rows, "_at", "rp", "rps", "qp", "qps"), spread(queries, "own", "qp", "qps", "rp", "rps")


_KEY = ["tree", "prefix", "rp", "qp"]


def _ranges(codes: np.ndarray, queries: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end row, in sorted *codes*, of the rows sharing *level* bits with each query."""
    keep = np.where(level > 0, ~np.uint64(0) << (np.uint64(BITS) - np.maximum(level, 1).astype(np.uint64)), np.uint64(0))
    low = queries & keep
    return np.searchsorted(codes, low, side="left"), np.searchsorted(codes, low | ~keep, side="right")


def _best(vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, queries: np.ndarray, own: np.ndarray, neighbours: int):
    """Per query the positions and scores of its best rows. Scores are summed row by row, so equal vectors score equally."""
    rough = vectors @ queries.T
    for q in range(len(queries)):
        scores = np.where(at == own[q], -np.inf, rough[:, q])
        if len(scores) > neighbours:
            least = np.partition(scores, len(scores) - neighbours)[len(scores) - neighbours]
            near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least) if np.isfinite(least) else 1.0))
        else:
            near = np.arange(len(scores))
        near = near[at[near] != own[q]]
        exact = (vectors[near] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:neighbours]
        yield q, near[order], exact[order]


def _ranked(found: DataFrame, neighbours: int) -> DataFrame:
    """The best rows of each query with their rank; rows that were met several times count once."""
    once = found.groupBy("query_id", "own", "vec_id", "at").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "at"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= neighbours)


def _in_forest(forest: Forest, result: str, neighbours: int) -> DataFrame:
    """The best rows of all queries that have matches enough at the floor."""
    rows, queries = _grouped(forest)
    dimension, floor = forest.dimension, forest.floor

    def count(rows_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        codes = np.sort(rows_of.column("code").to_numpy().view(np.uint64))
        asked = queries_of.column("code").to_numpy().view(np.uint64)
        columns = {"own": queries_of.column("own")}
        for step in range(LEVELS):
            first, end = _ranges(codes, asked, np.full(len(asked), min(BITS, floor + step)))
            columns[f"c{step}"] = pa.array(end - first)
        return pa.table(columns)

    counted = rows.select(*_KEY, "code").groupBy(*_KEY).cogroup(queries.select(*_KEY, "code", "own").groupBy(*_KEY)).applyInArrow(
        count, "own long, " + ", ".join(f"c{s} long" for s in range(LEVELS))
    )
    totals = counted.groupBy("own").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(LEVELS)])
    level = F.array_max(F.array(*[F.when(F.col(f"c{s}") >= forest.matches, F.lit(floor + s)) for s in range(LEVELS)]))
    reached = totals.select(F.col("own").alias("_of"), level.alias("level")).filter("level IS NOT NULL")

    def compare(rows_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        codes = rows_of.column("code").to_numpy().view(np.uint64)
        order = np.argsort(codes, kind="stable")
        codes, sorted_vectors = codes[order], _matrix(rows_of.column("embedding"), dimension)[order]
        ids, at = rows_of.column("vec_id").to_numpy()[order], rows_of.column("_at").to_numpy()[order]
        asked, query_ids = _matrix(queries_of.column("query"), dimension), queries_of.column("query_id").to_numpy()
        own = queries_of.column("own").to_numpy()
        first, end = _ranges(codes, queries_of.column("code").to_numpy().view(np.uint64), queries_of.column("level").to_numpy())
        found: list[tuple] = []
        spans, member = np.unique(np.stack([first, end]), axis=1, return_inverse=True)
        for number, (a, b) in enumerate(spans.T):
            if a == b:
                continue
            of = np.flatnonzero(member.ravel() == number)
            for start in range(0, len(of), 256):
                some = of[start : start + 256]
                for q, near, scores in _best(sorted_vectors[a:b], ids[a:b], at[a:b], asked[some], own[some], neighbours):
                    found.append((np.full(len(near), some[q]), a + near, scores))
        which = np.concatenate([x[0] for x in found]) if found else np.zeros(0, dtype=np.int64)
        near = np.concatenate([x[1] for x in found]) if found else np.zeros(0, dtype=np.int64)
        scores = np.concatenate([x[2] for x in found]) if found else np.zeros(0)
        return pa.table({"query_id": query_ids[which], "own": own[which], "vec_id": ids[near], "at": at[near], "score": scores})

    levelled = queries.join(written(reached, "forest-levels"), F.col("own") == F.col("_of"))
    found = (
        rows.select(*_KEY, "code", "_at", "vec_id", "embedding")
        .groupBy(*_KEY)
        .cogroup(levelled.select(*_KEY, "code", "own", "query_id", "query", "level").groupBy(*_KEY))
        .applyInArrow(compare, result)
    )
    return _ranked(found, neighbours)


def _with_all_rows(forest: Forest, asked: list, result: str, neighbours: int) -> DataFrame:
    """The best of all rows for each query of *asked*. Each task keeps its own best ones."""
    dimension = forest.dimension
    query_ids, own = [r["vec_id"] for r in asked], np.array([r["_at"] for r in asked])
    shared = forest.coded.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in asked], dtype=np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            vectors = _matrix(batch.column("embedding"), dimension)
            ids, at = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("_at").to_numpy()
            for start in range(0, len(own), 256):
                for q, near, scores in _best(vectors, ids, at, shared.value[start : start + 256], own[start : start + 256], neighbours):
                    these = (ids[near], at[near], scores)
                    every = [np.concatenate(x) for x in zip(best[start + q], these)] if start + q in best else these
                    order = np.lexsort((every[1], every[0], -every[2]))[:neighbours]
                    best[start + q] = tuple(x[order] for x in every)
        for q, (ids, at, scores) in best.items():
            columns = [pa.array([query_ids[q]] * len(ids), type=kind), pa.array(np.full(len(ids), own[q])), pa.array(ids, type=kind), pa.array(at), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "own", "vec_id", "at", "score"])

    return _ranked(forest.coded.select("vec_id", "embedding", "_at").mapInArrow(scan, result), neighbours)


def search(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every query row, nearest first, ties to the smaller id.

    Every query gets *neighbours* rows, or all other rows if there are fewer.
    Vectors that are null, zero, or hold null or non-finite numbers take no
    part, nor do rows without an id. Vectors of different lengths are compared as
    if the shorter ones went on with zeros. A repeated row is a candidate of its own;
    only the query's own row is left out. Other columns are ignored; an empty
    table gives no rows.
    """
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    result = f"query_id {id_kind}, own long, vec_id {id_kind}, at long, score double"
    forest = build(vectors, is_query, trees, target, neighbours)
    if forest is None:
        empty = vectors.sparkSession.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    best = written(_in_forest(forest, result, neighbours), "forest-neighbours")
    full = best.groupBy("own").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= neighbours).select(F.col("own").alias("_of"))
    found = [best.join(full, F.col("own") == F.col("_of"), "left_semi")]
    left = written(forest.coded.filter("is_query").join(full, F.col("_at") == F.col("_of"), "left_anti"), "open-queries")
    blocks = -(-left.count() // QUERY_BLOCK)
    for block in range(blocks):
        # Bounded: about QUERY_BLOCK queries.
        some = left.filter(F.pmod(F.xxhash64("_at"), F.lit(blocks)) == block).select("vec_id", "embedding", "_at").collect()
        if some:
            found.append(written(_with_all_rows(forest, some, result, neighbours), "forest-neighbours"))
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")
