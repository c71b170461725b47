"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, and each half has a codebook, learned by k-means
on a bounded sample (SAMPLE). A pair of codewords is a cell; every row lies in
one. For an anchor, a half's part of an inner product is at most
q . centre + |q| * radius, where the radius of a codeword covers all rows under it. The
sum of two such half-scores bounds the score of every row of a cell, and a heap
over the two sorted lists of half-scores yields cells in falling order of that sum.

Positives and negatives are each found in two visits. The first takes cells from
the heap until they hold FIRST_ROWS rows, and shows how good the best rows are at
least. The second goes on until the bound of the next cell falls below that: then
no row left can enter, and the window is certified. Cells whose lower bound lies
above all windows are passed over. So the result is exact, whatever the
codebooks are; how many cells are visited depends on how the vectors cluster.

A cell of more than ROW_PART rows, or more than QUERY_PART visiting anchors, is split,
so a cell may hold any share of all rows. Codebooks, radii and cell sizes, at
most MAX_CODEWORDS squared numbers, are all that the driver sees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.sources.workarea import written

SAMPLE = 4096  # rows that the codebooks are learned on
CELL_ROWS = 2048  # rows of a cell, on average, that the number of codewords aims at
MAX_CODEWORDS = 64  # of a half
FIRST_ROWS = 8192
ROW_PART, QUERY_PART = 4096, 4096
POSITIVES, NEGATIVES = 5, 5
SCALE = 256
LEAST_PERCENT = 80  # a negative scores at least so much of its positive, and at most as much
_ROUNDS = 12


def most_component(dimension: int) -> int:
    """Largest component whose scores, times 100, fit into 64 bits."""
    return math.isqrt((1 << 63) // (128 * max(1, dimension)))


def scaled_rows(vectors: DataFrame, dimension: int) -> DataFrame:
    """at, vec_id, label, vector (32-bit integers) of the usable rows; shorter vectors are filled up with zeros."""
    limit = min(most_component(dimension), (1 << 31) - 1)
    id_kind = vectors.schema["vec_id"].dataType.simpleString()

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("embedding")
            filled = np.zeros((batch.num_rows, dimension))
            sizes = np.diff(vector.offsets.to_numpy())
            filled[np.arange(dimension) < sizes[:, None]] = vector.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * filled)
            fits = np.abs(whole).max(axis=1, initial=0) <= limit
            small = whole[fits].astype("<i4")
            kept = batch.filter(pa.array(fits))
            columns = [kept.column("at"), kept.column("vec_id"), kept.column("label"), pa.array([r.tobytes() for r in small], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "vec_id", "label", "vector"])

    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = usable(vectors).select(F.monotonically_increasing_id().alias("at"), "vec_id", relabelled.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return written(rows.mapInArrow(scale, f"at long, vec_id {id_kind}, label long, vector binary"), "scaled")


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding", "label").filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    ).filter(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<i4").reshape(len(values), -1).astype(np.float64)


def codebook(rows: np.ndarray, size: int) -> np.ndarray:
    """Centres of k-means; a centre without rows stays where it was."""
    random = np.random.default_rng(len(rows))
    centres = rows[random.permutation(len(rows))[:size]].copy()
    for _ in range(_ROUNDS):
        nearest = nearest_of(rows, centres)[0]
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_of(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the distance to it."""
    rough = (centres**2).sum(axis=1) - 2 * rows @ centres.T
    nearest = rough.argmin(axis=1)
    return nearest, np.sqrt(((rows - centres[nearest]) ** 2).sum(axis=1))


class Index:
    """Codebooks of both halves, radii of their codewords, and the rows of each cell."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], sizes: dict[int, int]):
        self.books, self.radii, self.sizes = books, radii, sizes
        self.width = len(books[1])

    def half_scores(self, vector: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half the largest and the smallest part of a score under each codeword."""
        found, at = [], 0
        for book, radius in zip(self.books, self.radii):
            part = vector[at : at + book.shape[1]]
            middle, spread = book @ part, np.linalg.norm(part) * radius
            # Rounding must not lift a row over its bound.
            slack = 1.0 + 1e-9 * (np.abs(middle) + spread)
            found.append((middle + spread + slack, middle - spread - slack))
            at += book.shape[1]
        return found

    def cells(self, vector: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of the cells that hold rows, upper bounds falling."""
        (high_a, low_a), (high_b, low_b) = self.half_scores(vector)
        order_a, order_b = np.argsort(-high_a), np.argsort(-high_b)
        heap = [(-(high_a[order_a[0]] + high_b[order_b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = order_a[i], order_b[j]
            # A cell is reached from the left only, or, in the first column, from above: so once.
            if j + 1 < len(order_b):
                heapq.heappush(heap, (-(high_a[a] + high_b[order_b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(order_a):
                heapq.heappush(heap, (-(high_a[order_a[i + 1]] + high_b[b]), i + 1, 0))
            cell = int(a) * self.width + int(b)
            if cell in self.sizes:
                yield -bound, float(low_a[a] + low_b[b]), cell

    def visit(self, vector: np.ndarray, first: bool, first_rows: int, least: float, most: float) -> list[int]:
        """Cells of one visit: the first ones up to *first_rows* rows, or those after them.

        No cell below *least* or wholly above *most* is visited. The first visit
        is a prefix that does not depend on *least*, so the second knows it.
        """
        found, rows = [], 0
        for upper, lower, cell in self.cells(vector):
            in_first = rows < first_rows
            if upper < least or (first and not in_first):
                break
            if lower > most:
                continue
            rows += self.sizes[cell]
            if in_first == first:
                found.append(cell)
        return found


def build(rows: DataFrame, dimension: int) -> tuple[DataFrame, dict]:
    """*rows* with their cell, written, and the parts of the Index; no index for no rows."""
    # Bounded: SAMPLE rows.
    sample = rows.orderBy(F.xxhash64("vec_id"), "at").limit(SAMPLE).collect()
    half = dimension // 2
    if not sample:
        return rows.withColumn("cell", F.lit(0)), {}
    drawn = _matrix(pa.array([bytes(r["vector"]) for r in sample], type=pa.binary()))
    size = max(1, min(MAX_CODEWORDS, round(math.sqrt(rows.count() / CELL_ROWS))))
    books = codebook(drawn[:, :half], size), codebook(drawn[:, half:], size)
    width = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            (a, to_a), (b, to_b) = nearest_of(vectors[:, :half], books[0]), nearest_of(vectors[:, half:], books[1])
            columns = [pa.array((a * width + b).astype(np.int32)), pa.array(to_a), pa.array(to_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "cell", "to_a", "to_b"])

    id_kind = rows.schema["vec_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(assign, f"at long, vec_id {id_kind}, label long, vector binary, cell int, to_a double, to_b double"), "cells")
    per_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_a").alias("a"), F.max("to_b").alias("b")).collect()
    radii = np.zeros(len(books[0])), np.zeros(width)
    for r in per_cell:
        for radius, word, far in ((radii[0], r["cell"] // width, r["a"]), (radii[1], r["cell"] % width, r["b"])):
            radius[word] = max(radius[word], far * (1 + 1e-9))
    return placed.drop("to_a", "to_b"), {"books": books, "radii": radii, "sizes": {r["cell"]: r["n"] for r in per_cell}}


def best_rows(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """Positions in *among* of the *count* highest scores, ties to the smaller id, then place."""
    if len(among) > count:
        least = np.partition(scores[among], len(among) - count)[len(among) - count]
        among = among[scores[among] >= least]
    return among[np.lexsort((at[among], ids[among], -scores[among]))[:count]]


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, (rows, queries)."""
    largest = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))
    if rows.shape[1] * largest**2 < 1 << 53:
        return (rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.T.astype(np.int64)


_VISIT = "own long, anchor_label long, query binary, places array<long>, scores array<long>, cell int"
_FOUND = "own long, which int, vec_id long, at long, score long"


def _visits(queries: DataFrame, parts: dict, first: bool, first_rows: int) -> DataFrame:
    """A row for each query and cell of the visit. *queries* have least and most, which may be null."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**parts)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("query"))
            found = []
            for vector, least, most in zip(vectors, batch.column("least").to_pylist(), batch.column("most").to_pylist()):
                found.append(index.visit(vector, first, first_rows, -math.inf if least is None else least, math.inf if most is None else most))
            which = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in found]))
            cells = pa.array([c for of in found for c in of], type=pa.int32())
            kept = [batch.column(name).take(which) for name in ("own", "anchor_label", "query", "places", "scores")]
            yield pa.RecordBatch.from_arrays([*kept, cells], names=["own", "anchor_label", "query", "places", "scores", "cell"])

    return queries.mapInArrow(plan, _VISIT)


def _met(rows: DataFrame, visits: DataFrame, sizes: dict[int, int], kernel: Callable) -> DataFrame:
    """*kernel* over every group of a cell's rows and the queries that visit it."""
    visits = written(visits, "visits")
    asked = visits.groupBy("cell").count().collect()
    counts = [(r["cell"], -(-sizes[r["cell"]] // ROW_PART), -(-r["count"] // QUERY_PART)) for r in asked]
    # Bounded: MAX_CODEWORDS squared cells.
    parts = F.broadcast(visits.sparkSession.createDataFrame(counts, "cell int, rps int, qps int"))

    def spread(side: DataFrame, key: str, own: str, owns: str, other: str, others: str) -> DataFrame:
        placed = side.join(parts, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(owns)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("rps", "qps")

    keys = ["cell", "rp", "qp"]
    left = spread(rows, "at", "rp", "rps", "qp", "qps").groupBy(*keys)
    return left.cogroup(spread(visits, "own", "qp", "qps", "rp", "rps").groupBy(*keys)).applyInArrow(kernel, _FOUND)


def _kernel(positives: bool, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, at, labels = (rows.column(c).to_numpy() for c in ("vec_id", "at", "label"))
            vectors = _matrix(rows.column("vector"))
            own, of = queries.column("own").to_numpy(), queries.column("anchor_label").to_numpy()
            places, limits = queries.column("places").to_pylist(), queries.column("scores").to_pylist()
            for start in range(0, len(own), 256):
                some = slice(start, start + 256)
                products = _products(vectors, _matrix(queries.column("query")[some]))
                for q, scores in enumerate(products.T, start):
                    same = labels == of[q]
                    if positives:
                        windows = [(0, same & (at != own[q]))]
                    else:
                        high = 100 * scores
                        windows = [(p, ~same & (high >= LEAST_PERCENT * s) & (high <= 100 * s)) for p, s in zip(places[q], limits[q])]
                    for which, fits in windows:
                        for i in best_rows(scores, ids, at, np.flatnonzero(fits), count):
                            found.append((own[q], which, ids[i], at[i], scores[i]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*found) if found else [[]] * 5
        return pa.table([pa.array(np.array(c), type=k) for c, k in zip(columns, kinds)], names=["own", "which", "vec_id", "at", "score"])

    return best


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("own", "which").orderBy(F.desc("score"), "vec_id", "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _two_visits(rows: DataFrame, queries: DataFrame, parts: dict, positives: bool, count: int, first_rows: int) -> DataFrame:
    """The best *count* rows of every window of *queries*, certified: own, which, vec_id, at, score, rank."""
    kernel = _kernel(positives, count)
    first = written(_ranked(_met(rows, _visits(queries, parts, True, first_rows), parts["sizes"], kernel), count), "first-visit")
    # A full window cannot be entered from below its last score, another one not from below its own end.
    full = first.groupBy("own", "which").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == count)
    if positives:
        reached = full.select(F.col("own").alias("_own"), F.col("score").cast("double").alias("_least"))
    else:
        ends = queries.select("own", F.posexplode("scores").alias("which", "end"))
        by_window = ends.join(full, ["own", "which"], "left").withColumn("_least", F.coalesce(F.col("score").cast("double"), F.col("end") * (LEAST_PERCENT / 100)))
        reached = by_window.groupBy(F.col("own").alias("_own")).agg(F.min("_least").alias("_least"))
    later = queries.join(reached, F.col("own") == F.col("_own"), "left").withColumn("least", F.coalesce("_least", "least")).drop("_own", "_least")
    second = _met(rows, _visits(later, parts, False, first_rows), parts["sizes"], kernel)
    return written(_ranked(first.drop("rank").unionByName(second), count), "certified")


def mine_negatives(vectors: DataFrame, is_anchor: Column, first_rows: int = FIRST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor of *vectors*.

    *vectors* has vec_id, embedding, label; other columns are ignored. Rows
    without an id, label or vector, and vectors with a null or non-finite number,
    take no part; nor do those with a component over most_component(), whose scores would
    not fit into 64 bits. Shorter vectors count as filled up with zeros. A
    repeated row is an anchor and a candidate of its own. Anchors without another
    row of their label, and windows without a row, give nothing; an empty table
    gives no rows.
    """
    longest = usable(vectors).agg(F.max(F.size("embedding"))).first()[0]
    dimension = max(2, longest or 0)
    rows, parts = build(scaled_rows(vectors, dimension), dimension)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return vectors.sparkSession.createDataFrame([], result)
    none = F.lit(None).cast("double")
    no_windows = F.array().cast("array<long>")
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False))).select(
        F.col("at").alias("own"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("query")
    )
    asked = anchors.select("own", "anchor_label", "query", no_windows.alias("places"), no_windows.alias("scores"), none.alias("least"), none.alias("most"))
    positives = _two_visits(rows, asked, parts, True, POSITIVES, first_rows)

    windows = positives.groupBy("own").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("place"), "score"))).alias("_w"))
    scores = F.transform("_w", lambda w: w["score"])
    asked = anchors.join(windows, "own").select(
        "own", "anchor_label", "query", F.transform("_w", lambda w: w["place"].cast("long")).alias("places"), scores.alias("scores"),
        (F.array_min(scores) * (LEAST_PERCENT / 100)).alias("least"), F.array_max(scores).cast("double").alias("most"),
    )
    negatives = _two_visits(rows, written(asked, "windows"), parts, False, NEGATIVES, first_rows)
    pairs = negatives.select(
        "own", F.col("which").alias("_place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    of = positives.select("own", (F.col("rank") - 1).alias("_place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(of, ["own", "_place"]).join(anchors.select("own", "anchor_id"), "own").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
