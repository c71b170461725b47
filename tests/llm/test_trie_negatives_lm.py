"""Hard negatives, conversation trie and LM scoring against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prorrata.llm import backoff, bursttrie, multiindex
from tests.llm.conftest import FOLDER, edge_rows

# Conversation trie.

CONVERSATION = "conv_id long, turn long, role string, text string"


def plain_trie(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        cost = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += cost
            leaves[path[:d]] += kids[path] == 0
    found = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if built[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        found.append((min(who), len(path), parent, len(who), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def nodes(df) -> list[tuple]:
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversation_rows() -> list[tuple]:
    r = random.Random(3)
    rows = []
    for c in range(0, 240):
        if c % 15 == 0:
            continue  # families without their first conversation
        n = r.choice([1, 1, 2, 3, 4, 6, 9, 12])
        rows += [(c, t, r.choice(["user", "assistant"]), f"text {r.randint(0, 2)}" if t else "hello") for t in range(n)]
    same = [(t, "user", f"line {t}") for t in range(14)]
    rows += [(c, *x) for c in range(300, 420) for x in same]  # many equal ones
    rows += [(c, t, "user", f"line {min(t, 11)}" + ("!" if t == 12 else "") + str(c % 7) * (t > 12)) for c in range(420, 460) for t in range(14)]
    rows += [(500, None, None, None), (500, None, "user", "b"), (500, None, "user", "a"), (500, 1, "user", "é"), (500, 1, "user", "é")]
    rows += [(505, 1, "a", "bc"), (506, 1, "ab", "c"), (507, 3, "", "x" * 20_000), (508, 0, None, ""), (-5, 0, "user", "hello"), (-3, 0, "user", "hello")]
    rows += [(600, t, "user", f"long {t}") for t in range(130)] + [(600 + 1, t, "user", f"long {t}") for t in range(129)]
    return rows + [(None, 0, "user", "hello")]


@pytest.mark.parametrize("size, partitions", [(512, 3), (8, 7), (1, 2)])
def test_trie_against_plain_version(spark, size, partitions):
    """Any container size, hence any number of bursts, gives the nodes of the plain trie."""
    given = spark.createDataFrame(conversation_rows(), CONVERSATION).repartition(partitions)
    found = bursttrie.trie(bursttrie.entries(bursttrie.rebuilt(bursttrie.turn_sequences(given))), container_rows=size)
    assert nodes(found) == plain_trie(conversation_rows())


def test_trie_of_the_table(spark):
    given = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()]
    clashing = given.selectExpr("*", "'x' AS head", "'x' AS depth", "'x' AS letters", "1 AS n")
    assert nodes(bursttrie.conversation_trie(clashing)) == plain_trie(rows)


def test_trie_of_no_rows(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    found = bursttrie.conversation_trie(empty)
    assert found.count() == 0 and dict(found.dtypes)["conv_id"] == "bigint"


def test_blocks_of_ids_are_hashed_as_one_text(spark, monkeypatch):
    monkeypatch.setattr(bursttrie, "BLOCK_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(10, 200) if zlib.crc32(str(c).encode()) % 9 == 0]
    found = bursttrie.conversation_trie(spark.createDataFrame(rows, CONVERSATION).repartition(4))
    assert nodes(found) == plain_trie(rows)


# Hard negatives.

VECTOR = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows: list[tuple]) -> list[tuple]:
    usable = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        usable.append((i, whole, (label + 1) % 10 if i % 7 == 0 else label))
    found = []
    for at, (i, vector, label) in enumerate(usable):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, other)), j, k, their) for k, (j, other, their) in enumerate(usable)]
        positives = sorted(x for x in scored if x[3] == label and x[2] != at)[:5]
        for p, j, _, _ in positives:
            fits = sorted(x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            found += [(i, j, rank, n, -p, -s) for rank, (s, n, _, _) in enumerate(fits, 1)]
    return sorted(found)


def vector_rows() -> list[tuple]:
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * r.standard_normal(16)).astype(np.float32).tolist(), int(i % 5)) for i in range(1, 900)]
    rows += [(2000 + i, rows[99][1], i % 3) for i in range(300)]  # a third of all rows are equal
    rows += [(3000, None, 1), (3001, [], 1), (3100, [0.0] * 16, 1), (3200, [1.0, None] + [0.0] * 14, 1), (3300, [float("nan")] * 16, 2)]
    rows += [(3400, [float("inf")] + [0.0] * 15, 2), (3500, rows[5][1], None), (None, rows[5][1], 1), (3600, rows[6][1][:9], 2), (3700, [-x for x in rows[7][1]], 4)]
    return rows + [rows[199], rows[199], (3800, [1000.0] * 16, 3)]


@pytest.mark.parametrize("cell_rows, first_rows", [(8, 40), (100, 8192), (2048, 1)])
def test_negatives_against_plain_version(spark, monkeypatch, cell_rows, first_rows):
    """Any number of cells and any length of the first visit give the exact windows; parts of cells meet as well."""
    monkeypatch.setattr(multiindex, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(multiindex, "ROW_PART", 60)
    monkeypatch.setattr(multiindex, "QUERY_PART", 3)
    given = spark.createDataFrame(vector_rows(), VECTOR).repartition(4).selectExpr("*", "'x' AS at", "1 AS cell", "0 AS rank", "'x' AS own")
    found = multiindex.mine_negatives(given, F.col("vec_id") % 100 == 0, first_rows)
    assert sorted(map(tuple, found.collect())) == plain_negatives(vector_rows())
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_negatives_of_the_table(spark):
    given = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()]
    assert sorted(map(tuple, multiindex.mine_negatives(given, F.col("vec_id") % 100 == 0).collect())) == plain_negatives(rows)


def test_negatives_of_no_rows(spark):
    assert multiindex.mine_negatives(spark.createDataFrame([], VECTOR), F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 2)], VECTOR)
    assert multiindex.mine_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0


def test_cells_come_in_falling_order_and_bound_their_rows():
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.standard_normal((500, 10)))
    books = multiindex.codebook(rows[:, :5], 7), multiindex.codebook(rows[:, 5:], 6)
    (a, to_a), (b, to_b) = multiindex.nearest_of(rows[:, :5], books[0]), multiindex.nearest_of(rows[:, 5:], books[1])
    radii = tuple(np.array([d[w == i].max(initial=0) for i in range(len(x))]) for w, d, x in ((a, to_a, books[0]), (b, to_b, books[1])))
    cell = a * len(books[1]) + b
    index = multiindex.Index(books, radii, dict(Counter(cell.tolist())))
    for query in rows[:20]:
        visited = list(index.cells(query))
        assert [c for _, _, c in visited] and sorted(c for _, _, c in visited) == sorted(index.sizes)
        assert all(x[0] >= y[0] for x, y in zip(visited, visited[1:]))
        for upper, lower, c in visited:
            scores = rows[cell == c] @ query
            assert lower <= scores.min() and scores.max() <= upper
        split = index.visit(query, True, 60, -math.inf, math.inf) + index.visit(query, False, 60, -math.inf, math.inf)
        assert sorted(split) == sorted(index.sizes)


# LM scoring.


def plain_scores(rows: list[tuple], order: int, priors) -> dict:
    """doc_id to (held out, tokens, known, N, base, score) by dictionaries of counts."""
    texts = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        texts.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*words, 0]))
    counts = Counter()
    for _, held, tokens in texts:
        if not held:
            line = [1, *tokens]
            counts[(1,)] += 1
            for n in range(1, order + 1):
                counts.update(tuple(line[i - n + 1 : i + 1]) for i in range(1, len(line)) if i - n + 1 >= 0)
    total = sum(c for k, c in counts.items() if len(k) == 1 and k != (1,))
    everything = total + sum(1 for k in counts if len(k) == 1 and k != (1,)) + 1

    def chance(line, i, n, prior, less):
        if n == 1:
            return (max(counts[(line[i],)], 1) if less else counts[(line[i],)] + 1) / everything
        below = chance(line, i, n - 1, prior, less)
        gram, history = tuple(line[i - n + 1 : i + 1]), tuple(line[i - n + 1 : i])
        return (max(counts[gram] - less, 0) + prior * below) / (max(counts[history] - less, 0) + prior)

    def score(tokens, prior, less=0):
        line = [1, *tokens]
        return sum(math.log10(chance(line, i, min(order, i + 1), prior, less)) for i in range(1, len(line)))

    fits = [sum(score(t, p, 1) for _, held, t in texts if not held) for p in priors]
    best = priors[max(range(len(priors)), key=lambda i: fits[i])]
    return Counter(
        (i, held, len(t), sum(counts[(w,)] > 0 for w in t), total, round(sum(math.log10((counts[(w,)] + 1) / everything) for w in t), 6), round(score(t, best), 6))
        for i, held, t in texts
    )


def scored(df) -> Counter:
    return Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("order, chunk, shard", [(2, 1 << 21, 1 << 21), (2, 50, 300), (3, 70, 900), (1, 40, 500)])
def test_scores_against_plain_version(spark, edge_docs, order, chunk, shard):
    """Chunks and shards of any size, which cut documents anywhere, give the scores of the plain model."""
    wanted = plain_scores([(r[0], r[1]) for r in edge_rows()], order, backoff.PRIORS)
    found = backoff.score_documents(edge_docs, order, chunk_tokens=chunk, shard_tokens=shard)
    assert scored(found) == wanted


def test_slices_of_a_long_text(monkeypatch):
    text = ("Abé c\x0bd\x1fe  " * 999).encode()
    whole = np.concatenate(list(backoff.word_hashes(text)))
    monkeypatch.setattr(backoff, "_SLICE_BYTES", 100)
    assert np.array_equal(np.concatenate(list(backoff.word_hashes(text))), whole)
    assert whole[:3].tolist() == [xxhash.xxh64_intdigest(w) for w in ("abé".encode(), b"c", b"d\x1fe")]


def test_scores_without_training_rows(spark, no_docs):
    assert backoff.score_documents(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = backoff.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_the_automaton_is_a_distribution():
    """After every history the words seen and one unknown word share a probability of one."""
    lines = ["a b a c", "b a a", "c a b b"]
    hashes = [np.concatenate(list(backoff.word_hashes(x.encode()))) for x in lines]
    end = np.array([backoff.END], dtype=np.uint64)
    words = np.unique(np.concatenate([*hashes, end, np.array([backoff.START, 7], dtype=np.uint64)]))

    def row(texts):
        ids = [np.searchsorted(words, np.array([backoff.START, *t], dtype=np.uint64)).astype(np.uint32) for t in texts]
        pieces = [{"lead": 1, "length": len(x) - 1, "held_out": False, "begins": True} for x in ids]
        return {"pieces": pieces, "words": words.tobytes(), "tokens": backoff.pack(np.concatenate(ids))}

    trained = backoff.Grams(row([[*h.tolist(), backoff.END] for h in hashes]), 2)
    vocabulary = [w for w in words.tolist() if w != backoff.START]
    counts = {int(k): int(c) for keys, part in zip(trained.keys, trained.counts) for k, c in zip(keys, part)}
    for history in (w for w in vocabulary if w != backoff.END):  # nothing follows an end
        every = backoff.Grams(row([[history, w] for w in vocabulary]), 2)
        totals = [np.array([counts.get(int(k), 0) for k in keys], dtype=np.uint64) for keys in every.keys]
        n = sum(totals[0][i] for i, w in enumerate(words.tolist()) if w != backoff.START)
        weights = backoff.run_automaton(every, totals, (totals[0] + 1.0) / float(n + len(vocabulary)), 4.0)
        after = every.of_token[1][every.scored].reshape(-1, 2)[:, 1]
        assert abs(np.power(10.0, weights[1][after]).sum() - 1) < 1e-9


def test_scores_of_held_out_texts_beat_single_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    row = backoff.score_documents(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]
