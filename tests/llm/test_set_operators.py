"""Sharding, transcripts, mixing, SimHash classes, hash forest."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prorrata.llm import hashforest, mixing, sharding, simhash, transcripts
from tests.conftest import rows
from tests.llm.conftest import edge_rows, prose


def test_shards_of_edge_rows(edge_docs, no_docs):
    import zlib

    tree = sharding.regular_tree(2, 2, 2)
    found = sharding.shard_documents(edge_docs, tree, sharding.grown_tree(tree, 8)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows()
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shard_documents(no_docs, tree).count() == 0


def test_draws_equal_plain_draws(spark):
    """Every level by the largest logarithm of a uniform draw over the weight, in plain Python."""
    signed = [-5, 0, *range(1, 400), 1 << 40]
    heavy = sharding.Node("heavy", (sharding.shard_node(20, 3.0), sharding.shard_node(21, 0.5), sharding.shard_node(22, 0.0)))
    tree = sharding.Node("root", (*sharding.regular_tree(2, 2, 3).children, heavy))

    def hashed(key, name):
        first = 42 if key is None else xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
        return xxhash.xxh64_intdigest(name.encode(), first)

    def plain(key, node):
        while node.children:
            drawn = [(math.log(((hashed(key, c.name) >> 11) + 0.5) / (1 << 53)) / c.weight, c) for c in node.children if c.weight > 0]
            node = max(drawn, key=lambda d: d[0])[1]
        return node.shard

    docs = spark.createDataFrame([(k, "x") for k in [*signed, None]], "doc_id long, text string")
    grown = sharding.grown_tree(tree, 30, 2.0)
    found = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_documents(docs, tree, grown).collect()}
    assert found == {k: (plain(k, tree), plain(k, grown)) for k in [*signed, None]}


def test_tree_shares_and_movement(spark):
    """Shards get their weight's share; a heavier shard draws rows in and moves none elsewhere than on its path."""
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    tree = sharding.regular_tree(2, 2, 2)
    heavier = sharding.Node("root", (sharding.Node("region0", (
        sharding.Node("region0/rack0", (sharding.shard_node(0, 3.0), sharding.shard_node(1))), tree.children[0].children[1])), tree.children[1]))
    placed = ids.select(sharding.place(F.col("doc_id"), tree).alias("a"), sharding.place(F.col("doc_id"), heavier).alias("b")).groupBy("a", "b").count().collect()
    before, after = Counter(), Counter()
    for r in placed:
        before[r["a"]] += r["count"]
        after[r["b"]] += r["count"]
        assert r["a"] == r["b"] or r["b"] in (0, 1, 2, 3)  # rows move only into subtrees that grew
        if r["a"] in (0, 1) and r["b"] != r["a"]:
            assert r["b"] == 0
    assert all(abs(before[s] / 30_000 - 1 / 8) < 0.01 for s in range(8))
    assert abs(after[0] / 30_000 - 3 / 10) < 0.015


def roots_by_brute_force(prints: list[int], ids: list):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i in range(len(prints)):
        r = find(i)
        if ids[i] is not None:
            smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return [smallest.get(find(i)) for i in range(len(prints))]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 1])
def test_near_duplicates_of_edge_rows(edge_docs, no_docs, tile_rows):
    given = edge_rows()
    prints = [plain_fingerprint(r[1]) for r in given]
    expected = roots_by_brute_force(prints, [r[0] for r in given])
    found = simhash.near_duplicates(edge_docs, tile_rows)
    wanted = [(r[0], f"{p:016x}", c) for r, p, c in zip(given, prints, expected)]
    assert rows(found) == sorted(wanted, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 20])
def test_links_lose_no_pair(spark, tile_rows):
    """A hot group of close fingerprints and chains between random ones, with and without splitting."""
    r = random.Random(11)
    base = r.getrandbits(64)
    prints = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)}
    for _ in range(40):
        at = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            prints.add(at)
            for b in r.sample(range(64), 3):
                at ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(4)
    links = simhash.fingerprint_links(frame, tile_rows)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in rows(links))
    found = {n: x for n, x in rows(simhash.components(links))}
    expected = roots_by_brute_force(prints, list(range(len(prints))))
    groups, wanted = defaultdict(set), defaultdict(set)
    for i, p in enumerate(signed):
        groups[found.get(p, p)].add(i)
        wanted[expected[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_mixing_budgets_and_permutations(edge_docs, no_docs):
    target = {"entropy_share": 0.9, "max_repeats": 4.0}
    found = mixing.mixed_order(edge_docs, **target).collect()
    tokens = Counter()
    documents = defaultdict(Counter)
    for r in edge_rows():
        n = len((r[1] or "").encode().replace(b"\x1f", b"_").split()) + 1
        tokens[r[3]] += n
        documents[r[3]][r[0], n] += 1
    budget = sum(tokens.values())

    def weights(a):
        powered = {s: (n / budget) ** a for s, n in tokens.items()}
        return {s: p / sum(powered.values()) for s, p in powered.items()}

    def entropy(w):
        return -sum(x * math.log(x) for x in w.values())

    low, high = 0.0, 16.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(weights(middle)) > 0.9 * math.log(len(tokens)) else (low, middle)
    repeats = [max(w * budget / tokens[s] for s, w in weights(a).items()) for a in (high,)]
    assert repeats[0] <= 4 or high < 1
    blocks = defaultdict(list)
    for r in found:
        blocks[r["source"], r["block"]].append(r)
    plan = {r["source"]: r for r in mixing.mixing_plan(edge_docs, **target).collect()}
    for source, at in plan.items():
        assert at["tokens"] == tokens[source]
        if repeats[0] <= 4:
            assert abs(at["weight"] - weights(high)[source]) < 1e-6
        own = sorted(b for s, b in blocks if s == source)
        assert own == list(range(len(own)))
        for b in own:
            part = blocks[source, b]
            assert sorted(r["position"] for r in part) == list(range(len(part)))
            taken = Counter((r["doc_id"], r["tokens"]) for r in part)
            if b < at["full_blocks"]:
                assert taken == documents[source]
            else:
                assert not taken - documents[source]
        spent = sum(r["tokens"] for b in own for r in blocks[source, b])
        assert spent <= at["budget"]
        # What is left of a budget is less than the next document, or group of equal rows, would take.
        most = max(n * c for (_, n), c in documents[source].items())
        assert at["budget"] - spent <= max(most, 40 * 52)
    assert mixing.mixed_order(no_docs, **target).count() == 0


def test_any_number_of_rows_without_an_id(spark, monkeypatch):
    """Rows of one id or none keep their places, whatever the length of a run or the number of partitions."""
    docs = spark.range(900).selectExpr(
        "if(id % 3 = 0, NULL, if(id % 3 = 1, 7, id)) AS doc_id", "if(id % 2 = 0, 'a', NULL) AS source", "repeat('w ', CAST(id % 4 AS int)) AS text"
    )
    whole = rows(mixing.mixed_order(docs, entropy_share=0.99))
    assert len(whole) >= 400
    monkeypatch.setattr(mixing, "RUN_ROWS", 8)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert rows(mixing.mixed_order(docs.repartition(7), entropy_share=0.99)) == whole


def test_mixing_exponents(spark):
    shares = spark.createDataFrame([(s,) for s in (0.7, 0.2, 0.1)], "share double")
    exponent = mixing.mixing_exponent(shares, entropy_share=0.95)
    powered = [s**exponent for s in (0.7, 0.2, 0.1)]
    entropy = -sum(p / sum(powered) * math.log(p / sum(powered)) for p in powered)
    assert abs(entropy / math.log(3) - 0.95) < 1e-6
    limit = mixing.mixing_exponent(shares, max_repeats=2.0)
    powered = [s**limit for s in (0.7, 0.2, 0.1)]
    assert abs(powered[2] / sum(powered) / 0.1 - 2.0) < 1e-6
    assert mixing.mixing_exponent(shares, max_repeats=0.5) == 1.0
    assert mixing.mixing_exponent(shares, entropy_share=1.0) < 1e-3
    with pytest.raises(ValueError):
        mixing.mixing_exponent(shares)


def test_the_last_block_ends_in_the_right_range(spark, monkeypatch):
    """Many ranges per source give the same prefix of the permutation as one."""
    docs = spark.range(600).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', concat('b', id % 7)) AS source", "repeat('w ', CAST(id % 11 AS int)) AS text")
    whole = rows(mixing.mixed_order(docs, entropy_share=0.99))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    assert rows(mixing.mixed_order(docs, entropy_share=0.99)) == whole
    assert rows(mixing.mixed_order(docs.repartition(7), entropy_share=0.99)) == whole


def conversation_rows():
    r = random.Random(6)
    out = []
    for c in range(60):
        turns = r.randint(1, 6)
        out += [(c, t, ("user", "assistant")[t % 2], "\n".join(prose(r, "en", r.randint(3, 20)) for _ in range(r.randint(1, 3)))) for t in range(turns)]
    return out


CONVERSATION = "conv_id bigint, turn int, role string, text string"


def test_roles_are_recovered(spark):
    given = conversation_rows()
    found = transcripts.format_conversations(spark.createDataFrame(given, CONVERSATION).repartition(3))
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in found.collect()}
    right = sum(got.get((c, t)) == (role, text) for c, t, role, text in given)
    assert right >= 0.95 * len(given)


def test_roles_of_held_out_conversations(spark):
    """Whole conversations that the model was not fitted on, at sf0.1."""
    import zlib

    given = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text")
    whole, got = defaultdict(list), defaultdict(list)
    for r in sorted(given.collect()):
        whole[r["conv_id"]].append((r["role"], r["text"]))
    for r in sorted(transcripts.format_conversations(given).select("conv_id", "turn", "role", "text").collect()):
        got[r["conv_id"]].append((r["role"], r["text"]))
    held = [c for c in whole if zlib.crc32(str(c).encode()) % transcripts.HELD_OUT == 0]
    right = sum(got[c] == whole[c] for c in held)
    print("held-out conversations", right, "of", len(held))
    assert len(held) >= 100 and right >= 0.95 * len(held)


@pytest.mark.parametrize("part_rows", [transcripts.PART_ROWS, 128])
def test_a_long_conversation_comes_back(spark, part_rows, monkeypatch):
    monkeypatch.setattr(transcripts, "PART_ROWS", part_rows)
    r = random.Random(16)
    long = [(7_000, t, ("user", "assistant")[t % 2], prose(r, "en", r.randint(4, 12)) + ".") for t in range(1000)]
    given = conversation_rows() + long
    found = transcripts.format_conversations(spark.createDataFrame(given, CONVERSATION).repartition(5))
    got = sorted((r["turn"], r["role"], r["text"]) for r in found.filter("conv_id = 7000").collect())
    assert got == [x[1:] for x in long]


def test_what_a_turn_keeps():
    labelled = transcripts.labelled_lines([("user", "User: a b\n\n\nc d"), ("assistant", "AI: c\nd e?")])
    model = transcripts.RoleModel([labelled] * 50)
    assert model.turns("User: one\n\n\ntwo\n\nAI: Note: buy milk\n\n") == [("user", "one\n\n\ntwo"), ("assistant", "Note: buy milk")]
    for text in ("Note: buy milk", "> a quoted line", "# A heading of words", "Bob: hello"):
        assert model.turns(text)[0][1] == text
    assert transcripts.marker_of("> a quoted line") == ("none", "> a quoted line")
    assert transcripts.marker_of("[user] hi") == ("user", "hi") and transcripts.marker_of("**Agent:** hi") == ("assistant", "hi")
    assert transcripts.marker_of("### User") == ("user", "") and transcripts.marker_of("a cat") == ("none", "a cat")


def test_conversation_edge_rows(spark):
    given = conversation_rows() + [(900, 0, "user", None), (901, None, None, "hi there"), (None, 0, "tool", "x"), (902, 0, "user", "")]
    given += [(903, t % 3, "user", f"row {t} of many") for t in range(700)] + [(904, 0, "user", "same")] * 50
    frame = spark.createDataFrame(given, CONVERSATION).selectExpr("*", "'x' AS part", "'y' AS transcript", "'z' AS rendered")
    found = transcripts.format_conversations(frame).collect()
    texts = Counter(r["text"] for r in found if r["conv_id"] == 904)
    assert texts == Counter({"same": 50})
    assert "".join(sorted(r["text"] for r in found if r["conv_id"] == 903)).count("of many") == 700
    assert {r["text"] for r in found if r["conv_id"] == 901} == {"hi there"}
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in found)
    assert transcripts.format_conversations(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    model = transcripts.RoleModel([transcripts.labelled_lines([("user", "User: a b"), ("assistant", "AI: c\nd e?")])])
    shown = [f for _, f, _ in transcripts.features(["Q: what?", "", "then this", "A: so"])]

    def score(path):
        total = model.start[path[0]] + sum(model.emit[path[0]][f] for f in shown[0])
        for a, b, f in zip(path, path[1:], shown[1:]):
            total += model.move[a][b] + sum(model.emit[b][x] for x in f)
        return total

    best = max(score(p) for p in product(range(len(transcripts.STATES)), repeat=len(shown)))
    assert abs(score(model.states(shown)) - best) < 1e-9


@pytest.mark.parametrize("clustered", [False, True])
def test_forest_recall_and_scores(spark, clustered, monkeypatch):
    monkeypatch.setattr(hashforest, "ROW_PART", 300)
    monkeypatch.setattr(hashforest, "QUERY_PART", 20)
    r = np.random.default_rng(3)
    data = r.standard_normal((1500, 24)).astype(np.float32)
    if clustered:
        data = (r.standard_normal((15, 24))[r.integers(0, 15, 1500)] * 3 + data * 0.5).astype(np.float32)
    data[700:1200] = data[700]  # a third of all rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    found = hashforest.search(frame, F.col("vec_id") % 20 == 0).collect()
    exact = data.astype(np.float64)
    by_query = defaultdict(list)
    for x in found:
        assert abs(exact[x["query_id"]] @ exact[x["vec_id"]] - x["score"]) < 1e-9
        by_query[x["query_id"]].append((x["rank"], -x["score"], x["vec_id"]))
    hits = 0
    for q in range(0, 1500, 20):
        got = sorted(by_query[q])
        assert [g[0] for g in got] == list(range(1, 21)) and got == sorted(got, key=lambda g: g[1:]) and q not in {g[2] for g in got}
        scores = exact @ exact[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-20]
        hits += sum(scores[g[2]] >= least - 1e-9 for g in got)
    assert hits >= 0.9 * 20 * 75


def test_forest_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    given += [(6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.25, 0.0])]
    frame = spark.createDataFrame(given, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS own", "'x' AS code", "0 AS rank")
    found = rows(hashforest.search(frame, F.col("vec_id") % 20 == 0), order=True)
    of_0 = {(0, 1, 8, 1.0), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (0, 4, 20, 0.25)}
    of_20 = {(20, 1, 0, 0.25), (20, 2, 8, 0.25), (20, 3, 1, 0.125), (20, 4, 1, 0.125)}
    assert set(found) == of_0 | of_20 and len(found) == 8
    assert hashforest.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hashforest.search(frame.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_isolated_queries_get_all_neighbours(spark, monkeypatch):
    """Queries outside the sample, far from every cluster, get as many neighbours as all others, and the exact ones."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((20, 24)) * 5
    data = centres[np.arange(3000) % 20] + r.standard_normal((3000, 24)) * 0.02
    lone = -centres.mean(axis=0) * 4 + r.standard_normal((12, 24)) * 3
    data = np.concatenate([data, lone]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    built = hashforest.build

    def without_lone(vectors, is_query, *rest):
        """The forest of a sample that holds none of the lone queries."""
        forest = built(vectors, is_query & (F.col("vec_id") < 3000), *rest)
        return hashforest.Forest(forest.coded.withColumn("is_query", is_query), forest.dimension, forest.matches, forest.floor)

    monkeypatch.setattr(hashforest, "build", without_lone)
    monkeypatch.setattr(hashforest, "QUERY_BLOCK", 5, raising=False)
    by_query = defaultdict(list)
    for x in hashforest.search(frame, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") >= 3000)).collect():
        by_query[x["query_id"]].append((x["rank"], x["vec_id"]))
    assert set(by_query) == {*range(0, 3000, 20), *range(3000, 3012)}
    assert all([rank for rank, _ in sorted(got)] == list(range(1, 21)) and len({i for _, i in got}) == 20 for got in by_query.values())
    exact = data.astype(np.float64)
    for q in range(3000, 3012):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        assert {i for _, i in by_query[q]} == set(np.argsort(-scores)[:20].tolist())
