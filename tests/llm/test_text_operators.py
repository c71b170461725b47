"""Quality rules, quality classifier, token counts, language identification, packing."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from prorrata.llm import bytebpe, divergence, langid, packing, quality, tokencount
from prorrata.llm.common import id_remainder
from prorrata.llm.queries import byte_bpe
from tests.conftest import rows
from tests.llm.conftest import FOLDER, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_counts_equal_brute_force(edge_docs):
    def expected(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)

    found = divergence.quality_rules(edge_docs)
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    assert rows(found, *columns) == sorted(
        ((r[0], *expected(r[1])) for r in edge_rows()), key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    failed = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in found.collect()}
    assert failed[200] == failed[201] == failed[202] == (True, False)


def test_a_strange_distribution_is_not_kept(spark):
    r = random.Random(2)
    texts = [prose(r, "en", 120) for _ in range(40)]
    strange = [" ".join(f"Q{i}X#" for i in range(100)), texts[0].upper()]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + strange)], "doc_id bigint, text string, lang string")
    kept = {row["doc_id"] for row in divergence.quality_rules(docs).filter("kept").collect()}
    assert kept == set(range(40))


def test_training_equals_plain_descent(monkeypatch):
    """The same steps, one weight at a time in plain Python, give the same scores."""
    import math

    monkeypatch.setattr(quality, "STEPS", 40)
    monkeypatch.setattr(quality, "BUCKETS", 1 << 18)
    texts, labels, shares = ["good clean prose", "bad spam spam", "more prose here", "spam offer", ""], [1, 0, 1, 0, 0], (0.25, 0.75)
    model = quality.train(texts, labels, shares)

    def parts(text):
        counts = Counter(b for _, found in quality.features([text]) for b in found.tolist())
        return {b: n / counts.total() for b, n in counts.items()}

    def clip(x):
        return max(-quality.BOUND, min(quality.BOUND, x))

    random_, size = np.random.default_rng(0), quality.DIMENSION
    start = random_.uniform(-1 / size, 1 / size, (quality.BUCKETS, size))
    documents = [parts(t) for t in texts]
    vectors = {b: start[b].tolist() for d in documents for b in d}
    layer = [[0.0, 0.0] for _ in range(size)]

    def forward(own):
        mean = [sum(p * vectors[b][k] for b, p in own.items()) for k in range(size)]
        logits = [sum(mean[k] * layer[k][v] for k in range(size)) for v in (0, 1)]
        odds = [math.exp(x - max(logits)) for x in logits]
        return mean, [x / sum(odds) for x in odds]

    steps = 8 * len(labels)
    for done, i in enumerate(i for _ in range(8) for i in random_.permutation(len(labels)).tolist()):
        own, label = documents[i], labels[i]
        mean, chances = forward(own)
        weight = shares[label] * len(labels) / labels.count(label)
        rate = quality.RATE * (1 - done / steps) * min(weight, 5.0)
        error = [(chances[v] - (v == label)) * rate for v in (0, 1)]
        back = [sum(layer[k][v] * error[v] for v in (0, 1)) for k in range(size)]
        layer = [[clip(layer[k][v] - mean[k] * error[v]) for v in (0, 1)] for k in range(size)]
        for b, p in own.items():
            vectors[b] = [clip(vectors[b][k] - min(p * len(own), 4.0) * back[k]) for k in range(size)]
    assert model.scores(texts) == pytest.approx([forward(d)[1][1] for d in documents], abs=1e-3)


def test_summaries_merge_in_a_tree(spark, monkeypatch):
    """Many tasks and levels: the candidates hold every common word."""
    monkeypatch.setattr(divergence, "_MERGED", 2)
    r = random.Random(13)
    given = [("xx", " ".join(["often"] * (i % 3) + [f"r{r.randrange(5000)}" for _ in range(60)])) for i in range(300)] + [("yy", "a b a")]
    docs = spark.createDataFrame(given, "lang string, text string").repartition(11)
    found = divergence.candidate_words(docs)
    assert found["xx"] == [b"often"] and found["yy"] == [b"a", b"b"]


def test_references_and_verdicts_equal_plain_counts(spark):
    """A language that only a few rows of one end hold, rare words, untagged and foreign rows; all recomputed plainly."""
    import math
    import unicodedata

    r = random.Random(31)
    rare = [f"w{i}" for i in range(3000)]
    given = [(i, " ".join(["alpha"] * 3 + r.choices(rare, k=100)) + " Beta. gamma", "xx") for i in range(150)]
    given += [(200 + i, prose(r, "en", 90) + " only (here) only", "en") for i in range(6)]
    given += [(300, " ".join(r.choices(rare, k=80)), None), (301, "### " * 80, "xx"), (302, prose(r, "en", 120).upper(), "zz"), (303, "short one", "en"), (304, None, "en")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string").repartitionByRange(12, "doc_id")

    def words_of(text):
        return [w for w in (x.strip(".,;:!?\"'()[]") for x in WORD.findall(text.lower())) if w]

    def kind(c):
        if c in ".,;:!?'\"()-":
            return 5
        k = unicodedata.category(c)
        return {"Ll": 0, "Lu": 1}.get(k, {"L": 2, "M": 3, "N": 4, "P": 6, "S": 7}.get(k[0], 8))

    def jsd(a, b):
        if not sum(a) or not sum(b):
            return 1.0
        total = 0.0
        for x, y in zip(a, b):
            p, q = x / sum(a), y / sum(b)
            total += (p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0)
        return math.sqrt(min(1.0, max(0.0, total / 2)))

    expected = {}
    for lang in ("xx", "en", "zz"):
        texts = [t for _, t, x in given if x == lang and t]
        counts, classes = Counter(w for t in texts for w in words_of(t)), Counter(kind(c) for t in texts for c in t)
        whole = sum(counts.values())
        common = {w: n for w, n in counts.items() if n * 200 >= whole}
        expected[lang] = ([classes[k] for k in range(9)], common, whole - sum(common.values()))
    found = divergence.references(docs)
    assert set(found) == set(expected)
    for lang, (classes, common, other) in expected.items():
        assert found[lang].classes.tolist() == classes
        assert {w.decode(): found[lang].counts[i] for w, i in found[lang].words.items()} == common
        assert found[lang].counts[-1] == other

    def distances(text, lang):
        classes, _, _ = expected[lang]
        own, chars = Counter(words_of(text)), Counter(kind(c) for c in text)
        common = list(expected[lang][1])
        mine = [own[w] for w in common]
        return (jsd([chars[k] for k in range(9)], classes),
                jsd(mine + [sum(own.values()) - sum(mine)], [expected[lang][1][w] for w in common] + [expected[lang][2]]))

    for row in divergence.quality_rules(docs).collect():
        _, text, lang = next(g for g in given if g[0] == row["doc_id"])
        text, n = text or "", row["n_words"]
        chars = words = None
        if len(text) >= 200 or n >= 40:
            near = [lang] if lang in expected else list(expected)
            chars, words = min((distances(text, x) for x in near), key=lambda d: (d[1], d[0]))
            chars, words = (chars if len(text) >= 200 else None), (words if n >= 40 else None)
        assert row["char_distance"] == (None if chars is None else pytest.approx(chars, abs=1e-9))
        assert row["word_distance"] == (None if words is None else pytest.approx(words, abs=1e-9))
        far = (chars or 0) > divergence.MAX_CHAR_DISTANCE or (words or 0) > divergence.MAX_WORD_DISTANCE
        assert row["kept"] == (not row["base_failed"] and not far)


def test_summaries_miss_no_common_word():
    """Summaries of any parts, merged in any order, hold every word of a share above 1 / (counters + 1)."""
    r = random.Random(7)
    for size in (1, 5, 20):
        parts = [Counter(r.choices(["a", "b", "c", *map(str, range(300))], weights=[40, 25, 15, *[0.3] * 300], k=r.randint(1, 900))) for _ in range(17)]
        whole, merged = sum(parts, Counter()), Counter()
        for part in parts:
            merged = divergence.summary(merged + divergence.summary(part, size), size)
        assert len(merged) <= size
        for word, n in whole.items():
            assert n - whole.total() / (size + 1) <= merged[word] <= n


def test_distance_bounds():
    a, b = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert divergence.distance(a, a) == 0 and divergence.distance(a, b) == 1 and divergence.distance(a, a * 0) == 1


def test_rules_of_an_empty_table(no_docs):
    assert divergence.quality_rules(no_docs).count() == 0


def test_features_equal_brute_force():
    texts = ["ab  ab\ncde", "", "x", " a bcdef "]
    found = Counter()
    for owner, buckets in quality.features(texts):
        found.update(owner.tolist())
    expected = {}
    for i, t in enumerate(texts):
        words = t.encode().split()
        marked = [b" " + w + b" " for w in words]
        grams = sum(max(0, len(w) - n + 1) for w in marked for n in quality.NGRAMS)
        expected[i] = 1 + len(words) + grams + sum(a == b for a, b in zip(words, words[1:]))
    assert dict(found) == expected
    alone = [np.sort(np.concatenate([b for _, b in quality.features([t])])) for t in texts]
    for i in range(len(texts)):
        together = np.sort(np.concatenate([b[o == i] for o, b in quality.features(texts)]))
        assert np.array_equal(alone[i], together)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels)
    checked = found.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert len(checked) > 5 and sum(r["quality"] == r["predicted"] for r in checked) >= 0.9 * len(checked)
    assert all(0 <= r["score"] <= 1 for r in checked)


def test_training_stays_finite():
    """Short equal texts with contradicting labels, and one text many times."""
    texts = ["a a a", "b"] * 300 + ["the same text again"] * 600
    labels = [0, 1] * 150 + [1, 0] * 150 + [1] * 500 + [0] * 100
    scores = quality.train(texts, labels, (0.1, 0.9)).scores(["a a a", "b", "the same text again", "", "unseen"])
    assert np.isfinite(scores).all() and ((0 <= scores) & (scores <= 1)).all() and scores[2] > 0.5


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = quality.Model(np.random.default_rng(1).standard_normal(quality.BUCKETS))
    text = prose(random.Random(4), "en", 3000)
    pieces = list(quality.long_pieces(text, 700))
    assert "".join(pieces) == text and max(map(len, pieces)) < 720
    r = random.Random(11)
    texts = [text, "same " * 3000, "same \t\n\v\f\r  same" + " " * 5000 + "same other ", " " * 4000, "x" * 5000 + " " + "x" * 5000]
    texts += ["".join(r.choice(["a", "b", "é", " ", "  ", "\n", "a a a", "\x1f", "\u3000"]) for _ in range(3000)) for _ in range(20)]

    def multiset(found):
        return np.sort(np.concatenate([b for _, b in found]))

    whole = model.scores([*texts, "short"])
    for size in (1, 7, 64, 2000):
        monkeypatch.setattr(quality, "_CHUNK_CHARS", size)
        for t in texts[3 if size < 64 else 0 :]:
            assert np.array_equal(multiset(quality.long_features(t)), multiset(quality.features([t])))
    assert np.allclose(whole, model.scores([*texts, "short"]), atol=1e-12, rtol=0)


def test_the_sample_is_filled_with_documents_that_are_there(spark):
    """Labels without a document, and long documents, do not make the sample smaller."""
    docs = [(i, "good plain words " * (3 if i % 5 else 3000) if i % 2 else "bad bad bad noise " * 3) for i in range(200)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1) for i in range(1000, 60000)], "doc_id bigint, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(200))


def test_classifier_on_edge_rows(edge_docs, no_labels, no_docs):
    found = quality.classify(edge_docs, no_labels)
    assert found.count() == len(edge_rows()) and found.filter("score = 0.5 AND predicted = 1").count() == len(edge_rows())
    assert quality.classify(no_docs, no_labels).count() == 0
    one_label = no_docs.sparkSession.createDataFrame([(1, 0, 0), (2, 0, 0)], no_labels.schema)
    assert quality.classify(edge_docs, one_label).filter("predicted = 0").count() == len(edge_rows())


def test_language_of_edge_rows(edge_docs, no_docs):
    found = {r["doc_id"]: r for r in langid.identify(edge_docs).collect()}
    for i in (200, 201, 202, 203):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    wrong = [r[0] for r in edge_rows() if r[0] is not None and r[0] < 200 and len(r[1].split()) > 3 and found[r[0]]["lang_pred"] != r[2]]
    assert not wrong and found[204]["lang_pred"] == "de"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert langid.identify(no_docs).count() == 0
    untagged = edge_docs.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")
    assert langid.identify(untagged).filter("lang_pred <> 'und'").count() == 0


def as_text(classes) -> str:
    return "".join(map(chr, classes))


def test_references_take_an_equal_share_of_every_document(monkeypatch):
    assert langid.equal_shares([5, 100, 0, 30], 60) == [5, 28, 0, 27] and langid.equal_shares([3, 2], 9) == [3, 2]
    r = random.Random(2)
    for _ in range(200):
        lengths, total = [r.randint(0, 50) for _ in range(r.randint(1, 9))], r.randint(0, 300)
        taken = langid.equal_shares(lengths, total)
        cut = [t for t, n in zip(taken, lengths) if t < n]
        assert sum(taken) == min(total, sum(lengths)) and all(t <= n for t, n in zip(taken, lengths))
        assert not cut or max(taken) - min(cut) <= 1
    texts = [c * 1000 for c in "abcdefgh"]
    classes = langid.letter_classes(texts)
    made = langid.reference(texts, classes, 400)
    assert 393 <= len(made) <= 400 and all(42 <= (made == classes[ord(c)]).sum() <= 50 for c in "abcdefgh")


def test_many_letters_and_many_languages(spark):
    """Thousands of letters stay apart; of hundreds of languages each can be predicted, long documents or not."""
    r = random.Random(9)
    words = {i: ["".join(chr(0x4E00 + 40 * i + 5 * w + k) for k in range(5)) for w in range(8)] for i in range(200)}
    given = []
    for i in range(200):
        for k in range(4):
            given.append((len(given), " ".join(r.choice(words[i]) for _ in range(5_000 if i < 3 else 12)), f"l{i}"))
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string")
    found = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    learned = {t for i, _, t in given if not found[i]["held_out"]}
    assert len(learned) > 180 and all(found[i]["lang_pred"] == t for i, _, t in given if t in learned)


def test_phrases_equal_a_greedy_parse():
    """The vectorised automaton parse against substring search."""
    r = random.Random(7)
    samples = {lang: [prose(r, lang, 150)] for lang in ("en", "de")}
    model = langid.Languages(samples)
    texts = [prose(r, "de", 200), "qzx the", "und", "the " * 90, "日本 der"]
    sequence, starts = langid.encode(texts, model.classes)
    counts = model.phrases(sequence, starts)
    for number, lang in enumerate(model.names):
        reference = as_text(langid.encode([samples[lang][0]], model.classes)[0])
        for i in range(len(texts)):
            own, expected = as_text(sequence[starts[i] : starts[i + 1]]), 0
            for at in range(0, len(own), langid.BLOCK):
                block, place = own[at : at + langid.BLOCK], 0
                while place < len(block):
                    size = 1
                    while place + size < len(block) and block[place : place + size + 1] in reference:
                        size += 1
                    unseen = block[place : place + 1] not in reference
                    place, expected = place + size, expected + 1
                    if unseen and place >= len(block):
                        expected += 1  # the block's end closes the empty phrase after it
            assert counts[i, number] == expected, (lang, i)


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.RankEncoder(byte_bpe())


def odd_texts():
    r = random.Random(3)
    fixed = ["", " ", "  a  b ", "y" * 5000, " " * 4000, ("ab" * 900 + " ") * 9, "it's <|endoftext|> a<|endoftext|>b \n\n c" * 80, " x　y" * 300]
    return fixed + ["".join(r.choice(" \n\t aAé1'#<|endoftext|> 字s") for _ in range(600)) for _ in range(60)]


def test_rank_encoder_equals_the_library(encoder):
    for text in odd_texts():
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(16, 2), (64, 4), (200, 16), (1000, 1)])
def test_overlapping_chunks_equal_the_whole(encoder, chunk, overlap):
    texts = odd_texts()
    whole = [len(encoder.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert tokencount.count_texts(texts, encoder, chunk, overlap) == whole


def test_token_counts_of_edge_rows(edge_docs, no_docs, encoder):
    found = rows(tokencount.count_tokens(edge_docs, byte_bpe()))
    expected = []
    for doc_id, text, *_ in edge_rows():
        n = len(encoder.tokenizer.encode(text or "", add_special_tokens=False))
        expected.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert found == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert tokencount.count_tokens(no_docs, byte_bpe()).count() == 0


def test_best_fit_equals_a_plain_search():
    r = np.random.default_rng(4)
    for count in (1, 7, 400):
        lengths = r.integers(1, 65, count)
        sequences, offsets = packing.best_fit(lengths, 64)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [c for c in room if c >= lengths[i]]
            if fits:
                room.remove(min(fits))
                left = min(fits) - lengths[i]
            else:
                left = 64 - lengths[i]
            room.append(left)
        used = np.bincount(sequences, weights=lengths)
        assert sorted(64 - used) == sorted(room)
        for s in range(len(used)):
            own = np.flatnonzero(sequences == s)
            ends = np.sort(offsets[own] + lengths[own])
            assert np.array_equal(np.sort(offsets[own])[1:], ends[:-1]) and offsets[own].min() == 0


def test_packing_is_a_round_trip(edge_docs, no_docs, encoder):
    found = packing.pack_documents(edge_docs, byte_bpe(), with_ids=True).collect()
    expected = Counter((r[0], tuple(encoder.encode(r[1] or "").tolist()) + (0,)) for r in edge_rows())
    single = Counter()
    for r in found:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        single[r["doc_id"]] += r["length"]
    total = Counter()
    for (doc_id, ids), n in expected.items():
        total[doc_id] += n * len(ids)
    assert single == total
    by_sequence: dict[int, list] = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    once = [r for r in found if r["doc_id"] == 204]
    ids = [i for r in sorted(once, key=lambda r: r["start"]) for i in r["ids"]]
    assert (204, tuple(ids)) in expected
    assert packing.pack_documents(no_docs, byte_bpe()).count() == 0


def test_long_texts_are_encoded_in_segments(encoder):
    r = random.Random(8)
    for text in [prose(r, "de", 400), "z" * 900, "a  b " * 200]:
        assert np.array_equal(packing.document_ids(text, encoder.encode, 100), packing.document_ids(text, encoder.encode))


def test_remainders(edge_docs):
    found = edge_docs.select("doc_id", id_remainder("doc_id", 5).alias("r")).filter("doc_id IS NOT NULL").collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in found)
