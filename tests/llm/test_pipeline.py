"""The corpus pipeline against a plain version of each stage, and the registered queries."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from prorrata.llm import langid, quality
from prorrata.llm.common import id_remainder
from prorrata.llm.queries import QUERIES
from prorrata.sources.workarea import written
from tests.llm.conftest import FOLDER, edge_rows
from tests.llm.test_set_operators import plain_fingerprint, roots_by_brute_force


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, documents first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], FOLDER), f"test-{name}"))
    return found


def ids(df) -> Counter:
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage(stages):
    model = langid.learn(stages[0].filter(id_remainder("doc_id", 3) != 1))
    given = stages[0].select("doc_id", "text").collect()
    names, scores = model.predict([r["text"] for r in given])
    wanted = Counter(r["doc_id"] for r, n, s in zip(given, names, scores) if n != "und" and s >= 1.1 / len(model.names))
    assert ids(stages[1]) == wanted


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(id_remainder("doc_id", 5) != 0)
    model = quality.learn(stages[1], labels)
    given = stages[1].select("doc_id", "text").collect()
    scores = model.scores([r["text"] for r in given])
    assert ids(stages[2]) == Counter(r["doc_id"] for r, s in zip(given, scores) if s >= quality.THRESHOLD)
    assert 0 < stages[2].count() < stages[1].count()


def test_near_duplicate_stage(stages):
    given = sorted((r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect())
    roots = roots_by_brute_force([plain_fingerprint(t) for _, t in given], [i for i, _ in given])
    assert ids(stages[3]) == Counter(set(roots)) and stages[3].count() < stages[2].count()


def test_mixture_stage(stages):
    before, after = ids(stages[3]), ids(stages[4])
    assert set(after) <= set(before)
    tokens = {r["doc_id"]: (r["source"], len(r["text"].encode().replace(b"\x1f", b"_").split()) + 1) for r in stages[3].collect()}
    spent, total = Counter(), Counter()
    for i, (source, n) in tokens.items():
        total[source] += n
        spent[source] += n * after[i]
    shares = np.array([spent[s] for s in total]) / sum(spent.values())
    assert abs(-(shares * np.log(shares)).sum() / np.log(len(total)) - corpus_pipeline.ENTROPY_SHARE) < 0.03
    assert 0.9 * sum(total.values()) <= sum(spent.values()) <= sum(total.values())


def test_packing_stage(stages):
    pieces = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    copies = ids(stages[4])
    assert {r["doc_id"] for r in pieces} == set(copies)
    assert all(r["n"] == r["d"] * copies[r["doc_id"]] for r in pieces)


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    """Repeated rows, null and empty texts, null ids and clashing columns pass every stage; an empty table gives none."""
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, FOLDER), f"edge-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0
    first = corpus_pipeline.language(spark, edge_docs, FOLDER)
    gone = ids(edge_docs) - ids(first)
    assert gone == Counter({200: 1, 201: 1, 202: 1, 203: 1, None: 1})
    once = ids(corpus_pipeline.one_of_each(spark, edge_docs, FOLDER))
    roots = roots_by_brute_force([plain_fingerprint(r[1]) for r in edge_rows()], [r[0] for r in edge_rows()])
    assert once == Counter(set(roots))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, FOLDER).count() == 0


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(QUERIES)
    assert "pipeline" in entry.queries()


def test_the_native_operator_runs_no_python(spark):
    from prorrata.llm.mixing import mixed_order

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = mixed_order(docs, entropy_share=0.98)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
