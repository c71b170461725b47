from __future__ import annotations

import random

import pytest

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the of and that ing thon reer onand shth what".split(),
    "de": "der die und ung keit über schön ßen lich auch".split(),
}


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name in spark.checkpoint.dir."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def prose(random_: random.Random, lang: str, words: int) -> str:
    return " ".join(random_.choice(WORDS[lang]) + random_.choice(["", "", ",", "."]) for _ in range(words))


def edge_rows() -> list[tuple]:
    """Null, empty and blank texts, a very long one, repeated rows, null ids, and ordinary documents."""
    r = random.Random(5)
    rows = [(i, prose(r, lang := r.choice(["en", "de"]), r.randint(1, 120)), lang, f"s{i % 3}", 1) for i in range(60)]
    same = prose(r, "en", 50)
    rows += [(100 + i, same, "en", "s0", 1) for i in range(40)]
    rows += [(200, None, "en", "s1", None), (201, "", None, None, 0), (202, " \n\t ", "en", "s1", 4), (203, "!!! 123 ???", "de", "s1", 9)]
    rows += [(204, prose(r, "de", 9000), "de", "s2", 1), (205, "x" * 30000, "en", "s2", 1), (206, "ein\x1fwort  zwei\x0bdrei", "de", "s2", 1)]
    rows += [(300, same + " more", "en", "s0", 1)] * 3 + [(None, same, "en", "s0", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows in several partitions, with columns whose names the operators use themselves."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)
    extra = ("score", "shard", "print", "_at", "_key", "tokens", "block", "key", "held_out")
    return docs.selectExpr("*", *(f"'x' AS {c}" for c in extra))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
