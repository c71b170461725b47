"""Token counts of texts without spaces, and models on workers without the package."""

from __future__ import annotations

import random
import subprocess
import sys
import time
from pathlib import Path

import pytest

from prorrata.llm import tokencount
from prorrata.llm.bytebpe import load, stable_positions
from prorrata.llm.queries import byte_bpe

ROOT = Path(__file__).resolve().parents[2]
PIECES = [
    "word,", "don't", "it's", "'s", "!'s", "'re'", "9'll", "x=1;", "{a:b}", "中文字。", "日本語、", "한국어", "<|endoftext|>", "<|endof", "text|>",
    "\n", "\n\n  ", "\t", " ", "  ", "a1b2", "3.14", "é", "straße", "…", " ", "🙂", "́", "ǅ", "Ⅷ", "²", "'", "''", "|", "<", ">", "_", "\\",
]


@pytest.fixture(scope="module")
def tokenizer():
    return load(byte_bpe())


def test_counts_do_not_depend_on_chunks(tokenizer):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 120)))
        whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tokencount.count_long(text, tokenizer, rng.choice([40, 64, 100]), rng.choice([16, 20])) == whole, text


def test_tokens_begin_at_stable_positions(tokenizer):
    """Whatever part of a text is encoded, provided that it cuts no special string."""
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice([p for p in PIECES if "|" not in p]) for _ in range(60))
        for place in stable_positions(text, 1, len(text) - 1):
            start, stop = rng.randint(0, place - 1), rng.randint(place + 1, len(text))
            begins = {a + start for a, _ in tokenizer.encode(text[start:stop], add_special_tokens=False).offsets}
            assert place in begins, (text, place, start, stop)


@pytest.mark.parametrize("text", ["word," * 80_000, "中文字符没有空格。" * 30_000, "中文" * 100_000, "a" * 300_000, "x=1;y=2\n" * 40_000, " " * 200_000])
def test_long_texts_without_spaces_take_no_longer_than_a_few_times_the_library(tokenizer, text):
    started = time.perf_counter()
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    library = time.perf_counter() - started
    started = time.perf_counter()
    assert tokencount.count_long(text, tokenizer) == whole
    assert time.perf_counter() - started < 6 * library + 2


def test_models_reach_workers_that_cannot_import_the_package(tmp_path):
    """A session started outside the repository; only the driver has the package on its path."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from prorrata.llm.queries import QUERIES
from prorrata.session import local_session
spark = local_session(2, 2)
for name in sys.argv[1:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""
    names = [n for n in sorted(__import__("prorrata.llm.queries", fromlist=["QUERIES"]).QUERIES)]
    (tmp_path / "job.py").write_text(code)
    done = subprocess.run([sys.executable, "job.py", *names], capture_output=True, text=True, timeout=900, cwd=tmp_path, env={
        k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert [x.split()[0] for x in done.stdout.splitlines() if x.startswith("op")] == names
