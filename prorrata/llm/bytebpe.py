"""A byte-level BPE tokenizer on texts of any length.

A *stable* position is one at which a pre-token, and with it a token, begins
whatever stands before. These are stable:

(1) A space between two characters that are not white space. Runs of letters,
numbers or signs end before white space, and white-space runs of one space before
another character belong to what follows.
(2) The character after a line break or tab, unless it is white space: of a
white-space run, only a space can belong to what follows.
(3) A change between a letter, a digit and a sign. Each run holds one of these
kinds only; the one pattern with a sign and letters is a contraction, which
begins with an apostrophe, so a letter after an apostrophe is left out. Letters
and signs are taken from scripts whose classes are beyond doubt.

Special strings of the vocabulary are cut out before all this. They hold no white
space, and changes next to one of their signs are left out; a vocabulary whose
special strings could hold a stable position all the same is refused.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from prorrata.llm.common import process_cache

LONG_RUN = 2000  # characters
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_SIGNS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~、。，：；？！"  # without the apostrophe and the signs of special strings: < | >
_STABLE = re.compile(
    rf"(?<=\S) (?=\S)|(?<=[\n\r\t])(?=\S)|(?<=[{_LETTERS}])(?=[0-9{_SIGNS}'])|(?<=[0-9])(?=[{_LETTERS}{_SIGNS}'])|(?<=[{_SIGNS}])(?=[{_LETTERS}0-9])"
)
_RUN = re.compile(r"[^ ]{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


def load(path: str):
    """The tokenizer of a file, once per worker process and without threads of its own."""
    cache = process_cache("tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder().values()
        if any(re.search(r"\s", t.content) or _STABLE.search(t.content) or t.lstrip or t.rstrip for t in added):
            raise ValueError("a special string that may hold a stable position would break their proof")
        cache[path] = tokenizer
    return cache[path]


def stable_positions(text: str, start: int, stop: int) -> list[int]:
    """Stable positions p with start <= p < stop."""
    return [m.start() for m in _STABLE.finditer(text, start, min(stop + 1, len(text))) if m.start() < stop]


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes of every token by id, and the special strings; fails unless ids follow the order of the merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    ids = [content["model"]["vocab"][a + b] for a, b in merges]
    plain = content["pre_tokenizer"]
    if ids != sorted(ids) or len(ranks) != len(ids) + 256 or plain["type"] != "ByteLevel" or plain["add_prefix_space"] or content["normalizer"]:
        raise ValueError(f"{path}: merges in the order of their ids and a plain byte-level pre-tokenizer are needed")
    return ranks, special


class RankEncoder:
    """Ids of texts as the library gives them, by a faster encoder over the ids' order.

    A byte-level BPE whose ids follow the order of its merges is the same as a
    table of ranks, which tiktoken encodes several times faster. Texts with a run
    of over LONG_RUN characters without a space are left to the library, as
    tiktoken's time grows with the square of such a run.
    """

    def __init__(self, path: str):
        cache = process_cache("encoders")
        if path not in cache:
            import public_tokenizers
            import tiktoken

            ranks, special = _ranks(path)
            cache[path] = tiktoken.Encoding(
                os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
            )
        self.fast = cache[path]
        self.tokenizer = load(path)

    def ids(self, text: str) -> list[int]:
        if _RUN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), dtype="<u4")
