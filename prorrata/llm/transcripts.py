"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is plain text in which speakers are marked in many ways, or not at
all. The hidden state of a line is its role and whether it begins a turn. A line
shows a speaker marker (or none), whether a blank line stands before it, its
length, and whether it asks. State sequences are found by Viterbi; start,
transition and emission probabilities are counts over a bounded sample of
transcripts with known roles (SAMPLE), smoothed by one.

Lines of a turn are joined, with the blank lines between them; markers that name
a speaker are taken off where a turn begins, and every turn is rendered in one form.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from prorrata.llm.common import id_remainder, number_within, shared_value, smallest_hashes
from prorrata.sources.workarea import written

SAMPLE = 400  # transcripts that the model is fitted on
ROLES = ("system", "user", "assistant")
PART_ROWS = 4096  # turns of one transcript; a longer conversation is several, so no task holds it whole
HELD_OUT = 5  # the model is not fitted on conversations whose crc32(conv_id) is divisible by this
# Names by which speakers are marked, in lower case.
NAMES = {
    "system": ("system", "instruction", "instructions", "context", "prompt"),
    "user": ("user", "human", "q", "question", "customer", "client", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "support"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^\s{0,3}(?:[#*>\[<(|-]{0,3})\s?([A-Za-z]{1,12})\s?(?:[\])>|*]{0,3}:+[*]{0,2}|[\])>|]{1,3}|)(?:[ \t]+|$)")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]


def marker_of(line: str) -> tuple[str, str]:
    """Kind of the speaker marker of a line (a role, ``other`` or ``none``) and the line without it.

    A marker is a name with a colon or a closing bracket behind it, or a heading
    of its own; a bare word or a quoted line is none.
    """
    found = _MARKER.match(line)
    if not found:
        return "none", line
    before, after = line[: found.start(1)], line[found.end(1) : found.end()]
    rest = line[found.end() :]
    heading = before.lstrip().startswith(("#", "*"))
    if heading and rest and ":" not in after:
        return "none", line
    if not heading and not any(c in after for c in ":])>|"):
        return "none", line
    return _ROLE_OF.get(found.group(1).lower(), "other"), rest


def features(lines: list[str]) -> list[tuple[str, tuple, int]]:
    """Text, features and line number of every line that is not blank."""
    found, blank = [], False
    for number, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        words = line.count(" ") + 1
        size = 0 if words <= 3 else 1 if words <= 12 else 2 if words <= 30 else 3
        found.append((line, (("marker", marker_of(line)[0]), ("blank", blank), ("size", size), ("asks", line.rstrip().endswith("?"))), number))
        blank = False
    return found


class RoleModel:
    """Logarithms of start, transition and emission probabilities."""

    def __init__(self, labelled: list[list[tuple[tuple, int]]]):
        """*labelled*: per transcript the features and the state number of each line."""
        count = len(STATES)
        starts, moves, seen = [1] * count, [[1] * count for _ in STATES], [Counter() for _ in STATES]
        values: dict[str, set] = {"marker": {*ROLES, "other", "none"}, "blank": {False, True}, "size": {0, 1, 2, 3}, "asks": {False, True}}
        for lines in labelled:
            before = None
            for shown, state in lines:
                if before is None:
                    starts[state] += 1
                else:
                    moves[before][state] += 1
                seen[state].update(shown)
                before = state
        self.start = [math.log(n / sum(starts)) for n in starts]
        self.move = [[math.log(n / sum(row)) for n in row] for row in moves]
        self.emit = []
        for at, counts in enumerate(seen):
            role, begins = STATES[at]
            log = {}
            for name, possible in values.items():
                # Prior counts: a turn's first line is likelier to carry its own role's marker.
                prior = {v: 1.0 + 20.0 * (name == "marker" and begins and v == role) for v in possible}
                total = sum(counts[name, v] + prior[v] for v in possible)
                for v in possible:
                    log[name, v] = math.log((counts[name, v] + prior[v]) / total)
            self.emit.append(log)

    def states(self, shown: list[tuple]) -> list[int]:
        """Likeliest state sequence; ties go to the state that stands first in STATES."""
        if not shown:
            return []
        emit, move, every = self.emit, self.move, range(len(STATES))
        score = [self.start[s] + sum(emit[s][f] for f in shown[0]) for s in every]
        back: list[list[int]] = []
        for features_of in shown[1:]:
            came = [max(every, key=lambda p, s=s: (score[p] + move[p][s], -p)) for s in every]
            score = [score[came[s]] + move[came[s]][s] + sum(emit[s][f] for f in features_of) for s in every]
            back.append(came)
        at = max(every, key=lambda s: (score[s], -s))
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        return path[::-1]

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a transcript.

        Blank lines inside a turn stay; those before and after it are layout. A
        marker is taken off only if it names a known speaker.
        """
        lines = transcript.split("\n")
        shown = features(lines)
        found: list[tuple[str, list[str]]] = []
        last = 0
        for (line, _, number), state in zip(shown, self.states([f for _, f, _ in shown])):
            role, begins = STATES[state]
            if begins or not found or found[-1][0] != role:
                kind, rest = marker_of(line)
                found.append((role, [rest if kind in ROLES else line]))
            else:
                found[-1][1].extend([*lines[last + 1 : number], line])
            last = number
        return [(role, _without_blank_ends(text)) for role, text in found]


def _without_blank_ends(lines: list[str]) -> str:
    filled = [i for i, x in enumerate(lines) if x.strip()]
    return "\n".join(lines[filled[0] : filled[-1] + 1]) if filled else ""


def labelled_lines(turns: list[tuple[str, str]]) -> list[tuple[tuple, int]]:
    """Features and states of the lines of a transcript whose turns are known."""
    lines, states = [], []
    for role, text in turns:
        own = text.split("\n")
        first = next((i for i, x in enumerate(own) if x.strip()), 0)
        lines += own
        states += [STATES.index((role, i == first)) for i in range(len(own))]
    return [(shown, states[number]) for _, shown, number in features(lines)]


def learn(transcripts: DataFrame) -> RoleModel:
    """Model from *transcripts* (id, turns: array of role and line as written); the sample is bounded by SAMPLE."""
    ids = transcripts.select(F.lit(0).alias("all"), "id")
    chosen = smallest_hashes(ids, "all", "id", {0: transcripts.count()}, SAMPLE)
    sample = transcripts.join(F.broadcast(chosen.select("id")), "id", "left_semi").select("id", "turns").collect()
    sample.sort(key=lambda r: str(r["id"]))
    return RoleModel([labelled_lines([(t["role"], t["line"]) for t in r["turns"]]) for r in sample])


def parse_transcripts(transcripts: DataFrame, model: RoleModel) -> DataFrame:
    """*transcripts* (id columns and transcript) with turn, role, text, rendered: a row per recovered turn.

    A transcript that is null, empty or blank has no turn. All columns but
    transcript are kept. A transcript is parsed by itself, so rows of any number
    need no shuffle.
    """
    shared = shared_value(transcripts.sparkSession, model)

    @F.pandas_udf("array<struct<role: string, text: string>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared()
        for texts in batches:
            yield pd.Series([[{"role": r, "text": x} for r, x in model.turns(t or "")] for t in texts])

    kept = [c for c in transcripts.columns if c != "transcript"]
    turns = transcripts.select(*kept, F.posexplode(parse("transcript")).alias("turn", "_t"))
    rendered = F.concat(F.lit("<|"), F.col("_t.role"), F.lit("|>\n"), F.col("_t.text"), F.lit("\n<|end|>\n"))
    return turns.select(*kept, "turn", "_t.role", "_t.text", rendered.alias("rendered"))


# How transcripts of the conversations table are written, (system, user, assistant) for each style.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Instructions: ", "Human: ", "AI: "),
    ("Context: ", "Q: ", "A: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("### System\n", "### User\n", "### Assistant\n"),
    ("**Prompt:** ", "**Customer:** ", "**Agent:** "),
)


def _marker(style: Column, role: Column) -> Column:
    cases = [(s, r, STYLES[s][i]) for s in range(len(STYLES)) for i, r in enumerate(ROLES)]
    start = F.when((style == cases[0][0]) & (role == cases[0][1]), cases[0][2])
    return reduce(lambda case, c: case.when((style == c[0]) & (role == c[1]), c[2]), cases[1:], start)


def _parts(rows: DataFrame) -> DataFrame:
    """*rows* with part: the PART_ROWS consecutive rows of a conversation that a row belongs to.

    Conversations are counted first; only those of more rows than a part are
    sorted and numbered, across tasks.
    """
    spark = rows.sparkSession
    long = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART_ROWS)
    long = written(long.select(F.col("conv_id").alias("_long")), "long-conversations")
    if long.isEmpty():
        return rows.withColumn("part", F.lit(0))
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    # The row's place spreads equal rows over ranges.
    spread = rows.join(long, same, "left_semi").withColumn("_place", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "_place"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = number_within(spread.repartitionByRange(partitions, *order).sortWithinPartitions(*order), "conv_id", "_slot")
    parted = numbered.withColumn("part", F.floor(F.col("_slot") / PART_ROWS).cast("int"))
    return rows.join(long, same, "left_anti").withColumn("part", F.lit(0)).unionByName(parted.select(*rows.columns, "part"))


def written_transcripts(conversations: DataFrame) -> DataFrame:
    """Loose transcripts of *conversations* (conv_id, turn, role, text): conv_id, part, transcript, turns.

    The style follows from the conversation's id; every fourth turn or so after
    the first of a transcript has no marker, only a blank line before it. Roles
    other than system and assistant count as user, null texts as empty, null
    turns as 0. Turns of one number are ordered by role and text; equal rows are
    turns of their own. A conversation is one transcript per PART_ROWS turns.
    """
    rows = conversations.select(
        "conv_id",
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.when(F.col("role").isin("system", "assistant"), F.col("role")).otherwise("user").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))

    def line(turn: Column, place: Column) -> Column:
        """A turn without a marker needs a text that shows, and one before it."""
        bare = (place > 0) & (F.trim(turn["text"]) != "") & (F.pmod(F.xxhash64("conv_id", turn["turn"]), F.lit(4)) == 0)
        text = F.when(bare, F.concat(F.lit("\n"), turn["text"])).otherwise(F.concat(_marker(style, turn["role"]), turn["text"]))
        return F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), text.alias("line"))

    grouped = _parts(rows).groupBy("conv_id", "part").agg(sorted_turns.alias("_sorted"))
    return (
        grouped.select("conv_id", "part", F.transform("_sorted", line).alias("turns"))
        .withColumn("id", F.concat_ws("/", "conv_id", "part"))
        .withColumn("transcript", F.array_join(F.transform("turns", lambda t: t["line"]), "\n"))
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, text, rendered: the turns recovered from loose transcripts of *conversations*.

    `turn` counts on from part to part. The transcripts are written once; the
    model is fitted on those that are not held out (see HELD_OUT).
    """
    transcripts = written(written_transcripts(conversations), "transcripts")
    model = learn(transcripts.filter(id_remainder("conv_id", HELD_OUT) != 0))
    found = parse_transcripts(transcripts.select("conv_id", "part", "transcript"), model)
    return found.withColumn("turn", F.col("turn") + F.col("part") * PART_ROWS)
