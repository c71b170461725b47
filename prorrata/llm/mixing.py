"""Temperature mixing of sources, in DataFrame operations only.

A source's weight is its share of all tokens to the power of an exponent,
normalised. The exponent is sought by repeated section: the smallest interval of
a grid that holds the answer becomes the next grid. It meets a target entropy of
the weights, or a limit to how often a source is repeated, or the entropy as far
as the limit allows.

Weights become budgets of tokens. A source is read in blocks, each a permutation
of its documents by a hash of block and row. Full blocks hold all documents; the
last one ends where the budget does. Where that is follows from sums over equal
ranges of the hash and one range in detail, so a source may hold any share of all
rows: no task sees more of it than a range, and texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.sources.workarea import written

RANGE_ROWS = 2000  # rows of a hash range, about
RUN_ROWS = 4096  # rows alike that are spread out in one go
_SECTIONS, _ROUNDS = 32, 8  # 32 ** 8 intervals
_MOST = 16.0  # largest exponent that is tried
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_tokens(text: Column) -> Column:
    """Words of a text (null: none), and one token for the end of the document."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)) + 1).cast("long")


def _grid_step(shares: DataFrame, low: float, high: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest 1 / repetition factor) at the grid points of [low, high]."""
    points = [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)]
    powered = F.pow(F.col("share"), F.col("x"))
    rows = (
        shares.select("share", F.explode(F.array(*[F.lit(p) for p in points])).alias("x"))
        .groupBy("x")
        .agg(
            F.sum(powered).alias("z"),
            F.sum(powered * F.log("share")).alias("l"),
            F.max(F.pow(F.col("share"), F.col("x") - 1)).alias("m"),
        )
        .collect()
    )
    return sorted((r["x"], math.log(r["z"]) - r["x"] * r["l"] / r["z"], r["m"] / r["z"]) for r in rows)


def _smallest(shares: DataFrame, high: float, reached) -> float:
    """Smallest exponent in [0, high] at which *reached(entropy, repetition)* holds; *high* if it never does."""
    low = 0.0
    for _ in range(_ROUNDS):
        points = _grid_step(shares, low, high)
        first = next((i for i, (_, h, m) in enumerate(points) if reached(h, m)), None)
        if first is None or first == 0:
            return points[-1 if first is None else 0][0]
        low, high = points[first - 1][0], points[first][0]
    return high


def mixing_exponent(
    shares: DataFrame, entropy_share: float | None = None, max_repeats: float | None = None, budget_share: float = 1.0
) -> float:
    """Exponent for the sources' token *shares* (column share, positive, sum 1).

    *entropy_share*: wanted entropy of the weights, as a part of the largest one
    (all sources equal). *max_repeats*: how often a source may be read at most
    when the budget is *budget_share* of all tokens. With both, the entropy gives
    way. A limit below budget_share cannot be met by any weights; then the
    exponent is 1, at which all sources repeat alike.
    """
    if entropy_share is None and max_repeats is None:
        raise ValueError("a target entropy or a repetition limit is needed")
    exponent = 0.0
    if entropy_share is not None:
        wanted = entropy_share * math.log(max(1, shares.count()))
        exponent = _smallest(shares, _MOST, lambda h, _: h <= wanted + 1e-12)
    if max_repeats is not None and exponent < 1.0:
        exponent = max(exponent, _smallest(shares, 1.0, lambda _, m: m * budget_share <= max_repeats))
    return exponent


def _key(block: Column, columns: list[str]) -> Column:
    """Place of a row in a block: a hash, as a number of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(block, *columns), 1)


def _range(key: Column, ranges: Column) -> Column:
    """Which of *ranges* equal parts of the hash's range a key lies in, from 0."""
    return F.shiftright(F.shiftright(key, 32) * ranges, 31)


def mixing_plan(
    docs: DataFrame,
    tokens: Column | None = None,
    entropy_share: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    key_columns: tuple[str, ...] = ("doc_id", "source"),
) -> DataFrame:
    """One row per source: weight, budget, full blocks, and where the last block ends.

    *docs* has source and what *tokens* (default: words of text, and one) reads.
    A null source is a source. The last block holds the ranges before _cut_range,
    and of that range the rows up to _cut_key.
    """
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    rows = written(docs.select(*key_columns, *([] if "source" in key_columns else ["source"]), tokens.alias("_tokens")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).filter("tokens > 0")
    sources = written(sources, "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    if not total:
        exponent, norm = 1.0, 1.0
    else:
        shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("share"))
        exponent = mixing_exponent(shares, entropy_share, max_repeats, budget / total)
        norm = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    weight = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent)) / F.lit(norm)
    plan = sources.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(budget)))
    plan = plan.withColumn("full_blocks", F.floor(F.col("budget") / F.col("tokens"))).withColumn(
        "_rest", F.col("budget") - F.col("full_blocks") * F.col("tokens")
    )
    plan = written(plan.withColumn("_ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("long")), "mix-plan")

    of = plan.select(F.col("source").alias("_source"), "full_blocks", "_ranges", "_rest")
    keyed = rows.join(of, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "_tokens", "_ranges", "_rest", _key(F.col("full_blocks"), list(key_columns)).alias("_key")
    ).withColumn("_range", _range(F.col("_key"), F.col("_ranges")))
    sums = keyed.groupBy("source", "_range", "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy("source").orderBy("_range"))
    ended = sums.withColumn("_upto", upto).filter("_upto > _rest").groupBy("source").agg(
        F.min_by(F.struct(F.col("_range").alias("range"), (F.col("_upto") - F.col("_sum")).alias("before")), "_range").alias("_cut")
    )
    cut = written(ended.select(F.col("source").alias("_of"), F.col("_cut.range").alias("_cut_range"), F.col("_cut.before").alias("_before")), "mix-cuts")
    detail = keyed.join(cut, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_cut_range")))
    # Any number of rows may share a key; they reach the window as one.
    detail = detail.groupBy("source", "_rest", "_before", "_key").agg(F.sum("_tokens").alias("_tokens"))
    running = F.col("_before") + F.sum("_tokens").over(
        W.partitionBy("source").orderBy("_key").rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    last = detail.withColumn("_running", running).filter("_running <= _rest").groupBy("source").agg(F.max("_key").alias("_cut_key"))
    last = last.withColumnRenamed("source", "_last")
    return (
        plan.join(cut, F.col("source").eqNullSafe(F.col("_of")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("_last")), "left")
        .select(
            "source", "tokens", "rows", "weight", "budget", "full_blocks", "_ranges",
            F.coalesce("_cut_range", F.lit(0)).alias("_cut_range"), F.coalesce("_cut_key", F.lit(-1)).alias("_cut_key"),
        )
    )


def mix(docs: DataFrame, plan: DataFrame, key_columns: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """*docs* with a column block: a row for every block that takes the document.

    The plan has one row per source and is joined as it is; the texts stay where
    they are if Spark broadcasts it, and hot sources are split if it does not.
    """
    of = plan.select(F.col("source").alias("_source"), "full_blocks", "_ranges", "_cut_range", "_cut_key")
    joined = docs.join(of, F.col("source").eqNullSafe(F.col("_source")))
    key = _key(F.col("full_blocks"), list(key_columns))
    place = _range(key, F.col("_ranges"))
    partly = (place < F.col("_cut_range")) | ((place == F.col("_cut_range")) & (key <= F.col("_cut_key")))
    copies = F.col("full_blocks") + partly.cast("long")
    return (
        joined.withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(*docs.columns, "block")
    )


def mixed_order(docs: DataFrame, **target) -> DataFrame:
    """doc_id, source, tokens, block, position of the mixture of *docs* (doc_id, text, source).

    position is the place in the permutation of a source's block, gapless from 0.
    Other columns are ignored. A null text is an empty document, a null doc_id a
    document, a null source a source. Rows of one id and source share their
    place's hash: the last block takes all of them or none, and they follow each
    other in the order of their tokens. They are counted before any window and
    spread out again afterwards, RUN_ROWS at a time, so any number of rows may
    share an id, or have none. An empty table gives no rows.
    """
    small = written(docs.select("doc_id", "source", word_tokens(F.col("text")).alias("tokens")), "mix-tokens")
    plan = written(mixing_plan(small, F.col("tokens"), **target), "mix-cut-plan")
    alike = small.groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("_rows"))
    chosen = mix(written(alike, "mix-alike"), plan).join(
        plan.select(F.col("source").alias("_of"), "_ranges"), F.col("source").eqNullSafe(F.col("_of"))
    )
    keyed = chosen.withColumn("_key", _key(F.col("block"), ["doc_id", "source"]))
    ranged = keyed.withColumn("_range", _range(F.col("_key"), F.col("_ranges"))).drop("_of", "_ranges")
    counts = ranged.groupBy("source", "block", "_range").agg(F.sum("_rows").alias("_all"))
    before = F.sum("_all").over(W.partitionBy("source", "block").orderBy("_range")) - F.col("_all")
    offsets = counts.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = W.partitionBy("source", "block", "_range").orderBy("_key", "tokens", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = (
        ranged.withColumn("_inside", F.sum("_rows").over(inside) - F.col("_rows"))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("_range") == F.col("_r")))
        .select("doc_id", "source", "tokens", "block", "_rows", (F.col("_before") + F.col("_inside")).alias("_first"))
    )
    step = F.lit(RUN_ROWS).cast("long")
    runs = first.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, step)))
    # Runs of one id part ways here, whatever they have in common.
    apart = runs.repartition("source", "block", "_first", "_run")
    last = F.least(F.col("_run") + step, F.col("_rows")) - 1
    position = F.explode(F.sequence(F.col("_first") + F.col("_run"), F.col("_first") + last))
    return apart.select("doc_id", "source", "tokens", "block", position.alias("position"))
