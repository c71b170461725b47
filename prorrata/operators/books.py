"""Stored ledger: one book per unit, worked on only where payments arrive.

A book holds all bills of a unit (see `allocation.books_of`). Books are stored on
shelves, folders by a hash of the unit. A posting reads the shelves of the units
that were paid, runs those units, and rewrites these shelves; all other files stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prorrata.operators.allocation import BLOCK_ROWS, UNITS_PER_TASK, bills_of, books_of, of_units, run_books
from prorrata.schemas import UNIT_KEY
from prorrata.sources.workarea import tasks_for, written

SHELVES = 64  # folders of a new store; the more there are, the less an unpaid unit is rewritten
BILLS_PER_TASK = 150_000  # of which one task makes books
_SHELF = "Estante"
_BOOK_SCHEMA = f"Id_Consorcio int, NroUF string, libro array<bigint>, {_SHELF} int"


@dataclass(frozen=True)
class Posting:
    """What a run over the paid units changed; nothing is stored yet."""

    touched: DataFrame
    books: DataFrame
    details: DataFrame


def _shelf(shelves: int) -> Column:
    return F.pmod(F.xxhash64(*UNIT_KEY), F.lit(shelves)).cast("int").alias(_SHELF)


def _by_shelf(books: DataFrame, tasks: int, shelves: int) -> DataFrame:
    """Books in order by shelf; a shelf of more books than a task takes is several files."""
    piece = F.pmod(F.xxhash64("NroUF", "Id_Consorcio"), F.lit(max(1, -(-tasks // shelves))))
    return books.repartition(max(tasks, shelves), _SHELF, piece).sortWithinPartitions(_SHELF, *UNIT_KEY)


def store_books(bills: DataFrame, path: str, shelves: int = SHELVES) -> None:
    """Write the books of *bills* to a new path."""
    tasks = tasks_for(bills.count(), BILLS_PER_TASK)
    books = books_of(bills.repartition(tasks, *UNIT_KEY)).withColumn(_SHELF, _shelf(shelves))
    _by_shelf(books, tasks, shelves).write.mode("errorifexists").partitionBy(_SHELF).parquet(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BOOK_SCHEMA).parquet(path)


def stored_bills(spark: SparkSession, path: str) -> DataFrame:
    return bills_of(read_books(spark, path).drop(_SHELF))


def _on_shelves(books: DataFrame, units: DataFrame, shelves: int) -> tuple[DataFrame, list[int]]:
    """The books that stand on the shelves of *units*; the list has at most as many numbers as there are shelves."""
    numbers = sorted(r[0] for r in units.select(_shelf(shelves)).distinct().collect())
    return books.filter(F.col(_SHELF).isin(numbers)), numbers


def post_payments(
    spark: SparkSession, path: str, resolved: DataFrame, shelves: int = SHELVES, block_rows: int = BLOCK_ROWS
) -> Posting:
    """Apply *resolved* payments (see `allocation.resolve_payments`) to the stored books.

    Only books of units with payments are read into the run. Units without a
    book are left out.
    """

    def held(touched: DataFrame, tasks: int) -> DataFrame:
        near, _ = _on_shelves(read_books(spark, path), touched, shelves)
        return of_units(near.drop(_SHELF), touched, "left_semi", tasks)

    run = run_books(held, None, resolved, block_rows)
    return Posting(run.touched, run.books, run.details)


def publish(spark: SparkSession, path: str, posting: Posting, shelves: int = SHELVES) -> list[int]:
    """Rewrite the shelves on which a book has changed, and no other; returns their numbers.

    The new shelves are complete in the work area before the old ones go. A
    posting must be published before the next one is made.
    """
    near, numbers = _on_shelves(read_books(spark, path), posting.books, shelves)
    kept = of_units(near, posting.books, "left_anti", tasks_for(posting.books.count(), UNITS_PER_TASK))
    fresh = written(kept.unionByName(posting.books.withColumn(_SHELF, _shelf(shelves))), "shelves")
    if numbers:
        rows = _by_shelf(fresh, tasks_for(fresh.count(), UNITS_PER_TASK), shelves)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_SHELF).parquet(path)
    return numbers
