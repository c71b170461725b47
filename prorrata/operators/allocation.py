"""Payments to units, and payments to bills (oldest debt first)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.functions.dates import from_month_index, month_index
from prorrata.functions.money import from_cents, to_cents
from prorrata.operators import ledger as L
from prorrata.schemas import BILL, BILL_KEY, PAYMENT_DETAIL, SETTLEMENT_KEY, UNIT_KEY
from prorrata.sources.buckets import bucket_count
from prorrata.sources.workarea import new_folder, tasks_for, written

# The ledger travels with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(L)

# Payments of a block that the ledger takes as rows; of a larger block it takes the sum first.
BLOCK_ROWS = 1000

# Units, or rows of payments, that one task of a run takes: its memory does not grow with the input.
UNITS_PER_TASK, PAYMENTS_PER_TASK = 2000, 200_000

_RUN_SCHEMA = (
    "Id_Consorcio int, NroUF string, kind int, month int, id bigint, sequence int, income int, block bigint, "
    + ", ".join(f"{c} bigint" for c in L.AMOUNTS)
    + ", book array<bigint>"
)
_BILL_AMOUNTS = BILL.columns[len(BILL_KEY):]


@dataclass(frozen=True)
class Allocation:
    bills: DataFrame
    details: DataFrame
    payments: DataFrame


def units_of_accounts(persons: DataFrame, links: DataFrame, person_account: str = "Cbu_Cvu") -> DataFrame:
    """The unit each account pays for: first by building and (as text) unit number among open links.

    Minimum per person, then per account, so neither a person with very many
    links nor an account shared by very many people is gathered anywhere.
    """
    first = F.min(F.struct(*UNIT_KEY)).alias("unit")
    per_person = links.filter(F.col("Fecha_Fin").isNull()).groupBy("Id_Persona").agg(first)
    return (
        persons.filter(F.col(person_account).isNotNull())
        .select("Id_Persona", F.col(person_account).alias("account"))
        .join(per_person, "Id_Persona")
        .groupBy("account")
        .agg(F.min("unit").alias("unit"))
        .select("account", "unit.*")
    )


def _is_pending(cutoff: dt.date) -> Column:
    return F.col("Es_Pago_Asociado") & ~F.col("Procesado") & (F.col("Fecha") <= F.lit(cutoff))


def resolve_payments(
    payments: DataFrame, accounts: DataFrame, cutoff: dt.date, account: str = "Cuenta_Origen"
) -> DataFrame:
    """Unprocessed payments up to *cutoff* with the unit they are for."""
    pending = payments.filter(_is_pending(cutoff)).select("Id_Pago", "Fecha", "Importe", account)
    return pending.join(accounts.withColumnRenamed("account", account), account).select(
        "Id_Pago", "Fecha", "Importe", *UNIT_KEY
    )


def mark_processed(
    payments: DataFrame, accounts: DataFrame, cutoff: dt.date | Column, account: str = "Cuenta_Origen"
) -> DataFrame:
    """Payment table after an allocation run: every resolved payment is processed."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    found = F.col("Id_Consorcio").isNotNull() & F.col("Es_Pago_Asociado") & (F.col("Fecha") <= limit)
    return (
        payments.join(accounts.withColumnRenamed("account", account), account, "left")
        .withColumn("Procesado", F.col("Procesado") | F.coalesce(found, F.lit(False)))
        .select(payments.columns)
    )


def _rows(df: DataFrame, kind: int, **values: Column) -> DataFrame:
    """Any of the tables in the one row format that a unit's run takes; unused columns are 0."""
    types = {"month": "int", "day": "int", "id": "bigint", "block": "bigint", **{c: "bigint" for c in L.AMOUNTS}}
    columns = [values.get(name, F.lit(0)).cast(kind_).alias(name) for name, kind_ in types.items()]
    steps = values.get("steps", F.lit(None)).cast("array<bigint>").alias("steps")
    return df.select(*UNIT_KEY, F.lit(kind).alias("kind"), *columns, steps)


def of_units(rows: DataFrame, units: DataFrame, how: str, tasks: int) -> DataFrame:
    """*rows* (bills or books) of the *units* ("left_semi") or of the others ("left_anti").

    Of more units than one task takes, *tasks* sets the partitions unless rows lie in buckets; a task holds the keys of
    its units and sorts no rows.
    """
    keys = units.select(*UNIT_KEY)
    if tasks > 1:
        keys = keys.repartition(max(tasks, bucket_count(rows.sparkSession)), *UNIT_KEY).hint("shuffle_hash")
    return rows.join(keys, UNIT_KEY, how)


def books_of(bills: DataFrame) -> DataFrame:
    """UNIT_KEY, libro: all bills of a unit in one array, a month and its amounts in cents after the other."""
    numbers = [month_index(F.col("Periodo")), *[to_cents(F.col(name)) for name in _BILL_AMOUNTS]]
    bill = F.array(*[n.cast("bigint") for n in numbers])
    return bills.groupBy(*UNIT_KEY).agg(F.flatten(F.collect_list(bill)).alias("libro"))


def bills_of(books: DataFrame) -> DataFrame:
    """The bills of *books*, a row each."""
    starts = F.sequence(F.lit(0), F.size("libro") - 1, F.lit(L.BOOK_WIDTH))
    one = books.select(*UNIT_KEY, "libro", F.explode(starts).alias("_at"))
    amounts = [from_cents(F.get("libro", F.col("_at") + i)).alias(name) for i, name in enumerate(_BILL_AMOUNTS, 1)]
    month = from_month_index(F.get("libro", F.col("_at")).cast("int")).alias("Periodo")
    return one.select(*UNIT_KEY, month, *amounts).select(BILL.columns)


def step_rows(steps: DataFrame) -> DataFrame:
    """Steps have the unit and `Pasos`, see `step_numbers`: one row per unit."""
    return _rows(steps, L.STEP, steps=F.col("Pasos"))


def step_numbers(month: Column, issues: Column, ordinary: Column, extraordinary: Column) -> Column:
    """One step as four numbers: month, whether a bill is issued, and its unrounded shares in millionths."""

    def millionths(share: Column) -> Column:
        return (share * F.lit(1_000_000)).cast("bigint")

    return F.array(month_index(month).cast("bigint"), issues.cast("bigint"), millionths(ordinary), millionths(extraordinary))


_BLOCK_SCHEMA = (
    "Id_Consorcio int, NroUF string, kind int, month int, day int, id bigint, block bigint, c1 bigint, read string"
)


def payment_blocks(resolved: DataFrame, block_rows: int) -> DataFrame:
    """Payments of all units in blocks, in order, written by the way they are read (see `ledger.cut_blocks`).

    Ranges of (unit, day, id) split a unit of any size, so that no task gathers
    one. A unit's number of blocks in a range is bounded by its months and by
    the batches of the range.
    """
    rows = resolved.select(
        *UNIT_KEY,
        month_index(F.col("Fecha")).cast("int").alias("month"),
        F.unix_date("Fecha").alias("day"),
        F.col("Id_Pago").cast("bigint").alias("id"),
        to_cents(F.col("Importe")).cast("bigint").alias("c1"),
    )
    order = [*UNIT_KEY, "day", "id"]
    rows = written(rows, "resolved")  # counted, sampled for the ranges, and dealt out
    ranges = rows.repartitionByRange(tasks_for(rows.count(), PAYMENTS_PER_TASK), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    return written(ranges.mapInArrow(lambda batches: L.cut_blocks(batches, block_rows), _BLOCK_SCHEMA), "blocks", ("read",))


def _run(rows: DataFrame) -> DataFrame:
    """Run every unit: one shuffle by unit, and whole batches, not single units, cross into Python.

    Numbering the rows of each unit makes Spark gather and sort them by unit,
    and that is what the ledger relies on. (A plain repartition is only a hint:
    it can be dropped where the input seems to be partitioned already.)
    """
    in_order = W.partitionBy(*UNIT_KEY).orderBy("month", "kind", "day", "id")
    numbered = rows.withColumn("position", F.row_number().over(in_order))
    return numbered.mapInArrow(lambda batches: L.run_units(batches, books=True), _RUN_SCHEMA)


def _of_kind(df: DataFrame, kind: int) -> DataFrame:
    return df.filter(F.col("kind") == kind).drop("kind")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class Run:
    """What a run changes; books are (UNIT_KEY, libro)."""

    touched: DataFrame  # units with payments
    tasks: int  # for the touched units
    books: DataFrame  # of the touched units, whole
    issued: DataFrame  # new bills of the other units
    details: DataFrame


def run_books(
    held: Callable[[DataFrame, int], DataFrame],
    steps: DataFrame | None,
    resolved: DataFrame,
    block_rows: int = BLOCK_ROWS,
    stepped: int = 0,
) -> Run:
    """Work through *steps* the units that have them (*stepped* of them) or payments.

    *held* gives, for the touched units (those with payments), the books that
    the run needs: theirs, and of other units only what their next bills carry on.
    It is given a number of tasks for the touched units.

    Payments are cut into ordered blocks. Most blocks that are known only by
    their sum go whole to one bill. A block in which some payment closes a bill
    is asked for, with the next ones, and read in the next round; a step closes
    each bill at most once, so there are at most about as many rounds as bills of
    a unit, however many payments there are. Only units that asked go on. All
    rounds are parts of one table.
    """
    blocks = payment_blocks(resolved, block_rows)
    spark = blocks.sparkSession
    touched = written(blocks.select(*UNIT_KEY).distinct(), "touched")
    paid = tasks_for(touched.count(), UNITS_PER_TASK)
    at_once = blocks.filter(F.col("read") != L.LATER).count()
    tasks = max(paid, tasks_for(stepped, UNITS_PER_TASK), tasks_for(at_once, PAYMENTS_PER_TASK))
    later = blocks.filter(F.col("read") == L.LATER)
    amounts = {c: F.col(c) for c in ("month", "day", "id", "block", "c1")}
    known = {L.PAYMENT: L.NOW, L.BLOCK: L.SUM}
    static = _union([_rows(blocks.filter(F.col("read") == read), kind, **amounts) for kind, read in known.items()])
    if steps is not None:
        static = static.unionByName(step_rows(steps))
    rows, number = static.unionByName(_rows(held(touched, paid), L.BOOK, steps=F.col("libro"))), 0
    block = [*UNIT_KEY, "month", "block"]
    folder = new_folder(spark, "ledger")
    while True:
        path = f"{folder}/round={number}"
        _run(rows.repartition(tasks, *UNIT_KEY)).write.mode("errorifexists").partitionBy("kind").parquet(path)
        result = spark.read.schema(_RUN_SCHEMA).parquet(path)
        pending = _of_kind(result, L.PENDING)
        unfinished = pending.count()
        if not unfinished:
            break
        # A unit that goes on reads at most so many rows of the blocks it asked for, and one reading is bounded by them.
        tasks = tasks_for(unfinished, UNITS_PER_TASK)
        waiting = pending.select(*UNIT_KEY)
        if number == 0:
            static = written(static.join(waiting, UNIT_KEY, "left_semi"), "unfinished")
        state = _rows(_of_kind(result, L.STATE), L.BOOK, steps=F.col("book"))
        position = _rows(pending, L.POSITION, month=F.col("month"), block=F.col("block"), id=F.col("sequence"))
        wanted = result.filter(F.col("kind").isin(L.PENDING, L.ASKED)).select(*block)
        asked = _rows(later.join(wanted, block, "left_semi"), L.PAYMENT, **amounts)
        rows = _union([static.join(waiting, UNIT_KEY, "left_semi"), state, position, asked])
        number += 1

    rounds = spark.read.schema(f"{_RUN_SCHEMA}, round int").parquet(folder).drop("round")
    # Assignment rows name the bill in `month` and the block's own month in `id`.
    targets = _of_kind(rounds, L.ASSIGNMENT).select(
        *UNIT_KEY, F.col("id").cast("int").alias("month"), "block", F.col("month").alias("bill"), "income"
    )
    whole = (
        later.filter(F.col("c1") > 0)
        .select(*block, "id", "c1")
        .join(targets, block)
        .select(*UNIT_KEY, "id", F.lit(1).alias("sequence"), F.col("bill").alias("month"), "income", "c1")
    )

    def books(kind: int) -> DataFrame:
        return _of_kind(rounds, kind).select(*UNIT_KEY, F.col("book").alias("libro"))

    details = _details(_of_kind(rounds, L.DETAIL)).unionByName(_details(whole))
    return Run(touched, paid, books(L.BOOK), books(L.ISSUED), details)


def run_ledgers(
    bills: DataFrame,
    steps: DataFrame | None,
    resolved: DataFrame,
    block_rows: int = BLOCK_ROWS,
    carried_months: DataFrame | None = None,
    stepped: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """All units' bills and payment details after working through *steps*.

    Bills of units without payments stay as they are and never reach the ledger,
    except those of *carried_months* (building, Periodo), which the bills that the
    steps issue carry on; without it, all of them may. *stepped* is the number of units with steps.
    """

    def held(touched: DataFrame, tasks: int) -> DataFrame:
        own = of_units(bills, touched, "left_semi", tasks)
        if steps is None:
            return books_of(own)
        if carried_months is None:
            return books_of(bills)
        carried = of_units(bills.join(carried_months, SETTLEMENT_KEY, "left_semi"), touched, "left_anti", tasks)
        return books_of(own.unionByName(carried))

    run = run_books(held, steps, resolved, block_rows, stepped)
    untouched = of_units(bills.select(BILL.columns), run.touched, "left_anti", run.tasks)
    return _union([untouched, bills_of(run.books.unionByName(run.issued))]), run.details


def _details(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("Id_Pago"),
        F.col("sequence").alias("Secuencia"),
        *UNIT_KEY,
        from_month_index(F.col("month")).alias("Periodo"),
        F.col("income").alias("Id_Tipo_Ingreso"),
        from_cents(F.col("c1")).alias("Importe_Usado"),
    ).select(PAYMENT_DETAIL.columns)


def allocate_payments(
    bills: DataFrame,
    payments: DataFrame,
    persons: DataFrame,
    links: DataFrame,
    cutoff: dt.date,
    account: str = "Cuenta_Origen",
    person_account: str = "Cbu_Cvu",
    block_rows: int = BLOCK_ROWS,
) -> Allocation:
    """Apply the unprocessed payments up to *cutoff*, each to the oldest debt of its unit first.

    Payments of a unit are taken by date and number. What exceeds all debt goes
    to the unit's latest bill as an advance. Balances are carried forward after
    every payment.
    """
    accounts = units_of_accounts(persons, links, person_account)
    resolved = resolve_payments(payments, accounts, cutoff, account)
    new_bills, details = run_ledgers(bills, None, resolved, block_rows)
    return Allocation(new_bills, details, mark_processed(payments, accounts, cutoff, account))
