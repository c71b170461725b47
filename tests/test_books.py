"""Stored books: postings touch paid units only; large ranges; rounds."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prorrata.operators import allocation as A, ledger as L
from prorrata.operators.books import SHELVES, post_payments, publish, read_books, store_books, stored_bills
from prorrata.schemas import BILL
from tests.conftest import rows

RESOLVED = "Id_Pago bigint, Fecha date, Importe decimal(18,2), Id_Consorcio int, NroUF string"
MONTHS = [dt.date(2025, m, 1) for m in range(1, 7)]


def bills_of_units(spark, units):
    rng = random.Random(9)

    def bill(unit, month):
        own, special = Decimal(rng.randint(0, 90_000)) / 100, Decimal(rng.choice([0, 0, 5000])) / 100
        return (1 + unit % 3, str(unit), month, *[Decimal("0.00")] * 4, own, special, own + special)

    return spark.createDataFrame([bill(u, m) for u in range(units) for m in MONTHS], BILL.schema)


def payments_of(spark, units, count, first=0):
    rng = random.Random(count)
    chosen = [(rng.choice(units)) for _ in range(count)]
    data = [(first + i, dt.date(2025, rng.randint(1, 6), rng.randint(1, 28)), Decimal(rng.randint(-100, 60_000)) / 100, 1 + u % 3, str(u)) for i, u in enumerate(chosen)]
    return spark.createDataFrame(data, RESOLVED)


def files_below(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_books_hold_their_bills(spark):
    bills = bills_of_units(spark, 40).withColumn("Total_A_Pagar", F.when(F.col("NroUF") != "7", F.col("Total_A_Pagar")))
    assert rows(A.bills_of(A.books_of(bills))) == rows(bills)


def test_postings_touch_paid_units_and_their_shelves_only(spark, tmp_path):
    """Two postings, the second of 1 % of the units, equal the allocation over all bills; other files stay."""
    path, bills = str(tmp_path / "books"), bills_of_units(spark, 300)
    early, late = payments_of(spark, list(range(300)), 900), payments_of(spark, [5, 77, 130], 12, first=10_000)
    store_books(bills, path)
    assert rows(stored_bills(spark, path)) == rows(bills)
    first = post_payments(spark, path, early)
    publish(spark, path, first)
    wanted, details = A.run_ledgers(bills, None, early)
    assert rows(stored_bills(spark, path)) == rows(wanted) and rows(first.details) == rows(details)

    before = files_below(path)
    second = post_payments(spark, path, late)
    assert second.touched.count() == second.books.count() == 3  # only these came out of the run
    changed = publish(spark, path, second)
    after = files_below(path)
    assert 1 <= len(changed) <= 3 < SHELVES
    shelves = tuple(f"Estante={n}/" for n in changed)
    untouched = {f: t for f, t in before.items() if not f.startswith(shelves)}
    assert {f: t for f, t in after.items() if not f.startswith(shelves)} == untouched and len(untouched) > 0
    wanted, details = A.run_ledgers(wanted, None, late)
    assert rows(stored_bills(spark, path)) == rows(wanted) and rows(second.details) == rows(details)
    assert rows(read_books(spark, path).select("Id_Consorcio", "NroUF")) == rows(bills.select("Id_Consorcio", "NroUF").distinct())


def test_a_posting_of_nothing_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "books")
    store_books(bills_of_units(spark, 10), path)
    before = files_below(path)
    unknown = spark.createDataFrame([(1, dt.date(2025, 1, 2), Decimal("5.00"), 9, "none")], RESOLVED)
    for resolved in (unknown, unknown.limit(0)):
        posting = post_payments(spark, path, resolved)
        assert publish(spark, path, posting) == [] and posting.details.count() == 0
    assert files_below(path) == before


def test_units_without_payments_stay_out_of_the_run(spark):
    """Of unpaid units only the bills that new ones carry on reach the ledger, and their other bills come back unchanged."""
    bills = bills_of_units(spark, 60)
    resolved = payments_of(spark, [3, 4], 9)
    next_month, carried = dt.date(2025, 7, 1), spark.createDataFrame([(c, MONTHS[-1]) for c in (1, 2, 3)], "Id_Consorcio int, Periodo date")
    steps = bills.select("Id_Consorcio", "NroUF").distinct().select(
        "*", A.step_numbers(F.lit(next_month), F.lit(1), F.lit(Decimal("100.5")), F.lit(Decimal("7"))).alias("Pasos")
    )
    seen = []
    original = A.books_of
    try:
        A.books_of = lambda df: seen.append(df.count()) or original(df)
        found = A.run_ledgers(bills, steps, resolved, carried_months=carried)
    finally:
        A.books_of = original
    assert seen == [2 * len(MONTHS) + 58]
    wanted = A.run_ledgers(bills, steps, resolved)
    assert rows(found[0]) == rows(wanted[0]) and rows(found[1]) == rows(wanted[1])
    assert found[0].filter(F.col("Periodo") == F.lit(next_month)).count() == 60


def test_blocks_of_a_range_of_600_000_unit_months():
    """Block numbers of one range stay in order and apart from the next range's, however many there are."""
    size, numbers = 10_000, []
    for part in range(60):
        unit = np.arange(part * size, (part + 1) * size)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.ones(size, np.int32)), pa.array([f"{u:07d}" for u in unit]), pa.array(np.full(size, 24_000, np.int32)),
             pa.array(np.full(size, 20_000, np.int32)), pa.array(unit), pa.array(np.full(size, 100)), pa.array(np.full(size, 3, np.int32))],
            names=["Id_Consorcio", "NroUF", "month", "day", "id", "c1", "range"],
        )
        numbers.append(batch)
    blocks = np.concatenate([b.column("block").to_numpy() for b in L.cut_blocks(iter(numbers), 1000)])
    assert len(blocks) == 600_000 and (np.diff(blocks) > 0).all()
    assert blocks[0] == 3 << 40 and blocks[-1] < 4 << 40


@pytest.mark.parametrize("asked", [1, 16])
def test_rounds_of_a_unit_with_many_blocks(spark, monkeypatch, asked):
    """A unit asks for several blocks at a time: the same rows in fewer rounds."""
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(24)]
    bills = spark.createDataFrame([(1, "1", m, *[Decimal("0.00")] * 4, Decimal("10.00"), Decimal("0.00"), Decimal("10.00")) for m in months], BILL.schema)
    data = [(i, months[i % 24], Decimal("1.00"), 1, "1") for i in range(24 * 30)]
    resolved = spark.createDataFrame(data, RESOLVED)
    wanted = A.run_ledgers(bills, None, resolved)
    monkeypatch.setattr(L, "BLOCKS_ASKED", asked)
    rounds = []
    original = A._run
    monkeypatch.setattr(A, "_run", lambda df: rounds.append(1) or original(df))
    found = A.run_ledgers(bills, None, resolved, block_rows=3)
    assert rows(found[0]) == rows(wanted[0]) and rows(found[1]) == rows(wanted[1])
    assert len(rounds) <= (4 if asked == 16 else 26)


def test_a_task_takes_a_bounded_number_of_units(spark, monkeypatch):
    """However few partitions the session's shuffles have, and however small Spark finds the rows."""
    monkeypatch.setattr(A, "UNITS_PER_TASK", 20, raising=False)
    units = spark.range(400).select(F.lit(1).alias("Id_Consorcio"), F.col("id").cast("string").alias("NroUF"))
    amounts = [F.lit(Decimal(v)).cast("decimal(18,2)").alias(c) for c, v in zip(BILL.columns[3:], (0, 0, 0, 0, 50, 0, 50))]
    bills = units.select("*", F.lit(dt.date(2025, 4, 1)).alias("Periodo"), *amounts).select(BILL.columns)
    paid = units.select(
        F.col("NroUF").cast("bigint").alias("Id_Pago"), F.lit(dt.date(2025, 4, 2)).alias("Fecha"),
        F.lit(Decimal(10)).cast("decimal(18,2)").alias("Importe"), "Id_Consorcio", "NroUF",
    )
    most, run = [], A._run

    def watched(given):
        done = run(given)
        sizes = done.select("Id_Consorcio", "NroUF", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
        most.append(max(r[1] for r in sizes.collect()))
        return done

    monkeypatch.setattr(A, "_run", watched)
    done, details = A.run_ledgers(bills, None, paid)
    assert details.count() == 400 and done.agg(F.sum("Pagos_Recibidos_Mes")).first()[0] == Decimal(4000)
    assert most and max(most) <= 60
