"""The unit ledger against a literal, slow reading of the allocation rules."""

from __future__ import annotations

import datetime as dt
import random
import subprocess
import sys
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prorrata.operators import ledger as L
from prorrata.operators.allocation import allocate_payments, run_ledgers, step_numbers
from prorrata.schemas import BILL, PAYMENT, PERSON, UNIT_PERSON
from tests.conftest import rows

CENT = Decimal("0.01")


def D(value) -> Decimal:
    return Decimal(str(value)).quantize(CENT, ROUND_HALF_UP)


class Model:
    """One unit, one rule at a time, over decimals."""

    def __init__(self):
        self.bills = {}  # month -> dict

    def issue(self, month, ordinary, extraordinary):
        before = self.bills.get(month - 1)
        rest = before["total"] - before["paid"] if before else Decimal(0)
        self.bills[month] = dict(
            carried=rest, paid=D(0), debt=rest, interest=D(rest * Decimal("0.05")), ordinary=D(ordinary),
            extraordinary=D(extraordinary),
            total=D(rest + rest * Decimal("0.05") + ordinary + extraordinary),
        )

    def recalculate(self):
        carry = None
        for i, month in enumerate(sorted(self.bills)):
            bill = self.bills[month]
            if i == 0:
                carry = D(bill["total"] - bill["paid"])
                continue
            interest = carry * Decimal("0.05") if carry > 0 else Decimal(0)
            exact = carry + interest + bill["ordinary"] + bill["extraordinary"]
            bill.update(carried=carry, interest=D(interest), total=D(exact), debt=max(carry, Decimal(0)))
            carry = D(exact - bill["paid"])

    def pay(self, payment, amount, details):
        sequence = 0
        while amount > 0:
            due = [m for m in sorted(self.bills) if self.bills[m]["total"] - self.bills[m]["paid"] > CENT]
            if due:
                month, kind = due[0], 1
                use = min(amount, self.bills[month]["total"] - self.bills[month]["paid"])
            elif self.bills:
                month, kind, use = max(self.bills), 3, amount
            else:
                break
            self.bills[month]["paid"] += use
            sequence += 1
            details.append((payment, sequence, month, kind, use))
            amount -= use
        self.recalculate()


def input_table(rows_):
    names = ["Id_Consorcio", "NroUF", "kind", "month", "day", "id", "block", *L.AMOUNTS, "steps"]
    types = {"NroUF": pa.string(), "steps": pa.list_(pa.int64())}
    columns = {n: [] for n in names}
    for row in rows_:
        full = {"Id_Consorcio": 1, "NroUF": "1", **row}
        for name in names:
            columns[name].append(full.get(name))
    return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in columns.items()})


def result(table):
    bills, details = {}, []
    for r in table.to_pylist():
        if r["kind"] == L.BILL:
            bills[r["month"]] = tuple(r[c] for c in L.AMOUNTS)
        elif r["kind"] == L.DETAIL:
            details.append((r["id"], r["sequence"], r["month"], r["income"], r["c1"]))
    return bills, sorted(details)


def expected(model, details):
    names = ["carried", "paid", "debt", "interest", "ordinary", "extraordinary", "total"]
    return (
        {m: tuple(int(b[n] * 100) for n in names) for m, b in model.bills.items()},
        sorted((p, s, m, k, int(u * 100)) for p, s, m, k, u in details),
    )


def random_unit(rng: random.Random):
    """Steps and payments of one unit; amounts small enough to hit ties and the one-cent limit."""
    start = 24000
    months = list(range(start, start + rng.randint(1, 6)))
    steps = [(m, Decimal(rng.choice([0, 1, 333, 1000, 12345])) / 7, Decimal(rng.choice([0, 0, 50]))) for m in months]
    steps = [(m, o.quantize(Decimal("0.000001")), e) for m, o, e in steps]
    payments = []
    for i in range(rng.randint(0, 25)):
        amount = D(rng.choice([0, -5, "0.01", "0.02", 1, 7, "47.62", 100, 1500, 3000]))
        payments.append((rng.choice(months), rng.randint(1, 28), i, amount))
    return steps, sorted(payments)


@pytest.mark.parametrize("seed", range(60))
def test_cycle_of_one_unit_equals_the_literal_rules(seed):
    rng = random.Random(seed)
    steps, payments = random_unit(rng)
    model, details = Model(), []
    for month, ordinary, extraordinary in steps:
        model.issue(month, ordinary, extraordinary)
        for p_month, _, number, amount in payments:
            if p_month == month:
                model.pay(number, amount, details)
    data = [
        dict(kind=L.STEP, steps=[n for m, o, e in steps for n in (m, 1, int(o * 10**6), int(e * 10**6))])
    ] + [
        dict(kind=L.PAYMENT, month=m, day=m * 31 + d, id=n, block=0, c1=int(a * 100)) for m, d, n, a in payments
    ]
    rng.shuffle(data)
    batches = input_table(data).to_batches(max_chunksize=7)
    assert result(pa.Table.from_batches(L.run_units(iter(batches)))) == expected(model, details)


UNIT_MONTHS = [dt.date(2025, 4, 1), dt.date(2025, 5, 1), dt.date(2025, 6, 1)]


def bill(unit, month, ordinary, total=None, carried=0, paid=0, debt=0, interest=0):
    return (1, unit, month, D(carried), D(paid), D(debt), D(interest), D(ordinary), D(0),
            D(ordinary if total is None else total))


def world(spark, people, payments, bills):
    """people: (person, account, unit); payments: (id, day, account, amount)."""
    persons = [(p, str(p), "N", "A", None, None, False, a) for p, a in sorted({(p, a) for p, a, _ in people})]
    links = [(i, 1, u, p, 1, None, None) for i, (p, _, u) in enumerate(people)]
    paid = [(i, 1, day, account, D(amount), True, False) for i, day, account, amount in payments]
    return (
        spark.createDataFrame(bills, BILL.schema),
        spark.createDataFrame(paid, PAYMENT.schema),
        spark.createDataFrame(persons, PERSON.schema),
        spark.createDataFrame(links, UNIT_PERSON.schema),
    )


def test_worked_example(spark):
    april, may, june = UNIT_MONTHS
    people = [(1, "A", "7")]
    bills = [bill("7", april, 1000), bill("7", may, 1000, total=2050, carried=1000, debt=1000, interest=50)]
    day = dt.date(2025, 5, 10)
    tables = world(spark, people, [(1, day, "A", 1500), (2, day, "A", 700)], bills)
    done = allocate_payments(*tables, cutoff=dt.date(2025, 5, 31))
    assert rows(done.details, "Id_Pago", "Secuencia", "Periodo", "Id_Tipo_Ingreso", "Importe_Usado") == [
        (1, 1, april, 1, D(1000)), (1, 2, may, 1, D(500)), (2, 1, may, 1, D(500)), (2, 2, may, 3, D(200)),
    ]
    assert rows(done.bills.filter("Periodo = '2025-05-01'")) == [
        (1, "7", may, D(0), D(1200), D(0), D(0), D(1000), D(0), D(1000))
    ]
    # June is issued with the credit of 200 and negative interest; the first payment realigns it.
    june_bill = bill("7", june, 1000, total=790, carried=-200, debt=-200, interest=-10)
    later = world(spark, people, [(3, dt.date(2025, 6, 5), "A", 100)], [])
    bills = done.bills.unionByName(spark.createDataFrame([june_bill], BILL.schema))
    done = allocate_payments(bills, *later[1:], cutoff=dt.date(2025, 6, 30))
    assert rows(done.bills.filter("Periodo = '2025-06-01'")) == [
        (1, "7", june, D(-200), D(100), D(0), D(0), D(1000), D(0), D(800))
    ]
    assert rows(done.payments, "Id_Pago", "Procesado") == [(3, True)]


def test_edges_of_allocation(spark):
    april = UNIT_MONTHS[0]
    people = [(1, "A", "1"), (2, "B", "2"), (2, "B", "10"), (3, "C", "3")]
    bills = [bill("1", april, 10), bill("2", april, 10), bill("10", april, 10)]
    day = dt.date(2025, 4, 5)
    payments = [
        (1, day, "A", "9.99"),   # leaves one cent: counts as paid
        (2, day, "A", 5),        # so this is an advance
        (3, day, "A", 0),        # processed without effect
        (4, day, "B", 1),        # unit '10' comes before '2' as text
        (5, day, "C", 1),        # unit without bills
        (6, dt.date(2025, 5, 1), "A", 1),  # after the cutoff
        (7, day, "X", 1),        # unknown account
    ]
    done = allocate_payments(*world(spark, people, payments, bills), cutoff=dt.date(2025, 4, 30))
    assert rows(done.details, "Id_Pago", "NroUF", "Id_Tipo_Ingreso", "Importe_Usado") == [
        (1, "1", 1, D("9.99")), (2, "1", 3, D(5)), (4, "10", 1, D(1)),
    ]
    assert rows(done.payments, "Id_Pago", "Procesado") == [
        (1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, False),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_units_give_the_same_result_in_blocks(spark, seed):
    """Taking blocks by their sums must not change a single row, whatever their size."""
    rng = random.Random(seed)
    bills, payments = [], []
    for unit in ("1", "2", "3"):
        for month in UNIT_MONTHS:
            bills.append(bill(unit, month, rng.choice([100, 333, 1000])))
    resolved = []
    for number in range(400):
        unit = rng.choice(["1", "1", "1", "2", "3"])
        day = dt.date(2025, rng.randint(3, 6), rng.randint(1, 28))
        resolved.append((number, day, D(rng.choice([0, -1, "0.01", "3.33", 5, 20, 40])), 1, unit))
    schema = "Id_Pago bigint, Fecha date, Importe decimal(18,2), Id_Consorcio int, NroUF string"
    frames = spark.createDataFrame(bills, BILL.schema), spark.createDataFrame(resolved, schema)
    steps_schema = "Id_Consorcio int, NroUF string, Periodo date, Ordinario decimal(24,6), Extraordinario decimal(24,6), Nuevo int"
    steps = spark.createDataFrame(
        [(1, u, m, Decimal("333.333333"), Decimal("10"), 1) for u in ("1", "2", "3") for m in UNIT_MONTHS], steps_schema
    )
    numbers = step_numbers(F.col("Periodo"), F.col("Nuevo"), F.col("Ordinario"), F.col("Extraordinario"))
    steps = steps.groupBy("Id_Consorcio", "NroUF").agg(F.flatten(F.collect_list(numbers)).alias("Pasos"))
    none = spark.createDataFrame([], BILL.schema)
    for start, plan in ((frames[0], None), (none, steps)):
        whole = run_ledgers(start, plan, frames[1])
        blocks = run_ledgers(start, plan, frames[1], block_rows=0)
        mixed = run_ledgers(start, plan, frames[1], block_rows=7)
        for other in (blocks, mixed):
            assert rows(whole[0]) == rows(other[0])
            assert rows(whole[1]) == rows(other[1])
        assert whole[1].count() > 250


def test_workers_do_not_need_the_package(tmp_path):
    """The function sent to the workers loads where this package cannot be imported."""
    from pyspark import cloudpickle

    (tmp_path / "run_units.pickle").write_bytes(cloudpickle.dumps(L.run_units))
    code = (
        "import pickle, sys, pyspark.cloudpickle\n"
        "sys.modules['prorrata'] = None\n"
        "assert list(pickle.load(open('run_units.pickle', 'rb'))(iter([]))) == []\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
