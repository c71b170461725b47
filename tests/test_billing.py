from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from prorrata import schemas as S
from prorrata.operators.billing import (
    UNITS_PER_TASK, prorate_bills, recalculate_balances, replace_bills, settlement_header, settlement_headers, unit_shares,
)
from prorrata.operators.cycle import Books, close_months
from prorrata.operators.workdays import business_days
from tests.conftest import rows
from tests.test_ledger import D, Model

APRIL, MAY, JUNE = dt.date(2025, 4, 1), dt.date(2025, 5, 1), dt.date(2025, 6, 1)
TODAY = dt.date(2025, 7, 1)


@pytest.fixture(scope="module")
def world(spark):
    condominiums = spark.createDataFrame(
        [(1, 1, "UNO", "X", 2, None, D(1000), D(500)), (2, 1, "DOS", "X", 1, None, None, None)], S.CONDOMINIUM.schema
    )
    units = spark.createDataFrame(
        [
            (1, "1", "1", "A", Decimal("33.33"), 1, True, True, 0, 0),
            (1, "2", "1", "B", Decimal("0.05"), 1, False, False, 0, 0),
            (2, "1", "1", "A", Decimal("100.00"), 1, False, True, 0, 0),
        ],
        S.UNIT.schema,
    )
    ordinary = spark.createDataFrame(
        [(1, 1, 1, APRIL, D("10.10"), "a"), (2, 1, 2, dt.date(2025, 4, 30), D("20.00"), "b"), (3, 1, 1, MAY, D(7), "c")],
        S.ORDINARY_EXPENSE.schema,
    )
    extraordinary = spark.createDataFrame([(1, 1, 1, "w", 1, 2, D(50), dt.date(2025, 4, 10))], S.EXTRAORDINARY_EXPENSE.schema)
    return condominiums, units, ordinary, extraordinary


def test_settlements(spark, world):
    condominiums, _, ordinary, extraordinary = world
    headers = settlement_headers(condominiums, ordinary, extraordinary, APRIL, MAY, TODAY)
    due = (TODAY, dt.date(2025, 7, 11), dt.date(2025, 7, 21))
    assert rows(headers) == [
        (1, APRIL, *due, D("30.10"), D(50)), (1, MAY, *due, D(7), D(0)), (2, APRIL, *due, D(0), D(0)), (2, MAY, *due, D(0), D(0)),
    ]
    rest = settlement_headers(condominiums, ordinary, extraordinary, APRIL, JUNE, TODAY, existing=headers)
    assert rows(rest, "Id_Consorcio", "Periodo") == [(1, JUNE), (2, JUNE)]
    with pytest.raises(ValueError, match="already settled"):
        settlement_header(condominiums, ordinary, extraordinary, headers, 1, APRIL, TODAY)
    assert settlement_header(condominiums, ordinary, extraordinary, headers, 1, JUNE, TODAY).count() == 1


def test_proration_rounds_once_and_charges_interest_on_credits(spark, world):
    condominiums, units, ordinary, extraordinary = world
    headers = settlement_headers(condominiums, ordinary, extraordinary, APRIL, APRIL, TODAY)
    march = dt.date(2025, 3, 1)
    previous = spark.createDataFrame(
        [
            (1, "1", march, D(0), D(120), D(0), D(0), D(0), D(0), D(100)),  # credit of 20
            (1, "2", dt.date(2025, 2, 1), D(0), D(0), D(0), D(0), D(0), D(0), D(9)),  # not the month before
        ],
        S.BILL.schema,
    )
    bills = prorate_bills(headers, units, condominiums, previous)
    assert rows(bills) == [
        (1, "1", APRIL, D(-20), D(0), D(-20), D(-1), D("1510.03"), D("16.67"), D("1505.70")),
        # 0.01505 and 0.025 are stored as 0.02 and 0.03, their sum 0.04005 as 0.04
        (1, "2", APRIL, D(0), D(0), D(0), D(0), D("0.02"), D("0.03"), D("0.04")),
        (2, "1", APRIL, D(0), D(0), D(0), D(0), None, D(0), None),  # parking without a price
    ]
    again = replace_bills(bills.unionByName(previous), bills)
    assert rows(again) == rows(bills.unionByName(previous))


def test_recalculation_equals_the_literal_rules_and_is_stable(spark):
    rng = random.Random(5)
    bills, expected = [], []
    for unit in range(12):
        model = Model()
        for month in range(rng.randint(1, 9)):
            model.issue(24300 + month, D(rng.choice([0, 10, 333, "0.10"])), D(rng.choice([0, 50])))
            model.bills[24300 + month]["paid"] = D(rng.choice([0, 10, 100, 1000, "0.33"]))
        names = ["carried", "paid", "debt", "interest", "ordinary", "extraordinary", "total"]

        def table():
            return [
                (1, str(unit), dt.date(m // 12, m % 12 + 1, 1), *[b[n] for n in names]) for m, b in model.bills.items()
            ]

        bills += table()
        model.recalculate()
        expected += table()
    once = recalculate_balances(spark.createDataFrame(bills, S.BILL.schema).repartition(3))
    wanted = rows(spark.createDataFrame(expected, S.BILL.schema))
    assert rows(once) == wanted
    assert rows(recalculate_balances(once)) == wanted


def test_months_closed_at_once_or_one_by_one(spark, world):
    condominiums, units, ordinary, extraordinary = world
    persons = spark.createDataFrame(
        [(1, "1", "N", "A", None, None, False, "A"), (2, "2", "N", "A", None, None, False, "B")], S.PERSON.schema
    )
    links = spark.createDataFrame([(1, 1, "1", 1, 1, None, None), (2, 2, "1", 2, 1, None, None)], S.UNIT_PERSON.schema)
    payments = spark.createDataFrame(
        [(i, 1, day, account, D(amount), True, False) for i, day, account, amount in [
            (1, dt.date(2025, 3, 1), "A", 500), (2, dt.date(2025, 4, 20), "A", 2000), (3, dt.date(2025, 5, 2), "A", 10),
            (4, dt.date(2025, 6, 30), "A", 5), (5, dt.date(2025, 7, 1), "A", 5), (6, dt.date(2025, 5, 1), "B", 5),
        ]],
        S.PAYMENT.schema,
    )
    open_days = spark.createDataFrame([(TODAY, True)], "Fecha date, is_business_day boolean")

    def close(books, first, last, days=open_days):
        return close_months(
            books, condominiums, units, persons, links, ordinary, extraordinary, days, first, last, TODAY
        )

    start = Books(*[spark.createDataFrame([], t.schema) for t in (S.SETTLEMENT, S.BILL)], payments,
                  spark.createDataFrame([], S.PAYMENT_DETAIL.schema))
    together, stepwise = close(start, APRIL, JUNE), start
    for month in (APRIL, MAY, JUNE):
        stepwise = close(stepwise, month, month)
    for name in ("headers", "bills", "payments", "details"):
        assert rows(getattr(together, name)) == rows(getattr(stepwise, name)), name
    assert rows(together.payments, "Id_Pago", "Procesado") == [(i, i != 5) for i in range(1, 7)]

    again = close(together, APRIL, JUNE)  # all settled and processed: nothing changes
    for name in ("headers", "bills", "payments", "details"):
        assert rows(getattr(again, name)) == rows(getattr(together, name)), name

    closed = spark.createDataFrame([(TODAY, False)], open_days.schema)
    nothing = close(start, APRIL, JUNE, closed)
    assert nothing.headers.count() == nothing.bills.count() == nothing.details.count() == 0
    assert rows(nothing.payments) == rows(payments)

    applied = together.details.groupBy("Id_Pago").agg(F.sum("Importe_Usado").alias("used"))
    whole = payments.join(applied, "Id_Pago").filter("used <> Importe")
    assert whole.count() == 0  # payments of units with bills are used up
    per_bill = together.details.groupBy(*S.BILL_KEY).agg(F.sum("Importe_Usado").alias("used"))
    off = together.bills.join(per_bill, S.BILL_KEY, "left").filter("coalesce(used, 0) <> Pagos_Recibidos_Mes")
    assert off.count() == 0


def test_business_days(spark):
    days = [dt.date(2025, 6, d) for d in (14, 15, 16, 17)]  # Saturday, Sunday, holiday, Tuesday
    dates = spark.createDataFrame([(d,) for d in days], "Fecha date")
    holidays = spark.createDataFrame([("2025-06-16",)], "fecha string")
    assert rows(business_days(dates, holidays)) == list(zip(days, [False, False, False, True]))


def test_units_of_one_building_are_spread_before_they_grow_to_months(spark):
    """Small rows of many units would else be gathered into one task by their size."""
    condominiums = spark.createDataFrame([(1, 1, "UNO", "X", 2, None, D(1000), D(500))], S.CONDOMINIUM.schema)
    count, months = 3 * UNITS_PER_TASK, 12
    units = spark.range(count).select(
        F.lit(1).alias("Id_Consorcio"), F.col("id").cast("string").alias("NroUF"), F.lit(D(1)).alias("Coeficiente"),
        F.lit(True).alias("Cochera"), F.lit(False).alias("Baulera"),
    )
    headers = spark.createDataFrame(
        [(1, dt.date(2025, m + 1, 1), *3 * [TODAY], D(100), D(50)) for m in range(months)], S.SETTLEMENT.schema
    )
    sizes = [r[1] for r in unit_shares(headers, units, condominiums).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == count * months
    assert len(sizes) > 1 and max(sizes) < 2 * UNITS_PER_TASK * months
