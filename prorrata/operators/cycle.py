"""Closing months: settlement, bills and payment allocation in order."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from prorrata.functions.dates import month_end, month_start
from prorrata.operators.allocation import (
    BLOCK_ROWS, mark_processed, resolve_payments, run_ledgers, step_numbers, units_of_accounts,
)
from prorrata.operators.billing import settlement_headers, shares_of, units_with_months
from prorrata.schemas import SETTLEMENT_KEY, UNIT_KEY


@dataclass(frozen=True)
class Books:
    """Accounting state before or after a close."""

    headers: DataFrame
    bills: DataFrame
    payments: DataFrame
    details: DataFrame


def close_months(
    books: Books,
    condominiums: DataFrame,
    units: DataFrame,
    persons: DataFrame,
    links: DataFrame,
    ordinary: DataFrame,
    extraordinary: DataFrame,
    business_days: DataFrame,
    first: dt.date,
    last: dt.date,
    as_of: dt.date,
    account: str = "Cuenta_Origen",
    person_account: str = "Cbu_Cvu",
    block_rows: int = BLOCK_ROWS,
) -> Books:
    """Close the months *first* to *last* of every building.

    A month without settlement gets one, with its bills, if *as_of* is a
    business day (`business_days`: Fecha, is_business_day); then the payments
    up to the end of the month are applied. A month that stays unsettled
    applies nothing. Settlements depend on expenses only and units not on each
    other, so all months are one pass over units instead of a pass per month. Of
    units without payments, only the bills before an issued month are read.
    """
    working = business_days.filter("is_business_day").select(F.col("Fecha").alias("Fecha_Emision"))
    issued = settlement_headers(
        condominiums, ordinary, extraordinary, first, last, as_of, existing=books.headers
    ).join(working, "Fecha_Emision", "left_semi")
    in_range = F.col("Periodo").between(F.lit(first), F.lit(last))
    settled = books.headers.filter(in_range).select(*SETTLEMENT_KEY)

    months = issued.select(
        *SETTLEMENT_KEY, "Total_Gasto_Ordinarios", "Total_Gasto_Extraordinarios", F.lit(1).alias("Nuevo")
    ).unionByName(settled.withColumn("Nuevo", F.lit(0)), allowMissingColumns=True)
    steps = F.transform("meses", lambda m: step_numbers(m["Periodo"], m["Nuevo"], *shares_of(m)))
    plan = units_with_months(months, units, condominiums).select(*UNIT_KEY, F.flatten(steps).alias("Pasos"))
    last_step = (
        issued.select(*SETTLEMENT_KEY)
        .unionByName(settled)
        .groupBy("Id_Consorcio")
        .agg(F.max("Periodo").alias("Ultimo"))
    )

    accounts = units_of_accounts(persons, links, person_account).join(last_step, "Id_Consorcio")
    in_time = month_start(F.col("Fecha")) <= F.col("Ultimo")
    resolved = (
        resolve_payments(books.payments, accounts, month_end(last), account)
        .join(last_step, "Id_Consorcio")
        .filter(in_time)
        .drop("Ultimo")
    )
    carried = issued.select("Id_Consorcio", F.add_months("Periodo", -1).alias("Periodo"))
    bills, details = run_ledgers(books.bills, plan, resolved, block_rows, carried, units.count())
    return Books(
        headers=books.headers.unionByName(issued.select(books.headers.columns)),
        bills=bills,
        payments=mark_processed(books.payments, accounts, F.last_day("Ultimo"), account),
        details=books.details.unionByName(details),
    )
