"""Management reports.

Each report covers all buildings, or one when `condominium` is given. Applied
money is summed per bill before it meets the bill, so a bill or unit that
received a large part of all payments reaches the joins as a few rows.
Windows only ever run over calendar-sized groups. Rows come in no order;
`ordered` sorts a finished report by its keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.functions.dates import in_year, month_start, week_number, year_month
from prorrata.functions.money import ZERO, money, proportion
from prorrata.schemas import BILL_KEY, UNIT_KEY
from prorrata.sources.workarea import written

# A balance up to this counts as paid.
SMALLEST_DEBT = Decimal("0.01")
# What the debtor report shows of a person.
CONTACT = ("Apellido", "Nombre", "DNI", "Email", "Telefono")

ORDINARY = "Importe_Ordinario_Prorrateado"
EXTRAORDINARY = "Importe_Extraordinario_Prorrateado"


# Keys of the reports in the order in which they sort.
_KEYS = (
    "Id_Consorcio", "Piso", "Departamento", "NroUF", "Anio", "Semana", "Periodo", "FechaPago", "FechaPagoSiguiente",
    "Puesto",
)


def ordered(report: DataFrame) -> DataFrame:
    """A report in the order of its keys, for showing or writing it."""
    return report.orderBy(*[c for c in _KEYS if c in report.columns])


def _of_condominium(df: DataFrame, condominium: int | None) -> DataFrame:
    return df if condominium is None else df.filter(F.col("Id_Consorcio") == condominium)


def _dated_applications(
    payments: DataFrame, details: DataFrame | None, when: Column, condominium: int | None
) -> DataFrame:
    """Applied money with its day; without *details*, `payments` are collections that have both already."""
    if details is None:
        return _of_condominium(payments, condominium).filter(when)
    dated = payments.filter(when).select("Id_Pago", "Fecha")
    applied = _of_condominium(details, condominium).select("Id_Pago", *BILL_KEY, "Importe_Usado")
    return applied.join(dated, "Id_Pago").withColumn("Pagos", F.lit(1))


def collections(payments: DataFrame, details: DataFrame) -> DataFrame:
    """Applied money and number of payments per bill and day.

    A unit has no more rows than the calendar allows, whatever its payments, so
    they may be stored by unit (see `sources.buckets`). The reports take them in
    place of *payments*, with no *details*.
    """
    return (
        _dated_applications(payments, details, F.lit(True), None)
        .groupBy(*BILL_KEY, "Fecha")
        .agg(money(F.sum("Importe_Usado")).alias("Importe_Usado"), F.sum("Pagos").alias("Pagos"))
    )


def _between(start: dt.date, end: dt.date) -> Column:
    return F.col("Fecha").between(F.lit(start), F.lit(end))


def _bill_parts(bills: DataFrame, condominium: int | None) -> DataFrame:
    return _of_condominium(bills, condominium).select(*BILL_KEY, ORDINARY, EXTRAORDINARY)


def weekly_collection(
    payments: DataFrame,
    details: DataFrame | None,
    bills: DataFrame,
    start: dt.date,
    end: dt.date,
    condominium: int | None = None,
) -> DataFrame:
    """Money collected per week, split by origin, with running total and average week."""
    by_week = (
        _dated_applications(payments, details, _between(start, end), condominium)
        .groupBy(*BILL_KEY, F.year("Fecha").alias("Anio"), week_number(F.col("Fecha")).alias("Semana"))
        .agg(money(F.sum("Importe_Usado")).alias("Usado"))
        .join(_bill_parts(bills, condominium), BILL_KEY)
    )
    whole = F.col(ORDINARY) + F.col(EXTRAORDINARY)

    def share(part: str) -> Column:
        return F.when(whole == 0, F.lit(ZERO)).otherwise(F.col("Usado") * proportion(F.col(part), whole))

    weeks = by_week.groupBy("Id_Consorcio", "Anio", "Semana").agg(
        F.sum(share(ORDINARY)).alias("TotalOrdinario"),
        F.sum(share(EXTRAORDINARY)).alias("TotalExtraordinario"),
        F.sum("Usado").alias("TotalSemana"),
    )
    building = W.partitionBy("Id_Consorcio")
    return weeks.select(
        "Id_Consorcio",
        "Anio",
        "Semana",
        money(F.col("TotalOrdinario")).alias("TotalOrdinario"),
        money(F.col("TotalExtraordinario")).alias("TotalExtraordinario"),
        money(F.col("TotalSemana")).alias("TotalSemana"),
        money(F.sum("TotalSemana").over(building.orderBy("Anio", "Semana"))).alias("AcumuladoProgresivo"),
        money(F.avg("TotalSemana").over(building)).alias("PromedioPeriodo"),
    )


def monthly_by_department(
    payments: DataFrame,
    details: DataFrame | None,
    units: DataFrame,
    start: dt.date,
    end: dt.date,
    condominium: int | None = None,
    months: list[str] | None = None,
) -> DataFrame:
    """Cross-tab of collected money: one row per department, one column per month.

    Without *months* they are read from the (already aggregated) data, in order.
    """
    per_unit = (
        _dated_applications(payments, details, _between(start, end), condominium)
        .groupBy(*UNIT_KEY, month_start(F.col("Fecha")).alias("Mes"))
        .agg(money(F.sum("Importe_Usado")).alias("Usado"))
    )
    cells = (
        per_unit.join(_of_condominium(units, condominium).select(*UNIT_KEY, "Departamento"), UNIT_KEY)
        .groupBy("Id_Consorcio", "Departamento", year_month(F.col("Mes")).alias("Mes"))
        .agg(money(F.sum("Usado")).alias("Usado"))
    )
    if months is None:
        cells = written(cells, "cells")  # read twice: for the list of months and for the table
        months = [row.Mes for row in cells.select("Mes").distinct().orderBy("Mes").collect()]
    if not months:
        return cells.select("Id_Consorcio", "Departamento").limit(0)
    return cells.groupBy("Id_Consorcio", "Departamento").pivot("Mes", months).agg(F.first("Usado"))


def collection_by_origin(
    payments: DataFrame,
    details: DataFrame | None,
    bills: DataFrame,
    start: dt.date,
    end: dt.date,
    condominium: int | None = None,
) -> DataFrame:
    """Money collected per month, split into ordinary and extraordinary origin."""
    by_month = (
        _dated_applications(payments, details, _between(start, end), condominium)
        .groupBy(*BILL_KEY, month_start(F.col("Fecha")).alias("Mes"))
        .agg(money(F.sum("Importe_Usado")).alias("Usado"))
        .join(_bill_parts(bills, condominium), BILL_KEY)
    )
    whole = F.coalesce(F.col(ORDINARY), F.lit(ZERO)) + F.coalesce(F.col(EXTRAORDINARY), F.lit(ZERO))

    def share(part: str, other: str) -> Column:
        only_part = (F.col(part) > 0) & (F.col(other) == 0)
        only_other = (F.col(part) == 0) & (F.col(other) > 0)
        return (
            F.when(only_part, F.col("Usado"))
            .when(only_other, F.lit(ZERO))
            .otherwise(F.col("Usado") * proportion(F.col(part), whole))
        )

    def total(value: Column) -> Column:
        return money(F.coalesce(F.sum(value), F.lit(ZERO)))

    return (
        by_month.filter(whole > 0)
        .groupBy("Id_Consorcio", year_month(F.col("Mes")).alias("Periodo"))
        .agg(
            total(share(ORDINARY, EXTRAORDINARY)).alias("Ordinario"),
            total(share(EXTRAORDINARY, ORDINARY)).alias("Extraordinario"),
            total(F.col("Usado")).alias("Importe"),
        )
    )


def _top_months(monthly: DataFrame, amount: str, size: int) -> DataFrame:
    ranking = W.partitionBy("Id_Consorcio", "Anio").orderBy(F.desc(amount), "Mes")
    return monthly.withColumn("Puesto", F.row_number().over(ranking)).filter(F.col("Puesto") <= size)


def top_expense_months(
    ordinary: DataFrame,
    extraordinary: DataFrame,
    year: int | None = None,
    condominium: int | None = None,
    expense_type: int | None = None,
    size: int = 5,
) -> DataFrame:
    """Months with the largest expenses of each year; the type filter leaves extraordinary ones alone."""

    def monthly(expenses: DataFrame, amount: str, label: str) -> DataFrame:
        expenses = _of_condominium(expenses, condominium)
        if year is not None:
            expenses = expenses.filter(in_year(F.col("Fecha"), year))
        return (
            expenses.groupBy("Id_Consorcio", F.year("Fecha").alias("Anio"), F.month("Fecha").alias("Mes"))
            .agg(F.sum(amount).alias("Total"))
            .withColumn("Tipo", F.lit(label))
        )

    if expense_type is not None:
        ordinary = ordinary.filter(F.col("Id_Tipo_Gasto") == expense_type)
    sources = monthly(ordinary, "Importe_Total", "Gasto Ordinario").unionByName(
        monthly(extraordinary, "Importe", "Gasto Extraordinario")
    )
    totals = sources.groupBy("Id_Consorcio", "Anio", "Mes").agg(
        money(F.sum("Total")).alias("TotalGasto"),
        F.array_join(F.array_sort(F.collect_list("Tipo")), ", ").alias("TiposIncluidos"),
    )
    return _top_months(totals, "TotalGasto", size)


def top_income_months(
    payments: DataFrame,
    details: DataFrame | None,
    year: int | None = None,
    condominium: int | None = None,
    size: int = 5,
) -> DataFrame:
    """Months with the largest applied payments of each year."""
    when = F.lit(True) if year is None else in_year(F.col("Fecha"), year)
    totals = (
        _dated_applications(payments, details, when, condominium)
        .groupBy("Id_Consorcio", F.year("Fecha").alias("Anio"), F.month("Fecha").alias("Mes"))
        .agg(money(F.sum("Importe_Usado")).alias("TotalIngreso"))
    )
    return _top_months(totals, "TotalIngreso", size)


def top_debtors(
    bills: DataFrame,
    units: DataFrame,
    links: DataFrame,
    persons: DataFrame,
    year: int | None = None,
    condominium: int | None = None,
    floor: str | None = None,
    size: int = 3,
    contact: Column | None = None,
    opened: Callable[[DataFrame], DataFrame] = lambda persons: persons,
) -> DataFrame:
    """People linked to the units with the largest open balances, per building, floor and year.

    Balances carry earlier debt, so the sum over months counts it again, and
    tenants appear next to owners: both as the report is defined. People of
    equal *contact* (by default a hash of what is shown) are one; the contact
    itself is joined, and *opened*, for the winners only. Of equal debts the
    lower person comes first.
    """
    open_bills = _of_condominium(bills, condominium)
    if year is not None:
        open_bills = open_bills.filter(in_year(F.col("Periodo"), year))
    balance = F.col("Total_A_Pagar") - F.col("Pagos_Recibidos_Mes")
    floors = _of_condominium(units, condominium).select(*UNIT_KEY, "Piso")
    if floor is not None:
        floors = floors.filter(F.col("Piso") == floor)
    current = _of_condominium(links, condominium).filter(F.col("Fecha_Fin").isNull())

    # A row per unit and year before any join; the months of a year are bits of a number, so that units of one
    # contact can share them without a count of distinct values.
    debts = (
        open_bills.filter(balance > F.lit(SMALLEST_DEBT))
        .groupBy(*UNIT_KEY, F.year("Periodo").alias("Anio"))
        .agg(money(F.sum(balance)).alias("Saldo"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.month("Periodo"))).alias("Meses"))
    )
    contact = F.sha2(F.to_json(F.struct(*CONTACT)), 256) if contact is None else contact
    linked = current.select(*UNIT_KEY, "Id_Persona").join(persons.select("Id_Persona", contact.alias("contacto")), "Id_Persona")
    totals = (
        debts.join(floors, UNIT_KEY)
        .join(linked, UNIT_KEY)
        .groupBy("Id_Consorcio", "Piso", "Anio", "contacto")
        .agg(
            money(F.sum("Saldo")).alias("DeudaTotalAcumulada"),
            F.bit_count(F.bit_or("Meses")).cast("bigint").alias("Cant_Periodos_Adeudados"),
            F.min("Id_Persona").alias("Id_Persona"),
        )
    )
    # A cut at a fixed number of rows is made in the map tasks first; ties go to the lower person.
    ranking = W.partitionBy("Id_Consorcio", "Piso", "Anio").orderBy(F.desc("DeudaTotalAcumulada"), "Id_Persona")
    winners = totals.withColumn("Puesto", F.row_number().over(ranking)).filter(F.col("Puesto") <= size).drop("contacto")
    return opened(persons.join(winners, "Id_Persona")).select(
        "Id_Consorcio", "Piso", "Anio", F.concat("Apellido", F.lit(", "), "Nombre").alias("Propietario"),
        "DNI", "Email", "Telefono", "DeudaTotalAcumulada", "Cant_Periodos_Adeudados", "Puesto",
    )


def payment_intervals(
    payments: DataFrame,
    details: DataFrame | None,
    bills: DataFrame,
    start: dt.date,
    end: dt.date,
    condominium: int | None = None,
) -> DataFrame:
    """Days between consecutive payments of ordinary expenses, per unit.

    Equal rows of the report collapse, so per unit and day only two facts
    matter: whether the day has several payments (an interval of 0 days) and
    which payment day comes next. Days are counted first; the window then
    sees one row per unit and day.
    """
    with_ordinary = _of_condominium(bills, condominium).filter(F.col(ORDINARY) > 0).select(*BILL_KEY)
    days = (
        _dated_applications(payments, details, _between(start, end), condominium)
        .groupBy(*BILL_KEY, "Fecha")
        .agg(F.sum("Pagos").alias("Pagos"))
        .join(with_ordinary, BILL_KEY)
        .groupBy(*UNIT_KEY, "Fecha")
        .agg(F.sum("Pagos").alias("Pagos"))
    )
    following = F.lead("Fecha").over(W.partitionBy(*UNIT_KEY).orderBy("Fecha"))
    next_days = F.array_compact(
        F.array(F.when(F.col("Pagos") > 1, F.col("Fecha")), F.col("Siguiente"))
    )
    return (
        days.withColumn("Siguiente", following)
        .select(*UNIT_KEY, "Fecha", F.explode(next_days).alias("Siguiente"))
        .select(
            *UNIT_KEY,
            F.date_format("Fecha", "yyyy-MM-dd").alias("FechaPago"),
            F.date_format("Siguiente", "yyyy-MM-dd").alias("FechaPagoSiguiente"),
            F.datediff("Siguiente", "Fecha").alias("DiasEntrePagos"),
        )
    )
