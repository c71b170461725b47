"""Monthly settlement, bills per unit and balances carried from month to month."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prorrata.functions.dates import month_start
from prorrata.functions.money import MONEY, MONTHLY_INTEREST, ZERO, from_cents, money, to_cents
from prorrata.operators import balances
from prorrata.schemas import BILL, SETTLEMENT, SETTLEMENT_KEY, UNIT_KEY
from prorrata.sources.workarea import tasks_for

# The steps travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(balances)

_ORDINARY, _EXTRAORDINARY = "Importe_Ordinario_Prorrateado", "Importe_Extraordinario_Prorrateado"

FIRST_DUE_DAYS, SECOND_DUE_DAYS = 10, 20

# Units that one task spreads over their months; a larger building is dealt out in pieces of about so many units.
UNITS_PER_TASK, UNITS_PER_PIECE = 2000, 250


def monthly_totals(expenses: DataFrame, amount: str, first: dt.date, last: dt.date) -> DataFrame:
    """Sum per building and month over a date range that reaches the scan."""
    after_last = dt.date(last.year + last.month // 12, last.month % 12 + 1, 1)
    return (
        expenses.filter((F.col("Fecha") >= F.lit(first)) & (F.col("Fecha") < F.lit(after_last)))
        .groupBy("Id_Consorcio", month_start(F.col("Fecha")).alias("Periodo"))
        .agg(F.sum(amount).alias("Total"))
    )


def settlement_headers(
    condominiums: DataFrame,
    ordinary: DataFrame,
    extraordinary: DataFrame,
    first: dt.date,
    last: dt.date,
    as_of: dt.date,
    existing: DataFrame | None = None,
) -> DataFrame:
    """New settlement headers of every building for the months *first* to *last*.

    Months without expenses get zero totals; periods already settled are left out.
    """
    months = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))
    periods = condominiums.select("Id_Consorcio", F.explode(months).alias("Periodo"))
    if existing is not None:
        periods = periods.join(existing.select(*SETTLEMENT_KEY), SETTLEMENT_KEY, "left_anti")
    regular = monthly_totals(ordinary, "Importe_Total", first, last).withColumnRenamed("Total", "Regular")
    special = monthly_totals(extraordinary, "Importe", first, last).withColumnRenamed("Total", "Special")
    issued = F.lit(as_of)
    return (
        periods.join(regular, SETTLEMENT_KEY, "left")
        .join(special, SETTLEMENT_KEY, "left")
        .select(
            *SETTLEMENT_KEY,
            issued.alias("Fecha_Emision"),
            F.date_add(issued, FIRST_DUE_DAYS).alias("Fecha_Vencimiento1"),
            F.date_add(issued, SECOND_DUE_DAYS).alias("Fecha_Vencimiento2"),
            money(F.coalesce("Regular", F.lit(ZERO))).alias("Total_Gasto_Ordinarios"),
            money(F.coalesce("Special", F.lit(ZERO))).alias("Total_Gasto_Extraordinarios"),
        )
        .select(SETTLEMENT.columns)
    )


def settlement_header(
    condominiums: DataFrame,
    ordinary: DataFrame,
    extraordinary: DataFrame,
    existing: DataFrame,
    condominium: int,
    period: dt.date,
    as_of: dt.date,
) -> DataFrame:
    """Header of one building and month; an error when that period is already settled."""
    ours = F.col("Id_Consorcio") == condominium
    if not existing.filter(ours & (F.col("Periodo") == F.lit(period))).isEmpty():
        raise ValueError(f"building {condominium} is already settled for {period:%Y-%m}")
    return settlement_headers(
        condominiums.filter(ours), ordinary.filter(ours), extraordinary.filter(ours), period, period, as_of
    )


def units_with_months(
    months: DataFrame, units: DataFrame, condominiums: DataFrame, of_units: DataFrame | None = None
) -> DataFrame:
    """Every unit with its building's months in order as one array `meses`, and what its shares depend on.

    *months* has the building, Periodo and any other columns; *of_units* is at most a
    row per unit, whose columns go with the unit. `Tasa` is the unit's part of a
    total, `Fijo` what it owes each month besides. A building with very
    many units is as many small rows to the join, whatever the number of months.
    The rows are dealt into partitions of about UNITS_PER_TASK units, since a
    unit grows to a row per month afterwards and Spark would gather the small
    rows into few tasks by their size. A building of more units is several parts,
    and its months go to each.
    """
    fields = ["Periodo", *[c for c in months.columns if c not in SETTLEMENT_KEY]]
    prices = condominiums.select("Id_Consorcio", "Precio_Cochera", "Precio_Baulera")
    by_building = months.groupBy("Id_Consorcio").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("meses"))
    wanted = units.select(*UNIT_KEY, "Coeficiente", "Cochera", "Baulera")
    if of_units is not None:
        wanted = wanted.join(of_units, UNIT_KEY, "left")
    sizes = units.groupBy("Id_Consorcio").agg(F.count(F.lit(1)).alias("_unidades"))
    pieces = sizes.select("Id_Consorcio", F.ceil(F.col("_unidades") / UNITS_PER_PIECE).cast("int").alias("_partes"))
    piece = F.pmod(F.xxhash64("NroUF"), F.col("_partes")).cast("int").alias("_parte")
    parts = by_building.join(prices, "Id_Consorcio").join(pieces, "Id_Consorcio")
    parts = parts.withColumn("_parte", F.explode(F.sequence(F.lit(0), F.col("_partes") - 1)))
    key, tasks = ["Id_Consorcio", "_parte"], tasks_for(units.count(), UNITS_PER_TASK)
    dealt = wanted.join(pieces, "Id_Consorcio").select(*wanted.columns, piece).repartition(tasks, *key)
    met = dealt.join(parts.repartition(tasks, *key), key)

    def extra(feature: str, price: str) -> Column:
        return F.when(F.col(feature), F.col(price)).otherwise(F.lit(ZERO))

    # Worked out before a unit grows to a row per month; a product instead of a division by 100 is as exact.
    rate = F.col("Coeficiente") * F.lit(Decimal("0.01"))
    fixed = extra("Cochera", "Precio_Cochera") + extra("Baulera", "Precio_Baulera")
    others = [] if of_units is None else [c for c in of_units.columns if c not in UNIT_KEY]
    return met.select(*UNIT_KEY, "meses", rate.alias("Tasa"), fixed.alias("Fijo"), *others)


def shares_of(month: Column) -> tuple[Column, Column]:
    """Unrounded ordinary and extraordinary share of a unit (`units_with_months`) in a settlement."""

    ordinary = month["Total_Gasto_Ordinarios"] * F.col("Tasa") + F.col("Fijo")
    return ordinary.cast("decimal(24,6)"), (month["Total_Gasto_Extraordinarios"] * F.col("Tasa")).cast("decimal(24,6)")


def unit_shares(
    headers: DataFrame, units: DataFrame, condominiums: DataFrame, of_units: DataFrame | None = None
) -> DataFrame:
    """Unrounded share of every unit in its building's settlements, with the unit's columns of *of_units*, if given."""
    months = headers.select(*SETTLEMENT_KEY, "Total_Gasto_Ordinarios", "Total_Gasto_Extraordinarios")
    spread = units_with_months(months, units, condominiums, of_units).withColumn("mes", F.explode("meses"))
    others = [] if of_units is None else [c for c in of_units.columns if c not in UNIT_KEY]
    ordinary, extraordinary = shares_of(F.col("mes"))
    return spread.select(
        *UNIT_KEY,
        F.col("mes.Periodo").alias("Periodo"),
        ordinary.alias("Ordinario"),
        extraordinary.alias("Extraordinario"),
        *others,
    )


def prorate_bills(
    headers: DataFrame, units: DataFrame, condominiums: DataFrame, previous: DataFrame
) -> DataFrame:
    """Bill of every unit for every given settlement.

    The balance of the bill one month earlier in *previous* is carried over
    with interest, also when it is a credit. The total is rounded once, from
    the unrounded parts, so it may differ by a cent from the sum of the parts.
    """
    return bills_of_shares(unit_shares(headers, units, condominiums), previous)


def bills_of_shares(shares: DataFrame, previous: DataFrame | None, paid: Column | None = None) -> DataFrame:
    """The bills of `prorate_bills` from the units' unrounded *shares*.

    Without *previous* nothing is carried over, and nothing shuffled; *paid* is
    what a bill has received, by default nothing.
    """
    rest = F.lit(ZERO).cast(MONEY)
    if previous is not None:
        carried = previous.select(
            *UNIT_KEY,
            F.add_months("Periodo", 1).alias("Periodo"),
            (F.col("Total_A_Pagar") - F.col("Pagos_Recibidos_Mes")).alias("Resto"),
        )
        shares = shares.join(carried, [*UNIT_KEY, "Periodo"], "left")
        rest = F.coalesce(F.col("Resto"), F.lit(ZERO)).cast(MONEY)
    interest = rest * F.lit(MONTHLY_INTEREST)
    return shares.select(
        *UNIT_KEY,
        "Periodo",
        rest.alias("Saldo_Anterior"),
        money(F.lit(ZERO) if paid is None else paid).alias("Pagos_Recibidos_Mes"),
        rest.alias("Deuda"),
        money(interest).alias("Interes_Por_Mora"),
        money(F.col("Ordinario")).alias("Importe_Ordinario_Prorrateado"),
        money(F.col("Extraordinario")).alias("Importe_Extraordinario_Prorrateado"),
        money(rest + interest + F.col("Ordinario") + F.col("Extraordinario")).alias("Total_A_Pagar"),
    ).select(BILL.columns)


def replace_bills(bills: DataFrame, generated: DataFrame) -> DataFrame:
    """Bill table after (re)generation: all bills of a regenerated settlement are replaced."""
    settled = generated.select(*SETTLEMENT_KEY).distinct()
    return bills.join(settled, SETTLEMENT_KEY, "left_anti").select(BILL.columns).unionByName(generated)


def recalculate_balances(bills: DataFrame) -> DataFrame:
    """Carry balances through the months of every unit.

    The clamp at zero and the rounding of each step make this a recurrence, so
    the months of a unit are worked in order (see `balances`); the units of a
    batch take each month together. The first month stays as it is; interest is
    due on positive balances only. One shuffle by unit, linear in the months.
    """
    cents = {
        "carried": "Saldo_Anterior", "paid": "Pagos_Recibidos_Mes", "debt": "Deuda", "interest": "Interes_Por_Mora",
        "total": "Total_A_Pagar", "ordinary": _ORDINARY, "extraordinary": _EXTRAORDINARY,
    }
    rows = bills.select(*UNIT_KEY, "Periodo", *[to_cents(F.col(c)).alias(n) for n, c in cents.items()])
    # Numbering the rows makes Spark gather and sort them by unit and month.
    place = F.row_number().over(W.partitionBy(*UNIT_KEY).orderBy("Periodo"))
    in_order = rows.withColumn("_place", place)
    amounts = ", ".join(f"{n} bigint" for n in cents)
    schema = f"Id_Consorcio int, NroUF string, Periodo date, {amounts}, _place int"
    done = in_order.mapInArrow(balances.recalculated, schema)
    made = [from_cents(F.col(n)).alias(c) for n, c in cents.items()]
    return done.select(*UNIT_KEY, "Periodo", *made).select(BILL.columns)
