"""The accounting tables, derived from nations, customers, orders and line items.

A nation plays the building, a customer the unit and the person living in it,
an order a bank payment and a line item an expense of the supplier's nation.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prorrata.functions.dates import month_start
from prorrata.functions.money import PERCENT, ZERO, money
from prorrata.operators.billing import bills_of_shares, settlement_headers, unit_shares
from prorrata.schemas import BILL_KEY, UNIT_KEY
from prorrata.seeds import BANK_TRANSFER, ON_TIME, OWNER, TENANT

# When the derived settlements are issued, and when people moved in.
EMISSION = dt.date(2002, 1, 15)
MOVED_IN = dt.date(1995, 1, 1)


def account_of(customer_key: Column) -> Column:
    return F.lpad(customer_key.cast("string"), 22, "0")


class Domain:
    """Lazy frames over one folder of generated tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def span(self) -> tuple[dt.date, dt.date]:
        """First and last day on which anything was spent or paid (a month of nothing if there is neither)."""
        days = [self.table("lineitem").select(F.col("l_shipdate").alias("day")), self.table("orders").select(F.col("o_orderdate").alias("day"))]
        ends = [d.agg(F.min("day").alias("first"), F.max("day").alias("last")) for d in days]
        row = ends[0].unionByName(ends[1]).agg(F.min("first").cast("date"), F.max("last").cast("date")).first()
        return (row[0], row[1]) if row[0] is not None else (EMISSION.replace(day=1), EMISSION)

    @property
    def months(self) -> tuple[dt.date, dt.date]:
        """First days of the first and the last month of the span."""
        return self.span[0].replace(day=1), self.span[1].replace(day=1)

    @cached_property
    def condominiums(self) -> DataFrame:
        price = F.lit(Decimal("1000.00"))
        return self.table("nation").select(
            F.col("n_nationkey").alias("Id_Consorcio"),
            F.lit(1).alias("Id_Administracion"),
            F.upper("n_name").alias("Nombre"),
            F.concat(F.lit("CALLE "), F.col("n_nationkey").cast("string")).alias("Domicilio"),
            F.lit(0).cast("smallint").alias("Cant_unidades"),
            F.lit(None).cast("int").alias("MetrosCuadrados"),
            money(price).alias("Precio_Cochera"),
            money(price).alias("Precio_Baulera"),
        )

    @cached_property
    def units(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        sizes = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("unidades"))
        key = F.col("c_custkey")
        return customers.join(sizes, "c_nationkey").select(
            F.col("c_nationkey").alias("Id_Consorcio"),
            key.cast("string").alias("NroUF"),
            (key % 10).cast("string").alias("Piso"),
            F.left("c_mktsegment", F.lit(5)).alias("Departamento"),
            (F.lit(100).cast("decimal(5,2)") / F.col("unidades").cast("decimal(10,0)")).cast(PERCENT).alias("Coeficiente"),
            (key % 90 + 30).cast("smallint").alias("M2_UF"),
            (key % 3 == 0).alias("Baulera"),
            (key % 2 == 0).alias("Cochera"),
            (key % 3).cast("smallint").alias("M2_Baulera"),
            (key % 2).cast("smallint").alias("M2_Cochera"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("Id_Persona"),
            (key + 10_000_000).cast("string").alias("DNI"),
            F.upper(F.left("c_mktsegment", F.lit(5))).alias("Nombre"),
            F.upper("c_name").alias("Apellido"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("Email"),
            F.concat(F.lit("11-"), F.lpad(key.cast("string"), 8, "0")).alias("Telefono"),
            (key % 4 == 0).alias("inquilino"),
            account_of(key).alias("Cbu_Cvu"),
        )

    @cached_property
    def links(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("ID_U_P"),
            F.col("c_nationkey").alias("Id_Consorcio"),
            key.cast("string").alias("NroUF"),
            key.alias("Id_Persona"),
            F.when(key % 4 == 0, TENANT).otherwise(OWNER).alias("Id_TipoRelacion"),
            F.lit(MOVED_IN).alias("Fecha_Inicio"),
            F.lit(None).cast("date").alias("Fecha_Fin"),
        )

    @cached_property
    def second_links(self) -> DataFrame:
        """Every person also has an open link to the next customer's unit."""
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .filter(key > 0)
            .select(
                (key + 1_000_000_000_000).alias("ID_U_P"),
                F.col("c_nationkey").alias("Id_Consorcio"),
                key.cast("string").alias("NroUF"),
                (key - 1).alias("Id_Persona"),
                F.lit(OWNER).alias("Id_TipoRelacion"),
                F.lit(MOVED_IN).alias("Fecha_Inicio"),
                F.lit(None).cast("date").alias("Fecha_Fin"),
            )
        )

    @cached_property
    def holidays(self) -> DataFrame:
        """Payment days that fall on a fixed-date holiday."""
        day = F.col("o_orderdate").cast("date").alias("fecha")
        fixed = F.date_format("o_orderdate", "MM-dd").isin("01-01", "05-01", "05-25", "07-09", "12-08", "12-25")
        return self.table("orders").filter(fixed).select(day).distinct()

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("Id_Pago"),
            F.lit(BANK_TRANSFER).alias("Id_Forma_De_Pago"),
            F.col("o_orderdate").cast("date").alias("Fecha"),
            account_of(F.col("o_custkey")).alias("Cuenta_Origen"),
            money(F.col("o_totalprice")).alias("Importe"),
            F.lit(True).alias("Es_Pago_Asociado"),
            F.lit(False).alias("Procesado"),
        )

    @cached_property
    def expenses(self) -> DataFrame:
        items = self.table("lineitem").select(
            "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.col("l_shipdate").cast("date").alias("Fecha")
        )
        suppliers = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("Id_Consorcio"))
        return items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)

    @cached_property
    def ordinary(self) -> DataFrame:
        return self.expenses.filter(F.col("l_returnflag") != "R").select(
            "Id_Consorcio",
            (F.col("l_linenumber") % 6 + 1).alias("Id_Tipo_Gasto"),
            "Fecha",
            money(F.col("l_extendedprice")).alias("Importe_Total"),
        )

    @cached_property
    def extraordinary(self) -> DataFrame:
        return self.expenses.filter(F.col("l_returnflag") == "R").select(
            "Id_Consorcio",
            (F.col("l_linenumber") % 3 + 1).alias("Id_tipo_pago"),
            "Fecha",
            money(F.col("l_extendedprice")).alias("Importe"),
        )

    @cached_property
    def headers(self) -> DataFrame:
        """Settlements of all buildings for every month of the span."""
        return settlement_headers(
            self.condominiums, self.ordinary, self.extraordinary, *self.months, as_of=EMISSION
        )

    @cached_property
    def details(self) -> DataFrame:
        """Applied money: each payment goes whole to its own month's bill."""
        owners = self.links.join(self.persons.select("Id_Persona", "Cbu_Cvu"), "Id_Persona").select(
            F.col("Cbu_Cvu").alias("Cuenta_Origen"), *UNIT_KEY
        )
        return self.payments.join(owners, "Cuenta_Origen").select(
            "Id_Pago",
            F.lit(1).alias("Secuencia"),
            *UNIT_KEY,
            month_start(F.col("Fecha")).alias("Periodo"),
            F.lit(ON_TIME).alias("Id_Tipo_Ingreso"),
            F.col("Importe").alias("Importe_Usado"),
        )

    @cached_property
    def shares(self) -> DataFrame:
        """What every unit owes of every settlement, before rounding."""
        return unit_shares(self.headers, self.units, self.condominiums)

    @cached_property
    def unpaid_bills(self) -> DataFrame:
        """One bill per unit and month: the month's share alone, nothing carried, nothing paid."""
        return bills_of_shares(self.shares, None)

    @cached_property
    def bills(self) -> DataFrame:
        """The same bills with the applied money of `details` as their payments.

        The sums by bill go with the unit, as one value, before it grows to a row
        per month; so bills need no shuffle.
        """
        paid = self.details.groupBy(*BILL_KEY).agg(money(F.sum("Importe_Usado")).alias("Pagado"))
        by_month = F.map_from_entries(F.collect_list(F.struct("Periodo", "Pagado"))).alias("Pagos")
        of_units = paid.filter(F.col("Periodo").isNotNull()).groupBy(*UNIT_KEY).agg(by_month)
        shares = unit_shares(self.headers, self.units, self.condominiums, of_units)
        received = F.coalesce(F.try_element_at("Pagos", F.col("Periodo")), F.lit(ZERO))
        return bills_of_shares(shares, None, received)
