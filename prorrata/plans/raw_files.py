"""Incoming files in their raw text form, written out of the generated tables.

They carry the faults the imports have to cope with: missing and malformed
values, repeated rows, unknown references, title rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prorrata.functions.dates import MONTH_NAMES
from prorrata.functions.money import money
from prorrata.operators.imports import EXPENSE_COLUMNS
from prorrata.plans.adapter import Domain, account_of
from prorrata.seeds import TENANT
from prorrata.sources.workarea import new_folder, work_area

# What earlier files brought: everything but one market segment, and payments before a day.
NEW_SEGMENT, NEW_DEPARTMENT = "MACHINERY", "MACHI"
LOADED_BEFORE = dt.date(1998, 1, 1)


def _every(key: Column, step: int, value: Column, otherwise: Column) -> Column:
    return F.when(key % step == 0, value).otherwise(otherwise)


def _null() -> Column:
    return F.lit(None).cast("string")


def delimited_file(lines: DataFrame, name: str, separator: str) -> str:
    """Path of *lines* as text in the work area: a header, no quoting, empty for NULL, white space kept."""
    path = f"{work_area(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = lines.write.option("sep", separator).option("header", True).option("quote", "").option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def json_file(documents: DataFrame, name: str) -> str:
    """Path of *documents* in the work area, one object per line."""
    path = f"{work_area(documents.sparkSession)}/{name}-{uuid.uuid4().hex}"
    documents.write.json(path)
    return path


def _framed_text(lines: DataFrame, name: str, first: str, last: str | None = None) -> str:
    """Path of text files of *lines* (value); every file has its first and, if given, its last line."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in ([first], *(b.column("value").to_pylist() for b in batches), [] if last is None else [last]):
            yield pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], names=["value"])

    path = new_folder(lines.sparkSession, name)
    lines.mapInArrow(framed, "value string").write.text(path)
    return path


def json_array_files(documents: DataFrame, name: str) -> str:
    """Path of *documents* in the work area, one array per file. Every document ends with a comma and an empty one closes the array."""
    return _framed_text(documents.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value")), name, "[", "{}]")


def faulty_unit_file(d: Domain) -> str:
    """The lines of `unit_lines` as a file; some lack their last field, some have one more."""
    key = F.col("c_custkey")
    lines = unit_lines(d, "c_custkey")
    fields = [c for c in lines.columns if c != "c_custkey"]
    texts = [F.coalesce(c, F.lit("")) for c in fields]
    last = _every(key, 29, F.lit(""), F.concat(F.lit("\t"), texts[-1], _every(key, 31, F.lit("\textra"), F.lit(""))))
    line = F.concat(F.concat_ws("\t", *texts[:-1]), last)
    return _framed_text(lines.select(line.alias("value")), "faulty-units", "\t".join(fields))


def condominium_sheet(d: Domain) -> DataFrame:
    """One building per customer."""
    key = F.col("c_custkey")
    number = F.concat(F.lit("Consorcio "), key.cast("string"))
    return d.table("customer").select(
        _every(key, 17, _null(), _every(key, 13, F.lit("Consorcio X"), number)).alias("Consorcio"),
        F.lower("c_name").alias("Nombre del consorcio"),
        _every(key, 3, F.lit(""), _every(key, 5, _null(), F.lit("Calle 1"))).alias("Domicilio"),
        F.when(key % 4 != 0, (key % 50).cast("int")).alias("Cant unidades funcionales"),
        F.when(key % 7 == 0, -5).when(key % 11 != 0, (key % 1000).cast("int")).alias("M2 totales"),
    )


def existing_condominiums(d: Domain) -> DataFrame:
    """Buildings loaded before: those of all market segments but one."""
    key = F.col("c_custkey")
    return d.table("customer").filter(F.col("c_mktsegment") != NEW_SEGMENT).select(
        key.cast("int").alias("Id_Consorcio"),
        F.lit(9).alias("Id_Administracion"),
        F.lit("OLD").alias("Nombre"),
        F.lit("OLD").alias("Domicilio"),
        F.lit(1).cast("smallint").alias("Cant_unidades"),
        F.lit(1).alias("MetrosCuadrados"),
        money(F.lit(5)).alias("Precio_Cochera"),
        money(F.lit(5)).alias("Precio_Baulera"),
    )


def unit_lines(d: Domain, *more: str) -> DataFrame:
    key = F.col("c_custkey")
    hundredths = (key % 900 + 1).cast("int")
    coefficient = F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit(","), F.lpad((hundredths % 100).cast("string"), 2, "0")
    )
    name = F.concat(F.lit(" nation_"), F.col("c_nationkey").cast("string"), F.lit(" "))
    return d.table("customer").select(
        _every(key, 19, _null(), _every(key, 17, F.lit("Nowhere"), name)).alias("consorcio"),
        F.concat(F.lit(" "), key.cast("string"), F.lit(" ")).alias("uf"),
        (key % 10).cast("string").alias("piso"),
        F.left("c_mktsegment", F.lit(5)).alias("depto"),
        _every(key, 23, F.lit("abc"), coefficient).alias("coeficiente"),
        F.concat((key % 90 + 30).cast("string"), F.lit(".9")).alias("m2"),
        _every(key, 3, F.lit("si "), _every(key, 5, _null(), F.lit("NO"))).alias("baulera"),
        _every(key, 2, F.lit("SI"), F.lit("no")).alias("cochera"),
        (key % 300).cast("string").alias("m2_baulera"),
        (key % 20).cast("string").alias("m2_cochera"),
        *more,
    )


def person_lines(d: Domain) -> DataFrame:
    """One line per order: most people appear many times, in the order of the orders."""
    order = F.col("o_orderkey")
    customers = d.table("customer").select("c_custkey", "c_name")
    document = F.concat(F.lit(" "), (F.col("c_custkey") + 10_000_000).cast("string"))
    return (
        d.table("orders")
        .select("o_orderkey", "o_custkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit(" n"), F.col("c_custkey").cast("string")).alias("nombre"),
            F.lower("c_name").alias("apellido"),
            _every(order, 11, F.lit("A12"), _every(order, 13, F.lit(" "), document)).alias("dni"),
            F.concat(F.lit("User "), F.col("c_custkey").cast("string"), F.lit("@Example.COM")).alias("email"),
            order.cast("string").alias("telefono"),
            account_of(F.col("c_custkey")).alias("cbu"),
            _every(F.col("c_custkey"), 4, F.lit("1"), F.lit("0")).alias("inquilino"),
            order.alias("ordinal"),
        )
    )


def existing_persons(d: Domain) -> DataFrame:
    return d.persons.filter(F.col("Nombre") != NEW_DEPARTMENT)


def link_lines(d: Domain) -> DataFrame:
    """One line per order, so every link is repeated."""
    customers = d.table("customer").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    return (
        d.table("orders")
        .select("o_custkey")
        .join(customers, F.col("o_custkey") == key)
        .select(
            _every(key, 7, F.lit("unknown"), F.concat(account_of(key), F.lit(" "))).alias("cbu"),
            F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")).alias("consorcio"),
            _every(key, 11, F.lit("ZZZ"), key.cast("string")).alias("uf"),
            F.lit("1").alias("piso"),
            F.lit("A").alias("depto"),
        )
    )


def existing_links(d: Domain) -> DataFrame:
    """Tenants were linked before, owners are new."""
    return d.links.filter(F.col("Id_TipoRelacion") == TENANT)


def payment_lines(d: Domain) -> DataFrame:
    order = F.col("o_orderkey")
    amount = F.concat(F.lit("$ "), F.translate(money(F.col("o_totalprice")).cast("string"), ".", ","))
    return d.table("orders").select(
        order.cast("string").alias("id"),
        _every(order, 9, F.lit("31/02/2025"), F.date_format("o_orderdate", "d/M/yyyy")).alias("fecha"),
        _every(order, 8, F.lit("elsewhere"), F.concat(F.lit(" "), account_of(F.col("o_custkey")))).alias("cuenta"),
        _every(order, 21, _null(), amount).alias("importe"),
    )


def existing_payments(d: Domain) -> DataFrame:
    """Payments of earlier files: the new one repeats them and goes on."""
    return d.payments.filter(F.col("Fecha") < F.lit(LOADED_BEFORE))


def supplier_sheet(d: Domain) -> DataFrame:
    key = F.col("s_suppkey")
    return d.table("supplier").select(
        _every(key, 9, F.lit("Tipo gasto"), F.concat(F.lit(" Tipo "), (key % 5).cast("string"))).alias("F1"),
        F.concat(F.col("s_name"), F.lit(" ")).alias("F2"),
        key.cast("string").alias("F3"),
        _every(
            key, 7, F.lit("Nombre del consorcio"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))
        ).alias("F4"),
    )


def existing_suppliers(d: Domain) -> DataFrame:
    key = F.col("s_suppkey")
    return d.table("supplier").filter(F.col("s_acctbal") > 5000).select(
        (key + 1).alias("Id_Proveedor"),
        F.col("s_nationkey").alias("Id_Consorcio"),
        F.col("s_name").alias("Nombre_Gasto"),
        F.lit("OLD").alias("Descripcion"),
        F.lit("OLD").alias("Cuenta"),
    )


def expense_documents(d: Domain) -> DataFrame:
    """Per building and month name, the expenses of all years, in either way of writing amounts."""
    column = F.element_at(F.array(*[F.lit(c) for c in EXPENSE_COLUMNS]), F.col("l_linenumber"))
    month = F.month("Fecha")
    cells = (
        d.expenses.groupBy("Id_Consorcio", month.alias("month"))
        .pivot("l_linenumber", list(range(1, len(EXPENSE_COLUMNS) + 1)))
        .agg(F.sum(money(F.col("l_extendedprice"))))
    )
    names = F.array(*[F.lit(n.capitalize() + " ") for n in MONTH_NAMES])

    def written_amount(value: Column) -> Column:
        english = F.format_number(value, 2)
        return F.when(F.col("month") % 2 == 0, english).otherwise(F.translate(english, ",.", ".,"))

    return cells.select(
        F.concat(F.lit("NATION_"), F.col("Id_Consorcio").cast("string")).alias("Nombre del consorcio"),
        F.when(F.col("month") == 12, F.lit("Brumario")).otherwise(F.element_at(names, F.col("month"))).alias("Mes"),
        *[written_amount(F.col(str(i))).alias(c) for i, c in enumerate(EXPENSE_COLUMNS, 1)],
    )


def existing_expenses(d: Domain) -> DataFrame:
    """January's bank charges of every building that has expenses, to be updated."""
    return d.expenses.groupBy("Id_Consorcio").agg(F.count(F.lit(1)).alias("n")).select(
        (F.col("Id_Consorcio") + 1).cast("bigint").alias("Id_gasto"),
        "Id_Consorcio",
        F.lit(1).alias("Id_Tipo_Gasto"),
        F.make_date(F.lit(2025), F.lit(1), F.lit(1)).alias("Fecha"),
        money(F.col("n")).alias("Importe_Total"),
        F.lit("BANCARIOS").alias("Descripcion"),
    )


def unit_changes(d: Domain) -> DataFrame:
    """Two changes per customer, valid and invalid ones mixed."""
    key = F.col("c_custkey")
    copy = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    base = d.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", copy)
    first = F.col("copy") == 0
    return base.select(
        (key * 2 + F.col("copy")).alias("ordinal"),
        F.col("c_nationkey").alias("Id_Consorcio"),
        F.when(key % 31 == 0, F.lit("none")).otherwise(key.cast("string")).alias("NroUF"),
        F.when(key % 29 == 0, F.lit(" ")).when(first, F.concat(F.lit("N"), (key % 40).cast("string")))
        .otherwise((key % 10).cast("string")).alias("Piso"),
        F.when(key % 23 == 0, _null()).when(first, F.lit(" D1")).otherwise(F.left("c_mktsegment", F.lit(5)))
        .alias("Departamento"),
        F.when(key % 19 == 0, F.lit(0)).when(key % 17 != 0, F.lit(2)).cast("decimal(5,2)").alias("Coeficiente"),
        F.when(key % 13 == 0, F.lit(-1)).otherwise(key % 90 + 1).cast("smallint").alias("M2_UF"),
        F.when(key % 3 != 0, key % 2 == 0).alias("Baulera"),
        (key % 2 == 0).alias("Cochera"),
        F.lit(1).cast("smallint").alias("M2_Baulera"),
        F.lit(None).cast("smallint").alias("M2_Cochera"),
    )
