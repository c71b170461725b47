"""Registered queries: every operator over the whole generated tables."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from prorrata import schemas as S
from prorrata.functions.money import money
from prorrata.operators import allocation as A, billing as B, imports as I, privacy as P, reports as R
from prorrata.operators.books import post_payments, publish, store_books, stored_bills
from prorrata.operators.checks import check_tables
from prorrata.operators.cycle import Books, close_months
from prorrata.operators.unit_changes import change_units
from prorrata.operators.upsert import upsert
from prorrata.operators.workdays import business_days
from prorrata.plans import raw_files as raw
from prorrata.plans.adapter import EMISSION, Domain, account_of
from prorrata.schemas import BILL, PAYMENT_DETAIL, SETTLEMENT
from prorrata.seeds import seed_table
from prorrata.sources import files
from prorrata.sources.buckets import bucket_count, store_buckets
from prorrata.sources.files import top_months_xml, write_xml, xml_row
from prorrata.sources.tables import read_table, replace_settlements, upsert_months, write_table
from prorrata.sources.workarea import new_folder, tasks_for, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Domain(spark, folder))
    return build


TODAY = dt.date(2025, 6, 17)

# Pepper of the generated data only; the key is new in every run.
SAMPLE_PEPPER = "generated-data"


def _keys() -> P.Keys:
    return P.Keys(os.urandom(32), SAMPLE_PEPPER)


@_query
def o01_import_condominiums(d: Domain) -> DataFrame:
    administrations = seed_table(d.spark, S.ADMINISTRATION)
    return I.import_condominiums(raw.condominium_sheet(d), administrations, raw.existing_condominiums(d), 1).table


@_query
def o02_import_units(d: Domain) -> DataFrame:
    old = d.units.filter(F.col("Departamento") != raw.NEW_DEPARTMENT).withColumn("Piso", F.lit("OLD"))
    return I.import_units(raw.unit_lines(d), d.condominiums, old).table


@_query
def o02_rejected_units(d: Domain) -> DataFrame:
    rejects = I.import_units(raw.unit_lines(d), d.condominiums, d.units).rejects
    return rejects.select("uf", "reason")


@_query
def o03_import_persons(d: Domain) -> DataFrame:
    return I.import_persons(raw.person_lines(d), raw.existing_persons(d)).table


@_query
def o04_import_links(d: Domain) -> DataFrame:
    return I.import_links(
        raw.link_lines(d), d.condominiums, d.units, d.persons, raw.existing_links(d), TODAY
    ).table


@_query
def o05_import_payments(d: Domain) -> DataFrame:
    return I.import_payments(raw.payment_lines(d), d.persons, d.links, raw.existing_payments(d)).table


@_query
def o06_import_suppliers(d: Domain) -> DataFrame:
    return I.import_suppliers(raw.supplier_sheet(d), d.condominiums, raw.existing_suppliers(d)).table


@_query
def o07_import_expenses(d: Domain) -> DataFrame:
    types = seed_table(d.spark, S.ORDINARY_TYPE)
    return I.import_expenses(raw.expense_documents(d), d.condominiums, types, raw.existing_expenses(d), 2025).table


@_query
def o01_rejected_condominiums(d: Domain) -> DataFrame:
    administrations = seed_table(d.spark, S.ADMINISTRATION)
    done = I.import_condominiums(raw.condominium_sheet(d), administrations, raw.existing_condominiums(d), 1)
    return done.rejects.select("Nombre del consorcio", "reason")


@_query
def o03_rejected_persons(d: Domain) -> DataFrame:
    return I.stage_persons(raw.person_lines(d), "ordinal")[1].select("Telefono", "reason")


@_query
def o04_rejected_links(d: Domain) -> DataFrame:
    done = I.import_links(raw.link_lines(d), d.condominiums, d.units, d.persons, raw.existing_links(d), TODAY)
    return done.rejects.select("account", "NroUF", "consorcio", "reason")


@_query
def o05_rejected_payments(d: Domain) -> DataFrame:
    return I.stage_payments(raw.payment_lines(d))[1].select("id", "reason")


@_query
def o06_rejected_suppliers(d: Domain) -> DataFrame:
    done = I.import_suppliers(raw.supplier_sheet(d), d.condominiums, raw.existing_suppliers(d))
    return done.rejects.select("F3", "reason")


@_query
def o07_rejected_expenses(d: Domain) -> DataFrame:
    types = seed_table(d.spark, S.ORDINARY_TYPE)
    done = I.import_expenses(raw.expense_documents(d), d.condominiums, types, raw.existing_expenses(d), 2025)
    return done.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("filas"))


@_query
def o02_import_units_file(d: Domain) -> DataFrame:
    """From a file of tab-separated lines, as the following ones from theirs."""
    old = d.units.filter(F.col("Departamento") != raw.NEW_DEPARTMENT).withColumn("Piso", F.lit("OLD"))
    path = raw.delimited_file(raw.unit_lines(d), "units", "\t")
    return I.import_units(files.read_units(d.spark, path), d.condominiums, old).table


@_query
def o03_import_persons_file(d: Domain) -> DataFrame:
    lines = raw.person_lines(d).orderBy("ordinal").drop("ordinal")
    path = raw.delimited_file(lines, "persons", ";")
    return I.import_persons(files.read_persons(d.spark, path), raw.existing_persons(d)).table


@_query
def o04_import_links_file(d: Domain) -> DataFrame:
    lines = files.read_links(d.spark, raw.delimited_file(raw.link_lines(d), "links", "|"))
    return I.import_links(lines, d.condominiums, d.units, d.persons, raw.existing_links(d), TODAY).table


@_query
def o05_import_payments_file(d: Domain) -> DataFrame:
    """The separator is a comma, so amounts have a point."""
    lines = raw.payment_lines(d).withColumn("importe", F.translate("importe", ",", "."))
    path = raw.delimited_file(lines, "payments", ",")
    return I.import_payments(files.read_payments(d.spark, path), d.persons, d.links, raw.existing_payments(d)).table


@_query
def o07_import_expenses_file(d: Domain) -> DataFrame:
    types = seed_table(d.spark, S.ORDINARY_TYPE)
    documents = files.read_expenses(d.spark, raw.json_file(raw.expense_documents(d), "expenses"), lines=True)
    return I.import_expenses(documents, d.condominiums, types, raw.existing_expenses(d), 2025).table


@_query
def o07_import_expenses_array(d: Domain) -> DataFrame:
    """From files that hold a JSON array each, cut across tasks."""
    types = seed_table(d.spark, S.ORDINARY_TYPE)
    documents = files.read_expenses(d.spark, raw.json_array_files(raw.expense_documents(d), "expenses"))
    return I.import_expenses(documents, d.condominiums, types, raw.existing_expenses(d), 2025).table


@_query
def o02_malformed_lines(d: Domain) -> DataFrame:
    return files.malformed_lines(d.spark, raw.faulty_unit_file(d), "units").select("linea", "reason")


@_query
def o08_upsert_month(d: Domain) -> DataFrame:
    """Bills stored by month; the last month's are updated with their payments, the other files stay."""
    path = new_folder(d.spark, "stored-bills")
    write_table(d.unpaid_bills, BILL, path)
    upsert_months(d.spark, BILL, path, d.bills.filter(F.col("Periodo") == F.lit(d.months[1])), S.BILL_KEY)
    return read_table(d.spark, BILL, path)


@_query
def o10_replace_settlements(d: Domain) -> DataFrame:
    """Bills stored by month; the last month's settlements are generated again from the balances of the month before."""
    path = new_folder(d.spark, "stored-bills")
    write_table(d.unpaid_bills, BILL, path)
    last = F.col("Periodo") == F.lit(d.months[1])
    replace_settlements(d.spark, BILL, path, B.bills_of_shares(d.shares.filter(last), previous=d.bills))
    return read_table(d.spark, BILL, path)


@_query
def o08_keyed_upsert(d: Domain) -> DataFrame:
    """Payments of the earlier years, corrected and continued by those of the later ones."""
    later = d.payments.filter(F.col("Fecha") >= F.lit(dt.date(1997, 1, 1)))
    source = later.withColumn("Importe", money(F.col("Importe") * 2)).drop("Procesado")
    target = d.payments.filter(F.col("Fecha") < F.lit(dt.date(1999, 1, 1)))
    return upsert(target, source, ["Id_Pago"], S.PAYMENT.name)


@_query
def o09_settlement_headers(d: Domain) -> DataFrame:
    return d.headers


@_query
def o10_prorate_bills(d: Domain) -> DataFrame:
    d.headers = written(d.headers, "headers")  # read for the earlier bills and for the new ones
    return B.bills_of_shares(d.shares, previous=d.bills)


@_query
def o11_recalculate_balances(d: Domain) -> DataFrame:
    return B.recalculate_balances(d.bills)


@_query
def o12_resolve_payments(d: Domain) -> DataFrame:
    accounts = A.units_of_accounts(d.persons, d.links.unionByName(d.second_links))
    return A.resolve_payments(d.payments, accounts, d.span[1])


@_query
def o13_allocate_payments(d: Domain) -> DataFrame:
    return A.allocate_payments(d.unpaid_bills, d.payments, d.persons, d.links, d.span[1]).details


@_query
def o13_hot_account(d: Domain) -> DataFrame:
    """A third of all payments come from one account."""
    hot = F.when(F.col("Id_Pago") % 3 == 0, account_of(F.lit(5))).otherwise(F.col("Cuenta_Origen"))
    payments = d.payments.withColumn("Cuenta_Origen", hot)
    return A.allocate_payments(d.unpaid_bills, payments, d.persons, d.links, d.span[1]).details


@_query
def o13_allocated_bills(d: Domain) -> DataFrame:
    return A.allocate_payments(d.unpaid_bills, d.payments, d.persons, d.links, d.span[1]).bills


@_query
def o13_post_in_two_runs(d: Domain) -> DataFrame:
    """Stored books: all payments but those of the last week, then these, which touch few units."""
    path = new_folder(d.spark, "books")
    store_books(d.unpaid_bills, path)
    accounts, last = A.units_of_accounts(d.persons, d.links), d.span[1]
    week = F.col("Fecha") > F.lit(last - dt.timedelta(days=7))
    for payments in (d.payments.filter(~week), d.payments.filter(week)):
        publish(d.spark, path, post_payments(d.spark, path, A.resolve_payments(payments, accounts, last)))
    return stored_bills(d.spark, path)


def _closed_books(d: Domain, books: Books | None = None, last: dt.date | None = None) -> Books:
    """All months closed, up to *last*; empty *books* at first."""

    def empty(table):
        return d.spark.createDataFrame([], table.schema)

    if books is None:
        books = Books(empty(SETTLEMENT), empty(BILL), d.payments, empty(PAYMENT_DETAIL))
    today = d.condominiums.select(F.lit(EMISSION).alias("Fecha")).distinct()
    return close_months(
        books, d.condominiums, d.units, d.persons, d.links, d.ordinary, d.extraordinary,
        business_days(today, d.holidays), d.months[0], last or d.months[1], EMISSION,
    )


@_query
def o14_close_months(d: Domain) -> DataFrame:
    return _closed_books(d).bills


@_query
def o14_close_months_details(d: Domain) -> DataFrame:
    return _closed_books(d).details


@_query
def o14_continue_closing(d: Domain) -> DataFrame:
    """Closed up to the middle of the span, then all months again: the settled ones stay."""
    first, last = d.months
    middle = (first + (last - first) / 2).replace(day=1)
    return _closed_books(d, _closed_books(d, last=middle)).bills


@_query
def o15_weekly_collection(d: Domain) -> DataFrame:
    return R.weekly_collection(d.payments, d.details, d.bills, *d.span)


@_query
def o15_weekly_of_a_building(d: Domain) -> DataFrame:
    return R.weekly_collection(d.payments, d.details, d.bills, *d.span, condominium=7)


@_query
def o16_monthly_by_department(d: Domain) -> DataFrame:
    return R.monthly_by_department(d.payments, d.details, d.units, *d.span)


@_query
def o17_collection_by_origin(d: Domain) -> DataFrame:
    return R.collection_by_origin(d.payments, d.details, d.bills, *d.span)


@_query
def o18_top_months(d: Domain) -> DataFrame:
    columns = ["Seccion", "Id_Consorcio", "Anio", "Mes", "Total", "TiposIncluidos", "Puesto"]
    spent = R.top_expense_months(d.ordinary, d.extraordinary).select(
        F.lit("TopGastos").alias("Seccion"), "*", F.col("TotalGasto").alias("Total")
    )
    earned = R.top_income_months(d.payments, d.details).select(
        F.lit("TopIngresos").alias("Seccion"),
        "*",
        F.col("TotalIngreso").alias("Total"),
        F.lit(None).cast("string").alias("TiposIncluidos"),
    )
    return spent.select(columns).unionByName(earned.select(columns))


@_query
def o18_top_expenses_of_a_year(d: Domain) -> DataFrame:
    """Of one building and year; of the ordinary expenses one type only."""
    return R.top_expense_months(d.ordinary, d.extraordinary, year=1996, condominium=3, expense_type=2)


@_query
def o19_top_debtors_of_a_floor(d: Domain) -> DataFrame:
    return R.top_debtors(d.bills, d.units, d.links, d.persons, year=1997, condominium=3, floor="7")


@_query
def o19_top_debtors(d: Domain) -> DataFrame:
    return R.top_debtors(d.bills, d.units, d.links, d.persons)


@_query
def o19_top_debtors_encrypted(d: Domain) -> DataFrame:
    keys = _keys()
    stored = P.encrypt_persons(P.with_contact_index(d.persons, keys), keys)
    return P.top_encrypted_debtors(d.bills, d.units, d.links, stored, keys)


@_query
def o20_payment_intervals(d: Domain) -> DataFrame:
    return R.payment_intervals(d.payments, d.details, d.bills, *d.span)


def _in_buckets(d: Domain, rows: DataFrame, kind: str, keys: list[str] = S.UNIT_KEY) -> DataFrame:
    """*rows* stored by unit or bill; the following queries read their facts from such tables. Buckets grow in number with the units."""
    buckets = max(bucket_count(d.spark), tasks_for(d.units.count(), A.UNITS_PER_TASK))
    return store_buckets(rows, f"prorrata_{kind}_{uuid.uuid4().hex}", new_folder(d.spark, f"buckets-{kind}"), buckets, keys)


def _collected(d: Domain) -> tuple[DataFrame, None, DataFrame]:
    """Collections, and bills, by bill."""
    applied = _in_buckets(d, R.collections(d.payments, d.details), "collections", S.BILL_KEY)
    return applied, None, _in_buckets(d, d.unpaid_bills, "bills", S.BILL_KEY)


@_query
def o10_prorate_buckets(d: Domain) -> DataFrame:
    """Last balances meet the new shares where both lie."""
    return B.bills_of_shares(_in_buckets(d, d.shares, "shares"), previous=_in_buckets(d, d.bills, "bills"))


@_query
def o11_recalculate_buckets(d: Domain) -> DataFrame:
    return B.recalculate_balances(_in_buckets(d, d.bills, "bills"))


@_query
def o13_allocate_buckets(d: Domain) -> DataFrame:
    return A.allocate_payments(_in_buckets(d, d.unpaid_bills, "bills"), d.payments, d.persons, d.links, d.span[1]).bills


@_query
def o15_weekly_buckets(d: Domain) -> DataFrame:
    return R.weekly_collection(*_collected(d), *d.span)


@_query
def o17_origin_buckets(d: Domain) -> DataFrame:
    return R.collection_by_origin(*_collected(d), *d.span)


@_query
def o19_debtors_buckets(d: Domain) -> DataFrame:
    bills, units = _in_buckets(d, d.bills, "bills"), _in_buckets(d, d.units, "units")
    return R.top_debtors(bills, units, d.links, d.persons)


@_query
def o20_intervals_buckets(d: Domain) -> DataFrame:
    return R.payment_intervals(*_collected(d), *d.span)


@_query
def o22_business_days(d: Domain) -> DataFrame:
    return business_days(d.payments.select("Fecha").distinct(), d.holidays)


@_query
def o21_weekly_xml(d: Domain) -> DataFrame:
    report = R.weekly_collection(d.payments, d.details, d.bills, *d.span)
    columns = [c for c in report.columns if c != "Id_Consorcio"]
    return report.select("Id_Consorcio", "Anio", "Semana", xml_row("Fila", *columns).alias("xml"))


@_query
def o21_weekly_xml_file(d: Domain) -> DataFrame:
    """The weekly report written as XML files and read from them."""
    report = R.weekly_collection(d.payments, d.details, d.bills, *d.span)
    path = new_folder(d.spark, "weekly-xml")
    write_xml(report, path, "Fila", "Reporte")
    return d.spark.read.format("xml").option("rowTag", "Fila").schema(report.schema).load(path)


@_query
def o21_top_months_xml(d: Domain) -> DataFrame:
    return top_months_xml(
        R.top_expense_months(d.ordinary, d.extraordinary), R.top_income_months(d.payments, d.details)
    )


@_query
def o23_encrypt_persons(d: Domain) -> DataFrame:
    """Encrypted and opened again; `cifrado` tells that nothing was stored in the clear."""
    keys = _keys()
    stored = P.encrypt_persons(d.persons, keys)
    hidden = F.coalesce(F.col("DNI").try_cast("string") != F.col("clear"), F.lit(True))
    stored = stored.withColumn("clear", (F.col("Id_Persona") + 10_000_000).cast("string")).withColumn("cifrado", hidden)
    return P.decrypt_persons(stored, keys).drop("clear")


@_query
def o24_match_encrypted_accounts(d: Domain) -> DataFrame:
    keys = _keys()
    persons = P.encrypt_persons(d.persons, keys).select("Id_Persona", P.ACCOUNT_INDEX)
    payments = P.encrypt_payments(d.payments, keys)
    matched = payments.join(persons, F.col(P.PAYMENT_INDEX) == F.col(P.ACCOUNT_INDEX))
    return P.decrypt_payments(matched, keys).select("Id_Pago", "Id_Persona", "Cuenta_Origen")


@_query
def o25_import_encrypted_persons(d: Domain) -> DataFrame:
    keys = _keys()
    target = P.encrypt_persons(raw.existing_persons(d), keys)
    return P.decrypt_persons(P.import_encrypted_persons(raw.person_lines(d), target, keys).table, keys)


@_query
def o26_import_encrypted_links(d: Domain) -> DataFrame:
    keys = _keys()
    persons = P.encrypt_persons(d.persons, keys)
    return P.import_encrypted_links(
        raw.link_lines(d), d.condominiums, d.units, persons, raw.existing_links(d), TODAY, keys
    ).table


@_query
def o27_import_encrypted_payments(d: Domain) -> DataFrame:
    keys = _keys()
    persons = P.encrypt_persons(d.persons, keys)
    target = P.encrypt_payments(raw.existing_payments(d), keys)
    return P.decrypt_payments(
        P.import_encrypted_payments(raw.payment_lines(d), persons, d.links, target, keys).table, keys
    )


@_query
def o28_allocate_encrypted_payments(d: Domain) -> DataFrame:
    keys = _keys()
    return P.allocate_encrypted_payments(
        d.unpaid_bills, P.encrypt_payments(d.payments, keys), P.encrypt_persons(d.persons, keys), d.links, d.span[1]
    ).details


@_query
def o29_change_units(d: Domain) -> DataFrame:
    return change_units(raw.unit_changes(d), d.units).table


@_query
def o29_rejected_changes(d: Domain) -> DataFrame:
    return change_units(raw.unit_changes(d), d.units).rejected.select("ordinal", "reason")


@_query
def o30_integrity_checks(d: Domain) -> DataFrame:
    """The derived tables with faults: repeated ids, lost references, missing accounts, long names."""
    items = d.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Id_gasto"),
        (F.col("l_suppkey") % 30).cast("int").alias("Id_Consorcio"),
        (F.col("l_linenumber") + 1).alias("Id_Tipo_Gasto"),
    )
    number = F.col("Id_Pago")
    payments = d.payments.withColumn("Cuenta_Origen", F.when(number % 17 != 0, F.col("Cuenta_Origen"))).withColumn(
        "Id_Forma_De_Pago", (number % 5).cast("int")
    )
    links = d.links.withColumn("Id_Consorcio", F.when(F.col("ID_U_P") % 11 == 0, 7).otherwise(F.col("Id_Consorcio")))
    names = d.table("customer").select(
        F.col("c_nationkey").alias("Id_Consorcio"), F.col("c_custkey").cast("string").alias("NroUF"),
        F.col("c_mktsegment").alias("Departamento"),
    )
    return check_tables(
        {
            S.CONDOMINIUM.name: d.condominiums,
            S.ORDINARY_TYPE.name: seed_table(d.spark, S.ORDINARY_TYPE),
            S.PAYMENT_METHOD.name: seed_table(d.spark, S.PAYMENT_METHOD),
            S.ORDINARY_EXPENSE.name: items,
            S.PAYMENT.name: payments,
            S.PERSON.name: d.persons,
            S.UNIT.name: names,
            S.UNIT_PERSON.name: links,
        }
    )


@_query
def o30_all_tables(d: Domain) -> DataFrame:
    """All 18 tables that operations write, with faults: lost references and bills, repeated details, long names."""
    seeds = {t.name: seed_table(d.spark, t) for t in (
        S.ADMINISTRATION, S.EXTRAORDINARY_TYPE, S.ORDINARY_TYPE, S.SERVICE_TYPE, S.RELATION_TYPE, S.PAYMENT_METHOD, S.INCOME_TYPE
    )}
    items = d.table("lineitem")
    item_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Id_gasto")
    supplier = (F.col("l_suppkey") % 30).cast("int").alias("Id_Consorcio")
    special = F.col("l_returnflag") == "R"
    payment = F.col("Id_Pago")
    lost_bill = F.when(payment % 97 == 0, F.add_months("Periodo", 1200)).otherwise(F.col("Periodo"))
    found = [
        (S.CONDOMINIUM, d.condominiums),
        (S.SUPPLIER, raw.existing_suppliers(d)),
        (S.UNIT, d.units.withColumn("Departamento", F.concat("Departamento", F.lit("-")))),
        (S.PERSON, d.persons),
        (S.UNIT_PERSON, d.links.withColumn("Id_Persona", F.when(F.col("Id_Persona") % 13 != 0, F.col("Id_Persona")).otherwise(-1))),
        (S.ORDINARY_EXPENSE, items.filter(~special).select(item_id, supplier, (F.col("l_linenumber") % 6 + 1).alias("Id_Tipo_Gasto"))),
        (S.EXTRAORDINARY_EXPENSE, items.filter(special).select(item_id, supplier, F.col("l_linenumber").alias("Id_tipo_pago"))),
        (S.SETTLEMENT, d.headers),
        (S.BILL, d.unpaid_bills),
        (S.PAYMENT, d.payments),
        (S.PAYMENT_DETAIL, d.details.withColumn("Periodo", lost_bill).withColumn("Id_Pago", payment - F.when(payment % 32 == 1, 1).otherwise(0))),
    ]
    whole = {
        t.name: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns])
        for t, df in found
    }
    return check_tables({**seeds, **whole})


@_query
def o31_all_seeds(d: Domain) -> DataFrame:
    """Every seeded row with the number of derived rows that use it."""
    uses = [
        (S.ADMINISTRATION, d.condominiums.select("Id_Administracion")),
        (S.RELATION_TYPE, d.links.select("Id_TipoRelacion")),
        (S.PAYMENT_METHOD, d.payments.select("Id_Forma_De_Pago")),
        (S.INCOME_TYPE, d.details.select("Id_Tipo_Ingreso")),
        (S.EXTRAORDINARY_TYPE, d.extraordinary.select("Id_tipo_pago")),
        (S.ORDINARY_TYPE, d.ordinary.select("Id_Tipo_Gasto")),
        (S.SERVICE_TYPE, None),
    ]
    parts = []
    for table, used in uses:
        seeds = seed_table(d.spark, table)
        key, name = seeds.columns[:2]
        rows = seeds.select(F.lit(table.name).alias("tabla"), F.col(key).cast("int").alias("id"), F.col(name).alias("nombre"))
        if used is None:
            parts.append(rows.withColumn("filas", F.lit(0).cast("bigint")))
            continue
        counts = used.groupBy(F.col(used.columns[0]).cast("int").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(rows.join(counts, "id", "left").select("tabla", "id", "nombre", F.coalesce("n", F.lit(0)).alias("filas")))
    return reduce(DataFrame.unionByName, parts)


@_query
def o31_seed_tables(d: Domain) -> DataFrame:
    """Seeded expense types with the expenses booked on each."""
    booked = d.ordinary.groupBy("Id_Tipo_Gasto").agg(
        F.count(F.lit(1)).alias("gastos"), money(F.sum("Importe_Total")).alias("importe")
    )
    return seed_table(d.spark, S.ORDINARY_TYPE).join(booked, "Id_Tipo_Gasto", "left")
