"""Cleaning of the files an administration receives, and their merge into the tables.

Every import returns the new table and the rows it left out, with the reason.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prorrata.functions.dates import month_number
from prorrata.functions.money import PERCENT, decode_amount, money, parse_amount
from prorrata.functions.text import is_blank, match_key, yes_flag
from prorrata.operators.upsert import insert_missing, unique_source, upsert
from prorrata.schemas import ADMINISTRATION, CONDOMINIUM, PAYMENT, PERSON, UNIT, UNIT_KEY
from prorrata.seeds import BANK_TRANSFER, OWNER, TENANT

NO_ADDRESS = "DOMICILIO NO INFORMADO"
HEADER_TYPE, HEADER_CONDOMINIUM = "Tipo gasto", "Nombre del consorcio"

# Expense columns of the JSON files. The public services share one expense type.
EXPENSE_COLUMNS = (
    "BANCARIOS",
    "LIMPIEZA",
    "ADMINISTRACION",
    "SEGUROS",
    "GASTOS GENERALES",
    "SERVICIOS PUBLICOS-Agua",
    "SERVICIOS PUBLICOS-Luz",
)
PUBLIC_SERVICES = "SERVICIOS PUBLICOS"


@dataclass(frozen=True)
class Import:
    table: DataFrame
    rejects: DataFrame


def _split(staged: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason to be left out, and the others with the first reason that applies."""
    reason = F.coalesce(*[F.when(condition, F.lit(text)) for text, condition in reasons.items()])
    marked = staged.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def _not_a_number(text: Column, value: Column) -> Column:
    return text.isNotNull() & value.isNull()


def condominium_names(condominiums: DataFrame) -> DataFrame:
    """Lookup by name; of several buildings with one name the lowest id is taken."""
    return condominiums.groupBy(match_key(F.col("Nombre")).alias("name")).agg(
        F.min("Id_Consorcio").alias("Id_Consorcio")
    )


def _with_condominium(staged: DataFrame, name: Column, condominiums: DataFrame) -> DataFrame:
    return (
        staged.withColumn("name", match_key(name)).join(condominium_names(condominiums), "name", "left").drop("name")
    )


def import_condominiums(
    sheet: DataFrame, administrations: DataFrame, target: DataFrame, administration: int
) -> Import:
    """Sheet columns: Consorcio, Nombre del consorcio, Domicilio, Cant unidades funcionales, M2 totales."""
    # The administration is at most one row, or the job fails: a bounded broadcast.
    ours = administrations.filter(F.col("Id_Administracion") == administration)
    prices = F.broadcast(
        unique_source(ours, ["Id_Administracion"], ADMINISTRATION.name).select(
            "Id_Administracion",
            F.col("Precio_Cochera_Default").alias("Precio_Cochera"),
            F.col("Precio_Baulera_Default").alias("Precio_Baulera"),
        )
    )
    number = F.trim(F.regexp_replace("Consorcio", "(?i)consorcio ", "")).try_cast("int")
    area = F.col("M2 totales").cast("int")
    staged = sheet.withColumn("Id_Consorcio", number)
    accepted, rejects = _split(
        staged,
        {
            "condominium missing": F.col("Consorcio").isNull(),
            "condominium is not a number": F.col("Id_Consorcio").isNull(),
        },
    )
    cleaned = accepted.select(
        "Id_Consorcio",
        F.upper("Nombre del consorcio").alias("Nombre"),
        F.when(is_blank(F.col("Domicilio")), F.lit(NO_ADDRESS)).otherwise(F.col("Domicilio")).alias("Domicilio"),
        F.coalesce(F.col("Cant unidades funcionales"), F.lit(0)).cast("smallint").alias("Cant_unidades"),
        F.when(area < 0, F.lit(0)).otherwise(area).alias("MetrosCuadrados"),
        F.lit(administration).alias("Id_Administracion"),
    )
    priced = (
        cleaned.withColumnRenamed("Id_Administracion", "wanted")
        .join(prices, F.col("wanted") == F.col("Id_Administracion"), "left")
        .select(CONDOMINIUM.columns)
    )
    return Import(upsert(target, priced, ["Id_Consorcio"], CONDOMINIUM.name), rejects)


def import_units(raw: DataFrame, condominiums: DataFrame, target: DataFrame) -> Import:
    """Text columns: consorcio, uf, piso, depto, coeficiente, m2, baulera, cochera, m2_baulera, m2_cochera."""

    def area(value: Column, precision: int) -> Column:
        exact = F.trim(value).try_cast(f"decimal({precision},2)")
        return exact.try_cast("smallint")  # whole metres: the fraction is cut

    kept = raw.select(F.struct(*raw.columns).alias("raw"))
    text = {name: F.col(f"raw.{name}") for name in raw.columns}
    staged = _with_condominium(kept, text["consorcio"], condominiums).select(
        "raw",
        "Id_Consorcio",
        F.trim(text["uf"]).alias("NroUF"),
        F.trim(text["piso"]).alias("Piso"),
        F.trim(text["depto"]).alias("Departamento"),
        F.replace(F.trim(text["coeficiente"]), F.lit(","), F.lit(".")).try_cast(PERCENT).alias("Coeficiente"),
        area(text["m2"], 7).alias("M2_UF"),
        yes_flag(text["baulera"], "SI").alias("Baulera"),
        yes_flag(text["cochera"], "SI").alias("Cochera"),
        area(text["m2_baulera"], 5).alias("M2_Baulera"),
        area(text["m2_cochera"], 5).alias("M2_Cochera"),
    )
    fits = F.col("M2_Baulera").between(0, 255) & F.col("M2_Cochera").between(0, 255)
    accepted, rejects = _split(
        staged,
        {
            "condominium or unit missing": F.col("raw.consorcio").isNull() | F.col("raw.uf").isNull(),
            "unknown condominium": F.col("Id_Consorcio").isNull(),
            "coefficient is not a number": _not_a_number(F.col("raw.coeficiente"), F.col("Coeficiente")),
            "area is not a number": _not_a_number(F.col("raw.m2"), F.col("M2_UF"))
            | _not_a_number(F.col("raw.m2_baulera"), F.col("M2_Baulera"))
            | _not_a_number(F.col("raw.m2_cochera"), F.col("M2_Cochera")),
            "storage or parking area out of range": ~fits,
        },
    )
    return Import(
        upsert(target, accepted.select(UNIT.columns), UNIT_KEY, UNIT.name), rejects.select("raw.*", "reason")
    )


def stage_persons(raw: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned persons, one per document, and rejects.

    Text columns: nombre, apellido, dni, email, telefono, cbu, inquilino. Of
    several rows with one document the first by *ordinal* counts. The minimum
    is taken while aggregating, so a document that fills a third of the file is
    reduced before it is shuffled.
    """
    cleaned = raw.select(
        F.trim("dni").alias("DNI"),
        F.upper(F.trim("nombre")).alias("Nombre"),
        F.upper(F.trim("apellido")).alias("Apellido"),
        F.lower(F.replace("email", F.lit(" "), F.lit(""))).alias("Email"),
        F.trim("telefono").alias("Telefono"),
        F.coalesce(F.trim("inquilino") == "1", F.lit(False)).alias("inquilino"),
        F.trim("cbu").alias("Cbu_Cvu"),
        F.col(ordinal).alias("ordinal"),
    )
    accepted, rejects = _split(
        cleaned,
        {
            "document missing": is_blank(F.col("DNI")),
            "document is not a number": ~F.col("DNI").rlike("^[0-9]+$"),
            "account missing": F.col("Cbu_Cvu").isNull(),
        },
    )
    values = [c for c in PERSON.columns if c not in ("Id_Persona", "DNI")]
    first = F.min_by(F.struct(*values), "ordinal").alias("first")
    return accepted.groupBy("DNI").agg(first).select("DNI", "first.*"), rejects


def import_persons(raw: DataFrame, target: DataFrame, ordinal: str = "ordinal") -> Import:
    persons, rejects = stage_persons(raw, ordinal)
    return Import(upsert(target, persons, ["DNI"], PERSON.name, id_column="Id_Persona"), rejects)


def import_links(
    raw: DataFrame,
    condominiums: DataFrame,
    units: DataFrame,
    persons: DataFrame,
    target: DataFrame,
    as_of: dt.date,
    account: Column | None = None,
    person_account: str = "Cbu_Cvu",
) -> Import:
    """Text columns: cbu, consorcio, uf (piso and depto are not used).

    *account* is the form in which accounts are matched, the trimmed text by
    default. Of several persons with one account the lowest id is taken.
    """
    wanted = F.trim("cbu") if account is None else account
    holders = (
        persons.filter(F.col(person_account).isNotNull())
        .groupBy(F.col(person_account).alias("account"))
        .agg(F.min(F.struct("Id_Persona", "inquilino")).alias("person"))
        .select("account", "person.*")
    )
    # Equal rows of the file collapse before the joins.
    staged = raw.select(
        wanted.alias("account"), match_key(F.col("consorcio")).alias("consorcio"), F.trim("uf").alias("NroUF")
    ).distinct()
    known_unit = units.select(*UNIT_KEY).withColumn("unit_exists", F.lit(True))
    resolved = (
        _with_condominium(staged, F.col("consorcio"), condominiums)
        .join(holders, "account", "left")
        .join(known_unit, UNIT_KEY, "left")
    )
    accepted, rejects = _split(
        resolved,
        {
            "account or unit missing": F.col("account").isNull() | F.col("NroUF").isNull(),
            "unknown condominium": F.col("Id_Consorcio").isNull(),
            "unknown account": F.col("Id_Persona").isNull(),
            "unknown unit": F.col("unit_exists").isNull(),
        },
    )
    keys = [*UNIT_KEY, "Id_Persona", "Id_TipoRelacion"]
    links = (
        accepted.select(
            *UNIT_KEY,
            "Id_Persona",
            F.when(F.col("inquilino"), F.lit(TENANT)).otherwise(F.lit(OWNER)).alias("Id_TipoRelacion"),
        )
        .distinct()
        .withColumn("Fecha_Inicio", F.lit(as_of))
    )
    return Import(
        insert_missing(target, links, keys, "unidades.Unidad_Persona", id_column="ID_U_P"),
        rejects.select("account", "consorcio", "NroUF", "reason"),
    )


def accounts_with_open_link(persons: DataFrame, links: DataFrame, person_account: str = "Cbu_Cvu") -> DataFrame:
    current = links.filter(F.col("Fecha_Fin").isNull()).select("Id_Persona").distinct()
    return persons.join(current, "Id_Persona", "left_semi").select(F.col(person_account).alias("account")).distinct()


def stage_payments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text columns: id, fecha (d/m/y), cuenta, importe. A date that is none becomes NULL."""
    cleaned = raw.select(
        F.trim("id").try_cast("bigint").alias("Id_Pago"),
        F.try_to_date(F.trim("fecha"), "d/M/yyyy").alias("Fecha"),
        F.trim("cuenta").alias("Cuenta_Origen"),
        parse_amount(F.col("importe")).alias("Importe"),
        F.struct("id", "fecha", "cuenta", "importe").alias("raw"),
    )
    accepted, rejects = _split(
        cleaned,
        {
            "account or amount missing": F.col("raw.cuenta").isNull() | F.col("raw.importe").isNull(),
            "payment number is not a number": F.col("Id_Pago").isNull(),
            "amount is not a number": F.col("Importe").isNull(),
        },
    )
    return accepted.drop("raw"), rejects.select("raw.*", "reason")


def import_payments(raw: DataFrame, persons: DataFrame, links: DataFrame, target: DataFrame) -> Import:
    staged, rejects = stage_payments(raw)
    return Import(append_payments(staged, accounts_with_open_link(persons, links), target, "Cuenta_Origen"), rejects)


def append_payments(staged: DataFrame, associated: DataFrame, target: DataFrame, account: str) -> DataFrame:
    """Unseen payments, flagged by whether *account* is among the associated accounts."""
    flagged = (
        staged.join(
            associated.withColumnRenamed("account", account).withColumn("Es_Pago_Asociado", F.lit(True)), account, "left"
        )
        .withColumn("Es_Pago_Asociado", F.coalesce("Es_Pago_Asociado", F.lit(False)))
        .withColumn("Id_Forma_De_Pago", F.lit(BANK_TRANSFER))
        .withColumn("Procesado", F.lit(False))
    )
    return insert_missing(target, flagged.select(target.columns), ["Id_Pago"], PAYMENT.name)


def import_suppliers(sheet: DataFrame, condominiums: DataFrame, target: DataFrame) -> Import:
    """Headerless sheet, columns by position: F1 expense type, F2 name, F3 account, F4 condominium."""
    staged = _with_condominium(sheet, F.col("F4"), condominiums)
    accepted, rejects = _split(
        staged,
        {
            "title or header": is_blank(F.col("F4")) | (match_key(F.col("F4")) == HEADER_CONDOMINIUM.upper())
            | is_blank(F.col("F1")) | (match_key(F.col("F1")) == HEADER_TYPE.upper()),
            "unknown condominium": F.col("Id_Consorcio").isNull(),
            "name missing": F.col("F2").isNull(),
        },
    )
    suppliers = accepted.select(
        "Id_Consorcio",
        F.trim("F2").alias("Nombre_Gasto"),
        F.trim("F1").alias("Descripcion"),
        F.trim("F3").alias("Cuenta"),
    ).distinct()
    keys = ["Id_Consorcio", "Nombre_Gasto"]
    return Import(
        upsert(target, suppliers, keys, "negocio.Proveedor", id_column="Id_Proveedor"),
        rejects.select("F1", "F2", "F3", "F4", "reason"),
    )


def import_expenses(
    documents: DataFrame, condominiums: DataFrame, expense_types: DataFrame, target: DataFrame, year: int
) -> Import:
    """One row per building and month, one text column per expense, to one row per expense.

    Water and light share the expense type, so the description belongs to the key.
    """
    amounts = documents.select("Nombre del consorcio", "Mes", *[F.col(f"`{c}`") for c in EXPENSE_COLUMNS]).unpivot(
        ["Nombre del consorcio", "Mes"], [F.col(f"`{c}`") for c in EXPENSE_COLUMNS], "Descripcion", "importe"
    )
    kind = F.when(F.col("Descripcion").startswith(PUBLIC_SERVICES), F.lit(PUBLIC_SERVICES)).otherwise(
        F.col("Descripcion")
    )
    types = expense_types.select("Id_Tipo_Gasto", match_key(F.col("Nombre")).alias("kind"))
    staged = (
        _with_condominium(amounts, F.col("Nombre del consorcio"), condominiums)
        .withColumn("kind", match_key(kind))
        .join(types, "kind", "left")
        .withColumn("month", month_number(F.col("Mes")))
    )
    accepted, rejects = _split(
        staged,
        {
            "amount missing": F.col("importe").isNull(),
            "unknown month": F.col("month").isNull(),
            "unknown condominium": F.col("Id_Consorcio").isNull(),
            "unknown expense type": F.col("Id_Tipo_Gasto").isNull(),
        },
    )
    expenses = accepted.select(
        "Id_Consorcio",
        "Id_Tipo_Gasto",
        F.make_date(F.lit(year), F.col("month"), F.lit(1)).alias("Fecha"),
        "Descripcion",
        money(decode_amount(F.col("importe"))).alias("Importe_Total"),
    )
    keys = ["Id_Consorcio", "Id_Tipo_Gasto", "Fecha", "Descripcion"]
    return Import(
        upsert(target, expenses, keys, "gastos.Gasto_Ordinario", id_column="Id_gasto"),
        rejects.select("Nombre del consorcio", "Mes", "Descripcion", "importe", "reason"),
    )
