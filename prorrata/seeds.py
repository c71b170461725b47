"""Reference data every installation starts with."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from prorrata import schemas as S

OWNER, TENANT = 1, 2
BANK_TRANSFER = 1
ON_TIME, OVERDUE, ADVANCE = 1, 2, 3

# The rows the operations look up by id or by name.
ROWS = {
    S.ADMINISTRATION.name: [
        (1, "Administradora Central", "30-00000000-0", "Calle Principal 100", "11-0000-0000",
         "contacto@example.com", "0" * 22, Decimal("1000.00"), Decimal("1000.00")),
    ],
    S.RELATION_TYPE.name: [(OWNER, "Propietario"), (TENANT, "Inquilino")],
    S.PAYMENT_METHOD.name: [
        (BANK_TRANSFER, "Transferencia Bancaria"), (2, "Efectivo"), (3, "Debito Automatico"),
    ],
    S.INCOME_TYPE.name: [(ON_TIME, "EN TERMINO"), (OVERDUE, "ADEUDADO"), (ADVANCE, "ADELANTADO")],
    S.EXTRAORDINARY_TYPE.name: [(1, "Reparaciones"), (2, "Mejoras"), (3, "Fondo de Reserva")],
    S.ORDINARY_TYPE.name: [
        (1, "BANCARIOS"), (2, "LIMPIEZA"), (3, "ADMINISTRACION"), (4, "SEGUROS"),
        (5, "GASTOS GENERALES"), (6, "SERVICIOS PUBLICOS"),
    ],
    S.SERVICE_TYPE.name: [(1, "Agua"), (2, "Luz"), (3, "Gas")],
}


def seed_table(spark: SparkSession, table: S.Table) -> DataFrame:
    return spark.createDataFrame(ROWS[table.name], table.schema)


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: seed_table(spark, S.TABLES[name]) for name in ROWS}
