"""Spans from the data, the work area, one-pass upserts, missing columns, ordered XML."""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prorrata import schemas as S
from prorrata.operators import imports as I, reports as R
from prorrata.operators.checks import check_table
from prorrata.operators.upsert import upsert
from prorrata.plans.adapter import Domain
from prorrata.plans.queries import QUERIES
from prorrata.seeds import seed_table
from prorrata.sources import workarea
from prorrata.sources.files import write_xml
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="generated tables not present")


@needs_data
def test_later_dates_are_part_of_the_results(spark, tmp_path):
    """A line item and an order of 2003 extend the settlements and are allocated."""
    for name in os.listdir(FOLDER):
        shutil.copy(f"{FOLDER}/{name}", tmp_path / name)
    for name, column in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        late = F.lit(dt.date(2003, 5, 17)).cast(table.schema[column].dataType)
        first = table.agg(F.min("l_orderkey" if name == "lineitem" else "o_orderkey")).first()[0]
        key = "l_orderkey" if name == "lineitem" else "o_orderkey"
        table.withColumn(column, F.when(F.col(key) == first, late).otherwise(F.col(column))).coalesce(1).write.parquet(str(tmp_path / f"late-{name}"))
        os.remove(tmp_path / f"{name}.parquet")
        os.rename(tmp_path / f"late-{name}", tmp_path / f"{name}.parquet")
    d = Domain(spark, str(tmp_path))
    assert d.months[1] == dt.date(2003, 5, 1)
    headers = QUERIES["o09_settlement_headers"](spark, str(tmp_path)).filter("Periodo = '2003-05-01'")
    assert headers.agg(F.sum("Total_Gasto_Ordinarios") + F.sum("Total_Gasto_Extraordinarios")).first()[0] > 0
    late_payment = d.payments.filter("Fecha = '2003-05-17'").first()["Id_Pago"]
    assert QUERIES["o12_resolve_payments"](spark, str(tmp_path)).filter(F.col("Id_Pago") == late_payment).count() == 1


def test_the_work_area_can_be_closed(spark):
    workarea.written(spark.range(10).toDF("n"), "something")
    folder = Path(re.sub("^file:/*", "/", workarea.work_area(spark)))
    assert folder.exists() and list(folder.iterdir())
    workarea.close_work_area(spark)
    assert not folder.exists()
    assert workarea.written(spark.range(3).toDF("n"), "again").count() == 3


def test_upsert_with_ids(spark):
    target = spark.createDataFrame([(4, "a", 1), (9, "b", 2)], "id long, k string, v int")
    source = spark.createDataFrame([("b", 20), ("c", 30), ("d", None)], "k string, v int")
    assert rows(upsert(target, source, ["k"], "t", id_column="id")) == [(10, "c", 30), (11, "d", None), (4, "a", 1), (9, "b", 20)]
    assert rows(upsert(target.limit(0), source, ["k"], "t", id_column="id"), "id") == [(1,), (2,), (3,)]


def test_a_repeated_source_key_fails(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string")
    with pytest.raises(PySparkException, match="more than one source row"):
        upsert(target, source, ["k"], "t").collect()


def test_a_repeated_administration_fails(spark):
    administrations = seed_table(spark, S.ADMINISTRATION)
    sheet = spark.createDataFrame(
        [("Consorcio 1", "uno", "Calle 1", 3, 100)],
        "Consorcio string, `Nombre del consorcio` string, Domicilio string, `Cant unidades funcionales` int, `M2 totales` int",
    )
    target = spark.createDataFrame([], S.CONDOMINIUM.schema)
    assert I.import_condominiums(sheet, administrations, target, 1).table.count() == 1
    with pytest.raises(PySparkException, match="more than one source row"):
        I.import_condominiums(sheet, administrations.unionByName(administrations), target, 1).table.collect()


def test_missing_columns_and_tables_are_violations(spark):
    payments = spark.createDataFrame([(1, "acc")], "Id_Pago long, Cuenta_Origen string")
    found = rows(check_table(S.PAYMENT.name, {S.PAYMENT.name: payments}), "regla", "columnas", "filas")
    assert ("MISSING COLUMN", "Id_Forma_De_Pago", 1) in found
    assert ("MISSING TABLE pagos.Forma_De_Pago", "Id_Forma_De_Pago", 1) in found
    assert ("PRIMARY KEY", "Id_Pago", 0) in found


@needs_data
def test_xml_files_hold_the_report_in_order(spark, tmp_path):
    d = Domain(spark, FOLDER)
    report = R.weekly_collection(d.payments, d.details, d.bills, *d.span)
    wanted = [(r["Id_Consorcio"], r["Anio"], r["Semana"]) for r in R.ordered(report).collect()]
    assert wanted == sorted(wanted) and len(wanted) > 100
    write_xml(report, str(tmp_path / "report"), "Fila", "Reporte")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    found = re.findall(r"<Id_Consorcio>(\d+)</Id_Consorcio>\s*<Anio>(\d+)</Anio>\s*<Semana>(\d+)</Semana>", text)
    assert [tuple(map(int, f)) for f in found] == wanted
