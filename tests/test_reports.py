from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prorrata import schemas as S
from prorrata.functions.dates import week_number
from prorrata.operators import reports as R
from prorrata.sources.files import top_months_xml, write_xml
from prorrata.sources.tables import read_table, write_table
from tests.conftest import rows
from tests.test_ledger import D

APRIL, MAY = dt.date(2025, 4, 1), dt.date(2025, 5, 1)
START, END = dt.date(2025, 1, 1), dt.date(2025, 12, 31)


def day(text):
    return dt.date.fromisoformat(f"2025-{text}")


@pytest.fixture(scope="module")
def books(spark):
    payments = [
        (1, day("04-05"), 90), (2, day("04-06"), 60), (3, day("04-06"), 40), (4, day("05-01"), 10), (5, day("05-02"), 7),
    ]
    details = [
        (1, 1, 1, "1", APRIL, 1, 90), (2, 1, 1, "1", APRIL, 1, 50), (2, 2, 1, "1", MAY, 3, 10),
        (3, 1, 1, "2", APRIL, 1, 40), (4, 1, 1, "1", MAY, 1, 10), (5, 1, 2, "1", APRIL, 1, 7),
    ]
    bills = [
        (1, "1", APRIL, 200, 100, 140), (1, "1", MAY, 10, 0, 20), (1, "2", APRIL, 0, 30, 40), (2, "1", APRIL, 0, 0, 7),
    ]  # building, unit, month, ordinary, extraordinary, paid
    return (
        spark.createDataFrame([(i, 1, d, "A", D(a), True, True) for i, d, a in payments], S.PAYMENT.schema),
        spark.createDataFrame([(*r[:6], D(r[6])) for r in details], S.PAYMENT_DETAIL.schema),
        spark.createDataFrame(
            [(b, u, m, D(0), D(p), D(0), D(0), D(o), D(e), D(o + e)) for b, u, m, o, e, p in bills], S.BILL.schema
        ),
    )


def test_week_numbers(spark):
    expected = {"2025-01-04": 1, "2025-01-05": 2, "2023-01-01": 1, "2024-12-31": 53}
    dates = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in expected], "d date")
    assert dict(rows(dates, F.col("d").cast("string"), week_number(F.col("d")))) == expected


def test_weekly_collection(books):
    report = R.weekly_collection(*books, START, END)
    assert rows(report) == [
        # 2025-04-05 is a Saturday: the next day starts another week
        (1, 2025, 14, D(60), D(30), D(90), D(90), D(66.67)),
        (1, 2025, 15, D("43.33"), D("56.67"), D(100), D(190), D("66.67")),
        (1, 2025, 18, D(10), D(0), D(10), D(200), D("66.67")),
        (2, 2025, 18, D(0), D(0), D(7), D(7), D(7)),
    ]
    assert rows(R.weekly_collection(*books, START, END, condominium=2), "Id_Consorcio", "TotalSemana") == [(2, D(7))]


def test_collection_by_origin_leaves_out_empty_bills(books):
    report = R.collection_by_origin(*books, START, END)
    assert rows(report) == [
        (1, "2025-04", D("103.33"), D("86.67"), D(190)),
        (1, "2025-05", D(10), D(0), D(10)),
    ]


def test_monthly_by_department(spark, books):
    payments, details, _ = books
    units = spark.createDataFrame(
        [(b, u, "1", d, None, None, None, None, None, None) for b, u, d in [(1, "1", "A"), (1, "2", "B"), (2, "1", "A")]],
        S.UNIT.schema,
    )
    report = R.monthly_by_department(payments, details, units, START, END)
    assert report.columns == ["Id_Consorcio", "Departamento", "2025-04", "2025-05"]
    assert rows(report) == [(1, "A", D(150), D(10)), (1, "B", D(40), None), (2, "A", None, D(7))]
    nothing = R.monthly_by_department(payments, details, units, START, START)
    assert nothing.columns == ["Id_Consorcio", "Departamento"] and nothing.count() == 0


def test_top_months(spark, books):
    payments, details, _ = books
    ordinary = spark.createDataFrame(
        [(i, 1, 1 + i % 2, dt.date(2025, m, 1), D(10 * m), "x") for i, m in enumerate(range(1, 8))], S.ORDINARY_EXPENSE.schema
    )
    special = spark.createDataFrame([(1, 1, 1, "w", 1, 1, D(60), dt.date(2025, 1, 2))], S.EXTRAORDINARY_EXPENSE.schema)
    spent = R.top_expense_months(ordinary, special, year=2025, condominium=1)
    both = "Gasto Extraordinario, Gasto Ordinario"
    assert rows(spent.orderBy("Puesto"), "Mes", "TotalGasto", "TiposIncluidos", order=True) == [
        (1, D(70), both), (7, D(70), "Gasto Ordinario"), (6, D(60), "Gasto Ordinario"), (5, D(50), "Gasto Ordinario"),
        (4, D(40), "Gasto Ordinario"),
    ]
    filtered = R.top_expense_months(ordinary, special, year=2025, expense_type=2)
    assert rows(filtered, "Mes", "TotalGasto") == [(1, D(60)), (2, D(20)), (4, D(40)), (6, D(60))]
    earned = R.top_income_months(payments, details, year=2025)
    assert rows(earned, "Id_Consorcio", "Mes", "TotalIngreso", "Puesto") == [
        (1, 4, D(190), 1), (1, 5, D(10), 2), (2, 5, D(7), 1),
    ]
    document = rows(top_months_xml(spent, earned.filter("Id_Consorcio = 2")))
    assert "<TopIngresos>" not in document[0][2] and "<TiposIncluidos>" + both in document[0][2]
    assert "<TopGastos>" not in document[1][2]


def test_top_debtors(spark):
    bills = spark.createDataFrame(
        [(1, u, m, D(0), D(p), D(0), D(0), D(0), D(0), D(t)) for u, m, t, p in [
            ("1", APRIL, 100, 0), ("1", MAY, 200, 0), ("2", APRIL, 50, "49.99"), ("3", APRIL, 70, 0), ("4", APRIL, 60, 0),
            ("5", APRIL, 60, 0), ("1", dt.date(2024, 12, 1), 999, 0)]],
        S.BILL.schema,
    )
    units = spark.createDataFrame(
        [(1, str(u), "2", "A", None, None, None, None, None, None) for u in range(1, 6)], S.UNIT.schema
    )
    persons = spark.createDataFrame(
        [(i, str(10 + i), f"N{i}", f"A{i}", "e" * 40, None, False, "x") for i in range(1, 6)], S.PERSON.schema
    )
    ended = dt.date(2025, 1, 1)
    links = spark.createDataFrame(
        [(i, 1, str(i), i, 1, None, None) for i in range(1, 6)] + [(9, 1, "1", 3, 2, None, ended)], S.UNIT_PERSON.schema
    )
    report = R.top_debtors(bills, units, links, persons, year=2025, condominium=1, floor="2")
    assert rows(report.orderBy("Puesto"), "Propietario", "DNI", "Email", "DeudaTotalAcumulada", "Cant_Periodos_Adeudados", order=True) == [
        ("A1, N1", "11", "e" * 40, D(300), 2), ("A3, N3", "13", "e" * 40, D(70), 1), ("A4, N4", "14", "e" * 40, D(60), 1),
    ]


def test_payment_intervals(books):
    report = R.payment_intervals(*books, START, END)
    assert rows(report) == [
        (1, "1", "2025-04-05", "2025-04-06", 1),
        (1, "1", "2025-04-06", "2025-04-06", 0),  # one payment on two bills
        (1, "1", "2025-04-06", "2025-05-01", 25),
    ]


def test_xml_file(spark, books, tmp_path):
    report = R.weekly_collection(*books, START, END, condominium=2).drop("Id_Consorcio").withColumn("nada", F.lit(None).cast("string"))
    write_xml(report.coalesce(1), str(tmp_path / "x"), "Fila", "RecaudacionSemanal")
    text = next((tmp_path / "x").glob("part-*")).read_text()
    flat = "".join(line.strip() for line in text.splitlines())
    assert flat.endswith(
        "<RecaudacionSemanal><Fila><Anio>2025</Anio><Semana>18</Semana><TotalOrdinario>0.00</TotalOrdinario>"
        "<TotalExtraordinario>0.00</TotalExtraordinario><TotalSemana>7.00</TotalSemana>"
        "<AcumuladoProgresivo>7.00</AcumuladoProgresivo><PromedioPeriodo>7.00</PromedioPeriodo></Fila></RecaudacionSemanal>"
    )


def test_stored_tables(spark, books, tmp_path):
    bills = books[2]
    write_table(bills, S.BILL, str(tmp_path / "bills"))
    back = read_table(spark, S.BILL, str(tmp_path / "bills"))
    assert back.schema == S.BILL.schema and rows(back) == rows(bills)
    assert (tmp_path / "bills" / "Periodo=2025-04-01").is_dir()
