from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from prorrata import schemas as S
from prorrata.operators import imports as I
from prorrata.operators.upsert import assign_ids, duplicate_keys, upsert
from prorrata.seeds import seed_table
from prorrata.sources import files
from tests.conftest import rows

D = Decimal
PRICE = D("1000.00")


def empty(spark, table):
    return spark.createDataFrame([], table.schema)


@pytest.fixture(scope="module")
def condominiums(spark):
    names = [(1, "AZCUENAGA"), (2, "Alberdi "), (3, "UNZUE")]
    return spark.createDataFrame(
        [(i, 1, n, "X", 0, None, PRICE, PRICE) for i, n in names], S.CONDOMINIUM.schema
    )


@pytest.fixture(scope="module")
def units(spark):
    made = [(1, "1"), (1, "2"), (1, "10"), (2, "1")]
    return spark.createDataFrame([(b, u, "1", "A", D("1.00"), 1, False, False, 0, 0) for b, u in made], S.UNIT.schema)


@pytest.fixture(scope="module")
def persons(spark):
    made = [(1, "100", "A", False), (2, "200", "B", True), (5, "500", "S", False), (4, "400", "S", True)]
    return spark.createDataFrame(
        [(i, d, "N", "P", None, None, t, a) for i, d, a, t in made], S.PERSON.schema
    )


@pytest.fixture(scope="module")
def links(spark):
    closed = dt.date(2024, 1, 1)
    made = [(1, 1, "1", 1, 1, None), (2, 1, "2", 1, 1, None), (3, 1, "10", 2, 2, closed)]
    return spark.createDataFrame([(i, b, u, p, r, None, e) for i, b, u, p, r, e in made], S.UNIT_PERSON.schema)


def test_condominiums(spark):
    sheet = spark.createDataFrame(
        [
            ("Consorcio 1", " Azul", "Calle 1", 10, 500),
            (None, "lost", "x", 1, 1),
            ("Consorcio X", "lost", "x", 1, 1),
            ("", "lost", "x", 1, 1),
            ("Consorcio 2", "Verde", "", None, -5),
            ("Consorcio 3", "Rojo", None, 3, None),
        ],
        "Consorcio string, `Nombre del consorcio` string, Domicilio string, `Cant unidades funcionales` int, `M2 totales` int",
    )
    old = spark.createDataFrame([(1, 9, "OLD", "OLD", 1, 1, D("1"), D("1")), (7, 9, "KEPT", "K", 1, 1, None, None)], S.CONDOMINIUM.schema)
    done = I.import_condominiums(sheet, seed_table(spark, S.ADMINISTRATION), old, 1)
    expected = [
        (1, 1, " AZUL", "Calle 1", 10, 500, PRICE, PRICE),
        (2, 1, "VERDE", I.NO_ADDRESS, 0, 0, PRICE, PRICE),
        (3, 1, "ROJO", I.NO_ADDRESS, 3, None, PRICE, PRICE),
        (7, 9, "KEPT", "K", 1, 1, None, None),
    ]
    assert rows(done.table) == expected
    assert rows(done.rejects, "reason") == [("condominium is not a number",)] * 2 + [("condominium missing",)]
    again = I.import_condominiums(sheet, seed_table(spark, S.ADMINISTRATION), done.table, 1)
    assert rows(again.table) == expected
    unknown = I.import_condominiums(sheet, seed_table(spark, S.ADMINISTRATION), empty(spark, S.CONDOMINIUM), 99)
    assert {r[1] for r in rows(unknown.table)} == {None}


def test_units_from_file(spark, condominiums, tmp_path):
    header = "\t".join("abcdefghij")
    lines = [
        "azcuenaga \t 1\t PB \tA\t1,67\t50.9\tSI\tno\t3.2\t0",
        "AZCUENAGA\t2\t1\tB\t2\t40\tno\tsi \t0\t12",
        "Nowhere\t1\t1\tA\t1\t1\tNO\tNO\t0\t0",
        "Alberdi\t\t1\tA\t1\t1\tNO\tNO\t0\t0",
        "Alberdi\t5\t1\tA\tx\t1\tNO\tNO\t0\t0",
        "Alberdi\t6\t1\tA\t1\t1,5\tNO\tNO\t0\t0",
        "Alberdi\t7\t1\tA\t1\t1\tNO\tNO\t300\t0",
        "Alberdi\t8\t1\tA\t1\t1\t\tNO\t\t0",
    ]
    (tmp_path / "uf.txt").write_bytes("\r\n".join([header, *lines]).encode() + b"\r\n")
    done = I.import_units(files.read_units(spark, str(tmp_path / "uf.txt")), condominiums, empty(spark, S.UNIT))
    expected = [
        (1, "1", "PB", "A", D("1.67"), 50, True, False, 3, 0),
        (1, "2", "1", "B", D("2.00"), 40, False, True, 0, 12),
        (2, "8", "1", "A", D("1.00"), 1, False, False, None, 0),
    ]
    assert rows(done.table) == expected
    assert rows(done.rejects, "uf", "reason") == [
        ("1", "unknown condominium"),
        ("5", "coefficient is not a number"),
        ("6", "area is not a number"),
        ("7", "storage or parking area out of range"),
        (None, "condominium or unit missing"),
    ]
    again = I.import_units(files.read_units(spark, str(tmp_path / "uf.txt")), condominiums, done.table)
    assert rows(again.table) == expected


def test_persons_from_file(spark, tmp_path):
    lines = [
        "n;a;d;e;t;c;i",
        " ana ;Paz; 30 ;An A@X.com;1;C1;1",
        "other;Paz;30;o@x.com;2;C2;0",
        "bad;Paz;;b@x.com;2;C2;0",
        "bad;Paz;12x;b@x.com;2;C2;0",
        "luz;Sol;20;l@x.com; 3 ;C3;0",
    ]
    path = tmp_path / "p.csv"
    path.write_text("\n".join(lines))
    old = spark.createDataFrame([(7, "20", "OLD", "OLD", None, None, True, "C9")], S.PERSON.schema)
    done = I.import_persons(files.read_persons(spark, str(path)), old)
    expected = [
        (7, "20", "LUZ", "SOL", "l@x.com", "3", False, "C3"),
        (8, "30", "ANA", "PAZ", "ana@x.com", "1", True, "C1"),
    ]
    assert rows(done.table) == expected
    assert rows(done.rejects, "reason") == [("document is not a number",), ("document missing",)]
    assert rows(I.import_persons(files.read_persons(spark, str(path)), done.table).table) == expected


def test_first_row_wins_whatever_the_partitions(spark):
    lines = [("n", "a", str(i % 5), "e", str(i), "c", "0", i) for i in range(500)]
    schema = "nombre string, apellido string, dni string, email string, telefono string, cbu string, inquilino string, ordinal int"
    raw = spark.createDataFrame(lines, schema)
    results = [
        rows(I.import_persons(raw.repartition(n), empty(spark, S.PERSON)).table, "Id_Persona", "DNI", "Telefono")
        for n in (1, 7)
    ]
    assert results[0] == results[1] == [(i + 1, str(i), str(i)) for i in range(5)]


def test_links_from_file(spark, condominiums, units, persons, links, tmp_path):
    lines = [
        "cbu|con|uf|p|d",
        "B |Alberdi| 1 |1|A",
        "B|alberdi|1|2|B",
        "S|AZCUENAGA|10|1|A",
        "A|AZCUENAGA|1|1|A",
        "Z|AZCUENAGA|1|1|A",
        "A|AZCUENAGA|99|1|A",
        "A|Nowhere|1|1|A",
        "|AZCUENAGA|1|1|A",
    ]
    path = tmp_path / "l.csv"
    path.write_text("\n".join(lines))
    today = dt.date(2025, 6, 1)

    def run(target):
        return I.import_links(files.read_links(spark, str(path)), condominiums, units, persons, target, today)

    done = run(links)
    new = [(4, 1, "10", 4, 2, today, None), (5, 2, "1", 2, 2, today, None)]
    assert rows(done.table.filter("ID_U_P > 3")) == new
    assert rows(done.rejects, "reason") == [
        ("account or unit missing",), ("unknown account",), ("unknown condominium",), ("unknown unit",),
    ]
    assert rows(run(done.table).table) == rows(done.table)


def test_payments_from_file(spark, persons, links, tmp_path):
    lines = [
        "id,fecha,cuenta,importe",
        "1,5/4/2025, A ,$ 100.50",
        "2,31/02/2025,A,20",
        "3,05/04/2025,B,30",
        "4,05/04/2025,unknown,40",
        "5,05/04/2025,,50",
        "6,05/04/2025,A,",
        "7,05/04/2025,A,much",
        "8,05/04/2025,A,80",
    ]
    path = tmp_path / "p.csv"
    path.write_text("\n".join(lines))
    old = spark.createDataFrame([(8, 1, None, "OLD", D("1.00"), True, True)], S.PAYMENT.schema)
    done = I.import_payments(files.read_payments(spark, str(path)), persons, links, old)
    day = dt.date(2025, 4, 5)
    assert rows(done.table) == [
        (1, 1, day, "A", D("100.50"), True, False),
        (2, 1, None, "A", D("20.00"), True, False),
        (3, 1, day, "B", D("30.00"), False, False),  # its only link is closed
        (4, 1, day, "unknown", D("40.00"), False, False),
        (8, 1, None, "OLD", D("1.00"), True, True),
    ]
    assert rows(done.rejects, "id", "reason") == [
        ("5", "account or amount missing"), ("6", "account or amount missing"), ("7", "amount is not a number"),
    ]
    again = I.import_payments(files.read_payments(spark, str(path)), persons, links, done.table)
    assert rows(again.table) == rows(done.table)


def test_comma_decimals_and_repeated_payment_numbers(spark, persons, links):
    schema = "id string, fecha string, cuenta string, importe string"
    raw = spark.createDataFrame([("1", "1/4/2025", "A", "$ 123,45")], schema)
    done = I.import_payments(raw, persons, links, empty(spark, S.PAYMENT))
    assert rows(done.table, "Importe") == [(D("123.45"),)]
    with pytest.raises(Exception, match="more than one source row"):
        I.import_payments(raw.union(raw), persons, links, empty(spark, S.PAYMENT)).table.collect()


def test_suppliers(spark, condominiums):
    sheet = spark.createDataFrame(
        [
            ("Proveedores", None, None, None),
            ("Tipo gasto", "Nombre", "Cuenta", "Nombre del consorcio"),
            (" LIMPIEZA ", " Clean ", " 1 ", "Azcuenaga"),
            (" LIMPIEZA ", " Clean ", " 1 ", " AZCUENAGA "),
            ("SEGUROS", "Safe", None, "Alberdi"),
            ("SEGUROS", "Safe", None, "Nowhere"),
            ("SEGUROS", None, None, "Alberdi"),
            ("  ", "x", None, "Alberdi"),
        ],
        "F1 string, F2 string, F3 string, F4 string",
    )
    old = spark.createDataFrame([(4, 2, "Safe", "OLD", "OLD")], S.SUPPLIER.schema)
    done = I.import_suppliers(sheet, condominiums, old)
    expected = [(4, 2, "Safe", "SEGUROS", None), (5, 1, "Clean", "LIMPIEZA", "1")]
    assert rows(done.table) == expected
    assert rows(I.import_suppliers(sheet, condominiums, done.table).table) == expected
    clash = sheet.union(spark.createDataFrame([("OTRO", "Safe", None, "Alberdi")], sheet.schema))
    with pytest.raises(Exception, match="more than one source row"):
        I.import_suppliers(clash, condominiums, old).table.collect()


def test_expenses_from_json(spark, condominiums, tmp_path):
    documents = [
        {"_id": {"x": 1}, "Nombre del consorcio": "Azcuenaga", "Mes": "Abril ", "BANCARIOS": "25.500,00",
         "LIMPIEZA": "25,500.00", "ADMINISTRACION": "3000", "SEGUROS": "45", "GASTOS GENERALES": "7",
         "SERVICIOS PUBLICOS-Agua": "1.000,00", "SERVICIOS PUBLICOS-Luz": "2.000,00"},
        {"Nombre del consorcio": "Unzue", "Mes": "brumario", "BANCARIOS": "100,00"},
        {"Nombre del consorcio": "Nowhere", "Mes": "mayo", "BANCARIOS": "100,00"},
    ]
    path = tmp_path / "e.json"
    path.write_text(json.dumps(documents))
    types = seed_table(spark, S.ORDINARY_TYPE)

    def run(target):
        return I.import_expenses(files.read_expenses(spark, str(path)), condominiums, types, target, 2025)

    done = run(empty(spark, S.ORDINARY_EXPENSE))
    april = dt.date(2025, 4, 1)
    assert rows(done.table) == [
        (1, 1, 1, april, D("25500.00"), "BANCARIOS"),
        (2, 1, 2, april, D("25500.00"), "LIMPIEZA"),
        (3, 1, 3, april, D("30.00"), "ADMINISTRACION"),
        (4, 1, 4, april, D("0.45"), "SEGUROS"),
        (5, 1, 5, april, None, "GASTOS GENERALES"),
        (6, 1, 6, april, D("1000.00"), "SERVICIOS PUBLICOS-Agua"),
        (7, 1, 6, april, D("2000.00"), "SERVICIOS PUBLICOS-Luz"),
    ]
    reasons = rows(done.rejects.filter("importe is not null"), "reason")
    assert reasons == [("unknown condominium",), ("unknown month",)]
    assert rows(run(done.table).table) == rows(done.table)


def test_upsert_and_ids(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, kept int")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(upsert(target, source, ["k"], "t")) == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    assert rows(duplicate_keys(source.union(source), ["k"])) == [(2, 2), (3, 2)]
    numbered = assign_ids(spark.range(1000).repartition(5).select((-F.col("id")).alias("k")), "n", ["k"], 100)
    found = rows(numbered.orderBy("k"), "k", "n", order=True)
    assert found == [(k, 101 + i) for i, k in enumerate(range(-999, 1))]

