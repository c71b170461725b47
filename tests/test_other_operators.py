from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from prorrata import schemas as S
from prorrata.operators import privacy as P
from prorrata.operators.checks import check_tables
from prorrata.operators.unit_changes import AREA, COEFFICIENT, EMPTY, MISSING, TAKEN, change_units
from prorrata.seeds import ROWS, seed_tables
from tests.conftest import rows
from tests.test_ledger import UNIT_MONTHS, bill, world
from prorrata.operators.allocation import allocate_payments

KEYS = P.Keys(bytes(range(32)), "pepper")


def test_personal_data_is_hidden_and_comes_back(spark):
    persons = spark.createDataFrame([(1, "30", "ANA", "PAZ", None, "1", True, "C1")], S.PERSON.schema)
    stored = P.encrypt_persons(persons, KEYS)
    first, second = stored.first(), stored.first()
    assert first.DNI != second.DNI and b"30" != first.DNI and first.Email is None
    assert first.dni_bidx == second.dni_bidx and len(first.dni_bidx) == 64
    assert rows(P.decrypt_persons(stored, KEYS), *S.PERSON.columns) == rows(persons)
    assert "pepper" not in repr(KEYS)
    with pytest.raises(ValueError):
        P.Keys(b"short", "p")
    with pytest.raises(ValueError, match="spark.prorrata.privacy.key"):
        P.Keys.from_conf(spark)


def test_second_encrypted_import_updates_instead_of_duplicating(spark):
    schema = "nombre string, apellido string, dni string, email string, telefono string, cbu string, inquilino string, ordinal int"
    raw = spark.createDataFrame([("a", "b", "1", None, None, "C1", "0", 1), ("c", "d", "2", None, None, "C2", "1", 2)], schema)
    empty = P.encrypt_persons(spark.createDataFrame([], S.PERSON.schema), KEYS)
    once = P.import_encrypted_persons(raw, empty, KEYS).table
    twice = P.import_encrypted_persons(raw, once, KEYS).table
    assert rows(P.decrypt_persons(twice, KEYS)) == rows(P.decrypt_persons(once, KEYS))
    assert twice.count() == 2
    units = spark.createDataFrame([(1, "1", "1", "A", None, None, None, None, None, None)], S.UNIT.schema)
    condominiums = spark.createDataFrame([(1, 1, "UNO", "X", 1, 1, None, None)], S.CONDOMINIUM.schema)
    lines = spark.createDataFrame([(" C2", "uno", "1", "", "")], "cbu string, consorcio string, uf string, piso string, depto string")
    links = P.import_encrypted_links(
        lines, condominiums, units, once, spark.createDataFrame([], S.UNIT_PERSON.schema), dt.date(2025, 1, 1), KEYS
    ).table
    tenant = rows(P.decrypt_persons(once, KEYS).filter("DNI = '2'"), "Id_Persona")[0][0]
    assert rows(links) == [(1, 1, "1", tenant, 2, dt.date(2025, 1, 1), None)]
    bank = spark.createDataFrame([("1", "1/4/2025", "C2", "10"), ("2", "1/4/2025", "C1", "10")], "id string, fecha string, cuenta string, importe string")
    none = P.encrypt_payments(spark.createDataFrame([], S.PAYMENT.schema), KEYS)
    paid = P.import_encrypted_payments(bank, once, links, none, KEYS).table
    assert rows(P.decrypt_payments(paid, KEYS), "Id_Pago", "Cuenta_Origen", "Es_Pago_Asociado") == [
        (1, "C2", True), (2, "C1", False),
    ]


def test_allocation_over_encrypted_accounts(spark):
    tables = world(
        spark, [(1, "A", "1"), (2, "B", "2")], [(1, dt.date(2025, 4, 2), "A", 30), (2, dt.date(2025, 4, 3), "B", 5)],
        [bill("1", UNIT_MONTHS[0], 10), bill("2", UNIT_MONTHS[0], 10)],
    )
    cutoff = dt.date(2025, 4, 30)
    clear = allocate_payments(*tables, cutoff)
    hidden = P.allocate_encrypted_payments(
        tables[0], P.encrypt_payments(tables[1], KEYS), P.encrypt_persons(tables[2], KEYS), tables[3], cutoff
    )
    assert rows(hidden.bills) == rows(clear.bills)
    assert rows(hidden.details) == rows(clear.details)


def test_unit_changes(spark):
    units = spark.createDataFrame(
        [(1, str(u), str(u), "A", Decimal("1.00"), 10, False, False, 0, 0) for u in range(1, 8)], S.UNIT.schema
    )
    two = Decimal("2.00")
    changes = [
        (1, 1, "99", "9", "Z", two, 5, None, None, 1, 1),
        (2, 1, "1", "  ", "Z", two, 5, None, None, 1, 1),
        (3, 1, "1", "2", "A", two, 5, None, None, 1, 1),
        (4, 1, "1", "9", "Z", Decimal("0.00"), 5, None, None, 1, 1),
        (5, 1, "1", "9", "Z", two, 0, None, None, 1, 1),
        (6, 1, "4", " 8 ", "B", None, None, True, None, 1, 1),   # NULL numbers pass
        (7, 1, "5", "8", "B", two, 5, None, None, 1, 1),          # same spot, later
        (8, 1, "6", "6", "A", two, 5, None, True, 1, 1),          # its own spot
        (9, 1, "6", "6", "C", two, 6, None, True, 1, 1),          # last change stands
        (10, 1, "7", "4", "A", two, 5, None, None, 1, 1),         # left by unit 4 in this batch only
    ]
    schema = "ordinal int, Id_Consorcio int, NroUF string, Piso string, Departamento string, Coeficiente decimal(5,2), M2_UF smallint, Baulera boolean, Cochera boolean, M2_Baulera smallint, M2_Cochera smallint"
    done = change_units(spark.createDataFrame(changes, schema), units)
    assert {r.ordinal: r.reason for r in done.rejected.collect()} == {
        1: MISSING, 2: EMPTY, 3: TAKEN, 4: COEFFICIENT, 5: AREA, 7: TAKEN, 10: TAKEN,
    }
    changed = {r[1]: r[2:] for r in rows(done.table)}
    assert changed["4"] == ("8", "B", None, None, True, False, 1, 1)
    assert changed["6"] == ("6", "C", two, 6, False, True, 1, 1)
    assert changed["1"] == ("1", "A", Decimal("1.00"), 10, False, False, 0, 0)


def test_integrity_checks(spark):
    persons = spark.createDataFrame(
        [(1, None, "N" * 81, "A", None, None, False, "C"), (1, "2", "N", "A", None, None, False, None)], S.PERSON.schema
    )
    links = spark.createDataFrame(
        [(1, 1, "1", 1, 1, None, None), (2, 1, "1", 5, 1, None, None), (3, 1, "1", 5, 1, None, None), (4, 1, "1", None, 1, None, None)],
        S.UNIT_PERSON.schema,
    )
    found = {r[:3]: r[3] for r in rows(check_tables({S.PERSON.name: persons, S.UNIT_PERSON.name: links}))}
    person, link = S.PERSON.name, S.UNIT_PERSON.name
    assert found[(person, "PRIMARY KEY", "Id_Persona")] == 1
    assert found[(person, "NOT NULL", "DNI")] == 1 and found[(person, "NOT NULL", "Cbu_Cvu")] == 1
    assert found[(person, "LENGTH", "Nombre")] == 1 and found[(person, "LENGTH", "Apellido")] == 0
    assert found[(link, f"FOREIGN KEY {person}", "Id_Persona")] == 2
    assert found[(link, "PRIMARY KEY", "ID_U_P")] == 0


def test_seeds_match_their_tables(spark):
    tables = seed_tables(spark)
    assert len(S.TABLES) == 27
    for name, df in tables.items():
        assert df.schema == S.TABLES[name].schema and df.count() == len(ROWS[name])
    assert sum(r[3] for r in rows(check_tables(tables))) == 0
