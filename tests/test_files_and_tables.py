"""Malformed lines, JSON arrays cut across tasks, months rewritten in place, secrets outside plans, one-pass checks."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prorrata import schemas as S
from prorrata.operators import checks
from prorrata.operators.reports import CONTACT
from prorrata.seeds import seed_tables
from prorrata.sources import files
from prorrata.sources.tables import read_table, replace_settlements, upsert_months, write_table
from tests.conftest import rows
from tests.test_books import MONTHS, bills_of_units, files_below

ROOT = Path(__file__).resolve().parents[1]


def test_lines_with_another_number_of_fields_are_rejects(spark, tmp_path):
    folder = tmp_path / "payments"
    folder.mkdir()
    (folder / "a.csv").write_text("id,fecha,cuenta,importe\n1,1/1/2025,X,5\n2,1/1/2025,X\n\n3,,,\n")
    (folder / "b.csv").write_text("id,fecha,cuenta,importe\n4,1/1/2025,X,5,6\n5,1/1/2025,\"X,7\n")
    found = files.read_payments(spark, str(folder))
    assert rows(found) == [("1", "1/1/2025", "X", "5"), ("3", None, None, None), ("5", "1/1/2025", '"X', "7")]
    assert rows(found.select("id")) == [("1",), ("3",), ("5",)] and found.count() == 3
    assert rows(files.malformed_lines(spark, str(folder), "payments")) == [
        ("a.csv", "2,1/1/2025,X", "too few fields"), ("b.csv", "4,1/1/2025,X,5,6", "too many fields"),
    ]


def array_of(count: int) -> list[dict]:
    rng = random.Random(count)
    texts = ["plain", "a } b", "}}{{", 'quote " and }', "back\\slash}", "\\", '\\"}', "line\nbreak", "é}ñ", "", "x" * 3000 + "}" + "y" * 3000]
    nested = [{}, {"x": "}"}, {"y": {"z": ["{", {"w": 1}]}}]
    return [{"_id": rng.choice(nested), "a": str(i), "b": rng.choice(texts), "c": rng.choice([i, 1.5, None, True])} for i in range(count)]


@pytest.mark.parametrize("count, indent, block", [(300, None, 700), (300, 2, 700), (40, None, 100), (40, 1, 1 << 20), (1, None, 50), (0, None, 50)])
def test_json_arrays_are_cut_across_tasks(spark, tmp_path, count, indent, block):
    """Any size of blocks, smaller than a record too, gives the rows that a reader of whole files gives."""
    schema = "a string, b string, c string"
    for name, given in (("one.json", array_of(count)), ("two.json", array_of(count // 2))):
        (tmp_path / name).write_text(json.dumps(given, indent=indent, ensure_ascii=count % 2 == 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = files.read_json_array(spark, str(tmp_path), schema)
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        got = rows(found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == rows(spark.read.schema(schema).option("multiLine", True).json(str(tmp_path)))
    assert len(got) == count + count // 2 and (tasks > 5 or count < 300)


def test_an_upsert_rewrites_its_month_only(spark, tmp_path):
    path, bills = str(tmp_path / "bills"), bills_of_units(spark, 30)
    write_table(bills, S.BILL, path)
    before = files_below(path)
    month = bills.filter(F.col("Periodo") == F.lit(MONTHS[2]))
    new = month.withColumn("Pagos_Recibidos_Mes", F.lit(Decimal("7.00"))).filter("NroUF <> '3'").unionByName(
        month.filter("NroUF = '4'").withColumn("NroUF", F.lit("999"))
    )
    assert upsert_months(spark, S.BILL, path, new, S.BILL_KEY) == [MONTHS[2]]
    wanted = bills.join(new.select(*S.BILL_KEY), S.BILL_KEY, "left_anti").select(S.BILL.columns).unionByName(new)
    assert rows(read_table(spark, S.BILL, path)) == rows(wanted)
    after = files_below(path)
    part = f"Periodo={MONTHS[2]}"
    left = {f: t for f, t in before.items() if not f.startswith(part)}
    assert len(left) >= len(MONTHS) - 1 and {f: t for f, t in after.items() if not f.startswith(part)} == left
    scan = read_table(spark, S.BILL, path).filter(F.col("Periodo").isin([MONTHS[2]]))
    assert "PartitionFilters: [isnotnull(Periodo" in scan._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        upsert_months(spark, S.BILL, path, new, ["Id_Consorcio", "NroUF"])
    assert upsert_months(spark, S.BILL, path, new.limit(0), S.BILL_KEY) == []


def test_regenerated_settlements_replace_theirs_only(spark, tmp_path):
    path, bills = str(tmp_path / "bills"), bills_of_units(spark, 30)
    write_table(bills, S.BILL, path)
    before = files_below(path)
    first = bills.filter((F.col("Id_Consorcio") == 1) & (F.col("Periodo") == F.lit(MONTHS[0])))
    generated = first.filter("NroUF <> '0'").withColumn("Deuda", F.lit(Decimal("1.00")))
    assert replace_settlements(spark, S.BILL, path, generated) == [MONTHS[0]]
    assert rows(read_table(spark, S.BILL, path)) == rows(bills.exceptAll(first).unionByName(generated))
    part = f"Periodo={MONTHS[0]}"
    assert {f for f in files_below(path) if not f.startswith(part)} == {f for f in before if not f.startswith(part)}


def test_checks_read_every_table_once(spark, tmp_path):
    tables = {}
    for name, df in seed_tables(spark).items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    for name, table in S.TABLES.items():
        if name not in tables:
            spark.createDataFrame([], table.schema).write.parquet(str(tmp_path / name))
            tables[name] = spark.read.schema(table.schema).parquet(str(tmp_path / name))
    found = checks.check_tables(tables)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == len(S.TABLES) and "CartesianProduct" not in plan
    assert plan.count("Join") <= 1  # the list of rules with its counts
    assert all(r[3] == 0 for r in rows(found)) and found.count() == sum(
        1 + len(t.references) + len(t.required) + len(t.lengths) for t in S.TABLES.values()
    )


def test_values_of_composite_keys_are_not_confused(spark):
    units = spark.createDataFrame([(1, "23", *[None] * 8), (12, "3", *[None] * 8), (None, None, *[None] * 8), (None, None, *[None] * 8)], S.UNIT.schema)
    links = spark.createDataFrame([(1, 1, "23", None, None, None, None), (2, 12, "3", None, None, None, None), (3, 123, "", None, None, None, None), (4, 1, None, None, None, None, None), (5, 2, "23", None, None, None, None)], S.UNIT_PERSON.schema)
    found = {r[:3]: r[3] for r in rows(checks.check_tables({S.UNIT.name: units, S.UNIT_PERSON.name: links}))}
    assert found[(S.UNIT_PERSON.name, f"FOREIGN KEY {S.UNIT.name}", "Id_Consorcio, NroUF")] == 2
    assert found[(S.UNIT.name, "PRIMARY KEY", "Id_Consorcio, NroUF")] == 1


def test_secrets_stay_out_of_plans_and_event_logs(tmp_path):
    """A session of its own with an event log: neither explain() nor the log holds key or pepper in any form."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from prorrata.operators import privacy as P
from prorrata.schemas import PERSON
from prorrata.session import local_session
spark = local_session(2, 2, **{{"spark.eventLog.enabled": "true", "spark.eventLog.dir": {str(tmp_path)!r}, "spark.eventLog.compress": "false"}})
keys = P.Keys(b"0123456789abcdefghijklmnopqrstuv", "the-pepper-of-this-test")
persons = spark.createDataFrame([(1, "30", "ANA", "PAZ", None, "1", True, "C1"), (2, "31", "EVA", "PAZ", None, "1", True, "C2")], PERSON.schema)
stored = P.encrypt_persons(P.with_contact_index(persons, keys), keys)
opened = P.decrypt_persons(stored.join(stored.select(P.DOCUMENT_INDEX), P.DOCUMENT_INDEX), keys)
for df in (stored, opened):
    df.explain("extended"); df.explain("formatted"); df.explain("codegen")
assert sorted(r.DNI for r in opened.collect()) == ["30", "31"]
opened.explain("formatted")
print(opened._jdf.queryExecution().toString())
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]
    logs = "".join(p.read_text(errors="replace") for p in tmp_path.rglob("*") if p.is_file())
    assert len(logs) > 10_000 and "aes_encrypt" in done.stdout.lower()
    key = b"0123456789abcdefghijklmnopqrstuv"
    import base64

    for text in (done.stdout, logs):
        for secret in (key.decode(), key.hex(), key.hex().upper(), base64.b64encode(key).decode(), "the-pepper-of-this-test"):
            assert secret not in text
        assert " ".join(f"{b:02X}" for b in key[:6]) not in text
