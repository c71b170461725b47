"""Every registered query against its SQL, and independence from partitioning."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prorrata.operators.allocation import allocate_payments
from prorrata.plans.adapter import Domain
from prorrata.plans.oracle import oracle_queries, slow_oracle_queries
from prorrata.plans.queries import QUERIES
from tests.compare import compare, oracle_connection
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="generated tables not present")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


ORACLE = {**oracle_queries(), **slow_oracle_queries()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    verdict, _, count = compare(spark, connection, FOLDER, QUERIES[name], ORACLE[name])
    assert verdict == "equal" and count > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_one_account_with_a_third_of_all_payments(spark):
    """Splitting the hot unit into blocks, and any partitioning, give the same rows."""
    d = Domain(spark, FOLDER)
    hot = F.when(F.col("Id_Pago") % 3 == 0, F.lpad(F.lit("5"), 22, "0")).otherwise(F.col("Cuenta_Origen"))
    payments = d.payments.withColumn("Cuenta_Origen", hot)
    plain = allocate_payments(d.unpaid_bills, payments, d.persons, d.links, d.span[1])
    split = allocate_payments(
        d.unpaid_bills.repartition(5), payments.repartition(7), d.persons, d.links, d.span[1], block_rows=3
    )
    assert rows(plain.details) == rows(split.details)
    assert rows(plain.bills) == rows(split.bills)
    assert plain.payments.filter("not Procesado").count() == 0
