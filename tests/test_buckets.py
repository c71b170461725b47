"""Facts stored by unit: equal rows without a shuffle of the facts, new months, other catalogs, hot units."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prorrata.operators import allocation as A, billing as B, reports as R
from prorrata.plans.adapter import Domain
from prorrata.plans.queries import QUERIES
from prorrata.schemas import BILL, BILL_KEY, UNIT_KEY
from prorrata.sources.buckets import add_to_buckets, open_buckets, store_buckets
from prorrata.sources.workarea import new_folder
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"
BUCKETS = 6
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="generated tables not present")


def _stored(spark, df, kind, keys=UNIT_KEY):
    return store_buckets(df, f"t_{kind}_{uuid.uuid4().hex}", new_folder(spark, kind), BUCKETS, keys)


@pytest.fixture(scope="module")
def facts(spark):
    d = Domain(spark, FOLDER)
    return {
        "d": d,
        "bills": _stored(spark, d.bills, "bills"),
        "shares": _stored(spark, d.shares, "shares"),
        "units": _stored(spark, d.units, "units"),
        "applied": _stored(spark, R.collections(d.payments, d.details), "applied", BILL_KEY),
        "bills_by_bill": _stored(spark, d.bills, "bills_by_bill", BILL_KEY),
    }


@pytest.fixture
def no_broadcast(spark):
    """Plans as for facts that are too large to be sent."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_by(df) -> list[str]:
    """What the exchanges of the plan hash by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def _names(keys: str) -> list[str]:
    return [k.split("#")[0] for k in keys.split(", ")]


def test_shares_meet_balances_without_a_shuffle(spark, facts, no_broadcast):
    """The join is by unit and month, more than the buckets' keys."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(setting, "false")
    try:
        made = B.bills_of_shares(facts["shares"], facts["bills"])
        assert shuffled_by(made) == []
        assert rows(made) == rows(B.bills_of_shares(facts["d"].shares, facts["d"].bills))
    finally:
        spark.conf.unset(setting)


def test_balances_without_a_shuffle(facts):
    made = B.recalculate_balances(facts["bills"])
    assert shuffled_by(made) == []
    assert rows(made) == rows(B.recalculate_balances(facts["d"].bills))


def test_books_without_a_shuffle(facts):
    assert shuffled_by(A.books_of(facts["bills"])) == []


@pytest.mark.parametrize("report", [R.weekly_collection, R.collection_by_origin, R.payment_intervals])
@pytest.mark.parametrize("condominium", [None, 3])
def test_reports_shuffle_results_only(facts, no_broadcast, report, condominium):
    d = facts["d"]
    made = report(facts["applied"], None, facts["bills_by_bill"], *d.span, condominium=condominium)
    # The sums by bill, and their join, stay in the buckets; buildings and weeks, or days of units, come together afterwards.
    assert all("Periodo" not in _names(keys) for keys in shuffled_by(made))
    assert rows(made) == rows(report(d.payments, d.details, d.bills, *d.span, condominium=condominium))


def test_debtors_shuffle_people_only(facts, no_broadcast):
    d = facts["d"]
    made = R.top_debtors(facts["bills"], facts["units"], d.links, d.persons)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # One exchange by unit: that of the linked people; bills and units are read in their buckets.
    assert [_names(k) for k in shuffled_by(made)].count(list(UNIT_KEY)) == 1
    assert plan.count("Bucketed: true") >= 2
    assert rows(made) == rows(R.top_debtors(d.bills, d.units, d.links, d.persons))


def test_a_new_month_leaves_other_files(spark, facts):
    bills, last = facts["d"].bills, F.lit(facts["d"].months[1])
    name, path = f"t_months_{uuid.uuid4().hex}", new_folder(spark, "months")
    store_buckets(bills.filter(F.col("Periodo") < last), name, path, BUCKETS)
    before = {p.name: p.stat().st_mtime_ns for p in Path(path).glob("part-*")}
    grown = add_to_buckets(bills.filter(F.col("Periodo") == last), name, BUCKETS)
    after = {p.name: p.stat().st_mtime_ns for p in Path(path).glob("part-*")}
    assert rows(grown, *BILL.columns) == rows(bills, *BILL.columns)
    assert before.items() <= after.items() and len(before) <= BUCKETS and len(after) <= 2 * BUCKETS
    assert shuffled_by(B.recalculate_balances(grown)) == []


def test_known_again_by_another_catalog(spark, facts):
    name, path = f"t_first_{uuid.uuid4().hex}", new_folder(spark, "first")
    stored = store_buckets(facts["d"].bills, name, path, BUCKETS)
    again = open_buckets(spark, f"t_again_{uuid.uuid4().hex}", path, stored.schema, BUCKETS)
    assert rows(again) == rows(stored)
    assert shuffled_by(B.recalculate_balances(again)) == []


def test_a_hot_unit_is_a_row_per_bill_and_day(facts):
    d = facts["d"]
    hot = R.collections(d.payments.withColumn("Fecha", F.lit(d.span[0])), d.details)
    of_bill = hot.groupBy("Id_Consorcio", "NroUF", "Periodo").count()
    assert of_bill.filter("count > 1").isEmpty()
    assert hot.agg(F.sum("Pagos")).first()[0] == d.payments.join(d.details, "Id_Pago").count()


def test_empty_tables(spark, facts):
    d = facts["d"]
    none = _stored(spark, R.collections(d.payments.limit(0), d.details), "none", BILL_KEY)
    assert R.weekly_collection(none, None, facts["bills_by_bill"], *d.span).count() == 0
    assert R.payment_intervals(none, None, facts["bills_by_bill"], *d.span).count() == 0


def test_bills_are_not_shuffled_after_they_grow_to_months(spark, no_broadcast):
    """What was paid goes with the unit, so no exchange lies above the step that makes a row per month."""
    d = Domain(spark, FOLDER)
    for bills in (d.bills, d.unpaid_bills):
        plan = bills._jdf.queryExecution().executedPlan().toString()
        above, generated, _ = plan.partition("Generate explode(meses")
        assert generated and "Exchange" not in above


def test_proration_shuffles_new_and_earlier_bills_once(spark, no_broadcast):
    made = QUERIES["o10_prorate_bills"](spark, FOLDER)
    # By bill: the shares, the earlier balances, and the sums of what was paid.
    assert [_names(k) for k in shuffled_by(made)].count(list(BILL_KEY)) == 3


def test_payments_without_day_or_bill_leave_the_bills(spark):
    d, odd = Domain(spark, FOLDER), Domain(spark, FOLDER)
    day = F.col("Fecha")
    odd.payments = d.payments.unionByName(d.payments.withColumn("Fecha", F.lit(None).cast("date"))).unionByName(
        d.payments.withColumn("Fecha", F.add_months(day, 1200))
    )
    assert rows(odd.bills) == rows(d.bills)
    none = Domain(spark, FOLDER)
    none.payments = d.payments.limit(0)
    assert rows(none.bills) == rows(none.unpaid_bills)
