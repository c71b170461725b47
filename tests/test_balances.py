"""The vectorised recurrence against one unit at a time over decimals."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
import pytest

from prorrata.operators import balances
from prorrata.operators.billing import recalculate_balances
from prorrata.schemas import BILL
from tests.conftest import rows

CENT = Decimal("0.01")
MONTHS = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(40)]


def D(value):
    return None if value is None else Decimal(value).quantize(CENT, ROUND_HALF_UP)


def plain(bills):
    """The recurrence as it is defined, for the bills of one unit in order of months."""
    found, carry = [], None
    for place, (c, u, month, carried, paid, debt, interest, ordinary, extra, total) in enumerate(bills):
        if place:
            carried, late = carry, Decimal(0)
            if carry is not None and carry > 0:
                late = carry * Decimal("0.05")
            exact = None if carry is None or ordinary is None or extra is None else carry + late + ordinary + extra
            debt, interest, total = (carry if late else D(0)), D(late), D(exact)
        else:
            exact = total
        carry = None if exact is None or paid is None else D(exact - paid)
        found.append((c, u, month, D(carried), paid, D(debt), D(interest), ordinary, extra, total))
    return found


def units(seed):
    rng = random.Random(seed)

    def amount(nullable=True):
        return None if nullable and rng.random() < 0.03 else D(rng.choice(["0", "0.01", "0.1", "333.33", "-5.05", "1000", str(rng.randint(0, 10**6) / 100)]))

    given = []
    for u in range(30):
        months = sorted(rng.sample(MONTHS, rng.choice([1, 2, 5, 40])))
        given.append([(1 + u % 2, str(u), m, amount(), amount(u % 3 > 0), amount(), amount(), amount(u % 3 > 0), D("1.10"), amount()) for m in months])
    return given


@pytest.mark.parametrize("seed", [1, 2])
def test_recalculation_equals_the_plain_recurrence(spark, seed):
    given = units(seed)
    found = recalculate_balances(spark.createDataFrame([b for unit in given for b in unit], BILL.schema).repartition(3))
    assert rows(found) == rows(spark.createDataFrame([b for unit in given for b in plain(unit)], BILL.schema))
    assert found.schema == BILL.schema or [f.dataType for f in found.schema] == [f.dataType for f in BILL.schema]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_units_spread_over_batches(size):
    """Any cut into batches, also inside a unit, gives the same rows; so do amounts beyond 64 bits within a step."""
    for scale in (1, 10**10):
        given = [b for unit in units(3) for b in unit]
        place = {"carried": 3, "paid": 4, "debt": 5, "interest": 6, "total": 9}

        def cents(value):
            return None if value is None else int(value * 100) * scale

        columns = {n: [cents(b[i]) for b in given] for n, i in place.items()}
        columns["own"] = [None if b[7] is None else cents(b[7] + b[8]) for b in given]
        table = pa.table({"Id_Consorcio": [b[0] for b in given], "NroUF": [b[1] for b in given], **{n: pa.array(c, pa.int64()) for n, c in columns.items()}})
        whole = pa.Table.from_batches(balances.recalculated(iter(table.to_batches())))
        parts = pa.Table.from_batches(balances.recalculated(iter(table.to_batches(max_chunksize=size))))
        assert parts.to_pylist() == whole.to_pylist()
        if scale == 1:
            wanted = [b for unit in units(3) for b in plain(unit)]
            assert whole.column("total").to_pylist() == [cents(b[9]) for b in wanted]
            assert whole.column("carried").to_pylist() == [cents(b[3]) for b in wanted]


def test_the_step_adds_up_the_parts_of_a_bill():
    """Batches hold the two parts only; largest amounts and unknown ones give what their sum gives."""
    most = 10**18 - 1
    parts = [(most, most), (-most, -most), (None, 5), (5, None), (None, None), (7, -3)]
    columns = {
        "Id_Consorcio": [1] * len(parts), "NroUF": [str(i // 2) for i in range(len(parts))],
        **{n: pa.array([i * 10 for i in range(len(parts))], pa.int64()) for n in ("carried", "paid", "debt", "interest", "total")},
        "ordinary": pa.array([o for o, _ in parts], pa.int64()), "extraordinary": pa.array([e for _, e in parts], pa.int64()),
    }
    given = pa.table(columns)
    own = pa.array([None if None in p else sum(p) for p in parts], pa.int64())
    with_sum = balances.recalculated(iter(given.append_column("own", own).to_batches()))
    found = pa.Table.from_batches(balances.recalculated(iter(given.to_batches())))
    assert found.to_pylist() == pa.Table.from_batches(with_sum).drop_columns("own").to_pylist()
