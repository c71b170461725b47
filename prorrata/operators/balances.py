"""Balances carried through the months of all units of a batch, one numpy step per month.

Amounts are whole cents; within a step the total and the balance passed on are
each rounded from the exact value, in hundredths of a cent. NULL amounts are masked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INPUT = ["carried", "paid", "debt", "interest", "own", "total"]  # in cents; own: ordinary plus extraordinary
OUTPUT = ["carried", "debt", "interest", "total"]

# With amounts up to this a step stays within 64 bits; beyond it Python's integers take over.
_LARGE = 1 << 55


def _half_away(value: np.ndarray) -> np.ndarray:
    """value / 100 to the nearest integer, ties away from zero."""
    return np.where(value >= 0, (value + 50) // 100, -((50 - value) // 100))


class Carry:
    """The balance that the last unit of a batch takes into the next one."""

    def __init__(self) -> None:
        self.unit: tuple | None = None
        self.value, self.known = 0, False


def carry_forward(starts: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray], before: Carry, continues: bool):
    """New amounts of rows that are sorted by unit and month; *starts* are the first rows of the units.

    The first month of a unit stays as it is, unless the unit *continues* from
    the batch before. Steps are as many as the longest unit has months; the units
    that are still running take each step together. Leaves in *before* the balance
    of the last unit.
    """
    count = len(values["own"])
    ends = np.append(starts[1:], count)
    result = {name: values[name].copy() for name in OUTPUT}
    shown = {name: known[name].copy() for name in OUTPUT}
    first = starts.copy()
    carry = values["total"][first] - values["paid"][first]
    if continues and isinstance(before.value, int):
        carry = carry.astype(object)
    fine = known["total"][first] & known["paid"][first]
    at = first + 1
    if continues:
        carry[0], fine[0], at[0] = before.value, before.known, starts[0]
    running = np.arange(len(starts))
    small = max(np.abs(v).max() for v in (*values.values(), carry)) <= _LARGE
    while True:
        if carry.dtype != object and not small:
            values, result = ({k: v.astype(object) for k, v in x.items()} for x in (values, result))
            carry = carry.astype(object)
        running = running[at[running] < ends[running]]
        if not len(running):
            break
        row, given, is_known = at[running], carry[running], fine[running]
        late = np.where(is_known & (given > 0), 5 * given, 0)
        exact = 100 * (given + values["own"][row]) + late
        has_total = is_known & known["own"][row]
        result["carried"][row], shown["carried"][row] = given, is_known
        result["debt"][row], shown["debt"][row] = np.where(late > 0, given, 0), True
        result["interest"][row], shown["interest"][row] = (late + 50) // 100, True
        result["total"][row], shown["total"][row] = _half_away(exact), has_total
        carry[running] = _half_away(exact - 100 * values["paid"][row])
        small = small and np.abs(carry[running]).max() <= _LARGE
        fine[running] = has_total & known["paid"][row]
        at[running] += 1
    before.value, before.known = carry[-1], bool(fine[-1])
    return result, shown


def recalculated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bills sorted by unit and month, with carried amounts made anew. A unit may spread over batches."""
    before = Carry()
    for batch in batches:
        if not batch.num_rows:
            continue
        building = batch.column("Id_Consorcio").to_numpy(zero_copy_only=False)
        unit = batch.column("NroUF").to_numpy(zero_copy_only=False)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (building[1:] != building[:-1]) | (unit[1:] != unit[:-1])
        columns = {name: batch.column(name) for name in INPUT if name != "own"}
        # Both parts are below 10^18 cents, so their sum stays within 64 bits.
        columns["own"] = (
            batch.column("own") if "own" in batch.schema.names else pc.add(batch.column("ordinary"), batch.column("extraordinary"))
        )
        known = {name: c.is_valid().to_numpy(zero_copy_only=False) for name, c in columns.items()}
        values = {name: c.fill_null(0).to_numpy() for name, c in columns.items()}
        continues = before.unit == (building[0], unit[0])
        result, shown = carry_forward(np.flatnonzero(new), values, known, before, continues)
        before.unit = (building[-1], unit[-1])
        made = {name: pa.array(result[name], type=pa.int64(), mask=~shown[name]) for name in OUTPUT}
        yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)
