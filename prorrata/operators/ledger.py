"""Running account of one unit: its bills, month by month, and the payments applied to them.

The order of payments decides how each later one splits, so a unit is worked
through in sequence; units do not touch each other. Amounts are whole cents;
shares of expenses are millionths of a currency unit, as they are rounded only
when a bill is issued. NULL amounts stay None.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa

from prorrata.seeds import ADVANCE, ON_TIME

# Kinds of row in and out of a unit's run.
BILL, STEP, PAYMENT, BLOCK, POSITION = 0, 1, 2, 3, 4
STATE, DETAIL, ASSIGNMENT, PENDING = 5, 6, 7, 8
# All bills of a unit in one row; those that the run issued; a block that will be needed after the pending one.
BOOK, ISSUED, ASKED = 9, 10, 11

AMOUNTS = [f"c{i}" for i in range(1, 8)]
# Numbers of a bill in a book: its month and its amounts.
BOOK_WIDTH = 1 + len(AMOUNTS)

# Blocks that a unit asks for at a time: fewer rounds, and never more than so many blocks of rows in a task.
BLOCKS_ASKED = 16

# Rows after which finished units are handed back to Spark; a book counts as so many.
BATCH_ROWS, BOOK_ROWS = 20_000, 50

# A balance of one cent or less counts as paid.
SMALLEST_DEBT = 1


def rounded(value: int, unit: int) -> int:
    """value / unit to the nearest integer, ties away from zero."""
    if value >= 0:
        return (2 * value + unit) // (2 * unit)
    return -((unit - 2 * value) // (2 * unit))


class Ledger:
    def __init__(self) -> None:
        self.months: list[int] = []
        self.carried: list = []
        self.paid: list = []
        self.debt: list = []
        self.interest: list = []
        self.ordinary: list = []
        self.extraordinary: list = []
        self.total: list = []
        self.own: list = []  # ordinary plus extraordinary
        self.issued: set[int] = set()
        self._search_from = 0
        self._dirty: int | None = None
        self._untouched = True  # no payment yet in the current step
        self._in_line = 1  # so many first bills would stay as they are if recalculated

    def columns(self) -> list[list]:
        return [self.carried, self.paid, self.debt, self.interest, self.ordinary, self.extraordinary, self.total]

    def load(self, numbers: list) -> None:
        """All bills of a book at once, into an empty ledger."""
        bills = sorted(zip(*[iter(numbers)] * BOOK_WIDTH), key=itemgetter(0))
        if not bills:
            return
        columns = [list(c) for c in zip(*bills)]
        self.months = columns[0]
        for before, month in zip(self.months, self.months[1:]):
            if before == month:
                raise ValueError(f"two bills of one unit for month {month // 12}-{month % 12 + 1:02d}")
        self.carried, self.paid, self.debt, self.interest, self.ordinary, self.extraordinary, self.total = columns[1:]
        self.own = [None if o is None or e is None else o + e for o, e in zip(self.ordinary, self.extraordinary)]

    def numbers(self, only_issued: bool = False) -> list:
        bills = zip(self.months, *self.columns())
        return list(chain.from_iterable(b for b in bills if not only_issued or b[0] in self.issued))

    def insert(self, month: int, amounts: list) -> None:
        months = self.months
        at = len(months) if not months or months[-1] < month else bisect_left(months, month)
        if at < len(months) and months[at] == month:
            raise ValueError(f"two bills of one unit for month {month // 12}-{month % 12 + 1:02d}")
        months.insert(at, month)
        for column, amount in zip(self.columns(), amounts):
            column.insert(at, amount)
        self._in_line = max(1, min(self._in_line, at))
        ordinary, extraordinary = amounts[4], amounts[5]
        self.own.insert(at, None if ordinary is None or extraordinary is None else ordinary + extraordinary)

    def issue(self, month: int, ordinary: int | None, extraordinary: int | None) -> None:
        """Bill of *month* from unrounded shares plus the balance of the month before."""
        months = self.months
        rest, last = 0, months[-1] if months else month - 1
        before = len(months) - 1 if last == month - 1 else bisect_left(months, month - 1)
        if 0 <= before < len(months) and months[before] == month - 1:
            total, paid = self.total[before], self.paid[before]
            rest = 0 if total is None or paid is None else total - paid
        self.issued.add(month)
        total = None
        if ordinary is not None and extraordinary is not None:
            total = rounded(rest * 10_500 + ordinary + extraordinary, 10_000)
        if ordinary is not None:
            ordinary = rounded(ordinary, 10_000)
        if extraordinary is not None:
            extraordinary = rounded(extraordinary, 10_000)
        interest = rounded(rest * 5, 100)
        if months and last >= month:
            self.insert(month, [rest, 0, rest, interest, ordinary, extraordinary, total])
            return
        # Almost always the latest month.
        months.append(month)
        self.carried.append(rest)
        self.paid.append(0)
        self.debt.append(rest)
        self.interest.append(interest)
        self.ordinary.append(ordinary)
        self.extraordinary.append(extraordinary)
        self.total.append(total)
        self.own.append(None if ordinary is None or extraordinary is None else ordinary + extraordinary)

    def begin_step(self) -> None:
        self.settle()
        self._untouched = True
        self._search_from = 0

    def resume_step(self) -> None:
        """Go on in a step whose first payments have been applied already."""
        self._untouched = False

    def balance(self, i: int) -> int:
        total, paid = self.total[i], self.paid[i]
        return 0 if total is None or paid is None else total - paid

    def oldest_open(self) -> int | None:
        """First bill with a balance. Payments only lower balances, so the search never goes back."""
        i, count = self._search_from, len(self.months)
        while i < count and self.balance(i) <= SMALLEST_DEBT:
            i += 1
        self._search_from = i
        return i if i < count else None

    def _carry_out(self, i: int) -> int | None:
        total, paid = self.total[i], self.paid[i]
        if i == 0:
            return None if total is None or paid is None else total - paid
        carry, own = self.carried[i], self.own[i]
        if carry is None or own is None or paid is None:
            return None
        return rounded(100 * (carry + own - paid) + (5 * carry if carry > 0 else 0), 100)

    def recalculate(self, changed: int, everything: bool = False) -> None:
        """Carry balances forward from bill *changed* to the last one.

        The total and the balance passed on are each rounded from the exact
        value, which is kept here in hundredths of a cent.
        """
        carried, paid, debt, interest, own, total = (
            self.carried, self.paid, self.debt, self.interest, self.own, self.total
        )
        carry = self._carry_out(changed)
        if everything and changed < self._in_line:
            self._in_line = len(carried)
        for i in range(changed + 1, len(carried)):
            if not everything and carried[i] == carry:
                return
            carried[i] = carry
            late = 0
            if carry is not None and carry > 0:
                late = 5 * carry
                interest[i], debt[i] = (late + 50) // 100, carry
            else:
                interest[i] = debt[i] = 0
            if carry is None or own[i] is None:
                total[i] = carry = None
                continue
            exact = 100 * (carry + own[i]) + late
            total[i] = now = (exact + 50) // 100 if exact >= 0 else -((50 - exact) // 100)
            given = paid[i]
            if given is None:
                carry = None
            else:
                # Whole cents were paid, so the balance differs from the rounded total only where its sign turns the tie.
                carry = now - given if (exact >= 0) == (exact >= 100 * given) else rounded(exact - 100 * given, 100)

    def settle(self) -> None:
        if self._dirty is not None:
            self.recalculate(self._dirty)
            self._dirty = None

    def _credit(self, i: int, cents: int) -> None:
        if self.paid[i] is not None:
            self.paid[i] += cents
        self._dirty = i if self._dirty is None else min(i, self._dirty)

    def pay(self, cents: int) -> list[tuple[int, int, int]]:
        """Apply one payment; returns (bill, income type, cents) in order.

        Within a payment later totals still hold the debt it has just paid.
        """
        self.settle()
        applied = []
        while cents > 0 and self.months:
            bill = self.oldest_open()
            if bill is None:
                bill, use, kind = len(self.months) - 1, cents, ADVANCE
            else:
                use, kind = min(cents, self.balance(bill)), ON_TIME
            self._credit(bill, use)
            applied.append((bill, kind, use))
            cents -= use
        if self._untouched:
            # The first payment of a step also brings freshly issued bills in line. Those before the
            # first one that was paid, as far as they are in line, would be made anew as they are.
            start = self._in_line - 1 if self._dirty is None else min(self._dirty, self._in_line - 1)
            self._untouched, self._dirty, self._search_from = False, None, 0
            if self.months:
                self.recalculate(start, everything=True)
        return applied

    def pay_in_order(self, ids: list[int], cents: list[int], out: Output) -> None:
        """Apply payments one after the other.

        Payments that fit whole into the oldest open bill are found by binary
        search over the running total and credited together.
        """
        count, at, running = len(ids), 0, None
        while at < count:
            if not self._untouched:
                self.settle()
                bill = self.oldest_open()
                if bill is None:
                    if self.months:
                        last = len(self.months) - 1
                        out.whole(ids, cents, at, count, self.months[last], ADVANCE)
                        self._credit(last, sum(c for c in cents[at:] if c > 0))
                    return
                if running is None:
                    running = list(accumulate(max(c, 0) for c in cents))
                base = running[at - 1] if at else 0
                fits = bisect_left(running, base + self.balance(bill) - SMALLEST_DEBT, at)
                if fits > at:
                    out.whole(ids, cents, at, fits, self.months[bill], ON_TIME)
                    self._credit(bill, running[fits - 1] - base)
                    at = fits
                    continue
            for sequence, (bill, kind, use) in enumerate(self.pay(cents[at]), 1):
                out.detail(ids[at], sequence, self.months[bill], kind, use)
            at += 1

    def pay_together(self, cents: int) -> tuple[int, int] | None:
        """Credit a block of payments known only by its sum.

        Returns (month, income type), or None when some payment of the block
        may have to be split, so that its payments are needed one by one.
        """
        if self._untouched:
            return None
        self.settle()
        bill, kind = self.oldest_open(), ON_TIME
        if bill is None:
            bill, kind = len(self.months) - 1, ADVANCE
        elif cents >= self.balance(bill) - SMALLEST_DEBT:
            return None
        self._credit(bill, cents)
        return self.months[bill], kind


class Output:
    """Result rows, column by column, of the units worked through so far."""

    def __init__(self) -> None:
        self.building: list[int] = []
        self.unit: list[str] = []
        self.kind: list[int] = []
        self.month: list[int] = []
        self.id: list = []
        self.sequence: list = []
        self.income: list = []
        self.block: list = []
        self.amounts: list[list] = [[] for _ in AMOUNTS]
        self.books: dict[int, list] = {}  # by row

    def _row(self, kind: int, month: int, row_id=None, sequence=None, income=None, block=None) -> None:
        self.kind.append(kind)
        self.month.append(month)
        self.id.append(row_id)
        self.sequence.append(sequence)
        self.income.append(income)
        self.block.append(block)

    def detail(self, payment: int, sequence: int, month: int, income: int, cents: int) -> None:
        self._row(DETAIL, month, payment, sequence, income)
        self._amount(cents)

    def whole(self, ids: list, cents: list, start: int, end: int, month: int, income: int) -> None:
        for i in range(start, end):
            if cents[i] > 0:
                self.detail(ids[i], 1, month, income, cents[i])

    def assignment(self, month: int, block_month: int, block: int, income: int) -> None:
        self._row(ASSIGNMENT, month, block_month, None, income, block)
        self._amount(None)

    def pending(self, month: int, block: int, step: int) -> None:
        self._row(PENDING, month, None, step, None, block)
        self._amount(None)

    def asked(self, month: int, block: int) -> None:
        self._row(ASKED, month, block=block)
        self._amount(None)

    def book(self, kind: int, numbers: list) -> None:
        if numbers:
            self.books[len(self.kind)] = numbers
            self._row(kind, 0)
            self._amount(None)

    def _amount(self, cents: int | None) -> None:
        self.amounts[0].append(cents)
        for column in self.amounts[1:]:
            column.append(None)

    def bills(self, ledger: Ledger, kind: int) -> None:
        size = len(ledger.months)
        self.kind += [kind] * size
        self.month += ledger.months
        for column in (self.id, self.sequence, self.income, self.block):
            column += [None] * size
        for column, values in zip(self.amounts, ledger.columns()):
            column.extend(values)

    def end_unit(self, building: int, unit: str) -> None:
        size = len(self.kind) - len(self.building)
        self.building += [building] * size
        self.unit += [unit] * size

    def _book_column(self) -> pa.Array:
        sizes = np.zeros(len(self.kind) + 1, dtype=np.int32)
        for row, numbers in self.books.items():
            sizes[row + 1] = len(numbers)
        values = pa.array(list(chain.from_iterable(self.books.values())), pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.building, pa.int32()),
                pa.array(self.unit, pa.string()),
                pa.array(self.kind, pa.int32()),
                pa.array(self.month, pa.int32()),
                pa.array(self.id, pa.int64()),
                pa.array(self.sequence, pa.int32()),
                pa.array(self.income, pa.int32()),
                pa.array(self.block, pa.int64()),
                *[pa.array(column, pa.int64()) for column in self.amounts],
                self._book_column(),
            ],
            names=["Id_Consorcio", "NroUF", "kind", "month", "id", "sequence", "income", "block", *AMOUNTS, "book"],
        )


def _values(column: pa.Array) -> list:
    if pa.types.is_list(column.type) and not column.flatten().null_count:
        values, ends = column.flatten().to_numpy().tolist(), column.offsets.to_numpy().tolist()
        first = ends[0] if ends else 0
        return [values[a - first : b - first] for a, b in zip(ends, ends[1:])]
    if column.null_count or pa.types.is_string(column.type) or pa.types.is_list(column.type):
        return column.to_pylist()
    return column.to_numpy().tolist()  # much faster than value by value


# How a row of payments in blocks is read: in the first run, as its block's sum, or when its block is asked for.
NOW, SUM, LATER = "now", "sum", "later"

_BLOCK_BITS = 40  # blocks of a range; 2**23 ranges fit above them


def cut_blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Payments of a range, sorted by unit, day and id, in blocks.

    A block is a run of one unit and month inside a batch. Its first payment
    travels by itself, because the first payment of a step realigns the bills. Of
    the others, up to *block_rows* travel as they are, more as a sum, and their
    rows wait until they are asked for. Block numbers follow the order of payments.
    """
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = {name: batch.column(name) for name in batch.schema.names}
        building, month = column["Id_Consorcio"].to_numpy(), column["month"].to_numpy()
        unit = column["NroUF"].to_numpy(zero_copy_only=False)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (building[1:] != building[:-1]) | (unit[1:] != unit[:-1]) | (month[1:] != month[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, batch.num_rows))
        first = (int(column["range"][0].as_py()) << _BLOCK_BITS) + number + 2 * np.arange(len(starts), dtype=np.int64)
        number += 2 * len(starts)
        waits = np.repeat(sizes - 1 > block_rows, sizes)
        waits[starts] = False
        block = np.repeat(first, sizes) + waits
        long = np.flatnonzero(sizes - 1 > block_rows)
        cents = column["c1"].fill_null(0).to_numpy()
        sums = np.add.reduceat(np.where(waits, np.maximum(cents, 0), 0), starts)[long]
        heads = pa.array(starts[long])
        rows = {name: column[name] for name in ("Id_Consorcio", "NroUF", "month", "day", "id", "c1")}
        rows |= {"kind": pa.array(np.full(batch.num_rows, PAYMENT, dtype=np.int32)), "block": pa.array(block)}
        rows["read"] = pa.array(np.where(waits, LATER, NOW).astype(object), pa.string())
        yield pa.RecordBatch.from_arrays([rows[n] for n in BLOCK_COLUMNS], names=BLOCK_COLUMNS)
        if len(long):
            summed = {name: column[name].take(heads) for name in ("Id_Consorcio", "NroUF", "month")}
            zeros = np.zeros(len(long), dtype=np.int64)
            summed |= {"day": pa.array(zeros.astype(np.int32)), "id": pa.array(zeros), "c1": pa.array(sums)}
            summed |= {"kind": pa.array(np.full(len(long), BLOCK, dtype=np.int32)), "block": pa.array(first[long] + 1)}
            summed["read"] = pa.array([SUM] * len(long))
            yield pa.RecordBatch.from_arrays([summed[n] for n in BLOCK_COLUMNS], names=BLOCK_COLUMNS)


BLOCK_COLUMNS = ["Id_Consorcio", "NroUF", "kind", "month", "day", "id", "block", "c1", "read"]


def run_units(batches: Iterator[pa.RecordBatch], books: bool = False) -> Iterator[pa.RecordBatch]:
    """Work through a partition sorted by unit and month, one unit at a time.

    Bills leave as a row each or, with *books*, as one row per unit: all of them
    if the unit has payments, else only those that the run has issued.
    """
    current, rows, out = None, {}, Output()
    for batch in batches:
        columns = {name: _values(batch.column(name)) for name in batch.schema.names}
        buildings, units = columns["Id_Consorcio"], columns["NroUF"]
        start, count = 0, batch.num_rows
        while start < count:
            unit = (buildings[start], units[start])
            end = start + 1
            while end < count and units[end] == unit[1] and buildings[end] == unit[0]:
                end += 1
            part = {name: values[start:end] for name, values in columns.items()}
            if unit == current:
                for name, values in part.items():
                    rows[name] += values
            else:
                if current is not None:
                    run_unit(rows, out, books)
                    out.end_unit(*current)
                    if len(out.kind) + BOOK_ROWS * len(out.books) >= BATCH_ROWS:
                        yield out.batch()
                        out = Output()
                current, rows = unit, part
            start = end
    if current is not None:
        run_unit(rows, out, books)
        out.end_unit(*current)
        yield out.batch()


def run_unit(rows: dict[str, list], out: Output, books: bool = False) -> None:
    """Work one unit through its steps.

    A step optionally issues a bill and then applies the payments up to its
    month. Payments come in blocks: with their rows, or as a sum only. Without
    any step row all payments belong to one step. The run stops, and says
    which block it needs, when a sum is not enough; it resumes there when it is
    given the state it had and that block's rows.
    """
    ledger = Ledger()
    steps, sums, payments, resume = [], {}, {}, (0, None)
    months, amounts = rows["month"], [rows[name] for name in AMOUNTS]
    kinds = rows["kind"]
    for i, (kind, month, block) in enumerate(zip(kinds, months, rows["block"])):
        if kind == BILL:
            ledger.insert(month, [column[i] for column in amounts])
        elif kind == BOOK:
            ledger.load(rows["steps"][i])
        elif kind == STEP:
            numbers = rows["steps"][i]
            steps += zip(numbers[::4], numbers[1::4], numbers[2::4], numbers[3::4])
        elif kind == PAYMENT:
            payments.setdefault((month, block), []).append((rows["day"][i], rows["id"][i], amounts[0][i] or 0))
        elif kind == BLOCK:
            sums[(month, block)] = amounts[0][i]
        else:
            resume = (rows["id"][i], (month, block))
    blocks = sorted(sums.keys() | payments.keys())
    steps = sorted(steps) or [(blocks[-1][0] if blocks else 0, 0, None, None)]

    next_block = 0
    for number, (month, issues, ordinary, extraordinary) in enumerate(steps):
        if number > resume[0] or resume[1] is None:
            ledger.begin_step()
            if issues:
                ledger.issue(month, ordinary, extraordinary)
        else:
            ledger.resume_step()
        while next_block < len(blocks) and blocks[next_block][0] <= month:
            block = blocks[next_block]
            if resume[1] is not None and block < resume[1]:
                next_block += 1
                continue
            if block in payments:
                ordered = sorted(payments[block])
                ledger.pay_in_order([p[1] for p in ordered], [p[2] for p in ordered], out)
            elif sums[block] > 0 and ledger.months:
                assigned = ledger.pay_together(sums[block])
                if assigned is None:
                    ledger.settle()
                    if books:
                        out.book(STATE, ledger.numbers())
                    else:
                        out.bills(ledger, STATE)
                    out.pending(block[0], block[1], number)
                    for later in [b for b in blocks[next_block + 1 :] if b not in payments][: BLOCKS_ASKED - 1]:
                        out.asked(*later)
                    return
                out.assignment(assigned[0], block[0], block[1], assigned[1])
            next_block += 1
    ledger.settle()
    if not books:
        out.bills(ledger, BILL)
    elif blocks:
        out.book(BOOK, ledger.numbers())
    else:
        out.book(ISSUED, ledger.numbers(only_issued=True))
