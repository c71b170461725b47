"""Integrity checks: keys, references, mandatory columns and lengths, all tables in one pass.

Every row of a table gives a tuple for its key, one for each of its references,
and one for each row rule that it breaks. A key and all references to it are one
domain. The tuples of all tables are counted by domain and value in one shuffle,
behind a partial count in the map tasks; a value's counts tell at once whether
the key is repeated and which references to it point nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prorrata.schemas import TABLES, Table

_RESULT = ["tabla", "regla", "columnas", "filas"]
_ROW_RULE = -1  # domain of broken row rules; their value is the rule's number


def _value(columns: tuple[str, ...]) -> Column:
    """The columns as one text; different values never read alike, and NULL is a value of its own."""
    parts = []
    for column in columns:
        text = F.col(column).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def _tuple(domain: int, source: int, value: Column, when: Column | None = None) -> Column:
    made = F.struct(F.lit(domain).alias("dominio"), F.lit(source).alias("fuente"), value.alias("valor"))
    return made if when is None else F.when(when, made)


def _missing(df: DataFrame, table: Table, tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """A violation for every column that a rule needs and the table lacks, and for every referenced table that is not there."""
    needed = dict.fromkeys([*table.key, *table.required, *table.lengths, *(c for r in table.references for c in r.columns)])
    found = [("MISSING COLUMN", c) for c in needed if c not in df.columns]
    return found + [(f"MISSING TABLE {r.table}", ", ".join(r.columns)) for r in table.references if r.table not in tables]


class _Plan:
    """The tuples that each table gives, and where the count of each rule is found."""

    def __init__(self) -> None:
        self.domains: dict[tuple, int] = {}  # (table, columns) to number
        self.sources: dict[int, int] = {}  # references to a domain so far
        self.tuples: dict[str, list[Column]] = {}
        self.rules: list[tuple] = []  # tabla, regla, columnas, dominio, fuente, fixed number of rows
        self.row_rules = 0

    def domain(self, name: str, columns: tuple[str, ...]) -> int:
        if (name, columns) not in self.domains:
            number = self.domains[name, columns] = len(self.domains)
            self.sources[number] = 0
            self.tuples.setdefault(name, []).append(_tuple(number, 0, _value(columns)))
        return self.domains[name, columns]

    def rule(self, table: Table, rule: str, columns: tuple[str, ...], domain: int = 0, source: int = 0, fixed: int | None = None) -> None:
        self.rules.append((table.name, rule, ", ".join(columns), domain, source, fixed))

    def add(self, table: Table, df: DataFrame, tables: dict[str, DataFrame]) -> None:
        if all(c in df.columns for c in table.key):
            self.rule(table, "PRIMARY KEY", table.key, self.domain(table.name, table.key))
        for reference in table.references:
            target = tables.get(reference.table)
            if target is None or not set(reference.columns) <= set(df.columns) or not set(reference.target) <= set(target.columns):
                continue
            number = self.domain(reference.table, reference.target)
            self.sources[number] += 1
            given = reduce(Column.__and__, [F.col(c).isNotNull() for c in reference.columns])
            self.tuples.setdefault(table.name, []).append(_tuple(number, self.sources[number], _value(reference.columns), given))
            self.rule(table, f"FOREIGN KEY {reference.table}", reference.columns, number, self.sources[number])
        broken = [("NOT NULL", c, F.col(c).isNull()) for c in table.required if c in df.columns]
        broken += [("LENGTH", c, F.length(c) > size) for c, size in table.lengths.items() if c in df.columns]
        for rule, column, when in broken:
            self.row_rules += 1
            self.tuples.setdefault(table.name, []).append(_tuple(_ROW_RULE, 0, F.lit(str(self.row_rules)), when))
            self.rule(table, rule, (column,), _ROW_RULE, self.row_rules)
        for rule, columns in _missing(df, table, tables):
            self.rule(table, rule, (columns,), fixed=1)


def check_tables(tables: dict[str, DataFrame], only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per rule of the tables (or of *only* some of them) with the number of violations.

    A key counts once however often it is repeated; a reference counts every row
    that points nowhere, rows with a NULL in it excepted. A rule that cannot be
    checked is a violation of its own, not silence. Every table is read once.
    """
    plan = _Plan()
    for name in tables if only is None else only:
        plan.add(TABLES[name], tables[name], tables)
    spark = next(iter(tables.values())).sparkSession
    rules = spark.createDataFrame(plan.rules, "tabla string, regla string, columnas string, dominio int, fuente int, fijo long")
    # A filter after the generator compiles; `array_compact` would be interpreted row by row.
    given = [tables[name].select(F.inline(F.array(*made))).filter(F.col("dominio").isNotNull()) for name, made in plan.tuples.items()]
    if not given:
        return rules.select("tabla", "regla", "columnas", F.col("fijo").alias("filas"))
    most = max([0, *plan.sources.values()])
    counts = reduce(DataFrame.unionByName, given).groupBy("dominio", "valor").agg(
        *[F.count_if(F.col("fuente") == source).alias(f"n{source}") for source in range(most + 1)]
    )
    key = F.col("dominio") != _ROW_RULE
    lost = [F.sum(F.when(key & (F.col("n0") == 0), F.col(f"n{s}"))).alias(f"r{s}") for s in range(1, most + 1)]
    repeated = F.count_if(F.when(key, F.col("n0") > 1).otherwise(True)).alias("r0")
    # Row rules keep a row each: their value stands for the source.
    source = F.when(key, F.lit(0)).otherwise(F.col("valor").try_cast("int"))
    by_domain = counts.groupBy("dominio", source.alias("regla_fila")).agg(repeated, F.sum("n0").alias("filas_regla"), *lost)
    entries = [F.struct(F.lit(s).alias("fuente"), F.coalesce(f"r{s}", F.lit(0)).alias("filas")) for s in range(most + 1)]
    row_entry = F.array(F.struct(F.col("regla_fila").alias("fuente"), F.col("filas_regla").alias("filas")))
    found = by_domain.select("dominio", F.inline(F.when(key, F.array(*entries)).otherwise(row_entry)))
    return rules.join(found, ["dominio", "fuente"], "left").select(
        "tabla", "regla", "columnas", F.coalesce("fijo", "filas", F.lit(0)).cast("bigint").alias("filas")
    )


def check_table(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rules of one table."""
    return check_tables(tables, (name,))
