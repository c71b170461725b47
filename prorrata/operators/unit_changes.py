"""Validated changes to units, many at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from prorrata.schemas import UNIT, UNIT_KEY

_SPOT = ["Id_Consorcio", "Piso", "Departamento"]
_VALUES = [c for c in UNIT.columns if c not in UNIT_KEY]

# First rule that fails is the reason.
MISSING, EMPTY, TAKEN, COEFFICIENT, AREA = (
    "unit does not exist",
    "floor or department empty",
    "floor and department belong to another unit",
    "coefficient not positive",
    "area not positive",
)


@dataclass(frozen=True)
class UnitChanges:
    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def change_units(changes: DataFrame, units: DataFrame, ordinal: str = "ordinal") -> UnitChanges:
    """*changes* has the columns of a unit plus an ordinal.

    A floor and department must not belong to another unit, neither in the
    table as it was nor through an earlier valid change of the batch. Of
    several accepted changes to one unit the last one stands.
    """
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("Baulera", "Cochera")}
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("Piso", "Departamento")}
    cleaned = changes.withColumns({**flag, **text}).withColumnRenamed(ordinal, "ordinal")

    # How many units hold a spot, and one of them: enough to tell whether another unit does.
    holders = units.groupBy(*_SPOT).agg(F.min("NroUF").alias("first_holder"), F.max("NroUF").alias("last_holder"))
    known = units.select(*UNIT_KEY).withColumn("exists", F.lit(True))
    other = (F.col("first_holder") != F.col("NroUF")) | (F.col("last_holder") != F.col("NroUF"))
    checked = (
        cleaned.join(known, UNIT_KEY, "left")
        .join(holders, _SPOT, "left")
        .withColumn(
            "reason",
            F.when(F.col("exists").isNull(), MISSING)
            .when((F.col("Piso") == "") | (F.col("Departamento") == ""), EMPTY)
            .when(F.coalesce(other, F.lit(False)), TAKEN)
            .when(F.col("Coeficiente") <= 0, COEFFICIENT)
            .when(F.col("M2_UF") <= 0, AREA),
        )
        .drop("exists", "first_holder", "last_holder")
    )
    claims = (
        checked.filter(F.col("reason").isNull())
        .groupBy(*_SPOT)
        .agg(F.min(F.struct("ordinal", "NroUF")).alias("claim"))
    )
    later = (F.col("claim.ordinal") < F.col("ordinal")) & (F.col("claim.NroUF") != F.col("NroUF"))
    decided = (
        checked.join(claims, _SPOT, "left")
        .withColumn(
            "reason",
            F.when(F.col("reason").isin(MISSING, EMPTY, TAKEN), F.col("reason"))
            .when(F.coalesce(later, F.lit(False)), TAKEN)
            .otherwise(F.col("reason")),
        )
        .select("ordinal", *UNIT.columns, "reason")
    )
    accepted = decided.filter(F.col("reason").isNull()).drop("reason")
    last = accepted.groupBy(*UNIT_KEY).agg(F.max_by(F.struct(*_VALUES), "ordinal").alias("new"))
    table = units.join(last, UNIT_KEY, "left").select(
        *UNIT_KEY,
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _VALUES],
    )
    return UnitChanges(table, accepted, decided.filter(F.col("reason").isNotNull()))
