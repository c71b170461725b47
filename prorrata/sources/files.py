"""Readers of the incoming files, and the XML report files.

Delimited files have one header line and no quoting. All columns are read as
text, by position; cleaning and conversion belong to the imports. A line with
another number of fields is no row: `malformed_lines` has it, with its file.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from prorrata.operators.imports import EXPENSE_COLUMNS
from prorrata.operators.reports import ordered

# The record reader travels with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPED = re.compile(r"\\.", re.DOTALL)

UNIT_COLUMNS = ("consorcio", "uf", "piso", "depto", "coeficiente", "m2", "baulera", "cochera", "m2_baulera", "m2_cochera")
PERSON_COLUMNS = ("nombre", "apellido", "dni", "email", "telefono", "cbu", "inquilino")
LINK_COLUMNS = ("cbu", "consorcio", "uf", "piso", "depto")
PAYMENT_COLUMNS = ("id", "fecha", "cuenta", "importe")


def _text_schema(columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


# Separator and columns of each kind of file.
DELIMITED = {
    "units": ("\t", UNIT_COLUMNS),
    "persons": (";", PERSON_COLUMNS),
    "links": ("|", LINK_COLUMNS),
    "payments": (",", PAYMENT_COLUMNS),
}
_MALFORMED = "_malformed"


def _lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All lines; the text of one with another number of fields in _MALFORMED. Lines are parsed whole, whatever is read of them."""
    separator, columns = DELIMITED[kind]
    return (
        spark.read.schema(f"{_text_schema(columns)}, {_MALFORMED} string")
        .option("sep", separator)
        .option("header", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _MALFORMED)
        .option("columnPruning", False)
        .csv(path)
    )


def _delimited(spark: SparkSession, path: str, kind: str) -> DataFrame:
    # The second condition always holds; the reader wants another column than the malformed text to be used.
    read = F.length(F.concat_ws("", DELIMITED[kind][1][0])) >= 0
    return _lines(spark, path, kind).filter(F.col(_MALFORMED).isNull() & read).drop(_MALFORMED)


def malformed_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """archivo, linea, reason: lines of a file of this *kind* (see DELIMITED) with too few or too many fields."""
    separator, columns = DELIMITED[kind]
    line = F.col(_MALFORMED)
    fields = F.length(line) - F.length(F.replace(line, F.lit(separator), F.lit(""))) + 1
    reason = F.when(fields < len(columns), "too few fields").otherwise("too many fields")
    bad = _lines(spark, path, kind).select("*", F.col("_metadata.file_name").alias("archivo")).filter(line.isNotNull())
    read = F.length(F.concat_ws("", columns[0])) >= 0
    return bad.filter(read).select("archivo", line.alias("linea"), reason.alias("reason"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, "units")


def read_persons(spark: SparkSession, path: str) -> DataFrame:
    """With `ordinal`: the position of the row in the input (file, block of the file, row)."""
    position = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )
    return _delimited(spark, path, "persons").withColumn("ordinal", position)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, "links")


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, "payments")


def _after(fragment: str, inside: int) -> tuple[int, int]:
    """Whether a text is open after a fragment and its closing brace, and by how much the braces outside texts nest deeper."""
    parts = _ESCAPED.sub("", fragment).split('"')
    opened = sum(part.count("{") for part in parts[inside::2])
    inside ^= (len(parts) - 1) % 2
    return inside, opened - (not inside)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a file: quotes (odd or even), and the change of depth if the block starts outside or inside a text."""
    sums: dict[tuple, list[int]] = {}
    for batch in batches:
        for fragment, *block in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "start"))):
            now = sums.setdefault(tuple(block), [0, 0, 0, 1])  # depths, and whether inside, for both ways to start
            for way in (0, 1):
                now[2 + way], deeper = _after(fragment, now[2 + way])
                now[way] += deeper
    columns = [[path for path, _ in sums], [start for _, start in sums], *([v[i] for v in sums.values()] for i in (2, 0, 1))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["path", "start", "odd", "outside", "inside"])


def _array_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of JSON arrays of objects, from fragments that end at a closing brace.

    A record ends where no text and no brace is open. Both are followed through
    each block of a file, from the state it starts in. What a block cannot finish
    or has not begun leaves it as a part (opens, goes on, or closes).
    """
    block, begun, inside, depth, held = None, True, 0, 0, []  # begun: the record at hand began in this block

    def rest() -> tuple:
        return (*block, "opens" if begun else "goes on", "}".join(held))

    for batch in batches:
        found: list[tuple] = []
        for fragment, path, start, odd, deep in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "start", "odd", "deep"))):
            if (path, start) != block:
                if held:
                    found.append(rest())
                block, begun, inside, depth, held = (path, start), not odd and not deep, odd, deep, []
            held.append(fragment)
            inside, deeper = _after(fragment, inside)
            depth += deeper
            if not inside and depth <= 0:
                found.append((*block, "whole" if begun else "closes", "}".join(held)))
                begun, depth, held = True, 0, []
        yield _records(found)
    if held:
        yield _records([rest()])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "start", "part", "text"])


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that each hold one JSON array of objects; a file is cut across tasks.

    Lines mean nothing to such a file, so it is cut at closing braces, in texts
    and nested objects too. A first pass finds out in which state each block of a
    file starts. The few records that lie across blocks are joined afterwards: at
    most two parts of records for each block.
    """
    fragments = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    blocks = fragments.mapInArrow(_block_sums, "path string, start long, odd long, outside long, inside long")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    odd = blocks.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    deeper = odd.withColumn("deeper", F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside")))
    # A row per block of a file (some 100 MB each); a broadcast keeps the fragments in their order.
    states = F.broadcast(
        deeper.select("path", "start", F.col("open").alias("odd"), F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("deep"))
    )
    parts = fragments.join(states, ["path", "start"]).mapInArrow(_array_records, "path string, start long, part string, text string")
    whole = parts.filter("part = 'whole'").select("text")
    in_order = W.partitionBy("path").orderBy("start", F.col("part") == "opens")
    cut = parts.filter("part <> 'whole'").withColumn("record", F.count_if(F.col("part") == "opens").over(in_order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "text")))
    joined = cut.groupBy("path", "record").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "}").alias("text"))
    texts = whole.unionByName(joined.select("text")).filter(F.contains("text", F.lit("{")))
    record = F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit("}"))
    return texts.select(F.from_json(record, schema).alias("record")).select("record.*")


def read_expenses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Expense documents: a JSON array per file, or with *lines* one object per line. Either is cut across tasks."""
    schema = _text_schema(("Nombre del consorcio", "Mes", *EXPENSE_COLUMNS))
    return spark.read.schema(schema).json(path) if lines else read_json_array(spark, path, schema)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, "fecha date")


def write_xml(report: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    """Flat report as XML elements, in the order of its keys."""
    ordered(report).write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode("errorifexists").save(path)


def xml_row(row_tag: str, *columns: str | Column) -> Column:
    """One report row as an XML text; NULL columns are left out."""
    return F.to_xml(F.struct(*columns), {"rowTag": row_tag})


def top_months_xml(spent: DataFrame, earned: DataFrame) -> DataFrame:
    """The two top-month lists of each building and year nested in one document.

    Lists hold at most the report's few months.
    """
    keys = ["Id_Consorcio", "Anio"]

    def listed(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("Puesto", *fields)))
        return rows.groupBy(*keys).agg(
            F.transform(ordered, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)
        )

    both = listed(spent, "FilaGasto", ["Mes", "Anio", "TotalGasto", "TiposIncluidos"]).join(
        listed(earned, "FilaIngreso", ["Mes", "Anio", "TotalIngreso"]), keys, "full"
    )

    def section(rows: str, name: str) -> Column:
        return F.when(F.col(rows).isNotNull(), F.struct(rows)).alias(name)

    document = F.struct(section("FilaGasto", "TopGastos"), section("FilaIngreso", "TopIngresos"))
    return both.select(*keys, F.to_xml(document, {"rowTag": "ReporteTopMesesIngresosGastos"}).alias("xml"))
