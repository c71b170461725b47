"""Equivalent SQL, for DuckDB over the same generated tables.

Amounts are whole cents (BIGINT/HUGEINT) wherever rounding matters, because
decimal division there is floating point.
"""

from __future__ import annotations

from prorrata.schemas import TABLES

MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]

CONDOMINIUMS = """condominiums AS (
  SELECT n_nationkey AS id, upper(n_name) AS name FROM nation)"""

UNITS = """units AS (
  SELECT c_nationkey AS building, CAST(c_custkey AS VARCHAR) AS unit, c_custkey AS person,
         CAST(c_custkey % 10 AS VARCHAR) AS floor, c_mktsegment[1:5] AS department,
         CAST(CAST(round(10000.0 / count(*) OVER (PARTITION BY c_nationkey)) AS BIGINT) AS HUGEINT) AS coef,
         c_custkey % 3 = 0 AS storage, c_custkey % 2 = 0 AS parking
  FROM customer)"""

PAYMENTS = """payments AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_custkey AS person, c_nationkey AS building,
         CAST(o_custkey AS VARCHAR) AS unit,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents,
         date_trunc('month', o_orderdate)::DATE AS month
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

EXPENSES = """expenses AS (
  SELECT s_nationkey AS building, l_returnflag = 'R' AS special, l_linenumber % 6 + 1 AS kind,
         CAST(l_shipdate AS DATE) AS day, date_trunc('month', l_shipdate)::DATE AS month,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""

HEADERS = """span AS (
  SELECT date_trunc('month', min(day))::DATE AS first, date_trunc('month', max(day))::DATE AS last
  FROM (SELECT l_shipdate AS day FROM lineitem UNION ALL SELECT o_orderdate FROM orders)),
calendar AS (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
sums AS (
  SELECT building, month, sum(CASE WHEN special THEN 0 ELSE cents END)::HUGEINT AS ord,
         sum(CASE WHEN special THEN cents ELSE 0 END)::HUGEINT AS ext
  FROM expenses GROUP BY ALL),
headers AS (
  SELECT c.id AS building, k.month, coalesce(s.ord, 0)::HUGEINT AS ord, coalesce(s.ext, 0)::HUGEINT AS ext
  FROM condominiums c CROSS JOIN calendar k LEFT JOIN sums s ON s.building = c.id AND s.month = k.month)"""

# Shares in millionths of a currency unit; cents are their rounding.
BILLS = """shares AS (
  SELECT u.building, u.unit, u.person, u.floor, u.department, h.month,
         h.ord * u.coef + CASE WHEN parking THEN 1000000000 ELSE 0 END
                        + CASE WHEN storage THEN 1000000000 ELSE 0 END AS ord6,
         h.ext * u.coef AS ext6
  FROM units u JOIN headers h ON h.building = u.building),
bills AS (
  SELECT *, (ord6 + 5000) // 10000 AS ord, (ext6 + 5000) // 10000 AS ext,
         (ord6 + ext6 + 5000) // 10000 AS total
  FROM shares),
paid AS (SELECT building, unit, month, sum(cents)::HUGEINT AS cents FROM payments GROUP BY ALL)"""


def _money(expression: str) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(36,0)) / 100.0 AS DECIMAL(18,2))"


# A quotient of HUGEINTs at 13 decimals, rounded half up.
def _ratio(part: str, whole: str) -> str:
    return f"((2 * {part} * 10000000000000 + {whole}) // (2 * {whole}))"


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(parts) + "\n"


REPORT_BASE = (CONDOMINIUMS, UNITS, PAYMENTS, EXPENSES, HEADERS, BILLS)

SPLIT = f"""split AS (
  SELECT p.building, p.day, p.month, p.cents, p.unit, b.ord, b.ext,
         CASE WHEN b.ord + b.ext = 0 THEN 0 ELSE p.cents * {_ratio("b.ord", "(b.ord + b.ext)")} END AS ord_part,
         CASE WHEN b.ord + b.ext = 0 THEN 0 ELSE p.cents * {_ratio("b.ext", "(b.ord + b.ext)")} END AS ext_part
  FROM payments p JOIN bills b ON b.building = p.building AND b.unit = p.unit AND b.month = p.month)"""

def _half_away(expression: str, unit: int) -> str:
    return f"(sign({expression})::HUGEINT * ((2 * abs({expression}) + {unit}) // {2 * unit}))"


# Sums of cents at 13 extra decimals back to cents.
def _rounded(expression: str) -> str:
    return f"((({expression})::HUGEINT + 5000000000000) // 10000000000000)"


def oracle_queries() -> dict[str, str]:
    sql = {}

    sql["o09_settlement_headers"] = (
        _with(CONDOMINIUMS, EXPENSES, HEADERS)
        + f"""SELECT building AS "Id_Consorcio", month AS "Periodo", DATE '2002-01-15' AS "Fecha_Emision",
       DATE '2002-01-25' AS "Fecha_Vencimiento1", DATE '2002-02-04' AS "Fecha_Vencimiento2",
       {_money("ord")} AS "Total_Gasto_Ordinarios", {_money("ext")} AS "Total_Gasto_Extraordinarios"
FROM headers"""
    )

    sql["o10_prorate_bills"] = (
        _with(*REPORT_BASE)
        + f""", carried AS (
  SELECT b.*, coalesce(lag(b.total - coalesce(p.cents, 0)) OVER (PARTITION BY b.building, b.unit ORDER BY b.month), 0)::HUGEINT AS rest
  FROM bills b
  LEFT JOIN paid p ON p.building = b.building AND p.unit = b.unit AND p.month = b.month)
SELECT building AS "Id_Consorcio", unit AS "NroUF", month AS "Periodo",
       {_money("rest")} AS "Saldo_Anterior", CAST(0 AS DECIMAL(18,2)) AS "Pagos_Recibidos_Mes",
       {_money("rest")} AS "Deuda", {_money(_half_away("rest * 5", 100))} AS "Interes_Por_Mora",
       {_money("ord")} AS "Importe_Ordinario_Prorrateado", {_money("ext")} AS "Importe_Extraordinario_Prorrateado",
       {_money(_half_away("(rest * 10500 + ord6 + ext6)", 10000))} AS "Total_A_Pagar"
FROM carried"""
    )

    sql["o11_recalculate_balances"] = (
        _with(
            *REPORT_BASE,
            f"""settled AS (
  SELECT b.*, coalesce(p.cents, 0)::HUGEINT AS paid FROM bills b
  LEFT JOIN paid p ON p.building = b.building AND p.unit = b.unit AND p.month = b.month),
chain AS (
  SELECT building, unit, month, paid, ord, ext, 0::HUGEINT AS rest, 0::HUGEINT AS interest, total, total - paid AS carry
  FROM settled WHERE month = (SELECT min(month) FROM calendar)
  UNION ALL
  SELECT s.building, s.unit, s.month, s.paid, s.ord, s.ext, c.carry,
         {_half_away("greatest(c.carry, 0) * 5", 100)},
         {_half_away("(100 * (c.carry + s.ord + s.ext) + 5 * greatest(c.carry, 0))", 100)},
         {_half_away("(100 * (c.carry + s.ord + s.ext - s.paid) + 5 * greatest(c.carry, 0))", 100)}
  FROM chain c JOIN settled s ON s.building = c.building AND s.unit = c.unit
       AND s.month = (c.month + INTERVAL 1 MONTH)::DATE)""",
            recursive=True,
        )
        + f"""SELECT building AS "Id_Consorcio", unit AS "NroUF", month AS "Periodo",
       {_money("rest")} AS "Saldo_Anterior", {_money("paid")} AS "Pagos_Recibidos_Mes",
       {_money("greatest(rest, 0)")} AS "Deuda", {_money("interest")} AS "Interes_Por_Mora",
       {_money("ord")} AS "Importe_Ordinario_Prorrateado", {_money("ext")} AS "Importe_Extraordinario_Prorrateado",
       {_money("total")} AS "Total_A_Pagar"
FROM chain"""
    )

    sql["o12_resolve_payments"] = """
WITH links AS (
  SELECT c_custkey AS person, c_nationkey AS building, CAST(c_custkey AS VARCHAR) AS unit FROM customer
  UNION ALL
  SELECT c_custkey - 1, c_nationkey, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey > 0),
ranked AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, building, unit,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY building, unit) AS place
  FROM orders JOIN links ON person = o_custkey)
SELECT o_orderkey AS "Id_Pago", CAST(o_orderdate AS DATE) AS "Fecha", CAST(o_totalprice AS DECIMAL(18,2)) AS "Importe",
       building AS "Id_Consorcio", unit AS "NroUF"
FROM ranked WHERE place = 1"""

    sql["o22_business_days"] = """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Fecha",
       NOT (isodow(o_orderdate) >= 6
            OR strftime(o_orderdate, '%m-%d') IN ('01-01', '05-01', '05-25', '07-09', '12-08', '12-25'))
         AS "is_business_day"
FROM orders"""

    sql["o15_weekly_collection"] = (
        _with(*REPORT_BASE, SPLIT)
        + f""", weeks AS (
  SELECT building, year(day) AS y,
         (dayofyear(day) + dayofweek(make_date(year(day), 1, 1)) - 1) // 7 + 1 AS w,
         {_rounded("sum(ord_part)")} AS ord, {_rounded("sum(ext_part)")} AS ext, sum(cents)::HUGEINT AS total
  FROM split GROUP BY ALL)
SELECT building AS "Id_Consorcio", CAST(y AS INTEGER) AS "Anio", CAST(w AS INTEGER) AS "Semana",
       {_money("ord")} AS "TotalOrdinario", {_money("ext")} AS "TotalExtraordinario",
       {_money("total")} AS "TotalSemana",
       {_money("sum(total) OVER (PARTITION BY building ORDER BY y, w)")} AS "AcumuladoProgresivo",
       {_money("(2 * sum(total) OVER (PARTITION BY building) + count(*) OVER (PARTITION BY building))::HUGEINT // (2 * count(*) OVER (PARTITION BY building))")} AS "PromedioPeriodo"
FROM weeks"""
    )

    columns = ", ".join(
        f"""CAST(sum(CASE WHEN strftime(p.day, '%Y-%m') = '{m}' THEN p.cents END) / 100.0 AS DECIMAL(18,2)) AS "{m}\""""
        for m in MONTHS
        if m <= "2001-08"
    )
    sql["o16_monthly_by_department"] = (
        _with(*REPORT_BASE)
        + f"""SELECT p.building AS "Id_Consorcio", b.department AS "Departamento", {columns}
FROM payments p JOIN bills b ON b.building = p.building AND b.unit = p.unit AND b.month = p.month
GROUP BY p.building, b.department"""
    )

    sql["o17_collection_by_origin"] = (
        _with(*REPORT_BASE, SPLIT)
        + f"""SELECT building AS "Id_Consorcio", strftime(day, '%Y-%m') AS "Periodo",
       {_money(_rounded("sum(ord_part)"))} AS "Ordinario",
       {_money(_rounded("sum(ext_part)"))} AS "Extraordinario", {_money("sum(cents)")} AS "Importe"
FROM split WHERE ord + ext > 0 GROUP BY building, strftime(day, '%Y-%m')"""
    )

    sql["o18_top_months"] = (
        _with(*REPORT_BASE)
        + f""", spent AS (
  SELECT building, year(day) AS y, month(day) AS m, sum(cents) AS cents,
         CASE WHEN bool_or(special) AND bool_or(NOT special) THEN 'Gasto Extraordinario, Gasto Ordinario'
              WHEN bool_or(special) THEN 'Gasto Extraordinario' ELSE 'Gasto Ordinario' END AS kinds
  FROM expenses GROUP BY ALL),
earned AS (
  SELECT p.building, year(p.day) AS y, month(p.day) AS m, sum(p.cents) AS cents
  FROM payments p JOIN bills b ON b.building = p.building AND b.unit = p.unit AND b.month = p.month GROUP BY ALL),
ranked AS (
  SELECT 'TopGastos' AS section, *, row_number() OVER (PARTITION BY building, y ORDER BY cents DESC, m) AS place FROM spent
  UNION ALL
  SELECT 'TopIngresos', building, y, m, cents, NULL,
         row_number() OVER (PARTITION BY building, y ORDER BY cents DESC, m) FROM earned)
SELECT section AS "Seccion", building AS "Id_Consorcio", CAST(y AS INTEGER) AS "Anio", CAST(m AS INTEGER) AS "Mes",
       {_money("cents")} AS "Total", kinds AS "TiposIncluidos", CAST(place AS INTEGER) AS "Puesto"
FROM ranked WHERE place <= 5"""
    )

    sql["o19_top_debtors"] = (
        _with(*REPORT_BASE)
        + f""", owed AS (
  SELECT b.building, b.person, b.floor, year(b.month) AS y, sum(b.total - coalesce(p.cents, 0)) AS cents, count(*) AS months
  FROM bills b LEFT JOIN paid p ON p.building = b.building AND p.unit = b.unit AND p.month = b.month
  WHERE b.total - coalesce(p.cents, 0) > 1 GROUP BY ALL),
ranked AS (
  SELECT o.*, c_name, c_mktsegment, row_number() OVER (PARTITION BY building, floor, y
         ORDER BY cents DESC, CAST(person + 10000000 AS VARCHAR)) AS place
  FROM owed o JOIN customer ON c_custkey = person)
SELECT building AS "Id_Consorcio", floor AS "Piso", CAST(y AS INTEGER) AS "Anio",
       upper(c_name) || ', ' || upper(c_mktsegment[1:5]) AS "Propietario",
       CAST(person + 10000000 AS VARCHAR) AS "DNI",
       lower(replace(c_name, '#', '.')) || '@example.com' AS "Email",
       '11-' || lpad(CAST(person AS VARCHAR), 8, '0') AS "Telefono",
       {_money("cents")} AS "DeudaTotalAcumulada", months AS "Cant_Periodos_Adeudados", CAST(place AS INTEGER) AS "Puesto"
FROM ranked WHERE place <= 3"""
    )

    sql["o20_payment_intervals"] = (
        _with(*REPORT_BASE)
        + """, sequences AS (
  SELECT p.building, p.unit, p.day, lead(p.day) OVER (PARTITION BY p.building, p.unit ORDER BY p.day) AS next_day
  FROM payments p JOIN bills b ON b.building = p.building AND b.unit = p.unit AND b.month = p.month
  WHERE b.ord > 0)
SELECT DISTINCT building AS "Id_Consorcio", unit AS "NroUF", strftime(day, '%Y-%m-%d') AS "FechaPago",
       strftime(next_day, '%Y-%m-%d') AS "FechaPagoSiguiente",
       CAST(datediff('day', day, next_day) AS INTEGER) AS "DiasEntrePagos"
FROM sequences WHERE next_day IS NOT NULL"""
    )
    sql["o21_weekly_xml"] = (
        f"""SELECT "Id_Consorcio", "Anio", "Semana", '<Fila>' || chr(10) || """
        + " || ".join(
            f"""'    <{c}>' || CAST("{c}" AS VARCHAR) || '</{c}>' || chr(10)"""
            for c in ("Anio", "Semana", "TotalOrdinario", "TotalExtraordinario", "TotalSemana",
                      "AcumuladoProgresivo", "PromedioPeriodo")
        )
        + f""" || '</Fila>' AS xml FROM ({sql["o15_weekly_collection"]})"""
    )

    def rows_xml(section: str, row: str, fields: str) -> str:
        inner = " || ".join(
            f"""'            <{tag}>' || CAST({column} AS VARCHAR) || '</{tag}>' || chr(10)"""
            for tag, column in (f.split(":") for f in fields.split())
        )
        body = f"""'        <{row}>' || chr(10) || {inner} || '        </{row}>' || chr(10)"""
        return f"""string_agg(CASE WHEN "Seccion" = '{section}' THEN {body} END, '' ORDER BY "Puesto")"""

    sql["o21_top_months_xml"] = f"""
WITH listed AS (
  SELECT "Id_Consorcio", "Anio",
         {rows_xml("TopGastos", "FilaGasto", 'Mes:"Mes" Anio:"Anio" TotalGasto:"Total" TiposIncluidos:"TiposIncluidos"')} AS spent,
         {rows_xml("TopIngresos", "FilaIngreso", 'Mes:"Mes" Anio:"Anio" TotalIngreso:"Total"')} AS earned
  FROM ({sql["o18_top_months"]}) GROUP BY ALL)
SELECT "Id_Consorcio", "Anio", '<ReporteTopMesesIngresosGastos>' || chr(10)
       || coalesce('    <TopGastos>' || chr(10) || spent || '    </TopGastos>' || chr(10), '')
       || coalesce('    <TopIngresos>' || chr(10) || earned || '    </TopIngresos>' || chr(10), '')
       || '</ReporteTopMesesIngresosGastos>' AS xml
FROM listed"""

    sql["o19_top_debtors_encrypted"] = sql["o19_top_debtors"]
    sql.update(_import_queries())
    sql.update(_reject_queries())
    for kind in ("units", "persons", "links", "payments", "expenses"):
        sql[f"{FILE_QUERIES[kind]}_file"] = sql[FILE_QUERIES[kind]]
    sql.update(_privacy_queries(sql))
    sql.update(_other_queries())
    sql.update(_allocation_queries())
    sql["o07_import_expenses_array"] = sql["o07_import_expenses"]
    sql["o13_post_in_two_runs"] = sql["o13_allocated_bills"]
    sql["o15_weekly_of_a_building"] = f"""SELECT * FROM ({sql["o15_weekly_collection"]}) WHERE "Id_Consorcio" = 7"""
    sql["o19_top_debtors_of_a_floor"] = (
        f"""SELECT * FROM ({sql["o19_top_debtors"]}) WHERE "Id_Consorcio" = 3 AND "Anio" = 1997 AND "Piso" = '7'"""
    )
    sql["o21_weekly_xml_file"] = sql["o15_weekly_collection"]
    sql.update(_stored_queries())
    in_buckets = {
        "o10_prorate_buckets": "o10_prorate_bills", "o11_recalculate_buckets": "o11_recalculate_balances",
        "o13_allocate_buckets": "o13_allocated_bills", "o15_weekly_buckets": "o15_weekly_collection",
        "o17_origin_buckets": "o17_collection_by_origin", "o19_debtors_buckets": "o19_top_debtors",
        "o20_intervals_buckets": "o20_payment_intervals",
    }
    sql.update({name: sql[same] for name, same in in_buckets.items()})
    return sql


def _stored_queries() -> dict[str, str]:
    """Stored tables that are changed in place, reports with parameters, and checks of all tables."""
    last = "(SELECT max(month) FROM calendar)"

    def bill(rest: str, paid: str, total: str) -> str:
        interest = _money(_half_away(f"({rest}) * 5", 100))
        return f"""SELECT b.building AS "Id_Consorcio", b.unit AS "NroUF", b.month AS "Periodo", {_money(rest)} AS "Saldo_Anterior",
       {_money(paid)} AS "Pagos_Recibidos_Mes", {_money(rest)} AS "Deuda", {interest} AS "Interes_Por_Mora",
       {_money("b.ord")} AS "Importe_Ordinario_Prorrateado", {_money("b.ext")} AS "Importe_Extraordinario_Prorrateado",
       {_money(total)} AS "Total_A_Pagar"
FROM bills b LEFT JOIN paid p ON p.building = b.building AND p.unit = b.unit AND p.month = b.month
LEFT JOIN (SELECT b.building, b.unit, b.month, (b.total - coalesce(p.cents, 0))::HUGEINT AS rest FROM bills b
           LEFT JOIN paid p ON p.building = b.building AND p.unit = b.unit AND p.month = b.month) e
  ON e.building = b.building AND e.unit = b.unit AND b.month = {last} AND e.month = (b.month - INTERVAL 1 MONTH)::DATE"""

    rest = "coalesce(e.rest, 0)::HUGEINT"
    coefficient = "CASE WHEN c_custkey % 23 = 0 THEN 'abc' ELSE (c_custkey % 900 + 1) // 100 || ',' || lpad(((c_custkey % 900 + 1) % 100)::VARCHAR, 2, '0') END"
    fields = [
        "CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'Nowhere' ELSE ' nation_' || c_nationkey || ' ' END",
        "' ' || c_custkey || ' '", "c_custkey % 10", "c_mktsegment[1:5]", coefficient, "(c_custkey % 90 + 30) || '.9'",
        "CASE WHEN c_custkey % 3 = 0 THEN 'si ' WHEN c_custkey % 5 = 0 THEN '' ELSE 'NO' END",
        "CASE WHEN c_custkey % 2 = 0 THEN 'SI' ELSE 'no' END", "c_custkey % 300",
    ]
    line = " || chr(9) || ".join(f"({f})" for f in fields)
    lost_item = "l_suppkey % 30 NOT IN (SELECT n_nationkey FROM nation)"
    repeated_item = (
        "SELECT count(*) FROM (SELECT 1 FROM lineitem WHERE l_returnflag {} 'R' GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1)"
    )
    owned = "FROM orders JOIN customer ON c_custkey = o_custkey"
    counted = {
        ("unidades.Unidad_Funcional", "LENGTH", "Departamento"): "SELECT count(*) FROM customer WHERE length(c_mktsegment) >= 5",
        ("unidades.Unidad_Persona", "FOREIGN KEY unidades.Persona", "Id_Persona"): "SELECT count(*) FROM customer WHERE c_custkey % 13 = 0",
        ("gastos.Gasto_Ordinario", "FOREIGN KEY negocio.Consorcio", "Id_Consorcio"):
            f"SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R' AND {lost_item}",
        ("gastos.Gasto_Extraordinario", "FOREIGN KEY negocio.Consorcio", "Id_Consorcio"):
            f"SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND {lost_item}",
        ("gastos.Gasto_Extraordinario", "FOREIGN KEY gastos.Tipo_Pago_Extraordinario", "Id_tipo_pago"):
            "SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3",
        ("gastos.Gasto_Ordinario", "PRIMARY KEY", "Id_gasto"): repeated_item.format("<>"),
        ("gastos.Gasto_Extraordinario", "PRIMARY KEY", "Id_gasto"): repeated_item.format("="),
        ("pagos.Detalle_Pago", "FOREIGN KEY liquidacion.Detalle_Expensa_UF", "Id_Consorcio, NroUF, Periodo"):
            f"SELECT count(*) {owned} WHERE o_orderkey % 97 = 0",
        ("pagos.Detalle_Pago", "FOREIGN KEY pagos.Pago", "Id_Pago"):
            f"SELECT count(*) {owned} WHERE o_orderkey % 32 = 1 AND o_orderkey - 1 NOT IN (SELECT o_orderkey FROM orders)",
        ("pagos.Detalle_Pago", "PRIMARY KEY", "Id_Pago, Secuencia"):
            f"""SELECT count(*) FROM (SELECT o_orderkey - CASE WHEN o_orderkey % 32 = 1 THEN 1 ELSE 0 END AS k {owned}
                GROUP BY k HAVING count(*) > 1)""",
    }
    unwritten = (
        "negocio.Estado_Financiero gastos.Gasto_Administracion gastos.Gasto_Seguro gastos.Gasto_General gastos.Empresa_Limpieza"
        " gastos.Gasto_Mantenimiento gastos.Empleado_Limpieza gastos.Gasto_Servicio_Publico liquidacion.Mora"
    ).split()
    checks = []
    for table in TABLES.values():
        if table.name in unwritten:
            continue
        rules = [("PRIMARY KEY", table.key), *((f"FOREIGN KEY {r.table}", r.columns) for r in table.references)]
        rules += [("NOT NULL", (c,)) for c in table.required] + [("LENGTH", (c,)) for c in table.lengths]
        for rule, columns in rules:
            place = (table.name, rule, ", ".join(columns))
            checks.append(f"SELECT '{place[0]}', '{place[1]}', '{place[2]}', CAST(({counted.get(place, '0')}) AS BIGINT)")
    return {
        "o08_upsert_month": _with(*REPORT_BASE) + bill("0::HUGEINT", f"CASE WHEN b.month = {last} THEN coalesce(p.cents, 0) ELSE 0 END", "b.total"),
        "o10_replace_settlements": _with(*REPORT_BASE) + bill(rest, "0", _half_away(f"({rest} * 10500 + b.ord6 + b.ext6)", 10000)),
        "o02_malformed_lines": f"""
SELECT {line} || CASE WHEN c_custkey % 29 = 0 THEN '' ELSE chr(9) || c_custkey % 20 || chr(9) || 'extra' END AS linea,
       CASE WHEN c_custkey % 29 = 0 THEN 'too few fields' ELSE 'too many fields' END AS reason
FROM customer WHERE c_custkey % 29 = 0 OR c_custkey % 31 = 0""",
        "o18_top_expenses_of_a_year": _with(*REPORT_BASE) + f""", spent AS (
  SELECT building, year(day) AS y, month(day) AS m, sum(cents) AS cents,
         CASE WHEN bool_or(special) AND bool_or(NOT special) THEN 'Gasto Extraordinario, Gasto Ordinario'
              WHEN bool_or(special) THEN 'Gasto Extraordinario' ELSE 'Gasto Ordinario' END AS kinds
  FROM expenses WHERE building = 3 AND year(day) = 1996 AND (special OR kind = 2) GROUP BY ALL)
SELECT building AS "Id_Consorcio", CAST(y AS INTEGER) AS "Anio", CAST(m AS INTEGER) AS "Mes", {_money("cents")} AS "TotalGasto",
       kinds AS "TiposIncluidos", CAST(place AS INTEGER) AS "Puesto"
FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, m) AS place FROM spent) WHERE place <= 5""",
        "o30_all_tables": "SELECT * FROM (" + " UNION ALL ".join(checks) + ") t(tabla, regla, columnas, filas)",
    }


_PERSON = """c_custkey AS "Id_Persona", CAST(c_custkey + 10000000 AS VARCHAR) AS "DNI",
  upper(c_mktsegment[1:5]) AS "Nombre", upper(c_name) AS "Apellido",
  lower(replace(c_name, '#', '.')) || '@example.com' AS "Email",
  '11-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS "Telefono",
  c_custkey % 4 = 0 AS inquilino, lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS "Cbu_Cvu\""""


# Imports that also run from files.
FILE_QUERIES = {
    "units": "o02_import_units",
    "persons": "o03_import_persons",
    "links": "o04_import_links",
    "payments": "o05_import_payments",
    "expenses": "o07_import_expenses",
}


def _reject_queries() -> dict[str, str]:
    return {
        "o01_rejected_condominiums": """
SELECT lower(c_name) AS "Nombre del consorcio",
       CASE WHEN c_custkey % 17 = 0 THEN 'condominium missing' ELSE 'condominium is not a number' END AS reason
FROM customer WHERE c_custkey % 17 = 0 OR c_custkey % 13 = 0""",
        "o03_rejected_persons": """
SELECT CAST(o_orderkey AS VARCHAR) AS "Telefono",
       CASE WHEN o_orderkey % 11 = 0 THEN 'document is not a number' ELSE 'document missing' END AS reason
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""",
        "o04_rejected_links": """
SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE lpad(CAST(c_custkey AS VARCHAR), 22, '0') END AS account,
       CASE WHEN c_custkey % 11 = 0 THEN 'ZZZ' ELSE CAST(c_custkey AS VARCHAR) END AS "NroUF",
       'NATION_' || c_nationkey AS consorcio,
       CASE WHEN c_custkey % 7 = 0 THEN 'unknown account' ELSE 'unknown unit' END AS reason
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
        "o05_rejected_payments": """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'account or amount missing' AS reason FROM orders WHERE o_orderkey % 21 = 0""",
        "o06_rejected_suppliers": """
SELECT CAST(s_suppkey AS VARCHAR) AS "F3", 'title or header' AS reason FROM supplier
WHERE s_suppkey % 9 = 0 OR s_suppkey % 7 = 0""",
        "o07_rejected_expenses": """
WITH cells AS (
  SELECT DISTINCT s_nationkey AS b, month(l_shipdate) AS m, l_linenumber AS n
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
counts AS (
  SELECT 'unknown month' AS reason, count(*) AS n FROM cells WHERE m = 12
  UNION ALL
  SELECT 'amount missing', (SELECT 7 * count(DISTINCT (b, m)) FROM cells) - (SELECT count(*) FROM cells))
SELECT reason, CAST(n AS BIGINT) AS filas FROM counts WHERE n > 0""",
    }


def _import_queries() -> dict[str, str]:
    sql = {}
    sql["o01_import_condominiums"] = """
WITH sheet AS (
  SELECT c_custkey AS k, c_name, TRUE AS given FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 13 <> 0),
old AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT CAST(k AS INTEGER) AS "Id_Consorcio",
       CASE WHEN given THEN 1 ELSE 9 END AS "Id_Administracion",
       CASE WHEN given THEN upper(c_name) ELSE 'OLD' END AS "Nombre",
       CASE WHEN NOT coalesce(given, FALSE) THEN 'OLD' WHEN k % 3 = 0 OR k % 5 = 0 THEN 'DOMICILIO NO INFORMADO'
            ELSE 'Calle 1' END AS "Domicilio",
       CAST(CASE WHEN NOT coalesce(given, FALSE) THEN 1 WHEN k % 4 <> 0 THEN k % 50 ELSE 0 END AS SMALLINT) AS "Cant_unidades",
       CAST(CASE WHEN NOT coalesce(given, FALSE) THEN 1 WHEN k % 7 = 0 THEN 0 WHEN k % 11 <> 0 THEN k % 1000 END AS INTEGER)
         AS "MetrosCuadrados",
       CAST(CASE WHEN given THEN 1000 ELSE 5 END AS DECIMAL(18,2)) AS "Precio_Cochera",
       CAST(CASE WHEN given THEN 1000 ELSE 5 END AS DECIMAL(18,2)) AS "Precio_Baulera"
FROM sheet FULL JOIN old USING (k)"""

    sql["o02_import_units"] = (
        _with(UNITS)
        + """, lines AS (
  SELECT c_custkey AS person, TRUE AS given FROM customer
  WHERE c_custkey % 19 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 300 <= 255)
SELECT building AS "Id_Consorcio", unit AS "NroUF", CASE WHEN given THEN floor ELSE 'OLD' END AS "Piso",
       department AS "Departamento",
       CAST(CASE WHEN given THEN person % 900 + 1 ELSE coef END / 100.0 AS DECIMAL(5,2)) AS "Coeficiente",
       CAST(person % 90 + 30 AS SMALLINT) AS "M2_UF", storage AS "Baulera", parking AS "Cochera",
       CAST(CASE WHEN given THEN person % 300 ELSE person % 3 END AS SMALLINT) AS "M2_Baulera",
       CAST(CASE WHEN given THEN person % 20 ELSE person % 2 END AS SMALLINT) AS "M2_Cochera"
FROM units LEFT JOIN lines USING (person) WHERE given OR department <> 'MACHI'"""
    )

    sql["o02_rejected_units"] = """
SELECT ' ' || c_custkey || ' ' AS uf,
       CASE WHEN c_custkey % 19 = 0 THEN 'condominium or unit missing' WHEN c_custkey % 17 = 0 THEN 'unknown condominium'
            WHEN c_custkey % 23 = 0 THEN 'coefficient is not a number'
            ELSE 'storage or parking area out of range' END AS reason
FROM customer WHERE c_custkey % 19 = 0 OR c_custkey % 17 = 0 OR c_custkey % 23 = 0 OR c_custkey % 300 > 255"""

    def persons(number: str, extra: str = "") -> str:
        return f"""
WITH old AS (SELECT {_PERSON} FROM customer WHERE c_mktsegment <> 'MACHINERY'),
lines AS (
  SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders
  WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY ALL),
fresh AS (
  SELECT k, CAST(k + 10000000 AS VARCHAR) AS "DNI", 'N' || k AS "Nombre", upper(c_name) AS "Apellido",
         'user' || k || '@example.com' AS "Email", CAST(first AS VARCHAR) AS "Telefono", k % 4 = 0 AS inquilino,
         lpad(CAST(k AS VARCHAR), 22, '0') AS "Cbu_Cvu"
  FROM lines JOIN customer ON c_custkey = k),
merged AS (
  SELECT o."Id_Persona", coalesce(f."DNI", o."DNI") AS "DNI",
         CASE WHEN k IS NULL THEN o."Nombre" ELSE f."Nombre" END AS "Nombre",
         CASE WHEN k IS NULL THEN o."Apellido" ELSE f."Apellido" END AS "Apellido",
         CASE WHEN k IS NULL THEN o."Email" ELSE f."Email" END AS "Email",
         CASE WHEN k IS NULL THEN o."Telefono" ELSE f."Telefono" END AS "Telefono",
         CASE WHEN k IS NULL THEN o.inquilino ELSE f.inquilino END AS inquilino,
         CASE WHEN k IS NULL THEN o."Cbu_Cvu" ELSE f."Cbu_Cvu" END AS "Cbu_Cvu"
  FROM old o FULL JOIN fresh f ON f."DNI" = o."DNI"),
top AS (SELECT max("Id_Persona") AS last FROM old)
SELECT * EXCLUDE (last) REPLACE (coalesce("Id_Persona", last + row_number() OVER (PARTITION BY "Id_Persona" IS NULL ORDER BY {number}))
                  AS "Id_Persona"){extra}
FROM merged, top"""

    sql["o03_import_persons"] = persons('"DNI"')
    sql["o25_import_encrypted_persons"] = persons(
        """sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "DNI"))""",
        """, sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "DNI")) AS dni_bidx, sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "Cbu_Cvu")) AS cbu_bidx""",
    )

    sql["o04_import_links"] = """
WITH old AS (
  SELECT c_custkey AS "ID_U_P", c_nationkey AS "Id_Consorcio", CAST(c_custkey AS VARCHAR) AS "NroUF",
         c_custkey AS "Id_Persona", CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS "Id_TipoRelacion",
         DATE '1995-01-01' AS "Fecha_Inicio" FROM customer),
fresh AS (
  SELECT * FROM old WHERE "Id_TipoRelacion" = 1 AND "Id_Persona" % 7 <> 0 AND "Id_Persona" % 11 <> 0
    AND "Id_Persona" IN (SELECT o_custkey FROM orders)),
top AS (SELECT max("ID_U_P") AS last FROM old WHERE "Id_TipoRelacion" = 2)
SELECT *, CAST(NULL AS DATE) AS "Fecha_Fin" FROM old WHERE "Id_TipoRelacion" = 2
UNION ALL
SELECT last + row_number() OVER (ORDER BY "Id_Consorcio", "NroUF"), "Id_Consorcio", "NroUF", "Id_Persona",
       "Id_TipoRelacion", DATE '2025-06-17', NULL
FROM fresh, top"""
    sql["o26_import_encrypted_links"] = sql["o04_import_links"]

    sql["o05_import_payments"] = """
SELECT o_orderkey AS "Id_Pago", 1 AS "Id_Forma_De_Pago",
       CASE WHEN o_orderdate < DATE '1998-01-01' OR o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS "Fecha",
       CASE WHEN o_orderdate >= DATE '1998-01-01' AND o_orderkey % 8 = 0 THEN 'elsewhere'
            ELSE lpad(CAST(o_custkey AS VARCHAR), 22, '0') END AS "Cuenta_Origen",
       CAST(o_totalprice AS DECIMAL(18,2)) AS "Importe",
       o_orderdate < DATE '1998-01-01' OR o_orderkey % 8 <> 0 AS "Es_Pago_Asociado", FALSE AS "Procesado"
FROM orders WHERE o_orderdate < DATE '1998-01-01' OR o_orderkey % 21 <> 0"""
    sql["o27_import_encrypted_payments"] = (
        f"""SELECT *, sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "Cuenta_Origen")) AS cuenta_bidx FROM ({sql["o05_import_payments"]})"""
    )

    sql["o06_import_suppliers"] = """
WITH old AS (SELECT s_suppkey + 1 AS id, * FROM supplier WHERE s_acctbal > 5000),
fresh AS (SELECT *, TRUE AS given FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0),
top AS (SELECT max(id) AS last FROM old),
merged AS (
  SELECT o.id, s.s_nationkey, s.s_name, f.given, s.s_suppkey
  FROM supplier s LEFT JOIN old o ON o.s_suppkey = s.s_suppkey LEFT JOIN fresh f ON f.s_suppkey = s.s_suppkey
  WHERE o.id IS NOT NULL OR f.given)
SELECT coalesce(id, last + row_number() OVER (PARTITION BY id IS NULL ORDER BY s_nationkey, s_name)) AS "Id_Proveedor",
       s_nationkey AS "Id_Consorcio", s_name AS "Nombre_Gasto",
       CASE WHEN given THEN 'Tipo ' || s_suppkey % 5 ELSE 'OLD' END AS "Descripcion",
       CASE WHEN given THEN CAST(s_suppkey AS VARCHAR) ELSE 'OLD' END AS "Cuenta"
FROM merged, top"""

    sql["o07_import_expenses"] = """
WITH kinds AS (
  SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS line, unnest([1, 2, 3, 4, 5, 6, 6]) AS kind,
         unnest(['BANCARIOS', 'LIMPIEZA', 'ADMINISTRACION', 'SEGUROS', 'GASTOS GENERALES', 'SERVICIOS PUBLICOS-Agua',
                 'SERVICIOS PUBLICOS-Luz']) AS name),
cells AS (
  SELECT s_nationkey AS building, kind, make_date(2025, CAST(month(l_shipdate) AS INTEGER), 1) AS day, name,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN kinds ON line = l_linenumber
  WHERE month(l_shipdate) <> 12 GROUP BY ALL),
old AS (
  SELECT s_nationkey + 1 AS id, s_nationkey AS building, 1 AS kind, DATE '2025-01-01' AS day, 'BANCARIOS' AS name,
         count(*) AS n
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey),
merged AS (
  SELECT id, building, kind, day, name, coalesce(amount, CAST(n AS DECIMAL(18,2))) AS amount
  FROM old FULL JOIN cells USING (building, kind, day, name)),
top AS (SELECT max(id) AS last FROM old)
SELECT coalesce(id, last + row_number() OVER (PARTITION BY id IS NULL ORDER BY building, kind, day, name)) AS "Id_gasto",
       building AS "Id_Consorcio", kind AS "Id_Tipo_Gasto", day AS "Fecha", CAST(amount AS DECIMAL(18,2)) AS "Importe_Total",
       name AS "Descripcion"
FROM merged, top"""

    sql["o08_keyed_upsert"] = """
SELECT o_orderkey AS "Id_Pago", 1 AS "Id_Forma_De_Pago", CAST(o_orderdate AS DATE) AS "Fecha",
       lpad(CAST(o_custkey AS VARCHAR), 22, '0') AS "Cuenta_Origen",
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderdate >= DATE '1997-01-01' THEN 2 ELSE 1 END AS DECIMAL(18,2)) AS "Importe",
       TRUE AS "Es_Pago_Asociado", CASE WHEN o_orderdate < DATE '1999-01-01' THEN FALSE END AS "Procesado"
FROM orders"""
    return sql


def _privacy_queries(sql: dict[str, str]) -> dict[str, str]:
    return {
        "o23_encrypt_persons": f"""
SELECT *, sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "DNI")) AS dni_bidx, sha256('generated-data' || chr(10) || sha256('generated-data' || chr(10) || "Cbu_Cvu")) AS cbu_bidx, TRUE AS cifrado
FROM (SELECT {_PERSON} FROM customer)""",
        "o24_match_encrypted_accounts": """
SELECT o_orderkey AS "Id_Pago", o_custkey AS "Id_Persona", lpad(CAST(o_custkey AS VARCHAR), 22, '0') AS "Cuenta_Origen"
FROM orders""",
    }


def _other_queries() -> dict[str, str]:
    decided = """
WITH units AS (
  SELECT c_nationkey AS b, CAST(c_custkey AS VARCHAR) AS u, CAST(c_custkey % 10 AS VARCHAR) AS f, c_mktsegment[1:5] AS d, *
  FROM customer),
changes AS (
  SELECT c_custkey AS k, c_custkey * 2 + n AS ordinal, c_nationkey AS b,
         CASE WHEN c_custkey % 31 = 0 THEN 'none' ELSE CAST(c_custkey AS VARCHAR) END AS u,
         CASE WHEN c_custkey % 29 = 0 THEN '' WHEN n = 0 THEN 'N' || c_custkey % 40 ELSE CAST(c_custkey % 10 AS VARCHAR) END AS f,
         CASE WHEN c_custkey % 23 = 0 THEN '' WHEN n = 0 THEN 'D1' ELSE c_mktsegment[1:5] END AS d,
         CASE WHEN c_custkey % 19 = 0 THEN 0 WHEN c_custkey % 17 <> 0 THEN 2 END AS coef,
         CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_custkey % 90 + 1 END AS area,
         coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 0 END, FALSE) AS storage
  FROM customer, (VALUES (0), (1)) t(n)),
spots AS (SELECT b, f, d, min(u) AS lo, max(u) AS hi FROM units GROUP BY ALL),
checked AS (
  SELECT c.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM units u WHERE u.b = c.b AND u.u = c.u) THEN 'unit does not exist'
    WHEN c.f = '' OR c.d = '' THEN 'floor or department empty'
    WHEN s.lo <> c.u OR s.hi <> c.u THEN 'floor and department belong to another unit'
    WHEN c.coef <= 0 THEN 'coefficient not positive' WHEN c.area <= 0 THEN 'area not positive' END AS reason
  FROM changes c LEFT JOIN spots s ON s.b = c.b AND s.f = c.f AND s.d = c.d),
claims AS (
  SELECT b, f, d, min(ordinal) AS ordinal, arg_min(u, ordinal) AS u FROM checked WHERE reason IS NULL GROUP BY ALL),
decided AS (
  SELECT c.* EXCLUDE (reason), CASE
    WHEN c.reason NOT IN ('coefficient not positive', 'area not positive') THEN c.reason
    WHEN m.ordinal < c.ordinal AND m.u <> c.u THEN 'floor and department belong to another unit'
    ELSE c.reason END AS reason
  FROM checked c LEFT JOIN claims m ON m.b = c.b AND m.f = c.f AND m.d = c.d)
"""
    length = [
        ("negocio.Consorcio", "Nombre"), ("negocio.Consorcio", "Domicilio"), ("gastos.Tipo_Gasto_Ordinario", "Nombre"),
        ("pagos.Forma_De_Pago", "Nombre"), ("pagos.Pago", "Cuenta_Origen"), ("unidades.Persona", "DNI"),
        ("unidades.Persona", "Nombre"), ("unidades.Persona", "Apellido"), ("unidades.Persona", "Email"),
        ("unidades.Persona", "Telefono"), ("unidades.Persona", "Cbu_Cvu"), ("unidades.Unidad_Funcional", "NroUF"),
        ("unidades.Unidad_Persona", "NroUF"),
    ]
    key = [
        ("negocio.Consorcio", "Id_Consorcio"), ("gastos.Tipo_Gasto_Ordinario", "Id_Tipo_Gasto"),
        ("pagos.Forma_De_Pago", "Id_Forma_De_Pago"), ("pagos.Pago", "Id_Pago"), ("unidades.Persona", "Id_Persona"),
        ("unidades.Unidad_Funcional", "Id_Consorcio, NroUF"), ("unidades.Unidad_Persona", "ID_U_P"),
    ]
    satisfied = [(t, "LENGTH", c) for t, c in length] + [(t, "PRIMARY KEY", c) for t, c in key] + [
        ("unidades.Persona", "NOT NULL", "DNI"), ("unidades.Persona", "NOT NULL", "Cbu_Cvu"),
        ("unidades.Unidad_Persona", "NOT NULL", "Id_Consorcio"),
        ("unidades.Unidad_Persona", "FOREIGN KEY unidades.Persona", "Id_Persona"),
        ("unidades.Unidad_Funcional", "FOREIGN KEY negocio.Consorcio", "Id_Consorcio"),
    ]
    counted = {
        ("gastos.Gasto_Ordinario", "PRIMARY KEY", "Id_gasto"):
            "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1)",
        ("gastos.Gasto_Ordinario", "FOREIGN KEY negocio.Consorcio", "Id_Consorcio"):
            "SELECT count(*) FROM lineitem WHERE l_suppkey % 30 NOT IN (SELECT n_nationkey FROM nation)",
        ("gastos.Gasto_Ordinario", "FOREIGN KEY gastos.Tipo_Gasto_Ordinario", "Id_Tipo_Gasto"):
            "SELECT count(*) FROM lineitem WHERE l_linenumber + 1 > 6",
        ("pagos.Pago", "FOREIGN KEY pagos.Forma_De_Pago", "Id_Forma_De_Pago"):
            "SELECT count(*) FROM orders WHERE o_orderkey % 5 NOT BETWEEN 1 AND 3",
        ("pagos.Pago", "NOT NULL", "Cuenta_Origen"): "SELECT count(*) FROM orders WHERE o_orderkey % 17 = 0",
        ("unidades.Unidad_Funcional", "LENGTH", "Departamento"):
            "SELECT count(*) FROM customer WHERE length(c_mktsegment) > 5",
        ("unidades.Unidad_Persona", "FOREIGN KEY unidades.Unidad_Funcional", "Id_Consorcio, NroUF"):
            "SELECT count(*) FROM customer WHERE c_custkey % 11 = 0 AND c_nationkey <> 7",
    }
    missing = [
        ("negocio.Consorcio", "MISSING TABLE negocio.Administracion", "Id_Administracion"),
        ("gastos.Gasto_Ordinario", "MISSING COLUMN", "Descripcion"),
        ("unidades.Unidad_Funcional", "MISSING COLUMN", "Piso"),
        ("unidades.Unidad_Persona", "MISSING TABLE unidades.TipoRelacionPersonaUnidad", "Id_TipoRelacion"),
    ]
    checks = [f"SELECT '{t}', '{r}', '{c}', CAST(0 AS BIGINT)" for t, r, c in satisfied]
    checks += [f"SELECT '{t}', '{r}', '{c}', CAST(1 AS BIGINT)" for t, r, c in missing]
    checks += [f"SELECT '{t}', '{r}', '{c}', CAST(({q}) AS BIGINT)" for (t, r, c), q in counted.items()]
    return {
        "o29_change_units": decided
        + """, last AS (
  SELECT b, u, arg_max({'f': f, 'd': d, 'coef': coef, 'area': area, 'storage': storage}, ordinal) AS new
  FROM decided WHERE reason IS NULL GROUP BY ALL)
SELECT units.b AS "Id_Consorcio", units.u AS "NroUF",
       CASE WHEN new IS NULL THEN units.f ELSE new.f END AS "Piso",
       CASE WHEN new IS NULL THEN units.d ELSE new.d END AS "Departamento",
       CASE WHEN new IS NULL THEN CAST(round(100.0 / count(*) OVER (PARTITION BY units.b), 2) AS DECIMAL(5,2))
            ELSE CAST(new.coef AS DECIMAL(5,2)) END AS "Coeficiente",
       CAST(CASE WHEN new IS NULL THEN c_custkey % 90 + 30 ELSE new.area END AS SMALLINT) AS "M2_UF",
       CASE WHEN new IS NULL THEN c_custkey % 3 = 0 ELSE new.storage END AS "Baulera",
       c_custkey % 2 = 0 AS "Cochera",
       CAST(CASE WHEN new IS NULL THEN c_custkey % 3 ELSE 1 END AS SMALLINT) AS "M2_Baulera",
       CAST(CASE WHEN new IS NULL THEN c_custkey % 2 END AS SMALLINT) AS "M2_Cochera"
FROM units LEFT JOIN last ON last.b = units.b AND last.u = units.u""",
        "o29_rejected_changes": decided + "SELECT ordinal, reason FROM decided WHERE reason IS NOT NULL",
        "o30_integrity_checks": "SELECT * FROM (" + " UNION ALL ".join(checks) + ") t(tabla, regla, columnas, filas)",
        "o31_all_seeds": """
WITH booked AS (
  SELECT l_returnflag = 'R' AS special, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
used AS (
  SELECT 'gastos.Tipo_Gasto_Ordinario' AS tabla, l_linenumber % 6 + 1 AS id, count(*) AS n FROM booked WHERE NOT special GROUP BY ALL
  UNION ALL
  SELECT 'gastos.Tipo_Pago_Extraordinario', l_linenumber % 3 + 1, count(*) FROM booked WHERE special GROUP BY ALL
  UNION ALL
  SELECT 'unidades.TipoRelacionPersonaUnidad', CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END, count(*) FROM customer GROUP BY ALL
  UNION ALL SELECT 'pagos.Forma_De_Pago', 1, count(*) FROM orders
  UNION ALL SELECT 'pagos.Tipo_ingreso', 1, count(*) FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'negocio.Administracion', 1, count(*) FROM nation)
SELECT t AS tabla, CAST(i AS INTEGER) AS id, nombre, CAST(coalesce(n, 0) AS BIGINT) AS filas
FROM (VALUES ('negocio.Administracion', 1, 'Administradora Central'),
  ('unidades.TipoRelacionPersonaUnidad', 1, 'Propietario'), ('unidades.TipoRelacionPersonaUnidad', 2, 'Inquilino'),
  ('pagos.Forma_De_Pago', 1, 'Transferencia Bancaria'), ('pagos.Forma_De_Pago', 2, 'Efectivo'),
  ('pagos.Forma_De_Pago', 3, 'Debito Automatico'), ('pagos.Tipo_ingreso', 1, 'EN TERMINO'),
  ('pagos.Tipo_ingreso', 2, 'ADEUDADO'), ('pagos.Tipo_ingreso', 3, 'ADELANTADO'),
  ('gastos.Tipo_Pago_Extraordinario', 1, 'Reparaciones'), ('gastos.Tipo_Pago_Extraordinario', 2, 'Mejoras'),
  ('gastos.Tipo_Pago_Extraordinario', 3, 'Fondo de Reserva'), ('gastos.Tipo_Gasto_Ordinario', 1, 'BANCARIOS'),
  ('gastos.Tipo_Gasto_Ordinario', 2, 'LIMPIEZA'), ('gastos.Tipo_Gasto_Ordinario', 3, 'ADMINISTRACION'),
  ('gastos.Tipo_Gasto_Ordinario', 4, 'SEGUROS'), ('gastos.Tipo_Gasto_Ordinario', 5, 'GASTOS GENERALES'),
  ('gastos.Tipo_Gasto_Ordinario', 6, 'SERVICIOS PUBLICOS'), ('gastos.Tipo_Servicio', 1, 'Agua'),
  ('gastos.Tipo_Servicio', 2, 'Luz'), ('gastos.Tipo_Servicio', 3, 'Gas')) seeds(t, i, nombre) LEFT JOIN used ON tabla = t AND id = i""",
        "o31_seed_tables": """
WITH kinds AS (
  SELECT unnest([1, 2, 3, 4, 5, 6]) AS kind,
         unnest(['BANCARIOS', 'LIMPIEZA', 'ADMINISTRACION', 'SEGUROS', 'GASTOS GENERALES', 'SERVICIOS PUBLICOS']) AS name),
booked AS (
  SELECT l_linenumber % 6 + 1 AS kind, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT kind AS "Id_Tipo_Gasto", name AS "Nombre", n AS gastos, CAST(amount AS DECIMAL(18,2)) AS importe
FROM kinds LEFT JOIN booked USING (kind)""",
    }


# One bill inside the recursion: own share, paid, carried, interest, debt, total (cents).
_EXACT = "(100 * (a.carry + b.bill.g) + CASE WHEN a.carry > 0 THEN 5 * a.carry ELSE 0 END)"


def _cents_away(expression: str) -> str:
    return f"CAST(sign({expression}) * ((2 * abs({expression}) + 100) // 200) AS BIGINT)"


_RECALCULATED = f"""list_reduce(
    list_transform(paid, lambda x: {{'carry': x.t - x.p, 'done': [x], 'bill': x}}),
    lambda a, b: {{
      'carry': {_cents_away(f"({_EXACT} - 100 * b.bill.p)")},
      'done': list_append(a.done, {{
        'month': b.bill.month, 'o': b.bill.o, 'x': b.bill.x, 'g': b.bill.g, 'p': b.bill.p, 'c': a.carry,
        'i': CASE WHEN a.carry > 0 THEN (10 * a.carry + 100) // 200 ELSE 0 END, 'd': greatest(a.carry, 0),
        't': {_cents_away(_EXACT)}}}),
      'bill': b.bill}}).done"""

_BILL_TYPE = "STRUCT(month DATE, o BIGINT, x BIGINT, g BIGINT, p BIGINT, c BIGINT, i BIGINT, d BIGINT, t BIGINT)[]"


def _ledger_sql(initial: str, events: str, *before: str) -> str:
    """Payments applied one bill at a time; every recursion step is one event or one application.

    *initial* gives building, unit, bills; *events* building, unit, n (from 1)
    and either cents and id of a payment or month, ord6 and ext6 of a bill.
    """
    rest = "coalesce(CASE WHEN bills[-1].month = (month - INTERVAL 1 MONTH)::DATE THEN bills[-1].t - bills[-1].p END, 0)"
    return _with(
        *before,
        f"events AS ({events})",
        f"""run AS (
  SELECT building, unit, 0::BIGINT AS n, 0::BIGINT AS remaining, 0::BIGINT AS id, 0 AS sequence, 0::BIGINT AS used,
         NULL::DATE AS target, 0 AS kind, bills::{_BILL_TYPE} AS bills
  FROM ({initial})
  UNION ALL
  SELECT building, unit, n, CASE WHEN len(bills) = 0 THEN 0 ELSE remaining - used END, id, sequence, used,
         bills[k].month, kind,
         CASE WHEN issue THEN list_append(bills, {{
                'month': month, 'o': (ord6 + 5000) // 10000, 'x': (ext6 + 5000) // 10000,
                'g': (ord6 + 5000) // 10000 + (ext6 + 5000) // 10000, 'p': 0, 'c': {rest},
                'i': {_cents_away(f"({rest} * 5)")}, 'd': {rest},
                't': CAST(sign({rest} * 10500 + ord6 + ext6)
                     * ((2 * abs({rest} * 10500 + ord6 + ext6) + 10000) // 20000) AS BIGINT)}})
              WHEN len(bills) = 0 OR used < remaining THEN paid
              ELSE {_RECALCULATED} END::{_BILL_TYPE}
  FROM (
    SELECT *, list_transform(bills, lambda y, j: {{
             'month': y.month, 'o': y.o, 'x': y.x, 'g': y.g, 'p': y.p + CASE WHEN j = k THEN used ELSE 0 END, 'c': y.c,
             'i': y.i, 'd': y.d, 't': y.t}}) AS paid
    FROM (
      SELECT *, coalesce(open, len(bills)) AS k, CASE WHEN open IS NULL THEN 3 ELSE 1 END AS kind,
             CASE WHEN issue OR len(bills) = 0 THEN 0 WHEN open IS NULL THEN remaining
                  ELSE least(remaining, bills[open].t - bills[open].p) END AS used
      FROM (
        SELECT r.building, r.unit, e.n, r.remaining = 0 AND e.cents IS NULL AS issue, r.bills,
               CASE WHEN r.remaining = 0 THEN coalesce(e.cents, 0) ELSE r.remaining END AS remaining,
               e.id, CASE WHEN r.remaining = 0 THEN 1 ELSE r.sequence + 1 END AS sequence, e.month, e.ord6, e.ext6,
               nullif(list_position(list_transform(r.bills, lambda z: z.t - z.p > 1), TRUE), 0) AS open
        FROM run r JOIN events e ON e.building = r.building AND e.unit = r.unit
             AND e.n = CASE WHEN r.remaining = 0 THEN r.n + 1 ELSE r.n END))))""",
        recursive=True,
    )


_DETAILS = f"""SELECT id AS "Id_Pago", sequence AS "Secuencia", building AS "Id_Consorcio", unit AS "NroUF",
       target AS "Periodo", kind AS "Id_Tipo_Ingreso", {_money("used")} AS "Importe_Usado"
FROM run WHERE used > 0"""

_FINAL_BILLS = f"""SELECT building AS "Id_Consorcio", unit AS "NroUF", b.month AS "Periodo", {_money("b.c")} AS "Saldo_Anterior",
       {_money("b.p")} AS "Pagos_Recibidos_Mes", {_money("b.d")} AS "Deuda", {_money("b.i")} AS "Interes_Por_Mora",
       {_money("b.o")} AS "Importe_Ordinario_Prorrateado", {_money("b.x")} AS "Importe_Extraordinario_Prorrateado",
       {_money("b.t")} AS "Total_A_Pagar"
FROM (SELECT building, unit, unnest(arg_max(bills, (n, sequence))) AS b FROM run GROUP BY building, unit)"""


# A third of all payments come from one account.
HOT_PAYMENTS = PAYMENTS.replace(
    "FROM orders JOIN", "FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM orders) JOIN"
)


def _given_sql(*base: str) -> str:
    return _ledger_sql(
        """SELECT building, unit, list({'month': month, 'o': ord::BIGINT, 'x': ext::BIGINT, 'g': (ord + ext)::BIGINT,
             'p': 0::BIGINT, 'c': 0::BIGINT, 'i': 0::BIGINT, 'd': 0::BIGINT, 't': total::BIGINT} ORDER BY month) AS bills
           FROM bills GROUP BY building, unit""",
        """SELECT building, unit, id, cents::BIGINT AS cents, NULL::DATE AS month, NULL::BIGINT AS ord6, NULL::BIGINT AS ext6,
             row_number() OVER (PARTITION BY building, unit ORDER BY day, id) AS n FROM payments""",
        *base,
    )


def _allocation_queries() -> dict[str, str]:
    given = _given_sql(*REPORT_BASE)
    closing = _ledger_sql(
        f"SELECT building, unit, []::{_BILL_TYPE} AS bills FROM units",
        """SELECT *, row_number() OVER (PARTITION BY building, unit ORDER BY month, cents IS NOT NULL, day, id) AS n
           FROM (SELECT building, unit, id, cents::BIGINT AS cents, month, day, NULL::BIGINT AS ord6, NULL::BIGINT AS ext6
                 FROM payments
                 UNION ALL
                 SELECT building, unit, NULL, NULL, month, month, ord6::BIGINT, ext6::BIGINT FROM shares)""",
        *REPORT_BASE,
    )
    return {
        "o13_allocate_payments": given + _DETAILS,
        "o13_allocated_bills": given + _FINAL_BILLS,
        "o14_close_months": closing + _FINAL_BILLS,
        "o14_close_months_details": closing + _DETAILS,
        "o14_continue_closing": closing + _FINAL_BILLS,
        "o28_allocate_encrypted_payments": given + _DETAILS,
    }


def slow_oracle_queries() -> dict[str, str]:
    """SQL that is right but takes minutes at sf0.01, as it recurses once per payment of the hot account."""
    hot = [HOT_PAYMENTS if part is PAYMENTS else part for part in REPORT_BASE]
    return {"o13_hot_account": _given_sql(*hot) + _DETAILS}
