"""Declared tables: columns, keys, mandatory columns, lengths and references.

Surrogate ids are 64-bit and bill and settlement tables are keyed by what
identifies them (building, unit, month), so no global counter is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from prorrata.functions.money import MONEY, PERCENT

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "small": T.ShortType(),
    "flag": T.BooleanType(),
    "money": MONEY,
    "percent": PERCENT,
    "date": T.DateType(),
    "bytes": T.BinaryType(),
}


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


TABLES: dict[str, Table] = {}


def _table(name: str, columns: str, key: str, required: str = "", references: tuple = ()) -> Table:
    """Columns are given as `Name type`; `text20` is text of at most 20 characters."""
    fields, lengths = [], {}
    for column in columns.split(","):
        column_name, kind = column.split()
        if kind.startswith("text"):
            lengths[column_name] = int(kind[4:])
            fields.append(T.StructField(column_name, T.StringType()))
        else:
            fields.append(T.StructField(column_name, _TYPES[kind]))
    table = Table(
        name,
        T.StructType(fields),
        tuple(key.split()),
        tuple(required.split()),
        lengths,
        tuple(Reference(tuple(c.split()), t, tuple(k.split())) for c, t, k in references),
    )
    TABLES[name] = table
    return table


_TO_CONDOMINIUM = ("Id_Consorcio", "negocio.Consorcio", "Id_Consorcio")
_TO_UNIT = ("Id_Consorcio NroUF", "unidades.Unidad_Funcional", "Id_Consorcio NroUF")
_TO_EXPENSE = ("Id_gasto", "gastos.Gasto_Ordinario", "Id_gasto")

ADMINISTRATION = _table(
    "negocio.Administracion",
    "Id_Administracion int, Razon_Social text100, CUIT text20, Direccion text100, Telefono text20,"
    "Email text100, Cuenta_Deposito text22, Precio_Cochera_Default money, Precio_Baulera_Default money",
    "Id_Administracion",
)
CONDOMINIUM = _table(
    "negocio.Consorcio",
    "Id_Consorcio int, Id_Administracion int, Nombre text100, Domicilio text100, Cant_unidades small,"
    "MetrosCuadrados int, Precio_Cochera money, Precio_Baulera money",
    "Id_Consorcio",
    references=(("Id_Administracion", "negocio.Administracion", "Id_Administracion"),),
)
SUPPLIER = _table(
    "negocio.Proveedor",
    "Id_Proveedor long, Id_Consorcio int, Nombre_Gasto text60, Descripcion text100, Cuenta text50",
    "Id_Proveedor",
    references=(_TO_CONDOMINIUM,),
)
EXTRAORDINARY_TYPE = _table("gastos.Tipo_Pago_Extraordinario", "Id_tipo_pago int, Nombre text50", "Id_tipo_pago")
EXTRAORDINARY_EXPENSE = _table(
    "gastos.Gasto_Extraordinario",
    "Id_gasto long, Id_Consorcio int, Id_tipo_pago int, detalle_trabajo text120, Nro_Cuotas_Actual small,"
    "Total_Cuotas small, Importe money, Fecha date",
    "Id_gasto",
    references=(_TO_CONDOMINIUM, ("Id_tipo_pago", "gastos.Tipo_Pago_Extraordinario", "Id_tipo_pago")),
)
ORDINARY_TYPE = _table("gastos.Tipo_Gasto_Ordinario", "Id_Tipo_Gasto int, Nombre text50", "Id_Tipo_Gasto")
ORDINARY_EXPENSE = _table(
    "gastos.Gasto_Ordinario",
    "Id_gasto long, Id_Consorcio int, Id_Tipo_Gasto int, Fecha date, Importe_Total money, Descripcion text50",
    "Id_gasto",
    references=(_TO_CONDOMINIUM, ("Id_Tipo_Gasto", "gastos.Tipo_Gasto_Ordinario", "Id_Tipo_Gasto")),
)
SERVICE_TYPE = _table("gastos.Tipo_Servicio", "Id_Tipo_Servicio int, Nombre text50", "Id_Tipo_Servicio")
UNIT = _table(
    "unidades.Unidad_Funcional",
    "Id_Consorcio int, NroUF text10, Piso text5, Departamento text5, Coeficiente percent, M2_UF small,"
    "Baulera flag, Cochera flag, M2_Baulera small, M2_Cochera small",
    "Id_Consorcio NroUF",
    references=(_TO_CONDOMINIUM,),
)
RELATION_TYPE = _table(
    "unidades.TipoRelacionPersonaUnidad", "ID_Tipo_Relacion_P_U int, Nombre text50", "ID_Tipo_Relacion_P_U"
)
PERSON = _table(
    "unidades.Persona",
    "Id_Persona long, DNI text15, Nombre text80, Apellido text80, Email text100, Telefono text20,"
    "inquilino flag, Cbu_Cvu text22",
    "Id_Persona",
    required="DNI Cbu_Cvu",
)
UNIT_PERSON = _table(
    "unidades.Unidad_Persona",
    "ID_U_P long, Id_Consorcio int, NroUF text10, Id_Persona long, Id_TipoRelacion int, Fecha_Inicio date,"
    "Fecha_Fin date",
    "ID_U_P",
    required="Id_Consorcio",
    references=(
        _TO_UNIT,
        ("Id_Persona", "unidades.Persona", "Id_Persona"),
        ("Id_TipoRelacion", "unidades.TipoRelacionPersonaUnidad", "ID_Tipo_Relacion_P_U"),
    ),
)
SETTLEMENT = _table(
    "liquidacion.Liquidacion_Mensual",
    "Id_Consorcio int, Periodo date, Fecha_Emision date, Fecha_Vencimiento1 date, Fecha_Vencimiento2 date,"
    "Total_Gasto_Ordinarios money, Total_Gasto_Extraordinarios money",
    "Id_Consorcio Periodo",
    references=(_TO_CONDOMINIUM,),
)
BILL = _table(
    "liquidacion.Detalle_Expensa_UF",
    "Id_Consorcio int, NroUF text10, Periodo date, Saldo_Anterior money, Pagos_Recibidos_Mes money, Deuda money,"
    "Interes_Por_Mora money, Importe_Ordinario_Prorrateado money, Importe_Extraordinario_Prorrateado money,"
    "Total_A_Pagar money",
    "Id_Consorcio NroUF Periodo",
    references=(("Id_Consorcio Periodo", "liquidacion.Liquidacion_Mensual", "Id_Consorcio Periodo"), _TO_UNIT),
)
PAYMENT_METHOD = _table("pagos.Forma_De_Pago", "Id_Forma_De_Pago int, Nombre text50", "Id_Forma_De_Pago")
PAYMENT = _table(
    "pagos.Pago",
    "Id_Pago long, Id_Forma_De_Pago int, Fecha date, Cuenta_Origen text22, Importe money, Es_Pago_Asociado flag,"
    "Procesado flag",
    "Id_Pago",
    required="Cuenta_Origen",
    references=(("Id_Forma_De_Pago", "pagos.Forma_De_Pago", "Id_Forma_De_Pago"),),
)
INCOME_TYPE = _table("pagos.Tipo_ingreso", "Id_Tipo_Ingreso int, Nombre text50", "Id_Tipo_Ingreso")
PAYMENT_DETAIL = _table(
    "pagos.Detalle_Pago",
    "Id_Pago long, Secuencia int, Id_Consorcio int, NroUF text10, Periodo date, Id_Tipo_Ingreso int,"
    "Importe_Usado money",
    "Id_Pago Secuencia",
    references=(
        ("Id_Pago", "pagos.Pago", "Id_Pago"),
        ("Id_Consorcio NroUF Periodo", "liquidacion.Detalle_Expensa_UF", "Id_Consorcio NroUF Periodo"),
        ("Id_Tipo_Ingreso", "pagos.Tipo_ingreso", "Id_Tipo_Ingreso"),
    ),
)

# Declared in the data model, but no operation writes or reads them.
_table(
    "negocio.Estado_Financiero",
    "Id_Estado_Financiero long, Id_Consorcio int, Saldo_Anterior money, Periodo date, Ingreso_Exp_Termino money,"
    "Ingreso_Exp_Adeudada money, Ingreso_Exp_Adelantada money, Egresos_Mes money, Saldo_Cierre money",
    "Id_Estado_Financiero",
    references=(_TO_CONDOMINIUM,),
)
_table("gastos.Gasto_Administracion", "Id_gasto long, Nro_Factura int", "Id_gasto", references=(_TO_EXPENSE,))
_table(
    "gastos.Gasto_Seguro", "Id_gasto long, Nro_Factura int, NombreSeguro text50", "Id_gasto", references=(_TO_EXPENSE,)
)
_table(
    "gastos.Gasto_General",
    "Id_gasto long, Descripcion text100, Nombre_Responsable text60, Nro_factura text50",
    "Id_gasto",
    references=(_TO_EXPENSE,),
)
_table(
    "gastos.Empresa_Limpieza",
    "Id_gasto long, Nombre_Empresa text50, Nro_factura int",
    "Id_gasto",
    references=(_TO_EXPENSE,),
)
_table("gastos.Gasto_Mantenimiento", "Id_gasto long, CBU text22", "Id_gasto", references=(_TO_EXPENSE,))
_table(
    "gastos.Empleado_Limpieza",
    "Id_gasto long, Sueldo money, Factura_Productos money",
    "Id_gasto",
    references=(_TO_EXPENSE,),
)
_table(
    "gastos.Gasto_Servicio_Publico",
    "Id_gasto long, Id_Tipo_Servicio int, Nombre_Empresa text50, Nro_Factura int",
    "Id_gasto",
    references=(_TO_EXPENSE, ("Id_Tipo_Servicio", "gastos.Tipo_Servicio", "Id_Tipo_Servicio")),
)
_table("liquidacion.Mora", "Id_Mora int, Porcentajes_Interes percent, Dias_Desde_Vencimiento int", "Id_Mora")

UNIT_KEY = list(UNIT.key)
SETTLEMENT_KEY = list(SETTLEMENT.key)
BILL_KEY = list(BILL.key)

# Encrypted forms: ciphertext columns plus the index columns that matching uses.
PERSONAL_COLUMNS = ("DNI", "Nombre", "Apellido", "Email", "Telefono", "Cbu_Cvu")
