"""Role tables from the mirror tables of the ERP.

``BINDINGS`` states which mirror column feeds which role column; everything else is a plain
select.  A bound column that a mirror lacks is an error, but for those in ``LATER``, which were added to the mirror
after its first tables and are NULL until then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.functions.predicates import month_of
from lonja.model import SPECS
from lonja.operators.ingest import project_rename
from lonja.sources.star import Star

# Mirror table of each role, and role column = mirror column.
BINDINGS: dict[str, tuple[str, str]] = {
    "tickets": ("ps_ventas", "ticket_id=reg_ventas store=tienda sale_date=fecha_creacion hour=hora_creacion net=total_si "
                             "customer_id=num_cliente is_sale=entrada"),
    "lines": ("ps_lineas_ventas", "line_id=reg_lineas ticket_id=num_ventas store=tienda item_id=codigo sale_date=fecha_creacion "
                                  "units=unidades net=total_si cost=total_coste_si month=mes"),
    "payments": ("ps_pagos_ventas", "payment_id=reg_pagos ticket_id=num_ventas method=forma method_code=codigo_forma "
                                    "amount=importe_cob paid_on=fecha_creacion store=tienda is_collection=entrada"),
    "stores": ("ps_tiendas", "store=codigo name=identificador town=poblacion updated_on=fecha_modifica"),
    "customers": ("ps_clientes", "customer_id=reg_cliente customer_no=num_cliente name=nombre tax_id=nif "
                                 "created_on=fecha_creacion last_purchase=ultima_compra_f"),
    "suppliers": ("ps_proveedores", "supplier_id=reg_proveedor name=nombre"),
    "reps": ("ps_gc_comerciales", "rep_id=reg_comercial rep=comercial"),
    "stock": ("ps_stock_tienda", "item_id=codigo store=tienda size=talla qty=stock"),
    "transfers": ("ps_traspasos", "transfer_id=reg_traspaso item_id=codigo size=talla units_out=unidades_s "
                                  "units_in=unidades_e from_store=tienda_salida to_store=tienda_entrada "
                                  "out_date=fecha_s in_date=fecha_e kind=tipo is_in=entrada"),
    "invoices": ("ps_gc_facturas", "invoice_id=reg_factura invoice_date=fecha_factura customer_id=num_cliente "
                                   "rep_id=num_comercial base1=base1 base2=base2 base3=base3 total=total_factura credit_note=abono"),
    "invoice_lines": ("ps_gc_lin_facturas", "line_id=reg_linea invoice_id=num_factura item_id=codigo "
                                            "description=descripcion units=unidades total=total cost=total_coste"),
    "deliveries": ("ps_gc_albaranes", "delivery_id=reg_albaran delivery_no=n_albaran customer_id=num_cliente sent_on=fecha_envio "
                                      "units=entregadas base1=base1 base2=base2 base3=base3 credit_note=abono"),
    "wholesale_orders": ("ps_gc_pedidos", "order_id=reg_pedido order_no=n_pedido customer_id=num_cliente ordered_on=fecha_pedido "
                                          "ordered=unidades delivered=entregadas pending=pendientes season=temporada "
                                          "closed=pedido_cerrado credit_note=abono"),
    "purchase_orders": ("ps_compras", "po_id=reg_pedido supplier_id=num_proveedor ordered_on=fecha_pedido received_on=fecha_recibido"),
    "purchase_lines": ("ps_lineas_compras", "po_line_id=reg_linea_compra po_id=num_pedido supplier_id=num_proveedor "
                                            "item_id=num_articulo units=unidades net=total_si"),
    "receipts": ("ps_albaranes", "receipt_id=reg_albaran po_id=num_pedido supplier_id=num_proveedor "
                                 "supplier_name=proveedor received_on=fecha_recibido"),
    "watermarks": ("etl_watermarks", "feed=table_name last_sync_at=last_sync_at rows_synced=rows_synced status=status "
                                     "error_msg=error_msg updated_at=updated_at"),
    "runs": ("etl_sync_runs", "run_id=id trigger=trigger kind=kind started_at=started_at finished_at=finished_at "
                              "duration_ms=duration_ms status=status tables_ok=tables_ok tables_failed=tables_failed "
                              "total_tables=total_tables total_rows=total_rows_synced"),
    "run_tables": ("etl_sync_run_tables", "run_id=run_id feed=table_name started_at=started_at finished_at=finished_at "
                                          "duration_ms=duration_ms status=status rows_synced=rows_synced method=sync_method "
                                          "watermark_from=watermark_from watermark_to=watermark_to error_msg=error_msg"),
}


LATER = {"hora_creacion"}


def hour_of(df: DataFrame, column: str) -> Column:
    """Hour of day from a time of day, however the mirror stores it: time, timestamp, text "HH:MM:SS" or a number."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("int")
    if isinstance(kind, T.StringType):
        return F.substring_index(F.trim(column), ":", 1).try_cast("int")
    return F.hour(column)


class MirrorStar(Star):
    """``table(name)`` returns a mirror table, for example ``lambda n: spark.read.parquet(f"{root}/{n}")``."""

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], ghost_store: str = "99"):
        super().__init__(spark)
        self._table = table
        self.ghost_store = ghost_store

    def _build(self, role: str) -> DataFrame:
        if hasattr(type(self), f"_{role}"):
            return getattr(self, f"_{role}")()
        return self._bound(role)

    def _bound(self, role: str) -> DataFrame:
        name, pairs = BINDINGS[role]
        mapping = {source: target for target, source in (p.split("=") for p in pairs.split())}
        table = self._table(name)
        if missing := {*mapping} - LATER - {c.lower() for c in table.columns}:
            raise LookupError(f"{name} lacks {sorted(missing)}")
        if "hora_creacion" in mapping and "hora_creacion" in table.columns:
            table = table.withColumn("hora_creacion", hour_of(table, "hora_creacion"))
        return project_rename(table, mapping, SPECS[role])

    def _tickets(self) -> DataFrame:
        return self._bound("tickets").withColumn("month", month_of("sale_date"))

    def _customers(self) -> DataFrame:
        """The mirror does not say which customers are wholesale ones."""
        return self._bound("customers").withColumn("is_wholesale", F.lit(None).cast("boolean"))

    def _items(self) -> DataFrame:
        """Items with the labels of their family, department, brand and color; unresolved ones stay."""
        items = self._table("ps_articulos")
        families = self._table("ps_familias").select(F.col("reg_familia").alias("num_familia"), F.col("reg_familia").alias("family_id"),
                                                     F.col("fami_grup_marc").alias("family"))
        departments = self._table("ps_departamentos").select(F.col("reg_departament").alias("num_departament"),
                                                             F.col("depa_secc_fabr").alias("department"))
        brands = self._table("ps_marcas").select(F.col("reg_marca").alias("num_marca"), F.col("clave").alias("brand"))
        joined = (items.join(families, "num_familia", "left").join(departments, "num_departament", "left")
                  .join(brands, "num_marca", "left"))
        return joined.select(
            F.col("codigo").alias("item_id"), F.col("reg_articulo").alias("item_key"), F.col("ccrefejofacm").alias("ref"),
            F.col("descripcion").alias("description"), "family_id", "family", "department", F.col("clave_temporada").alias("season"),
            "brand", F.col("sexo").alias("sex"), "color", F.col("num_proveedor").alias("supplier_id"),
            F.col("precio_coste").alias("unit_cost"), F.col("precio1").alias("list_price"), F.col("p_iva").alias("vat_rate"),
            (~F.col("anulado")).alias("active"))

    def _central_stock(self) -> DataFrame:
        """Central stock is kept by item record; the reports use the item code."""
        codes = self._table("ps_articulos").select(F.col("reg_articulo").alias("num_articulo"), F.col("codigo").alias("item_id"))
        stock = self._table("ps_stock_central").select("num_articulo", F.col("stock").alias("qty"))
        named = stock.join(codes, "num_articulo", "left")
        return named.select(F.coalesce("item_id", F.col("num_articulo").cast("string")).alias("item_id"), "qty")

    def _purchase_lines(self) -> DataFrame:
        """Purchase lines name the item record; lines of unknown items keep the record id."""
        lines = self._bound("purchase_lines").withColumn("item_key", F.col("item_id").cast("decimal(20,3)"))
        codes = self._table("ps_articulos").select(F.col("reg_articulo").alias("item_key"), F.col("codigo").alias("code"))
        return lines.join(codes, "item_key", "left").withColumn("item_id", F.coalesce("code", "item_id")).drop("code", "item_key")

    def _collections(self) -> DataFrame:
        raise LookupError("the mirror has no table of collections; reports on them need a source of their own")
