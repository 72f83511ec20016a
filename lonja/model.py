"""Role tables: what the reports read, with declared types and keys.

Types: record ids that come from the source as floats with a fractional suffix are
``decimal(20,3)`` there; the role tables leave the id type to the binding (``id`` below
is any equality-comparable type).  Money is ``decimal(15,2)``, units ``decimal(10,2)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = T.DecimalType(20, 3)
MONEY = T.DecimalType(15, 2)
UNITS = T.DecimalType(10, 2)
RATE = T.DecimalType(5, 2)


@dataclass(frozen=True)
class TableSpec:
    """A maintained table: declared columns, primary key and partition columns.

    Facts are partitioned by month and day, so that a date filter and a YYYYMM filter both prune folders.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    int16_columns: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def missing_in(self, df: DataFrame) -> list[str]:
        return [c for c in self.columns if c not in df.columns]


_TYPES = {"string": T.StringType(), "date": T.DateType(), "int": T.IntegerType(), "long": T.LongType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _type(text: str) -> T.DataType:
    if text.startswith("decimal"):
        precision, scale = text[len("decimal("):-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _TYPES[text]


def _spec(name: str, columns: str, key: str = "", partition_by: str = "") -> TableSpec:
    """Columns as "name type, name type"; needs no running session."""
    fields = [T.StructField(n, _type(t)) for n, t in (c.split() for c in columns.split(", "))]
    return TableSpec(name, T.StructType(fields), tuple(key.split()), tuple(partition_by.split()))


_K, _M, _U = "decimal(20,3)", "decimal(15,2)", "decimal(10,2)"

SPECS: dict[str, TableSpec] = {
    s.name: s
    for s in [
        _spec("tickets", f"ticket_id {_K}, store string, sale_date date, hour int, net {_M}, "
              f"customer_id {_K}, is_sale boolean, month int", "ticket_id", "month sale_date"),
        _spec("lines", f"line_id {_K}, ticket_id {_K}, store string, item_id string, sale_date date, units {_U}, net {_M}, "
              f"cost {_M}, month int", "line_id", "month sale_date"),
        _spec("payments", f"payment_id {_K}, ticket_id {_K}, method string, method_code string, amount {_M}, "
              "paid_on date, store string, is_collection boolean", "payment_id"),
        _spec("items", f"item_id string, item_key {_K}, ref string, description string, family_id {_K}, "
              f"family string, department string, season string, brand string, sex string, color string, "
              f"supplier_id {_K}, unit_cost {_M}, list_price {_M}, vat_rate decimal(5,2), active boolean", "item_id"),
        _spec("stores", "store string, name string, town string, updated_on date", "store"),
        _spec("customers", f"customer_id {_K}, customer_no {_K}, name string, tax_id string, "
              "created_on date, last_purchase date, is_wholesale boolean", "customer_id"),
        _spec("suppliers", f"supplier_id {_K}, name string", "supplier_id"),
        _spec("reps", f"rep_id {_K}, rep string", "rep_id"),
        _spec("stock", "item_id string, store string, size string, qty int", "item_id store size"),
        _spec("central_stock", "item_id string, qty int", "item_id"),
        _spec("transfers", f"transfer_id {_K}, item_id string, size string, units_out {_U}, units_in {_U}, "
              "from_store string, to_store string, out_date date, in_date date, kind string, is_in boolean",
              "transfer_id"),
        _spec("invoices", f"invoice_id {_K}, invoice_date date, customer_id {_K}, rep_id {_K}, base1 {_M}, "
              f"base2 {_M}, base3 {_M}, total {_M}, credit_note boolean", "invoice_id"),
        _spec("invoice_lines", f"line_id {_K}, invoice_id {_K}, item_id string, description string, units {_U}, "
              f"total {_M}, cost {_M}", "line_id"),
        _spec("deliveries", f"delivery_id {_K}, delivery_no {_K}, customer_id {_K}, sent_on date, units {_U}, "
              f"base1 {_M}, base2 {_M}, base3 {_M}, credit_note boolean", "delivery_id"),
        _spec("wholesale_orders", f"order_id {_K}, order_no {_K}, customer_id {_K}, ordered_on date, ordered {_U}, "
              f"delivered {_U}, pending {_U}, season string, closed boolean, credit_note boolean", "order_id"),
        _spec("purchase_orders", f"po_id {_K}, supplier_id {_K}, ordered_on date, received_on date", "po_id"),
        _spec("purchase_lines", f"po_line_id {_K}, po_id {_K}, supplier_id {_K}, item_id string, units {_U}, "
              f"net {_M}", "po_line_id"),
        _spec("receipts", f"receipt_id {_K}, po_id {_K}, supplier_id {_K}, supplier_name string, received_on date",
              "receipt_id"),
        _spec("watermarks", "feed string, last_sync_at timestamp, rows_synced long, status string, error_msg string, "
              "updated_at timestamp", "feed"),
        _spec("runs", "run_id long, trigger string, kind string, started_at timestamp, finished_at timestamp, "
              "duration_ms long, status string, tables_ok int, tables_failed int, total_tables int, "
              "total_rows long", "run_id"),
        _spec("run_tables", "run_id long, feed string, started_at timestamp, finished_at timestamp, duration_ms long, "
              "status string, rows_synced long, method string, watermark_from timestamp, watermark_to timestamp, "
              "error_msg string", "run_id feed"),
    ]
}
