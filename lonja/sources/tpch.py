"""Role tables derived from the TPC-H style test tables.

The retail and wholesale channels are split by customer segment before anything else.
Joins here carry no broadcast hints: the optimizer broadcasts a side only when its size
statistics are under the session threshold, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.predicates import month_of
from lonja.session import stored_bytes
from lonja.sources.star import Star

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

WHOLESALE_SEGMENT = "MACHINERY"


def _hundredths(column: str) -> Column:
    return F.rint(F.col(column) * 100).cast("bigint")


def _from_hundredths(n: Column, decimal_type: str) -> Column:
    return (n.cast("decimal(17,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(decimal_type)


def money(column: str | Column) -> Column:
    """Exact decimal amount.  A double column goes through whole cents, which is faster than the text route of a cast."""
    if isinstance(column, Column):
        return column.cast("decimal(15,2)")
    return _from_hundredths(_hundredths(column), "decimal(15,2)")


def units(column: str) -> Column:
    return _from_hundredths(_hundredths(column), "decimal(10,2)")


def line_net() -> Column:
    """Price less discount in whole cents, half a cent away from zero."""
    exact = _hundredths("l_extendedprice") * (100 - _hundredths("l_discount"))
    cents = F.floor((F.abs(exact) + 50) / 100) * F.signum(exact)
    return _from_hundredths(cents.cast("bigint"), "decimal(15,2)")


class TpchStar(Star):
    ghost_store = "24"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            self._raw[table] = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}.parquet")
        return self._raw[table]

    def largest_bytes(self) -> int:
        """Stored size of the largest table that reports shuffle."""
        return max(stored_bytes(self.spark, f"{self.path}/{t}.parquet") for t in ("lineitem", "orders", "events"))

    def _build(self, role: str) -> DataFrame:
        return getattr(self, f"_{role}")()

    # --- dimensions ---

    def _stores(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("string").alias("store"),
            F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("name"),
            F.when(F.col("n_nationkey") % 10 != 0, F.concat(F.lit("Town "), F.col("n_regionkey"))).alias("town"),
            F.make_date(F.lit(2001), F.lit(1), F.col("n_nationkey") + 1).alias("updated_on"))

    def _customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("customer_id"), key.cast("decimal(20,3)").alias("customer_no"),
            F.when(key % 3 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
            F.when(key % 2 == 0, F.concat(F.lit("NIF"), key)).alias("tax_id"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 2400).cast("int")).alias("created_on"),
            F.date_add(F.lit("2001-01-01").cast("date"), (key % 200).cast("int")).alias("last_purchase"),
            F.col("c_nationkey").cast("string").alias("store"),
            (F.col("c_mktsegment") == WHOLESALE_SEGMENT).alias("is_wholesale"))

    def _items(self) -> DataFrame:
        size, kind, name = F.col("p_size"), F.col("p_type"), F.col("p_name")
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"), F.concat_ws("-", kind, "p_partkey").alias("ref"),
            F.when(size != 15, name).alias("description"),
            F.when(size != 14, kind).alias("family_id"),
            F.when(size == 13, " ").when(size != 14, F.concat(kind, F.when(size % 2 == 0, " ").otherwise(""))).alias("family"),
            F.substring_index(name, " ", -1).alias("department"), F.substring_index(name, " ", 1).alias("color"),
            F.concat(F.when(size % 2 == 0, "PV0").otherwise("OI0"), size % 7).alias("season"),
            F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 2 == 0, "H").otherwise("M").alias("sex"),
            (F.col("p_partkey") % 100).alias("supplier_id"), money("p_retailprice").alias("unit_cost"),
            money(money("p_retailprice") * F.lit("1.60").cast("decimal(4,2)")).alias("list_price"),
            F.lit("21.00").cast("decimal(5,2)").alias("vat_rate"), (size <= 45).alias("active"))

    def _suppliers(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                           F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("name"))

    def _reps(self) -> DataFrame:
        return self.raw("nation").where("n_nationkey > 0").select(
            F.col("n_nationkey").alias("rep_id"),
            F.when(F.col("n_nationkey") % 6 == 1, " ").otherwise(F.col("n_name")).alias("rep"))

    # --- retail channel ---

    def _orders_of(self, wholesale: bool) -> DataFrame:
        keep = F.col("is_wholesale") if wholesale else ~F.col("is_wholesale")
        who = self.customers.where(keep).select(F.col("customer_id").alias("o_custkey"), "store")
        return self.raw("orders").join(who, "o_custkey")

    def _tickets(self) -> DataFrame:
        is_sale, day = F.col("o_orderstatus") != "P", F.to_date("o_orderdate")
        amount = money("o_totalprice")
        return self._orders_of(False).select(
            F.col("o_orderkey").alias("ticket_id"), "store", day.alias("sale_date"), F.hour("o_orderdate").alias("hour"),
            F.when(is_sale, amount).otherwise(-amount).cast("decimal(15,2)").alias("net"),
            # one customer in forty buys anonymously
            F.when(F.col("o_custkey") % 40 == 0, 0).otherwise(F.col("o_custkey")).alias("customer_id"),
            is_sale.alias("is_sale"), month_of("o_orderdate").alias("month"))

    def _lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("ticket_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_linenumber").alias("line_no"), F.to_date("l_shipdate").alias("sale_date"),
            units("l_quantity").alias("units"), line_net().alias("net"), F.lit(None).cast("decimal(15,2)").alias("cost"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount"),
            month_of("l_shipdate").alias("month"))

    def _payments(self) -> DataFrame:
        return self._orders_of(False).select(
            F.col("o_orderkey").alias("payment_id"), F.col("o_orderkey").alias("ticket_id"),
            F.col("o_orderpriority").alias("method"), F.left("o_orderpriority", F.lit(1)).alias("method_code"),
            money("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("paid_on"), "store",
            (F.col("o_orderstatus") != "P").alias("is_collection"))

    def payments_of(self, method_code: str) -> DataFrame:
        """Customers who used a payment method."""
        used = self.raw("orders").where(F.col("o_orderpriority").startswith(method_code))
        return used.select(F.col("o_custkey").alias("customer_id"))

    # --- stock ---

    def _supplied_lines(self, columns: list[str]) -> DataFrame:
        where_from = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        return self.raw("lineitem").select("l_suppkey", *columns).join(where_from, "l_suppkey").withColumn(
            "store", F.col("s_nationkey").cast("string"))

    def _signed_qty(self) -> Column:
        q = F.col("l_quantity").cast("int")
        return F.sum(F.when(F.col("l_returnflag") == "R", -q).otherwise(q)).cast("int")

    def _stock(self) -> DataFrame:
        """Cells per item, store and size; grouped by the source's integer keys, labelled afterwards."""
        rows = self._supplied_lines(["l_partkey", "l_linenumber", "l_quantity", "l_returnflag"])
        cells = (rows.where(F.col("store") != self.ghost_store).groupBy("l_partkey", "s_nationkey", "l_linenumber")
                 .agg(self._signed_qty().alias("qty")))
        return cells.select(F.col("l_partkey").alias("item_id"), F.col("s_nationkey").cast("string").alias("store"),
                            F.col("l_linenumber").cast("string").alias("size"), "qty")

    def _central_stock(self) -> DataFrame:
        rows = self._supplied_lines(["l_partkey", "l_quantity", "l_returnflag"])
        return (rows.where(F.col("store") == self.ghost_store)
                .groupBy(F.col("l_partkey").alias("item_id")).agg(self._signed_qty().alias("qty")))

    def wide_stock(self, slots: int = 7) -> DataFrame:
        """Source form of the stock: one row per item and store, a label and an unsigned 16-bit carrier per slot."""
        cells = self.stock
        out = []
        for i in range(1, slots + 1):
            hit = F.col("size") == str(i)
            out += [F.max(F.when(hit, F.concat(F.lit(" "), F.col("size"), F.lit(" ")))).alias(f"talla{i}"),
                    F.max(F.when(hit, F.pmod("qty", F.lit(65536)))).alias(f"stock{i}")]
        return cells.groupBy("item_id", "store").agg(*out)

    def _transfers(self) -> DataFrame:
        home = self._orders_all().select("o_orderkey", F.col("store").alias("to_store"))
        legs = self._supplied_lines(["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate",
                                     "l_returnflag", "l_linestatus"])
        moved = legs.join(home, F.col("l_orderkey") == F.col("o_orderkey"))
        base = moved.select(
            F.col("l_orderkey").alias("transfer_id"), F.col("l_partkey").alias("item_id"),
            F.col("l_linenumber").cast("string").alias("size"), units("l_quantity").alias("units_out"),
            units("l_quantity").alias("units_in"), F.col("store").alias("from_store"), "to_store",
            F.to_date("l_shipdate").alias("out_date"),
            F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("in_date"),
            F.col("l_returnflag").alias("kind"))
        # two rows per movement; a filter on is_in prunes one branch at planning time
        return (base.withColumn("is_in", F.lit(False))
                .unionByName(base.withColumn("is_in", F.lit(True))))

    def _orders_all(self) -> DataFrame:
        who = self.customers.select(F.col("customer_id").alias("o_custkey"), "store")
        return self.raw("orders").join(who, "o_custkey")

    # --- wholesale channel ---

    def _invoices(self) -> DataFrame:
        total = money("o_totalprice")
        base1 = (total * F.lit("0.70").cast("decimal(3,2)")).cast("decimal(15,2)")
        return self._orders_of(True).select(
            F.col("o_orderkey").alias("invoice_id"), F.to_date("o_orderdate").alias("invoice_date"),
            F.col("o_custkey").alias("customer_id"), F.col("store").cast("int").alias("rep_id"),
            base1.alias("base1"), (total - base1).cast("decimal(15,2)").alias("base2"),
            F.when(F.left("o_orderpriority", F.lit(1)) != "5", F.lit(0)).cast("decimal(15,2)").alias("base3"),
            total.alias("total"), (F.col("o_orderstatus") == "P").alias("credit_note"),
            month_of("o_orderdate").alias("month"))

    def _invoice_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("item_id"),
            F.concat(F.lit("line "), F.col("l_linenumber")).alias("description"), units("l_quantity").alias("units"),
            line_net().alias("total"), F.lit(None).cast("decimal(15,2)").alias("cost"),
            F.to_date("l_shipdate").alias("line_date"), month_of("l_shipdate").alias("month"))

    def _deliveries(self) -> DataFrame:
        """One delivery per wholesale order line."""
        head = self._orders_of(True).select("o_orderkey", F.col("o_custkey").alias("customer_id"))
        rows = self.raw("lineitem").join(head, F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("delivery_id"),
            F.col("l_orderkey").alias("delivery_no"), "customer_id", F.to_date("l_shipdate").alias("sent_on"),
            units("l_quantity").alias("units"), line_net().alias("base1"), money(F.lit(0)).alias("base2"),
            F.when(F.col("l_linenumber") != 7, money(F.lit(0))).alias("base3"),
            (F.col("l_returnflag") == "R").alias("credit_note"))

    def _wholesale_orders(self) -> DataFrame:
        qty, shipped = units("l_quantity"), F.col("l_linestatus") == "F"
        lines = self.raw("lineitem").select("l_orderkey", "l_quantity", "l_linestatus")
        head = self._orders_of(True).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        sums = lines.join(head, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").agg(
            F.sum(qty).cast("decimal(20,2)").alias("ordered"),
            F.coalesce(F.sum(F.when(shipped, qty)), F.lit(0)).cast("decimal(20,2)").alias("delivered"))
        return sums.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("order_no"),
            F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("ordered_on"), "ordered", "delivered",
            (F.col("ordered") - F.col("delivered")).cast("decimal(20,2)").alias("pending"),
            F.concat(F.lit("PV"), F.date_format("o_orderdate", "yy")).alias("season"),
            (F.col("o_orderstatus") == "F").alias("closed"), (F.col("o_orderstatus") == "P").alias("credit_note"))

    def _collections(self) -> DataFrame:
        """Collected amounts per invoice: part of the invoice, in one or two payments, or nothing."""
        inv = self.invoices
        share = (F.col("total") * F.lit("0.50").cast("decimal(3,2)")).cast("decimal(15,2)")
        first = inv.where(F.col("invoice_id") % 3 != 0).select("invoice_id", share.alias("amount"))
        second = inv.where(F.col("invoice_id") % 3 == 1).select(
            "invoice_id", (F.col("total") - share).cast("decimal(15,2)").alias("amount"))
        return first.unionByName(second)

    # --- purchasing: an order with several suppliers is one purchase order per supplier ---

    def _purchase_orders(self) -> DataFrame:
        # joined before grouping: a filter on the order date reaches the order scan, and the grouping
        # reuses the partitioning of the join
        lines = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linestatus")
        heads = self.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered_on"))
        grouped = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_suppkey", "ordered_on").agg(
            F.max("l_shipdate").alias("last_in"), F.bool_or(F.col("l_linestatus") == "O").alias("waiting"))
        return grouped.select(_po_id().alias("po_id"), F.col("l_suppkey").alias("supplier_id"), "ordered_on",
                              F.when(~F.col("waiting"), F.to_date("last_in")).alias("received_on"))

    def _purchase_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_suppkey", "l_linenumber").alias("po_line_id"), _po_id().alias("po_id"),
            F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("item_id"),
            units("l_quantity").alias("units"), line_net().alias("net"))

    def _receipts(self) -> DataFrame:
        return self.purchase_orders.where("received_on IS NOT NULL").join(self.suppliers, "supplier_id", "left").select(
            F.concat(F.lit("R"), F.col("po_id")).alias("receipt_id"), "po_id", "supplier_id",
            F.col("name").alias("supplier_name"), "received_on")

    # --- pipeline control, derived from the event stream ---

    def _events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").withColumn("k", k)

    def _run_tables(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        ms = F.floor(F.col("value") * 1000).cast("bigint")
        return self._events().select(
            F.col("event_id").alias("entry_id"), F.col("user_id").alias("run_id"),
            F.concat(F.col("event_type"), F.lit("_"), F.col("k") % 4).alias("feed"), F.col("ts").alias("started_at"),
            ms.alias("duration_ms"), F.when(failed, "failed").otherwise("ok").alias("status"),
            F.when(failed, 0).otherwise(F.col("k")).cast("bigint").alias("rows_synced"))

    def _runs(self) -> DataFrame:
        from lonja.operators import control
        return control.summarise_runs(self.run_tables)

    def _watermarks(self) -> DataFrame:
        newest = self.run_tables.groupBy("feed").agg(
            F.max("started_at").alias("last_sync_at"), F.max_by("status", F.struct("started_at", "entry_id")).alias("last"),
            F.sum("rows_synced").alias("rows_synced"))
        return newest.select("feed", "last_sync_at", "rows_synced",
                             F.when(F.col("last") == "failed", "error").otherwise("ok").alias("status"))


def _po_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_suppkey")


_STARS: dict[tuple, TpchStar] = {}


def tpch_star(spark: SparkSession, path: str) -> TpchStar:
    """One binding per session and folder, so that its plans are built once."""
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _STARS:
        _STARS[key] = TpchStar(spark, path)
    return _STARS[key]


def intraday_star(star: TpchStar) -> Star:
    """Event stream read as timed tickets (an error is a return), for the reports that need the hour."""
    from lonja.sources.star import FrameStar

    tickets = star.raw("events").select(
        F.col("event_id").alias("ticket_id"), (F.col("user_id") % 25).cast("string").alias("store"),
        F.to_date("ts").alias("sale_date"), F.hour("ts").alias("hour"),
        F.when(F.col("event_type") == "error", -money("value")).otherwise(money("value")).cast("decimal(15,2)").alias("net"),
        F.col("user_id").alias("customer_id"), (F.col("event_type") != "error").alias("is_sale"), month_of("ts").alias("month"))
    return FrameStar(star.spark, {"tickets": tickets, "stores": star.stores}, star.ghost_store)
