"""Reports over hand-made mirror tables: rules the test tables do not exercise."""

import datetime as dt
from decimal import Decimal as X

import pytest

from lonja.functions.periods import Range
from lonja.operators.filters import Filters
from lonja.plans import analyses, base, general, home, purchasing, questions, review, sales, stock, wholesale
from lonja.sources.mirror import MirrorStar

D = dt.date
DAY = D(2026, 5, 14)
MAY = Range(D(2026, 5, 1), D(2026, 5, 31))

TABLES = {
    "ps_ventas": ("reg_ventas decimal(20,3), tienda string, fecha_creacion date, hora_creacion string, total_si decimal(15,2), num_cliente decimal(20,3), entrada boolean", [
        (X("1.153"), "104", DAY, "10:31:07", X("60.00"), X("0.000"), True), (X("2.153"), "104", DAY, "12:00:00", X("40.00"), X("7.990"), True),
        (X("3.153"), "104", DAY, None, X("-10.00"), X("7.990"), False), (X("4.153"), "99", DAY, "09:59:59", X("999.00"), X("0.000"), True),
        (X("5.153"), None, DAY, "09:59:59", X("999.00"), X("0.000"), True), (X("6.153"), "105", D(2025, 5, 14), "11:15:00", X("50.00"), X("8.990"), True)]),
    "ps_lineas_ventas": ("reg_lineas decimal(20,3), num_ventas decimal(20,3), tienda string, codigo string, fecha_creacion date, unidades decimal(10,2), total_si decimal(15,2), total_coste_si decimal(15,2), mes int", [
        (X("1"), X("1.153"), "104", "a", DAY, X(2), X("60.00"), X("20.00"), 202605), (X("2"), X("2.153"), "104", "b", DAY, X(1), X("40.00"), X("30.00"), 202605),
        (X("3"), X("2.153"), "104", "b", DAY, X(1), X("0.00"), X("5.00"), 202605), (X("4"), X("9.153"), "104", "a", DAY, X(1), X("5.00"), X("1.00"), 202605),
        (X("5"), X("4.153"), "99", "a", DAY, X(1), X("9.00"), X("1.00"), 202605), (X("6"), X("5.153"), None, "a", DAY, X(1), X("9.00"), X("1.00"), 202605)]),
    "ps_articulos": ("reg_articulo decimal(20,3), codigo string, ccrefejofacm string, descripcion string, num_familia decimal(20,3), num_departament decimal(20,3), num_marca decimal(20,3), num_proveedor decimal(20,3), precio_coste decimal(15,2), precio1 decimal(15,2), p_iva decimal(5,2), anulado boolean, color string, clave_temporada string, sexo string", [
        (X(1), "a", "REF-A", "Shirt", X(10), None, None, X(5), X("10.00"), X("30.00"), X(21), False, "red", "PV26", "H"),
        (X(2), "b", "", None, X(11), None, None, X(5), X("20.00"), X("25.00"), X(21), False, None, None, "M"),
        (X(3), "c", "MREF", "Coat", None, None, None, None, None, None, None, False, None, "OI25", None),
        (X(4), "d", "OLD", "Old", X(10), None, None, None, X("1.00"), None, None, True, None, "PV26", None)]),
    "ps_familias": ("reg_familia decimal(20,3), fami_grup_marc string", [(X(10), "PANTALON "), (X(11), None)]),
    "ps_departamentos": ("reg_departament decimal(20,3), depa_secc_fabr string", []),
    "ps_marcas": ("reg_marca decimal(20,3), clave string", []),
    "ps_tiendas": ("codigo string, identificador string, poblacion string, fecha_modifica date", [
        ("104", " ", "Madrid", DAY), ("105", None, "", DAY), ("99", "ghost", None, DAY)]),
    "ps_stock_tienda": ("codigo string, tienda string, talla string, stock int", [
        ("a", "104", "M", 12), ("a", "104", "L", -3), ("b", "104", "U", 1), ("d", "104", "M", 50), ("a", "99", "M", 100), ("c", "105", "S", 20)]),
    "ps_stock_central": ("num_articulo decimal(20,3), stock int", [(X(1), 5), (X(9), 2)]),
    "ps_gc_facturas": ("reg_factura decimal(20,3), fecha_factura date, num_cliente decimal(20,3), num_comercial decimal(20,3), base1 decimal(15,2), base2 decimal(15,2), base3 decimal(15,2), total_factura decimal(15,2), abono boolean", [
        (X(1), DAY, X("7.990"), X(0), X(100), None, X(0), X(100), False), (X(2), DAY, X("7.990"), X(1), X(10), X(1), X(1), X(12), False),
        (X(3), DAY, X("7.990"), X(1), X(500), X(0), X(0), X(500), True)]),
    "ps_gc_lin_facturas": ("reg_linea decimal(20,3), num_factura decimal(20,3), codigo string, descripcion string, unidades decimal(10,2), total decimal(15,2), total_coste decimal(15,2)", [
        (X(1), X(1), "zzz", " odd item ", X(3), X(100), X(60)), (X(2), X(2), "a", "x", X(1), X(12), X(6)), (X(3), X(3), "a", "x", X(1), X(500), X(1))]),
    "ps_gc_comerciales": ("reg_comercial decimal(20,3), comercial string", [(X(1), "Ana")]),
    "ps_clientes": ("reg_cliente decimal(20,3), num_cliente decimal(20,3), nombre string, nif string, fecha_creacion date, ultima_compra_f date", [
        (X("7.990"), X("7.000"), "", None, DAY, DAY)]),
    "ps_compras": ("reg_pedido decimal(20,3), num_proveedor decimal(20,3), fecha_pedido date, fecha_recibido date", [
        (X(1), X(5), D(2026, 5, 1), D(2026, 5, 11)), (X(2), X(5), D(2026, 5, 2), None), (X(3), X(9), D(2026, 5, 3), None), (X(4), X(5), D(2026, 5, 9), D(2026, 5, 4))]),
    "ps_lineas_compras": ("reg_linea_compra decimal(20,3), num_pedido decimal(20,3), num_proveedor decimal(20,3), num_articulo decimal(20,3), unidades decimal(10,2), total_si decimal(15,2)", [
        (X(1), X(1), X(5), X(1), X(10), X(100))]),
    "ps_proveedores": ("reg_proveedor decimal(20,3), nombre string", [(X(5), "")]),
    "ps_traspasos": ("reg_traspaso decimal(20,3), codigo string, talla string, unidades_s decimal(10,2), unidades_e decimal(10,2), tienda_salida string, tienda_entrada string, fecha_s date, fecha_e date, tipo string, entrada boolean", [
        (X(1), "a", "M", X(2), X(2), "104", "105", DAY, DAY, "T", False), (X(2), "a", "M", X(2), X(2), "104", "105", DAY, DAY, "T", True)]),
}


@pytest.fixture(scope="module")
def star(spark):
    return MirrorStar(spark, lambda name: spark.createDataFrame(TABLES[name][1], TABLES[name][0]))


def test_sales_exclude_ghost_and_unknown_stores(star):
    k = sales.kpis(star, MAY).first()
    assert (k["net"], k["tickets"], k["avg_ticket"], k["returns"], k["yoy_pct"]) == (X(100), 2, X(50), X(10), 100.0)
    assert k["return_pct"] == 9.1 and k["units_per_ticket"] == 2.0


def test_store_filter(star, rows):
    assert rows(general.sales_by_store(star, MAY, Filters({"store": "105"}))) == []


def test_a_store_filter_reaches_the_line_scan(spark, rows, tmp_path):
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    stored = MirrorStar(spark, lambda name: spark.read.schema(TABLES[name][0]).parquet(str(tmp_path / name)))
    sold = base.retail_lines(stored, base.line_window(MAY), Filters({"store": "104"}), positive=False)
    assert rows(sold.groupBy("store").agg({"net": "sum"})) == [("104", X("100.00"))]
    assert rows(base.retail_lines(stored, None, Filters({"store": "105"}))) == []
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for df, pushed in ((sold, "EqualTo(tienda,104)"), (base.retail_lines(stored, None), "Not(EqualTo(tienda,99))")):
            scan, = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ps_lineas_ventas" in x]
            assert pushed in scan
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_gift_lines_do_not_count_in_margins_and_line_cost_wins(star):
    sold = {r["item_id"]: (r["net"], r["cost"]) for r in base.item_sales(star, MAY).collect()}
    assert sold == {"a": (X(60), X(20)), "b": (X(40), X(30))}


def test_family_trims_and_unresolved_family_is_labelled(star, rows):
    assert rows(stock.by_family(star)) == [("PANTALON", 12), ("Sin clasificar", 21)]


def test_inactive_items_and_ghost_stock(star):
    k = stock.kpis(star).first()
    assert (k["store_units"], k["central_units"], k["active_refs"]) == (83, 7, 3)
    assert k["value"] == X("140.00")          # 12 x 10 + 1 x 20; an item without cost is worth 0


def test_items_without_stock_in_a_store(star, rows):
    out = stock.without_stock(star, Filters({"stock_store": "105"}))
    assert rows(out.select("item_id", "ref")) == [("a", "REF-A"), ("b", "—")]
    assert rows(stock.without_stock(star).select("item_id")) == []


def test_dead_stock_survives_a_missing_code(star, rows):
    assert rows(stock.dead_stock(star, MAY).select("ref", "qty")) == [("MREF", 20)]


def test_wholesale_net_and_labels(star, rows):
    assert wholesale.kpis(star, MAY).first()["net"] == X(112)
    assert general.wholesale_kpis(star, MAY, strict=True).first()["net"] == X(12)
    assert rows(wholesale.by_rep(star, MAY)) == [("(Sin comercial asignado)", X(100)), ("Ana", X(12))]
    assert rows(wholesale.top_customers(star, MAY).select("customer", "invoices")) == [("Cliente 7", 2)]
    assert rows(wholesale.top_products(star, MAY).select("ref", "description", "total")) == [("REF-A", "Shirt", X(12)), ("zzz", "odd item", X(100))]


def test_purchasing_lead_time_and_unknown_supplier(star, rows):
    k = purchasing.kpis(star, MAY).first()
    assert (k["orders"], k["suppliers"], k["open_orders"], k["units"]) == (4, 2, 2, X(10))
    assert k["lead_days"] == 2.5                             # 10 and -5 days: the report keeps both
    assert rows(purchasing.by_supplier(star, MAY).select("supplier", "orders")) == [("5.000", 3)]
    assert rows(purchasing.open_order_aging(star, MAY).select("po_id", "days_open", "lines")) == [(X("2.000"), 29, 0)]


def test_transfers_count_each_side_once(star):
    t = review.transfers(star, review.week_of(DAY)).first()
    assert (t["shipments"], t["units_sent"], t["arrivals"], t["units_received"]) == (1, X(2), 1, X(2))


def test_review_goes_on_after_a_failed_section(star, spark, tmp_path):
    def broken(_star, _week):
        raise RuntimeError("no table")

    out = review.run_review(star, review.week_of(DAY), str(tmp_path), {"sales": review.sales, "bad": broken, "stores": review.store_ranking})
    assert [o.error is None for o in out] == [True, False, True]
    frame = spark.createDataFrame([(o.section, o.error) for o in out], "section string, error string")
    assert abs(review.failed_share(frame).first()[0] - 1 / 3) < 1e-9


def test_day_resolution_and_cutoff(star):
    assert home.resolve_day(star, DAY, 11) == home.Moment(DAY, 11)
    assert home.resolve_day(star, DAY, 18) == home.Moment(DAY, 12)             # last hour seen today
    assert home.resolve_day(star, D(2026, 6, 1), 9) == home.Moment(DAY)       # nothing today: newest day
    assert home.resolve_day(star, DAY, 9, D(2020, 1, 1)) == home.Moment(D(2025, 5, 14))
    assert home.resolve_day(star, DAY, 9, D(2030, 1, 1)).as_of == DAY


def test_untimed_tickets_do_not_pass_a_cutoff(star):
    h = home.hero(star, home.Moment(DAY, 11)).first()
    assert (h["today"], h["last_year_base"]) == (X(100), X(50))
    early = home.hero(star, home.Moment(DAY, 8)).first()
    assert early["last_year_base"] == X(50)                                     # nothing before 8: the full day


def test_scorecard_labels_and_activity(star):
    cards = {r["store"]: r for r in home.store_board(star, DAY).collect()}
    assert set(cards) == {"104", "105"}
    assert (cards["104"]["label"], cards["105"]["label"]) == ("Madrid", "Tienda 105")
    assert cards["104"]["is_active"] and not cards["105"]["is_active"]
    assert cards["104"]["returns_rate"] == 0.1 and cards["104"]["margin"] == 0.5
    assert cards["105"]["last_sale"] == D(2025, 5, 14) and cards["105"]["returns_rate"] is None


def test_anonymous_customer(star):
    u = questions.unique_customers(star, MAY).first()
    assert (u["customers"], u["anonymous"], u["tickets"]) == (2, 3, 4)


def test_magnitude_flags(spark):
    values = spark.createDataFrame([("net_sales", 0.0), ("average_ticket", 2600.0), ("stock_value", 1e7)], "metric string, value double")
    assert {r["metric"]: r["flag"] for r in analyses.magnitude_check(values).collect()} == {
        "net_sales": "zero", "average_ticket": "too high", "stock_value": "plausible"}


def test_shrinkage_by_hand(spark, rows):
    initial = spark.createDataFrame([("a", "1", 10)], "item_id string, store string, qty int")
    moves = spark.createDataFrame([("a", "1", "sale", 3), ("a", "1", "receipt", 5), ("a", "1", "purchase_return", 1), ("b", "1", "transfer_in", 2)],
                                  "item_id string, store string, kind string, units int")
    actual = spark.createDataFrame([("a", "1", 9)], "item_id string, store string, qty int")
    assert rows(analyses.shrinkage(initial.withColumnRenamed("qty", "initial").unionByName(actual.withColumnRenamed("qty", "actual"), allowMissingColumns=True), moves)) == [("a", "1", 11, 9, -2), ("b", "1", 2, 0, -2)]


def test_hours_of_every_kind(spark):
    from lonja.sources.mirror import hour_of
    for kind, value in (("string", "23:05:00"), ("int", 23), ("timestamp", dt.datetime(2026, 1, 1, 23, 5)), ("timestamp_ntz", dt.datetime(2026, 1, 1, 23, 5))):
        df = spark.createDataFrame([(value,), (None,)], f"t {kind}")
        assert [r[0] for r in df.select(hour_of(df, "t")).collect()] == [23, None]


def test_unknown_columns_are_refused(spark):
    def of(schema):
        return MirrorStar(spark, lambda name: spark.createDataFrame([], schema))
    columns = "reg_ventas decimal(20,3), tienda string, fecha_creacion date, total_si decimal(15,2), num_cliente decimal(20,3), entrada boolean"
    assert of(columns).tickets.columns  # the time of day came later
    with pytest.raises(LookupError, match="entrada"):
        _ = of(columns.replace(", entrada boolean", "")).tickets
    with pytest.raises(LookupError):
        _ = of(columns).collections


def test_intraday_reports_see_the_hour(star):
    hours = {r["hour"]: r["net"] for r in star.tickets.where("store = '104' and is_sale and hour is not null").select("hour", "net").collect()}
    assert hours == {10: X("60.00"), 12: X("40.00")}
