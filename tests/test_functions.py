from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions import redact as R
from lonja.operators.filters import DEFINITIONS, SCOPES, Filters


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_ratios(spark):
    got = values(spark, [(100, 40), (0, 5), (None, 1)], "a int, b int", M.margin_pct("a", "b"), M.ratio("b", "a"), M.margin_share("a", "b"))
    assert got == [(60.0, 0.4, 0.6), (None, None, None), (None, None, None)]
    got = values(spark, [(110, 100), (90, 100), (5, 0), (5, -10)], "now int, b int", M.change_pct("now", "b"), M.change_ratio("now", "b"))
    assert [g[0] for g in got] == [10.0, -10.0, None, 150.0]
    assert got[2][1] == 0.0


def test_three_return_rates(spark):
    got = values(spark, [(90, 10, 9, 3)], "s int, r int, ns int, nr int", M.return_rate_of_flow("s", "r"), M.return_rate_of_sales("s", "r"),
                 M.return_rate_of_tickets("ns", "nr"))
    assert got == [(10.0, 11.1, 33.33)]


def test_invoice_net_null_safe_and_strict(spark):
    schema = "base1 decimal(15,2), base2 decimal(15,2), base3 decimal(15,2)"
    from decimal import Decimal as X
    got = values(spark, [(X(10), X(5), None), (X(1), X(1), X(1))], schema, M.invoice_net(), M.invoice_net_strict())
    assert got == [(X(15), None), (X(3), X(3))]


def test_average_ticket_rounds_half_up(spark):
    got = values(spark, [("1243826.90", 4), ("10.00", 0)], "s string, n int", M.average_ticket(F.col("s").cast("decimal(15,2)"), "n"))
    assert [str(g[0]) for g in got] == ["310956.73", "None"]


def test_traffic_light(spark):
    cases = [(0.0, -0.15, 0, "alert"), (0.0, -0.05, 0, "watch"), (0.0, -0.049, 0, "ok"), (-0.5, 0.1, 0, "ok"), (-0.10, None, 0, "alert"),
             (-0.04, None, 0, "watch"), (0.0, 0.2, 3, "watch"), (0.0, 0.2, 5, "alert"), (0.0, -0.2, 3, "alert"), (0.0, None, 0, "ok")]
    got = values(spark, [c[:3] for c in cases], "d double, y double, s int", M.traffic_light("d", "y", "s"))
    assert [g[0] for g in got] == [c[3] for c in cases]


def test_trend_direction(spark):
    got = values(spark, [(3.0, 100.0), (-3.0, 100.0), (1.0, 100.0), (None, 100.0), (1.0, 0.0)], "s double, m double", M.trend_direction("s", "m"))
    assert [g[0] for g in got] == ["up", "down", "flat", "flat", "flat"]


def test_bands(spark):
    got = values(spark, [(1,), (3,), (10,), (11,)], "n int", M.purchase_band("n"))
    assert [g[0] for g in got] == ["1 compra", "2-3 compras", "4-10 compras", "Más de 10"]
    got = values(spark, [(10.1,), (0.0,), (-10.0,), (-10.1,), (None,)], "y double", M.heat_band("y"))
    assert [g[0] for g in got] == ["strong growth", "growth", "decline", "strong decline", None]


def test_cache_hit_and_throughput(spark):
    got = values(spark, [(50, 25, 25), (None, 10, 0), (0, 0, 0)], "r int, p int, w int", M.cache_hit_pct("r", "p", "w"))
    assert [g[0] for g in got] == [50.0, None, None]
    got = values(spark, [(1000, 2000), (5, 0), (5, None)], "n int, ms int", M.throughput("n", "ms"))
    assert [g[0] for g in got] == [500.0, None, None]


def test_null_store_is_dropped(spark, rows):
    df = spark.createDataFrame([("1", True), ("99", True), (None, True), ("1", False)], "store string, is_sale boolean")
    assert df.where(P.is_retail_sale()).count() == 1 and df.where(P.is_retail_return()).count() == 1


def test_search_has_no_wildcards(spark, rows):
    df = spark.createDataFrame([("100% Linen", None), ("1000", None), (None, "x_y")], "a string, b string")
    assert df.where(P.contains_ci("0%", "a", "b")).count() == 1
    assert df.where(P.contains_ci("X_Y", "a", "b")).count() == 1
    assert df.where(P.contains_ci("xzy", "a", "b")).count() == 0


def test_labels(spark):
    schema = "name string, tax_id string, customer_no int"
    got = values(spark, [(" A ", "n", 1), ("  ", " n ", 1), (None, "", 7), (None, None, None)], schema, L.customer_label())
    assert [g[0] for g in got] == ["A", "n", "Cliente 7", "Cliente desconocido"]


def test_es_formats(spark):
    got = values(spark, [(1234.5, 0.082), (-7.25, -0.189), (None, None)], "v double, f double", L.es_number("v", 2), L.es_currency("v"),
                 L.es_percent("v"), L.signed_percent("f"))
    assert got == [("1.234,50", "€1.234,50", "1.234,5%", "+8,2%"), ("-7,25", "€-7,25", "-7,3%", "-18,9%"), ("—", "—", "—", "—%")]


def test_durations(spark):
    cases = [(850, "850ms"), (1000, "1s"), (65000, "1m 5s"), (3_700_000, "1h 1m"), (None, "—")]
    got = values(spark, [(c[0],) for c in cases], "ms long", L.duration_text("ms"))
    assert [g[0] for g in got] == [c[1] for c in cases]
    cases = [(30, "< 1m"), (-5, "< 1m"), (60, "1m"), (8100, "2h 15m"), (90000, "1d 1h"), (None, "—")]
    got = values(spark, [(c[0],) for c in cases], "s long", L.age_text("s"))
    assert [g[0] for g in got] == [c[1] for c in cases]
    got = values(spark, [(1234.4,), (9.87,), (None,)], "r double", L.throughput_text("r"))
    assert [g[0] for g in got] == ["1.234 /s", "9.9 /s", "—"]


def test_sync_age(spark):
    cases = [(600, "10 min"), (3599, "1 h"), (9000, "2.5 h"), (172_000, "47.8 h"), (200_000, "2 d"), (-1, "—"), (None, "—")]
    got = values(spark, [(c[0],) for c in cases], "s int", L.sync_age_text("s"))
    assert [g[0] for g in got] == [c[1] for c in cases]


def test_slug_and_title(spark):
    got = values(spark, [("¡Acción: Revisión ñandú!",), ("---",), ("x" * 60,)], "t string", L.slug("t", default="accion_1"))
    assert [g[0] for g in got] == ["accion_revision_nandu", "accion_1", "x" * 48]
    got = values(spark, [("PANTALON DE LA SEÑORA/Y NIÑO",), ("la  casa",)], "t string", L.title_case("t"))
    assert [g[0] for g in got] == ["Pantalon de la Señora/y Niño", "La  Casa"]


SECRETS = [
    ("Authorization: Bearer abc.def", "Authorization: Bearer [redacted]"),
    ("authorization: basic dXNlcjpw, X: 1", "Authorization: basic [redacted], X: 1"),
    ("token=Bearer abcdefgh12", "token=Bearer [redacted]"),
    ("Authorization: s3cr3t", "Authorization: [redacted]"),
    ("key sk-ant-abcdefgh1234", "key [redacted]"),
    ("key sk-0123456789abcdef0", "key [redacted]"),
    ("jwt eyJhbGci.eyJzdWIi.c2lnbmF0", "jwt [redacted]"),
    ("dsn postgresql://u:p@h/db end", "dsn postgres://[redacted] end"),
    ("mysql://root:pw@host", "mysql:[redacted]@host"),
    ("PASSWORD = hunter2&x", "password=[redacted]&x"),
    ('{"access_token": "abc", "refreshToken":"d"}', '{"access_token": "[redacted]", "refreshToken": "[redacted]"}'),
    ("nothing to hide", "nothing to hide"),
]


def test_redaction_and_idempotence(spark):
    df = spark.createDataFrame([(s,) for s, _ in SECRETS], "t string")
    once = df.select(R.redact("t").alias("t"))
    assert [r[0] for r in once.collect()] == [want for _, want in SECRETS]
    assert [r[0] for r in once.select(R.redact("t")).collect()] == [want for _, want in SECRETS]


def test_redaction_literals_null_and_tail(spark):
    df = spark.createDataFrame([("a my.secret$value b",), (None,)], "t string")
    assert [r[0] for r in df.select(R.redact("t", literals=["my.secret$value", "b"])).collect()] == ["a [redacted] b", ""]
    assert one(spark, R.redact_tail(F.lit("x password=abc"), 10)) == "[redacted]"


def test_redacted_arguments(spark):
    df = spark.createDataFrame([(["run", "--token", "--password", "x", "--api-key", "k1", "-p", "y" * 300, "password=abc", "--secret"],), ([],)],
                               "a array<string>")
    got = [r[0] for r in df.select(R.redact_arguments("a")).collect()]
    assert got == [["run", "--token", "[redacted]", "x", "--api-key", "[redacted]", "-p", "y" * 240 + "…[truncated]",
                    "password=[redacted]", "--secret"], []]


def test_denied_attributes(spark):
    attrs = F.create_map(F.lit("db.user"), F.lit("u"), F.lit("postgres.password"), F.lit("p"), F.lit("http.route"), F.lit("/"))
    assert one(spark, R.drop_denied(attrs)) == {"http.route": "/"}


def test_fingerprint(spark):
    assert one(spark, R.fingerprint(F.lit('SELECT * FROM "PS_Ventas" v JOIN ps_tiendas t, ps_ventas'))) == ["ps_tiendas", "ps_ventas"]
    assert one(spark, R.fingerprint(F.lit("SELECT 1"))) == []


def test_filters(spark, rows):
    df = spark.createDataFrame([("1", "A ", 5), ("2", "B", 6), ("2", None, 7)], "store string, family string, supplier_id int")
    assert Filters().apply(df, "store", "family").count() == 3
    assert Filters({"store": " 2 "}).apply(df, "store").count() == 2
    assert Filters({"store": "  "}).apply(df, "store").count() == 3
    assert Filters({"family": ["B", "C"]}).apply(df, "family").count() == 1
    assert Filters({"family": []}).apply(df, "family").count() == 3
    assert Filters({"family": "B"}).apply(df, "family").count() == 3          # wrong type: inactive
    assert Filters({"catalog_family": ["A"]}).apply(df, "catalog_family").count() == 1
    assert Filters({"supplier": [5, 7]}).apply(df, "supplier").count() == 2
    assert Filters({"supplier": ["5"]}).apply(df, "supplier").count() == 3
    assert rows(Filters({"store": "2", "family": ["B"]}).options(df, "store", "store", "store", ("store", "family"))) == [("2", "2")]
    assert rows(Filters({"store": "2"}).options(df, "store", "store", "store", ("store",))) == [("1", "1"), ("2", "2")]
    assert rows(Filters().options(df, "catalog_family", F.trim("family"), F.trim("family"))) == [("A", "A"), ("B", "B")]
    assert {f for ids in SCOPES.values() for f in ids} == set(DEFINITIONS)


def test_facets_equal_the_lists_one_by_one(spark):
    import itertools

    from lonja.operators.filters import Filters

    data = [(s, f, b, x) for s, f, b, x in itertools.product(["1", "2", None], ["F", "G", ""], ["B", None], ["H", "M"])] * 2
    df = spark.createDataFrame(data, "store string, family string, brand string, sex string")
    panel = ("store", "family", "brand", "sex")
    for values in ({}, {"store": "1"}, {"store": "2", "family": ["F"], "brand": ["B", "C"]}, {"family": ["nothing"], "sex": []}):
        picked = Filters(values)
        got = {(r["filter"], r["value"], r["label"]): r["rows"] for r in picked.facets(df, {x: (x, x) for x in panel}, panel).collect()}
        assert {k[:3] for k in got} == {(x, r["value"], r["label"]) for x in panel for r in picked.options(df, x, x, x, cascade=panel).collect()}
        for (x, value, _), n in got.items():
            assert n == picked.apply(df, *panel, without=x).where(F.col(x) == value).count()
