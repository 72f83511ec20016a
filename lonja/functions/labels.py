"""Labels and Spanish display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCLASSIFIED = "Sin clasificar"
NO_REP = "(Sin comercial asignado)"
DASH = "—"
# Connector words that stay lower case in a title (fixed values).
CONNECTORS = ("de", "la", "el", "y", "en", "con", "del", "los", "las")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str, trim: bool = True) -> Column:
    value = _c(value)
    return F.nullif(F.trim(value) if trim else value, F.lit(""))


def first_label(*candidates: Column | str, default: str) -> Column:
    """First candidate that is not blank, trimmed; never NULL."""
    return F.coalesce(*[blank_to_null(c) for c in candidates], F.lit(default))


def or_dash(value: Column | str, trim: bool = False) -> Column:
    return F.coalesce(blank_to_null(value, trim), F.lit(DASH))


def family_label(default: str = UNCLASSIFIED) -> Column:
    return first_label("family", default=default)


def customer_label() -> Column:
    """Name, else tax id, else a synthetic label from the customer number, else a constant."""
    synthetic = F.concat(F.lit("Cliente "), F.col("customer_no").cast("bigint").cast("string"))
    return first_label("name", "tax_id", synthetic, default="Cliente desconocido")


def store_label() -> Column:
    return F.coalesce(blank_to_null("name"), blank_to_null("town"), F.concat(F.lit("Tienda "), F.col("store")))


# --- es-ES number formats ------------------------------------------------------------------------


def es_number(value: Column | str, digits: int = 0) -> Column:
    """1234.5 -> "1.234,50", half up; NULL -> dash."""
    return F.coalesce(F.translate(F.format_number(F.round(_c(value), digits), digits), ",.", ".,"), F.lit(DASH))


def es_currency(value: Column | str, digits: int = 2, prefix: str = "€") -> Column:
    return F.when(_c(value).isNull(), DASH).otherwise(F.concat(F.lit(prefix), es_number(value, digits)))


def es_percent(value: Column | str, digits: int = 1) -> Column:
    return F.when(_c(value).isNull(), DASH).otherwise(F.concat(es_number(value, digits), F.lit("%")))


def signed_percent(fraction: Column | str) -> Column:
    """0.082 -> "+8,2%"."""
    f = _c(fraction)
    return F.concat(F.when(f > 0, "+").otherwise(""), es_number(f * 100, 1), F.lit("%"))


def duration_text(ms: Column | str) -> Column:
    """850 -> "850ms", 65000 -> "1m 5s", 3 700 000 -> "1h 1m"; NULL -> dash."""
    ms = _c(ms).cast("bigint")
    sec = F.floor(ms / 1000)
    h, m, s = F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60
    return (F.when(ms.isNull(), DASH)
            .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
            .when(m > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("bigint").cast("string"), F.lit("s")))
            .otherwise(F.concat(s.cast("bigint").cast("string"), F.lit("s"))))


def age_text(seconds: Column | str) -> Column:
    """30 -> "< 1m", 8100 -> "2h 15m", 90000 -> "1d 1h"; NULL -> dash."""
    sec = _c(seconds).cast("bigint")
    mins = F.floor(sec / 60)
    h, m = F.floor(mins / 60), mins % 60

    def text(a: Column, unit_a: str, b: Column, unit_b: str) -> Column:
        return F.concat(a.cast("bigint").cast("string"), F.lit(unit_a + " "),
                        b.cast("bigint").cast("string"), F.lit(unit_b))

    return (F.when(sec.isNull(), DASH).when(sec < 60, "< 1m")
            .when(h >= 24, text(F.floor(h / 24), "d", h % 24, "h"))
            .when(h > 0, text(h, "h", m, "m"))
            .otherwise(F.concat(m.cast("bigint").cast("string"), F.lit("m"))))


def sync_age_text(seconds: Column | str) -> Column:
    """600 -> "10 min", 9000 -> "2.5 h", 200000 -> "2 d"; NULL or negative -> dash."""
    sec = _c(seconds).cast("double")
    mins = F.round(sec / 60)
    hours = F.round(mins / 6) / 10
    short = F.regexp_replace(hours.cast("string"), r"\.0$", "")
    return (F.when(sec.isNull() | (sec < 0), DASH)
            .when(mins < 60, F.concat(mins.cast("bigint").cast("string"), F.lit(" min")))
            .when(hours < 48, F.concat(short, F.lit(" h")))
            .otherwise(F.concat(F.round(hours / 24).cast("bigint").cast("string"), F.lit(" d"))))


def throughput_text(rows_per_second: Column | str) -> Column:
    r = _c(rows_per_second)
    small = F.concat(F.format_string("%.1f", r.cast("double")), F.lit(" /s"))
    return (F.when(r.isNull(), DASH).when(r >= 1000, F.concat(es_number(F.round(r, 0)), F.lit(" /s")))
            .otherwise(small))


def slug(text: Column | str, default: Column | str = "", width: int = 48) -> Column:
    """Key text: lower case, no accents, other characters to one underscore."""
    plain = F.translate(F.lower(_c(text)), "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc")
    body = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(F.left(body, F.lit(width)), F.lit("")), default)


def title_case(text: Column | str) -> Column:
    """Spanish title case: connector words stay lower case except as the first word."""
    words = F.split(F.regexp_replace(F.lower(_c(text)), r"(\s+|/)", "\u0001$1\u0001"), "\u0001")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*CONNECTORS), w).otherwise(
        F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))))
    return F.array_join(cased, "")
