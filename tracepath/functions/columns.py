"""Column expressions over activities: JVM-side, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"
ORIGIN = r"([A-Za-z0-9-]+://[^/\"'\s]+)"


def duration(start: str = "start", end: str = "end") -> Column:
    return F.greatest(F.col(end) - F.col(start), F.lit(0))


def informative() -> Column:
    """The interval says something: trusted at all, and of positive length."""
    return (F.col("confidence") > 0) & (F.col("end") > F.col("start"))


def decides() -> Column:
    """Observed rather than inferred, and informative: only such work can decide a finish."""
    return informative() & ~F.col("inferred")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Half-open overlap of a positive interval with [low, high)."""
    return (start < high) & (end > low) & (end > start)


def nested(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """One of the two intervals holds the other, ends included."""
    return ((a_start <= b_start) & (b_end <= a_end)) | ((b_start <= a_start) & (a_end <= b_end))


def wait_between(end: Column, start: Column) -> Column:
    return F.greatest(start - end, F.lit(0))


def origin_of(text: Column) -> Column:
    """The first scheme://host in a text, or null."""
    return F.nullif(F.regexp_extract(text, ORIGIN, 1), F.lit(""))


def first_origin(subject: Column) -> Column:
    """The first origin that a subject's fields name, or null."""
    return F.try_element_at(F.filter(F.transform(F.split(subject, SEPARATOR), origin_of), lambda o: o.isNotNull()), F.lit(1))


def owner_of(subject: Column, declared: str) -> Column:
    """UnderTest if the subject names the declared origin, Elsewhere if it names others only, else Unstated."""
    origins = F.filter(F.transform(F.split(subject, SEPARATOR), origin_of), lambda o: o.isNotNull())
    return F.when(F.array_contains(origins, declared), "UnderTest").when(F.size(origins) > 0, "Elsewhere").otherwise("Unstated")


def package_of(path: Column) -> Column:
    """The package a path is installed under: what follows the last node_modules/, two steps for a scope."""
    found = F.regexp_extract(path, r"^(?s:.*)node_modules/((?:@[^/]+/)?[^/]+)", 1)
    last = F.regexp_extract(path, r"^(?s:.*)node_modules/([^/]*)", 1)
    return F.when(last.startswith("@") & ~found.contains("/"), F.lit(None)).otherwise(F.nullif(found, F.lit("")))


def last_segment(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def names_symbol(text: Column, symbol: Column) -> Column:
    """A line of source names the last dotted part of a symbol."""
    part = last_segment(symbol)
    return (part != "") & F.contains(text, part)


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r'^(?s)"(.*)"$', "$1")


def map_name(url: Column) -> Column:
    """The map file of a script: what follows the last slash, up to a query or fragment, with .map after it."""
    return F.concat(F.regexp_replace(F.substring_index(url, "/", -1), r"(?s)[?#].*$", ""), F.lit(".map"))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def readable(subject: Column) -> Column:
    return F.replace(subject, F.lit(SEPARATOR), F.lit(", "))


def site_parts(subject: Column) -> Column:
    """What a subject's fields say of a place in code: script, digits of line and column, symbol; '' where they don't. Of a leaf that is
    stated twice the last counts."""

    def last(leaf: str) -> Column:
        return F.regexp_extract(subject, rf"^(?s:.*{SEPARATOR})?(?:[^={SEPARATOR}]*\.)?{leaf}=([^{SEPARATOR}]*)", 1)

    def digits(leaf: str) -> Column:
        return F.regexp_extract(last(leaf), r"^\+?([0-9]+)$", 1)

    return F.struct(unquoted(last("url")).alias("script"), digits("lineNumber").alias("line"), digits("columnNumber").alias("column"), unquoted(last("functionName")).alias("symbol"))


def number(digits: Column) -> Column:
    """Of 32 bits, without a sign; else null."""
    n = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= 10), digits).try_cast("long")
    return F.when(n < 1 << 32, n)


def site_of(subject: Column) -> Column:
    """The place in code that a subject states: script, line, column and symbol ('' if none is named). Null unless script, line and
    column are all there."""
    x = site_parts(subject)
    site = F.struct(x["script"].alias("script"), number(x["line"]).alias("line"), number(x["column"]).alias("column"), x["symbol"].alias("symbol"))
    return F.when((site["script"] != "") & site["line"].isNotNull() & site["column"].isNotNull(), site)
