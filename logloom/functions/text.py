"""Text of log values: bare scalars, display, escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER = r"^-?\d{1,20}$"
FLOAT = r"^-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def blank(raw: Column) -> Column:
    """Whether a line holds nothing but blanks, tabs and line ends."""
    return F.length(F.trim(raw, F.lit(" \t\r\n"))) == 0


def scalar_kind(text: Column) -> Column:
    """Kind of a bare scalar: null, bool, int, float or string. Integers reach from -2^63 to 2^64 - 1; floats are finite."""
    whole = text.try_cast("decimal(38,0)")
    is_int = F.coalesce(text.rlike(INTEGER) & whole.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")), F.lit(False))
    number = F.when(text.rlike(FLOAT), text.try_cast("double"))
    return (
        F.when(text.isNull() | (text == ""), "null")
        .when(text.isin("true", "false"), "bool")
        .when(is_int, "int")
        .when(number.isNotNull() & (F.abs(number) != float("inf")), "float")
        .otherwise("string")
    )


def as_integer(text: Column) -> Column:
    """decimal(20,0) of an integer's text, else null."""
    return F.when(text.rlike(INTEGER), text.try_cast("decimal(20,0)"))


def as_boolean(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def single_line(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def display(value: Column) -> Column:
    """A value as text, on one line; null is the empty text."""
    return single_line(F.coalesce(value.cast("string"), F.lit("")))


def csv_cell(text: Column) -> Column:
    """RFC 4180; a cell that starts with = or @ gets a ' before it, so that no sheet runs it as a formula."""
    guarded = F.when(text.startswith("=") | text.startswith("@"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]') | text.startswith("=") | text.startswith("@"), quoted).otherwise(text), F.lit(""))


def markdown_cell(text: Column) -> Column:
    """Backslash and pipe escaped; tabs and line ends become blanks."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(F.translate(out, "\r\n\t", "   "), F.lit(""))


def sanitise_note(text: Column, most: int = 1024) -> Column:
    """Control characters and line or paragraph separators become blanks, ends are trimmed, at most so many UTF-8 bytes."""
    clean = F.trim(F.regexp_replace(text, "[\\x00-\\x1F\\x7F-\\x9F\\u2028\\u2029]", " "))
    return F.when(F.octet_length(clean) <= most, clean).otherwise(_cut(clean, most))


def _cut(text: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` bytes."""
    chars = F.split(F.substring(text, 1, most), "")
    upto = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, c: F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), F.when(a["on"] & (a["bytes"] + F.octet_length(c) <= most), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (a["bytes"] + F.octet_length(c) <= most)).alias("on")))
    return F.substring(text, F.lit(1), upto["n"])


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row, however often later expressions and lambdas name them: the optimizer does
    not merge projections over a generator."""
    made = F.struct(*(c.alias(k) for k, c in columns.items()))
    return rows.withColumn("_once", F.explode(F.array(made))).select("*", "_once.*").drop("_once")
