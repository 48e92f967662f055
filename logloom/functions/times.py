"""Timestamps in logs: reading, writing, buckets."""

from __future__ import annotations

import datetime
import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats that are tried, in order. Fixed values.
DEFAULT_FORMATS = ("%FT%T%Ez", "%F %T%Ez", "%FT%T", "%F %T", "%d/%b/%Y:%H:%M:%S %z", "%b %e %H:%M:%S", "%b %d %H:%M:%S")
#: Directives that strftime_pattern() reads. Fixed values of the strftime language.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "j": "DDD", "z": "Z", "Z": "zzz", "%": "%"}

#: 400 years, after which the calendar and with it a zone's last rules repeat, and a time from which on only these hold; microseconds.
CYCLE, CYCLE_START = 146_097 * 86_400 * 1_000_000, 2_208_988_800 * 1_000_000


def iso_timestamp(text: Column) -> Column:
    """YYYY-MM-DD, T or blank, HH:MM:SS, up to six decimals after a point or comma, Z or nothing; second 60 is the next minute.

    The whole text must be so; else null."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?Z?$"
    plain = F.translate(text, ",Z", ".")
    leap = F.substring(text, 18, 2) == "60"
    at = F.try_to_timestamp(F.when(leap, F.concat(F.substring(plain, 1, 17), F.lit("59"), F.substring(plain, 20, 8))).otherwise(plain))
    return F.when(text.rlike(shape), F.when(leap, at + F.expr("INTERVAL 1 SECOND")).otherwise(at))


def offset_timestamp(text: Column) -> Column:
    """ISO with an offset such as +02:00 or -0500."""
    shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?)([+-]\d{2}):?(\d{2})$"
    plain = F.concat(F.regexp_extract(text, shape, 1), F.lit("T"), F.regexp_replace(F.regexp_extract(text, shape, 2), ",", "."), F.regexp_extract(text, shape, 3), F.lit(":"), F.regexp_extract(text, shape, 4))
    return F.when(text.rlike(shape), F.try_to_timestamp(plain))


def clf_timestamp(text: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS +zzzz, as web servers write it."""
    return F.when(text.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(text, F.lit("d/MMM/yyyy:HH:mm:ss Z")))


def syslog_timestamp(text: Column, reference: datetime.date) -> Column:
    """Mmm d HH:MM:SS without a year: the year of `reference`, or the one before if the month is later than its month."""
    shape = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})$"
    read = lambda year: F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 3)), F.lit("yyyy MMM d HH:mm:ss"))
    this = read(reference.year)
    month = F.array_position(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), F.regexp_extract(text, shape, 1))
    return F.when(text.rlike(shape), F.when(month > reference.month, read(reference.year - 1)).otherwise(this))


def strftime_pattern(fmt: str) -> str:
    """Spark's datetime pattern of a strftime format; ValueError for directives that it lacks."""
    out, i, quoted = [], 0, ""
    fmt = fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%R", "%H:%M").replace("%D", "%m/%d/%y")

    def flush() -> None:
        nonlocal quoted
        if quoted:
            out.append("'" + quoted.replace("'", "''") + "'")
            quoted = ""

    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            i += 1
            if fmt[i : i + 2] == "Ez":
                i += 1
                piece = "XXX"
            else:
                if i >= len(fmt) or fmt[i] not in _DIRECTIVES:
                    raise ValueError(f"unknown directive in {fmt!r}")
                piece = _DIRECTIVES[fmt[i]]
            flush()
            out.append("'%'" if piece == "%" else piece)
        elif c.isalpha():
            quoted += c
        else:
            flush()
            out.append("''" if c == "'" else c)
        i += 1
    flush()
    return "".join(out)


def parse_time(text: Column, formats: tuple[str, ...] = DEFAULT_FORMATS, reference: datetime.date | None = None) -> Column:
    """The first of the formats that reads the text; null if none does."""
    reference = reference or datetime.date.today()
    tried = []
    for f in formats:
        if f in ("%FT%T", "%F %T"):
            mark = "T" if "T%T" in f else " "
            tried.append(F.when(F.substring(text, 11, 1) == mark, iso_timestamp(text)))
        elif f in ("%FT%T%Ez", "%F %T%Ez"):
            mark = "T" if "T%T" in f else " "
            tried.append(F.when(F.substring(text, 11, 1) == mark, offset_timestamp(text)))
        elif f == "%d/%b/%Y:%H:%M:%S %z":
            tried.append(clf_timestamp(text))
        elif f in ("%b %e %H:%M:%S", "%b %d %H:%M:%S"):
            tried.append(syslog_timestamp(text, reference))
        else:
            tried.append(F.try_to_timestamp(text, F.lit(strftime_pattern(f))))
    return F.coalesce(*tried)


def format_time(ts: Column, zone: str = "UTC", fmt: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """In a zone, rounded to milliseconds."""
    rounded = F.timestamp_micros((F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000) * 1000).cast("long"))
    return F.date_format(F.from_utc_timestamp(rounded, zone), fmt)


@functools.cache
def zone_gaps(zone: str) -> tuple[tuple[int, int, int], ...]:
    """The gaps of a zone up to the end of a whole cycle of its last rules: first local time that there is not, first that there is again,
    and the instant of the transition, in microseconds. Local times count as if they were UTC."""
    jvm = SparkContext._active_spark_context._jvm
    rules = jvm.java.time.ZoneId.of(zone).getRules()
    out = []
    step = rules.nextTransition(jvm.java.time.Instant.parse("1800-01-01T00:00:00Z"))
    while step is not None and step.toEpochSecond() * 1_000_000 < CYCLE_START + CYCLE:
        at, before, after = step.toEpochSecond(), step.getOffsetBefore().getTotalSeconds(), step.getOffsetAfter().getTotalSeconds()
        if after > before:
            out.append(tuple(t * 1_000_000 for t in (at + before, at + after, at)))
        step = rules.nextTransition(step.getInstant())
    return tuple(out)


def local_to_utc(ts: Column, zone: str) -> Column:
    """A zone's wall-clock time as an instant: the earlier one if ambiguous, the transition if it falls into a gap. Gaps are looked up in the
    zone's rules, and only for times that don't come back the same; the last rules repeat every 400 years."""
    at = F.to_utc_timestamp(ts, zone)
    gaps = zone_gaps(zone)
    if not gaps:
        return at
    micros = F.unix_micros(ts.cast("timestamp"))
    cycles = F.greatest(F.lit(0), F.floor((micros - CYCLE_START) / CYCLE)).cast("long") * CYCLE
    table = F.expr("array(" + ", ".join(f"struct({first}L AS first, {again}L AS again, {at_}L AS at)" for first, again, at_ in gaps) + ")")
    hit = F.filter(table, lambda g: (micros - cycles >= g["first"]) & (micros - cycles < g["again"]))
    return F.when(F.from_utc_timestamp(at, zone) != ts, F.timestamp_micros(F.try_element_at(hit, F.lit(1))["at"] + cycles)).otherwise(at)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the bucket of `seconds` that holds ts, floored from the epoch, also before 1970; the type stays."""
    width = seconds * 1_000_000
    return F.window(ts, f"{seconds} seconds")["start"] if width > 0 else ts
