"""Row filters: a boolean tree of one-column leaves, compiled to a Column.

Every leaf is two-valued: a null, or a value of another type, makes it false, and not() turns that into true. Leaves that
cannot be resolved against the columns at hand are absent: they drop out of and() and or(), and a tree without any
leaf left keeps all rows. Cheap leaves come first in the compiled expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import levels
from logloom.functions.text import display
from logloom.functions.times import format_time

BOOL, ENUM, TIME, NUMBER, TEXT = 1, 2, 3, 4, 10


@dataclass
class Rule:
    """A node of the tree."""

    def compile(self, df: DataFrame) -> Column | None:
        raise NotImplementedError

    def cost(self) -> int:
        raise NotImplementedError


@dataclass
class Leaf(Rule):
    column: str
    weight: int
    make: Callable[[DataFrame, Column], Column | None]
    keys: tuple[str, ...] = ()

    def compile(self, df: DataFrame) -> Column | None:
        name = next((c for c in (self.column, *self.keys) if c in df.columns), None)
        if name is None:
            return None
        made = self.make(df.select(F.col(f"`{name}`").alias(self.column)), F.col(f"`{name}`"))
        return None if made is None else F.coalesce(made, F.lit(False))

    def cost(self) -> int:
        return self.weight


@dataclass
class Tree(Rule):
    kind: str
    children: list[Rule] = field(default_factory=list)

    def cost(self) -> int:
        return min((c.cost() for c in self.children), default=0)

    def compile(self, df: DataFrame) -> Column | None:
        parts = [p for c in sorted(self.children, key=lambda c: c.cost()) if (p := c.compile(df)) is not None]
        if not parts:
            return None if self.children or self.kind != "and" else F.lit(True)
        if self.kind == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if self.kind == "and" else (out | p)
        return out


def _needs(df: DataFrame, name: str, *kinds: type) -> bool:
    return isinstance(df.schema[0].dataType, kinds)


def enum_in(column: str, values: list[str]) -> Leaf:
    return Leaf(column, ENUM, lambda df, c: c.isin(*values) if values and _needs(df, column, T.StringType) else F.lit(False))


def level_in(column: str, names: list[str], mapping: dict[str, str] | None = None) -> Leaf:
    """Names and aliases of levels; any raw value of those levels matches. Names of no level make the leaf absent."""
    ranks = sorted({r for n in names if (r := levels.rank_of((mapping or {}).get(n, n))) is not None})
    return Leaf(column, ENUM, lambda df, c: levels.level_rank(c, mapping).isin(*ranks) if ranks else None)


def _instant(value: datetime | int | None) -> Column | None:
    if value is None:
        return None
    return F.timestamp_micros(F.lit(value)) if isinstance(value, int) else F.lit(value)


def time_range(column: str, low: datetime | int | None = None, high: datetime | int | None = None) -> Leaf:
    """Both ends included; None is open; integers (bounds and columns) are microseconds since 1970. A range upside down matches nothing."""

    def make(df: DataFrame, c: Column) -> Column:
        dtype = df.schema[0].dataType
        if isinstance(dtype, T.IntegralType):
            c = F.timestamp_micros(c)
        elif not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit(False)
        ntz = isinstance(dtype, T.TimestampNTZType)
        bound = lambda v: _instant(v).cast("timestamp_ntz") if ntz else _instant(v)
        out = c.isNotNull()
        if low is not None:
            out = out & (c >= bound(low))
        if high is not None:
            out = out & (c <= bound(high))
        return out

    return Leaf(column, TIME, make)


def number_range(column: str, low: float | None = None, high: float | None = None, low_open: bool = False, high_open: bool = False) -> Leaf:
    """Compared as doubles; NaN rows never match, a NaN bound is no bound."""

    def make(df: DataFrame, c: Column) -> Column:
        if not _needs(df, column, T.NumericType):
            return F.lit(False)
        x = c.cast("double")
        out = c.isNotNull() & ~F.isnan(x)
        if low is not None and not math.isnan(low):
            out = out & ((x > low) if low_open else (x >= low))
        if high is not None and not math.isnan(high):
            out = out & ((x < high) if high_open else (x <= high))
        return out

    return Leaf(column, NUMBER, make)


def is_boolean(column: str, true: bool = True, false: bool = False) -> Leaf:
    wanted = [v for v, on in ((True, true), (False, false)) if on]
    return Leaf(column, BOOL, lambda df, c: c.isin(*wanted) if wanted and _needs(df, column, T.BooleanType) else F.lit(False))


def _text(column: str, needle: str, test: Callable[[Column], Column]) -> Leaf:
    """On the shown text: times as format_time() shows them."""
    return Leaf(column, TEXT, lambda df, c: test(F.coalesce(format_time(c), F.lit("")) if _needs(df, column, T.TimestampType, T.TimestampNTZType) else display(c)))


def exactly(column: str, text: str) -> Leaf:
    """On the shown text, on one line; a null is the empty text."""
    return _text(column, text, lambda c: c == text)


def contains(column: str, text: str) -> Leaf:
    if not text:
        raise ValueError("an empty needle")
    return _text(column, text, lambda c: c.contains(text))


def matches(column: str, pattern: str) -> Leaf:
    """Regular expression, found anywhere; one that does not compile matches nothing."""
    if not pattern:
        raise ValueError("an empty needle")
    return _text(column, pattern, lambda c: c.rlike(pattern) if _compiles(pattern) else F.lit(False))


def _compiles(pattern: str) -> bool:
    """Whether the engine that runs the pattern reads it."""
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def glob_pattern(glob: str, cross_slash: bool = False) -> str:
    """Anchored regular expression of a glob: * and ? (within a path part unless cross_slash), [set], [!set]."""
    any_, out, i = "." if cross_slash else "[^/]", "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += any_ + "*"
        elif c == "?":
            out += any_
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" if body[0] in "!^" else "") + re.sub(r"([\\\[&])", r"\\\1", body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def wildcard(column: str, glob: str, cross_slash: bool = False) -> Leaf:
    if not glob:
        raise ValueError("an empty needle")
    return _text(column, glob, lambda c: c.rlike(glob_pattern(glob, cross_slash)))


def custom(column: str, test: Callable[[Column], Column]) -> Leaf:
    """Any predicate on one column: a Column expression or a pandas UDF."""
    return Leaf(column, TEXT, lambda df, c: test(c))


def all_of(*rules: Rule) -> Tree:
    return Tree("and", list(rules))


def any_of(*rules: Rule) -> Tree:
    return Tree("or", list(rules))


def negate(rule: Rule | None = None) -> Tree:
    return Tree("not", [rule]) if rule is not None else Tree("and")


def later_than(column: str, at: datetime) -> Leaf:
    return time_range(column, low=at + timedelta(microseconds=1))


def earlier_than(column: str, at: datetime) -> Leaf:
    return time_range(column, high=at - timedelta(microseconds=1))


def greater(column: str, value: float) -> Leaf:
    return number_range(column, low=value, low_open=True)


def less(column: str, value: float) -> Leaf:
    return number_range(column, high=value, high_open=True)


def in_list(column: str, values: list) -> Rule:
    """Booleans, one number or one instant, or texts; ValueError for an empty or mixed list."""
    if not values:
        raise ValueError("an empty list")
    if all(isinstance(v, bool) for v in values):
        return is_boolean(column, True in values, False in values)
    if len(values) == 1 and isinstance(values[0], (int, float)):
        return number_range(column, values[0], values[0])
    if len(values) == 1 and isinstance(values[0], datetime):
        return time_range(column, values[0], values[0])
    if all(isinstance(v, str) for v in values):
        return enum_in(column, values)
    raise ValueError("a list of several types")


def not_in(column: str, values: list) -> Rule:
    return negate(in_list(column, values))


def in_range(column: str, low, high) -> Rule:
    """ValueError for a range without ends, upside down or of two types."""
    if low is None and high is None:
        raise ValueError("a range without ends")
    if low is not None and high is not None:
        if isinstance(low, datetime) != isinstance(high, datetime):
            raise ValueError("a range of two types")
        if low > high:
            raise ValueError("a range upside down")
    return (time_range if isinstance(low if low is not None else high, datetime) else number_range)(column, low, high)


def where(df: DataFrame, rule: Rule) -> DataFrame:
    made = rule.compile(df)
    return df if made is None else df.where(made)
