"""Severity levels of log rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical level names by rank 0 to 5, and the aliases (lower case) of each. Fixed values.
CANONICAL = ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")
ALIASES = {
    "Trace": ("trace", "trc", "t", "finer", "finest", "silly"),
    "Debug": ("debug", "dbg", "d", "verbose", "vrb", "v", "fine"),
    "Info": ("info", "inf", "i", "information", "informational", "notice"),
    "Warn": ("warn", "wrn", "w", "warning"),
    "Error": ("error", "err", "e", "severe"),
    "Fatal": ("fatal", "ftl", "f", "critical", "crit", "emerg", "emergency", "panic", "alert", "fault"),
}
_RANK = {alias: rank for rank, name in enumerate(CANONICAL) for alias in ALIASES[name]}


def rank_of(name: str | None) -> int | None:
    """Rank of a level's name or alias, in any case."""
    return _RANK.get(name.lower()) if name else None


def level_rank(value: Column, overrides: dict[str, str] | None = None) -> Column:
    """Rank 0 (trace) to 5 (fatal) of raw level text; null if it is none.

    overrides maps raw values (exact) to level names or aliases, and comes first; an override to no level is ignored.
    """
    lower = F.lower(value)
    out = F.lit(None).cast("int")
    for rank, name in enumerate(CANONICAL):
        out = F.when(lower.isin(*ALIASES[name]), rank).otherwise(out)
    by_rank: dict[int, list[str]] = {}
    for raw, to in (overrides or {}).items():
        if (rank := rank_of(to)) is not None:
            by_rank.setdefault(rank, []).append(raw)
    for rank, raws in by_rank.items():
        out = F.when(value.isin(*raws), rank).otherwise(out)
    return out.cast("int")


def level_name(rank: Column) -> Column:
    """Canonical name of a rank; null outside 0 to 5."""
    return F.get(F.array(*map(F.lit, CANONICAL)), rank)


def raw_values(ranks: list[int], overrides: dict[str, str] | None = None) -> list[str]:
    """Lower-case aliases and overrides that have one of the ranks."""
    own = [a for a, r in _RANK.items() if r in ranks]
    return own + [k for k, v in (overrides or {}).items() if rank_of(v) in ranks]
