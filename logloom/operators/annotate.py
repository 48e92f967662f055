"""Bookmarks (anchors), highlight rules, find, record detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import display, sanitise_note
from logloom.operators import filters

COLOURS = 8
#: Anchors that are broadcast at most; more are joined by a shuffle.
BROADCAST_ANCHORS = 1_000_000
KEY = ["source", "line_id"]


def with_anchors(df: DataFrame, anchors: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds colour and note of the anchor on each row; null where there is none."""
    key = key or KEY
    few = anchors.select(*key, "colour", "note").dropDuplicates(key)
    return df.join(F.broadcast(few) if few.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS else few, key, "left")


def upsert_anchors(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: source, line_id, seq, action (set, recolour, remove), colour, note. Of a row's changes the last (by seq) counts;
    recolour keeps the note and makes an anchor where there is none; colours are clamped, notes cleaned."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    now = changes.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*KEY, "action", F.greatest(F.lit(0), F.least(F.lit(COLOURS - 1), F.col("colour"))).alias("new_colour"), sanitise_note(F.col("note")).alias("new_note"))
    both = anchors.join(now, KEY, "full")
    note = F.when(F.col("action") == "set", F.col("new_note")).otherwise(F.col("note"))
    return both.where(F.col("action").isNull() | (F.col("action") != "remove")).select(*KEY, F.coalesce("new_colour", "colour").alias("colour"), note.alias("note"))


def replace_anchors(rows: DataFrame, colour: int, note: str | None = None) -> DataFrame:
    """A new set of anchors, one on each of the rows."""
    return rows.select(*KEY, F.lit(max(0, min(COLOURS - 1, colour))).alias("colour"), sanitise_note(F.lit(note).cast("string")).alias("note")).dropDuplicates(KEY)


def persisted_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors of rows that have a source, by source and line."""
    return anchors.where(F.coalesce(F.col("source"), F.lit("")) != "").orderBy(*KEY)


def remap_anchors(anchors: DataFrame, numbered: DataFrame) -> DataFrame:
    """Anchors on the rows of a snapshot: numbered has source, line_id and row_id."""
    return anchors.join(numbered.select(*KEY, "row_id"), KEY).select("row_id", "colour", "note")


def compile_rules(df: DataFrame, rules: list[tuple[str, filters.Rule]]) -> tuple[list[tuple[int, str, Column]], list[str]]:
    """Rules that can be resolved, with their place, and the names of those that cannot (inactive)."""
    active, inactive = [], []
    for i, (name, rule) in enumerate(rules):
        made = rule.compile(df)
        if made is None:
            inactive.append(name)
        else:
            active.append((i, name, made))
    return active, inactive


def highlight(df: DataFrame, rules: list[tuple[str, filters.Rule]]) -> DataFrame:
    """Adds highlight: the name of the last rule that matches the row."""
    active, _ = compile_rules(df, rules)
    out = F.lit(None).cast("string")
    for _, name, made in active:
        out = F.when(made, name).otherwise(out)
    return df.withColumn("highlight", out)


def inactive_rules(df: DataFrame, rules: list[tuple[str, filters.Rule]]) -> DataFrame:
    """rule, active: one row a rule, beside the number of rows it would mark."""
    active, _ = compile_rules(df, rules)
    marks = df.agg(*(F.count_if(made).alias(f"r{i}") for i, _, made in active), F.count(F.lit(1)).alias("rows"))
    made = {i for i, _, _ in active}
    entries = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(i in made).alias("active"), (F.col(f"r{i}") if i in made else F.lit(0)).cast("long").alias("rows_marked")) for i, (name, _) in enumerate(rules)))
    return marks.select(F.explode(entries).alias("e")).select("e.*")


def find_expression(df: DataFrame, needle: str, mode: str = "substring", columns: list[str] | None = None, ignore_case: bool = False) -> Column:
    """Whether any of the columns holds the needle: substring, wildcard (anywhere) or regex."""
    if not needle:
        return F.lit(False)
    if mode == "wildcard":
        needle, mode = filters.glob_pattern(needle, cross_slash=True).removeprefix("^").removesuffix("$"), "regex"
    out = F.lit(False)
    for c in columns or df.columns:
        text = display(F.col(f"`{c}`"))
        if mode == "regex":
            hit = text.rlike(("(?i)" if ignore_case else "") + needle)
        else:
            hit = F.lower(text).contains(needle.lower()) if ignore_case else text.contains(needle)
        out = out | hit
    return out


def find(df: DataFrame, needle: str, mode: str = "substring", columns: list[str] | None = None, first: int | None = None, row_id: str = "row_id", ignore_case: bool = False) -> DataFrame:
    hits = df.where(find_expression(df, needle, mode, columns, ignore_case))
    return hits if first is None else hits.orderBy(row_id).limit(first)


def record_detail(df: DataFrame, key: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """One row a field: key, place, field, value as text (null stays null)."""
    names = columns or [c for c in df.columns if c != key]
    entries = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)))
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.*")
