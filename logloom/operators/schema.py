"""Typed columns from parsed fields: profile, inference, promotion, health, retyping.

One pass over (key, kind, value) rows profiles all keys at once; inference works on that small profile (one row a key).
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import levels, times
from logloom.functions.text import as_boolean, once, scalar_kind

#: Names of time and level columns, lower case. Fixed values.
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime", "created_at")
LEVEL_KEYS = (
    "level", "severity", "loglevel", "log.level", "log_level", "lvl", "levelname", "priority",
    "l", "lv", "lev", "sev", "s", "loglvl",
    "severity_text", "severity.text", "severitytext", "log_severity", "log.severity", "logseverity",
    "level_name", "level.name", "@level",
)
#: Distinct values an enumeration holds, bytes of one, share of misfits it stands. Fixed values.
ENUM_VALUES, ENUM_BYTES, ENUM_MISFITS, ENUM_ROWS = 64, 64, 0.01, 2


@dataclass
class Field:
    name: str
    keys: list[str]
    type: str = "any"
    visible: bool = True
    auto_detect: bool = True
    formats: list[str] = field(default_factory=lambda: list(times.DEFAULT_FORMATS))
    level_mapping: dict[str, str] = field(default_factory=dict)


@dataclass
class LogSchema:
    fields: list[Field]

    def find(self, key: str) -> Field | None:
        """The field of a name, or one that reads the key."""
        return next((f for f in self.fields if f.name == key), None) or next((f for f in self.fields if key in f.keys), None)

    def bind(self, keys: list[str]) -> Field | None:
        """The first field whose keys hold all of these."""
        return next((f for f in self.fields if set(keys) <= {*f.keys, f.name}), None)

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.fields])

    @classmethod
    def from_json(cls, text: str) -> LogSchema:
        return cls([Field(**f) for f in json.loads(text)])

    def ordered(self) -> LogSchema:
        """The first time field first, the first level field second."""
        out = list(self.fields)
        for place, kind in ((0, "time"), (1, "level")):
            at = next((f for f in out if f.type == kind), None)
            if at is not None:
                out.remove(at)
                out.insert(min(place, len(out)), at)
        return LogSchema(out)


def discover(parsed: DataFrame) -> DataFrame:
    """key, rows that have it, first line it came in."""
    return parsed.where("fields IS NOT NULL").select("source", "line_id", F.explode("fields").alias("key", "value")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("source", "line_id")).alias("first"))


_COUNTS = ("rows", "null", "bool", "int", "float", "string", "json", "long")
_PROFILE = "key string, " + ", ".join(f"`{c}` bigint" for c in _COUNTS) + ", values array<string>, overflow boolean"


def profile(parsed: DataFrame, values: int = ENUM_VALUES) -> DataFrame:
    """One row a key: rows, counts by kind, long strings, the distinct short strings if there are at most `values` (else null), and
    overflow, whether there are more.

    One pass: each task keeps, of each key, its counts and at most values + 1 strings; what the tasks found is merged, in two
    steps, by merged_profiles()."""
    short = F.when((F.col("kind") == "string") & (F.octet_length("value") <= ENUM_BYTES), F.col("value"))
    entries = F.explode(F.map_entries("fields")).alias("e")
    pairs = parsed.where("fields IS NOT NULL").select(entries, "kinds").select(F.col("e.key").alias("key"), F.element_at("kinds", F.col("e.key")).alias("kind"), F.col("e.value").alias("value"))
    names = _COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, int]] = {}
        found: dict[str, set | None] = {}  # None: more than `values`
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, kind, long, n in zip(*(c.to_pylist() for c in table.group_by(["key", "kind", "long"]).aggregate([([], "count_all")]).columns), strict=True):
                own = counts.setdefault(key, dict.fromkeys(names, 0))
                own["rows"] += n
                own[kind] += n
                own["long"] += n if long else 0
            full = [k for k, v in found.items() if v is None]
            some = table.filter(pc.and_(pc.is_valid(table["short"]), pc.invert(pc.is_in(table["key"], pa.array(full, pa.string())))))
            for key, value in zip(*(c.to_pylist() for c in some.select(["key", "short"]).group_by(["key", "short"]).aggregate([]).columns), strict=True):
                own_set = found.setdefault(key, set())
                if own_set is not None:
                    own_set.add(value)
                    if len(own_set) > values:
                        found[key] = None
        lists = [sorted(v) if (v := found.get(k, set())) is not None else None for k in counts]
        arrays = [pa.array(list(counts), pa.string()), *(pa.array([c[x] for c in counts.values()], pa.int64()) for x in names), pa.array(lists, pa.list_(pa.string())), pa.array([x is None for x in lists], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["key", *names, "values", "overflow"])

    told = pairs.select("key", F.coalesce("kind", F.lit("null")).alias("kind"), short.alias("short"), ((F.col("kind") == "string") & (F.octet_length("value") > ENUM_BYTES)).alias("long"))
    parts = told.mapInArrow(run, _PROFILE)
    # at most 64 of the tasks' rows a key meet in the last step
    return merged_profiles(merged_profiles(parts.withColumn("part", F.spark_partition_id() % 64), values, "part").drop("part"), values)


def merged_profiles(profiles: DataFrame, values: int = ENUM_VALUES, *by: str) -> DataFrame:
    """Profiles of parts of the rows, merged into one row a key. Associative: however rows are parted, the result is that of all of them."""
    united = F.array_distinct(F.flatten(F.collect_list("values")))
    out = profiles.groupBy("key", *by).agg(*(F.sum(c).alias(c) for c in _COUNTS), united.alias("values"), F.max("overflow").alias("overflow"))
    out = out.withColumn("overflow", F.col("overflow") | (F.size("values") > values))
    return out.withColumn("values", F.when(~F.col("overflow"), F.array_sort("values")))


def infer_type(p: Column | None = None) -> Column:
    """Type from a profile row: bool only, int and float, int, float; bool with numbers and nothing at all are any."""
    has = lambda k: F.col(k) > 0
    return (
        F.when(has("string") | has("json"), "string")
        .when(has("bool") & (has("int") | has("float")), "any")
        .when(has("bool"), "boolean")
        .when(has("int") & has("float"), "number")
        .when(has("int"), "integer")
        .when(has("float"), "floating")
        .otherwise("any")
    )


def promote(profiled: DataFrame) -> DataFrame:
    """Adds type: enum, level and time promotion on top of inference."""
    present = F.col("string") + F.col("json") + F.col("bool") + F.col("int") + F.col("float")
    misfits = F.col("long") + present - F.col("string")
    enum = (F.col("string") > 0) & (F.size("values") <= ENUM_VALUES) & (F.size("values") > 0) & (F.col("string") >= ENUM_ROWS) & (misfits <= ENUM_MISFITS * present)
    ranked = F.size(F.filter("values", lambda v: levels.level_rank(v).isNotNull()))
    level = enum & F.lower("key").isin(*LEVEL_KEYS) & (ranked > 0) & ((F.size("values") - ranked) * 4 <= ranked)
    time = F.lower("key").isin(*TIME_KEYS)
    return profiled.withColumn("type", F.when(time, "time").when(level, "level").when(enum, "enum").otherwise(infer_type()))


def infer_schema(parsed: DataFrame) -> LogSchema:
    """Keys in sorted order, typed, time first and level second. Collects one row a key."""
    rows = promote(profile(parsed)).select("key", "type").orderBy("key").collect()
    return LogSchema([Field(r["key"], [r["key"]], r["type"]) for r in rows]).ordered()


def value_of(f: Field) -> Column:
    """Text of a field: the first of its keys that is not null."""
    return F.coalesce(*(F.element_at(F.col("fields"), F.lit(k)) for k in f.keys))


def typed(text: Column, f: Field, reference: datetime.date | None = None) -> Column:
    if f.type == "time":
        micros = F.when(text.rlike(r"^-?\d{1,18}$"), F.timestamp_micros(text.try_cast("long")))
        return F.coalesce(times.parse_time(text, tuple(f.formats), reference), micros)
    if f.type == "boolean":
        return as_boolean(text)
    if f.type == "integer":
        return text.try_cast("decimal(20,0)")
    if f.type in ("floating", "number"):
        return text.try_cast("double")
    return text


def apply_schema(parsed: DataFrame, schema: LogSchema, keep: tuple[str, ...] = ("source", "line_id"), reference: datetime.date | None = None) -> DataFrame:
    """Typed columns; a level gets <name>_rank beside it, a time its text as <name>_raw."""
    columns: list[Column] = [F.col(k) for k in keep]
    texts = {f"_text_{i}": value_of(f) for i, f in enumerate(schema.fields)}
    rows = parsed.where("fields IS NOT NULL")
    if texts:
        rows = once(rows, **texts)
    for f, text in zip(schema.fields, map(F.col, texts), strict=True):
        columns.append(typed(text, f, reference).alias(f.name))
        if f.type == "level":
            columns.append(levels.level_rank(text, f.level_mapping).alias(f"{f.name}_rank"))
        elif f.type == "time":
            columns.append(text.alias(f"{f.name}_raw"))
    return rows.select(*columns)


def retype(df: DataFrame, name: str, to: str, formats: tuple[str, ...] = times.DEFAULT_FORMATS) -> DataFrame:
    """Pin a column to a type; what does not fit becomes null. The schema's metadata keeps the pin."""
    f = Field(name, [name], to, auto_detect=False, formats=list(formats))
    text = F.col(name).cast("string")
    return df.withColumn(name, typed(text, f)).withMetadata(name, {"type": to, "autoDetect": False})


def redetect(df: DataFrame, name: str) -> str:
    """Type of one text column by the rules of promote()."""
    text = F.col(name).cast("string")
    one = df.select(F.create_map(F.lit(name), text).alias("fields"), F.create_map(F.lit(name), scalar_kind(text)).alias("kinds"))
    return promote(profile(one)).first()["type"]


def columns_in_order(df: DataFrame, order: list[str], hidden: tuple[str, ...] = (), names: dict[str, str] | None = None) -> DataFrame:
    """Named columns first, the rest as they were, hidden ones left out of the projection only; names renames columns."""
    shown = [c for c in order if c not in hidden] + [c for c in df.columns if c not in order and c not in hidden]
    return df.select(*(F.col(f"`{c}`").alias((names or {}).get(c, c)) for c in shown))


def type_health(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, total, present, matching, mismatch_pct of columns against their declared types, in one pass over the data."""
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, (c, t) in enumerate(types.items()):
        col, dtype = F.col(f"`{c}`"), df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            kind = scalar_kind(col)
            match = {"boolean": kind == "bool", "integer": kind == "int", "floating": kind == "float", "number": kind.isin("int", "float"), "time": times.parse_time(col).isNotNull(), "level": F.octet_length(col) <= ENUM_BYTES, "enum": F.octet_length(col) <= ENUM_BYTES}.get(t, col.isNotNull())
        else:
            fits = {"boolean": T.BooleanType, "integer": (T.IntegralType, T.DecimalType), "floating": T.FractionalType, "number": T.NumericType, "time": (T.TimestampType, T.TimestampNTZType, T.LongType), "string": T.StringType, "enum": T.StringType, "level": T.StringType}.get(t, T.DataType)
            match = col.isNotNull() if isinstance(dtype, fits) else F.lit(False)
        aggregates += [F.count(col).alias(f"p{i}"), F.count_if(match & col.isNotNull()).alias(f"m{i}")]
    one = df.agg(*aggregates)
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col("total"), F.col(f"p{i}").alias("present"), F.col(f"m{i}").alias("matching")) for i, c in enumerate(types)))
    rows = one.select(F.explode(entries).alias("e")).select("e.*")
    return rows.withColumn("mismatch_pct", F.when(F.col("present") > 0, F.round(100.0 * (F.col("present") - F.col("matching")) / F.col("present"), 4)).otherwise(0.0))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def min_max(df: DataFrame, *names: str) -> DataFrame:
    return df.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))))


def is_monotonic(df: DataFrame, ts: str, order: str, by: str | None = None, block_rows: int = 65_536) -> DataFrame:
    """by, monotonic: whether ts never falls in the order (nulls skipped). In blocks of the order: inside each against the row
    before, and each block's first against the largest before it."""
    rows = df.where(F.col(ts).isNotNull()).withColumn("_by", F.col(by) if by else F.lit("")).withColumn("_b", F.floor(F.col(order) / block_rows))
    inside = Window.partitionBy("_by", "_b").orderBy(order)
    parts = rows.withColumn("_fell", F.col(ts) < F.lag(ts).over(inside)).groupBy("_by", "_b").agg(F.max(F.coalesce("_fell", F.lit(False))).alias("fell"), F.min(ts).alias("low"), F.max(ts).alias("high"))
    earlier = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("fell", F.col("fell") | F.coalesce(F.col("low") < F.max("high").over(earlier), F.lit(False))).groupBy("_by").agg((~F.max("fell")).alias("monotonic"))
    return out.withColumnRenamed("_by", by) if by else out.select("monotonic")
