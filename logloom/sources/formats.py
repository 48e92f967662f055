"""Parsing lines into fields: JSON Lines, logfmt, CSV, regular expression templates.

Every parser takes lines (source, line_id, raw) and adds fields (map of text, null for a null value), kinds (map: null,
bool, int, float, string, json) and error (text of a bad line, null else). A bad line never stops a load. Columns of
their own come from operators.schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import blank, once, scalar_kind
from logloom.sources.lines import read_lines
from logloom.sources.templates import Template

#: Files whose CSV headers are broadcast at most; beyond, the join shuffles.
BROADCAST_FILES = 10_000
#: A logfmt pair: key, "=" part, quoted body, bare value. Fixed value.
LOGFMT = r'([^\s="]++)(=(?:"([^"\\]*+(?:\\.[^"\\]*+)*+)"|([^\s"]*+)))?'
#: A JSON string with its quotes. Fixed value.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A CSV cell with the comma before it: quoted body (a doubled quote only where another one closes), bare text.
CSV_CELL = r'(?:^|,)(?:"([^"]*+(?:""(?=[^"]*+")[^"]*+)*+)"[^,]*+|([^,]*+))'


def last_wins(keys: Column, values: Column) -> Column:
    """Map of keys to values; a key that comes twice has its last value."""
    n = F.size(keys)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), n).alias("i"))
    named = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"), p["i"].alias("i")))
    kept = F.filter(named, lambda p: ~F.array_contains(F.slice(keys, p["i"] + 1, n), p["k"]))
    repeated = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))
    return F.when((n == 0) | (F.size(F.array_distinct(keys)) == n), F.map_from_arrays(keys, values)).otherwise(repeated)


def _error(bad: Column, why: str) -> Column:
    return F.when(bad, F.concat(F.lit("Error on line "), (F.col("line_id") + 1).cast("string"), F.lit(f": {why}")))


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("fields", F.when(F.col("error").isNull() | F.col("_partial"), F.col("fields"))).withColumn("kinds", F.when(F.col("fields").isNotNull(), F.col("kinds"))).drop("_partial")


def _nested(depth: int = 24) -> str:
    """A pattern of JSON objects and arrays, one in another up to a depth."""
    out = r"[\[{](?:[^\[\]{}\"]++|" + JSON_STRING + r")*+[\]}]"
    for _ in range(depth):
        out = r"[\[{](?:[^\[\]{}\"]++|" + JSON_STRING + "|" + out + r")*+[\]}]"
    return out


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """One object per line, strictly JSON and nothing after it; nested values stay the text they are; of a key that comes
    twice the last value counts. Numbers that neither a 64-bit integer nor a double holds are null. Blank lines are dropped; a
    line that is no object is an error."""
    rows = lines.where(~blank(F.col("raw")))
    # as the only element of an array, so that text after the object is an error
    parsed = F.from_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    member = JSON_STRING + r"\s*+:\s*+(" + JSON_STRING + r"|[^\s{\[\",}]++|" + _nested() + ")"
    rows = once(rows, _o=parsed, _t=F.regexp_extract_all("raw", F.lit(member), F.lit(1)))
    good = F.col("raw").rlike(r"^\s*+\{") & (F.size("_o") == 1)
    rows = once(rows, _good=F.coalesce(good, F.lit(False)), _k=F.map_keys(F.col("_o")[0]), _s=F.map_values(F.col("_o")[0]))
    pairs = F.arrays_zip(F.col("_s").alias("s"), F.col("_t").alias("t"))
    kinds = F.transform("_t", _json_kind)
    values = F.transform(pairs, lambda p: F.when(p["t"].startswith('"'), p["s"]).when(~_json_null(p["t"]), p["t"]))
    whole = F.size("_k") == F.size("_t")  # but for objects nested deeper than the pattern goes: these come as Spark writes them
    values = F.when(whole, values).otherwise(F.col("_s"))
    kinds = F.when(whole, kinds).otherwise(F.transform("_s", lambda s: F.when(s.isNull(), "null").when(s.rlike(r"^[\[{]"), "json").otherwise(scalar_kind(s))))
    rows = once(rows, _v=values, _n=kinds)
    return _finish(
        rows.withColumn("error", _error(~F.col("_good"), "not a JSON object"))
        .withColumn("fields", F.when(F.col("_good"), last_wins(F.col("_k"), F.col("_v"))))
        .withColumn("kinds", F.when(F.col("_good"), last_wins(F.col("_k"), F.col("_n"))))
        .withColumn("_partial", F.lit(False))
        .drop("_o", "_t", "_good", "_k", "_s", "_v", "_n")
    )


def _json_null(text: Column) -> Column:
    """Whether the text of a JSON value is null or a number out of range."""
    # only long numbers and those with an exponent can be
    long = (F.length(text) > 18) | F.lower(text).contains("e")
    whole, number = text.rlike(r"^-?\d+$"), text.try_cast("double")
    least, most = (F.lit(str(x)).cast("decimal(38,0)") for x in (-(2**63), 2**64 - 1))
    far = F.when(whole, ~F.coalesce(text.try_cast("decimal(38,0)").between(least, most), F.lit(False))).otherwise(F.abs(number) == float("inf"))
    return F.when(text == "null", True).when(text.substr(1, 1).isin("[", "{", "t", "f"), False).when(long, far).otherwise(False)


def _json_kind(text: Column) -> Column:
    """Kind of a JSON value by its text."""
    first = text.substr(1, 1)
    return (
        F.when(first == '"', "string")
        .when(first.isin("[", "{"), "json")
        .when(first.isin("t", "f"), "bool")
        .when(_json_null(text), "null")
        .when(text.rlike(r"^-?\d+$"), "int")
        .otherwise("float")
    )


def _unescape(text: Column) -> Column:
    """Line feed, carriage return, tab, quote and backslash escapes; others keep both characters."""
    # between double backslashes the other escapes stand alone
    def plain(part: Column) -> Column:
        for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    return F.when(~text.contains("\\"), text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\"))


def parse_logfmt(lines: DataFrame) -> DataFrame:
    """key=value pairs; a bare key or key= is null; quoted values stay strings; of a key that comes twice the last counts. A
    quote that never closes is an error; the fields before it are kept."""
    rows = lines.where(~blank(F.col("raw")))
    inside = r'[^"\\]*+(?:\\.[^"\\]*+)*+'  # possessive throughout: no line is too long for the stack
    closed = rf'^{inside}(?:"{inside}"{inside})*+$'
    bad = ~F.col("raw").rlike(closed)
    usable = F.when(bad, F.regexp_replace("raw", rf'(?<![^\s="])[^\s="]++="{inside}$', "")).otherwise(F.col("raw"))
    group = lambda i: F.regexp_extract_all("_usable", F.lit(LOGFMT), F.lit(i))
    rows = once(rows, _usable=usable)
    cells = F.arrays_zip(group(2).alias("eq"), group(3).alias("quoted"), group(4).alias("bare"))
    is_quoted = lambda c: c["eq"].startswith('="')
    value = lambda c: F.when(is_quoted(c), _unescape(c["quoted"])).when(c["bare"] != "", c["bare"])
    kind = lambda c: F.when(is_quoted(c), "string").otherwise(scalar_kind(c["bare"]))
    named = F.transform(cells, lambda c: F.struct(c["eq"].alias("eq"), c["quoted"].alias("quoted"), c["bare"].alias("bare")))
    rows = once(rows, _keys=group(1), _cells=named)
    return _finish(
        rows.withColumn("error", _error(bad, "unterminated quote"))
        .withColumn("fields", last_wins(F.col("_keys"), F.transform("_cells", value)))
        .withColumn("kinds", last_wins(F.col("_keys"), F.transform("_cells", kind)))
        .withColumn("_partial", F.lit(True))
        .drop("_usable", "_keys", "_cells")
    )


def csv_cells(raw: Column) -> Column:
    """Array of (quoted: boolean, text)."""
    whole = F.regexp_extract_all(raw, F.lit(CSV_CELL), F.lit(0))
    body = F.regexp_extract_all(raw, F.lit(CSV_CELL), F.lit(1))
    bare = F.regexp_extract_all(raw, F.lit(CSV_CELL), F.lit(2))
    cells = F.arrays_zip(whole.alias("w"), body.alias("q"), bare.alias("b"))
    return F.transform(cells, lambda c: F.struct(c["w"].rlike('^,?"').alias("quoted"), F.when(c["w"].rlike('^,?"'), F.replace(c["q"], F.lit('""'), F.lit('"'))).otherwise(c["b"]).alias("text")))


def _unique_names(names: Column) -> Column:
    """A name that came before gets _2, _3 and so on."""
    return F.transform(names, lambda x, i: F.when(F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x)) > 1, F.concat(x, F.lit("_"), F.size(F.filter(F.slice(names, 1, i + 1), lambda y: y == x)).cast("string"))).otherwise(x))


def parse_csv(lines: DataFrame) -> DataFrame:
    """The first line of each source that is not blank is the header; commas only, no cell over several lines. Empty bare
    cells are null, quoted ones strings; a header that comes twice gets _2, _3. More cells than headers, or a quote that
    never closes, are errors; the cells that fit are kept."""
    rows = lines.where(~blank(F.col("raw")))
    # headers: one row a file
    headers = rows.groupBy("source").agg(F.min(F.struct("line_id", "raw")).alias("h")).select(F.col("source").alias("_s"), F.col("h.line_id").alias("_h"), _unique_names(F.transform(csv_cells(F.col("h.raw")), lambda c: F.trim(c["text"]))).alias("_names"))
    few = not rows.isStreaming and headers.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    rows = rows.join(F.broadcast(headers) if few else headers, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("line_id") > F.col("_h"))
    rows = once(rows, _cells=csv_cells(F.col("raw")))
    n = F.least(F.size("_cells"), F.size("_names"))
    odd = F.size(F.regexp_extract_all("raw", F.lit('(")'), F.lit(1))) % 2 == 1
    ragged = F.size("_cells") > F.size("_names")
    value = lambda c: F.when(c["quoted"] | (c["text"] != ""), c["text"])
    kind = lambda c: F.when(c["quoted"], "string").otherwise(scalar_kind(c["text"]))
    return _finish(
        rows.withColumn("error", F.coalesce(_error(odd, "unterminated quote"), _error(ragged, "more cells than the header has")))
        .withColumn("fields", last_wins(F.slice("_names", F.lit(1), n), F.transform(F.slice("_cells", F.lit(1), n), value)))
        .withColumn("kinds", last_wins(F.slice("_names", F.lit(1), n), F.transform(F.slice("_cells", F.lit(1), n), kind)))
        .withColumn("_partial", F.lit(True))
        .drop("_s", "_h", "_names", "_cells")
    )


def parse_regex(lines: DataFrame, template: Template) -> DataFrame:
    """Named groups become fields; a group that is empty or took no part is null. The match starts at the line's start and
    need not reach its end. Blank lines are dropped."""
    rows = lines.where(~blank(F.col("raw")))
    first = F.substring_index("raw", "\n", 1)
    pattern = template.java.removeprefix("^")
    anchored = f"^(?:{pattern})" if "|" in pattern else "^" + pattern
    hit = first.rlike(anchored)
    rest = F.substring(F.col("raw"), F.length(first) + 1, F.length("raw"))
    groups = template.groups()
    values = []
    for i, (_, g) in enumerate(groups):
        v = F.nullif(F.regexp_extract(first, anchored, g), F.lit(""))
        if i == len(groups) - 1:  # a folded record's other lines belong to the last group
            v = F.when(rest == "", v).otherwise(F.concat(F.coalesce(v, F.lit("")), rest))
        values.append(v)
    names = F.array(*(F.lit(c) for c, _ in groups))
    rows = rows.withColumn("_hit", hit).withColumn("_values", F.array(*values))
    return _finish(
        rows.withColumn("error", _error(~F.col("_hit"), "Line did not match the regex pattern."))
        .withColumn("fields", F.map_from_arrays(names, F.col("_values")))
        .withColumn("kinds", F.map_from_arrays(names, F.transform("_values", scalar_kind)))
        .withColumn("_partial", F.lit(False))
        .drop("_hit", "_values")
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsonl(read_lines(spark, path))


def read_logfmt(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    from logloom.sources.folding import fold_indented

    lines = read_lines(spark, path)
    return parse_logfmt(fold_indented(lines) if multiline else lines)


def read_csv_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_csv(read_lines(spark, path))


def read_regex(spark: SparkSession, path: str, template: Template) -> DataFrame:
    from logloom.sources.folding import fold

    return parse_regex(fold(read_lines(spark, path), template), template)


def errors(parsed: DataFrame) -> DataFrame:
    """The bad lines of a load."""
    return parsed.where(F.col("error").isNotNull()).select("source", "line_id", "raw", "error")
