"""Readers on small files: the shapes that logs come in."""

import bz2
import datetime
import gzip
import io
import lzma

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.operators import schema
from logloom.sources import blocks, detect, folding, formats, lines, templates

BUILT_IN = {t.name: t for t in templates.BUILT_IN}


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("line_id").select(*columns).collect()]


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a":1,"b":"x","c":18446744073709551610,"d":1.5,"e":true,"f":null,"g":{"h":[1,2]},"i":"7"}\n\n[1]\nbad\n{"a":1,"a":2}\n3\n{"open":\n')
    parsed = formats.read_jsonl(spark, path)
    got = rows(parsed, "line_id", "fields", "kinds")
    assert got[0] == (0, {"a": "1", "b": "x", "c": "18446744073709551610", "d": "1.5", "e": "true", "f": None, "g": '{"h":[1,2]}', "i": "7"}, {"a": "int", "b": "string", "c": "int", "d": "float", "e": "bool", "f": "null", "g": "json", "i": "string"})
    assert {g[0]: g[1] for g in got} | {} == {0: got[0][1], 2: None, 3: None, 4: {"a": "2"}, 5: None, 6: None}
    assert rows(formats.errors(parsed), "error")[0] == ("Error on line 3: not a JSON object",)


def test_json_is_strict(spark):
    bad = ["this line is not JSON at all", '{"id":3,"msg":"unterminated string', "[1,2,3]", '"a bare JSON string"', "42", "true", "null", "{trailing,comma:bad}", '{"id":6,"msg":"missing colon" "extra":"x"}',
           '{"a":1} xyz', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', '{"a":01}', '{"a":1,}', '{"a":"tab\there"}']
    deep = "[" * 40 + "]" * 40
    good = ["{}", '{"a":{"x": 1,  "y":[1, "]}"]}, "b":[]}', '{"a":1e400,"b":-0.0,"c":99999999999999999999}', f'{{"a":{deep},"b":1}}', '{"a":"' + "x\\\\" * 5000 + '","k\\n":1}', '{"a":1,"b":2,"a":"z"}']
    df = spark.createDataFrame(list(enumerate(bad + good)), "line_id long, raw string").withColumn("source", F.lit("s"))
    got = rows(formats.parse_jsonl(df), "fields", "kinds", "error")
    assert all(g[0] is None and g[2] == f"Error on line {i + 1}: not a JSON object" for i, g in enumerate(got[: len(bad)]))
    empty, nested, numbers, far, slashes, twice = got[len(bad) :]
    assert empty[:2] == ({}, {}) and twice[:2] == ({"a": "z", "b": "2"}, {"a": "string", "b": "int"})
    assert nested[0] == {"a": '{"x": 1,  "y":[1, "]}"]}', "b": "[]"} and set(nested[1].values()) == {"json"}
    assert numbers[0] == {"a": None, "b": "-0.0", "c": None} and numbers[1] == {"a": "null", "b": "float", "c": "null"}
    assert far[0] == {"a": deep, "b": "1"} and slashes[0] == {"a": "x\\" * 5000, "k\n": "1"}


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([("s", 0, "{}")], "source string, line_id long, raw string")
    plan = schema.promote(schema.profile(formats.parse_jsonl(df)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3  # for the counts, for the few keys that may be enumerations (the same counts, reused), and for the values of these


def test_lines_of_a_file_that_cannot_be_split(spark, tmp_path):
    """Lines get their numbers without a window over the lines of a file, and count on over files that follow each other."""
    for name, ids in (("b.10.gz", range(1200, 2000)), ("a.9.gz", range(1200))):
        (tmp_path / name).write_bytes(gzip.compress("".join(f"line {i}\n" for i in ids).encode()))
    read = lines.read_lines(spark, str(tmp_path))
    assert "row_number" not in read._jdf.queryExecution().optimizedPlan().toString()
    got = lines.numbered_on(read, F.regexp_extract("source", r"\.(\d+)\.gz$", 1).cast("int"))
    assert got.where(F.concat(F.lit("line "), F.col("line_id").cast("string")) != F.col("raw")).count() == 0 and got.count() == 2000


def test_few_partitions_are_spread(spark):
    """Rows of one file are many tasks' work before they are parsed."""
    few = spark.range(10_000).coalesce(1)
    got = lines.spread(few, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == 4 and min(r["count"] for r in got) > 2000


def test_head_of_blank_lines_and_carriage_returns(spark, tmp_path):
    path = write(tmp_path / "late.log", "\n" * 100 + 'a=1 b=2\r\r\na=2 b="\ue000\\\\x"\r\n')
    read = lines.read_lines(spark, path)
    assert detect.detect_formats(read).first()["format"] == "logfmt"
    assert rows(read.where("line_id >= 100"), "raw") == [("a=1 b=2\r",), ('a=2 b="\ue000\\\\x"',)]
    assert rows(formats.parse_logfmt(read), "fields")[1][0] == {"a": "2", "b": "\ue000\\x"}


def test_sources_that_come_twice(spark):
    a = spark.createDataFrame([("f", i, f"a{i}") for i in range(5)] + [("g", 0, "g")], "source string, line_id long, raw string")
    b = spark.createDataFrame([("f", i, f"b{i}") for i in range(3, 8)] + [("h", 0, "h")], "source string, line_id long, raw string")
    got = sorted((r["source"], r["line_id"], r["raw"], r["source_rank"]) for r in lines.merge_sources(a, b).collect())
    assert got == [*(("f", i, f"a{i}", 0) for i in range(5)), *(("f", i, f"b{i}", 1) for i in range(5, 8)), ("g", 0, "g", 0), ("h", 0, "h", 1)]


def test_logfmt(spark, tmp_path):
    path = write(tmp_path / "a.log", 'ts=2024 msg="hi \\"x\\" \\q\\n" n=42 bare k= x=a=b q="42" n=43\na=1 b="open\nz=+5 y=1d w=nan\n')
    got = rows(formats.parse_logfmt(lines.read_lines(spark, path)), "fields", "kinds", "error")
    assert got[0][0] == {"ts": "2024", "msg": 'hi "x" \\q\n', "n": "43", "bare": None, "k": None, "x": "a=b", "q": "42"}
    assert got[0][1]["q"] == "string" and got[0][1]["n"] == "int"
    assert got[1][0] == {"a": "1"} and "unterminated" in got[1][2]
    assert set(got[2][1].values()) == {"string"}


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿a,b,a,c\r\n1,"x,""y""",,2.5\n1,2,3,4,5\n"un,2\n"",x,"q"zz,true\n1\n')
    got = rows(formats.read_csv_logs(spark, path), "fields", "error")
    assert got[0] == ({"a": "1", "b": 'x,"y"', "a_2": None, "c": "2.5"}, None)
    assert got[1][0] == {"a": "1", "b": "2", "a_2": "3", "c": "4"} and "more cells" in got[1][1]
    assert "unterminated" in got[2][1]
    assert got[3] == ({"a": "", "b": "x", "a_2": "q", "c": "true"}, None)
    assert got[4] == ({"a": "1"}, None)


def test_folded_template(spark, tmp_path):
    path = write(tmp_path / "j.log", "  lost\n\n2024-04-28 04:02:03,123 INFO  [main] com.example.App - Start\n  at x\n\n  at y\n\n2024-04-28T04:02:04.456Z WARN msg\n")
    t = BUILT_IN["Java / log4j / SLF4J Logback"]
    got = rows(formats.read_regex(spark, path, t), "line_id", "fields")
    assert got[0] == (2, {"timestamp": "2024-04-28 04:02:03,123", "level": "INFO", "thread": "main", "logger": "com.example.App", "message": "Start\n  at x\n\n  at y"})
    assert got[1] == (7, {"timestamp": "2024-04-28T04:02:04.456Z", "level": "WARN", "thread": None, "logger": None, "message": "msg"})
    lost = folding.orphans(lines.read_lines(spark, path), folding.header(t, F.col("raw"))).collect()
    assert [(r["first"], r["last"]) for r in lost] == [(0, 0)]


def test_fold_over_blocks(spark):
    made = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("line_id"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("h"), F.col("id"))).otherwise(F.concat(F.lit(" c"), F.col("id"))).alias("raw"))
    got = rows(folding.fold_lines(made, folding.indented_header(F.col("raw")), block=10), "line_id", "raw")
    assert got == [(i, "\n".join([f"h{i}", *(f" c{j}" for j in range(i + 1, min(i + 7, 1000)))])) for i in range(0, 1000, 7)]


#: One line for each template of the catalogue, of our own.
SAMPLES = {
    "Apache/nginx Combined Log Format": '10.0.0.9 - - [11/Feb/2023:06:43:36 +0000] "GET /a HTTP/1.1" 200 57 "-" "agent"',
    "Apache/nginx Common Log Format": '10.0.0.9 - ann [11/Feb/2023:06:43:36 +0000] "GET /a HTTP/1.0" 404 -',
    "Apache error log": "[Wed Oct 11 14:32:52 2023] [error] [client 10.0.0.9] no such file",
    "Docker / containerd CRI runtime": "2024-01-02T03:04:05.000000001Z stderr F out of range",
    "Rust env_logger": "[2024-01-02T03:04:05Z WARN  app::net] slow peer",
    "Generic bracketed level": "[INFO] 2024-01-02T03:04:05 0x1 ready",
    "Google glog": "W0102 03:04:05.678901 77 file.cc:12] watch out",
    "Java / log4j / SLF4J Logback": "2024-01-02 03:04:05,678 ERROR [t-1] a.b.C - failed",
    "MongoDB 3.x text log": "2024-01-02T03:04:05.678+0000 I NETWORK  [conn7] closed",
    "MySQL / MariaDB error log": "2024-01-02T03:04:05.678901Z 3 [Warning] [MY-1] old plugin",
    "PostgreSQL": "2024-01-02 03:04:05.678 UTC [77] ann@db ERROR:  no relation",
    "Ruby on Rails": "I, [2024-01-02T03:04:05.678901 #77]  INFO -- web: started",
    "Redis": "77:M 02 Jan 2024 03:04:05.678 * ready",
    "spdlog": "[2024-01-02 03:04:05.678] [net] [warning] slow",
    "Squid native access log": "1704164645.678 12 10.0.0.9 TCP_HIT/200 512 GET http://a/ - NONE/- text/html",
    "Syslog (RFC3164)": "Jan  2 03:04:05 host cron[77]: done",
    "Syslog (RFC5424)": '<46>1 2024-01-02T03:04:05+02:00 host app - - [x a="b"] started',
    "Uber Zap (console)": "2024-01-02T03:04:05.678Z INFO a/b.go:12 up",
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_template_lines(spark, name):
    t, line = BUILT_IN[name], SAMPLES[name]
    match = t.python.match(line)
    assert match
    one = spark.createDataFrame([("s", 0, line)], "source string, line_id bigint, raw string")
    got = formats.parse_regex(one, t).first()["fields"]
    assert got == {k: v or None for k, v in match.groupdict().items()}


def test_templates():
    assert len(BUILT_IN) == 28
    assert all(not templates.faults(t) and t.java.count("?<") == 0 for t in templates.BUILT_IN)
    own = templates.Template("Redis", r"^(?<a_b>\w+)$", 1, samples=("x", "!"))
    assert templates.faults(own) == ["no match: !"]
    assert [t.name for t in templates.catalogue((own,))][-1] == "Redis" and len(templates.catalogue((own,))) == 28


def test_detection(spark, tmp_path):
    write(tmp_path / "a.json", '{"a": 1}\n')
    write(tmp_path / "b.log", "\na=1 b=2\n")
    write(tmp_path / "c.csv", "x,y\n1,2\n")
    write(tmp_path / "d.log", f"{SAMPLES['Redis']}\nother\n{SAMPLES['Redis']}\n")
    write(tmp_path / "e.txt", "plain words\nno format\n")
    got = {r["source"].rsplit("/", 1)[1]: (r["format"], r["template"]) for r in detect.detect_formats(lines.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.json": ("json", None), "b.log": ("logfmt", None), "c.csv": ("csv", None), "d.log": ("regex", "Redis"), "e.txt": ("json", None)}


def test_line_ids_over_splits(spark, tmp_path):
    path = write(tmp_path / "many.txt", "".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.read_lines(spark, path)
        assert got.where(F.concat(F.lit("line "), F.col("line_id").cast("string")) != F.col("raw")).count() == 0
        assert got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compressed(spark, tmp_path):
    data = b"one\ntwo\r\nthree"
    (tmp_path / "a").write_bytes(gzip.compress(data))
    (tmp_path / "b").write_bytes(bz2.compress(data))
    (tmp_path / "c").write_bytes(lzma.compress(data))
    (tmp_path / "d").write_bytes(pa.compress(data, "zstd", asbytes=True))
    (tmp_path / "e").write_bytes(data)
    got = lines.read_compressed(spark, str(tmp_path)).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("line_id", "raw"))).alias("x")).collect()
    assert len(got) == 5 and all([tuple(y) for y in r["x"]] == [(0, "one"), (1, "two"), (2, "three")] for r in got)


def test_schema_of_logs(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", "".join(f'{{"ts":"2024-01-02T03:04:{i:02d}.5Z","level":"{("INFO", "warn", "ERROR")[i % 3]}","n":{i},"x":{i}.25,"free":"m{i}"}}\n' for i in range(60)) + '{"n":1.5}\n')
    parsed = formats.read_jsonl(spark, path)
    found = schema.infer_schema(parsed)
    assert [(f.name, f.type) for f in found.fields][:2] == [("ts", "time"), ("level", "level")]
    assert {f.name: f.type for f in found.fields} == {"ts": "time", "level": "level", "free": "enum", "n": "number", "x": "floating"}
    assert schema.LogSchema.from_json(found.to_json()) == found
    typed = schema.apply_schema(parsed, found).orderBy("line_id").collect()
    assert typed[7]["ts"] == datetime.datetime(2024, 1, 2, 3, 4, 7, 500000) and typed[1]["level_rank"] == 3 and typed[60]["level"] is None


def test_rotation(spark):
    names = ["/l/app.log", "/l/app.log.2", "/l/app.log.10.gz", "/l/app-2024-01-02.log", "/l/app.log-2024-01-01.xz", "/l/app.log.0"]
    df = lines.rotation_order(spark.createDataFrame([(n,) for n in names], "source string"))
    order = [r["source"] for r in df.where("rotation_family = '/l/app.log'").orderBy("rotation_rank").collect()]
    assert order == ["/l/app.log-2024-01-01.xz", "/l/app-2024-01-02.log", "/l/app.log.10.gz", "/l/app.log.2", "/l/app.log"]


def test_merge(spark):
    a = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y")], "source string, line_id bigint, a string")
    b = spark.createDataFrame([("s", 1, 2), ("t", 0, 3)], "source string, line_id bigint, b int")
    got = lines.merge_sources(a, b).orderBy("source", "line_id").collect()
    assert [(r["source"], r["line_id"], r["a"], r["b"]) for r in got] == [("s", 0, "x", None), ("s", 1, "y", None), ("t", 0, None, 3)]


def test_values_of_a_megabyte(spark):
    """No line is too long for a parser, a detector or a built-in template."""
    big = "x" * 1_000_000
    lines_ = lambda *raws: spark.createDataFrame([("f", i, r) for i, r in enumerate(raws)], "source string, line_id long, raw string")
    quoted = '\\"' * 300_000
    got = formats.parse_logfmt(lines_(f'a="{big}" b={big}', f'a="{quoted}" b=1', f'a=1 b="{big}', f"{big}=1 c")).orderBy("line_id").collect()
    assert [(len(r["fields"]["a"] or "") if "a" in r["fields"] else None, r["error"] is None) for r in got] == [(1_000_000, True), (300_000, True), (1, False), (None, True)]
    doubled = '""' * 300_000
    got = formats.parse_csv(lines_("a,b", f'"{big}",1', f'"{doubled}",2', f"{big},3", f'"{big},4')).orderBy("line_id").collect()
    assert [(len(r["fields"]["a"]), r["error"] is None) for r in got] == [(1_000_000, True), (300_000, True), (1_000_000, True), (0, False)]
    got = formats.parse_jsonl(lines_(f'{{"a": "{big}"}}', f'\t{{"a": "{quoted}"}}', "\t", " \t ")).orderBy("line_id").collect()
    assert [(len(r["fields"]["a"]), r["error"]) for r in got] == [(1_000_000, None), (300_000, None)]
    heads = [f'"{big}",{big}', f'a="{big}"', big, f'{{"a": "{big}"}}', "[" + big, "<" + big]
    df = spark.createDataFrame([(f"f{k}", i, h) for k, h in enumerate(heads) for i in range(2)], "source string, line_id long, raw string")
    assert {r["source"]: r["format"] for r in detect.detect_formats(df).collect()} == {"f0": "csv", "f1": "logfmt", "f2": "json", "f3": "json", "f4": "json", "f5": "json"}
    for t in templates.catalogue(()):
        assert formats.parse_regex(lines_(big, "[" + "a " * 500_000, f'1.2.3.4 - - [{big}] "GET / HTTP/1.1" 200 1'), t).count() == 3


def test_cells_whose_quotes_do_not_close(spark):
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(["a,b", '"x"",1', '"x""y""z,1', '"p""q",1'])], "source string, line_id long, raw string")
    assert [r["fields"]["a"] for r in formats.parse_csv(df).orderBy("line_id").collect()] == ["x", 'x"y', 'p"q']


def _framed(data, kind, cuts):
    pack = {"gzip": gzip.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": lambda x: pa.compress(x, "zstd", asbytes=True), "none": bytes}[kind]
    return b"".join(pack(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True))


@pytest.mark.parametrize("kind", ["gzip", "bzip2", "xz", "zstd", "none"])
@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"\n\n", b"one\ntwo\r\n\nthree", b"x" * 3000 + b"\n" + b"y\n" * 500, "".join(f"{i} {i * i}\n" for i in range(900)).encode()])
def test_pieces_hold_each_line_once(kind, data):
    wanted = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
    for cuts in ([], [len(data) // 2], sorted({len(data) * i // 7 for i in range(1, 7)})):
        raw = _framed(data, kind, cuts)
        for piece in (40, 200, 1 << 20):
            file, got = io.BytesIO(raw), []
            told = blocks.codec(raw[:10])
            assert told == kind or not raw
            for start, stop in blocks.bounds(file, told, len(raw), piece):
                own, after = blocks.chunks(file, told, len(raw), start, stop), blocks.chunks(file, told, len(raw), stop, len(raw))
                got += [line for part in blocks.numbered(own, lambda after=after: after, start == 0) for line in part]
            assert got == wanted


def test_files_of_frames_are_several_tasks(spark, tmp_path):
    data = "".join(f"line {i} {i * 7919 % 1000003}\n" for i in range(20_000)).encode()
    for kind in ("gzip", "bzip2", "xz", "zstd", "none"):
        (tmp_path / f"a b.{kind}").write_bytes(_framed(data, kind, [len(data) * i // 9 for i in range(1, 9)]))
    (tmp_path / "nothing").write_bytes(b"")
    files = lines.files_of(spark, str(tmp_path))
    many = {r["codec"]: r["count"] for r in blocks.pieces(files, 10_000).groupBy("codec").count().collect()}
    assert many["gzip"] == 1 and all(many[k] > 3 for k in ("bzip2", "xz", "zstd", "none"))
    got = lines.read_compressed(spark, str(tmp_path), piece=10_000)
    right = F.concat(F.lit("line "), F.col("line_id").cast("string"), F.lit(" "), (F.col("line_id") * 7919 % 1000003).cast("string")) == F.col("raw")
    assert [tuple(r) for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(right).alias("right")).select("rows", "right").collect()] == [(20_000, 20_000)] * 5
    with pytest.raises(Exception, match="is larger than 1000 bytes"):
        lines.read_compressed(spark, str(tmp_path), most_bytes=1000).count()


def test_heads_read_no_further(spark, tmp_path):
    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            got = super().read(n)
            self.seen += len(got)
            return got

    noise = "".join(f"{i} {i * 2654435761 % 2**32:x}\n" for i in range(200_000)).encode()
    for kind in ("gzip", "bzip2", "xz", "zstd", "none"):
        raw = _framed(b"\n \n" + noise, kind, [])
        assert len(raw) > 800_000
        file = Counted(raw)
        assert blocks.head(file, len(raw), 3) == [b"", b" ", b"0 0", *noise.split(b"\n")[1:3]]
        assert file.seen < (700_000 if kind == "bzip2" else 250_000)  # a bzip2 block is 900 000 bytes before it is packed; gzip and zstd read ahead
        cut = raw[: len(raw) // 2] if kind != "bzip2" else raw[: len(raw) * 4 // 5]  # still being written
        assert blocks.head(io.BytesIO(cut), len(cut), 3)[2] == b"0 0"
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"\n\nk=1 l=2\n" + noise))
    (tmp_path / "b.xz").write_bytes(lzma.compress(b'{"a": 1}'))
    (tmp_path / "c").write_bytes(b"")
    assert {(r["source"][-4:], r["format"]) for r in detect.detect_files(spark, str(tmp_path)).collect()} == {("a.gz", "logfmt"), ("b.xz", "json")}
    assert lines.read_heads(spark, str(tmp_path), 2).count() == 5
