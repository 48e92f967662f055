"""Operators 1 and 5, and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from logloom import llm
from logloom.llm import language_id, mixing, sharding
from test_near import brute


@pytest.mark.parametrize("ranges", [None, 8, 300])
def test_shards(docs, empty, texts, ranges):
    got = sharding.shard(docs, ranges=ranges).collect()
    assert len(got) == len(texts) == len({r["doc_id"] for r in got})
    slots = defaultdict(list)
    for r in got:
        t = (texts[r["doc_id"] // 3] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None) and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_shards_hold_near_equal_bytes(spark):
    got = [r["b"] for r in llm.QUERIES["op1_shards"](spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 8 and max(got) - min(got) < 0.01 * min(got)


def test_shards_split_a_hot_text(spark):
    rows = [(i, "the same words in a third of the rows" if i % 3 else f"text {i}" * (i % 7)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), ranges=64).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.05 * min(load.values())


def test_shards_number_crowded_parts_in_bins(spark):
    """Null and empty texts are few bytes and many rows."""
    rows = [(i, None if i % 3 else "") for i in range(6000)] + [(6000 + i, "text " * i) for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), ranges=64)
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kept_columns_with_names_used_inside(docs):
    names = ("key", "start", "n", "rep", "root", "copy")
    wanted = {r["doc_id"]: tuple(r[c] for c in names) for r in docs.collect()}
    model = None
    for got in (mixing.mix(docs, keep=names), sharding.shard(docs, keep=names), language_id.identify(docs, model, keep=names)):
        assert {r["doc_id"]: tuple(r[c] for c in names) for r in got.collect()} == wanted
    for bad in (lambda: mixing.mix(docs, keep=("size",)), lambda: sharding.shard(docs, keep=("shard",)), lambda: language_id.identify(docs, model, keep=("score",))):
        with pytest.raises(ValueError, match="kept"):
            bad()


def test_repeated_rows_and_null_ids(spark):
    """Rows come out as often as they went in; which of equal rows gets what makes no difference."""
    rows = [(1, "one two three", "a")] * 4 + [(None, "four five", "a")] * 3 + [(None, None, None)] * 2 + [(2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(df).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter(r[0] for r in rows)
    assert sum(r["taken"] for r in mixed) == round(mixed[0]["target"] if mixed[0]["source"] == "a" else next(r["target"] for r in mixed if r["source"] == "a"))
    sharded = sharding.shard(df).collect()
    assert Counter(r["doc_id"] for r in sharded) == Counter(r[0] for r in rows)
    assert Counter(r["doc_id"] for r in language_id.identify(df, None).collect()) == Counter(r[0] for r in rows)


def test_mix(spark, docs, empty, texts):
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {i * 3: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    total, of = Counter(), Counter()
    for k, r in rows.items():
        assert r["size"] == size[k] and 0 <= r["taken"] <= 2 * size[k]
        total[source[k]] += size[k]
        of[source[k]] += r["taken"]
    goal = {source[k]: r["target"] for k, r in rows.items()}
    assert all(abs(of[s] - goal[s]) < 1 and goal[s] <= 2 * total[s] for s in total)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [goal[s] / weight[s] for s in order if goal[s] < 2 * total[s] - 1e-6]
    assert max(free) == pytest.approx(min(free)) and all(2 * total[s] / weight[s] <= free[0] + 1e-6 for s in order if goal[s] >= 2 * total[s] - 1e-6)
    assert {k: r["taken"] for k, r in rows.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7), bin_rows=3).collect()}
    assert mixing.mix(empty).count() == 0
    whole = mixing.mix(docs, cut="nearest").collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in whole)
    assert mixing.mix(docs.where("text IS NULL")).first()["taken"] == 0


def test_mix_oracle(spark):
    same(llm.QUERIES["op5_mix_sources"](spark, "/root/testdata/sf0.001"), llm.ORACLES["op5_mix_sources"], "/root/testdata/sf0.001")


def test_pipeline_stages(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 5)
    columns = docs.select(*corpus_pipeline.COLUMNS)
    kept = {r["doc_id"]: r for r in corpus_pipeline.language(spark, columns, "").collect()}
    assert set(kept) == {i * 3 for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert all(r["text"] == texts[k // 3] and r["lang"] in ("en", "de", "es") for k, r in kept.items())
    groups = brute([i * 3 for i in range(len(texts))], texts, 5, 80)
    stay = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, columns, "").collect()}
    assert stay == {i for i, (_, root, _) in groups.items() if i == root}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(columns, cut="nearest").collect()}
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixing_weights(spark, columns, "").collect())
    assert mixed == {k: (t // s if s else 1) for k, (t, s) in taken.items() if not s or t}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty.select(*corpus_pipeline.COLUMNS), "")
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS


def test_near_duplicates_of_repeated_and_null_ids(spark):
    def words(c, last="end"):
        return " ".join([*(f"{c}{i}" for i in range(50)), last])

    rows = [(7, words("a")), (7, words("a")), (7, words("a"))]  # repeated rows: one stays
    rows += [(8, words("b")), (None, words("b")), (None, words("c")), (None, words("c", "other"))]  # null ids are compared
    rows += [(5, words("d")), (5, words("e")), (3, words("e")), (9, words("d", "other"))]  # id 5's first text is no copy
    rows += [(1, ""), (1, ""), (None, " ")]  # no words
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    one_of = [(i, t) for i, t in got if t in (words("c"), words("c", "other"))]
    assert len(one_of) == 1 and one_of[0][0] is None
    rest = Counter(got) - Counter(one_of)
    assert rest == Counter([(7, words("a")), (8, words("b")), (5, words("d")), (3, words("e")), (1, ""), (1, ""), (None, " ")])


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
