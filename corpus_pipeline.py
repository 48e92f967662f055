"""A corpus in four stages: language, near duplicates, mixing, SentencePiece. Each stage's documents are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import common, language_id, mixing, ngram_join, sentencepiece_codec

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; the others' lang becomes the predicted one."""
    known = language_id.identify(docs, language_id.fit(docs), keep=("text", "source", "n_chars"))
    return known.where(F.col("lang_pred") != language_id.UNDETERMINED).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with word 5-gram Jaccard similarity of 0.8 or more (linked directly or through others) one row stays: the
    one with the least id (null is above all), of these the one with the least hash. Repeated and null ids follow the same rule: of repeated
    rows one stays, and an id that comes with several texts keeps those that are not copies. Documents without words stay."""
    with common.temporaries():
        found = ngram_join.jaccard_components(docs, words=5, percent=80, with_rows=True).where("group IS NOT NULL")
        best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = found.join(best.select(F.col("group").alias("g"), "best"), F.col("group") == F.col("g")).groupBy("row", "best").agg(F.count(F.lit(1)).alias("n"))
        gone = common.materialise(rows.where("row <> best OR n > 1").select(F.col("row").alias("node"), (F.col("row") == F.col("best")).alias("repeated")), "duplicates", lasting=True)
    docs = docs.select(*COLUMNS).withColumn("row", ngram_join.row_hash(F.col("doc_id"), F.col("text")))
    repeated = gone.where("repeated").select("node")
    n_gone, n_repeated = gone.count(), repeated.count()
    kept = ngram_join.join_rows(docs, gone.select("node"), n_gone, "left_anti").select(*COLUMNS)
    if n_repeated:  # rows of equal id and text: one of them
        once = ngram_join.join_rows(docs, repeated, n_repeated, "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("r"))
        kept = kept.unionByName(once.select("r.*"))
    return kept


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it, whole; some come not at all."""
    mixed = mixing.mix(docs, cut="nearest", keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests. A null or empty text is encoded as an empty one; rows come out as they went in."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing_weights), ("sentencepiece", sentencepiece)]

#: A trained network and a tokenizer can't be expressed in SQL; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        done = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if i:  # the stage before is read no more
            common.release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
