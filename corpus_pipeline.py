"""Corpus cleaning as a chain of stages; each stage reads what the one before it wrote.

Null texts, empty texts, repeated rows and further columns pass through the stages as their operators define it: a text
without letters is rejected by the language stage, rows that repeat a doc_id with one text are one document to the
near-duplicate stage, further columns of any type and name stay with their rows, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.llm import langid, minhash, mixing, queries, toxicity
from csvharbor.llm.ranks import numbered
from csvharbor.llm.registry import reached
from csvharbor.operators.joins import lookup_join
from csvharbor.session import cut

LEAST_LANGUAGE_SCORE = 0.5
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose toxicity score is at the threshold or above."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.tag(F.col("text"), model)["score"] < queries.TOXIC_FROM)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter and those that no language has most of the score of.

    If no row tells a language, nothing can be learnt and only documents without a letter go.
    """
    model = queries.language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(F.col("text"), model)
    return docs.where((found["lang"] != langid.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every group of near copies; rows without a doc_id stay.

    Of rows that repeat a doc_id with one text, one stays: the first by the rows' JSON. Different texts under one doc_id are
    documents of their own.
    """
    rows, _ = minhash.apart(docs)
    named = rows.select("id", F.col("doc.text").alias("text"))
    found = minhash.near_duplicates(named, id_column="id", width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    kept = found.where(F.col("id") == F.col("component")).select("id").distinct()
    own = lookup_join(rows, cut(kept), ["id"], "left_semi").select("id", "doc")
    repeated = cut(named.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not repeated.isEmpty():
        first = lookup_join(own, repeated, ["id"], "left_semi").groupBy("id").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        own = lookup_join(own, repeated, ["id"], "left_anti").select("id", "doc").unionByName(first)
    return own.select("doc.*").union(docs.where(F.col("doc_id").isNull()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes to its target of words.

    Rows alike in doc_id, source and size share what is planned for them: if not all get as many copies, the first of them,
    by a number of their own, get the fewest.
    """
    name = F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("source").cast("string").alias("s"), F.col("size").alias("n")))
    plan = mixing.mix(docs).select(name.alias("name"), "copies").groupBy("name")
    plan = cut(plan.agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.count_if(F.col("copies") == 0).alias("none"), F.count_if(F.col("copies") < 2).alias("below")))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = sized.select("doc", name.alias("name"))
    taken = lookup_join(rows, plan.where("least = most").select("name", F.col("least").alias("copies")), ["name"])
    parted = cut(plan.where("least < most"))
    if not parted.isEmpty():
        unlike = cut(lookup_join(rows, parted, ["name"]).withColumn("row", F.monotonically_increasing_id()))
        place = numbered(unlike.select("name", "row"), ["name"], ["row"]).select("row", "place")
        copies = F.when(F.col("place") < F.col("none"), 0).when(F.col("place") < F.col("below"), 1).otherwise(F.col("most"))
        taken = taken.unionByName(unlike.join(place, "row").select("name", "doc", copies.cast("long").alias("copies")))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row per copy."""
    return queries.token_digests(docs)


STAGES = [
    ("toxicity", reached(not_toxic)),
    ("language", reached(identified)),
    ("near_duplicates", reached(deduplicated)),
    ("mixing", reached(mixed)),
    ("bpe", reached(encoded)),
]
#: The learned stages have no SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
