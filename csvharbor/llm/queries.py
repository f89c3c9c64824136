"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.llm import bpe, embeddings, html, langid, merkle, minhash, mixing, negatives, pseudolikelihood, quality, secrets, toxicity, warc
from csvharbor.llm.registry import query, table
from csvharbor.session import scratch


def token_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of tokens and digests of its ids and of the bytes they decode to."""
    return bpe.round_trips(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query(minhash.COMPONENTS_SQL)
def op4_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(remainder(5) != 0))


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", langid.predict(F.col("text"), language_model(docs)).alias("found"))
    return found.select(
        "doc_id",
        F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.ambiguous").alias("ambiguous"),
    )


TOXIC_FROM = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(remainder(4) != 2))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", toxicity.tag(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        F.col("found.score").alias("score"),
        (F.col("found.score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.col("found.spans").alias("spans"),
    )


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query(quality.JUDGE_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query(embeddings.COMPONENTS_SQL)
def op8_embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


@query(warc.RECORDS_SQL)
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    read = warc.read_archives(archives, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query()
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html.extract(F.col("html"), html.train(pages)).alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = pseudolikelihood.counted(docs)
    found = pseudolikelihood.likelihoods(docs.select("doc_id", "text"), pseudolikelihood.train(docs, counts=counts), counts)
    return found.select("doc_id", F.col("words").alias("n_words"), "log_likelihood", F.when(F.col("words") > 0, F.col("log_likelihood") / F.col("words")).alias("per_word"))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query(merkle.MANIFEST_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = {c: F.col(c) for c in MANIFEST_FIELDS}
    more = F.when(remainder(7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    manifest = merkle.build(docs, "doc_id", "lang", merkle.leaf_digest([*own.values()]), merkle.leaf_digest([*(own | {"n_chars": more}).values()]))
    return merkle.prove(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query(secrets.SCAN_SQL)
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.Ledger(spark, scratch(spark, "secrets")).scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    kinds = [r.kind for r in secrets.BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secrets.shown(of(*kinds)), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"),
    )


def whole_numbers(vector: str, times: float) -> Column:
    """Components times a number, rounded down; those too large to have a fraction stay."""

    def rounded(x: Column) -> Column:
        scaled = x.cast("double") * times
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, rounded)


@query(negatives.NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers("embedding", 256.0).alias("embedding"), label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
