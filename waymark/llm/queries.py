"""The thin queries of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, language_id, merkle, mixing, order_minhash, simhash_dedup, spelling, substring_dedup, token_counts, toxicity, url_rules, vector_dedup, warc
from .common import shared_dir, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=200, keep_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language_id.learn(docs, ~language_id.held_out())
    return language_id.identify(docs, samples).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), spans=True)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/waymark-warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    warc.write(pages, path)
    return warc.digests(warc.read(spark, path), pages.schema["page_id"].dataType.simpleString())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.newlines_lost(docs["doc_id"], docs["text"]))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_toxicity, op4_poisson_mix, op5_token_counts, op6_simhash_dedup, op7_vector_dedup, op8_url_rules, op9_decontaminate, op10_warc, op11_spelling_variants, op12_merkle_manifest, op13_order_minhash)}
ORACLE = {"op4_poisson_mix": mixing.ORACLE_SQL, "op8_url_rules": url_rules.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
