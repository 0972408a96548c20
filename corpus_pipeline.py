"""The corpus pipeline: documents through five training-data stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Nulls: a null text is an empty one; a document with a null id counts, for
the choice of one document of a group, as having an id larger than all others. Different
documents of one id are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, mixing, simhash_dedup, substring_dedup, toxicity
from waymark.llm.common import kept, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = tuple(c for c in COLUMNS if c != "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 0.5 or more go."""
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, field, carry=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the least id stays (of several such, and of rows
    without an id, that with the least hash). Rows are known by 96 bits of id and text; of equal
    rows one stays."""
    e, f = F.xxhash64(F.lit(5), "doc_id", "text").alias("e"), F.hash(F.lit(9), "text", "doc_id").alias("f")
    named = docs.select(*COLUMNS, e, f)
    prints = kept(simhash_dedup.fingerprints(named.select("doc_id", "text", "e", "f"), ("doc_id", "e", "f")), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "e", "f")
    stays = prints.join(simhash_dedup.label(prints), "fp").groupBy("root").agg(F.min(rank).alias("one")).select("one.e", "one.f")
    return named.join(stays, ["e", "f"], "left_semi").dropDuplicates(["e", "f"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated 200-byte strings cover go, and documents with nothing left."""
    cut = substring_dedup.remove_repeats(docs, width=200, carry=REST)
    cut = cut.filter("n_removed = 0 OR length(kept_text) > 0").withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS).filter("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weight by Poisson counts, dealt out in random order."""
    return mixing.mix(docs, carry=COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: SQL can't express the trained field or XXH64; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
