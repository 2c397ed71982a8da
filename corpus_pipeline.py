"""A training corpus from raw documents: five stages, each stored as Parquet and read by the next.

``python corpus_pipeline.py FOLDER`` runs it over the documents of a folder and prints the number of rows left.
"""

from __future__ import annotations

import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from airzone.llm import hyperminhash, mixing, pieces, quality, surrogates
from airzone.llm.common import leading_words, picked
from airzone.sources.tables import new_path, stage

#: Key of the surrogates: whoever holds it can tell which surrogate an entity got.
KEY = "corpus surrogates 1"
MODEL = "piece_bpe_32k.model"
#: Near duplicates share 80 of 100 five-word shingles; one pair in 2*10**7 at that similarity shares none of the 32 bands.
NEAR = hyperminhash.Sketch(width=5, numerator=80, denominator=100, rows=4)
MIX = mixing.Mix(share=80, epochs=2, seed="pipeline", weights={("web", "en"): 20, ("web", "fr"): 15, ("print",): 15})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars counts what is left."""
    named = docs.columns
    judged = quality.judged(docs.select(F.struct("*").alias("r"), "text"), id_col="r").where("kept")
    kept = judged.select("doc_id.*", F.col("cleaned").alias("cleaned_text"))
    return _with_text(kept.withColumn("text", F.col("cleaned_text")), named)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates.

    Rows are judged by their text: rows that share an id and a text are one document, rows that share an id only are
    two. The smallest id of a group stays, but a document whose id is shared goes before others. Null ids all stay.
    """
    shared = stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "shared-ids")
    told = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2 ** 63 - 1))
    keyed = picked(docs, shared, "doc_id", "left").withColumn("key", F.when(F.col("again"), -told).otherwise(F.col("doc_id")))
    found = stage(hyperminhash.near_duplicates(keyed, id_col="key", sketch=NEAR), "groups")
    staying = picked(keyed, found.where("NOT kept").select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    once = staying.where("again").dropDuplicates(["key"])
    return staying.where("again IS NULL").unionByName(once).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _with_text(surrogates.surrogated(docs, KEY, count_col="n_entities_found"), docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a leaf is cut to the words that fit its budget."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    domain = F.when(number != "", F.when(F.right(number, F.lit(1)).cast("int") % 2 == 0, "web").otherwise("print"))
    chosen = mixing.mixed(docs, domain, docs["lang"], docs["source"], MIX)
    cut = F.col("taken") < F.col("n_tokens")
    text = F.when(cut, leading_words(F.col("r.text"), F.col("taken"))).otherwise(F.col("r.text"))
    fitted = chosen.withColumn("r", F.col("r").withField("text", text))
    if "n_chars" in docs.columns:
        fitted = fitted.withColumn("r", F.when(cut, F.col("r").withField("n_chars", F.length("r.text").cast("long"))).otherwise(F.col("r")))
    return fitted.select("r.*")


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids, spans and decoded text."""
    found = pieces.encoded(docs, public_tokenizers.path(MODEL))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    counted = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return counted.select(*columns)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data),
          ("mixing", mixing_sources), ("sentence pieces", sentence_pieces)]

#: SQL cannot express the line rules, the surrogates or the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = new_path(spark, f"corpus-{name.replace(' ', '-')}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate(), sys.argv[1]).count())
