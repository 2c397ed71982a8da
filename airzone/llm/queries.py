"""The registered query of every operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from airzone.llm import alignment, bytepairs, chat, hyperminhash, mixing, pieces, quality, surrogates, tiles, toxicity, trie, urlfilter, warc
from airzone.llm.common import table
from airzone.llm.sql import ORACLE

MODEL = "piece_bpe_32k.model"

#: Weights of the mix; nodes not named weigh 10.
MIX = mixing.Mix(share=60, epochs=3, seed="1", weights={
    ("domain0",): 10, ("domain1",): 10, ("domain2",): 5, ("domain3",): 90,
    ("domain0", "en"): 20, ("domain0", "de"): 40, ("domain3", "fr"): 60, ("domain1", "en", "src1"): 80})

#: Dated list: entry, action, date, category.
LIST = [
    ("spam-farm.example.org", "add", date(2024, 1, 10), "spam"), ("spam-farm.example.org", "remove", date(2024, 6, 1), "spam"),
    ("spam-farm.example.org", "add", date(2024, 9, 1), "malware"), ("cheap-pills.example.com", "add", date(2024, 3, 1), "pharmacy"),
    ("adult-x.example.net", "add", date(2023, 11, 5), "adult"), ("m.adult-x.example.net", "remove", date(2024, 2, 1), "adult"),
    ("example.org/en", "add", date(2024, 5, 1), "never"), ("blog.ththan.example.net/en", "add", date(2024, 4, 1), "blog"),
    ("blog.ththan.example.net/en", "remove", date(2024, 11, 1), "blog"), ("ththan.example.net", "add", date(2024, 7, 1), "site"),
]


def domain_of(source: Column) -> Column:
    """Four domains of sources, by the number at the end of their names, of which the last two digits tell."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (F.right(number, F.lit(2)).cast("int") % 4).cast("string")))


def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chosen = mixing.mixed(docs, domain_of(docs["source"]), docs["lang"], docs["source"], MIX)
    return chosen.select("r.doc_id", "domain", "lang", "source", "n_tokens", "epoch", "taken")


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_failed", "lost_chars")


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.surrogated(table(spark, folder, "documents").select("doc_id", "text"), corpus_pipeline.KEY)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    events = spark.createDataFrame(LIST, "entry string, action string, since date, category string")
    return urlfilter.as_of(pages.select("page_id", "url", fetched.alias("fetched")), events)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))


def digested(encoded: DataFrame) -> DataFrame:
    """The packed ids and the decoded text as digests."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return digested(pieces.encoded(table(spark, folder, "documents"), public_tokenizers.path(MODEL)))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_conversations(given.unionByName(extra))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return tiles.near_vectors(table(spark, folder, "embeddings"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return trie.nodes(trie.rebuilt(turns))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(MODEL)
    return alignment.alignment(table(spark, folder, "documents"), *files, public_tokenizers.PATTERN)


def op13(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytepairs.digested(bytepairs.encoded(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1, "op2_quality_rules": op2, "op3_surrogates": op3, "op4_warc_index": op4, "op5_url_lists": op5,
            "op6_hyperminhash": op6, "op7_string_kernel": op7, "op8_sentencepiece": op8, "op9_reply_trees": op9,
            "op10_embedding_tiles": op10, "op11_prefix_trie": op11, "op12_alignment": op12, "op13_byte_pairs": op13, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
