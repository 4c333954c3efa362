"""The query of each operator over its whole table, and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstream.llm import ann, embedding_dedup, html_extract, language_id, line_dedup, mixing, packing, simhash, token_counts, toxicity
from rillstream.llm.common import table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def crc(col: str, mod: int):
    return F.crc32(F.col(col).cast("string")) % mod


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc("doc_id", 5) == 0, F.lit(False))
    filters = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs, filters)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, site_col="source", count_col="lines_dropped").select("doc_id", "text", "lines_dropped")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc("doc_id", 4) == 2, F.lit(False))
    learned = docs.select("doc_id", "text", "lang").where(~held_out)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(learned, labels, language_id.fit(learned, sample=float("inf")))
    found = toxicity.score(docs, model)
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_mix": op4_mix,
    "op5_ann": op5_ann,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op4_mix": mixing.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL}
