"""Documents from raw to packed sequences: each stage works on all that the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Null
and empty texts go at language ID, as they have no letters; a text that line dedup leaves empty stays as an empty
document; repeated rows fall together at SimHash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstream.llm import language_id, line_dedup, mixing, packing, simhash
from rillstream.llm.common import staged, table


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letters or is in no language that the labelled documents have."""
    return language_id.recognised(docs, language_id.fit(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that stand on too many documents of their source; n_chars follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, site_col="source")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of fingerprints up to two bits apart, or of texts that share four fifths of
    their five-word shingles."""
    return simhash.representatives(docs, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", recognise_language),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenising is not for SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
