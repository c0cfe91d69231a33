"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.

1. language: rows whose text no learnt language explains, or without a letter, go;
   a missing `lang` is filled with the prediction.
2. near-duplicates: of each SimHash component the row of the least id stays
   (words in shingles of four, at most four of 64 bits apart: the numbers of the
   operator's contract). Where an id occurs several times in a component, one row
   with it stays.
3. repeated passages: byte strings of 200 that occur at several places are cut
   out, with `n_chars` brought up to date; rows left without a word go.
4. contamination: rows that share a window of ten words with a benchmark item go.
5. mixing: rows are repeated towards target weights of sources, in shuffled order;
   a column `copy` numbers the repetitions.

Null ids: such rows pass stages 1, 3 and 4 by their text; in stage 2 a component
keeps a row without an id only if it has none with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm import decontamination, language_id, mixing, simhash, suffix_dedup
from findwell.llm._arrow import bounded_batches
from findwell.session import saved


def _key():
    """Of a row: its id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with all columns of the row as its id, so that nothing is joined back."""
    return docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc_id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.KneserNey(language_id.sample_by_language(docs.select("doc_id", "text", "lang"), F.lit(True)))
    bounded_batches(spark)
    found = language_id.identify_with(_whole(docs), model).where("not rejected")
    lang = F.coalesce("doc_id.lang", "lang_pred").alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"doc_id.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    keyed = docs.withColumn("row_key", _key())
    # ids with several texts are told apart by the row's key
    found = simhash.near_duplicates(keyed.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("doc_id"), "text"))
    kept = found.where("doc_id = component_id").select(F.col("doc_id.row_key").alias("row_key")).distinct()
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(_whole(docs), benchmark).where("not contaminated")
    return found.select(*(F.col(f"doc_id.`{c}`") for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.rates(docs))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", contamination),
    ("source_mixing", source_mix),
]

#: SimHash components and suffix sorting have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
