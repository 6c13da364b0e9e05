"""Training-corpus pipeline over ``documents``: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from cairnspark.llm.common import shared_folder, table

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some learned language, with all their columns; null, empty and letterless texts go.

    Very long texts are parsed whole; repeated rows and null ids stay as they are; languages that tie don't matter here.
    """
    return language_id.keep_known(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id; rows with a null id go if another row has their text."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, that of the least id, by the join's own shingles and limit.

    Wordless texts and rows with a null id link with nothing and stay; of an id on several texts each is judged alone.
    """
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item; null texts and an empty benchmark drop nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language ID, decontamination and token ids can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each but the last returns is written as Parquet to the shared folder and read again.

    A stage's input goes once its output is written; the last stage is lazy, so its input stays.
    """
    docs, place, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, before)
        before = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
