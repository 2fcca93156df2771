"""A corpus pipeline of five stages over ``documents``.

Each stage reads what the one before it wrote and works on all of it.  All but the last
return the columns of ``documents``; the last returns the token ids of every document of
the mix, with its text decoded from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codesift.llm.bpe import encode_decode
from codesift.llm.exact_dedup import drop_exact_copies
from codesift.llm.jaccard_join import keep_one_of_each_group
from codesift.llm.mixing import mix
from codesift.llm.quality import keep_good
from codesift.llm.queries import tokenizer_file
from codesift.llm.store import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text they decode to."""
    return encode_decode(docs, tokenizer_file("word_bpe_49k.json")).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe),
]

# The trained classifier cannot be written as SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}_{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
