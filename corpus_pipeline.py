"""The training-corpus pipeline: rules, classifier, near duplicates, repeated passages, packing.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the last
returns packed pieces. ``run`` writes each stage's result under the session's checkpoint folder and
reads it again, so a lost executor never recomputes an earlier stage; a result is deleted once its
successor is written.

Of all stages: an empty table gives an empty table; rows may repeat an id, and each is judged by its own
text; columns of ``documents`` beside doc_id, text, lang and n_chars may have any names and types and
pass unchanged. Nulls are described at each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillbase.llm import near_dedup, packing, quality_classifier, quality_rules, substring_dedup
from quillbase.llm.common import checkpoint_folder, remove_folder
from quillbase.sources.tables import load

#: SQL cannot express the classifier; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails; a null id or language is like any other."""
    return quality_rules.keep_documents(docs)


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's limits. A null language counts as one; a null text is dropped, a null id stays."""
    return quality_classifier.keep_documents(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies. Rows without an id stay, and so do empty texts, each by itself."""
    return near_dedup.keep_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier one has; their words joined by one space, ``n_chars`` set anew.
    Rows without an id keep their words; a null text becomes empty."""
    return substring_dedup.dedup_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids. A null text is its end id alone; a null id passes on."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", apply_rules),
    ("quality_classifier", apply_classifier),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove_folder(spark, f"{folder}/{last}")
        last = name
    return docs
