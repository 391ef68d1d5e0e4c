"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Language identification drops what has no language; near copies leave one document a
class; repeated passages leave their first occurrence; sources are mixed to target
weights; what remains is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, language, mixing, simhash_forest, suffix_dedup
from weftgraph.llm.common import durable, prepare, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are rejected go.

    Null texts, texts without a letter and texts that every language family of the model
    turns away go; a null ``lang`` becomes the prediction.  Null ids, ties, repeated rows and
    extra columns stay; texts of any length are read whole; an empty table, or one without
    labelled texts, gives an empty one.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return language.known_languages(docs, language.fit(docs, ~held_out))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id, with all its columns.

    Repeated rows (equal id and text) are one document; null ids come after all others, and of
    equal texts without any id one row stays; null texts stay; unlike texts under one id are
    documents of their own; texts have any length; an empty table gives an empty one.
    """
    return simhash_forest.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; no row or column goes.

    Null texts stay null, a text that goes whole becomes empty; null ids come after all others,
    and rows of one id (repeats, ties) keep what they share; an empty table gives an empty one.
    """
    return suffix_dedup.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns.

    Texts that are null or without words are never taken; the null source is one of its own;
    null ids come last, repeated rows are documents of their own, ties fall by a hash of the
    row; an empty table gives an empty one.
    """
    return mixing.apply_mix(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of each document and the text decoded from them.

    The other columns, extra ones too, are left out.  Null texts count as empty and have no
    ids; null ids, ties and repeated rows stay; an empty table gives an empty one.
    """
    prepare(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mix", source_mix),
    ("bpe_round_trip", bpe_round_trip),
]
#: Language prediction and encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
