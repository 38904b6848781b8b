"""The documents table to token ids, in five stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.bpe import bpe_encode
from fleetpulse.llm.common import scratch_dir
from fleetpulse.llm.exact_dedup import drop_exact_copies
from fleetpulse.llm.jaccard_join import drop_near_copies
from fleetpulse.llm.language_id import UNKNOWN, LanguageProfiles
from fleetpulse.llm.source_mix import in_mixed_order

VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from the labelled documents; documents of no known language (null, or without a letter) go."""
    added = {"lang_pred", "score"}
    judged = LanguageProfiles.fit(docs).predict(docs.select(*[c for c in docs.columns if c not in added]), keep_text=True)
    return judged.filter(judged.lang_pred != UNKNOWN).drop(*added)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 on five-word n-grams the row with the least doc_id stays."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order in which the sources' blocks are due; targets follow the root of a source's bytes."""
    return in_mixed_order(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, token ids and the position in the mix: reading by it gives the order of the stage before.

    A position is made of the numbers of the file (part and count) and of the row in it, as files are not read in the order of their parts.
    """
    number = [F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*?(?:-c(\d+))?(?:\.|$)", k) for k in (1, 2)]
    part, count = number[0].cast("bigint"), F.coalesce(F.nullif(number[1], F.lit("")).cast("bigint"), F.lit(0))
    position = F.shiftleft(part * 1000 + count, 33) + F.col("_metadata.row_index")
    done = bpe_encode(docs.select("doc_id", "lang", "source", "text", position.alias("position")), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids_text", "position")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe", bpe)]

#: The first stage is learned and the last encodes by a vocabulary file; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
