"""A training corpus from documents: filter, dedup, sanitise, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each
stage's rows as Parquet in the shared folder and hands the next stage what it reads back.
All stages but the last return the columns of ``documents``.

A null, empty or very short text fails the quality rules, so it goes in the first stage;
very long ones are read whole; equal rows that share an id are one group, of which one row
stays; a null source is a source of its own; an empty table gives an empty table.  The last
stage sets ``ids``, ``n_tokens`` and ``text``: of further columns of ``documents``, only those
with the first two names are replaced.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import bpe_decode, bpe_encode
from tessella.llm.common import cut, drop_cut
from tessella.llm.minhash import drop_near_duplicates
from tessella.llm.mixing import mix_sources
from tessella.llm.pii import sanitise
from tessella.llm.quality import quality_filter

#: The vocabulary of the last stage; any byte-level BPE file of this form will do.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by labels, disclosing terms generalised or removed; ``n_chars`` follows."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights, in shuffled shards."""
    return mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``text`` is what they decode to."""
    ids = bpe_encode(docs, VOCABULARY).drop("text")
    ids = ids.withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe_decode(ids, VOCABULARY, text_col="text")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("pii", private), ("mixing", mix), ("bpe", tokenise)]

#: SQL cannot express sketches' operators, seeded draws or BPE; the tests check run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_cut(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
