"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near copies stays, sources
are mixed to their weights along the curriculum, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, to which
mixing adds ``copy`` and ``position``, the place in training; encoding keeps them. An empty table passes through every stage; null texts are clean, have no lines to lose, link with nothing and take no words
of a mix beyond their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfields.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from trackfields.llm.common import free, saved, table
from trackfields.llm.queries import BPE_RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free(docs, "toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(f"{name}.score") < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)  # five words, 0.8


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(docs, BPE_RANKS)
    return rows.select("doc_id", "lang", "source", *[c for c in ("copy", "position") if c in docs.columns], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL cannot express the toxicity, mixing and encoding stages; tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
