"""The corpus pipeline: each stage's function takes (spark, docs, sf_dir) and returns the next stage's documents.

All stages but the last return the columns of ``documents``: doc_id, text, lang, source, n_chars. Nulls, empty texts, repeated rows
and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, jaccard, lines, mixing, quality, registry
from tallyforge.llm.common import Scratch, remainder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7). It learns from the labelled rows among them."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, model).filter("score >= 0.7").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more share; the largest doc_id keeps them. n_chars follows the text."""
    done = lines.dedup_lines(docs, Scratch(spark, "lines"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group that similarity of 0.8 on five-word shingles links."""
    linked = jaccard.link(docs, Scratch(spark, "near"), width=5, share=80)
    gone = linked.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: sources weigh 3, 1, 2 in turn and share 150 % of all words, none above twice its own; rows repeat as taken."""
    return mixing.mix(docs, [3, 1, 2], 1.5, 2.0, Scratch(spark, "mix")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding them gives the text back."""
    path = registry.vocabulary()
    coded = bpe.round_trip(docs, path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.write(docs, f"stage-{number}")
            if number > 1:
                scratch.drop(f"stage-{number - 1}")
    return docs
