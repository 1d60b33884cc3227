"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ann, bpe, jaccard, langid, lines, lm, mixing, neardup, quality, repair, runs, topk, urls
from tallyforge.llm.common import Scratch, remainder, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2.0, Scratch(spark, "op2"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    model = quality.train(documents, labels.select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"), Scratch(spark, "op4"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = langid.train(documents.filter(~held_out), Scratch(spark, "op6"))
    return langid.identify(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), width=3, share=90)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return topk.search(embeddings, embeddings.filter("vec_id % 100 = 0"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 1
    model = lm.train(documents.filter(~held_out), Scratch(spark, "op9"))
    told = lm.score(documents, model).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.sums["tokens"]).cast("long"))
    return told.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.repeating(table(spark, sf_dir, "documents")))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(embeddings, embeddings.filter("vec_id % 50 = 0"), Scratch(spark, "op12"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "conversations"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_mix": op2_mix, "op3_quality": op3_quality, "op4_urls": op4_urls, "op5_lines": op5_lines, "op6_langid": op6_langid, "op7_jaccard": op7_jaccard, "op8_topk": op8_topk, "op9_lm": op9_lm, "op10_neardup": op10_neardup, "op11_runs": op11_runs, "op12_nearest": op12_nearest, "op13_repair": op13_repair}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.ORACLE, "op4_urls": urls.ORACLE, "op5_lines": lines.ORACLE, "op8_topk": topk.ORACLE, "op10_neardup": neardup.ORACLE, "op13_repair": repair.ORACLE}
