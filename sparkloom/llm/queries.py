"""The ten ``opN_<name>`` queries and the pipeline: thin layers over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, near_dedup, packing, quality_rules, suffix_dedup, tokens, toxicity, url_filter, warc
from .common import Scratch

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where one file gives fewer tasks than there are cores; larger inputs stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_dedup.near_duplicates(docs, Scratch(spark), k=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.count_tokens(docs, vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    archives = warc.write_archives(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), scratch)
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_cascade(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.drop("rejected_by")  # which of several rules came first depends on the order


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return suffix_dedup.remove_repeats(docs, Scratch(spark))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES, scratch=Scratch(spark)).select("page_id", "host", "path", "rule", "verdict")


def scored(spark: SparkSession, sf_dir: str, column: str, folds: int, test: int, score) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    train = classifier.training_rows(table(spark, sf_dir, "labels"), column, folds, test)
    held_out = (classifier.fold_of(F.col("doc_id"), folds) == test).alias("held_out")
    return score(docs, train, Scratch(spark)).select("doc_id", held_out, "score", "predicted")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "quality", 5, 0, classifier.score_quality)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "toxic", 3, 1, toxicity.score_toxicity)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_token_counts, op4_decontamination, op5_warc, op6_quality_rules, op7_suffix_dedup, op8_url_filters, op9_quality_classifier, op10_toxicity)}
