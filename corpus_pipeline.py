"""From raw documents to packed sequences in five stages, each a table between two jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import classifier, decontam, near_dedup, packing, suffix_dedup
from sparkloom.llm.common import Scratch
from sparkloom.llm.queries import table, vocabulary

#: Passages of so many words are removed where they repeat, and those of so many bytes whatever their words.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 240
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    train = classifier.training_rows(table(spark, sf_dir, "labels"), "quality", 5, 0)
    return classifier.keep_good(docs.select(*COLUMNS), train, Scratch(spark))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column key: doc_id, or, where that is null, a hash of the text above all usual ids."""
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), own).alias("key"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Of repeated rows one stays. Rows without an id are judged like others; they come after all ids.
    """
    docs = keyed(docs)
    kept = near_dedup.near_duplicates(docs, Scratch(spark), id_col="key").where("kept").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(kept.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS or PASSAGE_BYTES or more that stand elsewhere too go; characters cut in two go with them."""
    docs = keyed(docs)
    cut = suffix_dedup.remove_repeats(docs, Scratch(spark), PASSAGE_BYTES, id_col="key", with_text=True, words=PASSAGE_WORDS).where("n_removed > 0")
    kept = cut.select(F.col("doc_id").alias("key"), F.coalesce("kept", F.lit(b"")).alias("kept")).dropDuplicates(["key"])
    return trimmed(docs.join(kept.hint("merge"), "key", "left"))


def trimmed(df: DataFrame) -> DataFrame:
    """Puts the characters in ``kept``, where there are any, in the place of text."""
    text = F.coalesce(F.make_valid_utf8(F.col("kept").cast("string")), F.col("text"))
    return df.withColumn("text", text).withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: A classifier, a tokenizer and connected components can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each reads the table that the one before it wrote."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
