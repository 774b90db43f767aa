"""The training-data pipeline: stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import op2_suffix_dedup, op6_simhash, op8_pii, op9_quality, op10_packing
from lodestone.llm.common import discard, prepare, read_table, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def named(docs: DataFrame) -> DataFrame:
    """docs with a 64-bit name of each row's id and text: rows equal in both share it, and share each stage's decision."""
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64(F.struct(F.col("doc_id").isNull(), "doc_id"), F.col("text").isNull(), "text"))


def with_text(docs: DataFrame, text: DataFrame) -> DataFrame:
    """docs, named, with the text (row, text) in place of its own, n_chars counted again."""
    return docs.drop("text", "n_chars").join(text.select("row", "text").dropDuplicates(["row"]), "row").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling accepts; the target model is fitted on `labels`."""
    docs = named(docs)
    kept = op9_quality.classify(docs, read_table(spark, sf_dir, "labels"), keep=["row"]).where("accepted").select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of 0.8 or more in five-word shingles: that with the smallest id, null ids last."""
    docs = named(docs)
    return docs.join(op6_simhash.kept(docs), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated 200-byte strings go; a character that loses some of its bytes goes whole. Documents of which nothing is left go."""
    docs = named(docs)
    kept = op2_suffix_dedup.cut_texts(docs.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    return with_text(docs, kept.where("length(text) > 0 or n_removed = 0"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]. The text travels in one pass; other columns are carried along."""
    model = op8_pii.fit(spark)
    found = op8_pii.redacted(op8_pii.detect(docs, model, keep=["lang", "source"]), keep=["lang", "source"])
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return op10_packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("pii", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's rows are stored for the next one, and go when that one's are."""
    prepare(spark)
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, last)
        release(spark)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
