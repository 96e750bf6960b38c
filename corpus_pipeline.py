"""A training-data pipeline over ``documents``, from quality rules to packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet in the shared folder and read again as the next one's docs.

A null or empty text has no words and is rejected by the first stage; rows with
a null or repeated doc_id are judged as rows; columns beside ``text`` pass through
untouched, whatever their names; an empty table gives an empty result. Python
workers live on from stage to stage, so each stage bounds what it holds: Arrow
batches of ``BATCH_ROWS`` rows, ``MEMO`` remembered token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.llm.decontam import contaminated
from rlframe.llm.jaccard import near_duplicates
from rlframe.llm.packing import pack
from rlframe.llm.pii import mask_private
from rlframe.llm.quality import repetition_profile
from rlframe.llm.queries import vocabulary
from rlframe.llm.shared import run_folder, staged
from rlframe.sources.tables import table

BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20
MEMO = 100_000


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in small Arrow batches from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; of equal rows all or none."""
    small_batches(spark)
    return repetition_profile(docs.withColumn("_judged", F.col("text")), "_judged") \
        .filter("kept").select(*docs.columns)


def numbered(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` with the row's id ``_row``, written so that retries see the same."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), tag)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies.

    Rows are compared as such: equal doc_ids need not be copies, and a row
    without doc_id counts as the last of its group."""
    small_batches(spark)
    rows = numbered(docs, "rows-to-join")
    classes = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")) \
        .select(F.col("doc_id").alias("_row"), "class_id")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")
    firsts = rows.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(F.min(rank).alias("first"))
    return rows.join(firsts.select("first._row"), "_row", "left_semi").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    small_batches(spark)
    rows = numbered(docs, "rows-to-search")
    leaks = contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")) \
        .select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaks, "_row", "left_anti").select(*docs.columns)


def masked_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Where nothing is
    found the row stays as it is; ``n_chars`` follows the text, null for null."""
    small_batches(spark)
    clean = mask_private(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their token ids, in sequences of 2048."""
    small_batches(spark)
    return pack(docs, vocabulary(), with_ids=True, memo=MEMO)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("PII", masked_pii),
    ("packing", packed),
]

#: SQL expresses neither suffix arrays nor the field nor BM25 windows; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
