"""Readers and writers (IO-1..10).

Paths may be any Hadoop filesystem URI (hdfs://, s3a://, ...); remote copy
(IO-9) is just writing to such a path. Dataset names that the reference
takes from file or folder names come from the hidden ``_metadata.file_path``
column, so one scan reads many datasets in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rlframe.operators.batch import with_global_index

QA_RECORD = StructType([
    StructField("question", StringType()), StructField("golden_answers", ArrayType(StringType())),
    StructField("answer", StringType()), StructField("context", StringType()),
])

PREDICTION = StructType([
    StructField("data_id", StringType()), StructField("question", StringType()),
    StructField("predicted_answer", StringType()), StructField("ground_truth", ArrayType(StringType())),
])


def read_json_array(spark: SparkSession, path: str, schema: StructType = QA_RECORD) -> DataFrame:
    """IO-1: files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(df: DataFrame, path: str, bucket: str, rows_per_file: int = 1000,
                      folder: str | None = None) -> None:
    """Write records as JSON-array files of at most ``rows_per_file`` rows
    (grouped by ``bucket // rows_per_file``, so no file needs a whole table),
    optionally one folder per value of ``folder``.

    With folders the rows are numbered by (folder, bucket) first: a folder's
    files are full but for the first and the last, however its ids are spread."""
    body = [c for c in df.columns if c != folder]
    if folder:
        df = with_global_index(df, [F.col(folder), F.col(bucket)], "_at")
    keys = [F.floor(F.col("_at" if folder else bucket) / rows_per_file).alias("_b")] + ([F.col(folder)] if folder else [])
    lines = df.select(*keys, F.to_json(F.struct(*[F.col(c) for c in body])).alias("_j"))
    arrays = lines.groupBy("_b", *([folder] if folder else [])).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("_j"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy(*([folder] if folder else []), "_b").text(path)


def read_parquet_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """IO-2: several parquet paths concatenated (schema merged by name)."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def with_dataset_from_path(df: DataFrame, pattern: str = r"([^/=]+)/[^/]*$", out: str = "dataset") -> DataFrame:
    """IO-3/IO-4: dataset name from the file's folder (or stem, with another
    ``pattern``)."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def write_by_dataset(df: DataFrame, path: str, dataset: str = "dataset", fmt: str = "parquet") -> None:
    """IO-3/IO-5/IO-6: one folder per dataset (or split); partition pruning
    makes per-dataset reads cheap."""
    df.write.mode("overwrite").partitionBy(dataset).format(fmt).save(path)


def read_results(spark: SparkSession, root: str, files: str = "*/res.json",
                 schema: StructType = PREDICTION) -> DataFrame:
    """IO-4: ``root/<dataset>/res.json`` (JSON arrays); folders without the
    file are simply not matched, unparseable files land in
    ``_corrupt_record`` and are skipped. The dataset is the name of the
    file's top folder under ``root`` (a ``name=`` prefix is dropped)."""
    sch = StructType(schema.fields + [StructField("_corrupt_record", StringType())])
    d = (spark.read.schema(sch).option("multiLine", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root.rstrip('/')}/{files}"))
    rel = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1)
    top = F.substring_index(rel, "/", 1)
    d = d.withColumn("dataset", F.regexp_replace(top, "^[^=]*=", ""))
    # Spark refuses a scan whose only referenced column is the corrupt-record
    # column (e.g. under count()); the always-true second term keeps a data
    # column referenced
    first = schema.fields[0].name
    keep = F.col("_corrupt_record").isNull() & (
        F.length(F.concat(F.coalesce(F.col(first).cast("string"), F.lit("")), F.lit("x"))) > 0)
    return d.where(keep).drop("_corrupt_record")


SUMMARY_COLUMNS = ["LLM", "dataset", "count", "exact_match_mean", "exact_match_sum", "substring_match_mean",
                   "substring_match_sum", "f1_mean"]


def write_summary_csv(rollup: DataFrame, path: str, model: str, with_similarity: bool) -> None:
    """IO-7: fixed column order, optional similarity column; one CSV file
    (the roll-up has one row per dataset, so a single writer is bounded)."""
    cols = SUMMARY_COLUMNS + (["semantic_similarity_mean"] if with_similarity else [])
    out = rollup.withColumn("LLM", F.lit(model)).select(*cols)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def interaction_log(turns: DataFrame, sample: str, turn: str, response: str, tool_response: str) -> DataFrame:
    """IO-10: per sample, the ordered turn blocks (think / prompt / response
    / answer) as one text. A sample's turns are bounded by the turn limit."""
    think = F.regexp_extract(F.col(response), r"(?s)<think>(.*?)</think>", 1)
    prompt = F.regexp_extract(F.col(response), r"(?s)<interaction_prompt>(.*?)</interaction_prompt>", 1)
    answer = F.regexp_extract(F.col(response), r"(?s)<answer>(.*?)</answer>", 1)
    block = F.concat_ws("\n", F.concat(F.lit("=== Turn "), (F.col(turn) + 1).cast("string"), F.lit(" ===")),
                        F.concat(F.lit("[think] "), F.trim(think)),
                        F.concat(F.lit("[prompt] "), F.trim(prompt)),
                        F.concat(F.lit("[response] "), F.coalesce(F.col(tool_response), F.lit(""))),
                        F.concat(F.lit("[answer] "), F.trim(answer)))
    g = turns.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"),
                                                                       block.alias("b")))).alias("_b"))
    return g.select(sample, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("log"))
