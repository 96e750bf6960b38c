"""I/O round-trip queries: write with the library's writers into the shared
scratch folder, read back with its readers, and check the content."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import prepare as P
from rlframe.plans import q_scoring as QS
from rlframe.plans import q_turns as QT
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import io as IO
from rlframe.sources.tables import table
from rlframe.streaming.jobs import work_dir


@query("io_json_arrays", """
SELECT source AS data_source, count(*) AS n,
       CAST(sum(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_gold
FROM documents GROUP BY source
""")
def io_json_arrays(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(3))
    recs = d.select("doc_id", F.col("text").alias("question"),
                    F.when(k == 0, F.array("lang", "source")).alias("golden_answers"),
                    F.when(k == 1, F.col("source")).alias("answer"), F.col("source").alias("context"))
    base = work_dir(spark, "jsonarr")
    IO.write_json_arrays(recs, base, "doc_id", rows_per_file=100)
    back = IO.read_json_array(spark, base)
    rows = P.qa_rows(back, "question", P.gold_answers("golden_answers", "answer"), "multihop", "Answer.",
                     keep=("context",))
    return rows.groupBy(F.col("context").alias("data_source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("reward_model.ground_truth")).cast("bigint").alias("n_gold"))


@query("io_dataset_dirs", """
SELECT source AS dataset, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source
""")
def io_dataset_dirs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("dataset"))
    base = work_dir(spark, "datasets")
    IO.write_by_dataset(d, base)
    back = IO.with_dataset_from_path(spark.read.parquet(base).drop("dataset"), r"dataset=([^/]+)/[^/]*$")
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("chars"))


@query("io_results_walk", """
SELECT source AS dataset, count(*) AS n, CAST(sum(CAST(lang = lang AS INTEGER)) AS BIGINT) AS n_gold FROM documents GROUP BY source
""")
def io_results_walk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    preds = d.select("doc_id", F.col("doc_id").cast("string").alias("data_id"), F.lit("q").alias("question"),
                     F.col("lang").alias("predicted_answer"), F.array("lang").alias("ground_truth"),
                     F.col("source").alias("dataset"))
    base = work_dir(spark, "results")
    IO.write_json_arrays(preds.drop("doc_id").withColumn("doc_id", F.col("data_id").cast("long")), base,
                         "doc_id", rows_per_file=100, folder="dataset")
    back = IO.read_results(spark, base, files="*/*/*.txt")
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.size("ground_truth")).cast("bigint").alias("n_gold"))


@query("io_summary_csv", QS._ROLL + f"""
SELECT 'model-x' AS LLM, dataset, cnt AS count, {R6('emm')} AS exact_match_mean, CAST(ems AS BIGINT) AS exact_match_sum,
       {R6('smm')} AS substring_match_mean, CAST(sms AS BIGINT) AS substring_match_sum, {R6('f1m')} AS f1_mean
FROM roll
""")
def io_summary_csv(spark, sf_dir):
    r = QS._rollup(spark, sf_dir)
    base = work_dir(spark, "summary")
    IO.write_summary_csv(r, base, "model-x", with_similarity=False)
    back = spark.read.option("header", True).csv(base)
    return back.select("LLM", "dataset", F.col("count").cast("bigint").alias("count"),
                       r6(F.col("exact_match_mean").cast("double")).alias("exact_match_mean"),
                       F.col("exact_match_sum").cast("bigint").alias("exact_match_sum"),
                       r6(F.col("substring_match_mean").cast("double")).alias("substring_match_mean"),
                       F.col("substring_match_sum").cast("bigint").alias("substring_match_sum"),
                       r6(F.col("f1_mean").cast("double")).alias("f1_mean"))


@query("interaction_log", QT._LT + """
, b AS (SELECT conv_id, k, '=== Turn ' || CAST(k + 1 AS VARCHAR) || ' ===' || chr(10) ||
               '[think] ' || trim(regexp_extract(response, '(?s)<think>(.*?)</think>', 1)) || chr(10) ||
               '[prompt] ' || trim(regexp_extract(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1)) || chr(10) ||
               '[response] ' || coalesce(tool_response, '') || chr(10) ||
               '[answer] ' || trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)) AS blk FROM lt)
SELECT conv_id, string_agg(blk, chr(10) || chr(10) ORDER BY k) AS log FROM b GROUP BY conv_id
""")
def interaction_log(spark, sf_dir):
    lt = QT.logged_turns(spark, sf_dir)
    return IO.interaction_log(lt, "conv_id", "k", "response", "tool_response")
