"""Registered queries of the corpus operators, over whole tables.

``QUERIES[name](spark, sf_dir)`` applies one operator with its production
parameters; ``ORACLES`` holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.llm.chat import Formatter
from rlframe.llm.shared import staged
from rlframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified leaks of benchmark items: one row per document and item."""
    from rlframe.llm.decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back from the archives."""
    from rlframe.llm.warc import read_archives, write_archives
    files, _ = write_archives(table(spark, sf_dir, "pages"))
    page = lambda c: F.substring_index(c, ":", -1).cast("long")
    return read_archives(spark, files, with_payload=False).filter("not gap").select(
        F.expr("try_cast(substring_index(record_id, ':', -1) AS bigint)").alias("page_id"), "payload_bytes",
        "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("uri").alias("url"))


def _conversation_digests(batches):
    """Stream turns in conversation order into one row per conversation."""
    f = Formatter()
    out: list[tuple] = []
    now: list | None = None

    def close():
        if now is not None:
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))

    def flush():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)],
                                          names=[x.split()[0] for x in _DIGESTS.split(", ")])

    for batch in batches:
        for conv, segments, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segments", "order_ok"))):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
            whole = "".join(s["text"] for s in segments)
            role, text = f.read_turn(whole)
            under_loss = f.unescape("".join(s["text"] for s in segments if s["loss"]))
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(under_loss)
            now[4].update(under_loss.encode())
            now[5] += len(whole)
            now[6] &= ok
        if len(out) > 5000:
            yield flush()
            out.clear()
    close()
    yield flush()


_DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
            "formatted_chars long, order_ok boolean")


@query
def op3_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, written and read back; digests per conversation."""
    from rlframe.llm.chat import format_conversations
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = staged(format_conversations(turns), "formatted")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hash over a conversation is sequential: it is streamed, never held
    return written.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_conversation_digests, _DIGESTS)


@query
def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.tokens import read_id_files, write_id_files
    files = write_id_files(table(spark, sf_dir, "documents"), vocabulary())
    return read_id_files(spark, files, with_ids=False)


def _arrived(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(t) + 16 for t in texts], pa.int64()),
             pa.array([zlib.crc32(t) for t in texts], pa.int64()), batch.column("shard"), batch.column("slot")],
            names=["doc_id", "size", "text_crc32", "shard", "slot"])


@query
def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.sharding import uniform_shards
    # whole rows are sharded; size and checksum are those of the texts that arrived
    return uniform_shards(table(spark, sf_dir, "documents"), 40).mapInArrow(
        _arrived, "doc_id long, size long, text_crc32 long, shard int, slot long").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.pii import find_private
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op8_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.quality import repetition_profile
    return repetition_profile(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links."""
    from rlframe.llm.jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rlframe.llm.lm import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 16 leading components of unit variance."""
    from rlframe.llm.whitening import whitened_vectors
    return whitened_vectors(table(spark, sf_dir, "embeddings"))


@query
def op12_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text's words, and the texts without the repeats."""
    from rlframe.llm.runs import periodic_runs, run_digests, with_planted_tail
    return run_digests(periodic_runs(with_planted_tail(table(spark, sf_dir, "documents"))))


@query
def op13_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of quality label 1, from its text alone."""
    from rlframe.llm.nbsvm import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
