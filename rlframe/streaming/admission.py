"""Filling training steps from a stream of generation batches (BS-17).

Each micro-batch of the stream is one generation batch. Its prompt groups are
filtered (varying metric, or one sample); kept groups are admitted, in order,
until a step has ``prompts`` of them, and the rest of that batch is dropped.
The next batch opens the next step.

What a step has so far lives in a ledger in the shared folder: one folder of
admitted rows and one of a single summary row per micro-batch, both named by the
batch's number. A batch reads only summaries of smaller numbers, overwrites
folders of its own number, and writes its summary last. So a batch that is
replayed after a lost driver, whether it had written nothing, rows only, or all,
leaves what one run leaves, and rows without a summary do not count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.operators.batch import dynamic_group_filter

SUMMARY = "batch_no long, step long, taken long, filled long, batches long, full boolean"


@dataclass
class Ledger:
    """Admission of groups into steps of ``prompts``, kept under ``folder``.

    ``max_batches`` bounds the batches one step may take (None: no bound): a step
    that is still open after so many fails the query, as its data are too easy or
    too hard for the filter."""

    spark: SparkSession
    folder: str
    prompts: int
    group: str
    metric: str
    max_batches: int | None = None

    def _path(self, kind: str, batch: int | str = "") -> str:
        return f"{self.folder}/{kind}/batch={batch}" if batch != "" else f"{self.folder}/{kind}"

    def _written(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def summaries(self) -> DataFrame:
        """One row per finished batch."""
        if not self._written("summary"):
            return self.spark.createDataFrame([], SUMMARY)
        return self.spark.read.schema(SUMMARY).parquet(self._path("summary"))

    def _state(self, batch: int) -> tuple[int, int, int]:
        """(step, groups it has, batches it took) before ``batch``."""
        last = self.summaries().where(F.col("batch_no") < batch).orderBy(F.desc("batch_no")).limit(1).collect()
        if not last:
            return 0, 0, 0
        s = last[0]
        return (s.step + 1, 0, 0) if s.full else (s.step, s.filled, s.batches)

    def admit(self, rows: DataFrame, batch: int) -> None:
        """Process one batch; safe to call again for the same batch."""
        step, filled, batches = self._state(batch)
        kept = dynamic_group_filter(rows, self.group, self.metric, self.prompts - filled)
        kept.withColumn("step", F.lit(step).cast("long")).withColumn("batch_no", F.lit(batch).cast("long")) \
            .write.mode("overwrite").parquet(self._path("rows", batch))
        taken = self.spark.read.parquet(self._path("rows", batch)).select(self.group).distinct().count()
        full = filled + taken >= self.prompts
        if not full and self.max_batches is not None and batches + 1 >= self.max_batches:
            raise ValueError(f"step {step} has {filled + taken} of {self.prompts} prompts after {batches + 1} batches")
        self.commit((batch, step, taken, filled + taken, batches + 1, full))

    def commit(self, summary: tuple) -> None:
        self.spark.createDataFrame([summary], SUMMARY).coalesce(1).write.mode("overwrite").parquet(self._path("summary", summary[0]))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Admit everything that is available, going on from the checkpoint."""
        each: Callable[[DataFrame, int], None] = lambda rows, batch: self.admit(rows, batch)
        q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    def admitted(self, schema: str) -> DataFrame:
        """Rows of all finished batches, with ``step`` and whether it is ``full``.

        ``schema`` is that of the stream's rows. Empty while nothing is finished."""
        done = self.summaries()
        steps = done.groupBy("step").agg(F.max("full").alias("full"))
        shape = f"{schema}, step long, batch_no long"
        rows = self.spark.read.schema(shape).parquet(self._path("rows")) if self._written("rows") else self.spark.createDataFrame([], shape)
        return rows.select(*[c for c in rows.columns if c != "batch"]).join(done.select("batch_no"), "batch_no", "left_semi").join(steps, "step")
