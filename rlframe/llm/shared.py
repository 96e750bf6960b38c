"""Helpers of the corpus operators: the shared folder, staged tables, words.

Intermediate results are written below the folder that the cluster names in
``spark.checkpoint.dir`` and read back from there, so a lost executor costs
its running tasks only. Files that are no Spark table (archives, id files)
go to the same folder through pyarrow's file systems; a file counts only if
the table of files written by the finished Spark job lists it, so attempts
that were lost leave nothing that is read.
"""

from __future__ import annotations

import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.session import ensure_checkpoint_dir

#: ASCII white space; words are what lies between.
WHITE = b" \t\n\x0b\x0c\r"


def run_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, as a URI."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage)."""
    path = run_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a shared-folder URI."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def text_bytes(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def input_parts(spark: SparkSession, df: DataFrame, rows_per_part: int) -> int:
    """Partitions for a shuffle of ``df`` at about ``rows_per_part`` rows each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_part))


def slices(sizes, limit: int):
    """Cut a sequence into runs whose sizes sum to ``limit`` at most.

    A single item above the limit makes a run of its own."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def word_codes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Integer codes of all words, equal words alike, and the words per text."""
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    n = int(counts.sum())
    seen: dict[bytes, int] = {}
    codes = np.fromiter(map(seen.setdefault, itertools.chain.from_iterable(docs), itertools.count()),
                        np.int64, n)
    return codes, counts


def offsets(counts: np.ndarray) -> np.ndarray:
    """Start positions of consecutive runs, with the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def whole_groups(batches, keys: list[str]):
    """From rows sorted by integer ``keys``: tables of whole groups and their
    bounds. Holds one batch and the group that is still open."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change) + 1
        if len(cuts) == 0:
            rest = table
            continue
        yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])
