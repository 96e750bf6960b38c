"""Token ids in canonical length-limited Huffman files.

Texts are laid out by ascending doc_id and encoded once; ids are counted over
all of them. The code lengths (package-merge, at most ``MAX_BITS``) define
the canonical code. A file holds the lengths and independent blocks: a table
of documents, the bit offset of every ``CHECKPOINT``-th id, the bits. The
decoder runs over all checkpoints of a block side by side with one table
lookup per id.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.llm.bpe import encoder
from rlframe.llm.shared import file_system, offsets, run_folder, slices, staged

MAX_BITS = 18
CHECKPOINT = 256
BLOCK_IDS = 1_000_000
BYTES_AT_ONCE = 4_000_000
MAGIC = b"HUFIDS1\n"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge);
    0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))  # which of the sorted items are leaves
        both = both[by]
        packages = both[:len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        step = np.left_shift(1, top - size)
        codes[order] = (offsets(step)[:-1] >> (top - size)).astype(np.uint64)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed bits and the bit offset of every checkpoint."""
    size = lengths[ids].astype(np.int64)
    at = offsets(size)
    start = at[:-1]
    value = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    word = start >> 5
    out = np.zeros(int(at[-1] >> 5) + 2, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        out[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), first)
    return out.astype(">u4").tobytes(), start[::CHECKPOINT].copy()


class Decoder:
    """Table-driven decoder of one canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.int64)
        self.symbol[:span.sum()] = np.repeat(order, span)
        self.length[:span.sum()] = np.repeat(lengths[order].astype(np.int64), span)

    def decode(self, raw: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        b = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), CHECKPOINT), np.uint32)
        mask = np.uint32((1 << self.bits) - 1)
        last = n - (len(at) - 1) * CHECKPOINT  # ids behind the last checkpoint
        for i in range(min(CHECKPOINT, n)):
            live = slice(0, len(at) if i < last else len(at) - 1)
            p = at[live]
            key = window[p >> 3] >> (32 - self.bits - (p & 7)).astype(np.uint32) & mask
            out[live, i] = self.symbol[key]
            at[live] += self.length[key]
        return out.reshape(-1)[:n]


def write_block(stream, doc_ids: list, ids: list[bytes], lengths: np.ndarray, codes: np.ndarray) -> None:
    counts = np.array([len(x) // 4 for x in ids], "<i8")
    flat = np.frombuffer(b"".join(ids), "<u4")
    bits, checks = encode_bits(flat, lengths, codes)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    stream.write(struct.pack("<IQIQ", len(doc_ids), len(flat), len(checks), len(bits)))
    for part in (docs.tobytes(), null.tobytes(), counts.tobytes(), checks.astype("<i8").tobytes(), bits):
        stream.write(part)


def read_blocks(stream):
    """(doc_ids, ids per document) of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not an id file")
    vocabulary, = struct.unpack("<I", stream.read(4))
    decoder = Decoder(np.frombuffer(stream.read(vocabulary), np.uint8))
    while head := stream.read(24):
        docs, n, checks, size = struct.unpack("<IQIQ", head)
        doc = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
        null = np.frombuffer(stream.read(docs), np.uint8)
        at = offsets(np.frombuffer(stream.read(8 * docs), "<i8"))
        check = np.frombuffer(stream.read(8 * checks), "<i8")
        ids = decoder.decode(stream.read(size), check, n)
        yield [None if z else d for d, z in zip(doc, null)], [ids[a:b] for a, b in zip(at[:-1], at[1:])]


_RAW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _tokenise(folder: str, path: str, end_id: int):
    """Encode a partition into a raw file; rows: the file (id -1, its number
    of ids) and the count of each id."""
    def run(batches):
        enc = encoder(path)
        last = np.array([end_id], "<u4").tobytes()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.arrow"
        counts, docs = np.zeros(0, np.int64), 0
        with fs.open_output_stream(name, compression=None) as sink, \
                pa.ipc.new_stream(sink, _RAW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                doc, texts = batch.column(0), batch.column(1).to_pylist()
                for lo, hi in slices([len(t or "") for t in texts], BYTES_AT_ONCE):
                    raw = [enc.encode(t or "") + last for t in texts[lo:hi]]
                    flat = np.frombuffer(b"".join(raw), "<u4")
                    if len(flat) and int(flat.max()) >= len(counts):
                        counts = np.concatenate([counts, np.zeros(int(flat.max()) + 1 - len(counts), np.int64)])
                    counts += np.bincount(flat, minlength=len(counts))
                    small = [(b"\2" + np.frombuffer(x, "<u4").astype("<u2").tobytes()) if len(counts) <= 65536 else b"\4" + x for x in raw]
                    writer.write_batch(pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(small, pa.binary())], schema=_RAW))
                    docs += hi - lo
        some = np.flatnonzero(counts)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] + [None] * len(some), pa.string()), pa.array([at] * (len(some) + 1), pa.int64()),
             pa.array([-1, *some.tolist()], pa.int64()), pa.array([int(counts.sum()), *counts[some].tolist()], pa.int64())],
            names=["path", "part", "id", "n"])
    return run


def _raw_batches(path: str):
    fs, name = file_system(path)
    with fs.open_input_stream(name, compression=None) as source, pa.ipc.open_stream(source) as reader:
        for batch in reader:
            ids = [np.frombuffer(x, f"<u{x[0]}", offset=1).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield batch.column(0).to_pylist(), ids


def _encode(folder: str, lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path, part, n in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "n"))):
                name = f"{base}/{part:08d}-{uuid.uuid4().hex}.hufids"
                with fs.open_output_stream(name, compression=None) as sink:
                    sink.write(MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes())
                    docs: list = []
                    ids: list[bytes] = []
                    held = 0
                    for d, x in _raw_batches(path):
                        for one, raw in zip(d, x):
                            if docs and held + len(raw) > 4 * BLOCK_IDS:
                                write_block(sink, docs, ids, lengths, codes)
                                docs, ids, held = [], [], 0
                            docs.append(one)
                            ids.append(raw)
                            held += len(raw)
                    if docs:
                        write_block(sink, docs, ids, lengths, codes)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([n], pa.int64())],
                                                 names=["path", "part", "n"])
    return run


def write_id_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all rows of ``docs(doc_id, text, ...)`` by ascending
    doc_id; returns the table of files (path, part, n): ``part`` orders them.

    A null or empty text has its end id only. A null doc_id comes first, rows
    of equal doc_id follow their texts' checksums, repeated rows are written
    each. Other columns are ignored; an empty table gives files without
    blocks. Files of attempts that were lost are in no table."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    laid = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit(""))))
    raw = staged(laid.mapInArrow(_tokenise(run_folder(spark, "raw-ids"), tokenizer, end_id),
                                 "path string, part long, id long, n long"), "raw-files")
    total = raw.filter("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    counts = np.zeros(max((r.id for r in total), default=-1) + 1, np.int64)
    for r in total:
        counts[r.id] = r.n
    files = raw.filter("id = -1").select("path", "part", "n").repartition(n, "part")
    return staged(files.mapInArrow(_encode(run_folder(spark, "id-files"), code_lengths(counts)),
                                   "path string, part long, n long"), "files")


def read_id_files(spark: SparkSession, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids (little-endian uint32), read from the files."""
    before, base = 0, {}
    for r in files.select("part", "n").orderBy("part").collect():  # one row per file
        base[r.part] = before
        before += r.n

    def run(batches):
        for batch in batches:
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist()):
                fs, name = file_system(path)
                start = base[part]
                with fs.open_input_stream(name, compression=None) as source:
                    for doc, ids in read_blocks(source):
                        size = [len(x) for x in ids]
                        raw = [x.astype("<u4").tobytes() for x in ids]
                        cols = [pa.array(doc, pa.int64()), pa.array(start + offsets(np.array(size))[:-1]),
                                pa.array(size, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                        start += sum(size)
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids,
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "part").mapInArrow(run, shape)
