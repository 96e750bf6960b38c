"""Retrieval packing of token sequences with a sharded BM25 index.

Each document becomes token ids with an end id. Full windows of ``WINDOW``
ids are sequences of their own; what remains, the tail, is packed: tails are
laid out by a min-hash of their token pairs, salted, so that lexically close
tails meet in a shard of ``SHARD`` tails however many share the key. A shard
is an inverted index over the tokens of its tails. The first unused tail
seeds a window, its rarest terms query the index by BM25, and unused
neighbours fill the window in the order of their scores; the neighbour that
no longer fits is cut, its rest stays unused. An open window goes on into the
next shard. What is open at the end of a partition is cut into sequences
whose lengths are powers of two, so no padding is needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.bpe import MEMO_ENTRIES, encoder
from rlframe.llm.shared import mix64, offsets, slices, staged

WINDOW = 2048
SHARD = 4096
QUERY_TERMS = 24
K1, B = 1.2, 0.75
ROWS_PER_PARTITION = 16_384
BYTES_AT_ONCE = 4_000_000


def _tails(path: str, end_id: int, with_ids: bool, memo: int):
    def run(batches):
        enc = encoder(path, memo)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], BYTES_AT_ONCE):
                key, n, crcs, tails, heads = [], [], [], [], []
                for t in texts[lo:hi]:
                    raw = enc.encode(t or "") + last
                    cut = len(raw) - len(raw) % (4 * WINDOW)
                    tail = np.frombuffer(raw[cut:], "<u4")
                    pair = tail[:-1].astype(np.uint64) << np.uint64(32) | tail[1:] if len(tail) > 1 else tail
                    key.append(int(mix64(pair).min() >> np.uint64(1)) if len(pair) else -1)
                    n.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i:i + 4 * WINDOW]) for i in range(0, cut, 4 * WINDOW)])
                    tails.append(_narrow(tail))
                    heads.append(raw[:cut] if with_ids else b"")
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo), pa.array(key, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(heads, pa.binary())],
                    names=["doc_id", "key", "n", "crcs", "tail", "head"])
    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as uint16 behind a 2 if all fit, else as uint32 behind a 4."""
    small = not len(ids) or int(ids.max()) < 65536
    return (b"\2" + ids.astype("<u2").tobytes()) if small else (b"\4" + ids.tobytes())


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


class Index:
    """BM25 inverted index over the tails of a shard."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        size = np.array([len(t) for t in tails])
        ids = np.concatenate(tails).astype(np.int64)
        pair, tf = np.unique(ids * n + np.repeat(np.arange(n), size), return_counts=True)
        term, self.doc = pair // n, pair % n
        self.at = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
        self.terms = term[self.at[:-1]]
        df = np.diff(self.at)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1))
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n

    def neighbours(self, tail: np.ndarray) -> np.ndarray:
        """Tails that share a query term, best first (ties: by place)."""
        slot = np.searchsorted(self.terms, np.unique(tail))
        slot = slot[np.argsort(-self.idf[slot], kind="stable")[:QUERY_TERMS]]
        lo, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        where = np.repeat(lo - offsets(size)[:-1], size) + np.arange(size.sum())
        score = np.bincount(self.doc[where], self.weight[where], self.n)
        hit = np.flatnonzero(score)
        return hit[np.argsort(-score[hit], kind="stable")]


class Packer:
    """Fills windows; ``rows`` gets (document, start, ids, sequence, offset)."""

    def __init__(self, first_sequence: int):
        self.sequence, self.open, self.room, self.rows = first_sequence, [], WINDOW, []

    def close(self, pieces) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.rows.append((doc, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def put(self, doc, start: int, ids: np.ndarray) -> tuple[int, np.ndarray] | None:
        """Add a piece to the open window; returns what is left of it."""
        self.open.append((doc, start, ids[:self.room]))
        rest = (start + self.room, ids[self.room:]) if len(ids) > self.room else None
        self.room -= min(self.room, len(ids))
        if self.room == 0:
            self.close(self.open)
            self.open, self.room = [], WINDOW
        return rest

    def shard(self, docs: list, starts: list[int], tails: list[np.ndarray]) -> None:
        """Pack the tails of a shard (all of length 1 at least)."""
        index = Index(tails)
        left: list[tuple[int, np.ndarray] | None] = list(zip(starts, tails))
        for seed in range(len(docs)):
            while left[seed] is not None:
                left[seed] = self.put(docs[seed], *left[seed])
                if not self.open:
                    continue
                for j in index.neighbours(tails[seed]).tolist():
                    if left[j] is not None:
                        left[j] = self.put(docs[j], *left[j])
                        if not self.open:
                            break

    def finish(self) -> None:
        """Cut the open window into sequences of lengths that are powers of two."""
        todo, self.open = self.open[::-1], []
        length = sum(len(x[2]) for x in todo)
        for bit in range(WINDOW.bit_length(), -1, -1):
            need, pieces = length & 1 << bit, []
            while need:
                doc, start, ids = todo.pop()
                pieces.append((doc, start, ids[:need]))
                if len(ids) > need:
                    todo.append((doc, start + need, ids[need:]))
                need -= min(need, len(ids))
            if pieces:
                self.close(pieces)


def _pack(with_ids: bool):
    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 40)
        wait: list = []

        def out():
            rows, packer.rows = packer.rows, []
            raw = [r[2].tobytes() if isinstance(r[2], np.ndarray) else r[2] for r in rows]
            cols = [pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(x) // 4 if isinstance(r[2], np.ndarray) else WINDOW for r, x in zip(rows, raw)], pa.int64()),
                    pa.array([zlib.crc32(x) if isinstance(r[2], np.ndarray) else r[0][2] for r, x in zip(rows, raw)], pa.int64()),
                    pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

        def shard():
            docs, starts, tails = zip(*wait)
            packer.shard(list(docs), list(starts), list(tails))
            wait.clear()

        for batch in batches:
            d = {c: batch.column(c).to_pylist() for c in ("doc_id", "n", "crcs", "tail", "head")}
            for doc, n, crcs, tail, head in zip(d["doc_id"], d["n"], d["crcs"], d["tail"], d["head"]):
                for i, crc in enumerate(crcs):
                    packer.rows.append(((doc, n, crc), i * WINDOW, head[4 * WINDOW * i:4 * WINDOW * (i + 1)], packer.sequence, 0))
                    packer.sequence += 1
                if len(tail) > 1:
                    wait.append(((doc, n), len(crcs) * WINDOW, _wide(tail)))
                if len(wait) == SHARD:
                    shard()
                    yield out()
            if packer.rows:
                yield out()
        if wait:
            shard()
        packer.finish()
        yield out()
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = False,
         memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text, ...)``: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and the ids (little-endian
    uint32) if asked for. ``memo`` bounds what a worker remembers of pieces it has
encoded (:data:`rlframe.llm.bpe.MEMO_ENTRIES`); it changes time, not results.

    A null or empty text has its end id only. Each row is a document of its
    own, also with a null or repeated doc_id. Other columns are ignored. Any
    text length goes: full windows leave the index alone. An empty table gives
    no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    tails = staged(rows.mapInArrow(_tails(tokenizer, end_id, with_ids, memo),
                                   "doc_id long, key long, n long, crcs array<long>, tail binary, head binary"), "tails")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-tails.count() // ROWS_PER_PARTITION), 1)
    laid = tails.withColumn("salt", F.xxhash64("doc_id", "n")).repartitionByRange(parts, "key", "salt") \
        .sortWithinPartitions("key", "salt", "doc_id", "n", F.crc32("tail"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return laid.drop("key", "salt").mapInArrow(_pack(with_ids), shape + ", ids binary" * with_ids)
