"""Near-duplicate join of documents: Jaccard of word 5-grams, chosen paths.

Each document is a set of hashed word 5-grams (lower-case A-Z; fewer than
five words make one gram). Equal sets form a class, compared once. A run of
the chosen-path join splits the classes on sampled shared grams: a node of
the tree samples 1/similarity coordinates of the min-hash embedding, and
classes whose sampled gram agrees go to one child. Children of few classes
are leaves and compared by brute force; larger ones are split again, to a
bounded depth, and what is still large there is compared in pairs of blocks,
so no bucket is capped. As many independent runs are made as the target
recall asks for at that depth.

A pair that meets in several leaves is compared in the first common one, so
links are counted without a table of pairs. Comparison is exact (64-bit gram
hashes): no false link.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import mix64, offsets, slices, staged, text_bytes, whole_groups

GRAM = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
MAX_DEPTH = 4
LEAF = 100
BLOCK = 400
HASHES = 64
#: A pair at the similarity agrees in 51 of 64 coordinates on average; below 32 has odds under 1e-7.
MIN_AGREE = 32
BYTES_AT_ONCE = 1_000_000

_MUL = mix64(np.arange(1, HASHES + 1)) | np.uint64(1)


def runs_for(recall: float = TARGET_RECALL, depth: int = MAX_DEPTH, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the similarity is in a common leaf with the
    target probability, though each run goes to the full depth."""
    extra = 1 / similarity - 1
    lost = 0.0
    for _ in range(depth):
        lost = (1 - similarity * (1 - lost)) * (1 - extra * similarity * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    docs = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    n = int(counts.sum())
    if n == 0:
        return [np.zeros(0, np.uint64)] * len(docs)
    seen: dict[bytes, int] = {}
    codes = np.fromiter(map(seen.setdefault, itertools.chain.from_iterable(docs), itertools.count()), np.int64, n)
    by_code = np.zeros(n, np.uint64)
    by_code[np.fromiter(seen.values(), np.int64, len(seen))] = np.fromiter(
        map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    word = by_code[codes]
    roll = np.zeros(n, np.uint64)
    for j in range(min(GRAM, n)):
        roll[:n - j] = roll[:n - j] * np.uint64(0x9E3779B97F4A7C15) + word[j:]
    roll = mix64(roll)
    at = offsets(counts)
    out = []
    for i, c in enumerate(counts.tolist()):
        if c >= GRAM:
            out.append(np.unique(roll[at[i]:at[i] + c - GRAM + 1]))
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(docs[i]), seed=c)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash values (uint32, one row per non-empty set)."""
    flat = np.concatenate(sets)
    at = offsets(np.array([len(s) for s in sets]))[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for t in range(HASHES):
        out[:, t] = np.minimum.reduceat((flat * _MUL[t]) >> np.uint64(32), at)
    return out


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _profiles(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in slices([len(t) for t in texts], BYTES_AT_ONCE):
            sets = gram_sets(texts[lo:hi])
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, embed([sets[i] for i in full])):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo), pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "cls", "n", "sig"])


def _children(sig: np.ndarray, node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and child nodes at the coordinates that each node samples:
    one always, another with probability 1/similarity - 1."""
    seed = mix64(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
    rows = np.arange(len(node))
    members, nodes = [], []
    for which in range(2):
        pick = mix64(seed + np.uint64(which + 1))
        go = rows if which == 0 else rows[(seed >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < 1 / SIMILARITY - 1]
        coord = (pick[go] % np.uint64(HASHES)).astype(np.int64)
        value = sig[go, coord].astype(np.uint64)
        members.append(go)
        nodes.append(mix64(mix64(pick[go]) ^ (value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(which))))
    return np.concatenate(members), np.concatenate(nodes)


def _split(level: int, runs: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, HASHES)
            if level == 1:
                row = np.tile(np.arange(n), runs)
                node = np.repeat(mix64(np.arange(1000, 1000 + runs)), n)
                sig = sig[row]
            else:
                row = np.arange(n)
                node = batch.column("path").to_numpy().view(np.uint64)
            member, child = _children(sig, node, level)
            cls = batch.column("cls").take(pa.array(row[member]))
            yield pa.RecordBatch.from_arrays([cls, pa.array(child.view(np.int64))], names=["cls", "path"])
    return run


def _pairs_here(path: int, leaves: list[bytes], side: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Upper-triangle mask of the pairs to compare in this bucket."""
    m = len(leaves)
    ok = np.triu(np.ones((m, m), bool), 1)
    if side.min() != side.max():
        ok &= side[:, None] != side[None, :]
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    ok &= low >= SIMILARITY * high - 1e-9
    own = [np.frombuffer(x, np.int64) for x in leaves]
    own = [x[x < path] for x in own]
    flat = np.concatenate(own)
    if len(flat):
        _, local = np.unique(flat, return_inverse=True)
        has = np.zeros((m, local.max() + 1), np.float32)
        has[np.repeat(np.arange(m), [len(x) for x in own]), local] = 1
        ok &= has @ has.T == 0
    if ok.any():
        agree = np.zeros((m, m), np.int16)
        for t in range(sig.shape[1]):
            agree += sig[:, None, t] == sig[None, :, t]
        ok &= agree >= MIN_AGREE
    return ok


def _bucket(table: pa.Table):
    cols = {k: table.column(k) for k in ("path", "lo", "hi", "side", "n")}
    cols = {k: v.to_numpy() for k, v in cols.items()}
    cols["leaves"], cols["sig8"] = table.column("leaves").to_pylist(), table.column("sig8").to_pylist()
    return cols


def _needed(batches):
    """(bucket, class) rows that at least one comparison needs."""
    for table, bounds in whole_groups(batches, ["path", "lo", "hi"]):
        c = _bucket(table)
        take = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            sig = np.frombuffer(b"".join(c["sig8"][a:b]), np.uint8).reshape(b - a, HASHES)
            ok = _pairs_here(c["path"][a], c["leaves"][a:b], c["side"][a:b], c["n"][a:b], sig)
            take.append(a + np.flatnonzero(ok.any(0) | ok.any(1)))
        if take:
            yield from table.take(pa.array(np.concatenate(take))).to_batches()


def shared_grams(sets: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the asked pairs."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 6:
        for i, j in zip(*np.nonzero(ok)):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, local, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[local] > 1
    owner, local = owner[common], local[common]
    _, local = np.unique(local, return_inverse=True)
    by = np.argsort(local, kind="stable")
    owner, local = owner[by], local[by]
    width = max(1, 8_000_000 // m)
    for lo in range(0, int(local[-1]) + 1 if len(local) else 0, width):
        a, b = np.searchsorted(local, [lo, lo + width])
        has = np.zeros((m, min(width, int(local[-1]) + 1 - lo)), np.float32)
        has[owner[a:b], local[a:b] - lo] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def _verified(batches):
    """Links per class and a star of links per component of the bucket."""
    for table, bounds in whole_groups(batches, ["path", "lo", "hi"]):
        c = _bucket(table)
        cls, copies, grams = (table.column(k).to_pylist() for k in ("cls", "copies", "grams"))
        out_cls, out_links, out_to = [], [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = c["n"][a:b]
            sig = np.frombuffer(b"".join(c["sig8"][a:b]), np.uint8).reshape(b - a, HASHES)
            ok = _pairs_here(c["path"][a], c["leaves"][a:b], c["side"][a:b], n, sig)
            both = shared_grams([np.frombuffer(x, np.uint64) for x in grams[a:b]], ok)
            link = ok & (both >= SIMILARITY * (n[:, None] + n[None, :] - both) - 1e-9)
            link |= link.T
            if not link.any():
                continue
            links = link @ np.array(copies[a:b])
            label = _labels(link, cls[a:b])
            for i in np.flatnonzero(links):
                out_cls.append(cls[a + i])
                out_links.append(int(links[i]))
                out_to.append(label[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_cls, pa.binary()), pa.array(out_links, pa.int64()),
                                          pa.array(out_to, pa.binary())], names=["cls", "links", "to"])


def _labels(link: np.ndarray, names: list[bytes]) -> list[bytes]:
    """Smallest name in the component of each member."""
    by = sorted(range(len(names)), key=names.__getitem__)
    label: list[bytes | None] = [None] * len(names)
    for s in by:
        if label[s] is not None:
            continue
        label[s], todo = names[s], [s]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if label[j] is None:
                    label[j] = names[s]
                    todo.append(j)
    return label


def components(edges: DataFrame) -> DataFrame:
    """(cls, root): the smallest class of each component of (cls, to) edges.

    Labels shrink along links and jump to their label's label, so rounds
    grow with the logarithm of a component's diameter."""
    both = staged(edges.select("cls", "to").union(edges.select(F.col("to"), F.col("cls"))).distinct(), "links")
    labels = staged(both.groupBy("cls").agg(F.least(F.min("to"), F.col("cls")).alias("root")), "labels")
    while True:
        seen = labels.select(F.col("cls").alias("to"), F.col("root").alias("r"))
        near = both.join(seen, "to").groupBy("cls").agg(F.min("r").alias("near"))
        low = labels.join(near, "cls").select("cls", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("cls").alias("root"), F.col("root").alias("further"))
        new = staged(low.join(jump, "root", "left").select(
            "cls", "was", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = new.select("cls", "root")
        if new.filter(F.col("was") != F.col("root")).isEmpty():
            return labels


def leaves_of(classes: DataFrame, runs: int) -> DataFrame:
    """(path, cls, blocks): the leaves with two classes or more."""
    found = None
    rows = classes.select("cls", "sig").mapInArrow(_split(1, runs), "cls binary, path long")
    for level in range(1, MAX_DEPTH + 1):
        rows = staged(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        rows = staged(rows.join(sizes, "path"), "buckets")
        last = level == MAX_DEPTH
        leaf = rows if last else rows.filter(F.col("size") <= LEAF)
        leaf = leaf.select("path", "cls", F.when(F.col("size") > LEAF, F.ceil(F.col("size") / BLOCK))
                           .otherwise(F.lit(1)).cast("int").alias("blocks"))
        found = leaf if found is None else found.unionByName(leaf)
        if last or rows.filter(F.col("size") > LEAF).isEmpty():
            return found
        rows = rows.filter(F.col("size") > LEAF).join(classes.select("cls", "sig"), "cls").select("cls", "sig", "path") \
            .mapInArrow(_split(level + 1, runs), "cls binary, path long")
    return found


def near_duplicates(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, class_id (the
    smallest doc_id of all documents joined by links), copy_id (the smallest
    with an equal gram set) and n_links (other documents at 0.8 or more,
    copies included).

    A text without words, null or empty, has no grams: it links to nothing and
    is a class by itself. A row without doc_id can't be named in a result:
    it keeps its row with its own ids null and no links. Repeated rows are
    copies of each other. Columns beside doc_id and text are ignored."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    profile = staged(texts.filter("doc_id is not null").mapInArrow(
        _profiles, "doc_id long, cls binary, n long, sig binary"), "profiles")
    classes = staged(profile.filter("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min("n").alias("n"),
        F.min("sig").alias("sig")), "classes")
    found = staged(leaves_of(classes, runs or runs_for()), "leaves")
    mine = found.groupBy("cls").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    slim = staged(classes.join(mine, "cls").select("cls", "copy_id", "copies", "n", "sig", "paths")
                  .mapInArrow(_slim, "cls binary, copy_id long, copies long, n long, sig8 binary, leaves binary"), "slim")
    side = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = found.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("path", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cls")
    key = ["path", "lo", "hi"]
    shape = "path long, lo int, hi int, side int, cls binary, copy_id long, copies long, n long, sig8 binary, leaves binary"
    names = [x.split()[0] for x in shape.split(", ")]
    need = staged(rows.join(slim, "cls").select(*names).repartition(*key).sortWithinPartitions(*key)
                  .mapInArrow(_needed, shape), "needed")
    wanted = need.select(F.col("copy_id").alias("doc_id")).distinct()
    grams = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_grams, "cls binary, grams binary") \
        .groupBy("cls").agg(F.min("grams").alias("grams"))
    links = staged(need.join(grams, "cls").select(*names, "grams").repartition(*key).sortWithinPartitions(*key)
                   .mapInArrow(_verified, "cls binary, links long, to binary"), "verified")
    roots = components(links.filter("cls != to"))
    per_class = classes.select("cls", "copy_id", "copies") \
        .join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left") \
        .join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = per_class.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = per_class.join(smallest, "root").select(
        "cls", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = profile.select("doc_id", "cls").join(per_class, "cls", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nameless = texts.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"),
                                                     F.lit(None).cast("long").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless)


def _slim(batches):
    for b in batches:
        sig = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column("sig").to_pylist()]
        paths = [np.array(x, np.int64).tobytes() for x in b.column("paths").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("copy_id"), b.column("copies"), b.column("n"),
                                          pa.array(sig, pa.binary()), pa.array(paths, pa.binary())],
                                         names=["cls", "copy_id", "copies", "n", "sig8", "leaves"])


def _grams(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in slices([len(t) for t in texts], BYTES_AT_ONCE):
            sets = [s for s in gram_sets(texts[lo:hi]) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "grams"])
