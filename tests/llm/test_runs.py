"""Periodic runs: the tree against all windows, whole query against a plain loop."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from rlframe.llm import runs
from rlframe.llm.shared import offsets, word_codes

SF = "/root/testdata/sf0.001"


def plain_runs(w, min_length=12):
    """All runs by scanning each period for maximal stretches."""
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(min_length, 2 * p):
                best.setdefault((i, j + p - i), p)  # smaller periods came first
            i = j
    return sorted(((s, length, p) for (s, length), p in best.items()), key=lambda r: (r[0], r[2]))


def split_by_text(found, counts):
    at = offsets(counts)
    return [[(int(s - lo), int(n), int(p)) for s, n, p in found if lo <= s < hi] for lo, hi in zip(at, at[1:])]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_a_scan_of_every_period(least):
    rng = random.Random(least)
    for k in range(150):
        docs = []
        for _ in range(4):
            w = [rng.choice([b"a", b"b", b"c"][:1 + k % 3]) for _ in range(rng.randrange(0, 40))]
            docs.append(w + (w[-rng.randrange(1, 9):] * rng.randrange(1, 6) if w else []))
        codes, counts = word_codes(docs)
        got = split_by_text(runs.maximal_pair_runs(codes, counts, least).tolist(), counts)
        assert got == [plain_runs(d, least) for d in docs]


def test_fibonacci_words_and_long_repeats():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    codes, counts = word_codes([[c.encode() for c in b]])
    assert runs.maximal_pair_runs(codes, counts, 2).tolist() == [list(x) for x in plain_runs(b, 2)]
    began = time.time()
    n = 200_000
    one = np.zeros(n, np.int64)
    assert runs.maximal_pair_runs(one, np.array([n]), 12).tolist() == [[0, n, 1]]
    # a phrase that comes back often, after another word each time
    many = np.concatenate([np.concatenate([np.arange(8), [100 + i, 7000 + i % 7]]) for i in range(20_000)])
    assert runs.maximal_pair_runs(many, np.array([len(many)]), 12).shape == (0, 3)
    assert time.time() - began < 60


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (None, "x y " * 6 + "x"),
            (6, "é ü\x0bé ü " * 5), (7, "a b c " * 4 + "q " + "a b c " * 4)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_words int, runs string")
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed, r.n_words))
    assert got == {1: [([], "", 0)], 2: [([], "", 0)], 3: [([], "", 0)], 4: [([(0, 12, 1)], "a", 12)] * 2,
                   5: [([], " ".join("a" * 11), 11)], None: [([(0, 13, 2)], "x y", 13)],
                   6: [([(0, 20, 2)], "é ü", 20)], 7: [([(0, 12, 3), (13, 12, 3)], "a b c q a b c", 25)]}
    assert runs.periodic_runs(df.filter("doc_id > 99")).count() == 0


def test_query_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in E.queries()["op12_maximal_pair_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        w = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {i for s, m, p in found for i in range(s + p, s + m)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if found else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert x.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = b" ".join(v for i, v in enumerate(w) if i not in gone)
        assert x.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
