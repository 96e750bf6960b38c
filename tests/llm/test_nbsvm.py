"""Quality classifier: features, counts and the fit against plain versions,
and held-out accuracy of the whole query."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from rlframe.llm import nbsvm

SF = "/root/testdata/sf0.01"


def plain_slots(text: bytes) -> set:
    keys = [(n, int.from_bytes(text[i:i + n], "big")) for n in range(1, 5) for i in range(len(text) - n + 1)]
    w = [zlib.crc32(x) for x in text.lower().split()]
    keys += [(5, x) for x in w]
    mix = int(nbsvm._MIX_A)
    keys += [(6, (a << 24) ^ ((b * mix) % 2 ** 64 >> 8)) for a, b in zip(w, w[1:])]
    for i in range(len(w) - 3):
        a, b, c, d = w[i:i + 4]
        keys.append((7, sum(int(x) << k for k, x in enumerate((a == b, a == c, a == d, b == c, b == d, c == d)))))
    out = set()
    for family, x in keys:
        x = (x + (family << 56)) * mix % 2 ** 64
        x ^= x >> 29
        out.add((x * int(nbsvm._MIX_B) % 2 ** 64) >> (64 - nbsvm.SLOT_BITS))
    return out


def test_indicators_equal_a_plain_loop(monkeypatch):
    find = nbsvm.Indicators()
    texts = [b"", b" ", b"a", b"ab", b"The the THE the cat", "é ü x".encode(), b"x y x y x z" * 9, b"\x00\n\n"]
    for block in (nbsvm.BLOCK, 5):
        monkeypatch.setattr(nbsvm, "BLOCK", block)  # long texts go in blocks
        for t in texts:
            got = find.of(t)
            assert got.tolist() == sorted(plain_slots(t)), t


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    n = 120
    slots = [np.sort(rng.choice(40, rng.integers(0, 12), replace=False)) for _ in range(n)]
    rows = nbsvm.Rows(np.concatenate(slots).astype(np.int32), np.concatenate([[0], np.cumsum([len(s) for s in slots])]),
                      rng.random(n) < 0.6)
    values = rows.scaled(rng.normal(size=nbsvm.SLOTS))
    cost = 0.7
    w, bias, dual = nbsvm.dual_coordinate_descent(rows, values, np.arange(n), cost, 5000, 1e-9)
    x = np.zeros((n, 41))
    for i, s in enumerate(slots):
        x[i, s] = values[rows.at[i]:rows.at[i + 1]]
    x[:, 40] = 1
    sign = np.where(rows.good, 1, -1)
    full = (dual * sign) @ x
    assert np.allclose(full[:40], w[:40]) and full[40] == pytest.approx(bias)
    assert (dual >= 0).all() and (dual <= cost).all()
    primal = 0.5 * full @ full + cost * np.maximum(0, 1 - sign * (x @ full)).sum()
    assert primal == pytest.approx(dual.sum() - 0.5 * full @ full, rel=1e-6)  # no gap: both are optimal


def test_sigmoid_minimises_its_loss():
    rng = np.random.default_rng(4)
    m = rng.normal(size=500)
    good = rng.random(500) < 1 / (1 + np.exp(-(2 * m - 0.5)))
    slope, shift = nbsvm.sigmoid_fit(m, good)
    assert slope == pytest.approx(2, abs=0.5) and shift == pytest.approx(-0.5, abs=0.3)
    perfect = nbsvm.sigmoid_fit(np.where(good, 1.0, -1.0), good)
    assert np.isfinite(perfect).all() and perfect[0] > 1


def test_counts_cover_every_labelled_text(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = nbsvm.labelled_texts(docs, labels)
    good, bad = nbsvm.slot_counts(texts.repartition(7))
    want = np.zeros((2, nbsvm.SLOTS))
    find = nbsvm.Indicators()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for r in docs.collect():
        if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5:
            want[quality[r.doc_id], find.of((r.text or "").encode())] += 1
    assert (good == want[1]).all() and (bad == want[0]).all()


def test_held_out_accuracy_and_no_effect_of_partitions(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = E.queries()["op13_naive_bayes_svm"](spark, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, y, _ in test if y], [s for s, y, _ in test if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.98
    assert np.mean([p == y for _, y, p in test]) > 0.95
    again = nbsvm.quality_scores(docs.repartition(13), spark.read.parquet(f"{SF}/labels.parquet").repartition(5)).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-9)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x y", 5), (3, "x y", 5), (3, "x y", 5), (4, "w " * 50_000, 5)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (3, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    got = nbsvm.quality_scores(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] and by[None] == by[3]
    for d, n in ((docs.filter("false"), 0), (docs, 6)):
        rest = nbsvm.quality_scores(d, labels.filter("false")).collect()
        assert [r.score for r in rest] == [0.5] * n
