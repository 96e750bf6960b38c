"""Benchmark items whose leaked part has frequent words only."""

import random

import numpy as np
import pytest

from rlframe.llm import decontam


def test_leaks_of_frequent_words_are_found(spark):
    rng = random.Random(3)
    common, rarer = [f"common{i}" for i in range(40)], [f"rarer{i}" for i in range(6)]
    item = rarer + common[:24]  # the rarer six alone carry weight
    rows = [(i, " ".join(rng.sample(common, 40) + (rarer if i < 3 else []))) for i in range(60)]
    rows += [(100, " ".join(f"pad{i}" for i in range(50)) + " " + " ".join(common[:24]) + " the end"),  # 0.8 of the words in order
             (101, " ".join(f"pad{i}" for i in range(20)) + " " + " ".join(common[4:24])),  # 0.67 in order and the whole answer
             (102, " ".join(common[:12] + common[16:4:-1])),  # too few in order
             (103, " ".join(f"pad{i}" for i in range(700)) + " " + " ".join(common[:24]))]  # far into a text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"else{i}" for i in range(20)))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect()}
    assert sorted(got) == [100, 101, 103]
    assert [(got[d].item_id, got[d].lcs) for d in (100, 101, 103)] == [(1, 0.8), (1, round(20 / 30, 6)), (1, 0.8)]


@pytest.mark.parametrize("cells", [decontam.CELLS_AT_ONCE, 50])
def test_stretches_of_all_texts_at_once_equal_a_plain_loop(monkeypatch, cells):
    monkeypatch.setattr(decontam, "CELLS_AT_ONCE", cells)
    rng = np.random.default_rng(5)
    items = [rng.integers(1, 60, n) for n in (3, 12, 40, 300)]
    counts = rng.integers(0, 90, 60)
    postings = decontam._rarest_words(items, [0, 1, 3], counts)
    bounds, posted, places, least = postings
    seqs = [(rng.integers(1, 60, n) * (rng.random(n) < 0.15)).astype(np.int32) for n in (1, 31, 33, 256, 272, 290, 1500, 700)]
    for margin in (0, 40, 300):
        want = []
        for t, seq in enumerate(seqs):
            n_passages = max(1, -(-len(seq) // decontam.STEP) - 1)
            for a in range(0, n_passages, decontam.STRETCH):
                start, end = a * decontam.STEP, min(a + decontam.STRETCH, n_passages) * decontam.STEP + decontam.STEP
                near = np.zeros(len(items))
                for w in set(seq[max(0, start - margin):end + margin].tolist()):
                    for j in range(bounds[w], bounds[w + 1]):
                        near[posted[j]] += places[j]
                want += [(t, q, start, end) for q in range(len(items)) if near[q] >= least[q]]
        assert want and list(decontam._stretches(seqs, postings, margin, len(items))) == want
