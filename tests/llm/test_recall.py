"""Searches against planted cases and against all pairs."""

import collections
import random
import re

from rlframe.llm import decontam, jaccard

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def in_order(a, b):
    """Words of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def is_leak(item, text):
    """The rule by which a found candidate counts, over the whole text."""
    a, b = (re.sub(r"[^\w\s]|_", " ", x).lower().split() for x in (item, text))
    share, tail = in_order(a, b) / len(a), a[-decontam.ANSWER_WORDS:]
    return share >= decontam.SURE_LCS or (share >= decontam.MIN_LCS and in_order(tail, b) / len(tail) >= decontam.MIN_ANSWER)


def test_planted_benchmark_items_are_found(spark):
    rng = random.Random(12)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    clean = [f"filler{rng.randrange(400)}" for _ in range(4000)]
    rows, verbatim, leaks = [], set(), set()
    for item in bench.collect():
        for share in (0, 15, 25, 35):
            words = [w if rng.random() * 100 >= share else f"other{rng.randrange(10_000)}" for w in item.text.split()]
            at, doc = rng.randrange(3800), len(rows)
            rows.append((doc, " ".join(clean[at:at + 60] + words + clean[at + 60:at + 120])))
            if share == 0:
                verbatim.add((doc, item.item_id))
            if is_leak(item.text, rows[-1][1]):
                leaks.add((doc, item.item_id))
    rows += [(10_000 + i, " ".join(rng.choices(clean, k=200))) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    print("leaks by the rule", len(leaks), "found", len(leaks & got), "others", len(got - leaks))
    assert verbatim <= got and verbatim <= leaks
    assert len(leaks & got) >= 0.9 * len(leaks)
    assert not any(d >= 10_000 for d, _ in got)


def test_join_equals_all_pairs_of_a_thousand_documents(spark):
    d = spark.read.parquet(f"{LARGER}/documents.parquet")
    sets = {r.doc_id: set(jaccard.gram_sets([(r.text or "").encode()])[0].tolist()) for r in d.collect()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    links = collections.Counter()
    for i, s in sets.items():
        common = collections.Counter(j for g in s for j in holders[g])
        links[i] = sum(j != i and c >= 0.8 * (len(s) + len(sets[j]) - c) for j, c in common.items())
    assert {r.doc_id: r.n_links for r in jaccard.near_duplicates(d).collect()} == {i: links[i] for i in sets}
