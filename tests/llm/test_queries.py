"""Corpus operators on Spark: edge rows, brute force on the small tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from rlframe.llm import chat, decontam, jaccard, lm, packing, pii, quality, sharding, tokens, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LONG = "word " * 3000 + "end"
ROWS = [(1, None, "x"), (2, "", "x"), (3, "a b c d e f g h i j k l m", "y"), (3, "a b c d e f g h i j k l m", "y"),
        (4, LONG, None), (None, "null id text one two three four five six seven", "z"),
        (5, "A b c d e f g h i j k l m", "y"), (6, "mail me at a.b@c.org or 4539578763621486 now", "z")]


@pytest.fixture(scope="module")
def edge(spark):
    # extra columns clash with names that the operators use
    return spark.createDataFrame([(*r, 7, "clash") for r in ROWS],
                                 "doc_id long, text string, source string, shard int, spans string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.filter("doc_id > 1000")


def test_edge_rows_and_empty_tables(spark, edge, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None), (3, "")], "item_id long, text string")
    ops = {
        "quality": quality.repetition_profile, "join": jaccard.near_duplicates,
        "pii": lambda d: pii.find_private(d, pii.Field()), "pack": lambda d: packing.pack(d, VOCABULARY),
        "ids": lambda d: tokens.read_id_files(spark, tokens.write_id_files(d, VOCABULARY)),
        "shards": sharding.uniform_shards, "lm": lm.score_texts,
        "leaks": lambda d: decontam.contaminated(d, bench),
    }
    for name, op in ops.items():
        assert op(empty).count() == 0, name
        got = op(edge).collect()
        if name == "leaks":
            assert {(r.doc_id, r.item_id) for r in got} == {(3, 1), (5, 1)}
        elif name == "pack":
            assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
        else:
            assert len(got) == len(ROWS), name
        if name == "join":
            assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == \
                [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (4, 4, 0), (5, 3, 2), (6, 6, 0)]
        if name == "ids":
            assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2, 3, 3, 4, 5, 6]
    turns = spark.createDataFrame([(None, 0, "user", None), (1, None, None, "x"), (1, 2, "tool", "</s>")],
                                  "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(turns).count() == 3
    assert chat.format_conversations(turns.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "x"), (4, "u", "x"), (None, "u", "x")],
                                  "page_id long, url string, html string")
    files, _ = warc.write_archives(pages)
    got = {r.record_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, files).collect()}
    assert got == {"urn:page:1": ("revisit", "urn:page:2"), "urn:page:2": ("response", None),
                   "urn:page:3": ("revisit", "urn:page:4"), "urn:page:4": ("response", None),
                   "urn:page:null": ("revisit", "urn:page:4")}


def test_join_equals_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: set(jaccard.gram_sets([(r.text or "").encode()])[0].tolist()) for r in d.collect()}
    links = collections.Counter()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
    got = jaccard.near_duplicates(d).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[i] for i in sets}


def test_large_groups_of_near_copies_are_split_and_whole(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 190] + [f"x{i}"] + base[i % 190:])) for i in range(900)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert {r.n_links for r in got} == {899}


def test_model_scores_equal_recounted_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts, texts = collections.Counter(), {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split() + [None]
        texts[r.doc_id] = w
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(w)
    total = sum(counts.values())
    below = total + 0.5 * (len(counts) + 1)
    for r in lm.score_texts(docs).collect():
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / below) for x in w))
        assert r.score < 0


def test_chat_digests(spark):
    got = {r.conv_id: r for r in E.queries()["op3_chat_machine"](spark, SF).collect()}
    hard = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()


def test_shards_are_exact_and_slots_gapless(spark):
    rows = E.queries()["op5_hypergeometric_shards"](spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(x) for x in by.values()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaks = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = C.without_benchmarks(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == leaks
    firsts = C.one_of_each_group(spark, docs, SF)
    classes = {r.class_id for r in jaccard.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in firsts.select("doc_id").collect()) == sorted(classes)
    clean = C.masked_pii(spark, docs, SF)
    assert clean.columns == docs.columns
    left = [r.text for r in clean.collect()]
    assert not any(pii.base_spans(t) for t in left if t)
    assert C.run(spark, SF).count() > 0


def test_model_scores_see_the_order_of_words(spark):
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "green", "night") for b in ("fall", "ward", "light", "song")]
    held = [i for i in range(400) if lm._held(i)]
    fluent = " ".join(words)
    mixed = " ".join(np.random.default_rng(3).permutation(words))
    rows = [(i, mixed if i == held[0] else fluent) for i in range(400)]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score < got[held[1]].score - 5


def test_whole_documents_are_sharded(spark, monkeypatch):
    seen = []
    real = sharding.uniform_shards
    monkeypatch.setattr(sharding, "uniform_shards", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = E.queries()["op5_hypergeometric_shards"](spark, SF).collect()
    assert seen == [docs.columns]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    whole = real(docs, 3).drop("shard", "slot")
    assert whole.exceptAll(docs).count() == 0 and whole.count() == docs.count()


def test_dealing_streams_long_rows():
    part = sharding.pa.table({"_part": [4] * 6, "_uid": [(4 << 33) + i for i in range(6)], "text": [str(i) for i in range(6)]})
    matrix = np.zeros((5, 2), np.int64)
    matrix[4] = [4, 2]
    seen = 0

    def rows():
        nonlocal seen
        for b in part.to_batches(max_chunksize=2):
            seen += 1
            yield b

    out = sharding._deal(matrix, 1)(rows())
    first = next(out)
    assert seen == 1 and first.num_rows == 2
    assert collections.Counter(x for b in [first, *out] for x in b.column("shard").to_pylist()) == {0: 4, 1: 2}


def test_pipeline_stages_judge_rows_not_ids(spark):
    import corpus_pipeline as C
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r.text)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, item), (7, c), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = C.without_benchmarks(spark, docs, SF)
    assert sorted(r.text for r in kept.collect()) == [a, b, c] and kept.columns == docs.columns
    # unrelated rows of one id stay, near copies go, also without an id
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (5, c), (5, c), (None, c), (None, item), (None, item)]
    got = C.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (2, b), (5, c), (0, item)])
