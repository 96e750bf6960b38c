"""Batch-shaping queries over ``orders`` (a batch keyed by o_orderkey) and
the rollout table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import batch as B
from rlframe.operators import budget as BU
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

_OI = """WITH oi AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
                     row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
, nn AS (SELECT count(*) AS n FROM orders)
"""


def _oi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                              "o_orderpriority")
    return B.with_global_index(o, [F.col("o_orderkey")])


@query("global_index", _OI + "SELECT o_orderkey, CAST(idx AS BIGINT) AS idx FROM oi")
def global_index(spark, sf_dir):
    return _oi(spark, sf_dir).select("o_orderkey", "idx")


@query("repeat_interleave", _OI + """
SELECT o_orderkey, CAST(idx * 2 + r AS BIGINT) AS new_idx FROM oi, (SELECT unnest([0, 1]) AS r)
""")
def repeat_interleave(spark, sf_dir):
    return B.repeat(_oi(spark, sf_dir), 2, interleave=True).select("o_orderkey", "new_idx")


@query("repeat_tiled", _OI + """
SELECT o_orderkey, CAST(r * n + idx AS BIGINT) AS new_idx FROM oi, nn, (SELECT unnest([0, 1]) AS r)
""")
def repeat_tiled(spark, sf_dir):
    d = _oi(spark, sf_dir)
    return B.repeat(d, 2, interleave=False, n=d.count()).select("o_orderkey", "new_idx")


_PAD = """
, pad AS (SELECT ({k} - n % {k}) % {k} AS p, n FROM nn)
, padded AS (SELECT o_orderkey, idx, false AS is_pad FROM oi
             UNION ALL
             SELECT oi.o_orderkey, pad.n + j AS idx, true AS is_pad
             FROM pad, range(0, pad.p) AS t(j) JOIN oi ON oi.idx = j % pad.n)
"""


@query("pad_to_divisor", _OI + _PAD.format(k=7) + """
SELECT o_orderkey, CAST(idx AS BIGINT) AS idx, is_pad FROM padded
""")
def pad_to_divisor(spark, sf_dir):
    d = _oi(spark, sf_dir)
    p, _ = B.pad_to_divisor(d, 7, d.count())
    return p.select("o_orderkey", "idx", "is_pad")


@query("chunk_assign", _OI + _PAD.format(k=8) + """
SELECT o_orderkey, CAST(idx AS BIGINT) AS idx, is_pad,
       CAST(floor(idx / ((SELECT n + p FROM pad) // 8)) AS INTEGER) AS chunk_id FROM padded
""")
def chunk_assign(spark, sf_dir):
    d = _oi(spark, sf_dir)
    n = d.count()
    p, pad = B.pad_to_divisor(d, 8, n)
    return B.chunk(p, 8, n + pad).select("o_orderkey", "idx", "is_pad", "chunk_id")


@query("slice_step", _OI + """
SELECT o_orderkey, CAST(idx AS BIGINT) AS idx FROM oi, nn
WHERE idx >= 10 AND idx < n - 10 AND (idx - 10) % 3 = 0
""")
def slice_step(spark, sf_dir):
    d = _oi(spark, sf_dir)
    return B.slice_rows(d, d.count(), 10, -10, 3).select("o_orderkey", "idx")


@query("pick_rows", _OI + """
, picks AS (SELECT idx AS ord, (o_custkey * 7) % n AS pick FROM oi, nn WHERE o_custkey % 5 = 0)
SELECT CAST(ord AS BIGINT) AS ord, oi.o_orderkey FROM picks JOIN oi ON oi.idx = picks.pick
""")
def pick_rows(spark, sf_dir):
    d = _oi(spark, sf_dir)
    n = d.count()
    picks = d.where(F.pmod("o_custkey", F.lit(5)) == 0).select(
        F.col("idx").alias("ord"), F.pmod(F.col("o_custkey") * 7, F.lit(n)).alias("pick"))
    return B.pick_rows(d, picks).select(F.col("ord").cast("bigint"), "o_orderkey")


@query("reorder_rotate", _OI + """
SELECT CAST((idx - 17 + n) % n AS BIGINT) AS new_idx, o_orderkey FROM oi, nn
""")
def reorder_rotate(spark, sf_dir):
    d = _oi(spark, sf_dir)
    n = d.count()
    perm = d.select(F.col("idx").alias("new_idx"), F.pmod(F.col("idx") + 17, F.lit(n)).alias("src_idx"))
    return B.reorder(d, perm).select(F.col("new_idx").cast("bigint"), "o_orderkey")


@query("keyed_union", """
SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
""")
def keyed_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = o.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return B.keyed_union(a, b, ["o_orderkey"])


@query("fold_unfold", _OI + """
SELECT CAST(idx AS BIGINT) AS idx, o_orderkey, CAST(idx // 3 AS BIGINT) AS fold_idx FROM oi
""")
def fold_unfold(spark, sf_dir):
    d = _oi(spark, sf_dir).select("idx", "o_orderkey")
    f = B.fold(d, 3)
    u = B.unfold(f, 3)
    return u.select(F.col("idx").cast("bigint"), "o_orderkey", F.floor(F.col("idx") / 3).cast("bigint").alias("fold_idx"))


_SEQ = """
WITH seqs AS (SELECT l_orderkey AS seq, CAST(sum(l_quantity) AS BIGINT) AS len FROM lineitem GROUP BY l_orderkey)
, rk AS (SELECT *, row_number() OVER (ORDER BY len DESC, seq) - 1 AS r FROM seqs)
"""


def _seqs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("seq")).agg(F.sum("l_quantity").cast("bigint").alias("len"))


@query("length_balance", _SEQ + """
, b AS (SELECT *, CAST(CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS INTEGER) AS bucket FROM rk)
SELECT bucket, count(*) AS n_rows, CAST(sum(len) AS BIGINT) AS total_len FROM b GROUP BY bucket
""")
def length_balance(spark, sf_dir):
    a = B.snake_buckets(_seqs(spark, sf_dir), "len", 8, ["seq"])
    return a.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("len").cast("bigint").alias("total_len"))


@query("balance_report", _SEQ + f"""
, ix AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx,
                CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS bucket FROM rk)
, n AS (SELECT count(*) AS n FROM seqs)
, o AS (SELECT idx // ((SELECT n FROM n) // 8) AS c, sum(len) AS s FROM ix GROUP BY 1)
, bb AS (SELECT bucket, sum(len) AS s FROM ix GROUP BY 1)
SELECT CAST(min(o.s) AS BIGINT) AS min, CAST(max(o.s) AS BIGINT) AS max, CAST(max(o.s) - min(o.s) AS BIGINT) AS minmax_diff,
       CAST((SELECT min(s) FROM bb) AS BIGINT) AS balanced_min, CAST((SELECT max(s) FROM bb) AS BIGINT) AS balanced_max,
       {R6('sum(o.s) / 8')} AS mean
FROM o
""")
def balance_report(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    a = B.snake_buckets(s, "len", 8, ["seq"])
    a = B.with_global_index(a, [F.col("seq")], "idx")
    st = B.balance_stats(a, "len", "bucket", "idx", 8, s.count())
    return st.select(*[F.col(c).cast("bigint") for c in ("min", "max", "minmax_diff", "balanced_min",
                                                           "balanced_max")], r6("mean").alias("mean"))


@query("token_budget_buckets", _SEQ + """
, m AS (SELECT CAST(ceil(sum(len) / 4096.0) AS BIGINT) AS m FROM seqs)
, b AS (SELECT rk.*, CASE WHEN (r // m) % 2 = 0 THEN r % m ELSE m - 1 - r % m END AS mb FROM rk, m)
SELECT CAST(mb AS INTEGER) AS micro_batch, count(*) AS n_rows, CAST(sum(len) AS BIGINT) AS total_len FROM b GROUP BY mb
""")
def token_budget_buckets(spark, sf_dir):
    a, _ = B.token_budget_buckets(_seqs(spark, sf_dir), "len", 4096, ["seq"])
    return a.groupBy("micro_batch").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("len").cast("bigint").alias("total_len"))


_BUDGET = """
WITH RECURSIVE d AS (SELECT coalesce(n_chars, 0) AS len, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS r FROM documents)
, k AS (SELECT greatest(1, CAST(ceil(sum(len) / 40000.0) AS BIGINT)) AS k FROM d)
, st AS (SELECT CAST(0 AS BIGINT) AS r, list_transform(range(k), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS BIGINT) AS b FROM k
         UNION ALL
         SELECT s.r + 1, list_transform(s.loads, lambda x, i: CASE WHEN i = s.p THEN x + d.len ELSE x END), s.p
         FROM (SELECT *, list_position(loads, list_min(loads)) AS p FROM st) s JOIN d ON d.r = s.r + 1)
, a AS (SELECT CAST(st.b - 1 AS INTEGER) AS micro_batch, d.len FROM st JOIN d USING (r))
, l AS (SELECT micro_batch, count(*) AS n_rows, CAST(sum(len) AS BIGINT) AS total_len FROM a GROUP BY ALL)
"""


def _budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("len"))
    return BU.budget_buckets(docs, "len", 40_000, ["doc_id"])


@query("token_budget_longest_first", _BUDGET + "SELECT * FROM l")
def token_budget_longest_first(spark, sf_dir):
    """Micro-batches of unequal counts, longest document first."""
    a, _ = _budget(spark, sf_dir)
    return a.groupBy("micro_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("len").cast("bigint").alias("total_len"))


@query("token_budget_report", _BUDGET + """
SELECT k AS buckets, max(total_len) AS largest, CASE WHEN count(*) < k THEN 0 ELSE min(total_len) END AS smallest,
       max(total_len) - CASE WHEN count(*) < k THEN 0 ELSE min(total_len) END AS spread,
       CASE WHEN count(*) < k THEN 0 ELSE min(n_rows) END AS fewest_rows, max(n_rows) AS most_rows,
       CAST(count(*) FILTER (WHERE total_len > 40000) AS BIGINT) AS over_budget,
       CAST(sum(greatest(total_len - 40000, 0)) AS BIGINT) AS tokens_over
FROM l, k GROUP BY k
""")
def token_budget_report(spark, sf_dir):
    a, k = _budget(spark, sf_dir)
    return BU.budget_report(a, "len", k, 40_000)


_RO = AD.sql_with(rollouts=AD.ROLLOUTS_SQL)


@query("dynamic_group_filter", _RO + """
, st AS (SELECT uid, stddev_pop(score) AS sd, count(*) AS n FROM rollouts GROUP BY uid)
, kept AS (SELECT uid FROM st WHERE sd > 0 OR n = 1 ORDER BY uid LIMIT 1000)
SELECT uid, CAST(sample_idx AS BIGINT) AS sample_idx FROM rollouts WHERE uid IN (SELECT uid FROM kept)
""")
def dynamic_group_filter(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    return B.dynamic_group_filter(r, "uid", "score", 1000).select("uid", F.col("sample_idx").cast("bigint"))


@query("accuracy_band_filter", _RO + """
, st AS (SELECT uid, avg(acc) AS a, max(CAST(response_len >= 49 AS INTEGER)) AS tr FROM rollouts GROUP BY uid)
, d AS (SELECT r.uid, r.sample_idx, (st.a >= 0.2 AND st.a <= 0.8 AND st.tr = 0) AS passes
        FROM rollouts r JOIN st USING (uid))
, rk AS (SELECT *, row_number() OVER (ORDER BY passes DESC, uid, sample_idx) - 1 AS rr FROM d)
SELECT uid, CAST(sample_idx AS BIGINT) AS sample_idx, passes FROM rk
WHERE rr < CAST(floor((SELECT count(*) FROM rollouts) * 0.5) AS BIGINT)
""")
def accuracy_band_filter(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    d = B.accuracy_band_filter(r, "uid", "acc", 0.2, 0.8, "response_len", 49, keep_ratio=0.5, order=["uid", "sample_idx"])
    return d.select("uid", F.col("sample_idx").cast("bigint"), "passes")


@query("per_source_examples", _RO + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY uid, sample_idx) AS rn FROM rollouts)
SELECT data_source, uid, CAST(sample_idx AS BIGINT) AS sample_idx FROM rk WHERE rn <= 3
""")
def per_source_examples(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    return B.first_n_per_group(r, "data_source", ["uid", "sample_idx"], 3).select(
        "data_source", "uid", F.col("sample_idx").cast("bigint"))


@query("assign_uid", """
SELECT DISTINCT 'p' || CAST(l_orderkey AS VARCHAR) AS prompt, sha256('p' || CAST(l_orderkey AS VARCHAR)) AS uid FROM lineitem
""")
def assign_uid(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir).select("prompt").distinct()
    return B.assign_uid(r, ["prompt"])


@query("gather_responses", """
SELECT conv_id, count(*) AS n_responses, string_agg(text, ' || ' ORDER BY turn) AS responses
FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def gather_responses(spark, sf_dir):
    m = AD.messages(spark, sf_dir).where(F.col("role") == "assistant")
    g = B.gather_responses(m, ["conv_id"], "turn", "content")
    return g.select("conv_id", F.size("responses").cast("bigint").alias("n_responses"),
                    F.array_join("responses", " || ").alias("responses"))


@query("minibatch_epochs", """
WITH e AS (SELECT o_orderkey, ep AS epoch FROM orders, (SELECT unnest([0, 1]) AS ep))
, rk AS (SELECT *, row_number() OVER (PARTITION BY epoch
                ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7:' || CAST(epoch AS VARCHAR)), o_orderkey) - 1 AS e_idx FROM e)
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(e_idx // 256 AS BIGINT) AS batch_id, o_orderkey FROM rk
WHERE e_idx // 256 < (SELECT count(*) FROM orders) // 256
""")
def minibatch_epochs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    d = B.minibatches(o, 256, 2, 7, "o_orderkey")
    return d.select(F.col("epoch").cast("int"), "batch_id", "o_orderkey")
