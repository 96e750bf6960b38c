"""Admission of prompts into steps: cut, carried over, and replayed."""

import pytest

from rlframe.streaming import admission as A
from rlframe.streaming import jobs as J

SCHEMA = "uid long, sample_idx int, score double"


def batch(spark, uids, flat=()):
    rows = [(u, i, 0.5 if u in flat else float(i)) for u in uids for i in range(2)]
    return spark.createDataFrame(rows, SCHEMA)


def steps(ledger):
    got = {}
    for r in ledger.admitted(SCHEMA).collect():
        got.setdefault((r.step, r.full), set()).add(r.uid)
    return got


BATCHES = [(range(0, 4), (1,)), (range(10, 12), ()), (range(20, 29), (20, 21)), (range(30, 32), (30, 31)), (range(40, 42), ())]
WANT = {(0, True): {0, 2, 3, 10, 11}, (1, True): {22, 23, 24, 25, 26}, (2, False): {40, 41}}


def test_steps_fill_in_order_and_replays_change_nothing(spark):
    ledger = A.Ledger(spark, J.work_dir(spark, "ledger") + "/l", 5, "uid", "score")
    assert ledger.admitted(SCHEMA).count() == 0
    for n, (uids, flat) in enumerate(BATCHES):
        ledger.admit(batch(spark, uids, flat), n)
    assert steps(ledger) == WANT
    for n in (1, 4, 2):  # replayed after all were written
        ledger.admit(batch(spark, *BATCHES[n]), n)
    assert steps(ledger) == WANT


def test_query_killed_between_rows_and_summary(spark, monkeypatch):
    base = J.work_dir(spark, "ledger")
    ledger = A.Ledger(spark, f"{base}/l", 5, "uid", "score")
    real, kills = A.Ledger.commit, {1, 2}

    def commit(self, summary):
        if summary[0] in kills:
            kills.remove(summary[0])
            raise RuntimeError("killed")
        real(self, summary)

    monkeypatch.setattr(A.Ledger, "commit", commit)
    for n, (uids, flat) in enumerate(BATCHES):
        batch(spark, uids, flat).coalesce(1).write.mode("append").parquet(f"{base}/src")
        for _ in range(2):  # a killed run is started again
            try:
                ledger.run(spark.readStream.schema(SCHEMA).parquet(f"{base}/src"), f"{base}/ckpt")
                break
            except Exception as e:
                assert "killed" in str(e)
                assert n not in {r.batch_no for r in ledger.summaries().collect()}
    assert not kills and steps(ledger) == WANT


def test_too_many_batches_for_a_step(spark):
    ledger = A.Ledger(spark, J.work_dir(spark, "ledger") + "/l", 5, "uid", "score", max_batches=2)
    ledger.admit(batch(spark, range(2)), 0)
    with pytest.raises(ValueError, match="4 of 5 prompts after 2 batches"):
        ledger.admit(batch(spark, range(10, 12)), 1)
    assert steps(ledger) == {(0, False): {0, 1}}
