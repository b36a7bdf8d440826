"""Short traces are folded from their one slice; long ones still run over slices."""
import random

from pyspark.sql import functions as F

from packloom.config import FoldConfig
from packloom.operators import traces
from tests.test_traces import OWN, at, brute_fold, fold


def _rows(spark, lengths, seed=3):
    rng = random.Random(seed)
    rows = [(t, i, rng.random() < 0.9, rng.random() < 0.8, "") for t, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "trace_id bigint, line_no bigint, solid boolean, foldable boolean, indent string")


def test_short_traces_are_worked_on_once(spark):
    """The windows within slices stand once in the plan; the slices of long traces are written before."""
    plan = traces.fold_blocks(_rows(spark, {k: 9 for k in range(20)}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS _rn#") == 1


def test_mixed_lengths(spark, monkeypatch):
    rows = _rows(spark, {1: 4, 2: 5, 3: 23, 4: 1, 5: 11, None: 7})
    whole = {(r.trace_id, r.line_no): r for r in traces.fold_blocks(rows).collect()}
    assert len(whole) == 44  # rows without trace are in no run
    monkeypatch.setattr(traces, "SLICE_LINES", 5)
    cut = {(r.trace_id, r.line_no): r for r in traces.fold_blocks(rows).collect()}
    assert cut == whole
    moved = rows.withColumn("line_no", F.col("line_no") + F.when(F.col("trace_id") == 2, 10).otherwise(-3))
    got = {(r.trace_id, r.line_no - (10 if r.trace_id == 2 else -3)): (r.pos, r.block, r.block_len) for r in traces.fold_blocks(moved).collect()}
    assert got == {k: (r.pos, r.block, r.block_len) for k, r in whole.items()}


def test_long_and_short_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(traces, "SLICE_LINES", 4)
    rng = random.Random(8)
    texts = ["\n".join(at(rng.choice([OWN, "org.x.A", "com.y.B"]), i) for i in range(rng.choice([2, 3, 4, 5, 17]))) for _ in range(40)]
    config = FoldConfig(min_frames=2, keep_head=1, keep_tail=0)
    assert fold(spark, texts, {OWN}, config) == [brute_fold(t, {OWN}, config) for t in texts]
