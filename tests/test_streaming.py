"""The incremental mode fed by a file stream."""

import pytest

from corpusfold.options import ContextOptions
from corpusfold.sources import state
from corpusfold.sources.repo import SCHEMA
from corpusfold.streaming.incremental import follow, run_batch


def test_batches_move_the_snapshot_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    options = ContextOptions(tokenizer="native")
    seen = {}

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = follow(
            stream, options, folder, str(tmp_path / "checkpoint"),
            lambda deltas, epoch: seen.update({epoch: {r.path: r.delta for r in deltas.collect()}}),
        )
        query.awaitTermination(120)
        assert query.exception() is None

    feed([("a.rs", "/r/a.rs", 9, 1, "fn a() {}"), ("b.py", "/r/b.py", 5, 1, "x = 1"), ("n.txt", "/r/n.txt", 1, 1, "x")])
    feed([("a.rs", "/r/a.rs", 9, 1, "fn a() {}"), ("b.py", "/r/b.py", 5, 2, "x = 2"), ("b.py", "/r/b.py", 5, 3, "x = 3")])
    assert seen[0] == {"a.rs": "added", "b.py": "added"}
    assert seen[1] == {"a.rs": "unchanged", "b.py": "changed"}
    entries = {r.abs_path: (r.mtime_ns, r.full) for r in state.load(spark, folder).entries.collect()}
    assert entries == {"/r/a.rs": (1, "fn a() {}"), "/r/b.py": (3, "x = 3")}


def test_a_failed_report_is_repeated(spark, tmp_path):
    folder, options = str(tmp_path / "state"), ContextOptions(tokenizer="native")
    batch = spark.createDataFrame([("a.rs", "/r/a.rs", 9, 1, "fn a() {}")], SCHEMA)

    def fail(deltas):
        raise RuntimeError("report failed")

    with pytest.raises(RuntimeError):
        run_batch(batch, options, folder, fail)
    assert [r.delta for r in run_batch(batch, options, folder).collect()] == ["added"]
    assert [r.delta for r in run_batch(batch, options, folder).collect()] == ["unchanged"]
