"""The keyed log behind snapshots, and contents, digests and existence looked up late."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusfold.options import ContextOptions
from corpusfold.plans import context as plan
from corpusfold.plans import reports
from corpusfold.sources import content, ignore, repo, state
from corpusfold.sources.keyed_log import KeyedLog, LogConflict
from corpusfold.sources.listing import list_tree
from corpusfold.sources.repo import SCHEMA
from corpusfold.streaming.incremental import run_batch

ROWS = "k string, v bigint, t string"


@pytest.fixture
def log(spark, tmp_path):
    return KeyedLog(spark, str(tmp_path / "it's a log"), ROWS, "k")


def rows(spark, *found):
    return spark.createDataFrame(list(found), ROWS)


def held(log, *columns):
    return sorted(tuple(r) for r in log.rows(*columns).collect())


def many(spark, n, v=0):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") + v).alias("v"), F.lit("t").alias("t"))


def test_latest_row_of_every_key(spark, log):
    assert held(log) == [] and log.commits() == [] and not log.clear()
    log.append(rows(spark, ("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)), meta={"of": ["x"]})
    log.append(rows(spark, ("b", 20, None), ("d", 4, "w")), rows(spark, ("a", 0, "")).select("k"))
    assert held(log) == [("b", 20, None), ("c", 3, None), ("d", 4, "w")]
    assert held(log, "v") == [("b", 20), ("c", 3), ("d", 4)]
    log.append(rows(spark, ("a", 9, "back")))
    assert held(log)[0] == ("a", 9, "back")
    assert [c.number for c in log.commits()] == [1, 2, 3] and log.commits()[-1].meta == {"of": ["x"]}


def test_a_change_writes_its_own_rows(spark, log):
    log.append(many(spark, 1000))
    done = log.append(many(spark, 10, 5))
    assert done.rows == 10
    assert spark.read.parquet(f"{log.path}/segments/segment={done.segment}").count() == 10
    assert log.rows().count() == 1000


def test_a_crash_before_publishing_leaves_nothing(spark, log):
    log.append(rows(spark, ("a", 1, "x")))
    log._write(log._shaped(rows(spark, ("b", 2, "y")), False), 8)
    # a commit that was begun and not finished: its number is taken, and it says nothing
    with open(f"{log.path}/log/{2:012d}.json", "w") as out:
        out.write('{"number": 2, "segm')
    assert held(log) == [("a", 1, "x")]
    log.append(rows(spark, ("c", 3, "z")))
    assert [c.number for c in log.commits()] == [1, 3]
    assert held(log) == [("a", 1, "x"), ("c", 3, "z")]
    assert log.vacuum() == 1 and held(log) == [("a", 1, "x"), ("c", 3, "z")]


def test_a_repeated_batch_is_one_change(spark, log):
    assert log.append(rows(spark, ("a", 1, "x")), batch=("s", 0))
    assert log.append(rows(spark, ("a", 2, "x")), batch=("s", 0)) is None
    assert log.append(rows(spark, ("b", 1, "x")), batch=("other", 0))
    log.compact()
    assert log.append(rows(spark, ("b", 2, "x")), batch=("other", 0)) is None
    assert log.append(rows(spark, ("b", 3, "x")), batch=("other", 1))
    assert held(log, "v") == [("a", 1), ("b", 3)]


def test_two_writers_of_one_number(spark, log):
    log.append(rows(spark, ("a", 1, "x")))
    number = log._next()
    log.append(rows(spark, ("a", 2, "first")), number=number)
    with pytest.raises(LogConflict):
        log.append(rows(spark, ("a", 3, "second")), number=number)
    assert held(log, "v") == [("a", 2)]


def test_compaction_gives_way_to_changes(spark, log, monkeypatch):
    log.append(rows(spark, ("a", 1, "x")))
    assert log.compact() is None
    log.append(rows(spark, ("b", 2, "x")))
    publish = log._publish

    def meanwhile(commit):
        if commit.reset:
            KeyedLog(spark, log.path, ROWS, "k").append(rows(spark, ("c", 3, "x")))
        publish(commit)

    monkeypatch.setattr(log, "_publish", meanwhile)
    with pytest.raises(LogConflict):
        log.compact()
    monkeypatch.undo()
    assert held(log, "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert log.compact().rows == 3 and len(log.commits()) == 1
    assert log.vacuum() == 4 and held(log, "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert log.clear() and held(log) == [] and log.vacuum() == 1
    assert not os.listdir(f"{log.path}/segments")


def test_joins_leave_the_log_where_it_is(spark, log):
    log.append(many(spark, 500), buckets=8)
    log.append(many(spark, 20, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = many(spark, 30).select("k", F.col("v").alias("w"))
        joined = other.join(log.rows("v"), "k", "left")
        text = joined._jdf.queryExecution().executedPlan().toString()
        # one exchange, that of the other side; the log's side is read by bucket and merged in place
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
        assert joined.where("v = w + 1").count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_streamed_batches_append(spark, tmp_path):
    folder, options = str(tmp_path / "state"), ContextOptions(tokenizer="native")

    def batch(n, mtime):
        return spark.createDataFrame([(f"f{i}.rs", f"/r/f{i}.rs", 9, mtime, f"fn a{i}() {{}}") for i in range(n)], SCHEMA)

    run_batch(batch(50, 1), options, folder, number=("s", 0))
    run_batch(batch(10, 2), options, folder, number=("s", 1))
    run_batch(batch(10, 2), options, folder, number=("s", 1))
    assert [c.rows for c in state.log(spark, folder).commits()] == [50, 10]
    assert sorted(r.n for r in state.load(spark, folder).entries.groupBy("mtime_ns").agg(F.count("*").alias("n")).collect()) == [10, 40]


def test_segments_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MAX_SEGMENTS", 2)
    folder = str(tmp_path / "state")
    for i in range(4):
        fresh = spark.createDataFrame([(f"/r/{i}", i, i, "f", "s", "t")], state.ENTRY_SCHEMA)
        assert state.update(fresh, None, folder, {"a": 1}, ("s", i))
        assert not state.update(fresh, None, folder, {"a": 1}, ("s", i))
    assert len(state.log(spark, folder).commits()) <= 2
    assert state.load(spark, folder).seen.count() == 4


# --- looked up late


def put(root, files):
    for name, data in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())
    return root


def test_contents_are_read_for_misses_alone(spark, tmp_path, monkeypatch):
    root = put(tmp_path / "r", {f"src/m{i}.rs": f"fn m{i}() {{}}\n" for i in range(6)})
    folder, options = str(tmp_path / "state"), ContextOptions(tokenizer="native", incremental=True)
    read = []

    def counted(rows):
        read.append(Observation())
        return fetch(rows, read[-1])

    fetch = content.fetch
    monkeypatch.setattr(content, "fetch", counted)

    def run():
        context = plan.repository_context(spark, str(root), options, state_path=folder, generated_at="0")
        plan.save_state(context, folder)
        return sorted(r.path for r in context.files.collect())

    assert len(run()) == 6 and read[-1].get["files"] == 6
    assert run() == [] and read[-1].get["files"] == 0
    put(root, {"src/m1.rs": "fn changed() {}\n", "src/new.rs": "fn new() {}\n"})
    assert run() == ["src/m1.rs", "src/new.rs"] and read[-1].get["files"] == 2
    assert state.log(spark, folder).commits()[-1].rows == 2


def test_files_of_unequal_length_are_not_read(spark, tmp_path):
    now = put(tmp_path / "now", {"same.rs": "fn a() {}", "other.rs": "fn b() {}", "long.rs": b"\xff\xfe longer", "new.rs": b"\xff"})
    base = put(tmp_path / "base", {"same.rs": "fn a() {}", "other.rs": "fn c() {}", "long.rs": b"\xff\xfe", "old.rs": b"\xfe"})
    options, seen = ContextOptions(), Observation()
    files, known = (repo.scan(spark, str(p), options, content=False) for p in (now, base))
    found = {r.path: r.delta for r in plan.against_files(files, known, seen).collect()}
    assert found == {"same.rs": "unchanged", "other.rs": "changed", "long.rs": "changed", "new.rs": "added"}
    assert seen.get["files"] == 4  # both sides of the two pairs of equal length


def test_entries_outside_of_the_root(spark, tmp_path):
    root = put(tmp_path / "r", {"a.rs": "fn a() {}", "b.rs": "fn b() {}"})
    away = put(tmp_path / "away", {"here.rs": "fn x() {}"})
    folder, options = str(tmp_path / "state"), ContextOptions(tokenizer="native", incremental=True)
    plan.save_state(plan.repository_context(spark, str(root), options, generated_at="0"), folder)
    outside = [(str(away / n), 9, 1, "f", "s", "t") for n in ("here.rs", "gone.rs")] + [(str(root / "sub\\gone.rs"), 1, 1, "f", "s", "t")]
    state.update(spark.createDataFrame(outside, state.ENTRY_SCHEMA), None, folder, options.selection())
    (root / "b.rs").unlink()
    context = plan.repository_context(spark, str(root), options, state_path=folder, generated_at="0")
    assert sorted(r.path for r in context.deleted.collect()) == sorted(["b.rs", str(away / "gone.rs"), "sub/gone.rs"])
    row = reports.snapshot_health(state.load(spark, folder)).first()
    assert (row.entries, row.stale_entries) == (5, 4)


def test_probe(spark, tmp_path):
    put(tmp_path, {"a.rs": "xy"})
    keys = spark.createDataFrame([(str(tmp_path / "a.rs"), 1), (str(tmp_path), 2), ("/no/such", 3)], "abs_path string, n bigint")
    found = {r.n: (r.now_exists, r.now_file, r.now_size) for r in content.probe(keys).collect()}
    assert found[1] == (True, True, 2) and found[2][:2] == (True, False) and found[3] == (False, False, None)
    assert content.probe(keys.where("n > 3")).collect() == []


# --- listing


def test_one_flat_and_one_deep_folder(spark, tmp_path):
    deep = "/".join(f"d{i}" for i in range(12))
    files = {f"flat/f{i:03}.rs": "x" * 3000 for i in range(200)} | {f"{deep}/g{i}.rs": "y" * 100 for i in range(20)} | {"_a/.b/c.md": "z"}
    root = put(tmp_path / "r", files)
    listed = list_tree(spark, str(root), with_git=True)
    assert sorted(r.path for r in listed.collect()) == sorted(files)
    parts = content.spread(listed, 30000).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum("size").alias("n")).collect()
    assert len(parts) > 15 and max(r.n for r in parts) <= 36000
    read = repo.scan(spark, str(root), ContextOptions())
    assert {r.path: r.content for r in read.collect()} == files


def test_rules_are_carried_down(spark, tmp_path):
    files = {
        "keep.rs": "", "drop.rs": "", "a/keep.rs": "", "a/drop.rs": "", "a/b/drop.rs": "", "a/b/c/only.rs": "", "gen/x.rs": "", "a/gen/y.rs": "",
        ".gitignore": "drop.rs\n/gen/\n", "a/b/.gitignore": "!drop.rs\n", "a/b/c/.ignore": "*.rs\n", "a/.cursorignore": "gen/\n",
    }
    root = put(tmp_path / "top/r", files)
    put(tmp_path / "top", {".ignore": "keep.rs\n"})
    (root / ".git/info").mkdir(parents=True)
    (root / ".git/info/exclude").write_text("nothing\n")
    found = sorted(r.path for r in list_tree(spark, str(root), with_git=True).collect())
    assert found == ["a/b/drop.rs"]
    assert "keep.rs" in {r.path for r in list_tree(spark, str(root), with_git=False).collect()}
    assert len(list_tree(spark, str(root), with_git=True, everything=True).collect()) == 8
    assert ignore.top_of(str(root / "a")) == str(root)
    with pytest.raises(FileNotFoundError):
        list_tree(spark, str(root / "none"), with_git=True)
