"""Records found from any split, one file written by many tasks, and edits by spans."""

import random

import pytest
from pyspark.sql import functions as F

from corpusfold.operators import spans
from corpusfold.operators.sink import write_single
from corpusfold.sources.nul_records import read_records


def decoded(raw: str) -> list[tuple]:
    """The same records, one cell after the other."""
    found, cells = [], iter([cell for cell in raw.split("\0") if cell])
    for seq, status in enumerate(cells):
        old = next(cells) if status[0] in "RC" else None
        found.append((seq, status, old, next(cells)))
    return found


RAW = "M\0a.rs\0R100\0old.rs\0M\0D\0R\0C75\0M\0A\0A\0é.rs\0D\0R100\0"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 11, 16, 1000])
def test_records_of_a_file_cut_anywhere(spark, tmp_path, size):
    (tmp_path / "cells").write_text(RAW)
    confs = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size), "spark.sql.files.minPartitionNum": "100"}
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        found = sorted(tuple(r) for r in read_records(spark, str(tmp_path / "cells")).collect())
    finally:
        for name in confs:
            spark.conf.unset(name)
    assert found == decoded(RAW)
    assert len(found) == 6


def test_records_cut_short(spark, tmp_path):
    (tmp_path / "short").write_text("M\0a\0R100\0b")
    with pytest.raises(ValueError, match="invalid git diff --name-status output"):
        read_records(spark, str(tmp_path / "short"))
    (tmp_path / "empty").write_text("")
    assert read_records(spark, str(tmp_path / "empty")).collect() == []


def test_one_file_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé😀\n ") for _ in range(rng.choice([0, 1, 50, 3000]))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string").repartition(13)
    target = tmp_path / "out.txt"
    target.write_text("something longer that was here before" * 1000)
    n = write_single(rows, F.col("n"), F.col("t"), str(target))
    assert target.read_bytes() == "".join(texts).encode() and n == len("".join(texts).encode())
    assert write_single(rows.where("n < 0"), F.col("n"), F.col("t"), str(target)) == 0
    assert target.read_bytes() == b"" and not (tmp_path / "out.txt.partial").exists()


def replaced(text: str, edits: list[tuple]) -> str:
    out, at = "", 0
    for start, end, value in sorted(edits, key=lambda e: (e[0], -e[1], e[2])):
        if start >= at:
            out, at = out + text[at:start] + value, end
    return out + text[at:]


def nested(rng, low: int, high: int, depth: int = 0) -> list[tuple]:
    found = []
    while low < high and depth < 4:
        start = rng.randint(low, high)
        end = rng.randint(start, high)
        if rng.random() < 0.6:
            found.append((start, end, rng.choice(["", "<é>", "..."])))
        found += nested(rng, start, end, depth + 1)
        low = end + 1
    return found


def test_edits_by_nested_spans(spark):
    rng = random.Random(2)
    texts = {i: "".join(rng.choice("abé😀\n") for _ in range(rng.choice([0, 5, 60]))) for i in range(60)}
    edits = {i: nested(rng, 0, len(t)) for i, t in texts.items()}
    rows = [(i, *edit) for i, found in edits.items() for edit in found]
    files = spark.createDataFrame(list(texts.items()), "id long, content string")
    table = spark.createDataFrame(rows, "id long, start long, end long, value string")
    # one empty span inside another place's start would be ambiguous in order; the plain version orders the same way
    found = {r.id: r.content for r in spans.splice(files, table, "id").collect()}
    assert found == {i: replaced(t, edits[i]) for i, t in texts.items()}
    assert len(rows) > spans.outermost(table, "id").count() > 50
