"""The closed forms of the greedy rules against step-by-step simulations."""

import random

import pytest

from corpusfold.operators import budget

NAMES = ["README.md", "a/b/main.rs", "a/b/c/leaf.py", "a/x.rs", "deep/er/still/y.go", "Cargo.toml", "z.ts", "q/é.md"]
MANIFESTS = {"README.md", "Cargo.toml"}


def priority(path):
    name = path.rsplit("/", 1)[-1]
    if name in MANIFESTS:
        return 5000
    if name == "main.rs":
        return 4000
    return 2000 if name.endswith(".md") else 0


def key(path, tokens):
    return (1000 * path.count("/") + len(path.encode()) + tokens - priority(path), tokens, path.encode())


def simulate_downgrades(files, limit):
    levels = {path: level for path, level, *_ in files}
    tokens = {path: {1: t1, 2: t2, 3: t3} for path, _, t1, t2, t3 in files}

    def now(path):
        return tokens[path][levels[path]]

    while sum(map(now, levels)) > limit:
        open_files = [p for p in levels if levels[p] < 3]
        if not open_files:
            break
        levels[max(open_files, key=lambda p: key(p, now(p)))] += 1
    return levels


def simulate_drops(files, limit):
    kept = dict(files)
    while sum(kept.values()) > limit and len(kept) > 1:
        worst = max(kept, key=lambda p: (-priority(p), kept[p], p.encode()))
        del kept[worst]
    return set(kept)


def random_files(rng):
    names = rng.sample(NAMES, rng.randint(2, len(NAMES)))
    # small numbers make ties and skeletons longer than their text likely
    return [(n, rng.randint(1, 3), rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 6)) for n in names]


@pytest.mark.parametrize("seed", range(8))
def test_downgrades_match_simulation(spark, seed):
    rng = random.Random(seed)
    files = random_files(rng)
    start = sum({1: t1, 2: t2, 3: t3}[level] for _, level, t1, t2, t3 in files)
    limit = rng.randint(0, start)
    df = spark.createDataFrame(files, "path string, level int, t1 bigint, t2 bigint, t3 bigint")
    found = {row.path: row.level for row in budget.optimize(df, limit).collect()}
    assert found == simulate_downgrades(files, limit)


@pytest.mark.parametrize("seed", range(5))
def test_drops_match_simulation(spark, seed):
    rng = random.Random(100 + seed)
    files = [(name, rng.randint(1, 5)) for name in rng.sample(NAMES, rng.randint(1, len(NAMES)))]
    limit = rng.randint(0, sum(t for _, t in files))
    df = spark.createDataFrame([(p, t, t) for p, t in files], "path string, tokens bigint, cost bigint")
    found = {row.path for row in budget.drop_low_priority(df, limit).collect()}
    assert found == simulate_drops(files, limit)


def test_running_totals_survive_a_hot_key(spark):
    """A third of all rows share the leading sort key; the totals stay exact over all partitions."""
    from pyspark.sql import functions as F

    from corpusfold.operators.prefix import running_totals

    rows = spark.range(3000).select(
        F.struct(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("b")).alias("k"),
        (F.col("id") % 11).alias("v"),
    )
    got = {tuple(r.k): r.total for r in running_totals(rows, F.col("k").desc(), {"total": F.col("v")}).collect()}
    total = 0
    for a, b in sorted(((7 if i % 3 == 0 else i % 50, i) for i in range(3000)), reverse=True):
        total += b % 11
        assert got[(a, b)] == total


def test_levels_are_checked(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="level must be"):
        spark.range(1).select(budget.checked_level(F.lit(4))).collect()
