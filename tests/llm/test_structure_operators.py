"""Spelling variants, source mixing and conversation repair against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusfold.llm import curriculum, spelling, structure_repair
from corpusfold.llm.curriculum import MixOptions
from corpusfold.llm.spelling import SpellingOptions

# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, options):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if options.damage_every and h % options.damage_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= options.min_count and len(w) >= options.min_length}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= options.ratio * words[w] else None
    result = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        result.add((w, words[w], len(near[w]), form[w], None if form[w] is None else words[form[w]], root))
    return result


def variants_of(df, options):
    found = spelling.group_variants(df, options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r.word for r in found}) == len(found)
    return {tuple(r) for r in found}


def test_variants_against_all_pairs(make):
    rng = random.Random(5)
    base = ["".join(rng.choice("abeÉéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = []
    for _ in range(160):
        words = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("abeéx"), w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "1", "×", "_"]).join(words))
    docs = make(texts)
    for options in (SpellingOptions(damage_every=7), SpellingOptions(min_length=4, min_count=2, ratio=3)):
        expected = plain_variants([(i, t) for i, t in enumerate(texts)], options)
        assert any(row[3] for row in expected) and any(row[5] not in (row[0], row[3]) for row in expected)
        assert variants_of(docs, options) == expected


def test_variants_follow_chains_and_break_ties(make):
    text = " ".join(["kitten"] * 40 + ["kittens"] * 20 + ["kittenss"] * 10 + ["kittensss"] * 5 + ["mitten"] * 40 + ["zitten"] * 3)
    found = {r[0]: r for r in variants_of(make([text]), SpellingOptions())}
    assert found["kittensss"][3:] == ("kittenss", 10, "kitten")
    assert found["zitten"][3:] == ("kitten", 40, "kitten")
    assert found["mitten"][3:] == (None, None, "mitten")


def test_variants_of_awkward_rows(awkward, empty):
    options = SpellingOptions(damage_every=3)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert variants_of(awkward, options) == plain_variants(rows, options)
    assert variants_of(empty, options) == set()


def test_long_words(make):
    long = "abcdefghij" * 60
    found = variants_of(make([" ".join([long] * 6 + [long + "k"] * 3 + [long[:-1] + "z"] * 3)]), SpellingOptions())
    assert {(r[1], r[2], r[5]) for r in found} == {(6, 2, long), (3, 1, long)}


# --- mixing sources


def plain_targets(sizes: dict, most: int = 3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, among = total - sum(fixed.values()), sum(weight[s] for s in free)
        shares = {s: rest * weight[s] / among for s in free}
        above = {s: most * sizes[s] for s in free if shares[s] > most * sizes[s]}
        if not above:
            return fixed | shares
        fixed |= above


def sourced(make, texts, sources):
    rows = list(zip(range(len(texts)), texts, sources))
    docs = make(texts).drop("source")
    named = docs.sparkSession.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string")
    return docs.join(named, "doc_id")


def test_mix_meets_its_targets(make):
    rng = random.Random(3)
    names = ["a", "b", "é", "😀", "B", None, "c" * 30, ""]
    weights = [60, 1, 3, 1, 1, 5, 1, 2]
    sources = rng.choices(names, weights, k=400)
    texts = [rng.choice([None, "", "x " * rng.randint(1, 60), "one two"]) for _ in sources]
    docs = sourced(make, texts, sources)
    rows = curriculum.mixed(docs).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    expected = plain_targets(sizes)
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in rows) == list(range(400))
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source == sources[r.doc_id]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(expected[s] + 1e-9) for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, curriculum.mixed(docs.repartition(7)).collect()))


def test_schedules_are_followed(make):
    """At any time a source has handed out the integral of its schedule, and the order is that of time."""
    texts = ["w " * 10] * 300
    docs = sourced(make, texts, [("a", "b", "c")[i % 3] for i in range(300)])
    options = MixOptions()
    uses = curriculum.training_order(curriculum.curriculum(docs, options)).orderBy("start").collect()
    assert [u.start for u in uses] == list(itertools.accumulate([u.words for u in uses[:-1]], initial=0))
    assert [u.time for u in uses] == sorted(u.time for u in uses)
    for k, name in enumerate("abc"):
        knots = options.schedules[k]
        handed = 0
        for u in (u for u in uses if u.source == name):
            steps = 2000
            value = lambda t: next(w + (v - w) * (t - a) / (b - a) for (a, w), (b, v) in zip(knots, knots[1:]) if t <= b)
            integral = sum(value((i + 0.5) / steps * u.time) for i in range(steps)) / steps * u.time
            assert handed / u.target == pytest.approx(integral / curriculum.integrals(knots)[-1], abs=1e-6)
            handed += u.words
    first = [u.source for u in uses[:60]]
    assert first.count("c") > 2 * first.count("a")


def test_mix_of_awkward_rows(awkward, empty, make):
    rows = curriculum.mixed(awkward).collect()
    assert len(rows) == awkward.count()
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert curriculum.mixed(empty).collect() == []
    nothing = curriculum.mixed(make([None, "", " "])).collect()
    assert [(r.size, r.target, r.taken, r.first_start) for r in nothing] == [(0, 0.0, 0, None)] * 3


# --- conversation repair

CLASSES = [(c, go, cut) for c in ("s", "u", "a", "") for go, cut in ((False, False), (True, False), (False, True))]


def spelled(rows) -> tuple[int, str]:
    """By the table of steps."""
    steps = structure_repair.Steps()
    talk = structure_repair.Conversation("1", steps, structure_repair.Spill(3, 1000))
    for row in rows:
        step = steps.take(talk.paths, row)
        talk.paths, talk.cost = steps.after[step], talk.cost + steps.rise[step]
        talk.spill.add(step, "", "")
    audit = talk.audit()
    talk.spill.close()
    return talk.cost, audit


def every_way(rows) -> tuple[int, str]:
    """By looking at every sequence of edits with at most two inserts at each place."""
    inserts = [(3 * len(w), "I" * len(w), w) for k in range(3) for w in map("".join, itertools.product("ua", repeat=k))]

    def edits(row):
        initial, go, cut = row
        yield 4, "D", ""
        if not go:
            extra = 3 * cut
            yield extra, "K", initial or "x"
            yield 3 + extra, "R", "u"
            yield 3 + extra, "R", "a"

    places = [inserts]
    for row in rows:
        places += [list(edits(row)), inserts]
    ways = (tuple(map(sum_up, zip(*way))) for way in itertools.product(*places))
    return min((cost, letters) for cost, letters, roles in ways if re.fullmatch("(s?(ua)+)?", roles))


def sum_up(parts):
    return sum(parts) if isinstance(parts[0], int) else "".join(parts)


def plain_repair(rows) -> tuple[int, str]:
    """State by state with whole spellings."""
    best = {"": (0, "")}
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(known):
        known = dict(known)
        for _ in range(3):
            for q, (cost, letters) in list(known.items()):
                for to in moves[q].replace("s", ""):
                    known[to] = min(known.get(to, (1 << 30, "")), (cost + 3, letters + "I"))
        return known

    for initial, go, cut in rows:
        after = {}
        for q, (cost, letters) in inserted(best).items():
            ways = [(q, 4, "D")]
            if not go:
                ways += [(to, 3 + 3 * cut, "R") for to in moves[q].replace("s", "")]
                ways += [(initial, 3 * cut, "K")] if initial and initial in moves[q] else []
            for to, price, letter in ways:
                after[to] = min(after.get(to, (1 << 30, "")), (cost + price, letters + letter))
        best = after
    return min(v for q, v in inserted(best).items() if q in ("", "a"))


def test_steps_against_every_way():
    assert spelled([]) == (0, "")
    for n in (1, 2):
        for rows in itertools.product(CLASSES, repeat=n):
            assert spelled(rows) == every_way(rows) == plain_repair(rows)


def test_steps_against_whole_spellings():
    rng = random.Random(8)
    for _ in range(400):
        rows = [rng.choice(CLASSES) for _ in range(rng.randint(1, 25))]
        assert spelled(rows) == plain_repair(rows)


def plain_report(rows):
    """Report of one conversation given as (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, spaces = set(), [], " \t\n\x0b\x0c\r"
    for _, role, text in rows:
        bare = text.strip(spaces)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = plain_repair([(r[1][:1] if r[1][:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
    out, left = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter in "RI":
            role = "assistant" if out and out[-1].startswith("u") else "user"
        if letter != "D":
            out.append(f"{role}:{text}")
    initials = [r[1][:1] for r in rows]
    return (
        len(rows), max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    ), out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(0, 12)):
            turn = rng.choice([turn, turn, turn + 3, None, turn // 2])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "", " \n", None, "cut off", "Really? \t", "é.\nb", "Yes."])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.fixture(scope="module")
def talk_table(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for name in ("conv", "kind", "copy", "blank", "_d", "_at", "_first", "place"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(5)


def test_reports_against_plain(talks, talk_table):
    groups = defaultdict(list)
    for conv, *row in talks:
        groups[conv].append(row)
    expected = {conv: plain_report(rows)[0] for conv, rows in groups.items()}
    assert {r.conv_id: tuple(r)[1:] for r in structure_repair.reports(talk_table).collect()} == expected
    spilled = structure_repair.reports(talk_table, most_pointers=2, most_chars=50).collect()
    assert {r.conv_id: tuple(r)[1:] for r in spilled} == expected


def test_repaired_rows(talks, talk_table):
    groups, found = defaultdict(list), defaultdict(list)
    for conv, *row in talks:
        groups[conv].append(row)
    for r in structure_repair.repair(talk_table, most_chars=300).collect():
        if r.edit != "D":
            found[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for conv, rows in groups.items():
        assert [text for _, text in sorted(found[conv])] == plain_report(rows)[1]
        assert [place for place, _ in sorted(found[conv])] == list(range(len(found[conv])))


def test_damage(spark, talks, talk_table):
    expected = defaultdict(list)
    for conv, turn, role, text in talks:
        named = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(named).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows = expected[conv]
        rows += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = structure_repair.reports(structure_repair.damaged(talk_table)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {conv: plain_report(rows)[0] for conv, rows in expected.items()}
    gone = spark.createDataFrame([(7, 0, "user", "x", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert [tuple(r) for r in structure_repair.reports(gone).collect()] == [(7, 0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert structure_repair.reports(structure_repair.damaged(talk_table.where("conv_id < 0"))).collect() == []


def test_giant_conversation(spark):
    n = 30000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 7 == 3, "user").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("line "), F.col("id"), F.when(F.col("id") % 5 == 0, "").otherwise(".")).alias("text"),
    )
    plain = plain_report([tuple(r) for r in rows.select("turn", "role", "text").collect()])[0] if n < 2000 else None
    a = structure_repair.reports(rows).collect()
    b = structure_repair.reports(rows, most_pointers=1000, most_chars=10000).collect()
    assert a == b and a[0].n_rows == n and len(a[0].audit) >= n and plain is None
