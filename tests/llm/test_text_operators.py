"""Operators that judge texts one by one, against plain Python."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusfold.llm import decontaminate, license_scan, quality_rules, toxicity, weak_quality, wordbytes

from .conftest import prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_measures(text):
    w = SPACE.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures(awkward, make):
    repeats = make(["a b c a b c d", "x\nx\n\ny | <z>\nx", "p q r s " * 40, None])
    for docs in (awkward, repeats):
        for r in quality_rules.measure(docs.select("doc_id", "text")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)


@pytest.mark.parametrize("k,n,p", [(0, 700, 0.01), (3, 900, 0.01), (50, 10_000, 0.01), (900, 100_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    from math import exp, lgamma, log

    want = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1))
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()
    assert row.x == pytest.approx(want, rel=1e-8)


def test_rules_keep_their_promise(spark, make, empty):
    clean = [prose(i, 80) for i in range(3000)]
    junk = [" ".join(w + "###" for w in prose(9000 + i, 80).split()) for i in range(50)]
    docs = make(clean + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(3000, 0)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.filter_quality(docs, labels).collect()}
    assert sum(kept[i] for i in range(3000)) >= 2850 and not any(kept[i] for i in range(3000, 3050))
    # without labels every rule stays off
    off = quality_rules.filter_quality(docs, labels.where("doc_id < 0")).collect()
    assert all(r.kept == (not r.base_failed) for r in off)
    assert quality_rules.filter_quality(empty, labels).collect() == []


def plain_hits(text, items, n=13):
    w = ITEM.findall((text or "").translate(DOWN))
    covered, found = set(), set()
    for item, t in items:
        v = ITEM.findall((t or "").translate(DOWN))
        k = min(len(v), n)
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wins:
                covered |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(covered), sorted(found)


def test_decontamination(spark, make, awkward, empty):
    items = [(1, prose(50, 30)), (2, "Short Item here"), (3, None), (4, "--"), (10, "one"), (10, "one"), (12, prose(51, 13)), (13, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    mixed = make([
        prose(60, 40) + " " + items[0][1][:90] + " " + prose(61, 9), items[0][1].upper().replace(" ", "--"), "short, ITEM: here!", "two words " * 5,
        prose(62, 3) + " " + items[6][1] + " " + items[6][1], prose(63, 200), None, "two",
    ])
    for docs in (mixed, awkward):
        for r in decontaminate.flag(docs.select("doc_id", "text"), bench).collect():
            n, hit, found = plain_hits(r.text, items)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontaminate.flag(empty, bench).collect() == []
    assert decontaminate.flag(mixed, bench.where("item_id < 0")).where("contaminated").count() == 0
    kept = decontaminate.remove_documents(mixed, bench)
    assert kept.columns == mixed.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(mixed, bench).collect()}
    assert cut[2] == "" and cut[5] == prose(63, 200) and cut[6] is None
    # a table that is too large to broadcast gives the same rows
    wide = decontaminate.flag(mixed.select("doc_id", "text"), bench, broadcast_anchors=0)
    assert sorted(wide.collect()) == sorted(decontaminate.flag(mixed.select("doc_id", "text"), bench).collect())


def test_license_versions_and_places(make):
    t = license_scan.TEMPLATES
    gpl, mit = t["gpl-3.0"], t["mit"]
    texts = [
        gpl.replace("version 3", "version 2"), gpl, f"{gpl} {gpl} x {gpl}", f"{mit} {prose(4, 500)} {mit}", gpl.replace("work", "program"),
        t["apache-2.0"].replace("2.0", "1.1"), t["agpl-3.0"].replace("version 3", "version 1"), f"{mit} {gpl}",
    ]
    rows = license_scan.scan_licenses(make(texts + texts[2:3])).collect()
    found = {r.doc_id: [(m.license, m.begin, m.end) for m in r.matches] for r in rows}
    n, k = len(gpl.split()), len(mit.split())
    assert found[0] == [] and found[5] == [] and found[6] == []
    assert found[1] == [("gpl-3.0", 0, n)]
    assert found[2] == found[8] == [("gpl-3.0", a, a + n) for a in (0, n, 2 * n + 1)]
    assert found[3] == [("mit", a, a + k) for a in (0, k + 500)]
    assert [name for name, _, _ in found[4]] == ["gpl-3.0"]
    assert found[7] == [("gpl-3.0", k, k + n), ("mit", 0, k)]


def test_licenses(make, awkward, empty):
    t = license_scan.TEMPLATES
    docs = make([
        prose(1, 40) + "\n" + t["mit"] + "\n" + prose(2, 40), t["gpl-3.0"].upper(), t["bsd"][:-8] + " " + prose(3, 9), None, "All rights reserved", "rights reserved",
        prose(4, 3000) + " " + t["apache-2.0"] + " " + t["cc-by-nc-4.0"],
    ])
    found = {r.doc_id: r.matches for r in license_scan.scan_licenses(docs).collect()}
    names = {i: [m.license for m in f] for i, f in found.items()}
    assert names == {0: ["mit"], 1: ["gpl-3.0"], 2: ["bsd"], 3: [], 4: ["all-rights-reserved"], 5: [], 6: ["apache-2.0", "cc-by-nc-4.0"]}
    assert (found[0][0].begin, found[0][0].end) == (40, 45)
    assert license_scan.scan_licenses(empty).collect() == []
    assert license_scan.scan_licenses(awkward).count() == 14
    with pytest.raises(ValueError):
        license_scan.compile_templates({"x": "too short"}, license_scan.ScanOptions())


def test_bands_meet_their_bound():
    o = license_scan.ScanOptions()
    for s in (0.1, 0.3, 0.7):
        assert (1 - s**o.rows) ** license_scan.bands(s, o) <= o.miss


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_bytes(awkward, lower):
    texts = [r.text for r in awkward.collect()] + ["ä b", "  lead", "trail  ", "\x00 \x1f"]
    words = wordbytes.find_words(pa.array(texts, pa.string()), lower=lower)
    plain = [SPACE.findall((t or "").translate(DOWN) if lower else t or "") for t in texts]
    assert [[words.text(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])] == plain
    flat = [w for p in plain for w in p]
    h = wordbytes.hash_words(words)
    assert len(set(h.tolist())) == len(set(flat)) and {flat[i]: h[i] for i in range(len(flat))} == dict(zip(flat, h))


def toxic_texts(n):
    rng = np.random.default_rng(5)
    toxic = rng.random(n) < 0.2
    return [prose(100 + i, 60) + (" zzuzz vile " + prose(i, 20) if t else "") for i, t in enumerate(toxic)], toxic.astype(int)


def test_toxicity(spark, make, awkward, empty):
    texts, y = toxic_texts(900)
    docs = make(texts)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if i < 600], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y[i] for i in range(600, 900)]) > 0.97
    scored = toxicity.score(awkward, model)
    assert scored.count() == 14 and scored.where("toxicity BETWEEN 0 AND 1").count() == 14
    assert toxicity.score(empty, model).collect() == []
    # no labels, and labels of one class
    none = toxicity.train(docs, labels.where("doc_id < 0"))
    assert toxicity.score(docs, none).where("toxicity <> 0.5").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("toxicity >= 0.5").count() == 0


def test_weak_labels(make, awkward, empty):
    clean = [prose(i, 80) for i in range(400)]
    junk = [" ".join(w + "$$$" for w in prose(i, 80).split()) for i in range(60)] + [("Aa " * 40) + prose(i, 20) for i in range(60)]
    docs = make(clean + junk)
    model = weak_quality.train(docs)
    kept = {r.doc_id: r.kept for r in weak_quality.score(docs, model).collect()}
    assert np.mean([kept[i] == (i < 400) for i in kept]) > 0.97
    assert weak_quality.score(awkward, model).where("quality BETWEEN 0 AND 1").count() == 14
    assert weak_quality.score(empty, weak_quality.train(empty)).collect() == []


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    votes = [["g" if v == (rng.random() < a) else "b" for v in y] for a in (0.95, 0.9, 0.6)]
    count = collections.Counter("".join(v) for v in zip(*votes))
    _, shares, prior = weak_quality.em(list(count), np.array(list(count.values()), dtype=float))
    assert prior == pytest.approx(0.7, abs=0.03)
    assert [round(float(s[1, 1]), 1) for s in shares] == [0.9, 0.9, 0.6] or shares[0, 1, 1] > shares[1, 1, 1] > shares[2, 1, 1]
