"""Whole runs over small repositories on disk."""

import os
import subprocess

import pytest
import regex

from corpusfold.functions.tokens import TOKEN, Counter
from corpusfold.operators import compress
from corpusfold.options import ContextOptions
from corpusfold.plans import context as plan
from corpusfold.plans import reports
from corpusfold.sources import repo, state

TOML = '[package]\nname = "windmill"\nedition = "2024"\n'
LIB = 'pub fn grind(sacks: u32, stone: &Stone) -> Flour {\n    let speed = stone.turns();\n    Flour::of(sacks * speed)\n}\n'


def write(root, files):
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    return root


@pytest.fixture
def demo(tmp_path):
    return write(tmp_path / "demo", {"Cargo.toml": TOML, "src/lib.rs": LIB})


def options(**changes):
    return ContextOptions(**{"tokenizer": "native", "max_tokens": 12000, **changes})


def build(spark, root, opts, **more):
    return plan.repository_context(spark, str(root), opts, generated_at="0", **more)


def count(text):
    return len(regex.findall(TOKEN, text))


def paths(df):
    return sorted(row.path for row in df.select("path").collect())


def test_xml_document(spark, demo):
    context = build(spark, demo, options(), with_raw_tokens=True)
    text = context.text()
    assert text == (
        f'<repository_context>\n<metadata generated_at="0" repo_root="{demo}" max_tokens="12000" compression_level="2" file_count="2" />\n'
        '<project_map>\n<entry path="Cargo.toml" level="2" tokens="13" />\n<entry path="src/lib.rs" level="2" tokens="21" />\n</project_map>\n'
        '<files>\n<file path="Cargo.toml" level="2" tokens="13">[package]\nname = &quot;windmill&quot;\nedition = &quot;2024&quot;</file>\n'
        '<file path="src/lib.rs" level="2" tokens="21">pub fn grind(sacks: u32, stone: &amp;Stone) -&gt; Flour { ... }\n</file>\n</files>\n</repository_context>\n'
    )
    assert context.output_tokens == count(text)
    assert context.raw_tokens > context.output_tokens
    stats = reports.run_stats(context).first()
    assert stats.tokens_saved == stats.raw_tokens - stats.shrunk_tokens
    assert list(reports.dry_run_lines(context))[-2:] == ["  Cargo.toml  L2  13 tokens", "  src/lib.rs  L2  21 tokens"]
    assert "token_distribution: min=13, median=17.0, mean=17.0, max=21" in "\n".join(reports.detailed_lines(context))


def test_json_and_text_documents(spark, demo):
    context = build(spark, demo, options(format="json"))
    assert context.text() == (
        f'{{\n  "metadata": {{"generated_at":"0","repo_root":"{demo}","max_tokens":12000,"compression_level":2,"file_count":2}},\n'
        '  "project_map": [\n    {"path":"Cargo.toml","level":2,"tokens":13},\n    {"path":"src/lib.rs","level":2,"tokens":21}\n  ],\n'
        '  "files": [\n    {"path":"Cargo.toml","level":2,"tokens":13,"content":"[package]\\nname = \\"windmill\\"\\nedition = \\"2024\\""},\n'
        '    {"path":"src/lib.rs","level":2,"tokens":21,"content":"pub fn grind(sacks: u32, stone: &Stone) -> Flour { ... }\\n"}\n  ]\n}\n'
    )
    assert context.output_tokens == count(context.text())
    context = build(spark, demo, options(format="text", project_map="compact", directory_summaries=True, prompt=True))
    text = context.text()
    assert "\nproject_map compact\n[.] files=1 tokens=13\nCargo.toml L2 tokens=13\n[src] files=1 tokens=21\nlib.rs L2 tokens=21\n\n" in text
    assert "directory_summaries\n. files=1 tokens=13\nsrc files=1 tokens=21\n\nfiles\n--- Cargo.toml L2 tokens=13\n" in text
    assert text.endswith("pub fn grind(sacks: u32, stone: &Stone) -> Flour { ... }\n</context>\n")
    assert context.output_tokens == count(text)


def test_hashes_only_map(spark, demo):
    text = build(spark, demo, options(project_map_only=True, file_hashes=True, token_counts=False)).text()
    assert text.splitlines()[1] == (
        '<entry path="Cargo.toml" level="2" hash="f13d8910e82df407b31a804b88c157e1928d3eae6b7be6d619005a93e51e5077" />'
    )
    assert len(text.splitlines()) == 4


def test_written_parts_concatenate_to_the_document(spark, demo, tmp_path):
    context = build(spark, demo, options())
    context.write(str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == context.text()


def test_selection(spark, tmp_path):
    root = write(tmp_path / "flags", {
        ".gitignore": "ignored.rs\nlogs/\n", "src/lib.rs": "x", "src/skip.rs": "x", "src/client.min.js": "x", "src/generated.ts": "x",
        "tests/test.rs": "x", "vendor/lib.rs": "x", "dist/app.js": "x", "package-lock.json": "{}", "ignored.rs": "x",
        ".github/workflows/ci.yml": "a: b", "pkg/__init__.py": "", "logs/a.rs": "x", ".cursorignore": "cursed.rs\n",
        "cursed.rs": "x", "notes.txt": "x", "big.rs": "x" * 2000,
    })
    (root / ".git").mkdir()
    everything = paths(repo.scan(spark, str(root), options()))
    assert everything == sorted([
        "src/lib.rs", "src/skip.rs", "src/client.min.js", "src/generated.ts", "tests/test.rs", "vendor/lib.rs", "dist/app.js",
        "package-lock.json", ".github/workflows/ci.yml", "pkg/__init__.py", "big.rs",
    ])
    kept = paths(repo.scan(spark, str(root), options(exclude_generated=True, max_file_bytes=1000)))
    assert kept == [".github/workflows/ci.yml", "pkg/__init__.py", "src/lib.rs", "src/skip.rs", "tests/test.rs"]
    wanted = options(exclude_generated=True, include=("src/**", "dist/**"), exclude=("*skip*",))
    assert paths(repo.scan(spark, str(root), wanted)) == ["dist/app.js", "src/client.min.js", "src/generated.ts", "src/lib.rs"]
    loose = paths(repo.scan(spark, str(root), options(respect_gitignore=False)))
    assert "ignored.rs" in loose and "cursed.rs" not in loose


def test_bad_bytes_are_an_error(spark, tmp_path):
    root = write(tmp_path / "bad", {"a.rs": "x"})
    (root / "b.rs").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="cannot read source file"):
        repo.scan(spark, str(root), options()).collect()


def test_incremental_runs(spark, demo, tmp_path):
    folder = str(tmp_path / "state")
    incremental = options(incremental=True)
    first = build(spark, demo, incremental, state_path=folder)
    plan.save_state(first, folder)
    assert paths(first.files) == ["Cargo.toml", "src/lib.rs"]

    (demo / "src/lib.rs").write_text(LIB + "\npub fn sift(flour: Flour) -> Bran {\n    flour.rest()\n}\n")
    (demo / "Cargo.toml").unlink()
    second = build(spark, demo, incremental, state_path=folder)
    assert paths(second.files) == ["src/lib.rs"]
    assert paths(second.deleted) == ["Cargo.toml"]
    assert '<deleted path="Cargo.toml" />' in second.text()
    assert reports.incremental_text(second).splitlines()[1:] == [
        "  added: 0", "  changed: 1", "  unchanged: 0", "  skipped: 0", "  deleted: 1",
    ]
    plan.save_state(second, folder)
    assert [r.abs_path for r in state.load(spark, folder).entries.collect()] == [str(demo / "src/lib.rs")]

    other = build(spark, demo, options(incremental=True, exclude=("*.toml",)), state_path=folder)
    assert paths(other.files) == ["src/lib.rs"]
    row = reports.snapshot_health(state.load(spark, folder)).first()
    assert (row.entries, row.stale_entries) == (1, 0)
    assert state.clear(spark, folder) and not state.clear(spark, folder)


def test_base_directory(spark, demo, tmp_path):
    base = write(tmp_path / "base", {"Cargo.toml": TOML, "src/lib.rs": LIB.replace("speed", "pace"), "src/old.rs": "fn rust_away() {}\n"})
    context = build(spark, demo, options(), incremental_base=str(base))
    assert paths(context.files) == ["src/lib.rs"]
    assert paths(context.deleted) == ["src/old.rs"]


def test_changes_since_a_commit(spark, demo):
    def git(*args):
        env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null"}
        subprocess.run(["git", "-C", str(demo), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "start")
    (demo / "src/lib.rs").write_text(LIB + "\npub fn oil_axle() {}\n")
    write(demo, {"src/sail.rs": "pub struct Sail;\n", "src/brake.rs": "pub struct Brake;\n"})
    git("add", "src/sail.rs")
    (demo / "Cargo.toml").unlink()
    context = build(spark, demo, options(max_tokens=4000), changed_since="HEAD")
    assert reports.incremental_text(context).splitlines()[1:] == [
        "  added: 2", "  changed: 1", "  unchanged: 0", "  skipped: 0", "  deleted: 1",
    ]
    assert paths(context.files) == ["src/brake.rs", "src/lib.rs", "src/sail.rs"]


def simulate(context_options, table, fixed_text, renderer_text):
    """The greedy rule on real documents: format, count, downgrade or drop, repeat."""
    from tests.test_budget import key, priority

    files = {path: [level, texts] for path, level, texts in table}
    content = lambda p: files[p][1][files[p][0]]
    limit = context_options.max_tokens

    def take_step():
        candidates = [p for p in files if files[p][0] < 3]
        if not candidates:
            return False
        files[max(candidates, key=lambda p: key(p, count(content(p))))][0] += 1
        return True

    budget = max(limit - fixed_text, 0)
    while sum(count(content(p)) for p in files) > budget and take_step():
        pass
    while count(renderer_text(files)) > limit:
        if take_step():
            continue
        if not context_options.drop_low_priority or len(files) == 1:
            break
        del files[max(files, key=lambda p: (-priority(p), count(content(p)), p.encode()))]
    return {p: files[p][0] for p in files}


@pytest.mark.parametrize("limit", [420, 150])
def test_fit_matches_reformatting_loop(spark, tmp_path, limit):
    body = "    let x = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12];\n" * 3
    root = write(tmp_path / "fit", {
        "README.md": "# Title\n\nSome <text> & more.\n", "src/a.rs": "use b::c;\n\nfn a() {\n" + body + "}\n",
        "src/deep/b.rs": "// note\nfn b() {\n" + body + body + "}\n", "c.rs": "fn c() {}\n\n// tail & tail & tail\n",
    })
    opts = options(level=1, max_tokens=limit, drop_low_priority=True, directory_summaries=True)
    context = build(spark, root, opts)
    rows = context.variants.collect()
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")

    def document(files, empty=False):
        shown = {p: "" if empty else v[1][v[0]] for p, v in sorted(files.items())}
        tokens = {p: count(t) for p, t in shown.items()}
        folders = {}
        for p in shown:
            n, t = folders.get(p.rpartition("/")[0] or ".", (0, 0))
            folders[p.rpartition("/")[0] or "."] = (n + 1, t + tokens[p])
        level = {p: v[0] for p, v in files.items()}
        return "".join([
            f'<repository_context>\n<metadata generated_at="0" repo_root="{root}" max_tokens="{limit}" compression_level="1" file_count="{len(files)}" />\n<project_map>\n',
            *[f'<entry path="{p}" level="{level[p]}" tokens="{tokens[p]}" />\n' for p in shown], "</project_map>\n<directory_summaries>\n",
            *[f'<directory path="{d}" files="{n}" tokens="{t}" />\n' for d, (n, t) in sorted(folders.items())], "</directory_summaries>\n<files>\n",
            *[f'<file path="{p}" level="{level[p]}" tokens="{tokens[p]}">{escape(t)}</file>\n' for p, t in shown.items()], "</files>\n</repository_context>\n",
        ])

    table = [(r.path, 1, {1: r.full, 2: r.skeleton, 3: r.tree_map}) for r in rows]
    reserved = count(document({p: [1, t] for p, _, t in table}, empty=True))
    expected = simulate(opts, table, reserved, document)
    assert {r.path: r.level for r in context.files.collect()} == expected
    assert context.files_dropped == 4 - len(expected)
    assert context.output_tokens == count(context.text())


@pytest.mark.parametrize("fmt, layout", [("json", "flat"), ("json", "compact"), ("text", "compact"), ("xml", "flat")])
def test_file_costs_and_frame_add_up_to_the_document(spark, fmt, layout):
    from pyspark.sql import functions as F

    from corpusfold.functions.tokens import Counter
    from corpusfold.operators import render

    opts, native = options(format=fmt, project_map=layout, directory_summaries=True), Counter("native")
    renderer = render.Renderer(opts)
    rows = [("a.rs", 1, 12, "h", 'x "y" & <z>\n'), ("src/b.rs", 2, 7, "h", "q"), ("src/c.rs", 3, 0, "h", "")]
    files = spark.createDataFrame(rows, "path string, level int, tokens bigint, hash string, content string")
    blocks = renderer.blocks(files, None, render.Metadata("0", "/r", 9, 1))
    cost = renderer.file_cost(native, *[F.col(c) for c in ("path", "level", "tokens", "hash", "content")])
    frame = render.frame_tokens(blocks, opts, native)
    assert frame + files.agg(F.sum(cost).alias("n")).first().n == count(render.document_text(blocks))


def test_limits_and_empty_selections(spark, demo, tmp_path):
    with pytest.raises(plan.OverBudget):
        build(spark, demo, options(max_tokens=5, fail_over_budget=True))
    empty = write(tmp_path / "none", {"a.txt": "x"})
    with pytest.raises(plan.EmptySelection):
        build(spark, empty, options(fail_on_empty=True))
    context = build(spark, empty, options(format="json"))
    assert context.warnings and '"project_map": [\n\n  ]' in context.text()


def test_map_only_and_caps(spark, demo):
    context = build(spark, demo, options(map_only_under=20000))
    assert {r.level for r in context.files.collect()} == {3}
    assert "<files>" not in context.text() and "<directory_summaries>" in context.text()
    capped = build(spark, demo, options(max_file_tokens=6))
    assert {r.path: (r.level, r.tokens) for r in capped.files.collect()} == {"Cargo.toml": (3, 6), "src/lib.rs": (3, 6)}


def test_doctor(spark, demo):
    report = reports.doctor(spark, str(demo), None, "native")
    assert report["tokenizer"]["available"] and len(report["parsers"]) == 26
    assert {p["mode"] for p in report["parsers"] if p["extension"] in (".rs", ".md")} == {"tree-sitter", "compact"}
    assert "  tokenizer: native (ok)" in reports.doctor_text(report)


def test_edited_and_parent_ignore_files(spark, tmp_path):
    root = write(tmp_path / "tree/inner", {"a.rs": "x", "b.rs": "x", "c.rs": "x", ".gitignore": "b.rs\n"})
    (root / ".git").mkdir()
    write(tmp_path / "tree", {".ignore": "c.rs\n"})
    assert paths(repo.scan(spark, str(root), options())) == ["a.rs"]
    (root / ".gitignore").write_text("a.rs # no longer b\n".replace(" # no longer b", ""))
    assert paths(repo.scan(spark, str(root), options())) == ["b.rs"]


def test_damaged_state_counts_as_empty(spark, demo, tmp_path):
    folder = tmp_path / "state"
    plan.save_state(build(spark, demo, options()), str(folder))
    assert state.load(spark, str(folder)).entries.count() == 2
    for part in folder.glob("segments/*/part-*.parquet"):
        part.write_bytes(b"damaged")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert state.load(spark, str(folder)).entries.count() == 0


def test_unpublished_version_leaves_the_old_one(spark, demo, tmp_path):
    folder = str(tmp_path / "state")
    context = build(spark, demo, options())
    plan.save_state(context, folder)
    # a writer that stops before it publishes leaves only a folder of entries
    spark.createDataFrame([], f"{state.ENTRY_SCHEMA}, _removed boolean").write.parquet(f"{folder}/segments/segment=unfinished")
    assert state.load(spark, folder).entries.count() == 2


def test_unsupported_files_are_refused(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}"), ("b.sql", "select 1")], "path string, content string")
    with pytest.raises(Exception, match="no outline for this kind of file: b.sql"):
        compress.compress(files, Counter("native")).collect()
