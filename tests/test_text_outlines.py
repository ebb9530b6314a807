"""Outlines of Markdown, configuration, Objective-C and web files on small sources."""

import pytest
from pyspark.sql import functions as F

from corpusfold.functions import text
from corpusfold.functions.tokens import Counter
from corpusfold.operators import compress, config, markdown, objc
from corpusfold.operators import lines as L

NATIVE = Counter("native")


@pytest.fixture
def shown(spark):
    def lines(path, source):
        files = spark.createDataFrame([(path, source)], "path string, content string")
        return files.select(config.picked(F.col("path"), text.lines(F.col("content"))).alias("o")).first().o.shown

    return lines


def compressed(spark, path, content):
    files = spark.createDataFrame([(path, content)], "path string, content string")
    return compress.compress(files, NATIVE).first()


def test_config_keeps_important_sections(shown):
    source = '{\n  "version": "2",\n  "commands": {\n    "go": "run"\n  },\n  "palette": {\n    "tones": [\n      "not-shown"\n    ]\n  }\n}\n'
    lines = shown("a.json", source)
    assert '"go": "run"' in lines
    assert not any("not-shown" in line for line in lines)


def test_config_limits_array_items(shown):
    items = [f'    "{c}"' for c in "abcdefghijklmn"]
    lines = shown("a.json", '{\n  "bin": [\n' + ",\n".join(items) + "\n  ]\n}\n")
    assert lines.count("...") == 1
    assert lines[-1] == "..."
    assert '"l",' in lines and not any('"m"' in line for line in lines)


@pytest.mark.parametrize(
    "path, source, kept, dropped",
    [
        ("web/package.json", '{\n  "overrides": {\n    "left": "1"\n  },\n  "house": {\n    "tone": "not-shown"\n  }\n}', '"left": "1"', "not-shown"),
        (".github/workflows/nightly.yml", "on:\n  schedule:\nhouse:\n  tone: not-shown\n", "schedule:", "not-shown"),
        ("core/Cargo.toml", '[profile.bench]\ndebug = true\n\n[house.rules]\ntone = "not-shown"\n', "debug = true", "not-shown"),
        ("x/.codex-plugin/plugin.json", '{\n  "capabilities": {\n    "reads": "all"\n  },\n  "house": {\n    "tone": "not-shown"\n  }\n}', '"reads": "all"', "not-shown"),
        ("my-extension/package.json", '{\n  "menus": {\n    "top": [\n      {\n        "when": "open"\n      }\n    ]\n  },\n  "house": {\n    "tone": "not-shown"\n  }\n}', '"when": "open"', "not-shown"),
    ],
)
def test_config_profiles(shown, path, source, kept, dropped):
    lines = shown(path, source)
    assert kept in lines
    assert not any(dropped in line for line in lines)


def test_config_comments(shown):
    assert "# top" in shown("a.yaml", "# top\nname: demo\njobs:\n  # inner\n  build:\n")
    assert "# inner" not in shown("a.yaml", "# top\nname: demo\njobs:\n  # inner\n  build:\n")
    assert "// top" in shown("a.json", '// top\n{\n  // nested\n  "name": "x"\n}')
    assert "# noted" in shown("a.toml", "[dependencies]\n# noted\nserde = 1\n")


def test_markdown(spark):
    source = (
        "![](https://img.shields.io/x)\n| tool | use |\n| --- | --- |\n| `cut` | trim |\n\n## Setup\n\nFirst step.\nSecond step.\nThird step.\n\n"
        "Read [more](more.md).\n\n[more]: https://example.com/more\n\n~~~bash\nmake\n~~~\n\n```dot\na -> b\n```\n"
    )
    row = compressed(spark, "README.md", source)
    assert row.skeleton.split("\n") == [
        "| tool | use |", "| --- | --- |", "| `cut` | trim |", "## Setup", "First step.", "Second step.",
        "Read [more](more.md).", "[more]: https://example.com/more", "~~~bash", "make", "~~~", "```dot", "...", "```",
    ]
    assert row.tree_map == "## Setup"


def test_markdown_samples_and_falls_back(spark):
    table = "# M\n\n| name | value |\n| --- | --- |\n" + "".join(f"| row-{i} | v |\n" for i in range(1, 21))
    lines = compressed(spark, "m.md", table).skeleton.split("\n")
    assert lines[1:] == ["| name | value |", "| --- | --- |", *[f"| row-{i} | v |" for i in range(1, 9)], "...", *[f"| row-{i} | v |" for i in range(17, 21)]]
    assert compressed(spark, "p.md", "  plain\n\ntext \n").skeleton == "plain\ntext"
    assert compressed(spark, "e.md", "").skeleton == ""


def test_objective_c(spark):
    source = (
        "#import <UIKit/UIKit.h>\n\n@interface Tank : NSObject\n@property (assign) int level;\n+ (Tank *)full:(int)level;\n@end\n\n"
        "static int Twice(int n) {\n    int m = n;\n    return m + n;\n}\n\n@implementation Tank\n+ (Tank *)full:(int)level {\n    if (level) { return nil; }\n}\n@end\n"
    )
    row = compressed(spark, "Tank.m", source)
    assert row.skeleton.split("\n") == [
        "#import <UIKit/UIKit.h>", "@interface Tank : NSObject", "@property (assign) int level;", "+ (Tank *)full:(int)level;", "@end",
        "static int Twice(int n) { ... }", "@implementation Tank", "+ (Tank *)full:(int)level { ... }", "@end",
    ]
    assert row.tree_map == row.skeleton


def test_web(spark):
    row = compressed(spark, "a.vue", "\n<script>\n// note\nconst t = 1\n</script>\n<!-- x -->\n  <h1>{{ t }}</h1>\n")
    assert row.skeleton == "<script>\nconst t = 1\n</script>\n<h1>{{ t }}</h1>"


def test_long_lines_are_cut_by_tokens(spark):
    from pyspark.sql import functions as F

    words = " ".join(f"token{i}" for i in range(180))
    row = compressed(spark, "a.html", f'<meta content="{words}">')
    assert row.skeleton.endswith("...")
    assert spark.range(1).select(NATIVE.count(F.lit(row.skeleton)).alias("n")).first().n == 80


def test_line_functions_are_unit_exact(spark):
    from pyspark.sql import functions as F

    from corpusfold.functions import text

    cell = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert cell(text.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert cell(text.lines(F.lit(""))) == []
    assert cell(text.lines(F.lit("\n\n"))) == ["", ""]
    assert cell(text.trim(F.lit("\u2003 x\u00a0"))) == "x"
    assert cell(text.truncate_chars(F.lit("é" * 241), 240)) == "é" * 237 + "..."
    assert cell(text.json_escape(F.lit('a"\\\n\t\x01\x7f'))) == 'a\\"\\\\\\n\\t\\u0001\\u007f'
    assert cell(text.xml_escape(F.lit("&<>\"'"))) == "&amp;&lt;&gt;&quot;&apos;"


def test_repeats_collapse_only_next_to_each_other(spark):
    rows = [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x")]
    from corpusfold.operators import lines

    df = spark.createDataFrame(rows, "path string, pos int, line string")
    assert [r.line for r in lines.drop_repeats(df, ["path"]).orderBy("pos").collect()] == ["x", "y", "x"]
    assert markdown.FENCE_LINES == 24 and objc.SKELETON_LINES == 180


def test_limits_are_parameters(spark):
    rows = [("a", i, f"import {i}") for i in range(9)] + [("a", 9, "x")]
    lines = spark.createDataFrame(rows, "key string, pos int, line string").withColumn("syntax", F.lit("python"))
    short = L.collapse_imports(lines, ["key"], keep=2).orderBy("pos").collect()
    assert [r.line for r in short] == ["import 0", "import 1", "... 7 more imports", "x"]
    sample = L.sample_runs(lines.drop("syntax"), ["key"], head=2, tail=1).orderBy("pos").collect()
    assert [r.line for r in sample] == ["import 0", "import 1", "...", "x"]


def test_objective_c_outlines_are_made_row_by_row(spark, tmp_path):
    imports = "".join(f'#import "{i}.h"\n' for i in range(9))
    odd = [
        ("long.m", "".join(f"void f{i}(void) {{\n}}\n" for i in range(200))), ("imports.m", imports + "@end\n" + imports), ("none.m", "// x\n}\n{ y\n@end"),
        ("empty.m", ""), ("null.m", None), ("twice.m", "@end\n@end\n  @end\n} // stray\nint a;\r\n@end"), ("twice.m", "@class A;"),
    ]
    spark.createDataFrame(odd, "path string, content string").coalesce(1).write.parquet(str(tmp_path / "odd"))
    made = objc.compress(spark.read.parquet(str(tmp_path / "odd")))
    # outlines are wider than what their size is judged by, so they must not be sent to the driver for a join
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = {(r.path, r.skeleton, r.tree_map) for r in made.collect()}
    functions = [f"void f{i}(void) {{ ... }}" for i in range(200)]
    six = [f'#import "{i}.h"' for i in range(5)] + ["... 4 more imports"]
    closed = "\n".join([*six, "@end", *six])
    twice = "@end\nint a;\n@end"
    assert rows == {
        ("long.m", "\n".join(functions[:180]), "\n".join(functions[:120])), ("imports.m", closed, closed), ("none.m", "", ""),
        ("empty.m", "", ""), ("null.m", "", ""), ("twice.m", twice, twice), ("twice.m", "@class A;", "@class A;"),
    }


def test_config_reads_a_path_once_and_keeps_a_small_state(spark, tmp_path):
    lines = ["name: demo", "jobs:", *[f"\t  step {i}: x" for i in range(3)], "  - run: y", "", "a,b", "on: push"]
    spark.createDataFrame([("a.yml", "\n".join(lines))], "path string, content string").coalesce(1).write.parquet(str(tmp_path / "one"))
    made = config.outline(spark.read.parquet(str(tmp_path / "one")), NATIVE)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # the extension was looked up again at every line, and the lines shown so far were copied one by one
    assert plan.count(r"\.([^./]+)$") == 1
    assert "shown:array" not in config._STATE
    assert made.first().skeleton.split("\n") == ["name: demo", "jobs:", *[f"step {i}: x" for i in range(3)], "- run: y", "on: push"]
    indents = spark.createDataFrame([("\t a", 3), ("  a\tb", 2), (" \t\ta", 5), ("a", 0), ("   ", 3), ("", 0)], "line string, n int")
    assert indents.where(text.leading_indent(F.col("line")) != F.col("n")).count() == 0
