"""Skeletons and tree maps of code, one small source per language."""

import pytest

from corpusfold.functions.code_outline import outline
from corpusfold.operators import compress

CASES = {
    "rust": (
        "use std::io;\n\npub(crate) fn area(w: u32, h: u32) -> u32 {\n    let unused = || { 1 };\n    w * h\n}\n",
        "pub(crate) fn area(w: u32, h: u32) -> u32 { ... }", "w * h", "use std::io;",
    ),
    "typescript": (
        "import { join } from 'path'\n\ntype Point = { x: number }\n\nexport function norm(p: Point): number {\n  return Math.abs(p.x) // }\n}\n",
        "export function norm(p: Point): number { ... }", "Math.abs", "type Point",
    ),
    "javascript": (
        "const add = (a, b) => {\n  return a + b\n}\nclass Tank {\n  fill() {\n    if (x) { y() }\n  }\n}\n",
        "fill() { ... }", "return a", "class Tank {",
    ),
    "python": (
        "import math\n\ndef radius(area: float) -> float:\n    return math.sqrt(area / math.pi)\n",
        "def radius(area: float) -> float:\n    ...", "math.sqrt", "import math",
    ),
    "go": (
        'package shapes\n\nimport "math"\n\nfunc Radius(area float64) float64 {\n\treturn math.Sqrt(area)\n}\n',
        "func Radius(area float64) float64 { ... }", "math.Sqrt", "func Radius",
    ),
    "java": (
        "package shapes;\n\nclass Square {\n    double side;\n    double area() throws Failure {\n        return side * side;\n    }\n}\n",
        "double area() throws Failure { ... }", "side * side", "class Square",
    ),
    "csharp": (
        "using System.Linq;\n\nnamespace Shapes;\n\ninternal class Square {\n    public double Side { get; set; }\n    public double Area() {\n        return Side * Side;\n    }\n}\n",
        "public double Area() { ... }", "Side * Side", "public double Side { get; set; }",
    ),
    "swift": (
        "import UIKit\n\nstruct Square {\n    var side: Double\n    func area() -> Double {\n        return side * side\n    }\n}\n",
        "func area() -> Double { ... }", "side * side", "var side: Double",
    ),
    "kotlin": (
        "package shapes\n\ndata class Square(val side: Double) {\n    fun area(): Double {\n        return side * side\n    }\n    fun twice() = side + side\n}\n",
        "fun area(): Double { ... }\n    fun twice() { ... }", "side * side", "data class Square",
    ),
    "c": (
        "#include <math.h>\n#define SIDES 4\n\nstatic double area(const double *side)\n{\n    for (;;) { break; }\n    return *side * *side;\n}\n",
        "static double area(const double *side)\n{ ... }", "*side * *side", "#define SIDES 4",
    ),
    "cpp": (
        "#include <vector>\n\nnamespace shapes {\nclass Square : public Shape {\npublic:\n    double area() const override {\n        return side * side;\n    }\n};\n}\n",
        "double area() const override { ... }", "side * side", "class Square : public Shape {",
    ),
}


@pytest.mark.parametrize("syntax", CASES)
def test_bodies_go_and_shapes_stay(syntax):
    source, kept, dropped, shape = CASES[syntax]
    skeleton, tree_map = outline(source, syntax)
    assert kept in skeleton
    assert dropped not in skeleton
    assert shape in tree_map


def test_headers_keep_declarations():
    assert "long total(const long *first);" in outline("#ifndef T_H\n\nlong total(const long *first);\n", "c")[1]


def test_exports_show_twice():
    tree_map = outline("export function f() {\n  return 1\n}\n", "typescript")[1]
    assert tree_map.split("\n") == ["export function f() {", "function f() {"]


def test_braces_in_literals_do_not_count():
    source = 'fn a() -> char {\n    let s = "}}}"; // }\n    \'}\'\n}\nstruct S<\'a>(&\'a str);\nfn b() {}\n'
    assert outline(source, "rust")[0] == "fn a() -> char { ... }\nstruct S<'a>(&'a str);\nfn b() { ... }\n"


def test_nested_python_functions_are_replaced_once():
    source = "class A:\n    def m(self):\n        def inner():\n            return 1\n\n        return inner\n\n    x = 1\n"
    assert outline(source, "python")[0] == "class A:\n    def m(self):\n        ...\n\n    x = 1\n"


@pytest.mark.parametrize(
    "syntax, lines",
    [
        ("rust", [f"use {c}::X;" for c in "abcdefg"]),
        ("python", [f"import {c}" for c in "abc"] + [f"from {c} import C" for c in "defg"]),
        ("c", [f"#include <{c}.h>" for c in "abcdefg"]),
    ],
)
def test_long_import_runs_collapse(spark, syntax, lines):
    name = {"rust": "a.rs", "python": "a.py", "c": "a.c"}[syntax]
    text = "\n".join(["", *lines, "", "rest"]) + "\n"
    assert skeleton(spark, name, text) == "\n".join(["", *lines[:5], "... 2 more imports", "", "rest"]) + "\n"


def skeleton(spark, path, text):
    return compress.code(spark.createDataFrame([(path, text)], "path string, content string")).first().skeleton


def test_go_groups_collapse_and_short_ones_stay(spark):
    head = "package mill\n\nimport (\n"
    long = head + "".join(f'    "{c}"\n' for c in "abcdefg") + ")\n"
    assert '    "e"\n    ... 2 more imports\n)' in skeleton(spark, "a.go", long)
    for short in (head + '    "a"\n\n    "b"\n)\n', head + '    "a"\n'):
        assert skeleton(spark, "a.go", short) == short
