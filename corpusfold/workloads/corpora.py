"""Virtual repositories derived from the given tables.

Every table row becomes one file, so the work grows with the tables. Expressions that both SQL
engines accept are kept as shared strings; the oracle builds the same files from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The columns that files are generated from, dealt out by key.

    Generated texts are many times wider than these rows, so rows move before, and texts need not move after.
    The count is named, since adaptive execution would join partitions by the size of the narrow rows.
    """
    return table(spark, sf_dir, name).select(key, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


# -- documents as Markdown files ------------------------------------------------------------------

DOC_PATH = (
    "source || '/' || lang || '/' || CASE WHEN doc_id % 23 = 0 THEN 'd' || doc_id || '/README.md' "
    "WHEN doc_id % 7 = 0 THEN 'deep/doc_' || doc_id || '.md' ELSE 'doc_' || doc_id || '.md' END"
)

# one Markdown line from sentence {x} at index {i}; the document's id picks its style
MD_LINE = (
    "CASE WHEN {i} % 29 = 0 THEN '## ' || {x} "
    "WHEN {i} % 31 = 12 THEN '' "
    "WHEN {i} % 13 = 5 THEN '[' || {x} || '](https://example.com/' || {i} || ')' "
    "WHEN doc_id % 4 = 1 AND {i} % 29 > 2 THEN '- ' || {x} "
    "WHEN doc_id % 4 = 2 AND {i} % 29 > 2 THEN '| ' || {i} || ' | ' || {x} || ' |' "
    "WHEN doc_id % 4 = 3 AND {i} % 40 = 2 THEN '```rust' "
    "WHEN doc_id % 4 = 3 AND {i} % 40 = 33 THEN '```' "
    "WHEN doc_id % 4 = 3 AND {i} % 40 = 35 THEN '~~~mermaid' "
    "WHEN doc_id % 4 = 3 AND {i} % 40 = 38 THEN '~~~' "
    "WHEN {i} % 6 = 4 THEN 'again' WHEN {i} % 6 = 3 THEN 'again' "
    "ELSE '  ' || {x} END"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain documents: path, content, size."""
    return table(spark, sf_dir, "documents").select(
        F.expr(DOC_PATH).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("bigint").alias("size")
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out as Markdown, one line per sentence."""
    line = MD_LINE.format(i="i", x="x")
    return table(spark, sf_dir, "documents").select(
        F.expr(DOC_PATH).alias("path"),
        F.expr(f"array_join(transform(split(text, '[.] ?'), (x, i) -> {line}), '\n')").alias("content"),
    )


# -- documents as a tree with generated, vendored and hidden places -------------------------------

# fixed values: folders and names met in the selection rules
TREE_FOLDERS = (
    "src", "src/deep", "vendor", "dist", "tests", ".github/workflows", "third_party/lib",
    "node_modules/pkg", "Generated", "lib/out", "docs", "sub/.git/hooks", "app",
)
TREE_NAMES = (
    "lib.rs", "main.ts", "client.min.js", "generated.ts", "api.pb.go", "package.json",
    "package-lock.json", "pnpm-lock.yaml", "README.md", "notes.txt", "view.gen.kt", "code_gen.py",
    "Cargo.toml", "index.html", "App.SWIFT", "Makefile", "x.cpp",
)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over all selection rules: path, size."""
    folders = F.array(*[F.lit(f) for f in TREE_FOLDERS])
    names = F.array(*[F.lit(n) for n in TREE_NAMES])
    return table(spark, sf_dir, "documents").select(
        F.concat(
            F.element_at(folders, (F.col("doc_id") % len(TREE_FOLDERS) + 1).cast("int")),
            F.lit("/"), F.col("lang"), F.col("doc_id").cast("string"), F.lit("/"),
            F.element_at(names, (F.col("doc_id") % len(TREE_NAMES) + 1).cast("int")),
        ).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


# -- pages ----------------------------------------------------------------------------------------


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files named by their address: path, content, size."""
    bare = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit("/"))
    return table(spark, sf_dir, "pages").select(
        F.when(F.endswith(bare, F.lit(".html")), bare).otherwise(F.concat(bare, F.lit(".html"))).alias("path"),
        F.col("html").alias("content"),
        F.octet_length("html").cast("bigint").alias("size"),
    )


# -- labelled documents as an earlier snapshot ----------------------------------------------------

BENCHMARK_PATH = "'benchmark/item_' || item_id || '.md'"


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state: the labelled documents and the benchmark items, which are gone by now.

    Low quality documents differed in size and text, toxic ones in time.
    """
    docs = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            F.expr(DOC_PATH).alias("abs_path"),
            (F.octet_length("text") + F.when(F.col("quality") == 0, 1).otherwise(0)).cast("bigint").alias("size"),
            (F.col("doc_id") * 10 + F.col("toxic")).cast("bigint").alias("mtime_ns"),
            F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text")).alias("content"),
        )
    )
    gone = table(spark, sf_dir, "benchmark").select(
        F.expr(BENCHMARK_PATH).alias("abs_path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_ns"),
        F.col("text").alias("content"),
    )
    return docs.unionByName(gone)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's files: all documents."""
    return table(spark, sf_dir, "documents").select(
        F.expr(DOC_PATH).alias("abs_path"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.col("doc_id") * 10).cast("bigint").alias("mtime_ns"),
        F.col("text").alias("content"),
    )


# -- customers as source files --------------------------------------------------------------------

# language -> (extension, import line, file, expected skeleton, expected tree map);
# {k} is the customer key, {m} its market segment, {imports} the import block
CODE = {
    "rust": (
        "rs", "use crate::m{i}::M{i};",
        "{imports}\n\n/// {m} { not a brace\npub struct C{k} {\n    name: String,\n}\n\nimpl C{k} {\n    pub fn total(&self) -> usize {\n        let s = \"} {m}\";\n        if s.len() > {k} { return 1; }\n        s.len()\n    }\n}\n\nfn main() {}\n",
        "{imports}\n\n/// {m} { not a brace\npub struct C{k} {\n    name: String,\n}\n\nimpl C{k} {\n    pub fn total(&self) -> usize { ... }\n}\n\nfn main() { ... }\n",
        "{imports}\npub struct C{k} {\nimpl C{k} {\npub fn total(&self) -> usize {\nfn main() {}",
    ),
    "typescript": (
        "ts", "import v{i} from './m/v{i}'",
        "{imports}\n\nexport interface C{k} {\n  name: string\n}\n\nclass Store {\n  total(n: number): number {\n    // {m} }\n    return n + {k}\n  }\n}\n\nexport function main(): void {\n  const s = `}} {m}`\n}\n",
        "{imports}\n\nexport interface C{k} {\n  name: string\n}\n\nclass Store {\n  total(n: number): number { ... }\n}\n\nexport function main(): void { ... }\n",
        "{imports}\nexport interface C{k} {\ninterface C{k} {\nclass Store {\ntotal(n: number): number {\nexport function main(): void {\nfunction main(): void {\nconst s = `}} {m}`",
    ),
    "python": (
        "py", "import m{i}",
        "{imports}\n\n\nclass C{k}:\n    name = \"{m}\"\n\n    def total(self, n: int) -> int:\n        \"\"\"Doc\ndef fake():\n        \"\"\"\n        return n + {k}\n\n\ndef main():\n    return {\n        \"a\": {k},\n    }\n",
        "{imports}\n\n\nclass C{k}:\n    name = \"{m}\"\n\n    def total(self, n: int) -> int:\n        ...\n\n\ndef main():\n    ...\n",
        "{imports}\nclass C{k}:\ndef total(self, n: int) -> int:\ndef main():",
    ),
    "java": (
        "java", "import com.acme.M{i};",
        "package acme;\n\n{imports}\n\npublic class C{k} {\n    private String name = \"{m} }\";\n\n    public int total(int n) {\n        for (int i = 0; i < {k}; i++) { n += i; }\n        return n;\n    }\n}\n",
        "package acme;\n\n{imports}\n\npublic class C{k} {\n    private String name = \"{m} }\";\n\n    public int total(int n) { ... }\n}\n",
        "package acme;\n{imports}\npublic class C{k} {\nprivate String name = \"{m} }\";\npublic int total(int n) {",
    ),
    "c": (
        "c", "#include <m{i}.h>",
        "{imports}\n\nstruct c{k} {\n    int n;\n};\n\nint total(const char *s, int n) {\n    /* {m} } */\n    while (n > {k}) { n--; }\n    return n;\n}\n\nint later(int n);\n",
        "{imports}\n\nstruct c{k} {\n    int n;\n};\n\nint total(const char *s, int n) { ... }\n\nint later(int n);\n",
        "{imports}\nstruct c{k} {\nint total(const char *s, int n) {\nint later(int n);",
    ),
    "go": (
        "go", "\t\"m{i}\"",
        "package acme\n\nimport (\n{imports}\n)\n\ntype C{k} struct {\n\tname string\n}\n\nfunc (c *C{k}) Total(n int) int {\n\tif n > {k} {\n\t\treturn len(\"{m} {\")\n\t}\n\treturn n\n}\n",
        "package acme\n\nimport (\n{imports}\n)\n\ntype C{k} struct {\n\tname string\n}\n\nfunc (c *C{k}) Total(n int) int { ... }\n",
        "package acme\nimport (\ntype C{k} struct {\nfunc (c *C{k}) Total(n int) int {",
    ),
}


def _filled(template: str, columns: dict) -> list:
    """A template cut at its placeholders, as literals and columns."""
    parts: list = [template]
    for mark, column in columns.items():
        parts = [
            piece
            for part in parts
            for piece in (
                [part] if not isinstance(part, str)
                else [p for n, chunk in enumerate(part.split(mark)) for p in ([column] if n else []) + [chunk]]
            )
        ]
    return [F.lit(p) if isinstance(p, str) else p for p in parts if not (isinstance(p, str) and p == "")]


def _numbered(template: str):
    return lambda i: F.concat(*_filled(template, {"{i}": i.cast("string")}))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files in six languages: path, content."""
    key = F.col("c_custkey").cast("string")
    content = path = None
    for n, (_, (ext, import_line, source, _, _)) in enumerate(CODE.items()):
        imports = F.array_join(
            F.transform(F.sequence(F.lit(1), F.col("c_nationkey").cast("int") % 9 + 1), _numbered(import_line)), "\n"
        )
        text = F.concat(*_filled(source, {"{imports}": imports, "{k}": key, "{m}": F.col("c_mktsegment")}))
        name = F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/c"), key, F.lit("." + ext))
        here = F.col("c_custkey") % len(CODE) == n
        content = F.when(here, text) if content is None else content.when(here, text)
        path = F.when(here, name) if path is None else path.when(here, name)
    rows = narrow(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return rows.select(path.alias("path"), content.alias("content"))


# -- parts as manifests and Objective-C sources ---------------------------------------------------

# one JSON, TOML or YAML manifest per part with as many array items as the part's size
CONFIG_SQL = {
    0: (
        "'p' || p_partkey || '/package.json'",
        "'{{\n  \"name\": \"part-' || p_partkey || '\",\n  \"description\": \"' || p_name || '\",\n  \"files\": [\n' || {items_json} || "
        "'\n  ],\n  \"fixtures\": {{\n    \"brand\": \"' || p_brand || '\"\n  }},\n  \"scripts\": {{\n    \"build\": \"make ' || p_type || '\"\n  }}\n}}\n'",
    ),
    1: (
        "'p' || p_partkey || '/Cargo.toml'",
        "'# ' || p_name || '\n[package]\nname = \"part-' || p_partkey || '\"\n\n[features]\ndefault = [\n' || {items_json} || "
        "'\n]\n\n[lints.rust]\nunsafe = \"' || p_brand || '\"\n'",
    ),
    2: (
        "'.github/workflows/p' || p_partkey || '.yml'",
        "'name: ' || p_name || '\non:\n  push:\njobs:\n  build:\n    steps:\n' || {items_yaml} || "
        "'\nmetadata:\n  brand: ' || p_brand || '\n  list:\n    - x\n    - y\n'",
    ),
}


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests in three formats: path, content."""
    items_json = "array_join(transform(sequence(1, p_size), i -> '    \"item-' || i || '.js\"'), ',\n')"
    items_yaml = "array_join(transform(sequence(1, p_size), i -> '      - run: step ' || i), '\n')"
    path = " ".join(f"WHEN p_partkey % 3 = {n} THEN {p}" for n, (p, _) in CONFIG_SQL.items())
    body = " ".join(
        f"WHEN p_partkey % 3 = {n} THEN {c.format(items_json=items_json, items_yaml=items_yaml)}"
        for n, (_, c) in CONFIG_SQL.items()
    )
    parts = narrow(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return parts.select(F.expr(f"CASE {path} END").alias("path"), F.expr(f"CASE {body} END").alias("content"))


# line {i} of a part's Objective-C file; the file has as many lines as the part's size
OBJC_LINE = (
    "CASE WHEN {i} <= p_size % 8 THEN '#import \"h' || {i} || '.h\"' "
    "WHEN {i} % 10 = 0 THEN '@implementation P' || p_partkey "
    "WHEN {i} % 10 = 1 THEN '- (void)run:(int)n {{' "
    "WHEN {i} % 10 = 2 THEN '    if (n > ' || {i} || ') {{ [self x]; }}' "
    "WHEN {i} % 10 = 3 THEN '    static int k = 1;' "
    "WHEN {i} % 10 = 4 THEN '}}' "
    "WHEN {i} % 10 = 5 THEN '}} // stray' "
    "WHEN {i} % 10 = 6 THEN 'static int n' || (p_partkey % 5) || ' = 1;' "
    "WHEN {i} % 10 = 7 THEN 'static int n' || (p_partkey % 5) || ' = 1;' "
    "WHEN {i} % 10 = 8 THEN '// {{ comment' ELSE '@end' END"
)


def objc(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = OBJC_LINE.replace("{{", "{").replace("}}", "}").replace("{i}", "i")
    return narrow(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.expr("'ios/p' || p_partkey || '.m'").alias("path"),
        F.expr(f"array_join(transform(sequence(1, p_size * 4), i -> {line}), '\n')").alias("content"),
    )
