"""Report tables of a run: summary, savings, per-file statistics, dry run and health checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import langs, paths, text
from corpusfold.functions.tokens import counter_for
from corpusfold.operators import delta, order, rollup
from corpusfold.plans.context import Context
from corpusfold.sources import content as disk
from corpusfold.sources import state


def run_stats(context: Context) -> DataFrame:
    spark = context.files.sparkSession
    raw = F.lit(context.raw_tokens).cast("bigint")
    return spark.range(1).select(
        F.lit(context.files_included).cast("bigint").alias("files_included"),
        F.lit(context.files_dropped).cast("bigint").alias("files_dropped"),
        *rollup.savings(raw, F.lit(context.output_tokens).cast("bigint")),
    )


def incremental_summary(context: Context) -> DataFrame:
    return rollup.delta_counts(context.deltas, context.deleted)


def dry_run(context: Context) -> DataFrame:
    return context.files.select("path", "level", "tokens")


def parser_support(spark: SparkSession) -> DataFrame:
    """One row per supported extension: the mode that compresses it."""
    rows = spark.createDataFrame([(f"x.{ext}",) for ext in langs.EXTENSIONS], "path string")
    return rows.select(
        F.concat(F.lit("."), paths.extension(F.col("path"))).alias("extension"),
        paths.parser_mode(F.col("path")).alias("mode"),
        F.lit(True).alias("available"),
    )


def snapshot_health(snapshot: state.Snapshot) -> DataFrame:
    """Entries of a snapshot, and how many no longer are what is on disk, wherever they lie."""
    return delta.health(disk.probe(snapshot.seen))


def tokenizer_status(name: str) -> str:
    try:
        counter_for(name)
    except (RuntimeError, ValueError) as error:
        return f"error: {error}"
    return "ok"


def stats_text(context: Context) -> str:
    saved = max((context.raw_tokens or 0) - context.output_tokens, 0)
    percent = 100.0 * saved / context.raw_tokens if context.raw_tokens else 0.0
    return (
        f"stats:\n  raw_tokens: {context.raw_tokens or 0}\n  shrunk_tokens: {context.output_tokens}\n"
        f"  tokens_saved: {saved}\n  saving_percent: {percent:.2f}\n"
        f"  files_scanned: {context.files_included}\n  files_dropped: {context.files_dropped}"
    )


def summary_text(context: Context, output: str) -> str:
    o = context.options
    return (
        f"summary:\n  output: {output}\n  files_included: {context.files_included}\n"
        f"  files_dropped: {context.files_dropped}\n  selected_level: {o.level}\n  tokenizer: {o.tokenizer}\n"
        f"  output_tokens: {context.output_tokens} / {o.max_tokens}"
    )


def incremental_text(context: Context) -> str:
    names = ("added", "changed", "unchanged", "skipped", "deleted")
    return "incremental_summary:\n" + "\n".join(f"  {name}: {context.counts[name]}" for name in names)


def dry_run_lines(context: Context) -> Iterator[str]:
    """Printed form of the dry run, line by line."""
    files, gone = dry_run(context), context.deleted
    yield "dry_run:"
    yield f"  files: {context.files_included}"
    yield f"  deleted: {context.counts['deleted']}"
    yield f"  estimated_tokens: {context.output_tokens}"
    yield f"  max_tokens: {context.options.max_tokens}"
    yield "selected_files:"
    for f in files.orderBy(*order.keys(context.options.sort)).toLocalIterator():
        yield f"  {f.path}  L{f.level}  {f.tokens} tokens"
    if context.counts["deleted"]:
        yield "deleted_files:"
        for g in gone.orderBy("path").toLocalIterator():
            yield f"  {g.path}"


def detailed_lines(context: Context) -> Iterator[str]:
    """Per-file tokens, tokens by extension and their distribution, line by line."""
    files = context.files.select("path", "tokens")
    yield "detailed_stats:"
    yield f"  files_reported: {context.files_included}"
    yield "  per_file_tokens:"
    for f in context.files.orderBy(*order.keys(context.options.sort)).select("path", "tokens").toLocalIterator():
        yield f"    {f.path}: {f.tokens}"
    yield "  tokens_by_extension:"
    for e in rollup.tokens_by_extension(files).orderBy(F.desc("tokens"), "ext").toLocalIterator():
        yield f"    {e.ext}: {e.tokens}"
    d = rollup.token_distribution(files).first()
    yield f"  token_distribution: min={d.min}, median={d.median:.1f}, mean={d.mean:.1f}, max={d.max}"


def doctor(spark: SparkSession, root: str, state_path: str | None, tokenizer: str) -> dict:
    """Health of the snapshot, the tokenizer and the compressors."""
    snapshot = state.load(spark, state_path) if state_path else None
    entries = stale = 0
    if snapshot is not None:
        row = snapshot_health(snapshot).first()
        entries, stale = row.entries, row.stale_entries
    status = tokenizer_status(tokenizer)
    return {
        "repo_root": root,
        "cache_path": state_path,
        "cache": {
            "entries": entries, "stale_entries": stale,
            "metadata": None if snapshot is None else snapshot.selection,
        },
        "tokenizer": {"name": tokenizer, "available": status == "ok", "status": status},
        "parsers": [row.asDict() for row in parser_support(spark).collect()],
    }


def doctor_text(report: dict) -> str:
    cache, tokenizer = report["cache"], report["tokenizer"]
    rows = [
        "doctor:", f"  repo_root: {report['repo_root']}", f"  cache_path: {report['cache_path']}", "  cache:",
        f"    entries: {cache['entries']}", f"    stale_entries: {cache['stale_entries']}", "    metadata:",
        f"      present: {str(cache['metadata'] is not None).lower()}",
    ]
    for name in ("respect_gitignore", "max_file_bytes", "include", "exclude") if cache["metadata"] else ():
        rows.append(f"      {name}: {cache['metadata'][name]}")
    rows += [f"  tokenizer: {tokenizer['name']} ({tokenizer['status']})", "  parsers:"]
    rows += [f"    {p['extension']}: {p['mode']} ({'ok' if p['available'] else 'missing'})" for p in report["parsers"]]
    return "\n".join(rows)


# fixed values: how each number of a printed report is found
REPORT_PATTERNS = {
    "files_included": r"(?m)^  files_included: (\d+)$",
    "output_tokens": r"(?m)^  output_tokens: (\d+) / \d+$",
    "output_tokens_budget": r"(?m)^  output_tokens: \d+ / (\d+)$",
    "raw_tokens": r"(?m)^  raw_tokens: (\d+)$",
    "shrunk_tokens": r"(?m)^  shrunk_tokens: (\d+)$",
    "tokens_saved": r"(?m)^  tokens_saved: (\d+)$",
    "saving_percent": r"(?m)^  saving_percent: ([\d.]+)$",
}
MAP_ENTRY = r'<entry path="([^"]+)" level="(\d+)" tokens="(\d+)" />'


def parse_reports(reports: DataFrame, column: str) -> DataFrame:
    """Adds the numbers of printed reports, one row per report text; a missing one is null."""
    cells = []
    for name, pattern in REPORT_PATTERNS.items():
        found = F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
        cells.append(found.cast("double" if name == "saving_percent" else "bigint").alias(name))
    return reports.select("*", *cells)


def map_rows(entries: DataFrame, column: str, fmt: str = "xml") -> DataFrame:
    """(path, level, tokens) read back from map entries, one entry per row."""
    entry = F.col(column)
    if fmt == "json":
        parsed = F.from_json(F.rtrim(entry, F.lit(",")), "path string, level bigint, tokens bigint")
        return entries.select(parsed.alias("e")).select("e.*")
    return entries.filter(F.rlike(entry, F.lit(MAP_ENTRY))).select(
        text.xml_unescape(F.regexp_extract(entry, MAP_ENTRY, 1)).alias("path"),
        F.regexp_extract(entry, MAP_ENTRY, 2).cast("bigint").alias("level"),
        F.regexp_extract(entry, MAP_ENTRY, 3).cast("bigint").alias("tokens"),
    )


def map_line(path: Column, level: Column, tokens: Column) -> Column:
    """One printed map line; token counts are right-aligned to five places."""
    number = tokens.cast("string")
    padded = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit(" "))
    return F.concat(padded, F.lit(" tokens  L"), level.cast("string"), F.lit("  "), path)


def status_line(tokens: Column, limit: Column, files: Column) -> Column:
    """Short status of a run; a missing number is spelled out."""
    budget = F.coalesce(F.concat(F.lit("/"), limit.cast("string")), F.lit(""))
    shown = F.coalesce(F.concat(tokens.cast("string"), budget, F.lit(" tokens")), F.lit("tokens unknown"))
    counted = F.coalesce(F.concat(files.cast("string"), F.lit(" files")), F.lit("files unknown"))
    return F.concat(shown, F.lit(", "), counted)
