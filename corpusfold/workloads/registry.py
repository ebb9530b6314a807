"""Registered queries: each one a Spark plan, most with the same result as SQL for the check engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusfold.functions import langs, paths, text, tokens
from corpusfold.operators import budget, compress, config, delta, lines, markdown, objc, order, prefix, render, rollup, select, spans, web
from corpusfold.options import ContextOptions
from corpusfold.plans import context, reports
from corpusfold.session import scratch_dir, stage
from corpusfold.sources import nul_records as nul
from corpusfold.sources import state
from corpusfold.sources.keyed_log import KeyedLog
from corpusfold.workloads import corpora, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NATIVE = tokens.Counter("native")


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# -- tokens and scalar functions ------------------------------------------------------------------


@query(f"SELECT doc_id, CAST({duck.tokens('text')} AS BIGINT) AS tokens FROM documents")
def token_counts(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", NATIVE.count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {duck.short('text', 60)} AS shortened, CAST({duck.tokens(duck.short('text', 60))} AS BIGINT) AS tokens FROM documents")
def truncate_tokens(spark, sf):
    docs = corpora.table(spark, sf, "documents")
    cut = docs.select("doc_id", NATIVE.truncate(F.col("text"), 60).alias("shortened"))
    return cut.withColumn("tokens", NATIVE.count(F.col("shortened")))


@query("SELECT page_id, CASE WHEN length(html) > 240 THEN left(html, 237) || '...' ELSE html END AS line FROM pages")
def truncate_chars(spark, sf):
    return corpora.table(spark, sf, "pages").select("page_id", text.truncate_chars(F.col("html"), 240).alias("line"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", delta.digest(F.col("text")).alias("hash"))


@query(
    "WITH named AS (SELECT item_id, doc_id, [' GPT-4o-mini','gpt-4.1','o3','gpt-4','GPT-3.5-turbo','cl100k','openai','codex',"
    "'text-davinci-edit-001','gpt2','unknown','r50k_base'][CAST(doc_id % 12 + 1 AS INT)] || CASE WHEN source = 'src0' THEN ' ' ELSE '' END AS name "
    "FROM documents LEFT JOIN benchmark ON item_id = doc_id), "
    "n AS (SELECT doc_id, name, replace(replace(lower(trim(name)), '-', '_'), '.', '_') AS p FROM named) "
    "SELECT doc_id, name, CASE WHEN regexp_matches(p, '^(gpt_4o|gpt_4_1|gpt_5|o1|o3|o4)') THEN 'o200k_base' "
    "WHEN regexp_matches(p, '^(gpt_4|gpt_3_5|text_embedding_ada_002)') THEN 'cl100k_base' "
    "WHEN p IN ('o200k','o200k_base') THEN 'o200k_base' WHEN p IN ('cl100k','cl100k_base','openai','chatgpt') THEN 'cl100k_base' "
    "WHEN p IN ('p50k','p50k_base','codex','code','text_davinci_002','text_davinci_003') THEN 'p50k_base' "
    "WHEN p IN ('p50k_edit','text_davinci_edit_001','code_davinci_edit_001') THEN 'p50k_edit' "
    "WHEN p IN ('r50k','r50k_base','gpt2','gpt_2','davinci') THEN 'r50k_base' END AS encoding FROM n"
)
def tokenizer_alias(spark, sf):
    names = F.array(*[F.lit(n) for n in (
        " GPT-4o-mini", "gpt-4.1", "o3", "gpt-4", "GPT-3.5-turbo", "cl100k", "openai", "codex",
        "text-davinci-edit-001", "gpt2", "unknown", "r50k_base",
    )])
    name = F.concat(
        F.element_at(names, (F.col("doc_id") % 12 + 1).cast("int")),
        F.when(F.col("source") == "src0", F.lit(" ")).otherwise(F.lit("")),
    )
    docs = corpora.table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return docs.withColumn("encoding", tokens.encoding_column(F.col("name")))


# -- paths and selection --------------------------------------------------------------------------

_E = duck.ext("path")


@query(
    f"WITH {duck.TREE} SELECT path, {duck.directory('path')} AS dir, {duck.name('path')} AS name, {_E} AS ext, "
    f"CASE WHEN {_E} IN ('js','jsx','ts','tsx','py','rs','go','java','cs','swift','kt','c','h','cpp','hpp') THEN 'tree-sitter' ELSE 'compact' END AS mode "
    "FROM tree"
)
def path_parts(spark, sf):
    p = F.col("path")
    return corpora.tree(spark, sf).select(
        "path", paths.directory(p).alias("dir"), paths.file_name(p).alias("name"), paths.extension(p).alias("ext"),
        F.coalesce(paths.parser_mode(p), F.lit("compact")).alias("mode"),
    )


@query(
    f"WITH {duck.TREE} SELECT path, {duck.priority('path')} AS priority, {duck.leaf('path')} AS leaf, "
    f"{duck.leaf('path')} + size - {duck.priority('path')} AS score FROM tree"
)
def path_scores(spark, sf):
    p = F.col("path")
    return corpora.tree(spark, sf).select(
        "path", paths.priority(p).alias("priority"), paths.leaf_score(p).alias("leaf"),
        paths.downgrade_score(p, F.col("size")).alias("score"),
    )


@query(f"WITH {duck.TREE} SELECT path, size FROM tree WHERE {duck.supported('path')} AND size <= 5000 AND NOT contains(path, '/.git/')")
def select_files(spark, sf):
    return select.select(corpora.tree(spark, sf), ContextOptions(max_file_bytes=5000)).select("path", "size")


@query(
    f"WITH {duck.TREE} SELECT path FROM tree WHERE {duck.supported('path')} AND size <= 1048576 AND NOT contains(path, '/.git/') "
    "AND regexp_matches(path, '^(vendor/.*|.*[.]ts|.*[.](json|kt))$') "
    f"AND (regexp_matches(path, '^(vendor/.*|.*[.]ts|.*[.](json|kt))$') OR NOT {duck.generated('path')})"
)
def include_overrides_generated(spark, sf):
    options = ContextOptions(include=("vendor/**", "*.ts", "*.{json,kt}"), exclude_generated=True)
    return select.select(corpora.tree(spark, sf), options).select("path")


@query(f"WITH {duck.TREE} SELECT path FROM tree WHERE {duck.supported('path')} AND size <= 1048576 AND NOT contains(path, '/.git/') AND NOT {duck.generated('path')}")
def exclude_generated(spark, sf):
    return select.select(corpora.tree(spark, sf), ContextOptions(exclude_generated=True)).select("path")


@query(
    f"WITH {duck.TREE} SELECT path FROM tree WHERE {duck.supported('path')} AND NOT contains(path, '/.git/') "
    "AND regexp_matches(path, '^(src/.*|(.*/)?main[.]ts)$') AND NOT regexp_matches(path, '^.*/en[0-9].*$')"
)
def include_exclude(spark, sf):
    options = ContextOptions(include=("src/**", "**/main.ts"), exclude=("*/en[0-9]*",), max_file_bytes=0)
    return select.select(corpora.tree(spark, sf), options).select("path")


@query(f"WITH {duck.PAGES} SELECT path, size FROM pg WHERE {duck.supported('path')} AND size <= 4000 AND NOT regexp_matches(path, '^m[.].*$')")
def select_pages(spark, sf):
    options = ContextOptions(exclude=("m.*",), max_file_bytes=4000)
    return select.select(corpora.pages(spark, sf), options).select("path", "size")


# -- sorts ----------------------------------------------------------------------------------------


def _counted_docs(spark, sf) -> DataFrame:
    return corpora.documents(spark, sf).select("path", "content", NATIVE.count(F.col("content")).alias("tokens"))


def _placed(files: DataFrame, key) -> DataFrame:
    """All rows of a total order, numbered."""
    return prefix.running_totals(files.withColumn("place", F.lit(1)), key, {"place": F.col("place")})


_DOC_TOKENS = f"{duck.DOCS}, dt AS (SELECT path, CAST({duck.tokens('content')} AS BIGINT) AS tokens FROM docs)"


@query(f"WITH {_DOC_TOKENS} SELECT path, tokens, row_number() OVER (ORDER BY tokens DESC, path) AS place FROM dt")
def sort_tokens_topk(spark, sf):
    return _placed(_counted_docs(spark, sf).drop("content"), order.key("tokens"))


@query(f"WITH {_DOC_TOKENS} SELECT path, tokens, row_number() OVER (ORDER BY {duck.priority('path')} DESC, path) AS place FROM dt")
def sort_priority_topk(spark, sf):
    return _placed(_counted_docs(spark, sf).drop("content"), order.key("priority"))


@query(f"WITH {duck.TREE} SELECT path, row_number() OVER (ORDER BY path) AS place FROM tree")
def sort_path_topk(spark, sf):
    return _placed(corpora.tree(spark, sf).select("path"), order.key("path"))


@query(f"WITH {duck.TREE} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM tree")
def scan_order_topk(spark, sf):
    return _placed(corpora.tree(spark, sf).select("path"), order.key("scan"))


# -- rollups --------------------------------------------------------------------------------------


@query(f"WITH {_DOC_TOKENS} SELECT {duck.directory('path')} AS path, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM dt GROUP BY 1")
def dir_summary(spark, sf):
    return rollup.directory_summaries(_counted_docs(spark, sf))


@query(f"WITH {_DOC_TOKENS} SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM dt")
def total_tokens(spark, sf):
    return rollup.total_tokens(_counted_docs(spark, sf))


@query(
    f"WITH {duck.TREE} SELECT CASE WHEN {_E} = '' THEN '<noext>' ELSE '.' || {_E} END AS ext, CAST(sum(size) AS BIGINT) AS tokens FROM tree GROUP BY 1"
)
def tokens_by_ext(spark, sf):
    return rollup.tokens_by_extension(corpora.tree(spark, sf).withColumnRenamed("size", "tokens"))


@query(f"WITH {_DOC_TOKENS} SELECT min(tokens) AS min, median(tokens) AS median, round(avg(tokens), 6) AS mean, max(tokens) AS max FROM dt")
def token_distribution(spark, sf):
    return rollup.token_distribution(_counted_docs(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(
    f"WITH {duck.TREE} SELECT path, CAST(level AS INT) AS level, CAST(size AS BIGINT) AS tokens FROM (SELECT path, size, 3 AS level FROM tree)"
)
def map_only(spark, sf):
    files = corpora.tree(spark, sf).select("path", F.lit(budget.TREE_MAP).alias("level"), F.col("size").alias("t3"))
    files = files.withColumn("t1", F.lit(0)).withColumn("t2", F.lit(0))
    return files.select("path", "level", budget.at_level(F.col("level")).alias("tokens"))


# -- budget ---------------------------------------------------------------------------------------

_MDV = f"{duck.MARKDOWN}, {duck.MARKDOWN_VARIANTS}, {duck.MD_COUNTS}"


def _md_variants(spark, sf) -> DataFrame:
    return markdown.compress(corpora.markdown(spark, sf), NATIVE).withColumnRenamed("content", "full")


def _md_counts(spark, sf) -> DataFrame:
    """Staged narrow table (path, t1, t2, t3) of the Markdown corpus."""
    variants = _md_variants(spark, sf)
    return stage(
        variants.select("path", *[NATIVE.count(F.col(v)).alias(f"t{n}") for n, v in enumerate(("full", "skeleton", "tree_map"), 1)]),
        "md-counts",
    )


def _levels(files: DataFrame) -> DataFrame:
    level = F.col("level")
    return files.select("path", level.cast("bigint").alias("level"), budget.at_level(level).alias("tokens"))


def _optimized(spark, sf, start: int, share: float) -> DataFrame:
    files = _md_counts(spark, sf).withColumn("level", F.lit(start))
    total = files.agg(F.sum(f"t{start}").alias("n")).first().n
    return budget.optimize(files, int(total * share))


@query(f"WITH RECURSIVE {_MDV}, {duck.greedy(1, 'CAST(floor(sum(t1) * 0.75) AS BIGINT)')} SELECT path, level, CAST({duck.level_tokens()} AS BIGINT) AS tokens FROM lv")
def budget_levels(spark, sf):
    return _levels(_optimized(spark, sf, 1, 0.75))


@query(f"WITH RECURSIVE {_MDV}, {duck.greedy(2, 'CAST(floor(sum(t2) * 0.5) AS BIGINT)')} SELECT path, level, CAST({duck.level_tokens()} AS BIGINT) AS tokens FROM lv")
def budget_levels_from_skeleton(spark, sf):
    return _levels(_optimized(spark, sf, 2, 0.5))


@query(
    f"WITH {_MDV} SELECT mc.path, CAST(CASE WHEN t1 <= 90 THEN 1 WHEN t2 <= 90 THEN 2 ELSE 3 END AS BIGINT) AS level, "
    f"CASE WHEN t1 <= 90 THEN \"full\" WHEN t2 <= 90 THEN skeleton ELSE {duck.short('tree_map', 90)} END AS content "
    "FROM mc JOIN mv ON mv.path = mc.path"
)
def cap_levels(spark, sf):
    variants = _md_variants(spark, sf)
    options = ContextOptions(tokenizer="native", level=1, max_file_tokens=90)
    files = context.counted(variants, options)
    shown = budget.visible(F.col("level"), F.col("full"), F.col("skeleton"), F.col("tree_map"))
    return files.select("path", F.col("level").cast("bigint").alias("level"), shown.alias("content"))


@query(
    f"WITH {_DOC_TOKENS}, lim AS (SELECT CAST(floor(sum(tokens) * 0.3) AS BIGINT) AS budget, sum(tokens) AS total FROM dt), "
    f"o AS (SELECT path, tokens, row_number() OVER w AS n, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS freed, count(*) OVER () AS total_n FROM dt "
    f"WINDOW w AS (ORDER BY {duck.priority('path')}, tokens DESC, path DESC)), "
    "k AS (SELECT CASE WHEN max(total) <= max(budget) THEN 0 ELSE coalesce(min(CASE WHEN total - freed <= budget AND n < total_n THEN n END), max(total_n) - 1) END AS stop "
    "FROM o CROSS JOIN lim) SELECT path, tokens FROM o WHERE n > (SELECT stop FROM k)"
)
def drop_low_priority(spark, sf):
    files = stage(_counted_docs(spark, sf).drop("content"), "doc-tokens").withColumn("cost", F.col("tokens"))
    total = files.agg(F.sum("tokens").alias("n")).first().n
    return budget.drop_low_priority(files, int(total * 0.3)).drop("cost")


@query(
    f"WITH {_MDV} SELECT CAST(sum(t1) AS BIGINT) AS raw_tokens, CAST(sum(t3) AS BIGINT) AS shrunk_tokens, "
    "CAST(greatest(sum(t1) - sum(t3), 0) AS BIGINT) AS tokens_saved, "
    "round(CASE WHEN sum(t1) = 0 THEN 0 ELSE 100.0 * greatest(sum(t1) - sum(t3), 0) / sum(t1) END, 6) AS saving_percent FROM mc"
)
def savings_stats(spark, sf):
    sums = _md_counts(spark, sf).agg(F.sum("t1").alias("raw"), F.sum("t3").alias("shrunk"))
    return sums.select(*rollup.savings(F.col("raw"), F.col("shrunk"))).withColumn("saving_percent", F.round("saving_percent", 6))


@query(f"WITH {duck.DOCS} SELECT path, CAST(1 AS BIGINT) AS level, CAST({duck.tokens('content')} AS BIGINT) AS tokens FROM docs")
def raw_level(spark, sf):
    files = corpora.documents(spark, sf).select("path", F.lit(1).alias("level"), F.col("content").alias("full"))
    shown = budget.visible(F.col("level"), F.col("full"), F.lit(""), F.lit(""))
    return files.select("path", F.col("level").cast("bigint").alias("level"), NATIVE.count(shown).alias("tokens"))


# -- deltas ---------------------------------------------------------------------------------------

_CLASSIFIED = (
    f"{duck.SNAPSHOT}, cl AS (SELECT cur.abs_path, CASE WHEN base.abs_path IS NULL THEN 'added' WHEN cur.size = base.size "
    "AND cur.mtime_ns = base.mtime_ns THEN 'unchanged' ELSE 'changed' END AS delta FROM cur LEFT JOIN base USING (abs_path))"
)


def _snapshot_delta(spark, sf) -> DataFrame:
    files = corpora.current(spark, sf).drop("content")
    return delta.with_inclusion(delta.against_snapshot(files, corpora.snapshot(spark, sf).drop("content")), True)


@query(f"WITH {_CLASSIFIED} SELECT abs_path, delta, delta <> 'unchanged' AS included FROM cl")
def delta_snapshot(spark, sf):
    return _snapshot_delta(spark, sf).select("abs_path", "delta", "included")


def _by_path(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("abs_path", "path")


@query(
    f"WITH {duck.SNAPSHOT} SELECT cur.abs_path AS path, CASE WHEN base.abs_path IS NULL THEN 'added' WHEN cur.content = base.content "
    "THEN 'unchanged' ELSE 'changed' END AS delta FROM cur LEFT JOIN base USING (abs_path)"
)
def delta_directory(spark, sf):
    def narrow(df):
        return _by_path(df).select(
            "path", F.octet_length("content").alias("size"), delta.digest(F.col("content")).alias("digest")
        )

    files = narrow(corpora.current(spark, sf))
    return delta.against_directory(files, narrow(corpora.snapshot(spark, sf))).select("path", "delta")


_STATUS = (
    f"ev AS (SELECT doc_id AS seq, ['M','A','D','R100','C75'][CAST(doc_id % 5 + 1 AS INT)] AS status, "
    f"'old/' || doc_id || '.md' AS old_path, {corpora.DOC_PATH} AS path FROM documents JOIN labels USING (doc_id))"
)


def _status_rows(spark, sf) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("M", "A", "D", "R100", "C75")])
    docs = corpora.table(spark, sf, "documents").join(corpora.table(spark, sf, "labels").select("doc_id"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("seq"), F.element_at(codes, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"),
        F.expr("'old/' || doc_id || '.md'").alias("old_path"), F.expr(corpora.DOC_PATH).alias("path"),
    )


@query(
    f"WITH {_STATUS}, named AS (SELECT path, CASE WHEN left(status, 1) IN ('A','R','C') THEN 'added' ELSE 'changed' END AS d FROM ev WHERE left(status, 1) <> 'D'), "
    f"{duck.DOCS} SELECT docs.path, coalesce(d, 'unchanged') AS delta FROM docs LEFT JOIN named USING (path)"
)
def delta_changes(spark, sf):
    changed, _ = delta.changes_from_status(_status_rows(spark, sf))
    return delta.against_changes(corpora.documents(spark, sf).select("path"), changed)


_OTHER_PATHS = "CASE doc_id % 4 WHEN 0 THEN replace(path, '.md', '.bin') WHEN 1 THEN 'vendor/' || path ELSE path END"


@query(
    f"WITH {_STATUS}, named AS (SELECT seq, status, {_OTHER_PATHS.replace('doc_id', 'seq')} AS path FROM ev) SELECT path, CASE WHEN left(status, 1) IN ('A','R','C') THEN 'added' ELSE 'changed' END AS delta "
    "FROM named WHERE left(status, 1) <> 'D' AND path LIKE '%.md' AND path NOT LIKE 'vendor/%' AND path LIKE '%1%'"
)
def filtered_changes(spark, sf):
    """Changes named by Windows paths, of which extension and globs leave some; folders like vendor are no reason alone."""
    rows = _status_rows(spark, sf).withColumn("path", F.expr(_OTHER_PATHS.replace("doc_id", "seq")))
    windows = rows.withColumn("path", F.replace("path", F.lit("/"), F.lit("\\")))
    return delta.changes_from_status(windows, include=("*1*",), exclude=("vendor/**",))[0]


@query(f"WITH {_STATUS} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, status, CASE WHEN left(status, 1) IN ('R', 'C') THEN old_path END AS old_path, path FROM ev")
def nul_records(spark, sf):
    """Status records written as NUL-separated cells and read back, each record found from wherever its file was cut."""
    rows = _status_rows(spark, sf)
    named = F.when(F.left("status", F.lit(1)).isin("R", "C"), F.array("status", "old_path", "path")).otherwise(F.array("status", "path"))
    folder = f"{scratch_dir(spark)}/status-{uuid.uuid4().hex}"
    rows.repartitionByRange("seq").sortWithinPartitions("seq").select(F.explode(named).alias("cell")).write.option("lineSep", "\0").text(folder)
    return nul.read_records(spark, folder)


@query(f"WITH {_STATUS} SELECT path FROM ev WHERE left(status, 1) = 'D' UNION SELECT old_path FROM ev WHERE left(status, 1) = 'R'")
def deleted_from_changes(spark, sf):
    return delta.changes_from_status(_status_rows(spark, sf))[1]


@query(
    f"WITH {_STATUS}, new AS (SELECT abs_path AS path FROM cur ANTI JOIN base USING (abs_path)), {duck.SNAPSHOT} "
    "SELECT path, delta FROM (SELECT path, CASE WHEN left(status, 1) IN ('A','R','C') THEN 'added' ELSE 'changed' END AS delta FROM ev "
    "WHERE left(status, 1) <> 'D' AND path NOT IN (SELECT path FROM new)) UNION ALL SELECT path, 'added' FROM new".replace(
        f", new AS (SELECT abs_path AS path FROM cur ANTI JOIN base USING (abs_path)), {duck.SNAPSHOT}",
        f", {duck.SNAPSHOT}, new AS (SELECT abs_path AS path FROM cur ANTI JOIN base USING (abs_path))",
    )
)
def merge_changes(spark, sf):
    tracked, _ = delta.changes_from_status(_status_rows(spark, sf))
    untracked = delta.deleted(corpora.current(spark, sf), corpora.snapshot(spark, sf), "abs_path")
    return delta.merge_changes(tracked, _by_path(untracked))


@query(f"WITH {_CLASSIFIED} SELECT count(*) FILTER (delta = 'added') AS added, count(*) FILTER (delta = 'changed') AS changed, "
       "count(*) FILTER (delta = 'unchanged') AS unchanged, count(*) FILTER (delta = 'unchanged') AS skipped, "
       "(SELECT count(*) FROM base ANTI JOIN cur USING (abs_path)) AS deleted FROM cl")
def delta_counts(spark, sf):
    gone = delta.deleted(corpora.snapshot(spark, sf), corpora.current(spark, sf), "abs_path")
    return rollup.delta_counts(_snapshot_delta(spark, sf), gone)


@query(f"WITH {duck.SNAPSHOT} SELECT abs_path FROM base EXCEPT SELECT abs_path FROM cur")
def deleted_files(spark, sf):
    return delta.deleted(corpora.snapshot(spark, sf), corpora.current(spark, sf), "abs_path")


@query(f"WITH {duck.SNAPSHOT} SELECT abs_path, size, mtime_ns FROM base WHERE abs_path IN (SELECT abs_path FROM cur)")
def touched_state(spark, sf):
    return delta.touched(corpora.snapshot(spark, sf), corpora.current(spark, sf)).select("abs_path", "size", "mtime_ns")


@query(
    f"WITH {duck.SNAPSHOT} SELECT count(*) AS entries, count(*) FILTER (NOT coalesce(base.size = cur.size AND base.mtime_ns = cur.mtime_ns, false)) AS stale_entries "
    "FROM base LEFT JOIN cur USING (abs_path)"
)
def state_diagnostics(spark, sf):
    return delta.diagnostics(corpora.snapshot(spark, sf), corpora.current(spark, sf))


@query(
    f"WITH {duck.SNAPSHOT}, hit AS (SELECT cur.abs_path, base.content AS skeleton FROM cur JOIN base USING (abs_path) "
    f"WHERE cur.size = base.size AND cur.mtime_ns = base.mtime_ns) "
    f"SELECT cur.abs_path, coalesce(hit.skeleton, {duck.first_lines('cur.content', 120)}) AS skeleton, hit.abs_path IS NOT NULL AS reused "
    "FROM cur LEFT JOIN hit USING (abs_path)"
)
def read_through(spark, sf):
    """Renderings come from the snapshot where size and time match; only other files are compressed."""
    entries = corpora.snapshot(spark, sf).select(
        "abs_path", "size", "mtime_ns", F.col("content").alias("full"), F.col("content").alias("skeleton"), F.col("content").alias("tree_map")
    )
    files = corpora.current(spark, sf).withColumn("path", F.col("abs_path"))
    hits, misses = state.read_through(files, state.Snapshot(entries, {}))
    fresh = compress.compress(misses, NATIVE)
    return hits.select("abs_path", "skeleton", F.lit(True).alias("reused")).unionByName(
        fresh.select("abs_path", "skeleton", F.lit(False).alias("reused"))
    )


def _logged(spark, sf) -> KeyedLog:
    """Yesterday's entries as one change, then what became of them as a second one."""
    log = KeyedLog(spark, f"{scratch_dir(spark)}/state-{uuid.uuid4().hex}", "abs_path string, size bigint, mtime_ns bigint, content string", "abs_path")
    before, now = corpora.snapshot(spark, sf), corpora.current(spark, sf)
    log.append(before)
    same = ["abs_path", "size", "mtime_ns"]
    changed = now.join(log.rows("size", "mtime_ns"), same, "left_anti")
    log.append(changed, delta.deleted(log.rows("size"), now, "abs_path"))
    return log


@query(f"WITH {duck.SNAPSHOT} SELECT abs_path, size, mtime_ns, sha256(CASE WHEN same THEN old ELSE content END) AS hash FROM "
       "(SELECT cur.*, base.content AS old, coalesce(cur.size = base.size AND cur.mtime_ns = base.mtime_ns, FALSE) AS same FROM cur LEFT JOIN base USING (abs_path))")
def state_log(spark, sf):
    """The state after two changes: the latest entry of every file that is still there."""
    return _logged(spark, sf).rows().select("abs_path", "size", "mtime_ns", delta.digest(F.col("content")).alias("hash"))


@query(f"WITH {duck.SNAPSHOT} SELECT abs_path, size, mtime_ns FROM cur")
def state_log_compacted(spark, sf):
    """The same rows once both changes have become one segment and the others are removed."""
    log = _logged(spark, sf)
    log.compact()
    log.vacuum()
    return log.rows("size", "mtime_ns")


@query(f"WITH {_CLASSIFIED}, now AS (SELECT abs_path FROM cur) SELECT 'changed' AS change, count(*) FILTER (delta <> 'unchanged') AS rows FROM cl "
       "UNION ALL SELECT 'removed', count(*) FROM base WHERE abs_path NOT IN (SELECT abs_path FROM now)")
def state_log_change(spark, sf):
    """How many rows the second change wrote: those that differ and those that went, no others."""
    log = _logged(spark, sf)
    written = spark.read.parquet(f"{log.path}/segments/segment={log.commits()[-1].segment}")
    kinds = spark.createDataFrame([("changed", False), ("removed", True)], "change string, _removed boolean")
    return kinds.join(written, "_removed", "left").groupBy("change").agg(F.count("abs_path").alias("rows"))


@query(f"WITH {_CLASSIFIED} SELECT abs_path, delta FROM cl")
def state_log_delta(spark, sf):
    """Files classified against a log of two segments, whose buckets stay where they are."""
    log = KeyedLog(spark, f"{scratch_dir(spark)}/state-{uuid.uuid4().hex}", "abs_path string, size bigint, mtime_ns bigint", "abs_path")
    before = corpora.snapshot(spark, sf).select("abs_path", "size", "mtime_ns")
    log.append(before.withColumn("size", F.lit(-1).cast("bigint")))
    log.append(before)
    return delta.against_snapshot(corpora.current(spark, sf).drop("content"), log.rows("size", "mtime_ns")).select("abs_path", "delta")


# -- line operators -------------------------------------------------------------------------------

_DOC_LINES = f"l AS ({duck.exploded('documents', 'doc_id', 'text')})"


@query(f"WITH {_DOC_LINES} SELECT doc_id, pos, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l) WHERE p IS DISTINCT FROM line")
def dedupe_lines(spark, sf):
    t = lines.explode_lines(corpora.table(spark, sf, "documents"), ["doc_id"], "text")
    return lines.drop_repeats(t, ["doc_id"]).withColumn("pos", F.col("pos").cast("bigint"))


_TURN_LINES = (
    "tl AS (SELECT conv_id, turn, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM "
    f"(SELECT *, {duck.lines('text')} AS ls FROM conversations) WHERE len(ls) > 0), "
    "cl AS (SELECT conv_id, {'turn': turn, 'pos': pos} AS ord, line FROM tl)"
)


@query(
    f"WITH {_TURN_LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS a, count(*) OVER (PARTITION BY conv_id) AS n FROM cl), "
    "s AS (SELECT conv_id, ord, a, n, CASE WHEN n > 14 AND a = 11 THEN '...' ELSE line END AS line FROM g WHERE n <= 14 OR a <= 11 OR a > n - 4), "
    "p AS (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY ord) AS prev FROM s) "
    "SELECT conv_id, ord.turn AS turn, ord.pos AS pos, line FROM p WHERE NOT (n > 14 AND a > n - 4 AND coalesce(line = prev, false))"
)
def head_tail_sample(spark, sf):
    t = lines.explode_lines(corpora.table(spark, sf, "conversations"), ["conv_id"], "text", ("turn",), together=False)
    t = t.select("conv_id", F.struct("turn", F.col("pos").cast("bigint").alias("pos")).alias("ord"), "line")
    return lines.sample_runs(t, ["conv_id"], "ord").select("conv_id", "ord.turn", "ord.pos", "line")


_SENTENCES = (
    "sp AS (SELECT doc_id, regexp_split_to_array(text, '[.] ?') AS p FROM documents), "
    "sl AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS x FROM sp)"
)
_IMPORT_LINE = "CASE WHEN (length(x) + pos) % 9 < 7 THEN 'use ' || x ELSE x END"
_GO_LINE = (
    "CASE WHEN (pos + doc_id) % 20 = 1 THEN 'import (' WHEN (pos + doc_id) % 20 = 14 THEN ')' WHEN (pos + doc_id) % 20 = 5 THEN '' "
    "WHEN (pos + doc_id) % 20 > 14 THEN 'import \"' || x || '\"' ELSE '    ' || x END"
)


def _sentences(spark, sf, line: str, syntax: str) -> DataFrame:
    t = corpora.table(spark, sf, "documents").select("doc_id", F.split("text", "[.] ?").alias("p")).repartition("doc_id")
    t = t.select("doc_id", F.posexplode("p").alias("pos", "x"))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.expr(line).alias("line"), F.lit(syntax).alias("syntax"))


@query(
    f"WITH {_SENTENCES}, f AS (SELECT doc_id, pos, {_IMPORT_LINE} AS line FROM sl), k AS (SELECT *, starts_with({duck.trim('line')}, 'use ') AS k FROM f), "
    "i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS isl FROM k), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, isl ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id, k, isl) AS n FROM i) "
    "SELECT doc_id, pos, CASE WHEN k AND n > 5 AND rn = 6 THEN '... ' || (n - 5) || ' more imports' ELSE line END AS line FROM r WHERE NOT (k AND n > 5 AND rn > 6)"
)
def collapse_imports(spark, sf):
    return lines.collapse_imports(_sentences(spark, sf, _IMPORT_LINE, "rust"), ["doc_id"]).drop("syntax")


@query(
    f"WITH {_SENTENCES}, f AS (SELECT doc_id, pos, {_GO_LINE} AS line FROM sl), t AS (SELECT *, {duck.trim('line')} AS b, "
    f"lag({duck.trim('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS pb FROM f), "
    "cs AS (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS prev FROM t WHERE b = ')'), "
    "blk AS (SELECT cs.doc_id, min(t.pos) AS lo, cs.pos AS hi FROM cs JOIN t ON t.doc_id = cs.doc_id AND t.pos > cs.prev AND t.pos < cs.pos "
    "WHERE t.b = 'import (' AND NOT coalesce(starts_with(t.pb, 'import '), false) GROUP BY cs.doc_id, cs.pos), "
    "m AS (SELECT t.*, blk.lo, blk.hi FROM t LEFT JOIN blk ON blk.doc_id = t.doc_id AND t.pos BETWEEN blk.lo AND blk.hi), "
    "e AS (SELECT *, (lo IS NOT NULL AND pos > lo AND pos < hi) AS inb FROM m), "
    "c AS (SELECT *, count(*) FILTER (inb AND b <> '') OVER (PARTITION BY doc_id, lo) AS n, count(*) FILTER (inb AND b <> '') OVER (PARTITION BY doc_id, lo ORDER BY pos) AS nth FROM e), "
    "g AS (SELECT doc_id, pos, lo, CASE WHEN inb AND n > 5 AND nth = 6 THEN '    ... ' || (n - 5) || ' more imports' ELSE line END AS line FROM c "
    "WHERE NOT (inb AND n > 5) OR (b <> '' AND nth <= 6)), "
    "k AS (SELECT *, (lo IS NULL AND starts_with(trim(line), 'import ') AND trim(line) <> 'import (') AS k FROM g), "
    "num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS isl FROM k), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, isl ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id, k, isl) AS rc FROM num) "
    "SELECT doc_id, pos, CASE WHEN k AND rn = 6 THEN '... ' || (rc - 5) || ' more imports' ELSE line END AS line FROM r WHERE NOT k OR rn <= 6"
)
def collapse_import_groups(spark, sf):
    return lines.collapse_imports(_sentences(spark, sf, _GO_LINE, "go"), ["doc_id"]).drop("syntax")


@query(
    f"WITH RECURSIVE {duck.OBJC}, o0 AS (SELECT path, pos, line, row_number() OVER (PARTITION BY path ORDER BY pos) AS i, "
    "(length(line) - length(replace(line, '{', ''))) - (length(line) - length(replace(line, '}', ''))) AS d "
    f"FROM ({duck.exploded('oc')})), walk AS (SELECT path, i, pos, 0 AS depth, greatest(0, d) AS after FROM o0 WHERE i = 1 "
    "UNION ALL SELECT o.path, o.i, o.pos, w.after, greatest(0, w.after + o.d) FROM walk w JOIN o0 o ON o.path = w.path AND o.i = w.i + 1) "
    "SELECT path, pos, CAST(depth AS BIGINT) AS depth FROM walk"
)
def brace_depth(spark, sf):
    t = lines.explode_lines(corpora.objc(spark, sf), ["path"], "content")
    return objc.with_depth(t, ["path"]).select("path", F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"))


@query(
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) > 0 AND length(l) % 3 = 0 THEN '[' || length(l) || ']' "
    "ELSE array_to_string(list_transform(string_split(l, ' '), lambda w: CASE WHEN length(w) >= 7 THEN '…' ELSE w END), ' ') END), chr(10)) AS content "
    "FROM documents WHERE text IS NOT NULL"
)
def span_edit(spark, sf):
    """Long words become an ellipsis, and some lines their length: spans of words inside spans of lines do not count."""
    docs = corpora.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("content"))

    def parts(df, key, value, mark):
        """Parts between marks with their places."""
        cut = df.select(*df.columns, F.posexplode(F.split(value, mark)).alias("n", "part"))
        before = F.sum(F.length("part") + 1).over(W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, -1))
        return cut.withColumn("at", F.coalesce(before, F.lit(0)))

    of_lines = parts(docs, ["doc_id"], "content", "\n").select("doc_id", F.col("n").alias("line"), F.col("at").alias("start"), F.col("part").alias("text"))
    of_words = parts(of_lines, ["doc_id", "line"], "text", " ").where(F.length("part") >= 7)
    found = of_lines.where("length(text) > 0 AND length(text) % 3 = 0").select(
        "doc_id", "start", (F.col("start") + F.length("text")).alias("end"), F.concat(F.lit("["), F.length("text"), F.lit("]")).alias("value")
    ).unionByName(of_words.select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.length("part")).alias("end"), F.lit("…").alias("value")
    ))
    return spans.splice(docs, found, "doc_id")


@query(f"WITH {duck.DOCS} SELECT path, {duck.first_lines('content', 160)} AS outline FROM docs")
def non_empty_lines(spark, sf):
    shown = lines.first_lines(text.lines(F.col("content")), NATIVE, 160)
    return corpora.documents(spark, sf).select("path", text.join_lines(shown).alias("outline"))


@query(
    f"WITH {duck.MARKDOWN} SELECT path, pos, CAST(length(regexp_extract(line, '^[ \\t]*')) + length(replace(regexp_extract(line, '^[ \\t]*'), ' ', '')) AS BIGINT) AS indent "
    f"FROM ({duck.exploded('md')})"
)
def line_indent(spark, sf):
    t = lines.explode_lines(corpora.markdown(spark, sf), ["path"], "content")
    return t.select("path", F.col("pos").cast("bigint").alias("pos"), text.leading_indent(F.col("line")).cast("bigint").alias("indent"))


# -- compressors ----------------------------------------------------------------------------------


@query(f"WITH {duck.MARKDOWN}, {duck.MARKDOWN_VARIANTS} SELECT path, skeleton, tree_map FROM mv")
def markdown_outline(spark, sf):
    return markdown.compress(corpora.markdown(spark, sf), NATIVE).select("path", "skeleton", "tree_map")


@query(f"WITH RECURSIVE {duck.objc_outlines()} SELECT path, skeleton, tree_map FROM ov")
def objc_outline(spark, sf):
    return objc.compress(corpora.objc(spark, sf)).select("path", "skeleton", "tree_map")


def _web_sql(limit: int) -> str:
    kept = (
        f"list_filter(list_transform({duck.lines('content')}, lambda l: {duck.trim('l')}), "
        "lambda l: l <> '' AND NOT starts_with(l, '<!--') AND NOT starts_with(l, '//'))"
    )
    return f"array_to_string(list_transform(list_slice({kept}, 1, {limit}), lambda l: {duck.short('l')}), chr(10))"


@query(f"WITH {duck.PAGES} SELECT path, {_web_sql(160)} AS skeleton, {_web_sql(80)} AS tree_map FROM pg")
def web_outline(spark, sf):
    return corpora.pages(spark, sf).select(
        "path", web.outline(F.col("content"), NATIVE, web.SKELETON_LINES).alias("skeleton"),
        web.outline(F.col("content"), NATIVE, web.MAP_LINES).alias("tree_map"),
    )


@query(f"WITH {duck.code_outlines()} SELECT path, skeleton, tree_map FROM code")
def code_outline(spark, sf):
    return compress.code(corpora.code(spark, sf)).select("path", "skeleton", "tree_map")


@query(f"WITH {duck.config_outlines()} SELECT path, outline AS skeleton, outline AS tree_map FROM conf")
def config_outline(spark, sf):
    return config.outline(corpora.config(spark, sf), NATIVE).select("path", "skeleton", "tree_map")


@query(
    f"WITH RECURSIVE {duck.MARKDOWN}, {duck.MARKDOWN_VARIANTS}, {duck.objc_outlines()}, {duck.PAGES}, {duck.code_outlines()}, {duck.config_outlines()} "
    "SELECT path, skeleton, tree_map FROM mv UNION ALL SELECT path, skeleton, tree_map FROM ov UNION ALL SELECT path, outline, outline FROM conf "
    f"UNION ALL SELECT path, skeleton, tree_map FROM code UNION ALL SELECT path, {_web_sql(160)}, {_web_sql(80)} FROM pg"
)
def compress_corpus(spark, sf):
    """One corpus of all syntax families through the dispatcher."""
    corpus = None
    for part in (corpora.markdown, corpora.objc, corpora.pages, corpora.code, corpora.config):
        files = part(spark, sf).select("path", "content")
        corpus = files if corpus is None else corpus.unionByName(files)
    return compress.compress(compress.layout(corpus), NATIVE).select("path", "skeleton", "tree_map")


_KEYS = (
    "keys AS (SELECT doc_id, lower(source) || CASE doc_id % 6 WHEN 0 THEN '.name' WHEN 1 THEN '-scripts' WHEN 2 THEN 'version' "
    "WHEN 3 THEN '' ELSE '.x' END AS a, ['profile.release','target.x','name','bin','package.metadata.docs','dev-dependencies','nam'][CAST(doc_id % 7 + 1 AS INT)] AS b FROM documents)"
)


def _allow_sql(key: str, name: str) -> str:
    tests = []
    for word in langs.CONFIG_KEYS[name]:
        tests += [f"{key} = '{word}'", f"ends_with({key}, '.{word}')", f"ends_with({key}, '-{word}')"]
        if "." in word or word in ("profile", "target"):
            tests.append(f"starts_with({key}, '{word}.')")
    return "(" + " OR ".join(tests) + ")"


@query(f"WITH {_KEYS} SELECT doc_id, a, b, {_allow_sql('a', 'common')} AS common_a, {_allow_sql('b', 'cargo_toml')} AS cargo_b FROM keys")
def config_allowlist(spark, sf):
    docs = corpora.table(spark, sf, "documents").select(
        "doc_id",
        F.expr("lower(source) || CASE doc_id % 6 WHEN 0 THEN '.name' WHEN 1 THEN '-scripts' WHEN 2 THEN 'version' WHEN 3 THEN '' ELSE '.x' END").alias("a"),
        F.element_at(
            F.array(*[F.lit(k) for k in ("profile.release", "target.x", "name", "bin", "package.metadata.docs", "dev-dependencies", "nam")]),
            (F.col("doc_id") % 7 + 1).cast("int"),
        ).alias("b"),
    )
    return docs.withColumn("common_a", config.key_wanted(F.col("a"), "common")).withColumn(
        "cargo_b", config.key_wanted(F.col("b"), "cargo_toml")
    )


# -- documents ------------------------------------------------------------------------------------

_PAGE_FILES = f"{duck.PAGES}, pf AS (SELECT path, CAST(1 AS INT) AS level, CAST({duck.tokens('content')} AS BIGINT) AS tokens, sha256(content) AS hash, content FROM pg)"


def _page_files(spark, sf) -> DataFrame:
    return corpora.pages(spark, sf).select(
        "path", F.lit(1).alias("level"), NATIVE.count(F.col("content")).alias("tokens"),
        delta.digest(F.col("content")).alias("hash"), "content",
    )


def _entries(spark, sf, fmt: str) -> DataFrame:
    r = render.Renderer(ContextOptions(tokenizer="native", format=fmt, file_hashes=True))
    args = [F.col(c) for c in ("path", "level", "tokens")]
    return _page_files(spark, sf).select(
        "path", r.entry(*args, F.col("hash")).alias("entry"), r.file(*args, F.col("content")).alias("file")
    )


@query(
    f"WITH {_PAGE_FILES} SELECT path, '<entry path=\"' || {duck.xml('path')} || '\" level=\"1\" tokens=\"' || tokens || '\" hash=\"' || hash || '\" />' AS entry, "
    f"'<file path=\"' || {duck.xml('path')} || '\" level=\"1\" tokens=\"' || tokens || '\">' || {duck.xml('content')} || '</file>' AS file FROM pf"
)
def xml_entries(spark, sf):
    return _entries(spark, sf, "xml")


@query(
    f"WITH {_PAGE_FILES} SELECT path, '    {{\"path\":\"' || {duck.js('path')} || '\",\"level\":1,\"tokens\":' || tokens || ',\"hash\":\"' || hash || '\"}}' AS entry, "
    f"'    {{\"path\":\"' || {duck.js('path')} || '\",\"level\":1,\"tokens\":' || tokens || ',\"content\":\"' || {duck.js('content')} || '\"}}' AS file FROM pf"
)
def json_entries(spark, sf):
    return _entries(spark, sf, "json")


@query(
    f"WITH {_PAGE_FILES} SELECT path, path || ' L1 tokens=' || tokens || ' hash=' || hash AS entry, "
    "'--- ' || path || ' L1 tokens=' || tokens || chr(10) || CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END AS file FROM pf"
)
def text_entries(spark, sf):
    return _entries(spark, sf, "text")


_META = render.Metadata("0", "/corpus", 4000, 1)
_DIR = duck.directory("path")


def _placed_sql(section: int, block: str, source: str, d="''", item=0, rank="0", path="''", ends="true") -> str:
    return f"SELECT {section} AS section, {d} AS dir, {item} AS item, CAST({rank} AS BIGINT) AS rank, {path} AS path, {block} AS block, {ends} AS ends_line FROM {source}"


@query(
    f"WITH {_PAGE_FILES}, one AS (SELECT 1), dirs AS (SELECT {_DIR} AS d, count(*) AS n, sum(tokens) AS t FROM pf GROUP BY 1), "
    "o AS (SELECT *, row_number() OVER (ORDER BY tokens DESC, path DESC) = count(*) OVER () AS unused FROM pf), "
    "lastp AS (SELECT path FROM pf ORDER BY -tokens DESC, path DESC LIMIT 1) "
    + " UNION ALL ".join(
        [
            _placed_sql(10, "'{' || chr(10) || '  \"metadata\": {\"generated_at\":\"0\",\"repo_root\":\"/corpus\",\"max_tokens\":4000,\"compression_level\":1,\"file_count\":' || (SELECT count(*) FROM pf) || '},'", "one"),
            _placed_sql(20, "'  \"project_map\": ['", "one"),
            _placed_sql(22, "'    {\"path\":\"' || path || '\",\"level\":1,\"tokens\":' || tokens || '}' || CASE WHEN path = (SELECT path FROM lastp) THEN '' ELSE ',' END", "pf", rank="-tokens", path="path"),
            _placed_sql(29, "'  ],'", "one"),
            _placed_sql(40, "'  \"directory_summaries\": ['", "one"),
            _placed_sql(42, "'    {\"path\":\"' || d || '\",\"files\":' || n || ',\"tokens\":' || t || '}' || CASE WHEN d = (SELECT max(d) FROM dirs) THEN '' ELSE ',' END", "dirs", path="d"),
            _placed_sql(49, "'  ],'", "one"),
            _placed_sql(50, "'  \"files\": ['", "one"),
            _placed_sql(52, f"'    {{\"path\":\"' || path || '\",\"level\":1,\"tokens\":' || tokens || ',\"content\":\"' || {duck.js('content')} || '\"}}' || CASE WHEN path = (SELECT path FROM lastp) THEN '' ELSE ',' END", "pf", rank="-tokens", path="path"),
            _placed_sql(59, "'  ]'", "one"),
            _placed_sql(60, "'}'", "one"),
        ]
    )
)
def json_document(spark, sf):
    options = ContextOptions(tokenizer="native", format="json", sort="tokens", directory_summaries=True, level=1)
    return render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), None, _META)


@query(
    f"WITH {_PAGE_FILES}, {duck.SNAPSHOT}, gone AS (SELECT abs_path AS path FROM base ANTI JOIN cur USING (abs_path)), one AS (SELECT 1), "
    f"dirs AS (SELECT {_DIR} AS d, count(*) AS n, sum(tokens) AS t FROM pf GROUP BY 1) "
    + " UNION ALL ".join(
        [
            _placed_sql(10, "'<repository_context>' || chr(10) || '<metadata generated_at=\"0\" repo_root=\"/corpus\" max_tokens=\"4000\" compression_level=\"1\" file_count=\"' || (SELECT count(*) FROM pf) || '\" />'", "one"),
            _placed_sql(20, "'<project_map mode=\"compact\">'", "one"),
            _placed_sql(22, "'<dir path=\"' || d || '\" files=\"' || n || '\" tokens=\"' || t || '\">'", "dirs", d="d"),
            _placed_sql(22, f"'<entry name=\"' || {duck.name('path')} || '\" level=\"1\" tokens=\"' || tokens || '\" />'", "pf", d=_DIR, item=1, path="path"),
            _placed_sql(22, "'</dir>'", "dirs", d="d", item=2),
            _placed_sql(29, "'</project_map>'", "one"),
            _placed_sql(30, "'<deleted_files>'", "one"),
            _placed_sql(32, "'<deleted path=\"' || path || '\" />'", "gone", path="path"),
            _placed_sql(39, "'</deleted_files>'", "one"),
            _placed_sql(50, "'<files>'", "one"),
            _placed_sql(52, f"'<file path=\"' || path || '\" level=\"1\" tokens=\"' || tokens || '\">' || {duck.xml('content')} || '</file>'", "pf", path="path"),
            _placed_sql(59, "'</files>'", "one"),
            _placed_sql(60, "'</repository_context>'", "one"),
        ]
    )
)
def xml_document(spark, sf):
    options = ContextOptions(tokenizer="native", project_map="compact", level=1)
    gone = delta.deleted(corpora.snapshot(spark, sf), corpora.current(spark, sf), "abs_path")
    return render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), _by_path(gone), _META)


@query(
    f"WITH {_PAGE_FILES}, dirs AS (SELECT {_DIR} AS d, count(*) AS n, sum(tokens) AS t FROM pf GROUP BY 1), one AS (SELECT 1), "
    f"lastf AS (SELECT {_DIR} AS d, max(path) AS p FROM pf GROUP BY 1) "
    + " UNION ALL ".join(
        [
            _placed_sql(20, "'['", "one"),
            _placed_sql(22, "'  {\"path\":\"' || d || '\",\"files\":' || n || ',\"tokens\":' || t || ',\"entries\":['", "dirs", d="d", ends="false"),
            _placed_sql(22, f"'{{\"name\":\"' || {duck.name('path')} || '\",\"level\":1,\"tokens\":' || tokens || '}}' || CASE WHEN path IN (SELECT p FROM lastf) THEN '' ELSE ',' END", "pf", d=_DIR, item=1, path="path", ends="false"),
            _placed_sql(22, "']}' || CASE WHEN d = (SELECT max(d) FROM dirs) THEN '' ELSE ',' END", "dirs", d="d", item=2),
            _placed_sql(29, "']'", "one"),
        ]
    )
)
def compact_map(spark, sf):
    options = ContextOptions(tokenizer="native", format="json", project_map="compact", project_map_only=True, level=1)
    return render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), None, _META)


def _gone(spark, sf) -> DataFrame:
    return _by_path(delta.deleted(corpora.snapshot(spark, sf), corpora.current(spark, sf), "abs_path"))


_TEXT_DOCUMENT = (
    f"{_PAGE_FILES}, {duck.SNAPSHOT}, gone AS (SELECT abs_path AS path FROM base ANTI JOIN cur USING (abs_path)), one AS (SELECT 1), "
    f"dirs AS (SELECT {_DIR} AS d, count(*) AS n, sum(tokens) AS t FROM pf GROUP BY 1), blocks AS ("
    + " UNION ALL ".join(
        [
            _placed_sql(10, "concat_ws(chr(10), 'repository_context', 'generated_at: 0', 'repo_root: /corpus', 'max_tokens: 4000', 'compression_level: 1', 'file_count: ' || (SELECT count(*) FROM pf), '')", "one"),
            _placed_sql(20, "'project_map'", "one"),
            _placed_sql(22, "path || ' L1 tokens=' || tokens", "pf", path="path"),
            _placed_sql(29, "''", "one"),
            _placed_sql(30, "'deleted_files'", "one"),
            _placed_sql(32, "path", "gone", path="path"),
            _placed_sql(39, "''", "one"),
            _placed_sql(40, "'directory_summaries'", "one"),
            _placed_sql(42, "d || ' files=' || n || ' tokens=' || t", "dirs", path="d"),
            _placed_sql(49, "''", "one"),
            _placed_sql(50, "'files'", "one"),
            _placed_sql(52, "'--- ' || path || ' L1 tokens=' || tokens || chr(10) || CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END", "pf", path="path"),
        ]
    )
    + ")"
)


def _text_blocks(spark, sf) -> DataFrame:
    options = ContextOptions(tokenizer="native", format="text", directory_summaries=True, level=1)
    return render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), _gone(spark, sf), _META)


@query(f"WITH {_TEXT_DOCUMENT} SELECT * FROM blocks")
def text_document(spark, sf):
    """The text form, with deleted files and summaries."""
    return _text_blocks(spark, sf)


@query(
    f"WITH {_TEXT_DOCUMENT}, whole AS (SELECT string_agg(block || chr(10), '' ORDER BY section, dir, item, rank, path) AS doc FROM blocks), "
    "lines AS (SELECT unnest(string_split(left(doc, length(doc) - 1), chr(10))) AS line FROM whole) SELECT line, count(*) AS times FROM lines GROUP BY line"
)
def written_document(spark, sf):
    """The same document written by all tasks into one file, and the lines read back from it."""
    target = f"{scratch_dir(spark)}/document-{uuid.uuid4().hex}.txt"
    render.write_file(_text_blocks(spark, sf), target.removeprefix("file:"))
    lines = spark.read.option("lineSep", "\n").text(target)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))


@query(
    f"WITH {_PAGE_FILES}, dirs AS (SELECT {_DIR} AS d, count(*) AS n, sum(tokens) AS t FROM pf GROUP BY 1), one AS (SELECT 1) "
    + " UNION ALL ".join(
        [
            _placed_sql(10, "'<repository_context>' || chr(10) || '<metadata generated_at=\"0\" repo_root=\"/corpus\" max_tokens=\"4000\" compression_level=\"1\" file_count=\"' || (SELECT count(*) FROM pf) || '\" />'", "one"),
            _placed_sql(20, "'<project_map>'", "one"),
            _placed_sql(22, "'<entry path=\"' || path || '\" level=\"1\" tokens=\"' || tokens || '\" hash=\"' || hash || '\" />'", "pf", path="path"),
            _placed_sql(29, "'</project_map>'", "one"),
            _placed_sql(40, "'<directory_summaries>'", "one"),
            _placed_sql(42, "'<directory path=\"' || d || '\" files=\"' || n || '\" tokens=\"' || t || '\" />'", "dirs", path="d"),
            _placed_sql(49, "'</directory_summaries>'", "one"),
            _placed_sql(50, "'<files>'", "one"),
            _placed_sql(52, f"'<file path=\"' || path || '\" level=\"1\" tokens=\"' || tokens || '\">' || {duck.xml('content')} || '</file>'", "pf", path="path"),
            _placed_sql(59, "'</files>'", "one"),
            _placed_sql(60, "'</repository_context>'", "one"),
        ]
    )
)
def hashed_document(spark, sf):
    """The flat XML form with hashes and summaries."""
    options = ContextOptions(tokenizer="native", file_hashes=True, directory_summaries=True, level=1)
    return render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), None, _META)


@query(
    f"WITH {_PAGE_FILES}, {duck.SNAPSHOT}, gone AS (SELECT abs_path AS path FROM base ANTI JOIN cur USING (abs_path)) "
    + " UNION ALL ".join(
        [
            _placed_sql(30, "'  \"deleted_files\": ['", "(SELECT 1)"),
            _placed_sql(32, f"'    {{\"path\":\"' || {duck.js('path')} || '\"}}' || CASE WHEN path = (SELECT max(path) FROM gone) THEN '' ELSE ',' END", "gone", path="path"),
            _placed_sql(39, "'  ],'", "(SELECT 1)"),
        ]
    )
)
def json_deleted(spark, sf):
    """The deleted files of the JSON form."""
    options = ContextOptions(tokenizer="native", format="json", level=1)
    blocks = render.Renderer(options).blocks(stage(_page_files(spark, sf), "page-files"), _gone(spark, sf), _META)
    return blocks.where("section BETWEEN 30 AND 39")


@query(
    "SELECT doc_id, '\"' || replace(replace(replace(replace(replace(text || chr(1) || chr(8) || chr(31) || chr(127) || chr(133), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    ".replace(chr(1), '\\u0001').replace(chr(8), '\\u0008').replace(chr(31), '\\u001f').replace(chr(127), '\\u007f').replace(chr(133), '\\u0085') || '\"' AS quoted FROM documents WHERE text IS NOT NULL"
)
def json_controls(spark, sf):
    """Texts with control characters of every range as JSON strings."""
    controls = "".join(map(chr, (1, 8, 31, 127, 133)))
    docs = corpora.table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.concat(F.lit('"'), text.json_escape(F.concat("text", F.lit(controls))), F.lit('"')).alias("quoted"))


_FIT_ENTRY = "'<entry path=\"' || path || '\" level=\"' || {l} || '\" tokens=\"' || {t} || '\" />'"
_FIT_FILE = "'<file path=\"' || path || '\" level=\"' || {l} || '\" tokens=\"' || {t} || '\">' || {c} || '</file>'"


def _fit_cost(level: str, count: str, content: str) -> str:
    entry = _FIT_ENTRY.format(l=level, t=count)
    file = _FIT_FILE.format(l=level, t=count, c=duck.xml(content))
    return f"{duck.tokens(entry)} + {duck.tokens(file)}"


# tokens of everything around the files: <repository_context>, metadata, map and file section marks
_FIT_FIXED = (
    "'<repository_context><metadata generated_at=\"0\" repo_root=\"/corpus\" max_tokens=\"1\" compression_level=\"1\" file_count=\"1\" />"
    "<project_map></project_map><files></files></repository_context>'"
)
_FIT_SHARE = 0.8


@query(
    f"WITH RECURSIVE {_MDV}, fx AS (SELECT {duck.tokens(_FIT_FIXED)} AS fixed), "
    f"fc AS (SELECT path, t1, t2, t3, {_fit_cost('1', 't1', chr(34) + 'full' + chr(34))} AS r1, "
    f"{_fit_cost('2', 't2', 'skeleton')} AS r2, {_fit_cost('3', 't3', 'tree_map')} AS r3, "
    f"{_fit_cost('1', '0', chr(39) * 2)} AS r0 FROM mc JOIN mv USING (path)), "
    f"lim AS (SELECT CAST(floor(sum(t1) * {_FIT_SHARE}) AS BIGINT) AS lim, sum(t1) AS content, sum(r1) + max(fixed) AS doc, "
    f"greatest(CAST(floor(sum(t1) * {_FIT_SHARE}) AS BIGINT) - sum(r0) - max(fixed), 0) AS budget FROM fc CROSS JOIN fx), "
    f"st AS (SELECT path, 1 AS step, t1 - t2 AS d, r1 - r2 AS rd, {{'s': {duck.leaf('path')} + t1 - {duck.priority('path')}, 't': t1, 'p': path}} AS eff FROM fc UNION ALL "
    f"SELECT path, 2, t2 - t3, r2 - r3, least({{'s': {duck.leaf('path')} + t1 - {duck.priority('path')}, 't': t1, 'p': path}}, "
    f"{{'s': {duck.leaf('path')} + t2 - {duck.priority('path')}, 't': t2, 'p': path}}) FROM fc), "
    "r AS (SELECT *, row_number() OVER w AS n, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS saved, sum(rd) OVER (w ROWS UNBOUNDED PRECEDING) AS shrunk "
    "FROM st WINDOW w AS (ORDER BY eff DESC, step)), "
    "states AS (SELECT 0 AS n, 0 AS saved, 0 AS shrunk UNION ALL SELECT n, saved, shrunk FROM r), "
    "n0 AS (SELECT coalesce(min(CASE WHEN content - saved <= budget THEN n END), max(n)) AS n0 FROM states CROSS JOIN lim), "
    "n1 AS (SELECT coalesce(min(CASE WHEN n >= n0 AND doc - shrunk <= lim THEN n END), max(n)) AS n1 FROM states CROSS JOIN lim CROSS JOIN n0), "
    "taken AS (SELECT path, count(*) AS k FROM r WHERE n <= (SELECT n1 FROM n1) GROUP BY path) "
    f"SELECT fc.path, 1 + coalesce(k, 0) AS level, CAST(CASE 1 + coalesce(k, 0) WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS BIGINT) AS tokens "
    "FROM fc LEFT JOIN taken ON taken.path = fc.path"
)
def fit_document(spark, sf):
    """Levels once the whole XML document, not only its contents, fits the limit."""
    variants = stage(_md_variants(spark, sf), "md-variants")
    total = variants.agg(F.sum(NATIVE.count(F.col("full"))).alias("n")).first().n
    options = ContextOptions(tokenizer="native", level=1, max_tokens=int(total * _FIT_SHARE))
    none = spark.createDataFrame([], "path string")
    _, files, *_ = context.assemble(variants, none, options, render.Metadata("0", "/corpus", options.max_tokens, 1))
    return files.select("path", F.col("level").cast("bigint").alias("level"), "tokens")


_DROP_SHARE = 0.6


@query(
    f"WITH {_MDV}, fx AS (SELECT {duck.tokens(_FIT_FIXED)} AS fixed), "
    f"fc AS (SELECT path, t3, {_fit_cost('3', 't3', 'tree_map')} AS r3 FROM mc JOIN mv USING (path)), "
    f"lim AS (SELECT CAST(floor(sum(t3) * {_DROP_SHARE}) AS BIGINT) AS lim, sum(r3) + max(fixed) AS doc, count(*) AS n FROM fc CROSS JOIN fx), "
    f"d AS (SELECT path, t3, row_number() OVER w AS k, sum(r3) OVER (w ROWS UNBOUNDED PRECEDING) AS gone FROM fc "
    f"WINDOW w AS (ORDER BY {duck.priority('path')}, t3 DESC, path DESC)), "
    "cut AS (SELECT coalesce(min(CASE WHEN doc - gone <= lim THEN k END), max(k)) AS k FROM d CROSS JOIN lim) "
    "SELECT path, CAST(3 AS BIGINT) AS level, CAST(t3 AS BIGINT) AS tokens FROM d CROSS JOIN lim WHERE d.k > least((SELECT k FROM cut), n - 1)"
)
def fit_then_drop(spark, sf):
    """What stays of a document that does not fit with every file at its tree map."""
    variants = stage(_md_variants(spark, sf), "md-variants")
    total = variants.agg(F.sum(NATIVE.count(F.col("tree_map"))).alias("n")).first().n
    options = ContextOptions(tokenizer="native", level=1, max_tokens=int(total * _DROP_SHARE), drop_low_priority=True)
    none = spark.createDataFrame([], "path string")
    _, files, *_ = context.assemble(variants, none, options, render.Metadata("0", "/corpus", options.max_tokens, 1))
    return files.select("path", F.col("level").cast("bigint").alias("level"), "tokens")


# -- clients --------------------------------------------------------------------------------------


@query(
    f"WITH {_PAGE_FILES} SELECT path, CAST(level AS BIGINT) AS level, tokens FROM pf"
)
def map_readback(spark, sf):
    """Project-map rows parsed back from rendered XML entries."""
    r = render.Renderer(ContextOptions(tokenizer="native"))
    files = _page_files(spark, sf)
    entries = files.select(r.entry(F.col("path"), F.col("level"), F.col("tokens"), F.col("hash")).alias("entry"))
    return reports.map_rows(entries, "entry")


@query(f"WITH {_PAGE_FILES} SELECT path, CAST(level AS BIGINT) AS level, tokens FROM pf")
def map_readback_json(spark, sf):
    """Project-map rows parsed back from rendered JSON entries."""
    r = render.Renderer(ContextOptions(tokenizer="native", format="json"))
    files = _page_files(spark, sf)
    entries = files.select(r.entry(F.col("path"), F.col("level"), F.col("tokens"), F.col("hash")).alias("entry"))
    return reports.map_rows(entries, "entry", "json")


@query(
    f"WITH {_PAGE_FILES} SELECT path, lpad(CAST(tokens AS VARCHAR), CAST(greatest(5, length(CAST(tokens AS VARCHAR))) AS INT), ' ') || ' tokens  L' || level || '  ' || path AS line, "
    "tokens || CASE WHEN tokens % 2 = 0 THEN '/4000' ELSE '' END || ' tokens, ' || CASE WHEN tokens % 3 = 0 THEN 'files unknown' ELSE '7 files' END AS status FROM pf"
)
def map_lines(spark, sf):
    files = _page_files(spark, sf)
    tokens_, limit = F.col("tokens"), F.when(F.col("tokens") % 2 == 0, F.lit(4000))
    return files.select(
        "path", reports.map_line(F.col("path"), F.col("level"), tokens_).alias("line"),
        reports.status_line(tokens_, limit, F.when(tokens_ % 3 != 0, F.lit(7))).alias("status"),
    )


@query(
    f"WITH {_PAGE_FILES} SELECT path, CASE WHEN tokens % 2 = 0 THEN tokens % 97 END AS files_included, tokens AS output_tokens, tokens + 5 AS output_tokens_budget, "
    "tokens * 3 AS raw_tokens, tokens AS shrunk_tokens, CASE WHEN tokens % 3 > 0 THEN tokens * 2 END AS tokens_saved, CAST(tokens % 101 AS DOUBLE) AS saving_percent FROM pf"
)
def report_numbers(spark, sf):
    """All seven numbers of printed reports, some of which are not there."""
    n = F.col("tokens")

    def line(name, *parts):
        return F.concat(F.lit(f"\n  {name}: "), *[part.cast("string") for part in parts])

    shown = F.concat(
        F.lit("summary:"), F.when(n % 2 == 0, line("files_included", n % 97)).otherwise(F.lit("")), line("output_tokens", n, F.lit(" / "), n + 5), F.lit("\nstats:"),
        line("raw_tokens", n * 3), line("shrunk_tokens", n), F.when(n % 3 > 0, line("tokens_saved", n * 2)).otherwise(F.lit("")),
        line("saving_percent", F.format_string("%.2f", (n % 101).cast("double"))), F.lit("\n"),
    )
    return reports.parse_reports(_page_files(spark, sf).select("path", shown.alias("report")), "report").drop("report")


@query(
    f"WITH {_PAGE_FILES} SELECT path, CAST(NULL AS BIGINT) AS files_included, tokens AS output_tokens, CAST(4000 AS BIGINT) AS output_tokens_budget, "
    "tokens AS raw_tokens, CAST(NULL AS BIGINT) AS shrunk_tokens, CAST(NULL AS BIGINT) AS tokens_saved, round(tokens / 3.0, 2) AS saving_percent FROM pf"
)
def report_parse(spark, sf):
    """Numbers parsed back from printed reports, one report per file."""
    number = F.col("tokens").cast("string")
    shown = F.concat(
        F.lit("summary:\n  output_tokens: "), number, F.lit(" / 4000\nstats:\n  raw_tokens: "), number,
        F.lit("\n  saving_percent: "), F.format_string("%.2f", F.round(F.col("tokens") / F.lit(3.0), 2)), F.lit("\n"),
    )
    return reports.parse_reports(_page_files(spark, sf).select("path", shown.alias("report")), "report").drop("report")
