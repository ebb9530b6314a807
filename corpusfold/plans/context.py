"""From a corpus to a context document.

Text is read and compressed once; the renderings and their token counts are staged as one columnar
table. Everything that decides levels then reads its narrow columns, and the final pass picks the
visible text per row from the same table, without joining it back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import paths
from corpusfold.functions.tokens import counter_for
from corpusfold.operators import budget, delta, render, rollup
from corpusfold.operators.compress import compress, layout
from corpusfold.options import ContextOptions, check_delta_options
from corpusfold.session import counted_stage, stage
from corpusfold.sources import content as disk
from corpusfold.sources import git, repo, state

Fetch = Callable[[DataFrame], DataFrame]


class OverBudget(RuntimeError):
    pass


class EmptySelection(RuntimeError):
    pass


@dataclass
class Baseline:
    """What a run is compared with: a snapshot, a base directory's rows, or a change list.

    Rows of a directory have a digest of their text, or name files on disk, which are then read where only their
    contents can tell.
    """

    snapshot: state.Snapshot | None = None
    directory: DataFrame | None = None
    changes: DataFrame | None = None
    deleted: DataFrame | None = None
    on_disk: bool = False


@dataclass
class Context:
    """Result tables of a run; ``blocks`` is the document as ordered rows."""

    options: ContextOptions
    selected: DataFrame
    deltas: DataFrame
    deleted: DataFrame
    files: DataFrame
    blocks: DataFrame
    variants: DataFrame
    output_tokens: int
    files_included: int
    files_dropped: int
    raw_tokens: int | None = None
    counts: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def text(self) -> str:
        return render.document_text(self.blocks)

    def pieces(self) -> Iterator[str]:
        return render.document_pieces(self.blocks)

    def write(self, target: str) -> None:
        render.write_document(self.blocks, target)

    def write_file(self, target: str) -> int:
        return render.write_file(self.blocks, target)


def classify(files: DataFrame, options: ContextOptions, base: Baseline) -> DataFrame:
    """Adds delta and included. A change list wins over a directory, which wins over a snapshot."""
    active = options.incremental or base.directory is not None or base.changes is not None
    if base.changes is not None:
        deltas = delta.against_changes(files, base.changes)
    elif base.directory is not None:
        late = "digest" not in base.directory.columns
        deltas = against_files(files, base.directory) if late else delta.against_directory(files, base.directory)
    elif base.snapshot is not None and base.snapshot.taken_under(options.selection()):
        deltas = delta.against_snapshot(files, base.snapshot.seen)
    else:
        deltas = delta.all_added(files)
    return delta.with_inclusion(deltas, active)


def deleted_paths(files: DataFrame, options: ContextOptions, base: Baseline, root: str) -> DataFrame:
    empty = files.sparkSession.createDataFrame([], "path string")
    if base.changes is not None:
        return base.deleted if base.deleted is not None else empty
    if base.directory is not None:
        return delta.deleted(base.directory, files)
    snapshot = base.snapshot
    if not options.incremental or snapshot is None or not snapshot.taken_under(options.selection()):
        return empty
    # a snapshot entry counts as deleted only when its file is gone, not when it is merely unselected
    known = snapshot.seen.select("abs_path")
    gone = disk.probe(known).where("NOT now_exists") if base.on_disk else delta.deleted(known, files, "abs_path")
    prefix = root.rstrip("/") + "/"
    inside = F.substring("abs_path", F.lit(len(prefix) + 1), F.length("abs_path"))
    # an entry from outside of the root keeps its whole path
    shown = F.when(F.startswith("abs_path", F.lit(prefix)), inside).otherwise(F.col("abs_path"))
    return gone.select(F.replace(shown, F.lit("\\"), F.lit("/")).alias("path"))


def against_files(files: DataFrame, base: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Added, changed or unchanged against files on disk, which are read only where path and length agree."""
    known = base.select("path", F.col("size").alias("_size"), F.col("abs_path").alias("_other"))
    met = stage(files.join(known, "path", "left"), "met")
    equal = met.where(F.col("size") == F.col("_size"))
    both = equal.select("path", F.explode(F.array("abs_path", "_other")).alias("abs_path"), "size")
    read = disk.digests(disk.spread(both), seen).groupBy("path").agg((F.min("digest") == F.max("digest")).alias("_same"))
    told = F.when(F.col("_size").isNull(), F.lit("added")).when(F.col("_same"), F.lit("unchanged")).otherwise(F.lit("changed"))
    return met.join(read, "path", "left").withColumn("delta", told).drop("_size", "_other", "_same")


def with_variants(
    files: DataFrame, options: ContextOptions, snapshot: state.Snapshot | None, fetch: Fetch | None = None
) -> DataFrame:
    """Adds full, skeleton and tree_map, and ``fresh``: false where a snapshot's renderings have the same size and time.

    ``fetch`` adds the content to rows without it; it is called for the files without an entry alone.
    """
    counter = counter_for(options.line_tokenizer)

    def anew(rows: DataFrame) -> DataFrame:
        whole = layout(fetch(rows) if fetch else rows)
        return compress(whole, counter).drop("content").withColumn("fresh", F.lit(True))

    if snapshot is None or snapshot.selection is None:
        return anew(files)
    hits, misses = state.read_through(files, snapshot)
    if fetch:
        misses = stage(misses, "misses")
    return hits.drop("kind").withColumn("fresh", F.lit(False)).unionByName(anew(misses))


def counted(variants: DataFrame, options: ContextOptions) -> DataFrame:
    """Adds the start level, content tokens t1..t3 after the per-file cap, and the hash."""
    counter = counter_for(options.tokenizer)
    shown = [budget.visible(F.lit(level), F.col("full"), F.col("skeleton"), F.col("tree_map")) for level in (1, 2, 3)]
    files = variants.withColumn("hash", delta.digest(F.col("full")))
    for level, content in enumerate(shown, 1):
        files = files.withColumn(f"t{level}", counter.count(content))
    files = files.withColumn("level", F.lit(options.level))
    if options.max_file_tokens:
        cap = options.max_file_tokens
        # only a tree map can stay above the cap, so only tree maps are ever cut
        files = files.withColumn("level", budget.cap_level(F.col("level"), cap))
        cut = (F.col("level") == budget.TREE_MAP) & (F.col("t3") > cap)
        files = files.withColumn("_cut", cut)
        files = files.withColumn(
            "tree_map", F.when(F.col("_cut"), counter.truncate(F.col("tree_map"), cap)).otherwise(F.col("tree_map"))
        )
        files = files.withColumn("t3", F.when(F.col("_cut"), counter.count(F.col("tree_map"))).otherwise(F.col("t3")))
        files = files.drop("_cut")
    if options.map_only:
        files = files.withColumn("level", F.lit(budget.TREE_MAP))
    return files


def _costed(files: DataFrame, options: ContextOptions) -> DataFrame:
    """Adds r1..r3, the tokens a file adds to the document at each level, and its cost when empty."""
    counter, renderer = counter_for(options.tokenizer), render.Renderer(options)
    path, file_hash = F.col("path"), F.col("hash")
    for level in (1, 2, 3):
        content = budget.visible(F.lit(level), F.col("full"), F.col("skeleton"), F.col("tree_map"))
        cost = renderer.file_cost(counter, path, F.lit(level), F.col(f"t{level}"), file_hash, content)
        files = files.withColumn(f"r{level}", cost)
    empty = renderer.file_cost(counter, path, F.col("level"), F.lit(0), file_hash, F.lit(""))
    return files.withColumn("r0", empty)


def _at_levels(files: DataFrame) -> DataFrame:
    level = F.col("level")
    return files.select(
        "path", "level", budget.at_level(level).alias("tokens"), "hash",
        budget.visible(level, F.col("full"), F.col("skeleton"), F.col("tree_map")).alias("content"),
    )


def _folder_costs(files: DataFrame, options: ContextOptions) -> Column | None:
    """Tokens one folder adds to the document, as an expression over (dir, files, tokens)."""
    counter, renderer = counter_for(options.tokenizer), render.Renderer(options)
    parts = []
    comma = F.lit("," if options.format == "json" else "")
    if options.project_map == "compact":
        parts.append(renderer.directory(F.col("dir"), F.col("files"), F.col("tokens"), summary=False))
        parts.append(F.lit({"xml": "</dir>", "json": "]},", "text": ""}[options.format]))
    if options.shows_summaries:
        parts.append(F.concat(renderer.directory(F.col("dir"), F.col("files"), F.col("tokens"), summary=True), comma))
    if not parts:
        return None
    cost = counter.count(F.concat_ws("\n", *parts))
    if options.project_map == "compact" and options.format == "json":
        cost = cost - 1  # the last entry of a folder has no comma
    return cost


def _drop(files: DataFrame, options: ContextOptions, rendered_total: int) -> DataFrame:
    """Drop low-priority files until the document fits; a folder's own lines go with its last file."""
    narrow = files.select(
        "path", "level", budget.at_level(F.col("level")).alias("tokens"),
        budget.at_level(F.col("level"), "r").alias("cost"),
    )
    folder_cost = _folder_costs(narrow, options)
    if folder_cost is not None:
        rank = budget.drop_rank(F.col("path"), F.col("tokens"))
        folders = (
            narrow.groupBy(paths.directory(F.col("path")).alias("dir"))
            .agg(
                F.count(F.lit(1)).alias("files"),
                F.sum("tokens").alias("tokens"),
                F.min(rank)["path"].alias("path"),
            )
            .select("path", folder_cost.alias("_folder"))
        )
        narrow = narrow.join(folders, "path", "left").withColumn(
            "cost", F.col("cost") + F.coalesce("_folder", F.lit(0))
        )
    total = narrow.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("v")).first().v
    cut = budget.drop_cut(narrow, options.max_tokens, rendered_total - total)
    tokens = budget.at_level(F.col("level"))
    return files.filter(~cut.applied(budget.drop_rank(F.col("path"), tokens)))


def assemble(variants: DataFrame, deleted: DataFrame, options: ContextOptions, meta: render.Metadata):
    """Levels, files, document and token totals for staged renderings."""
    counter, renderer = counter_for(options.tokenizer), render.Renderer(options)
    # the job that writes the table counts it
    table, seen = counted_stage(
        _costed(counted(variants, options), options), "counted", files=F.count(F.lit(1)), empty=F.sum("r0")
    )

    def tokens_of(files: DataFrame) -> int:
        return render.document_tokens(renderer.blocks(files, deleted, meta), counter).first().tokens

    fixed = render.frame_tokens(renderer.blocks(_at_levels(table), deleted, meta), options, counter)
    content_budget = max(options.max_tokens - (fixed + seen["empty"]), 0)
    _, cut, fits = budget.downgrade_cuts(table, content_budget, options.max_tokens, fixed)
    chosen = budget.apply_cut(table, cut)
    dropped = 0
    if not fits and options.drop_low_priority:
        chosen = _drop(chosen, options, tokens_of(_at_levels(chosen)))
        dropped = seen["files"] - chosen.count()
    files = _at_levels(chosen)
    blocks = renderer.blocks(files, deleted, meta)
    return table, files, blocks, render.document_tokens(blocks, counter).first().tokens, seen["files"] - dropped, dropped


def raw_document_tokens(table: DataFrame, deleted: DataFrame, options: ContextOptions, meta: render.Metadata) -> int:
    """Tokens of the same document with every file in full."""
    full = _at_levels(table.withColumn("level", F.lit(1)))
    blocks = render.Renderer(options).blocks(full, deleted, meta)
    return render.document_tokens(blocks, counter_for(options.tokenizer)).first().tokens


def build_context(
    corpus: DataFrame,
    options: ContextOptions,
    baseline: Baseline | None = None,
    *,
    root: str = "",
    snapshot: state.Snapshot | None = None,
    generated_at: str | None = None,
    with_raw_tokens: bool = False,
    fetch: Fetch | None = None,
) -> Context:
    """Run the plan over selected files (path, abs_path, size, mtime_ns, content).

    With ``fetch`` the files come without contents, and it adds them to the rows that need them.
    """
    base = baseline or Baseline(snapshot=snapshot)
    files = corpus
    if fetch is None:
        corpus = layout(corpus)
        files = corpus.drop("kind")
        if base.directory is not None:
            files = files.withColumn("digest", delta.digest(F.col("content")))
    narrow = classify(files.drop("content"), options, base)
    variants = with_variants(corpus, options, snapshot, fetch)
    if snapshot is not None:
        # kept for the next snapshot; without one the renderings go straight into the counted table
        variants = stage(variants, "variants")
    found = {"selected": F.count(F.lit(1)), **rollup.delta_numbers()}
    deltas, counts = counted_stage(narrow.select("path", "delta", "included"), "deltas", **found)
    gone, removed = counted_stage(deleted_paths(files.drop("content"), options, base, root), "deleted", deleted=F.count(F.lit(1)))
    warnings = []
    if not counts["selected"]:
        message = f"no supported files found under {root or 'the corpus'}"
        if options.fail_on_empty:
            raise EmptySelection(message)
        warnings.append(message)

    included = variants
    if options.incremental or base.directory is not None or base.changes is not None:
        included = variants.join(deltas.filter("included").select("path"), "path", "left_semi")
    meta = render.Metadata(
        generated_at if generated_at is not None else str(int(time.time())), root, options.max_tokens, options.level
    )
    table, chosen, blocks, tokens, kept, dropped = assemble(included, gone, options, meta)
    if tokens > options.max_tokens:
        message = f"output is {tokens} tokens, above the limit of {options.max_tokens}"
        if options.fail_over_budget:
            raise OverBudget(message)
        warnings.append(message + " after all files reached tree map")
    raw = raw_document_tokens(table, gone, options, meta) if with_raw_tokens else None
    return Context(
        options, deltas.select("path"), deltas, gone, chosen, blocks, variants,
        tokens, kept, dropped, raw, counts | removed, warnings,
    )


def repository_context(
    spark: SparkSession,
    root: str,
    options: ContextOptions,
    *,
    state_path: str | None = None,
    incremental_base: str | None = None,
    base_is_directory: bool = True,
    changed_since: str | None = None,
    **kwargs,
) -> Context:
    """Scan a repository and build its context, with the baselines the options name."""
    check_delta_options(options.incremental, incremental_base, changed_since)
    for name in (options.tokenizer, options.line_tokenizer):
        counter_for(name)  # refuse a missing vocabulary before any job starts
    snapshot = state.load(spark, state_path) if state_path else None
    base = Baseline(snapshot=snapshot)
    if changed_since:
        base.changes, base.deleted = git.changes_since(
            spark, root, changed_since, options.include, options.exclude, options.respect_gitignore
        )
    elif incremental_base and base_is_directory:
        base.directory = repo.scan(spark, incremental_base, options, content=False)
    elif incremental_base:
        base.snapshot = state.load_required(spark, incremental_base)
    active = options
    if incremental_base and not base_is_directory:
        active = ContextOptions(**{**options.__dict__, "incremental": True})
    base.on_disk = True
    corpus = repo.scan(spark, root, options, content=False)
    fetch = lambda rows: disk.fetch(disk.spread(rows))
    return build_context(corpus, active, base, root=root, snapshot=snapshot, fetch=fetch, **kwargs)


def save_state(context: Context, path: str) -> None:
    """Keep the renderings of every file seen in this run, and only those.

    Where the snapshot under ``path`` was taken under the same options, the files rendered anew are written and those no
    longer seen are marked; everything else stays as it is.
    """
    selection = context.options.selection()
    known = state.load(context.variants.sparkSession, path)
    if known.selection is None or not known.taken_under(selection):
        state.save(context.variants, path, selection)
        return
    same = ["abs_path", "size", "mtime_ns"]
    new = context.variants.join(known.seen.select(*same), same, "left_anti")
    gone = known.seen.select("abs_path").join(context.variants.select("abs_path"), "abs_path", "left_anti")
    state.update(stage(new, "new-entries"), stage(gone, "gone-entries"), path, selection)


def summaries(context: Context) -> DataFrame:
    return rollup.directory_summaries(context.files)
