"""Documents as ordered rows.

A document is a table of blocks; reading them in order gives the text. No task ever holds more than
its own rows, so documents of any size can be written. Sort columns: section, dir, item, rank, path.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import paths, text
from corpusfold.functions.tokens import Counter
from corpusfold.operators import rollup
from corpusfold.operators.sink import write_single
from corpusfold.options import ContextOptions

ORDER = ("section", "dir", "item", "rank", "path")
_BEFORE, _HEAD, _MAP, _DELETED, _SUMMARIES, _FILES, _END, _AFTER = range(0, 80, 10)
# fixed values: the texts put around a document when it is wrapped as a prompt
_DEFAULT_TASK = (
    "Use this repo context to explain the architecture, identify the main entry points, and tell me where to "
    "start reading."
)
_WRAPPED = "{task}\n\nThe context below is compressed {name}. Use it as the source of truth before answering.\n\n<context>"


@dataclass(frozen=True)
class Metadata:
    generated_at: str
    repo_root: str
    max_tokens: int
    compression_level: int


def _text(value: Column) -> Column:
    return value.cast("string")


def _joined(*parts) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


class Renderer:
    """Blocks of one format under one set of options."""

    def __init__(self, options: ContextOptions):
        self.o = options
        self.indent = "" if options.project_map_only else "  "

    # -- one row at a time ------------------------------------------------------------------

    def _quoted(self, value: Column) -> Column:
        if self.o.format == "xml":
            return text.xml_escape(value)
        return text.json_escape(value) if self.o.format == "json" else value

    def _fields(self, pairs: list[tuple[str, Column]]) -> Column:
        """Numeric and hash fields after a name; a null field is left out."""
        shape = {
            "xml": lambda name, value: _joined(f' {name}="', value, '"'),
            "json": lambda name, value: _joined(
                f',"{name}":', *(('"', value, '"') if name == "hash" else (value,))
            ),
            "text": lambda name, value: _joined(" L" if name == "level" else f" {name}=", value),
        }[self.o.format]
        return F.concat_ws("", *[shape(name, _text(value)) for name, value in pairs])

    def _file_fields(self, level: Column, tokens: Column, file_hash: Column | None = None) -> Column:
        pairs = [("level", level)]
        if self.o.token_counts:
            pairs.append(("tokens", tokens))
        if file_hash is not None and self.o.file_hashes:
            pairs.append(("hash", file_hash))
        return self._fields(pairs)

    def entry(self, path: Column, level: Column, tokens: Column, file_hash: Column) -> Column:
        """One line of the project map, without a separator."""
        compact = self.o.project_map == "compact"
        name = self._quoted(paths.file_name(path) if compact else path)
        fields = self._file_fields(level, tokens, file_hash)
        label = "name" if compact else "path"
        if self.o.format == "xml":
            return _joined(f'<entry {label}="', name, '"', fields, " />")
        if self.o.format == "json":
            pad = "" if compact else self.indent + "  "
            return _joined(pad + f'{{"{label}":"', name, '"', fields, "}")
        return _joined(name, fields)

    def directory(self, path: Column, files: Column, tokens: Column, *, summary: bool) -> Column:
        pairs = [("files", files)] + ([("tokens", tokens)] if self.o.token_counts else [])
        name, fields = self._quoted(path), self._fields(pairs)
        if self.o.format == "xml":
            return (
                _joined('<directory path="', name, '"', fields, " />")
                if summary
                else _joined('<dir path="', name, '"', fields, ">")
            )
        if self.o.format == "json":
            pad = self.indent + "  "
            return _joined(pad + '{"path":"', name, '"', fields, "}" if summary else ',"entries":[')
        return _joined(name, fields) if summary else _joined("[", name, "]", fields)

    def deleted(self, path: Column) -> Column:
        name = self._quoted(path)
        if self.o.format == "xml":
            return _joined('<deleted path="', name, '" />')
        return _joined('    {"path":"', name, '"}') if self.o.format == "json" else name

    def file(self, path: Column, level: Column, tokens: Column, content: Column) -> Column:
        name, fields = self._quoted(path), self._file_fields(level, tokens)
        if self.o.format == "xml":
            return _joined('<file path="', name, '"', fields, ">", self._quoted(content), "</file>")
        if self.o.format == "json":
            return _joined('    {"path":"', name, '"', fields, ',"content":"', self._quoted(content), '"}')
        return _joined("--- ", name, fields, "\n", F.regexp_replace(content, r"\n\z", ""))

    def metadata(self, meta: Metadata, file_count: Column) -> Column:
        pairs = [
            ("generated_at", F.lit(meta.generated_at), True),
            ("repo_root", self._quoted(F.lit(meta.repo_root)), True),
            ("max_tokens", F.lit(meta.max_tokens), False),
            ("compression_level", F.lit(meta.compression_level), False),
            ("file_count", file_count, False),
        ]
        if self.o.format == "xml":
            cells = [_joined(f'{name}="', _text(value), '"') for name, value, _ in pairs]
            return _joined("<repository_context>\n<metadata ", F.concat_ws(" ", *cells), " />")
        if self.o.format == "json":
            cells = [
                _joined(f'"{name}":', '"' if quoted else "", _text(value), '"' if quoted else "")
                for name, value, quoted in pairs
            ]
            return _joined('{\n  "metadata": {', F.concat_ws(",", *cells), "},")
        cells = [_joined(f"{name}: ", _text(value)) for name, value, _ in pairs]
        return _joined("repository_context\n", F.concat_ws("\n", *cells), "\n")

    def file_cost(self, counter: Counter, path, level, tokens, file_hash, content) -> Column:
        """Tokens one file adds to the document: its map entry and, if shown, its contents."""
        comma = F.lit("," if self.o.format == "json" else "")
        cost = counter.count(F.concat(self.entry(path, level, tokens, file_hash), comma))
        if self.o.shows_files:
            cost = cost + counter.count(F.concat(self.file(path, level, tokens, content), comma))
        return cost

    # -- the whole document -----------------------------------------------------------------

    def blocks(self, files: DataFrame, deleted: DataFrame | None, meta: Metadata) -> DataFrame:
        """Rows (section, dir, item, rank, path, block, ends_line)."""
        o, json = self.o, self.o.format == "json"
        spark = files.sparkSession
        file_count = files.agg(F.count(F.lit(1)).alias("n")).scalar()
        shown_deleted = deleted if deleted is not None and o.shows_deleted else None
        has_deleted = F.lit(False)
        if shown_deleted is not None:
            has_deleted = shown_deleted.agg((F.count(F.lit(1)) > 0).alias("b")).scalar()
        has_summaries = file_count > 0 if o.shows_summaries else F.lit(False)

        fixed: list[tuple[int, Column, Column]] = []

        def add(section: int, block, when: Column = F.lit(True)) -> None:
            fixed.append((section, F.lit(block) if isinstance(block, str) else block, when))

        def comma_if(*later: Column) -> Column:
            test = F.lit(False)
            for one in later:
                test = test | one
            return F.when(test, F.lit(",")).otherwise(F.lit(""))

        def section(base: int, name: str, when: Column, later: list[Column], attributes: str = "", may_be_empty: bool = False) -> None:
            if o.format == "xml":
                add(base, f"<{name}{attributes}>", when)
                add(base + 9, f"</{name}>", when)
            elif json:
                add(base, self.indent + (f'"{name}": [' if self.indent else "["), when)
                if may_be_empty:
                    add(base + 1, "", file_count == 0)
                add(base + 9, F.concat(F.lit(self.indent + "]"), comma_if(*later)), when)
            else:
                add(base, name + (" compact" if attributes else ""), when)
                if name != "files":
                    add(base + 9, "", when)

        compact = o.project_map == "compact"
        if not o.project_map_only:
            add(_HEAD, self.metadata(meta, file_count))
        shows_files = F.lit(o.shows_files)
        section(
            _MAP, "project_map", F.lit(True), [has_deleted, has_summaries, shows_files],
            ' mode="compact"' if compact else "", may_be_empty=True,
        )
        if shown_deleted is not None:
            section(_DELETED, "deleted_files", has_deleted, [has_summaries, shows_files])
        if o.shows_summaries:
            section(_SUMMARIES, "directory_summaries", has_summaries, [shows_files])
        if o.shows_files:
            section(_FILES, "files", F.lit(True), [], may_be_empty=True)
        if not o.project_map_only and o.format != "text":
            add(_END, "</repository_context>" if o.format == "xml" else "}")
        if o.prompt or o.ask_template is not None:
            name = {"xml": "XML", "json": "JSON", "text": "text"}[o.format]
            task = o.ask_template if o.ask_template is not None else _DEFAULT_TASK
            add(_BEFORE, _WRAPPED.format(task=task, name=name))
            add(_AFTER, "</context>")

        result = self._fixed_rows(spark, fixed)
        for part in self._row_parts(files, shown_deleted, compact, json):
            result = result.unionByName(part)
        return result

    def _fixed_rows(self, spark: SparkSession, fixed) -> DataFrame:
        cells = [F.struct(F.lit(s).alias("section"), b.alias("block"), w.alias("shown")) for s, b, w in fixed]
        rows = spark.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("shown")
        return _placed(rows, F.col("section"), F.col("block"))

    def _row_parts(self, files: DataFrame, deleted: DataFrame | None, compact: bool, json: bool):
        o = self.o
        col = F.col
        rank = self._rank()
        path, level, tokens = col("path"), col("level"), col("tokens")

        def comma(is_last: Column) -> Column:
            return F.when(is_last, F.lit("")).otherwise(F.lit(",")) if json else F.lit("")

        def last_of(df: DataFrame, *keys: Column) -> Column:
            return df.agg(F.max(F.struct(*keys)).alias("k")).scalar()

        entry = self.entry(path, level, tokens, col("hash"))
        if compact:
            folder = paths.directory(path)
            # the last entry of every folder, as a pre-aggregated table of one row per folder
            folders = files.groupBy(folder.alias("dir")).agg(
                F.count(F.lit(1)).alias("files"),
                F.sum("tokens").alias("tokens"),
                F.max(F.struct(rank.alias("rank"), path.alias("path"))).alias("last"),
            )
            opened = self.directory(col("dir"), col("files"), tokens, summary=False)
            yield _placed(folders, F.lit(_MAP + 2), opened, dir=col("dir"), ends_line=not json)
            if json:
                # joined on the unique path, not on the folder, which may hold a third of all files
                lasts = folders.select(col("last.path").alias("path"), F.lit(True).alias("is_last"))
                marked = files.join(lasts, "path", "left")
                block = F.concat(entry, comma(F.coalesce("is_last", F.lit(False))))
                yield _placed(marked, F.lit(_MAP + 2), block, dir=folder, item=1, rank=rank, path=path, ends_line=False)
                final = col("dir") == folders.agg(F.max("dir").alias("d")).scalar()
                yield _placed(folders, F.lit(_MAP + 2), F.concat(F.lit("]}"), comma(final)), dir=col("dir"), item=2)
            else:
                yield _placed(files, F.lit(_MAP + 2), entry, dir=folder, item=1, rank=rank, path=path)
                if o.format == "xml":
                    yield _placed(folders, F.lit(_MAP + 2), F.lit("</dir>"), dir=col("dir"), item=2)
        is_last = F.struct(rank, path) == last_of(files, rank, path) if json else F.lit(False)
        if not compact:
            yield _placed(files, F.lit(_MAP + 2), F.concat(entry, comma(is_last)), rank=rank, path=path)
        if deleted is not None:
            last = path == deleted.agg(F.max("path").alias("p")).scalar() if json else F.lit(False)
            yield _placed(deleted, F.lit(_DELETED + 2), F.concat(self.deleted(path), comma(last)), path=path)
        if o.shows_summaries:
            summaries = rollup.directory_summaries(files)
            last = path == summaries.agg(F.max("path").alias("p")).scalar() if json else F.lit(False)
            block = F.concat(self.directory(path, col("files"), tokens, summary=True), comma(last))
            yield _placed(summaries, F.lit(_SUMMARIES + 2), block, path=path)
        if o.shows_files:
            block = F.concat(self.file(path, level, tokens, col("content")), comma(is_last))
            yield _placed(files, F.lit(_FILES + 2), block, rank=rank, path=path)

    def _rank(self) -> Column:
        if self.o.sort == "tokens":
            return -F.col("tokens")
        if self.o.sort == "priority":
            return -paths.priority(F.col("path"))
        return F.lit(0).cast("bigint")


def _placed(df, section, block, *, dir=None, item=0, rank=None, path=None, ends_line=True) -> DataFrame:
    return df.select(
        section.cast("int").alias("section"),
        (dir if dir is not None else F.lit("")).alias("dir"),
        F.lit(item).alias("item"),
        (rank if rank is not None else F.lit(0)).cast("bigint").alias("rank"),
        (path if path is not None else F.lit("")).alias("path"),
        block.alias("block"),
        F.lit(ends_line).alias("ends_line"),
    )


def document_tokens(blocks: DataFrame, counter: Counter) -> DataFrame:
    """Tokens of the document; the counters are additive across line ends."""
    return blocks.agg(F.coalesce(F.sum(counter.count(F.col("block"))), F.lit(0)).alias("tokens"))


def frame_tokens(blocks: DataFrame, options: ContextOptions, counter: Counter) -> int:
    """Tokens of everything but the files' own rows, in the terms of :meth:`Renderer.file_cost`.

    No file text is read: the optimizer drops the filtered rows' branches of the union.
    """
    compact = options.project_map == "compact"
    entries = (F.col("section") == _MAP + 2) & (F.col("item") == (1 if compact else 0))
    contents = F.col("section") == _FILES + 2
    tokens = document_tokens(blocks.filter(~entries & ~contents), counter).first().tokens
    if options.format != "json":
        return tokens
    # file costs include a comma, which the last row of every list does not have
    if compact:
        lists = blocks.filter((F.col("section") == _MAP + 2) & (F.col("item") == 2)).count()
    else:
        lists = min(blocks.filter(entries).limit(1).count(), 1)
    return tokens - lists - (options.shows_files and lists > 0)


def document_pieces(blocks: DataFrame) -> Iterator[str]:
    """The document piece by piece, in order; one partition of it is on the driver at a time."""
    for row in blocks.orderBy(*ORDER).select("block", "ends_line").toLocalIterator():
        yield row.block + ("\n" if row.ends_line else "")


def document_text(blocks: DataFrame) -> str:
    """The document as one string, for documents that are meant to be one; others are written."""
    return "".join(document_pieces(blocks))


def write_document(blocks: DataFrame, target: str) -> None:
    """Text part files whose concatenation in name order is the document.

    The text sink ends every row with a line end, so a compact JSON map gains insignificant ones.
    """
    blocks.orderBy(*ORDER).select("block").write.mode("overwrite").text(target)


def write_file(blocks: DataFrame, target: str) -> int:
    """The document as one file with the bytes of :func:`document_text`, written by all tasks; returns its bytes."""
    ended = F.concat(F.col("block"), F.when(F.col("ends_line"), F.lit("\n")).otherwise(F.lit("")))
    return write_single(blocks, F.struct(*ORDER), ended, target)
