"""Selection of files and of incremental subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import paths
from corpusfold.options import ContextOptions


def selection(options: ContextOptions, path: Column, size: Column) -> Column:
    """Extension, size, globs and generated-file test; an explicit include overrides the last."""
    test = paths.is_supported(path) & paths.fits_size(size, options.max_file_bytes)
    test = test & paths.passes_globs(path, options.include, options.exclude) & ~paths.in_git_dir(path)
    if options.exclude_generated:
        wanted = paths.matches_any_glob(path, options.include)
        test = test & (wanted | ~paths.is_generated(path))
    return test


def select(corpus: DataFrame, options: ContextOptions) -> DataFrame:
    return corpus.filter(selection(options, F.col("path"), F.col("size")))
