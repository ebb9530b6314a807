"""Web templates: trimmed lines without blanks and comment lines, row-wise in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfold.functions import langs, text
from corpusfold.functions.tokens import Counter

SKELETON_LINES, MAP_LINES = 160, 80


def outline(content: Column, counter: Counter, limit: int) -> Column:
    bare = F.transform(text.lines(content), text.trim)
    kept = F.filter(
        bare,
        lambda line: (line != "") & ~F.startswith(line, F.lit("<!--")) & ~F.startswith(line, F.lit("//")),
    )
    return text.join_lines(counter.truncate_all(F.slice(kept, 1, limit), langs.LINE_TOKEN_LIMIT))
