"""Token counters.

``native`` counts words (runs of letters, digits and underscores) and single symbols with one JVM
regular expression. It is additive over any split at a line end, which the fit query relies on.
The byte-pair encodings run as Arrow UDFs and refuse to start when their vocabulary is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.functions.text import trim_end

_BLANK = r" \t\n\r\f\x0B"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANK}]"
LED_TOKEN = rf"[{_BLANK}]*(?:{TOKEN})"

# fixed values: accepted model names and the encoding each one stands for
ENCODING_PREFIXES = (
    (("gpt_4o", "gpt_4_1", "gpt_5", "o1", "o3", "o4"), "o200k_base"),
    (("gpt_4", "gpt_3_5", "text_embedding_ada_002"), "cl100k_base"),
)
ENCODING_NAMES = {
    "o200k_base": ("o200k", "o200k_base"),
    "cl100k_base": ("cl100k", "cl100k_base", "openai", "chatgpt"),
    "p50k_base": ("p50k", "p50k_base", "codex", "code", "text_davinci_002", "text_davinci_003"),
    "p50k_edit": ("p50k_edit", "text_davinci_edit_001", "code_davinci_edit_001"),
    "r50k_base": ("r50k", "r50k_base", "gpt2", "gpt_2", "davinci"),
}
DEFAULT_ENCODING = "cl100k_base"


def encoding_column(name: Column) -> Column:
    """Encoding for a model or encoding name; null when the name is unknown."""
    plain = F.translate(F.lower(F.trim(name)), "-.", "__")
    result = F.lit(None).cast("string")
    for encoding, names in ENCODING_NAMES.items():
        result = F.when(plain.isin(*names), F.lit(encoding)).otherwise(result)
    for prefixes, encoding in reversed(ENCODING_PREFIXES):
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | F.startswith(plain, F.lit(prefix))
        result = F.when(hit, F.lit(encoding)).otherwise(result)
    return result


def encoding_for(name: str) -> str:
    """Driver-side twin of :func:`encoding_column` for one option value."""
    plain = name.strip().lower().translate(str.maketrans("-.", "__"))
    for prefixes, encoding in ENCODING_PREFIXES:
        if plain.startswith(prefixes):
            return encoding
    for encoding, names in ENCODING_NAMES.items():
        if plain in names:
            return encoding
    raise ValueError(f"unknown tokenizer {name}; use native or one of {', '.join(ENCODING_NAMES)}")


@dataclass(frozen=True)
class Counter:
    """A named token counter: a count expression and a truncation to at most ``limit`` tokens."""

    name: str

    def count(self, text: Column) -> Column:
        if self.name == "native":
            return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")
        return _bpe_count(self.name)(text)

    def truncate(self, text: Column, limit: int) -> Column:
        if self.name != "native":
            return _bpe_truncate(self.name, limit)(text)
        # the longest prefix that leaves room for the three dots of the ellipsis
        tokens = F.regexp_extract_all(text, F.lit(LED_TOKEN), F.lit(0))
        if limit > 3:
            prefix = F.array_join(F.slice(tokens, 1, limit - 3), "")
        else:
            prefix = F.lit("")
        cut = F.when(F.size(tokens) > limit, F.concat(prefix, F.lit("..."))).otherwise(text)
        # a token holds at least one character, so short texts skip the scan
        return F.when(F.char_length(text) <= limit, text).otherwise(cut)

    def truncate_all(self, texts: Column, limit: int) -> Column:
        """:meth:`truncate` on every element of an array."""
        if self.name == "native":
            return F.transform(texts, lambda text: self.truncate(text, limit))
        return _bpe_truncate_all(self.name, limit)(texts)


def counter_for(name: str) -> Counter:
    """The counter behind an option value; an encoding without vocabulary is refused here."""
    if name == "native":
        return Counter("native")
    encoding = encoding_for(name)
    try:
        _encoder(encoding)
    except Exception as error:
        raise RuntimeError(f"cannot load {encoding} tokenizer: {error}") from error
    return Counter(encoding)


@lru_cache(maxsize=None)
def _encoder(encoding: str):
    import tiktoken

    return tiktoken.get_encoding(encoding)


def _bpe_count(encoding: str):
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(encoding)
        return texts.map(lambda text: len(encoder.encode_ordinary(text)), na_action="ignore")

    return count


def _bpe_truncate(encoding: str, limit: int):
    @F.pandas_udf(T.StringType())
    def truncate(texts: pd.Series) -> pd.Series:
        encoder = _encoder(encoding)
        return texts.map(
            lambda text: longest_fitting(text, limit, lambda s: len(encoder.encode_ordinary(s))),
            na_action="ignore",
        )

    return truncate


def _bpe_truncate_all(encoding: str, limit: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def truncate(arrays: pd.Series) -> pd.Series:
        encoder = _encoder(encoding)

        def size(text: str) -> int:
            return len(encoder.encode_ordinary(text))

        return arrays.map(lambda texts: [longest_fitting(t, limit, size) for t in texts], na_action="ignore")

    return truncate


def longest_fitting(text: str, limit: int, size) -> str:
    """Search on the prefix length: byte-pair counts are not monotone, so the probes matter."""
    if size(text) <= limit:
        return text
    fits, over = 0, len(text) + 1
    while over - fits > 1:
        probe = (fits + over) // 2
        if size(text[:probe].rstrip() + "...") <= limit:
            fits = probe
        else:
            over = probe
    return text[:fits].rstrip() + "..."


def truncate_line(line: Column, counter: Counter, limit: int) -> Column:
    return counter.truncate(trim_end(line), limit)
