"""Text expressions: lines, trimming, truncation and escaping. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# every character of the Unicode White_Space class
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where it stands inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def trim_end(value: Column) -> Column:
    return F.rtrim(value, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """Lines without their terminators; a final terminator opens no extra line."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.endswith(unix, F.lit("\n")), F.left(unix, F.length(unix) - 1)).otherwise(unix)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def marked_lines(text: Column) -> Column:
    """Lines each of which has a line end in front of it."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(text, 2, 1 << 30), "\n", -1))


def join_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def truncate_chars(value: Column, limit: int) -> Column:
    """Texts over ``limit`` characters keep ``limit - 3`` of them plus an ellipsis."""
    return F.when(F.char_length(value) > limit, F.concat(F.left(value, F.lit(limit - 3)), F.lit("..."))).otherwise(value)


def leading_indent(line: Column) -> Column:
    """Width of the leading blanks; a tab counts two."""
    blanks = F.regexp_extract(line, "^[ \t]*", 0)
    tabbed = F.length(blanks) + F.length(F.replace(blanks, F.lit(" "), F.lit("")))
    # few lines have tabs, and a pattern costs more than trimming
    return F.when(F.contains(line, F.lit("\t")), tabbed).otherwise(F.length(line) - F.length(F.ltrim(line, F.lit(" "))))


def starts_with_any(value: Column, prefixes) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.startswith(value, F.lit(prefix))
    return test


def xml_escape(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def xml_unescape(value: Column) -> Column:
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        value = F.replace(value, F.lit(entity), F.lit(raw))
    return value


_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_OTHER_CONTROLS = [c for c in (*range(0x00, 0x20), *range(0x7F, 0xA0)) if chr(c) not in "\n\r\t"]


def json_escape(value: Column) -> Column:
    for raw, escaped in _SHORT_ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    # the remaining control characters are rare, so the replacement loop runs only where one occurs
    codes = F.array(*[F.lit(c) for c in _OTHER_CONTROLS])
    spelled = F.aggregate(
        codes,
        value,
        lambda text, code: F.replace(text, F.char(code), F.format_string("\\u%04x", code)),
    )
    return F.when(F.rlike(value, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")), spelled).otherwise(value)
