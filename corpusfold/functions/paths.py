"""Path expressions: names, selection predicates, glob patterns and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfold.functions import langs


def normalize(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension, empty when there is none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*langs.EXTENSIONS)


def syntax(path: Column) -> Column:
    return _lookup(extension(path), langs.SYNTAX)


def parser_mode(path: Column) -> Column:
    return F.when(syntax(path).isin(*langs.CODE_SYNTAXES), F.lit("tree-sitter")).otherwise(F.lit("compact"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    groups: dict[str, list[str]] = {}
    for word, value in table.items():
        groups.setdefault(value, []).append(word)
    result = F.lit(None).cast("string")
    for value, words in groups.items():
        result = F.when(key.isin(*words), F.lit(value)).otherwise(result)
    return result


def fits_size(size: Column, limit: int | None) -> Column:
    return F.lit(True) if not limit else F.coalesce(size <= limit, F.lit(True))


def is_lockfile(name: Column) -> Column:
    return name.isin(*langs.LOCKFILES)


def is_minified(name: Column) -> Column:
    return F.contains(name, F.lit(".min."))


def has_generated_name(name: Column) -> Column:
    test = F.lit(False)
    for part in langs.GENERATED_NAME_PARTS:
        test = test | F.contains(name, F.lit(part))
    for ending in langs.GENERATED_NAME_ENDINGS:
        test = test | F.endswith(name, F.lit(ending))
    return test


def is_generated(path: Column) -> Column:
    lowered = F.lower(path)
    name = file_name(lowered)
    components = F.array(*[F.lit(word) for word in langs.GENERATED_COMPONENTS])
    return (
        F.arrays_overlap(F.split(lowered, "/"), components)
        | is_lockfile(name)
        | is_minified(name)
        | has_generated_name(name)
    )


def in_git_dir(path: Column) -> Column:
    return F.contains(path, F.lit("/.git/")) | F.startswith(path, F.lit(".git/"))


def glob_to_regex(pattern: str) -> str:
    """Regular expression for one glob: ``*`` and ``?`` cross ``/``, plus ``**``, ``[..]``, ``{a,b}``."""
    out: list[str] = []
    depth = 0
    at = 0
    while at < len(pattern):
        ch = pattern[at]
        rest = pattern[at:]
        starts_component = at == 0 or pattern[at - 1] == "/"
        if rest.startswith("**/") and starts_component:
            out.append("(?:.*/)?")
            at += 3
        elif rest == "**" and pattern[:at].endswith("/"):
            out.append(".+")
            at += 2
        elif ch == "*":
            out.append(".*")
            at += 1
        elif ch == "?":
            out.append(".")
            at += 1
        elif ch == "[":
            found = re.match(r"\[([!^]?)(\]?[^\]]*)\]", rest)
            if not found or not found.group(2):
                raise ValueError(f"invalid glob pattern {pattern}: unclosed character class")
            members = re.sub(r"([\\\[\]&^~])", r"\\\1", found.group(2))
            out.append(f"[{'^' if found.group(1) else ''}{members}]")
            at += found.end()
        elif ch == "{":
            depth += 1
            out.append("(?:")
            at += 1
        elif ch == "}":
            if not depth:
                raise ValueError(f"invalid glob pattern {pattern}: unopened alternate group")
            depth -= 1
            out.append(")")
            at += 1
        elif ch == "," and depth:
            out.append("|")
            at += 1
        elif ch == "\\" and len(rest) > 1:
            out.append(re.escape(rest[1]))
            at += 2
        else:
            out.append(re.escape(ch))
            at += 1
    if depth:
        raise ValueError(f"invalid glob pattern {pattern}: unclosed alternate group")
    return "(?s)^" + "".join(out) + "$"


def matches_any_glob(path: Column, patterns) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | F.rlike(path, F.lit(glob_to_regex(pattern)))
    return test


def passes_globs(path: Column, include, exclude) -> Column:
    wanted = matches_any_glob(path, include) if include else F.lit(True)
    return wanted & ~matches_any_glob(path, exclude)


def priority(path: Column) -> Column:
    """How much a file resists compression and dropping."""
    name = file_name(path)
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    workflows = ".github/workflows/"
    scores = langs.PRIORITY_SCORES
    return (
        F.when(name.isin(*langs.PRIORITY_MANIFESTS), F.lit(scores["manifest"]))
        .when(name.isin(*langs.PRIORITY_ENTRY_POINTS), F.lit(scores["entry_point"]))
        .when(
            F.startswith(path, F.lit(workflows)) | F.contains(path, F.lit("/" + workflows)),
            F.lit(scores["workflow"]),
        )
        .when(ext.isin(*langs.PRIORITY_CONFIG_EXTENSIONS), F.lit(scores["config"]))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def leaf_score(path: Column) -> Column:
    """Deep and long paths score high: 1000 per separator plus the byte length."""
    separators = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return (separators * 1000 + F.octet_length(path)).cast("bigint")


def downgrade_score(path: Column, tokens: Column) -> Column:
    return leaf_score(path) + tokens - priority(path)
