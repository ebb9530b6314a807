"""Outline of JSON, YAML and TOML texts, as expressions.

Each line is first described on its own: what it says, how deep it stands, whether it opens or closes a
section. One fold over these descriptions then keeps the open sections and decides what is shown. It
stops adding lines at the larger limit, so its state is small however long the text is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import langs, paths, text
from corpusfold.functions.tokens import Counter
from corpusfold.operators import lines as L

SKELETON_LINES, MAP_LINES = 180, 100
ARRAY_ITEMS = 12
_SECTION = "struct<indent:int,wanted:boolean,table:boolean>"
_STATE = f"struct<open:array<{_SECTION}>,items:int,elided:boolean,n:int,shown:string,skeleton:int,tree_map:int>"


def key_wanted(key: Column, profile: str) -> Column:
    """Whether a key is on a profile's list: equal, as a last part, or as a dotted prefix."""
    names = langs.CONFIG_KEYS[profile]
    prefixes = [w for w in names if "." in w or w in langs.CONFIG_PREFIX_KEYS]
    # one expression for the whole list; a list of tests would read the key once a word
    pattern = rf"(?s)^(?:.*[.-])?(?:{_any_of(names)})\z"
    if prefixes:
        pattern += rf"|^(?:{_any_of(prefixes)})\."
    return key.rlike(pattern)


def _any_of(names) -> str:
    return "|".join(re.sub(r"[^\w]", r"\\\g<0>", name) for name in names)


def profiles(path: Column) -> dict[str, Column]:
    """Manifest profiles, each with the test whether a path belongs to it."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    package = name == "package.json"
    return {
        "package_json": package,
        "editor_manifest": package & F.exists(parts, lambda p: F.contains(p, F.lit("vscode")) | F.contains(p, F.lit("extension"))),
        "cargo_toml": name == "Cargo.toml",
        "agent_plugin": (name == "plugin.json") & path.rlike(r"(^|/)\.codex-plugin/"),
        "workflow": path.rlike(r"(^|/)\.github/(.*/)?workflows(/|$)"),
    }


def _key(bare: Column) -> Column:
    """The key of a line in lower case: up to a colon, else up to an equals sign; null where there is neither."""
    quoted = F.split(F.substring(bare, 2, 1 << 30), '"', 2)[0]
    before = F.when(F.contains(bare, F.lit(":")), F.split(bare, ":", 2)[0]).when(F.contains(bare, F.lit("=")), F.split(bare, "=", 2)[0])
    plain = F.regexp_replace(F.regexp_replace(text.trim(before), "^(?:- )+", ""), '^"+|"+$', "")
    return F.lower(F.when(F.startswith(bare, F.lit('"')), quoted).otherwise(plain))


def _describe(raw: Column, ext: Column, of_path: dict[str, Column]) -> Column:
    """What a line is, whatever stands around it."""
    seen = text.let(text.trim(raw), lambda bare: F.struct(bare.alias("bare"), _key(bare).alias("key"), text.leading_indent(raw).alias("indent")))
    return text.let(seen, lambda of: _described(raw, of["bare"], of["key"], of["indent"], ext, of_path))


def _described(raw: Column, bare: Column, key: Column, indent: Column, ext: Column, of_path: dict[str, Column]) -> Column:
    def starts(*marks: str) -> Column:
        return text.starts_with_any(bare, marks)

    def has(mark: str) -> Column:
        return F.contains(bare, F.lit(mark))

    bracketed = starts("[") & F.endswith(bare, F.lit("]"))
    table = (ext == "toml") & bracketed
    comment = F.when(ext == "json", starts("//")).when(ext.isin("yaml", "yml", "toml"), starts("#")).otherwise(False)
    heading = F.lower(text.trim(F.regexp_replace(bare, r"^[\[\]]+|[\[\]]+$", "")))

    def wanted_by(profile: str) -> Column:
        return F.coalesce(F.when(table, key_wanted(heading, profile)).otherwise(key_wanted(key, profile)), F.lit(False))

    wanted = F.coalesce(key_wanted(key, "common"), F.lit(False)) | F.when(table, wanted_by("common")).otherwise(False)
    for profile, member in of_path.items():
        wanted = wanted | (member & wanted_by(profile))
    return F.struct(
        bare.alias("bare"), indent.cast("int").alias("indent"), bracketed.alias("bracketed"), table.alias("table"),
        (comment & ~raw.rlike("^[ \t]")).alias("remark"),
        ((bare == "") | starts("#", "//") | bare.isin("{", "}", "[", "]", ",", "},", "],")).alias("noise"),
        (starts("{", "-", "[[") | (starts('"') & ~has(":")) | (F.endswith(bare, F.lit(",")) & ~has(":") & ~has("="))).alias("item"),
        (starts("[") | ((indent <= 2) & starts('"')) | ((indent == 0) & ~starts("-") & (has(":") | has("=")))).alias("headline"),
        wanted.alias("wanted"), starts("}", "]").alias("closes"),
        (table | F.endswith(bare, F.lit("{")) | F.endswith(bare, F.lit("[")) | F.endswith(bare, F.lit(":"))).alias("opens"),
    )


def _up_to_last(sections: Column, stays) -> Column:
    """Sections up to the last one that ``stays``; those inside of it are left."""
    depth = F.aggregate(
        F.transform(sections, lambda s, i: F.when(stays(s), i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b)
    )
    return F.slice(sections, F.lit(1), depth)


def _around(acc: Column, line: Column, ext: Column) -> Column:
    """The sections still open at a line."""
    sections = acc["open"]
    toml = F.when(line["table"], _up_to_last(sections, lambda s: ~s["table"])).otherwise(sections)
    closed = F.slice(sections, F.lit(1), F.greatest(F.size(sections) - 1, F.lit(0)))
    shallower = _up_to_last(sections, lambda s: s["indent"] < line["indent"])
    return F.when(ext == "toml", toml).when(line["closes"], closed).otherwise(shallower)


def _next(acc: Column, line: Column, sections: Column) -> Column:
    """The state after a line. What is used more than once is bound by ``let``: a lambda has no shared subexpressions."""
    inside = F.get(sections, F.size(sections) - 1)["wanted"]
    first = F.struct(
        (F.coalesce(inside, F.lit(False)) | line["wanted"]).alias("keep"),
        F.coalesce(inside, F.lit(True)).alias("inside"),
        F.when(line["item"], acc["items"] + 1).when(line["closes"], acc["items"]).otherwise(0).alias("items"),
    )

    def decided(of: Column) -> Column:
        over = line["item"] & (~of["keep"] | (of["items"] > ARRAY_ITEMS))
        headline = line["headline"] & of["inside"] & (of["keep"] | ~line["bracketed"])
        mark = F.when(over, F.when(~acc["elided"], F.lit("..."))).when(headline | of["keep"] | (of["items"] > 0), line["bare"])
        return text.let(F.struct(over.alias("over"), mark.alias("mark")), lambda now: moved(of, now["over"], now["mark"]))

    def moved(of: Column, over: Column, mark: Column) -> Column:
        elided = F.when(line["item"], acc["elided"] | over).when(line["closes"], acc["elided"]).otherwise(False)
        section = F.struct(line["indent"].alias("indent"), of["keep"].alias("wanted"), line["table"].alias("table"))
        opened = F.when(~over & line["opens"], F.concat(sections, F.array(section))).otherwise(sections)
        return _show(acc, mark, ~over, opened, of["items"], elided)

    return text.let(first, decided)


def _show(acc: Column, shown: Column, counts: Column, sections: Column, items: Column, elided: Column) -> Column:
    """The state with one more line, if there is one; a limit is taken at a line that ``counts``."""
    n = acc["n"] + F.when(shown.isNotNull(), 1).otherwise(0)
    taken = {
        name: F.coalesce(acc[name], F.when(counts & (n >= limit), n)).alias(name)
        for name, limit in (("skeleton", SKELETON_LINES), ("tree_map", MAP_LINES))
    }
    # one string: the state is copied at every line
    grown = F.when(shown.isNotNull(), F.concat(acc["shown"], F.lit("\n"), shown)).otherwise(acc["shown"])
    return F.struct(
        sections.alias("open"), items.cast("int").alias("items"), elided.alias("elided"), n.cast("int").alias("n"), grown.alias("shown"), *taken.values()
    ).cast(_STATE)


def picked(path: Column, items: Column) -> Column:
    """shown (lines), and how many of them the skeleton and the tree map take (null: all)."""
    # what a path says is computed once, not again for every line
    flags = F.struct(F.lower(paths.extension(path)).alias("ext"), *[member.alias(name) for name, member in profiles(path).items()])
    none = F.lit(None)
    start = F.struct(
        F.array().alias("open"), F.lit(0).alias("items"), F.lit(False).alias("elided"), F.lit(0).alias("n"), F.lit("").alias("shown"),
        none.alias("skeleton"), none.alias("tree_map"),
    ).cast(_STATE)

    def folded(of: Column) -> Column:
        ext = of["ext"]
        described = F.transform(items, lambda raw: _describe(raw, ext, {name: of[name] for name in profiles(path)}))

        def fold(acc: Column, line: Column) -> Column:
            inner = text.let(_around(acc, line, ext), lambda sections: _next(acc, line, sections))
            remark = _show(acc, line["bare"], F.lit(True), acc["open"], acc["items"], acc["elided"])
            done = acc["skeleton"].isNotNull() & acc["tree_map"].isNotNull()
            return F.when(done, acc).when(line["remark"], remark).when(line["noise"], acc).otherwise(inner)

        def shown(acc: Column) -> Column:
            return F.struct(text.marked_lines(acc["shown"]).alias("shown"), acc["skeleton"].alias("skeleton"), acc["tree_map"].alias("tree_map"))

        return F.aggregate(described, start, fold, shown)

    return text.let(flags, folded)


def outline(files: DataFrame, counter: Counter) -> DataFrame:
    """Adds skeleton and tree_map; a text of which nothing is shown gives its first lines."""
    all_lines = text.lines(F.col("content"))
    shown = files.select("*", text.let(all_lines, lambda items: F.struct(items.alias("all"), picked(F.col("path"), items).alias("o"))).alias("_p"))
    cut = shown.withColumn("_lines", counter.truncate_all(F.col("_p.o.shown"), langs.LINE_TOKEN_LIMIT))

    def variant(name: str, limit: int) -> Column:
        # the limit applies before repeats are dropped
        taken = F.slice("_lines", F.lit(1), F.coalesce(F.col(f"_p.o.{name}"), F.size("_lines")))
        unique = F.filter(taken, lambda line, at: (at == 0) | (F.get("_lines", at - 1) != line))
        fallback = text.join_lines(L.first_lines(F.col("_p.all"), counter, limit))
        return F.when(F.size("_lines") == 0, fallback).otherwise(text.join_lines(unique)).alias(name)

    return cut.select(*files.columns, variant("skeleton", SKELETON_LINES), variant("tree_map", MAP_LINES))
