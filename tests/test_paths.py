"""Globs, ignore patterns, option checks and tokenizer names."""

import re

import pytest

from corpusfold.functions.paths import glob_to_regex
from corpusfold.functions.tokens import counter_for, encoding_for, longest_fitting
from corpusfold.options import ContextOptions, check_delta_options
from corpusfold.sources.ignore import pattern_regex


@pytest.mark.parametrize(
    "glob, hits, misses",
    [
        ("*.rs", ["a.rs", "src/a.rs"], ["a.rsx"]),
        ("src/**", ["src/a", "src/a/b"], ["src", "lib/src/a"]),
        ("**/main.ts", ["main.ts", "a/b/main.ts"], ["xmain.ts"]),
        ("{a,b}/*.js", ["a/x.js", "b/y/z.js"], ["c/x.js"]),
        ("f[!0-9].md", ["fa.md"], ["f1.md"]),
        ("a?c", ["abc", "a/c"], ["ac"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_globs(glob, hits, misses):
    pattern = re.compile(glob_to_regex(glob))
    assert all(pattern.match(h) for h in hits)
    assert not any(pattern.match(m) for m in misses)


@pytest.mark.parametrize("glob", ["[", "{a", "a}", "[]"])
def test_bad_globs_are_refused_before_any_job(glob):
    with pytest.raises(ValueError, match="invalid glob"):
        ContextOptions(include=(glob,))


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("ignored.rs", ["ignored.rs", "a/ignored.rs"], ["a/ignored.rsx"]),
        ("/top.rs", ["top.rs"], ["a/top.rs"]),
        ("a/*.rs", ["a/x.rs"], ["a/b/x.rs", "b/a/x.rs"]),
        ("**/gen/**", ["gen/x", "a/gen/b/c"], ["gen"]),
        ("build/", ["build", "a/build"], ["builder"]),
        ("*.lo[gk]", ["x.log", "a/x.lok"], ["x.loo"]),
    ],
)
def test_ignore_patterns(pattern, hits, misses):
    compiled = re.compile(pattern_regex(pattern))
    assert all(compiled.fullmatch(h) for h in hits)
    assert not any(compiled.fullmatch(m) for m in misses)


def test_option_checks():
    with pytest.raises(ValueError, match="level must be"):
        ContextOptions(level=4)
    with pytest.raises(ValueError):
        ContextOptions(sort="size")
    with pytest.raises(ValueError):
        check_delta_options(True, None, "HEAD")
    check_delta_options(True, "base", None)


def test_tokenizer_names():
    assert encoding_for(" GPT-4.1-mini") == "o200k_base"
    assert encoding_for("gpt-4") == "cl100k_base"
    assert encoding_for("code-davinci-edit-001") == "p50k_edit"
    with pytest.raises(ValueError, match="unknown tokenizer"):
        encoding_for("nope")


def test_missing_vocabulary_is_refused(monkeypatch):
    from corpusfold.functions import tokens

    def missing(name):
        raise OSError("no vocabulary")

    monkeypatch.setattr(tokens, "_encoder", missing)
    with pytest.raises(RuntimeError, match="cannot load cl100k_base"):
        counter_for("cl100k_base")


def test_longest_fitting_prefix():
    size = lambda s: len(s.replace(".", "")) + s.count(".")
    assert longest_fitting("abc", 3, size) == "abc"
    assert longest_fitting("abcdefgh", 5, size) == "ab..."
    assert longest_fitting("abcdefgh", 2, size) == "..."




def test_byte_pair_functions(monkeypatch):
    """The Arrow functions behind the byte-pair counters, with one token per byte as the vocabulary."""
    import pandas as pd

    from corpusfold.functions import tokens

    class Bytes:
        @staticmethod
        def encode_ordinary(text):
            return list(text.encode())

    monkeypatch.setattr(tokens, "_encoder", lambda name: Bytes)
    assert tokens._bpe_count("x").func(pd.Series(["abc", "é", None])).tolist()[:2] == [3, 2]
    assert tokens._bpe_truncate("x", 5).func(pd.Series(["abcdefgh", "abc"])).tolist() == ["ab...", "abc"]
    assert tokens._bpe_truncate_all("x", 5).func(pd.Series([["abcdefgh", "abc"], []])).tolist() == [["ab...", "abc"], []]
