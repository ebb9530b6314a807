"""Ignore files: the pattern rules deciding which paths a scan leaves out."""

from __future__ import annotations

import os
import re


def pattern_regex(pattern: str) -> str:
    """Regular expression for one ignore pattern, matched against a path below the file's folder."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out: list[str] = []
    for token in re.findall(r"\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|.", body):
        if token == "**/":
            out.append("(?:.*/)?")
        elif token == "/**":
            out.append("/.+")
        elif token.startswith("*"):
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token.startswith("[") and len(token) > 1:
            out.append("[^" + token[2:] if token[1] == "!" else token)
        else:
            out.append(re.escape(token[-1]))
    return ("" if anchored else "(?:.*/)?") + "".join(out)


def parsed_lines(lines: list[str]) -> tuple[tuple[re.Pattern, bool, bool], ...]:
    """(pattern, negated, folders only) of the lines of an ignore file, in order."""
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        if body.strip("/"):
            rules.append((re.compile(pattern_regex(body)), negated, body.endswith("/")))
    return tuple(rules)


def above(root: str, name: str) -> list[str]:
    """Folders above a scan root whose ignore files of this name hold in it, the deepest first.

    Git's own count up to the top of the work tree, the others all the way.
    """
    return list(reversed(_parents(root) if name == ".gitignore" else _ancestors(root)))


def top_of(root: str) -> str:
    """The top of the git work tree that holds ``root``; the root itself where there is none."""
    chain = [*_parents(root), root]
    return next((base for base in reversed(chain) if os.path.isdir(os.path.join(base, ".git"))), root)


def global_file() -> str:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return os.path.join(home, "git", "ignore")


def _ancestors(root: str) -> list[str]:
    """All folders above the scan root, from the top."""
    chain: list[str] = []
    at = root
    while (parent := os.path.dirname(at)) != at:
        chain.insert(0, parent)
        at = parent
    return chain


def _parents(root: str) -> list[str]:
    """Folders above the scan root, up to the top of the git work tree that holds it."""
    chain: list[str] = []
    at = root
    while not os.path.exists(os.path.join(at, ".git")):
        parent = os.path.dirname(at)
        if parent == at:
            return []
        chain.insert(0, parent)
        at = parent
    return chain


def in_work_tree(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git")) or bool(_parents(root))
