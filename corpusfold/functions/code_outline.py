"""Outline of one source text: the per-row helper of the code compressor.

No grammar parser is at hand, so structure is read from statement heads. Comments and literals are
blanked first (offsets stay valid); what remains is cut at braces, semicolons and, where the language
ends statements there, at line ends. The text in front of a brace tells what the brace opens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_CONTROL = r"(?:if|for|foreach|while|switch|catch|with|else|do|try|finally|return|match|lock|using|synchronized|guard|when|unless|loop|repeat|defer|select)\b"


@dataclass(frozen=True)
class Language:
    literals: str
    newline_ends: bool
    callables: str
    types: str
    emits: str
    members: str = ""
    body_by_parens: bool = False
    skip_prefix: str = ""
    line_heads: str = ""
    twice: str = ""
    patterns: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for name in ("literals", "callables", "types", "emits", "members", "skip_prefix", "line_heads", "twice"):
            text = getattr(self, name)
            self.patterns[name] = re.compile(text, re.S) if text else None

    def hit(self, name: str, text: str):
        pattern = self.patterns[name]
        return pattern.search(text) if pattern else None


_JS_LITERALS = rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`"
_MODS = r"^(?:(?:public|private|protected|internal|open|fileprivate|static|final|abstract|override|virtual|sealed|partial|async|export|default|declare|data|inline|suspend|lateinit|const|readonly|mutating|indirect|unsafe|extern|required|convenience|enum(?=\s+class)|annotation|companion|weak|lazy|@\w+(?:\([^)]*\))?|\[[^\]]*\])\s+)*"

LANGUAGES = {
    "rust": Language(
        literals=rf'{_SLASHES}|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\[^\']*|[^\'\\\n])\'',
        newline_ends=False,
        callables=r"\bfn\s+\w+|\|[^|]*\|\s*(?:->\s*[\w:<>&]+\s*)?$",
        types=r"\b(?:impl|trait|mod|struct|enum|union)\b",
        emits=r"^(?:pub(?:\([^)]*\))?\s+|default\s+|async\s+|unsafe\s+|const\s+(?=fn|unsafe|async)|extern\s+(?:\"\s*\"\s*)?)*(?:use|fn|struct|enum|trait|impl|type|const|static|mod)\b",
        skip_prefix=r"^(?:\s*#!?\[[^\]]*\])+\s*",
    ),
    "javascript": Language(
        literals=_JS_LITERALS, newline_ends=True,
        callables=r"\bfunction\b|=>\s*$", types=r"\bclass\b", body_by_parens=True,
        emits=r"^(?:import|export|class|let|const|var|(?:async\s+)?function)\b",
        twice=r"^export\s+(?:default\s+)?(?=(?:async\s+function|function|class|let|const|var)\b)",
    ),
    "typescript": Language(
        literals=_JS_LITERALS, newline_ends=True,
        callables=r"\bfunction\b|=>\s*$", types=r"\b(?:class|interface|namespace|enum)\b", body_by_parens=True,
        emits=r"^(?:import|export|(?:abstract\s+)?class|let|const|var|(?:async\s+)?function|interface|type(?=\s+\w)|enum|declare)\b",
        twice=r"^export\s+(?:default\s+)?(?=(?:async\s+function|function|class|let|const|var|interface|type|enum|declare)\b)",
    ),
    "go": Language(
        literals=rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|`[^`]*`", newline_ends=True,
        callables=r"^func\b", types=r"\b(?:struct|interface)\s*$",
        emits=r"^(?:package|import|const|var|type|func)\b",
    ),
    "java": Language(
        literals=rf"{_SLASHES}|{_TRIPLE}|{_DOUBLE}|{_SINGLE}", newline_ends=False,
        callables=r"->\s*$", types=r"\b(?:class|interface|enum|record)\s+\w", body_by_parens=True,
        emits=_MODS + r"(?:package|import|class|interface|enum|record|@interface)\s", members="field",
    ),
    "csharp": Language(
        literals=rf'{_SLASHES}|@"(?:""|[^"])*"|{_DOUBLE}|{_SINGLE}', newline_ends=False,
        callables=r"=>\s*$", types=r"\b(?:class|struct|interface|enum|record|namespace)\s+\w", body_by_parens=True,
        emits=_MODS + r"(?:using|namespace|class|struct|interface|enum|record|delegate)\s", members="field",
    ),
    "swift": Language(
        literals=rf"{_SLASHES}|{_TRIPLE}|{_DOUBLE}", newline_ends=True,
        callables=r"\bfunc\b", types=r"\b(?:class|struct|enum|protocol|extension|actor)\s+\w",
        emits=_MODS + r"(?:import|class|struct|protocol|extension|enum|func|var|let|typealias)\b",
    ),
    "kotlin": Language(
        literals=rf"{_SLASHES}|{_TRIPLE}|{_DOUBLE}|{_SINGLE}", newline_ends=True,
        callables=r"\bfun\b", types=r"\b(?:class|interface|object)\b",
        emits=_MODS + r"(?:package|import|class|interface|object|fun|val|var|typealias)\b",
    ),
    "c": Language(
        literals=rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}", newline_ends=False,
        callables=r"(?!)", types=r"\b(?:struct|union|enum)\b[^()]*$", body_by_parens=True,
        emits=r"^(?:typedef|struct|union|enum)\b", members="declaration", line_heads=r"^#\s*(?:include|define)\b",
    ),
    "cpp": Language(
        literals=rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}", newline_ends=False,
        callables=r"\]\s*(?:\([^)]*\))?\s*(?:mutable\s*)?$", types=r"\b(?:class|struct|union|enum|namespace)\b[^()]*$",
        body_by_parens=True, emits=r"^(?:typedef|struct|union|enum|class|namespace|template)\b",
        members="declaration", line_heads=r"^#\s*(?:include|define)\b",
        skip_prefix=r"^(?:\s*(?:public|private|protected)\s*:(?!:))+\s*",
    ),
}

_AFTER_PARENS = re.compile(
    r"\)\s*(?:const|noexcept(?:\([^)]*\))?|override|final|mutable|volatile|throws\s+[\w.,\s]+|where\s+[^{}]*"
    r"|->\s*[\w:<>,*&\s]+|:\s*[^{};]*|\s)*$"
)
_NAMED_CALL = re.compile(r"([\w$~#\]>]+)\s*(?:<[^<>()]*>)?\s*\(")
_STATEMENT_WORD = re.compile(_CONTROL)


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match.group())


def _is_callable(lang: Language, head: str, inside: str) -> bool:
    if _STATEMENT_WORD.match(head):
        return False
    if lang.hit("callables", head):
        return True
    if not lang.body_by_parens or lang.hit("types", head) or inside == "callable":
        return False
    named = _NAMED_CALL.search(head)
    if not named or "=" in head[: named.start()] or re.search(r"\bnew\s+[\w.<>]*$", head[: named.end(1)]):
        return False
    return bool(_AFTER_PARENS.search(head))


@dataclass
class _Head:
    start: int
    text: str
    ends_with: str
    inside: str
    is_callable: bool


def _scan(source: str, lang: Language):
    """Statement heads in order, and the spans of callable bodies as (start, end)."""
    code = lang.patterns["literals"].sub(_blank, source)
    heads: list[_Head] = []
    bodies: list[tuple[int, int]] = []
    blocks: list[tuple[str, int, int]] = []
    start = round_depth = 0

    def inside() -> str:
        return blocks[-1][0] if blocks else "top"

    def close_head(end: int, mark: str) -> _Head | None:
        nonlocal start
        piece = code[start:end]
        lead = lang.patterns["skip_prefix"].match(piece) if lang.skip_prefix else None
        begin = start + (lead.end() if lead else 0)
        start = end + (mark in "{};")
        text = code[begin:end].strip()
        if not text:
            return None
        begin += len(code[begin:end]) - len(code[begin:end].lstrip())
        heads.append(_Head(begin, text, mark, inside(), False))
        return heads[-1]

    for found in re.finditer(r"[{}();\[\]\n]", code):
        mark, at = found.group(), found.start()
        if mark in "([":
            round_depth += 1
        elif mark in ")]":
            round_depth = max(round_depth - 1, 0)
        elif mark == "{":
            head = close_head(at, mark)
            if head is None and lang.newline_ends and heads and heads[-1].ends_with == "\n":
                head = heads[-1]
            kind = "block"
            if head is not None:
                head.is_callable = _is_callable(lang, head.text, inside())
                if head.is_callable:
                    kind = "callable"
                elif lang.hit("types", head.text):
                    kind = "scope" if "namespace" in head.text else "type"
            blocks.append((kind, at, round_depth))
            round_depth = 0
        elif mark == "}":
            close_head(at, mark)
            if blocks:
                kind, opened, round_depth = blocks.pop()
                if kind == "callable":
                    bodies.append((opened, at + 1))
        elif mark == ";":
            if round_depth == 0:
                close_head(at, mark)
        else:
            line = code[start:at].strip()
            directive = bool(lang.line_heads) and line.startswith("#")
            if directive or (lang.newline_ends and round_depth == 0 and line):
                close_head(at, mark)
    close_head(len(code), "\n")
    return code, heads, bodies


def _is_member(lang: Language, head: _Head) -> bool:
    """Fields and methods of a type, and C declarations, have no leading keyword to tell them by."""
    if lang.members == "field":
        if head.inside != "type" or head.ends_with not in ";{":
            return head.is_callable and head.inside == "type"
        return not _STATEMENT_WORD.match(head.text) and bool(re.search(r"\w\s+[\w<>\[\]]", head.text) or head.is_callable)
    if lang.members == "declaration":
        if head.is_callable or head.inside == "type":
            return head.is_callable
        typed = re.match(r"^[A-Za-z_][\w:<>,*&\s\[\]]*[\s*&>]+[*&]*[A-Za-z_~]\w*(?:::\w+)*\s*(?:[(\[={].*)?$", head.text, re.S)
        return head.ends_with == ";" and bool(typed) and not re.match(r"^(?:return|goto|using|delete|throw|else|case)\b", head.text)
    return False


def _outermost(bodies: list[tuple[int, int]]) -> list[tuple[int, int]]:
    kept: list[tuple[int, int]] = []
    for begin, end in sorted(bodies):
        if not kept or begin >= kept[-1][1]:
            kept.append((begin, end))
    return kept


def _replace(source: str, spans: list[tuple[int, int]], filler: str) -> str:
    pieces, at = [], 0
    for begin, end in spans:
        pieces += [source[at:begin], filler]
        at = end
    return "".join([*pieces, source[at:]])


def _first_line(source: str, start: int) -> str:
    end = source.find("\n", start)
    line = " ".join(source[start : end if end >= 0 else len(source)].split())
    return line if len(line) <= 240 else line[:237] + "..."


def _unrepeated(lines: list[str]) -> str:
    return "\n".join(line for at, line in enumerate(lines) if at == 0 or line != lines[at - 1])


def brace_outline(source: str, syntax: str) -> tuple[str, str]:
    lang = LANGUAGES[syntax]
    code, heads, bodies = _scan(source, lang)
    if syntax == "kotlin":
        for found in re.finditer(r"\bfun\b[^{}=\n]*\)[^{}=\n]*(=[^=\n][^\n]*)", code):
            if "{" not in found.group(1):
                bodies.append(found.span(1))
    shown: list[str] = []
    for head in sorted(heads, key=lambda h: h.start):
        method = head.is_callable and head.inside == "type" and lang.body_by_parens
        if lang.hit("emits", head.text) or _is_member(lang, head) or method or lang.hit("line_heads", head.text):
            shown.append(_first_line(source, head.start))
            inner = lang.hit("twice", head.text)
            if inner:
                shown.append(_first_line(source, head.start + inner.end()))
    return _replace(source, _outermost(bodies), "{ ... }"), _unrepeated([line for line in shown if line])


_PY_LITERALS = re.compile(r'"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*', re.S)
_PY_SHOWN = re.compile(r"^[ \t]*(import\b|from\b|(?:async\s+)?def\b|class\b|@)", re.M)
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def\b", re.M)


def python_outline(source: str) -> tuple[str, str]:
    """Indentation takes the place of braces; literals keep a filler so that they still count as statements."""
    code = _PY_LITERALS.sub(lambda m: re.sub(r"[^\n]", " " if m.group().startswith("#") else "_", m.group()), source)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    spans: list[tuple[int, int]] = []
    for found in _PY_DEF.finditer(code):
        if spans and found.start() < spans[-1][1]:
            continue
        colon = _header_end(code, found.end())
        if colon is None:
            continue
        line_end = code.find("\n", colon)
        line_end = len(code) if line_end < 0 else line_end
        if code[colon + 1 : line_end].strip():
            begin = colon + 1 + len(code[colon + 1 : line_end]) - len(code[colon + 1 : line_end].lstrip())
            spans.append((begin, colon + 1 + len(code[colon + 1 : line_end].rstrip())))
            continue
        indent = len(found.group(1).expandtabs())
        begin = end = None
        for at in starts[bisect_right(starts, line_end) :]:
            stop = code.find("\n", at)
            line = code[at : len(code) if stop < 0 else stop]
            if not line.strip() or (end is not None and re.match(r"[_)\]}]", line) and _inside_literal(source, code, at)):
                continue
            if len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= indent:
                break
            begin = at + len(line) - len(line.lstrip()) if begin is None else begin
            end = at + len(line.rstrip())
        if begin is not None:
            spans.append((begin, end))
    shown = [_first_line(source, found.start(1)) for found in _PY_SHOWN.finditer(code)]
    return _replace(source, spans, "..."), _unrepeated(shown)


def _inside_literal(source: str, code: str, at: int) -> bool:
    return code[at] == "_" and source[at] != "_"


def _header_end(code: str, at: int) -> int | None:
    depth = 0
    for found in re.finditer(r"[()\[\]{}:]", code[at:]):
        mark = found.group()
        if mark == ":" and depth == 0:
            return at + found.start()
        depth += mark in "([{"
        depth -= mark in ")]}"
    return None


def outline(source: str, syntax: str) -> tuple[str, str]:
    """Skeleton and tree map; long import runs are collapsed by the line operators."""
    return python_outline(source) if syntax == "python" else brace_outline(source, syntax)
