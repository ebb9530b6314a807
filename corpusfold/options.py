"""Options of one context run and their validation."""

from __future__ import annotations

from dataclasses import dataclass, fields

from corpusfold.functions.paths import glob_to_regex
from corpusfold.functions.tokens import DEFAULT_ENCODING
from corpusfold.operators.order import MODES

FORMATS = ("xml", "json", "text")
MAP_LAYOUTS = ("flat", "compact")


@dataclass(frozen=True)
class ContextOptions:
    max_tokens: int = 4000
    tokenizer: str = DEFAULT_ENCODING
    line_tokenizer: str = "native"
    max_file_bytes: int = 1_048_576
    max_file_tokens: int = 0
    level: int = 2
    format: str = "xml"
    project_map_only: bool = False
    map_only_under: int | None = None
    project_map: str = "flat"
    file_hashes: bool = False
    token_counts: bool = True
    content: bool = True
    sort: str = "path"
    directory_summaries: bool = False
    fail_over_budget: bool = False
    drop_low_priority: bool = False
    incremental: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_gitignore: bool = True
    exclude_generated: bool = False
    fail_on_empty: bool = False
    prompt: bool = False
    ask_template: str | None = None

    def __post_init__(self):
        if self.level not in (1, 2, 3):
            raise ValueError("level must be 1, 2, or 3")
        for name, allowed in (("format", FORMATS), ("project_map", MAP_LAYOUTS), ("sort", MODES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for name in ("max_tokens", "max_file_bytes", "max_file_tokens"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for pattern in (*self.include, *self.exclude):
            glob_to_regex(pattern)

    @property
    def map_only(self) -> bool:
        """Too small a budget for contents: the map and summaries stand in for them."""
        return self.map_only_under is not None and self.max_tokens < self.map_only_under

    @property
    def shows_files(self) -> bool:
        return self.content and not self.project_map_only and not self.map_only

    @property
    def shows_deleted(self) -> bool:
        return not self.project_map_only and not self.map_only

    @property
    def shows_summaries(self) -> bool:
        return (self.directory_summaries or self.map_only) and not self.project_map_only

    def selection(self) -> dict:
        """The options that decide which files a snapshot covers."""
        return {
            "include": list(self.include),
            "exclude": list(self.exclude),
            "respect_gitignore": self.respect_gitignore,
            "max_file_bytes": self.max_file_bytes or None,
            "exclude_generated": self.exclude_generated,
        }


OPTION_NAMES = tuple(f.name for f in fields(ContextOptions))


def check_delta_options(incremental: bool, incremental_base, changed_since) -> None:
    if changed_since and (incremental or incremental_base):
        raise ValueError("changed_since cannot be combined with incremental or incremental_base")
