"""Command line over the context plan: ``python -m corpusfold.cli PATH [options]``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from corpusfold.functions.tokens import DEFAULT_ENCODING
from corpusfold.operators import order
from corpusfold.options import FORMATS, MAP_LAYOUTS, OPTION_NAMES, ContextOptions, check_delta_options
from corpusfold.plans import context as plan
from corpusfold.plans import reports
from corpusfold.session import local_session
from corpusfold.sources import state


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusfold", description="Build a token-budgeted context document.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--max-tokens", type=int, default=4000)
    p.add_argument("--tokenizer", default=DEFAULT_ENCODING)
    p.add_argument("--line-tokenizer", default="native")
    p.add_argument("--max-file-bytes", type=int, default=1_048_576)
    p.add_argument("--max-file-tokens", type=int, default=0)
    p.add_argument("--level", type=int, default=2)
    p.add_argument("--output", choices=["file", "table"], default="file")
    p.add_argument("--output-file", default="context.xml")
    p.add_argument("--format", choices=FORMATS, default="xml")
    p.add_argument("--map-only-under", type=int)
    p.add_argument("--project-map", choices=MAP_LAYOUTS, default="flat")
    p.add_argument("--sort", choices=order.MODES, default="path")
    p.add_argument("--incremental-base")
    p.add_argument("--changed-since")
    p.add_argument("--state", help="snapshot folder; needed by --incremental")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--ask-template")
    for flag in (
        "project-map-only", "file-hashes", "no-token-counts", "no-content", "dry-run", "directory-summaries",
        "fail-over-budget", "drop-low-priority", "incremental", "incremental-summary", "no-respect-gitignore",
        "exclude-generated", "print-files", "fail-on-empty", "quiet", "stats", "detailed-stats", "summary", "prompt",
    ):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def options_from(args: argparse.Namespace) -> ContextOptions:
    values = {name: getattr(args, name) for name in OPTION_NAMES if hasattr(args, name)}
    values.update(
        token_counts=not args.no_token_counts,
        content=not args.no_content,
        respect_gitignore=not args.no_respect_gitignore,
        include=tuple(args.include),
        exclude=tuple(args.exclude),
    )
    return ContextOptions(**values)


def run(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    options = options_from(args)
    check_delta_options(args.incremental, args.incremental_base, args.changed_since)
    if args.incremental and not args.state:
        raise ValueError("--incremental needs --state")
    root = str(Path(args.path).resolve(strict=True))
    spark = local_session()
    say = (lambda *_: None) if args.quiet else print
    context = plan.repository_context(
        spark, root, options,
        state_path=args.state,
        incremental_base=args.incremental_base,
        base_is_directory=bool(args.incremental_base) and not state.is_snapshot(args.incremental_base),
        changed_since=args.changed_since,
        with_raw_tokens=args.stats,
    )
    for warning in context.warnings:
        if not args.quiet:
            print(f"warning: {warning}", file=sys.stderr)
    if args.print_files:
        for row in context.selected.orderBy(*order.scan_keys()).toLocalIterator():
            say(row.path)
    if args.dry_run:
        for line in reports.dry_run_lines(context):
            say(line)
    elif args.output == "table":
        context.write(args.output_file)
    else:
        context.write_file(args.output_file)
    if args.state and not args.dry_run:
        plan.save_state(context, args.state)
    if args.summary:
        say(reports.summary_text(context, "dry-run" if args.dry_run else args.output_file))
    if args.incremental_summary:
        say(reports.incremental_text(context))
    if args.stats:
        say(reports.stats_text(context))
    if args.detailed_stats:
        for line in reports.detailed_lines(context):
            say(line)
    return 0


def doctor(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="corpusfold doctor")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--state")
    p.add_argument("--tokenizer", default=DEFAULT_ENCODING)
    p.add_argument("--json", action="store_true")
    args = p.parse_args(argv)
    root = str(Path(args.path).resolve(strict=True))
    report = reports.doctor(local_session(), root, args.state, args.tokenizer)
    print(json.dumps(report, indent=2) if args.json else reports.doctor_text(report))
    return 0


def cache(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="corpusfold cache")
    p.add_argument("action", choices=["clear"])
    p.add_argument("state")
    args = p.parse_args(argv)
    cleared = state.clear(local_session(), args.state)
    print(f"cleared {args.state}" if cleared else f"no snapshot under {args.state}")
    return 0


COMMANDS = {"doctor": doctor, "cache": cache}


def main() -> int:
    argv = sys.argv[1:]
    try:
        if argv and argv[0] in COMMANDS:
            return COMMANDS[argv[0]](argv[1:])
        return run(argv)
    except (ValueError, RuntimeError, FileNotFoundError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
