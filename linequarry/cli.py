"""python -m linequarry scan ROOT [options]; python -m linequarry engines"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .options import CleanOptions, ScanOptions

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linequarry")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("engines", help="list the engines")
    s = sub.add_parser("scan", help="extract the dialogue below a folder")
    s.add_argument("root", nargs="?", default="")
    s.add_argument("-o", "--output")
    s.add_argument("-f", "--format", default="txt", choices=("txt", "csv", "tsv", "json", "jsonl", "template", "pdf"))
    s.add_argument("-e", "--encoding", default="utf-8-sig")
    s.add_argument("--force-encoding", default="auto")
    s.add_argument("--engines", default="")
    s.add_argument("--min-len", type=int, default=2)
    s.add_argument("--max-len", type=int, default=400)
    s.add_argument("--narration-label", default="")
    for flag in ("include-generic", "no-dedupe", "keep-all-versions", "aggressive", "keep-ascii", "allow-no-japanese", "chinese-only", "guess-speakers", "no-speaker-tracking", "no-tags", "no-speaker", "quiet"):
        s.add_argument(f"--{flag}", action="store_true")
    s.add_argument("--max-file-bytes", type=int, default=ScanOptions().max_file_bytes)
    s.add_argument("--max-total-bytes", type=int, default=ScanOptions().max_total_bytes)
    s.add_argument("--pdf-title", default="")
    s.add_argument("--pdf-font", default="")
    s.add_argument("--pdf-font-index", type=int, default=0)
    for flag in ("scene-per-page", "flat", "no-source", "list-fonts"):
        s.add_argument(f"--pdf-{flag}", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> ScanOptions:
    cleaning = CleanOptions(
        min_len=a.min_len, max_len=a.max_len, require_cjk=not a.allow_no_japanese, strip_tags=not a.no_tags, drop_ascii_only=not a.keep_ascii, aggressive=a.aggressive, chinese_only=a.chinese_only,
        track_speakers=not a.no_speaker_tracking, guess_bare_speakers=a.guess_speakers, narration_speaker=a.narration_label,
    )
    engines = tuple(x.strip() for x in a.engines.split(",") if x.strip()) or None
    return ScanOptions(engines=engines, include_generic=a.include_generic, encoding=a.force_encoding, dedupe=not a.no_dedupe, override_archives=not a.keep_all_versions, max_file_bytes=a.max_file_bytes, max_total_bytes=a.max_total_bytes, clean=cleaning)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 done, 2 no such folder, no text or no fonts to list, 3 no PDF could be made, 130 cancelled."""
    from .plans.registry import listed
    from .plans.scan import Cancelled, scan
    from .pdf.fonts import PROBE, find_fonts
    from .sinks import EXTENSIONS, PdfOptions, export, export_pdf

    a = parser().parse_args(argv)
    if a.command == "engines":
        for key, name, available, error in listed():
            print(f"{key:12} {name}{'' if available else f' (not available: {error})'}")
        return 0
    if a.pdf_list_fonts:
        found = find_fonts(probe=PROBE)
        for f in found:
            print(f"{f.name}\t{f.path}\t{f.face}")
        return 0 if found else 2
    if not a.root or not Path(a.root).exists():
        print(f"no such folder: {a.root}", file=sys.stderr)
        return 2
    try:
        spark = spark or SparkSession.builder.appName("linequarry").getOrCreate()
        options = options_of(a)
        told = (lambda share, what: print(f"{share:4.0%} {what}", file=sys.stderr)) if a.verbose else None
        result = scan(spark, a.root, options, progress=told)
        if result.lines.isEmpty():
            print("no text found", file=sys.stderr)
            return 2
        target = a.output or Path.cwd() / (Path(a.root).resolve().name + EXTENSIONS[a.format])
        if a.format == "pdf":
            options_pdf = PdfOptions(title=a.pdf_title, font_path=a.pdf_font, font_face=a.pdf_font_index, scene_per_page=a.pdf_scene_per_page, scene_headings=not a.pdf_flat, source_paths=not a.pdf_no_source)
            try:
                made = export_pdf(target, result, options_pdf)
            except Exception as e:
                print(f"no PDF could be made: {e}", file=sys.stderr)
                return 3
            out = made.path
            if made.missing:
                print(f"{len(made.missing)} characters have no glyph in {made.font_name}: {''.join(made.missing[:30])}", file=sys.stderr)
            if not a.quiet:
                print(f"{made.pages} pages, {made.scenes} scenes, {made.lines} lines, {made.size} bytes")
        else:
            out = export(target, result, a.format, a.encoding, with_speaker=not a.no_speaker)
        if not a.quiet:
            print(result.summary())
            print(*result.warnings_of_lines(options), sep="\n")
        print(out)
        return 0
    except (KeyboardInterrupt, Cancelled):
        return 130
