"""The scan: listing, engines, scripts, versions, extraction, deduplication, numbering, report."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import binary, clean, codec
from ..operators import kag, lines, nscript, speakers, versions
from ..options import ScanOptions
from ..sources import archives, loose
from ..storage import staged
from . import registry


class Cancelled(Exception):
    """The caller's should_cancel() said so between two steps."""


@dataclass
class ScanFrames:
    """Tables of a scan. Names, versions and decoded texts are staged; lines are computed when they are used."""

    root: str
    engines: list[tuple[str, int]]
    lines: DataFrame
    scripts: DataFrame
    warnings: list[str]

    @property
    def best_engine(self) -> str:
        """The engine with the highest score, '' if there is none."""
        return self.engines[0][0] if self.engines else ""

    def scripts_by_engine(self) -> DataFrame:
        """engine, n of the scripts that were read."""
        return self.scripts.filter("note = ''").groupBy("engine").agg(F.count("*").alias("n"))

    def warnings_of_lines(self, options: ScanOptions) -> list[str]:
        """Warnings that need the lines themselves."""
        out = list(self.warnings)
        lost = self.scripts.filter("note != ''").count()
        if lost:
            out.append(f"{lost} scripts were overridden by another version")
        if not options.clean.chinese_only:
            k = lines.kana_share(self.lines).first()
            if k["kana_lines"]:
                out.append(f"{k['kana_lines']} lines hold kana ({k['ratio']:.0%})")
        return out

    def summary(self) -> str:
        t = lines.totals(self.scripts).first()
        named = ", ".join(f"{registry.engine_name(k)} ({s})" for k, s in self.engines[:3]) or "none"
        return f"engines: {named} | scripts: {t['scripts']} ({t['scripts_with_text']} with text) | lines: {self.lines.count()}"


def _strings(data: Column, generic: Column) -> Column:
    @F.pandas_udf("array<string>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, is_generic in batches:
            yield pd.Series([(binary.scan_strings if g else binary.compiled_lines)(bytes(b or b"")) for b, g in zip(blobs, is_generic, strict=True)], dtype=object)

    return found(data, generic)


def _routed(scripts: DataFrame) -> DataFrame:
    """With by (whose extractor), ext, and blob (searched for strings, not decoded)."""
    # Scripts of engines from outside are text; their extension says whose extractor reads them.
    engine = F.when(F.col("engine").isin(*registry.BUILT_IN), F.col("engine")).otherwise("plaintext")
    by = versions.extractor(engine, F.col("virtual_path"))
    return scripts.withColumn("by", by).withColumn("ext", clean.extension(F.col("virtual_path"))).withColumn("blob", (F.col("by") == "bgi") | (F.col("engine") == "generic"))


def texts(scripts: DataFrame, options: ScanOptions) -> DataFrame:
    """script_ord, by, ext, text, encoding of scripts (script_ord, engine, virtual_path, data) that are text."""
    some = _routed(scripts).filter("not blob").withColumn("d", codec.decoded(F.col("data"), options.encoding, F.col("by") == "nscripter"))
    return some.select("script_ord", "by", "ext", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"))


def strings(scripts: DataFrame) -> DataFrame:
    """script_ord, found (strings in order) of compiled scripts and of files that generic reads."""
    some = _routed(scripts).filter("blob")
    return some.select("script_ord", _strings(F.col("data"), F.col("engine") == "generic").alias("found"))


def _candidates(text: DataFrame, blobs: DataFrame, options: ScanOptions) -> DataFrame:
    """script_ord, line_no, part_no, hint, line of texts() and strings(), by their extractors."""
    keys = ["script_ord"]
    scanned = blobs.select(*keys, F.posexplode("found").alias("line_no", "line")).select(*keys, "line_no", F.lit(0).alias("part_no"), F.lit("").alias("hint"), "line")
    tagged = (F.col("ext").isin(".ks", ".kag")) | (~F.col("ext").isin(".txt", ".csv", ".tjs") & kag.looks_like_kag(F.col("text")))
    part = lambda df: lines.explode_lines(df.select(*keys, "text"))
    whole = lambda df: df.select(*keys, "line_no", F.lit(0).alias("part_no"), "hint", "line")
    of_kag = whole(kag.kag_candidates(part(text.filter((F.col("by") == "kirikiri") & (F.col("ext") != ".tjs") & tagged)), keys, options.clean.tracking))
    of_plain = whole(kag.plain_candidates(part(text.filter((F.col("by") == "kirikiri") & (F.col("ext") != ".tjs") & ~tagged)), keys))
    of_nscript = nscript.nscript_candidates(part(text.filter((F.col("by") == "nscripter") & nscript.looks_like_script(F.col("text")))), keys)
    loose_lines = part(text.filter(F.col("by") == "plaintext")).withColumn("line", F.trim("line")).filter(F.char_length("line").between(1, 4000))
    of_loose = loose_lines.select(*keys, "line_no", F.lit(0).alias("part_no"), F.lit("").alias("hint"), "line")
    return scanned.unionByName(of_kag).unionByName(of_plain).unionByName(of_nscript.select(*keys, "line_no", "part_no", "hint", "line")).unionByName(of_loose)


def _rows(text: DataFrame, blobs: DataFrame, options: ScanOptions) -> DataFrame:
    rows = speakers.dialogue_rows(_candidates(text, blobs, options), options.clean, ["script_ord"], ["line_no", "part_no"])
    if not options.dedupe:
        return rows
    return lines.dedupe_in(rows, ["script_ord"], [F.col("line_no"), F.col("part_no"), F.col("sub_no")])


def extract(scripts: DataFrame, options: ScanOptions) -> DataFrame:
    """script_ord, line_no, part_no, sub_no, speaker, text of dialogue in scripts (script_ord, engine, virtual_path, data)."""
    return _rows(texts(scripts, options), strings(scripts), options)


def _is_folder(root: str) -> bool:
    if "://" in root and not root.startswith("file://"):
        store, inner = pafs.FileSystem.from_uri(root)
        return store.get_file_info(inner).type != pafs.FileType.NotFound
    return os.path.exists(root.removeprefix("file://"))


def _nothing(spark: SparkSession, root: str, found: list, warnings: list[str]) -> ScanFrames:
    return ScanFrames(root, found, spark.createDataFrame([], schema.LINES), spark.createDataFrame([], schema.REPORT), warnings)


def _index(spark: SparkSession, root: str, options: ScanOptions, every: DataFrame, files: DataFrame, chosen: list[str], warnings: list[str]) -> DataFrame | None:
    """Index rows of the chosen engines with their rank; files searched for strings if nothing else is there."""
    columns = ["engine", "virtual_path", "container", "size", "error", "path", "member"]
    every = every.select(*columns)
    listed = files.select("path", "rel", F.col("size").alias("length"))
    if "generic" in chosen:
        every = every.unionByName(loose.generic_files(listed, options.generic_max_file_bytes, options.generic_max_total_bytes))
    rank = F.array_position(F.array(*[F.lit(k) for k in chosen or ["-"]]), F.col("engine"))
    ranked = every.withColumn("rank", rank.cast("int")).filter("rank > 0")
    if not ranked.isEmpty():
        return ranked
    if options.auto_generic_if_empty and "generic" not in chosen:
        warnings.append("nothing known was found, so every file was searched for strings")
        ranked = loose.generic_files(listed, options.generic_max_file_bytes, options.generic_max_total_bytes).withColumn("rank", F.lit(1))
    return None if ranked.isEmpty() else ranked


def _versions(ranked: DataFrame, options: ScanOptions, warnings: list[str]) -> DataFrame:
    """The index rows that count, with script_ord, kept and winner; names and sizes alone are moved."""
    once = versions.first_wins(versions.within_size(ranked, options.max_file_bytes), ["container", "virtual_path"], [F.col("rank")])
    names = staged(once.withColumn("script_ord", F.concat_ws("\0", F.format_string("%03d", "rank"), "virtual_path", "container")), "names")
    within = versions.greedy_budget(names, options.max_total_bytes, "script_ord")
    if within is not names:
        within = staged(within, "within")
        warnings.append(f"the total limit of {options.max_total_bytes} bytes was reached: {names.count() - within.count()} scripts were left out")
    inner = F.when(F.col("container") == "", F.col("virtual_path")).otherwise(F.substring("virtual_path", F.char_length("container") + 2, F.char_length("virtual_path")))
    within = within.withColumn("inner", inner)
    if options.override_archives:
        return versions.resolve_overrides(within, [F.col("script_ord")])
    return within.withColumn("winner", F.col("virtual_path")).withColumn("kept", F.lit(True))


def scan(spark: SparkSession, root: str, options: ScanOptions | None = None, progress: Callable[[float, str], None] | None = None, should_cancel: Callable[[], bool] | None = None) -> ScanFrames:
    """All dialogue below a folder (or in one file).

    `progress` hears of each step with the share that is done; `should_cancel` is asked
    between steps, and Cancelled is raised if it agrees.
    """
    options = options or ScanOptions()

    def step(share: float, what: str) -> None:
        if should_cancel is not None and should_cancel():
            raise Cancelled(what)
        if progress is not None:
            progress(share, what)

    step(0.02, "listing")
    if not _is_folder(root):
        return _nothing(spark, root, [], [f"no such folder: {root}"])
    index = staged(archives.index(loose.listing(spark, root), options.max_file_bytes), "index")
    files = index.filter("kind = 'file'").select("rel", F.col("size").alias("length"), "size", "head", "path")
    step(0.05, "engines")
    found = [(r["key"], r["score"]) for r in registry.scores(files).collect()] + registry.added_scores(files)
    found = sorted(found, key=lambda x: (-x[1], x[0]))
    chosen = registry.select_engines(found, options)
    warnings = [] if chosen else ["no engine to read with"]
    if not chosen:
        return _nothing(spark, root, found, warnings)
    every, added = _with_added(spark, root, index.filter("kind = 'script'"), chosen)
    ranked = _index(spark, root, options, every, files, chosen, warnings)
    if ranked is None:
        return _nothing(spark, root, found, [*warnings, "there is nothing to parse"])
    step(0.2, "versions")
    resolved = staged(_versions(ranked, options, warnings), "versions")
    step(0.4, "scripts")
    kept = _routed(resolved.filter("kept and error is null"))
    text = staged(texts(_read(kept.filter("not blob"), added), options), "texts")
    step(0.7, "strings")
    blobs = staged(strings(_read(kept.filter("blob"), added)), "strings")
    rows = _rows(text, blobs, options)
    step(0.98, "lines")
    place = [F.col("script_ord"), F.col("line_no"), F.col("part_no"), F.col("sub_no")]
    final = lines.dedupe_in(rows, [], place) if options.dedupe else rows
    numbered = lines.dense_index(final, ["script_ord"], ["line_no", "part_no", "sub_no"])
    out = numbered.join(kept.select("script_ord", "virtual_path", "engine", "container"), "script_ord").select("index", "speaker", "text", F.col("virtual_path").alias("source"), "engine", "container")
    counts = lines.script_counts(rows, ["script_ord"])
    report = resolved.join(counts, "script_ord", "left").join(text.select("script_ord", "encoding"), "script_ord", "left")
    report = report.withColumn("line_count", F.coalesce("line_count", F.lit(0).cast("long"))).withColumn("note", F.lit(""))
    columns = ["virtual_path", "engine", "container", "size", "line_count", "encoding", "note", "error"]
    report = report.select(*columns, "kept", "winner").fillna("", ["encoding", "error"])
    whole = lines.with_overridden(report.filter("kept").select(*columns), report.filter("not kept").select(*columns, "winner"))
    step(1.0, "done")
    return ScanFrames(root, found, out, whole, warnings)


def _with_added(spark: SparkSession, root: str, every: DataFrame, chosen: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Index rows with those of engines from outside, and the bytes of these; an engine that fails gives one row with its error."""
    data = None
    for key in chosen:
        if key in registry.BUILT_IN:
            continue
        try:
            rows = staged(registry.load(key)[0].scripts(spark, root).select("virtual_path", "container", "data", "size", "error").withColumn("engine", F.lit(key)), "added")
        except Exception as e:
            rows = spark.createDataFrame([(key, "", None, 0, f"{type(e).__name__}: {e}", key)], "virtual_path string, container string, data binary, size long, error string, engine string")
        data = rows if data is None else data.unionByName(rows)
    if data is None:
        return every, None
    none = F.lit(None).cast("string")
    return every.unionByName(data.drop("data").withColumns({"path": none, "member": none, "kind": F.lit("script"), "rel": none, "head": F.lit(None).cast("binary")})), data


def _read(kept: DataFrame, added: DataFrame | None) -> DataFrame:
    """script_ord, engine, virtual_path, data of kept index rows."""
    rows = archives.read(kept.filter("path is not null"))
    if added is None:
        return rows
    others = kept.filter("path is null").select("script_ord", "engine", "virtual_path", "container").join(added.select("engine", "virtual_path", "container", "data"), ["engine", "virtual_path", "container"])
    return rows.unionByName(others.select("script_ord", "engine", "virtual_path", "data"))
