"""Engines: what there is, and which of them a folder looks like."""

from __future__ import annotations

import importlib
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..options import ScanOptions
from ..sources import archives, dsc
from ..sources.containers import ARC_KINDS, XP3_MAGIC
from ..sources.loose import NSCRIPT_NAMES, SCRIPT_EXT, in_skipped_dir

#: key -> (name, module). A module of another package may be added with register(); it has
#: score(files) -> int over the listing, and scripts(spark, root) -> rows of archives.SCRIPTS.
MODULES: dict[str, tuple[str, str]] = {
    "kirikiri": ("KiriKiri / KAG", "linequarry.operators.kag"),
    "nscripter": ("NScripter", "linequarry.operators.nscript"),
    "bgi": ("BGI / Ethornell", "linequarry.functions.binary"),
    "plaintext": ("loose script files", "linequarry.sources.loose"),
    "generic": ("binary strings", "linequarry.functions.binary"),
    # Planned: there is no module of that name yet.
    "reallive": ("RealLive", "linequarry.operators.reallive"),
}
BUILT_IN = frozenset(MODULES)


def register(key: str, name: str, module: str) -> None:
    """Add an engine, or put another module in the place of one."""
    MODULES[key] = (name, module)


def load(key: str) -> tuple[ModuleType | None, str]:
    """The module of an engine, or None and what went wrong; a broken module breaks nothing else."""
    if key not in MODULES:
        return None, f"no engine {key!r}"
    try:
        return importlib.import_module(MODULES[key][1]), ""
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def available() -> list[str]:
    return [k for k in MODULES if load(k)[0] is not None]


def listed() -> list[tuple[str, str, bool, str]]:
    """key, name, available, error of every engine."""
    rows = []
    for key, (name, _) in MODULES.items():
        module, error = load(key)
        rows.append((key, name, module is not None, error))
    return rows


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(listed(), "key string, name string, available boolean, error string")


def engine_name(key: str) -> str:
    return MODULES[key][0] if key in MODULES else key


def added_scores(files: DataFrame) -> list[tuple[str, int]]:
    """Scores of engines that were registered from outside; one that fails has none."""
    out = []
    for key in MODULES:
        if key in BUILT_IN:
            continue
        module, _ = load(key)
        try:
            score = min(100, int(module.score(files)))
        except Exception:
            continue
        if score > 0:
            out.append((key, score))
    return out


def scores(listing: DataFrame, by: list[str] | None = None) -> DataFrame:
    """key, score (1 to 100) of the engines that a listing (rel, length, head) speaks for, best first.

    `head` holds the first 16 bytes of a file. One aggregation over the listing, for each
    value of the columns `by` if there are such.
    """
    rel, name, ext = F.col("rel"), F.lower(F.regexp_extract("rel", r"([^/]*)\z", 1)), clean.extension(F.col("rel"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    add = lambda c, n: F.when(any_(c), n).otherwise(0)
    magic = (ext == ".xp3") & (F.substring("head", 1, 11) == F.lit(XP3_MAGIC))
    arc = (ext == ".arc") & F.substring("head", 1, 12).isin(*[F.lit(k) for k in ARC_KINDS]) & rel.rlike(r"\A(?:(?i:data)/)?[^/]*\z")
    top = ~F.contains(rel, F.lit("/"))
    kirikiri = (
        add(magic, 70) + F.when(any_(magic), add(name.isin("data.xp3", "scenario.xp3", "patch.xp3"), 10)).otherwise(add(ext == ".xp3", 5)) + add(ext == ".ks", 35) + add(ext == ".tjs", 20)
        + add(name.isin("startup.tjs", "config.tjs", "initialize.tjs"), 15) + add(ext == ".tpm", 15) + add(name.rlike(r"\A(?:krkr|kirikiri).*\.exe\z"), 20) + add(F.lower(rel).rlike(r"\Akag3/"), 10)
    )
    n_script = F.sum(F.when(name.isin(*NSCRIPT_NAMES), 45).when(ext.isin(".nsa", ".sar"), 20).when(name.rlike(r"\Aonscripter.*\.exe\z"), 25).otherwise(0))
    nscripter = F.when(n_script > 0, 30 + n_script).otherwise(0)
    # Only scripts are looked at: the same first bytes in a program or an archive say nothing.
    packed = top & ext.isin(*sorted(archives.WANTED["bgi"] - {""})) & (F.substring("head", 1, 16) == F.lit(dsc.MAGIC))
    bgi = add(arc, 85) + add(top & name.rlike(r"\Abgi.*\.exe\z"), 10) + add(top & name.rlike(r"\.bgi\z"), 10) + add(ext == ".ws2", 5) + add(packed, 15)
    hits = F.count_if(ext.isin(*SCRIPT_EXT) & ~in_skipped_dir(rel))
    plain = F.when(hits > 0, 8 + 3 * F.least(F.lit(5), hits)).otherwise(0)
    by = by or []
    one = listing.groupBy(*by).agg(kirikiri.alias("kirikiri"), nscripter.alias("nscripter"), bgi.alias("bgi"), plain.alias("plaintext"))
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.least(F.lit(100), F.col(k)).cast("int").alias("score")) for k in ("kirikiri", "nscripter", "bgi", "plaintext")])
    rows = one.select(*by, F.explode(each).alias("r")).select(*by, "r.*").filter("score > 0")
    return rows if by else rows.orderBy(F.col("score").desc(), "key")


def select_engines(found: list[tuple[str, int]], options: ScanOptions) -> list[str]:
    """Engines in rank order: those asked for, else those with score enough, then plain files, then generic if asked."""
    known = available()
    if options.engines:
        return [k for k in dict.fromkeys(options.engines) if k in known]
    out = [k for k, score in found if score >= options.min_engine_score and k != "generic"]
    return list(dict.fromkeys([*out, "plaintext", *(["generic"] if options.include_generic else [])]))
