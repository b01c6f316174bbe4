"""URL filters: block and allow rules joined to pages by one sorted sweep.

A host is turned into a canonical key: its labels reversed, each closed by U+0000.
A host rule is then an interval of keys (every key that starts with the rule's key),
and the intervals of any two rules are nested or apart. Pages and rules are cut into
key ranges, sorted, and swept once: a stack holds the rules whose interval is open at
the current key, so a page meets only rules of its own host and its parent domains.

Path prefixes are looked up in the open rules by their lengths. Of all rules that
fit, the one with the longest text (host + path) wins; of equally long ones that
with the longer host, then a block rule.

Skew: cut points are quantiles of the keys. A key range that holds the share of
several parts (one host with a third of all pages) is dealt to that many tasks, and
the few rules that reach into it go to each of them.

Defined results: null urls and urls without `://` have an empty host and path and
get the default verdict, as does every url that no rule fits; repeated rows give one
result each; rules with a null or empty host, or a verdict other than block or
allow, are ignored; repeated rules count once, and of two verdicts for one rule block
stays; an empty table of pages gives an empty result, without rules every url gets the
default. Urls of any length are judged whole. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship, shuffle_parts, spread

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys looked at to place the cut points; they affect balance only, never results.
SAMPLE_KEYS = 4000
#: Longest cut point: the beginning of a key cuts as well as the key.
KEY_CHARS = 256


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by U+0000: a parent domain's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0"))


def _after(key: str) -> str:
    """The least string above every string that starts with the key (which ends in U+0000)."""
    return key[:-1] + "\1"


def cut_points(keys: list[str], parts: int) -> list[str]:
    """parts - 1 quantiles of a sample; a key that fills several parts appears several times."""
    keys = sorted(keys)
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


class Deal:
    """Maps a key to the tasks that share its key range."""

    def __init__(self, cuts: list[str]):
        self.edges = sorted(set(cuts))
        # A range that starts at a repeated cut is shared by as many tasks.
        self.copies = [1] + [cuts.count(e) for e in self.edges]
        self.base = [sum(self.copies[:i]) for i in range(len(self.copies))]

    def range_at(self, key: str) -> int:
        return bisect.bisect_right(self.edges, key)

    def tasks(self, first: int, last: int) -> list[int]:
        return [self.base[r] + c for r in range(first, last + 1) for c in range(self.copies[r])]


def _dealer(cuts: list[str]):
    deal = Deal(cuts)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            tasks = []
            for key in b.column("key").to_pylist():
                r = deal.range_at(key)
                turn += 1
                tasks.append(deal.base[r] + turn % deal.copies[r])
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), *b.columns], names=["task", *b.schema.names])

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, tasks = [], []
            for i, key in enumerate(b.column("key").to_pylist()):
                for t in deal.tasks(deal.range_at(key), deal.range_at(_after(key))):
                    rows.append(i)
                    tasks.append(t)
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), *taken.columns], names=["task", *b.schema.names])

    return pages, rules


class _Open:
    """A rule interval on the stack: the rules of one host."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        # Of two verdicts for one rule, block stays.
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        if len(path) not in self.lengths:
            bisect.insort(self.lengths, len(path))

    def longest(self, path: str) -> str | None:
        for n in reversed(self.lengths):
            if n <= len(path) and path[:n] in self.paths:
                return path[:n]
        return None


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        task = None
        for b in batches:
            ids, rules, verdicts, hosts, paths = [], [], [], [], []
            columns = [b.column(n).to_pylist() for n in ("task", "key", "is_page", "row_id", "host", "path", "rule_verdict")]
            for t, key, is_page, row_id, host, path, verdict in zip(*columns, strict=True):
                if t != task:
                    task, stack = t, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key, host))
                    stack[-1].add(path, verdict)
                    continue
                best = None
                for frame in stack:
                    if (host == frame.host or host.endswith("." + frame.host)) and (fit := frame.longest(path)) is not None:
                        best = max(best or (-1, -1, "", ""), (len(frame.host) + len(fit), len(frame.host), frame.host + fit, frame.paths[fit]))
                ids.append(row_id)
                hosts.append(host)
                paths.append(path)
                rules.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`.

    `rules` has columns host, path, verdict (block or allow).
    """
    spark = pages.sparkSession
    ship(spark)
    url = F.col(url_col)
    left = pages.select(F.col(id_col).cast("long").alias("row_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    left = left.select(host_key(F.col("host")).alias("key"), F.lit(True).alias("is_page"), "row_id", "host", "path", F.lit(None).cast("string").alias("rule_verdict"))
    right = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host != '' and verdict in ('block', 'allow')")
    right = right.select(host_key(F.col("host")).alias("key"), F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("row_id"), "host", "path", F.col("verdict").alias("rule_verdict"))
    parts = shuffle_parts(spark)
    # A draw of about SAMPLE_KEYS rows, whatever their number and however many are alike.
    drawn = left.sample(min(1.0, SAMPLE_KEYS / max(1, left.count())), seed=17)
    cuts = cut_points([r["key"] for r in drawn.select(F.substring("key", 1, KEY_CHARS).alias("key")).collect()], parts)
    deal_pages, deal_rules = _dealer(cuts)
    schema = "task int, key string, is_page boolean, row_id long, host string, path string, rule_verdict string"
    both = left.mapInArrow(deal_pages, schema).unionByName(right.mapInArrow(deal_rules, schema))
    ordered = both.withColumn("at", spread(spark, F.col("task"), parts)).repartition(parts, "at").drop("at").sortWithinPartitions("task", "key", "is_page")
    return ordered.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
