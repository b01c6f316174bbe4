"""The registered queries of the ten operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, fingerprints, language_id, near_duplicates, quality, repeated_passages, token_files, toxicity, url_rules
from .runtime import staged

#: Rules of op3 (fixed values): host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprints.classes(docs, prints=staged(fingerprints.edited_pairs(docs), "forms"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",").alias("item_ids"), "n_items", "most_equal")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(_table(spark, sf_dir, "documents"), good)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(_remainder(5) != 0))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_passages.cut_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(_remainder(4) != 2), labels.filter(_remainder(4) != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "worst_score", "worst_begin", "worst_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_url_rules": op3_url_rules,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

_OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.seen
), least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_OP3 = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(h, p, v) AS (VALUES {_RULES}
), fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND k = 1
"""


#: All alignments of all items, by their equal tokens; no masks.
_OP4 = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents
), b AS (SELECT item_id, w, len(w) AS n, CASE WHEN len(w) < 10 THEN len(w) ELSE ceil(0.8 * least(len(w), 13) - 1e-9) END AS need FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) >= 5
), dw AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d
), bw AS (SELECT item_id, n, need, unnest(w) AS t, unnest(range(len(w))) AS p FROM b
), equal AS (
  SELECT doc_id, item_id, dw.p - bw.p AS g, any_value(n) AS n, any_value(need) AS need, count(*) AS m, list(bw.p ORDER BY bw.p) AS pos
  FROM dw JOIN bw USING (t) GROUP BY ALL HAVING count(*) >= any_value(need)
), dense AS (
  SELECT *, list_max(list_transform(pos, lambda x: len(list_filter(pos, lambda y: y >= least(x, n - least(n, 13)) AND y < least(x, n - least(n, 13)) + 13)))) AS best FROM equal
)
SELECT doc_id, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS item_ids, count(DISTINCT item_id) AS n_items, CAST(max(CAST(m AS DOUBLE) / n) AS DOUBLE) AS most_equal
FROM dense WHERE best >= need GROUP BY doc_id
"""


_OP7 = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(list_slice(w, i, i + 49), ' '))) AS s
  FROM words WHERE len(w) >= 50
), firsts AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM windows JOIN firsts USING (s) WHERE low < doc_id
), flat AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_near_duplicates": _OP2, "op3_url_rules": _OP3, "op4_decontamination": _OP4, "op7_repeated_passages": _OP7}
