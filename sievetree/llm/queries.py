"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe_columns, exact_dedup, gif, line_dedup, lm_score, packing, quality, secret_scan, simhash, token_counts
from .common import load


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(load(spark, sf_dir))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(load(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(load(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_blocks(load(spark, sf_dir))
    return clean.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, sf_dir)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(load(spark, sf_dir))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(load(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(load(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_columns.encode(load(spark, sf_dir), with_decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_lm_score, op3_simhash, op4_secrets, op5_line_dedup, op6_quality, op7_packing, op8_gif, op9_exact_dedup, op10_bpe)}

_SPANS = """
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, i,
         list_sum([length(x) FOR x IN parts[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0) AS s,
         list_sum([length(x) FOR x IN parts[1:i]]) + list_sum([length(x) FOR x IN hits[1:i]]) AS e
  FROM (SELECT doc_id, hits, grp, parts, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS grp, string_split_regex(t, '{pattern}') AS parts
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d WHERE regexp_matches(t, '{pattern}')) h) u
  WHERE length(grp[i]) >= {least}"""


def _secret_sql() -> str:
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = (("(?i)" if rule.ignore_case else "") + rule.pattern).replace("'", "''")
        parts.append(_SPANS.format(kind=rule.kind, order=order, pattern=pattern, group=rule.group, least=rule.least))
    spans = " UNION ALL ".join(parts)
    joined = "coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord){}, '')"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    base = sum(r.base for r in secret_scan.RULES)
    return f"WITH spans AS ({spans}) SELECT d.doc_id, {counts}, sha256({joined.format(f' FILTER (WHERE ord < {base})')}) AS base_sha256, {joined.format('')} AS spans FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"


_BLANK = "translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

ORACLE_SQL: dict[str, str] = {
    "op4_secrets": _secret_sql(),
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_BLANK} AS norm, length(coalesce(text, '')) AS len FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-len, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm""",
}
