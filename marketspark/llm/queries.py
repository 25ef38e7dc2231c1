"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import align, decontaminate, html, langid, mixing, neighbours, pii, quality, repair, rules, sharding, simhash, substring
from marketspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


#: All windows of 35 words, counted; words under a window that is there twice are taken out.
SUBSTRING_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT r, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
    SELECT r, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS hs FROM texts WHERE len(ws) >= 35)
), covered AS (
  SELECT DISTINCT r, i + k AS i FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) AS twice USING (h), range(0, 35) AS t(k)
), words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


@query("op1_substring_dedup", SUBSTRING_SQL)
def _substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op2_html_extraction")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


@query("op3_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.scored(docs, quality.learned(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality.KEEP).cast("int").alias("predicted"))


@query("op4_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tiles", "matched_words", "item_words", "coverage")


@query("op5_language_id")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op6_mixing")
def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, carry=("doc_id", "source")).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op7_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(F.encode(pii.written(F.col("base")), "UTF-8"), 256)
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], base.alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op8_hilbert_sharding")
def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_nn_descent")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


#: Measures of every text, failures by source, rates shrunk to a beta prior by moments. Four rules, as in ``rules``.
HOST_RULES_SQL = r"""
WITH texts AS (
  SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT r, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
    SELECT r, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) AS hs FROM texts WHERE len(ws) >= 9)
), again AS (
  SELECT r, i FROM windows SEMI JOIN (SELECT r, h FROM windows GROUP BY r, h HAVING count(*) > 1) AS twice USING (r, h)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS t(k) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measures AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), failures AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, unnest([
    {'rule': 1, 'f': n_words < 20}, {'rule': 2, 'f': 100 * n_repeat_words > 30 * n_words},
    {'rule': 3, 'f': 10 * n_symbols > n_words}, {'rule': 4, 'f': 10 * n_dup_lines > 3 * n_lines}], recursive := true) FROM measures
), hosts AS (
  SELECT source, rule, count(*) AS n, CAST(count(*) FILTER (f) AS DOUBLE) AS f FROM failures WHERE source IS NOT NULL GROUP BY ALL
), moments AS (
  SELECT rule, count(*) AS k, CAST(sum(n) AS DOUBLE) AS total, sum(f) / sum(n) AS p, sum(f * f / n) AS ff, sum(CAST(n AS DOUBLE) * n) AS nn FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, p, ((ff - total * p * p) / nullif(p * (1 - p), 0) - (k - 1)) / nullif(total - nn / total - (k - 1), 0) AS rho FROM moments
), verdicts AS (
  SELECT source, bool_or(coalesce(CASE WHEN rho > 0 THEN (f + (1 / least(rho, 1) - 1) * p) / (n + 1 / least(rho, 1) - 1) END, p) >= 0.5) AS host_failed
  FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_failed, false) AS host_failed,
  NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures) LEFT JOIN verdicts USING (source)
"""


@query("op12_host_rules", HOST_RULES_SQL)
def _host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.ruled(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


@query("op11_token_alignment")
def _token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def _conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summarised(repair.damaged(table(spark, sf_dir, "conversations")))
