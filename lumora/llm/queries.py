"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_bpe, decontam, lm_score, near_dup, pii, quality, ranked_search, secrets, source_mix, suffix_dedup, token_records, turn_repair, url_filter
from .common import LOWER, UPPER, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


OP1_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, verdict, rhost, rpath) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/'))
SELECT any_value(u.page_id) AS page_id, any_value(u.host) AS host, any_value(u.path) AS path,
       arg_max(r.rule, length(r.rule)) AS rule, coalesce(arg_max(r.verdict, length(r.rule)), 'allow') AS verdict,
       count(r.rule) AS n_hits
FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
GROUP BY u.rid
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_suffixes(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(table(spark, sf_dir, "documents"), token_records.default_tokenizer())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ranked_search.TERM}') AS terms FROM documents),
b AS (
  SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ranked_search.TERM}')) AS terms FROM benchmark),
size AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d),
asked AS MATERIALIZED (SELECT iid, item_id, unnest(terms) AS term FROM b),
p AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), size),
s AS (
  SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM p JOIN asked USING (term) JOIN w USING (term), size GROUP BY iid, rid),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip(table(spark, sf_dir, "documents"), chunk_bpe.default_tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # corpus_pipeline imports this package, so it is not imported with it
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mix": op2_source_mix,
    "op3_decontam": op3_decontam,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_lm_score": op6_lm_score,
    "op7_token_records": op7_token_records,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_near_dup": op10_near_dup,
    "op11_turn_repair": op11_turn_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_chunk_bpe": op13_chunk_bpe,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op12_ranked_search": OP12_SQL}
