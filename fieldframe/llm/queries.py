"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, langid, lm, packing, quality, simhash, token_store, toxicity
from .common import stash, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_digests(stash(token_store.encode_documents(table(spark, sf_dir, "documents")), "token-ids"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_simhash, op3_html, op4_token_ids, op5_decontaminate, op6_language, op7_quality, op8_chat, op9_lm_score, op10_packing)
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT row_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), places AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row_id
), items AS (
  SELECT row_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (row_id) LEFT JOIN items USING (row_id)
"""


def _coverage_sql() -> str:
    parts = []
    for n in quality.COVERAGE:
        parts.append(
            f"""
w{n} AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS k FROM (
    SELECT row_id, i, array_to_string(w[i : i + {n - 1}], ' ') AS g
    FROM (SELECT row_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d WHERE len(w) >= {n}))
), c{n} AS (
  SELECT row_id, count(*) AS words, sum(length(w[p])) AS chars
  FROM (SELECT DISTINCT row_id, unnest(range(i, i + {n})) AS p FROM w{n} WHERE k > 1) JOIN d USING (row_id) GROUP BY row_id
)"""
        )
    return ",".join(parts)


def quality_sql() -> str:
    shares = " OR ".join(f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in quality.COVERAGE.items())
    columns = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in quality.COVERAGE)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.row_id = d.row_id" for n in quality.COVERAGE)
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT row_id, i, line, row_number() OVER (PARTITION BY row_id, line ORDER BY i) AS k
  FROM (SELECT row_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT row_id, string_split(text, chr(10)) AS s FROM d))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), ld AS (
  SELECT row_id, count(*) AS lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM l WHERE k > 1 GROUP BY row_id
),{_coverage_sql()}, m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(ld.lines, 0)::BIGINT AS n_dup_lines, coalesce(c5.words, 0)::BIGINT AS n_repeat_words, coalesce(ld.chars, 0)::BIGINT AS dup_line_chars, {columns}
  FROM d LEFT JOIN ld ON ld.row_id = d.row_id {joins}
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND NOT (100 * dup_line_chars > {quality.LINE_COVERAGE} * word_chars OR 100 * n_symbols > {quality.SYMBOLS} * n_words OR {shares}) AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": DECONTAMINATE_SQL, "op7_quality": quality_sql(), "op8_chat": chat.ROTATE_SQL}
