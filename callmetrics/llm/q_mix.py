"""Query op1: all documents mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmetrics.llm import mixing
from callmetrics.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.per_document(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce('=' || source, '') AS queue,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 13) AS key
  FROM documents
), per_source AS (
  SELECT source, queue, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL
), weighted AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM per_source
), ranked AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS level,
    row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST) AS place FROM weighted
), tried AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level_tried
  FROM ranked
), water AS (
  SELECT arg_min(level_tried, place) AS water FROM tried WHERE level_tried <= level
), targets AS (
  SELECT queue, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), water * weight), CAST(2 * source_size AS DOUBLE)) AS target
  FROM tried, water
), waiting AS (
  SELECT s.*, t.source_size, t.target,
    coalesce(sum(size) OVER (PARTITION BY queue ORDER BY key, doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM sized s JOIN targets t USING (queue)
), timed AS (
  SELECT *, epoch * source_size + done AS begun, (epoch * source_size + done + size) / nullif(target, 0) AS finish
  FROM waiting, (VALUES (0), (1)) e(epoch)
), lined_up AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish NULLS FIRST, queue, key, doc_id NULLS FIRST, epoch, size, row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM timed
)
SELECT doc_id, size, source_size, target,
  CAST(sum(greatest(0, least(size, (SELECT CAST(floor(1.5::DOUBLE * sum(source_size)) AS BIGINT) FROM per_source) - before))) AS BIGINT) AS taken
FROM lined_up GROUP BY row, doc_id, size, source_size, target
""",
}
