"""Query op5: all documents through the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmetrics.llm import quality
from callmetrics.llm.common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Quantiles out of 1000 by rate.
_LEVEL = "CASE rate WHEN 'symbols' THEN 900 WHEN 'dup_lines' THEN 995 WHEN 'repeats' THEN 995 ELSE 900 END"


def _fences(name: str, source: str, keys: str) -> str:
    head = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {head}rate, rows, high + (high - mid) AS fence FROM (
    SELECT {head}rate, CAST(any_value(rows) AS BIGINT) AS rows,
      min(CASE WHEN 1000 * upto >= 500 * rows THEN edge END) AS mid, min(CASE WHEN 1000 * upto >= {_LEVEL} * rows THEN edge END) AS high
    FROM (SELECT {head}rate, bucket,
        CASE WHEN bucket < 64 THEN bucket ELSE ((bucket - 32 * (bucket // 32 - 1) + 1) << (bucket // 32 - 1)) - 1 END AS edge,
        sum(n) OVER (PARTITION BY {head}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {head}rate) AS rows
      FROM (SELECT {head}rate, bucket, sum(n) AS n FROM {source} GROUP BY ALL))
    GROUP BY ALL))"""


def _inside(count: str, among: str, most: str) -> str:
    return f"1000.0::DOUBLE * {count} <= {most} * {among} + 1000.0::DOUBLE * (9 + 3 * sqrt(CAST({most} * {among} AS DOUBLE) / 1000.0::DOUBLE))"


SQL = {
    "op5_quality_rules": rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3
), grams AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS seen FROM windows
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) t(k) WHERE seen > 1 GROUP BY row
), counted AS (
  SELECT row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered USING (row)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM counted
), long AS (
  SELECT lang, source, rate, value, greatest(length(bin(value)) - 6, 0) AS e
  FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS rate,
          unnest([symbols, dup_lines, repeats, word_length]) AS value FROM judged WHERE NOT base_failed)
), sketch AS (
  SELECT lang, source, rate, CAST(32 * e + (value >> e) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY ALL
), {_fences("own", "sketch", "lang, source")}, {_fences("by_lang", "sketch", "lang")}, {_fences("by_all", "sketch", "")}, bounds AS (
  SELECT o.lang, o.source, o.rate, (o.rows * o.fence + 200 * ((l.rows * l.fence + 200 * a.fence) // (l.rows + 200))) // (o.rows + 200) AS bound
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN by_all a ON o.rate = a.rate
), limits AS (
  SELECT lang, source, max(bound) FILTER (WHERE rate = 'symbols') AS s, max(bound) FILTER (WHERE rate = 'dup_lines') AS d,
    max(bound) FILTER (WHERE rate = 'repeats') AS r, max(bound) FILTER (WHERE rate = 'word_length') AS c FROM bounds GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({_inside("n_symbols", "n_words", "s")} AND {_inside("n_dup_lines", "n_lines", "d")}
    AND {_inside("n_repeat_words", "n_words", "r")} AND {_inside("word_chars", "n_words", "c")}, false) AS kept
FROM judged j LEFT JOIN limits t ON j.lang IS NOT DISTINCT FROM t.lang AND j.source IS NOT DISTINCT FROM t.source
""",
}
