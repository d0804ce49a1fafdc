"""Query op2: all pages written as WARC records and read back through the capture index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmetrics.llm import warc
from callmetrics.llm.common import table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.fetch(warc.write(pages), warc.keys_of(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a 40-digit hex string: 5 bits at a time out of its bit string.
_BITS = "array_to_string(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::INT), 4, '0')), '')"
SQL = {
    "op2_warc": f"""
WITH keyed AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT hex, min(page_id) AS original FROM keyed GROUP BY hex
), bits AS (
  SELECT hex, original, {_BITS} AS bits FROM firsts
), digests AS (
  SELECT hex, original, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, i * 5 + 1, 5))::INT, 1)), '') AS digest
  FROM bits
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM keyed JOIN digests USING (hex)
""",
}
