"""Query op11: the prefix trie of conversations that are rebuilt to share their first turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import trie
from callmetrics.llm.common import cut, table
from callmetrics.llm.turns import crc32_of

FAMILY, MOST_SHARED = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which conversation c begins with the first h turns of conversation c - c % 100 instead of
    its own first h, h being CRC-32 of c modulo 6. A head lends at most 5 turns to the 100 numbers it stands for."""
    c = F.col("conv_id")
    own = turns.select("*", F.pmod(crc32_of(c.cast("string")), F.lit(MOST_SHARED)).alias("h"), (c - c % FAMILY).alias("head"))
    convs = own.select("conv_id", "h", "head").distinct()
    heads = turns.where(F.col("place") < MOST_SHARED - 1).select(F.col("conv_id").alias("head"), "place", "digest", "chars")
    shared = convs.join(heads, "head").where(F.col("place") < F.col("h")).select("conv_id", "place", "digest", "chars")
    lent = heads.groupBy("head").agg(F.count(F.lit(1)).alias("lent"))
    rest = own.where(F.col("place") >= F.col("h")).join(lent, "head", "left")
    moved = (F.col("place") - F.col("h") + F.least("h", F.coalesce("lent", F.lit(0)))).cast("long")
    return convs.select("conv_id"), shared.unionByName(rest.select("conv_id", moved.alias("place"), "digest", "chars"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = cut(trie.placed_turns(rows))
    return trie.prefix_trie(*rebuilt(turns)).drop(*trie.KEY)


SQL = {
    "op11_prefix_trie": r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS place FROM named
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head,
    xor(list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ord(substr(CAST(conv_id AS VARCHAR), i, 1))),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
      4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM named)
), made AS (
  SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.head AND o.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place >= c.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key
  FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), paths AS (
  SELECT conv_id, depth, chars, key FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, count(*) AS n_convs FROM paths GROUP BY key
), parents AS (
  SELECT n.key, p.key AS parent_key, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = substr(n.key, 1, 64 * (n.depth - 1))
), children AS (
  SELECT parent_key AS key, count(*) AS n FROM parents WHERE parent_key IS NOT NULL GROUP BY 1
), below AS (
  SELECT DISTINCT a.key AS top, b.key FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT b.top AS key, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.key = b.key LEFT JOIN children c ON c.key = b.key GROUP BY 1
), lasts AS (
  SELECT p.key, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
  FROM paths p JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY 1) m ON m.conv_id = p.conv_id AND m.depth = p.depth GROUP BY 1
)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM nodes n JOIN parents p ON p.key = n.key JOIN sums s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN lasts l ON l.key = n.key
""",
}
