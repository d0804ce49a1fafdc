"""Query op6: later repeated runs of lines deleted from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import line_dedup
from callmetrics.llm.common import table


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = line_dedup.dedup_lines(docs)
    return made.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "text")


def _reach(side: int) -> str:
    """How many neighbouring lines of a match are equal, before (-1) or after (1) it."""
    edge, first_edge = ("i", "fi") if side < 0 else ("e", "fe")
    words = "edge.cum - edge.wc - (d.cum - d.wc)" if side < 0 else "d.cum - edge.cum"
    return f"""SELECT m.doc_id, m.i, coalesce(min(k) FILTER (WHERE d.t IS NULL OR g.t IS NULL OR d.t <> g.t OR {words} >= 50), 51) - 1 AS n
  FROM matches m CROSS JOIN range(1, 51) r(k)
  JOIN lines edge ON edge.doc_id = m.doc_id AND edge.seq = m.{edge}
  LEFT JOIN lines d ON d.doc_id = m.doc_id AND d.seq = m.{edge} + {side} * k
  LEFT JOIN lines g ON g.doc_id = m.f AND g.seq = m.{first_edge} + {side} * k
  GROUP BY m.doc_id, m.i"""


SQL = {
    "op6_line_dedup": rf"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), worded AS (
  SELECT doc_id, line, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS wc FROM split
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq, CAST(sum(wc) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS cum FROM worded WHERE wc > 0
), ends AS (
  SELECT a.doc_id, a.seq AS i, min(b.seq) AS e FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49 AND b.cum - a.cum + a.wc >= 50 GROUP BY ALL
), windows AS (
  SELECT n.doc_id, n.i, n.e, string_agg(l.t, chr(10) ORDER BY l.seq) AS key FROM ends n JOIN lines l ON l.doc_id = n.doc_id AND l.seq BETWEEN n.i AND n.e GROUP BY ALL
), firsts AS (
  SELECT key, min((doc_id, i, e)) AS w FROM windows GROUP BY key HAVING count(*) > 1
), matches AS (
  SELECT doc_id, i, e, w[1] AS f, w[2] AS fi, w[3] AS fe FROM windows JOIN firsts USING (key) WHERE doc_id <> w[1] OR i <> w[2]
), before AS ({_reach(-1)}), after AS ({_reach(1)}), runs AS (
  SELECT m.doc_id, CASE WHEN m.doc_id = m.f THEN greatest(a.line, g.line + 1) ELSE a.line END AS low, b.line AS high
  FROM matches m JOIN before x ON x.doc_id = m.doc_id AND x.i = m.i JOIN after y ON y.doc_id = m.doc_id AND y.i = m.i
  JOIN lines a ON a.doc_id = m.doc_id AND a.seq = m.i - x.n JOIN lines b ON b.doc_id = m.doc_id AND b.seq = m.e + y.n JOIN lines g ON g.doc_id = m.f AND g.seq = m.fe
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS line FROM runs WHERE low <= high
)
SELECT s.doc_id, count(*) AS n_lines, count(r.line) AS n_removed, coalesce(string_agg(s.x, chr(10) ORDER BY s.line) FILTER (WHERE r.line IS NULL), '') AS text
FROM split s LEFT JOIN removed r ON r.doc_id = s.doc_id AND r.line = s.line GROUP BY s.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
""",
}
