"""Query op12: damaged conversations and their cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import repair
from callmetrics.llm.common import table
from callmetrics.llm.trie import EMPTY_SHA256
from callmetrics.llm.turns import crc32_of, digest_in_order, named_turns

BLANK = " "


def damaged(rows: DataFrame) -> DataFrame:
    """By CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties it, 2 takes its sentence ends, 3 repeats it, 4
    makes it the user's. Nulls count as one space, in that key too."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(BLANK)))
    marked = named_turns(rows, BLANK).withColumn("damage", F.pmod(crc32_of(key), F.lit(20))).where("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired, audits = repair.repair(damaged(rows), BLANK)
    pieces = repaired.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("piece"))
    digests = digest_in_order(pieces, ["conv_id"], ["place"], "piece", "\n", "repaired_sha256")
    convs = rows.where("conv_id is not null").select(F.col("conv_id").cast("long")).distinct()
    made = convs.join(audits, "conv_id", "left").join(digests, "conv_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return made.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


SQL = {
    "op12_structure_repair": r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations WHERE conv_id IS NOT NULL
), marked AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, i, 1))),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
      4294967295), 4294967295) % 20 AS damage
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE damage <> 0
), digested AS (
  SELECT conv_id, turn, role, text, copy, sha256(length(role) || ':' || role || text) AS digest FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS pos FROM digested
), judged AS (
  SELECT conv_id, pos, turn, role, text, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY 1
), step(s, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), free AS (SELECT s, t FROM step WHERE c <> 's'
), ins AS (
  SELECT s, 0 AS run, s AS t FROM free UNION ALL SELECT s, 1, t FROM free
  UNION ALL SELECT a.s, 2, b.t FROM free a JOIN free b ON b.s = a.t
), ways AS (
  SELECT s, repeat('I', run) || 'D' AS code, 2 * run + 3 AS cost, t, CAST(NULL AS VARCHAR) AS initial, false AS stays FROM ins
  UNION ALL SELECT i.s, repeat('I', run) || 'R', 2 * run + 2, f.t, CAST(NULL AS VARCHAR), true FROM ins i JOIN free f ON f.s = i.t
  UNION ALL SELECT i.s, repeat('I', run) || 'K', 2 * run, p.t, p.c, true FROM ins i JOIN step p ON p.s = i.t
), layers AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM counted
  UNION ALL
  SELECT l.conv_id, l.pos + 1, w.t,
    min({'cost': l.best.cost + w.cost + CASE WHEN w.stays AND j.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': l.best.audit || w.code})
  FROM layers l JOIN judged j ON j.conv_id = l.conv_id AND j.pos = l.pos + 1
    JOIN ways w ON w.s = l.state AND (w.initial IS NULL OR w.initial = j.initial) AND (NOT w.stays OR j.fault IN ('', 'truncated'))
  GROUP BY 1, 2, 3
), solved AS (
  SELECT l.conv_id, min({'cost': l.best.cost + 2 * i.run, 'audit': l.best.audit || repeat('I', i.run)}) AS best
  FROM layers l JOIN counted c ON c.conv_id = l.conv_id AND c.n = l.pos JOIN ins i ON i.s = l.state AND i.t IN (0, 3) GROUP BY 1
), letters AS (
  SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS spot FROM solved
), edits AS (
  SELECT conv_id, spot, substr(audit, spot, 1) AS edit,
    length(regexp_replace(substr(audit, 1, spot), 'I', '', 'g')) AS pos,
    length(regexp_replace(substr(audit, 1, spot - 1), 'D', '', 'g')) AS place,
    length(regexp_replace(audit, 'D', '', 'g')) % 2 AS lead
  FROM letters
), pieces AS (
  SELECT e.conv_id, e.place, CASE e.edit WHEN 'K' THEN j.role WHEN 'D' THEN NULL ELSE CASE WHEN (e.place - e.lead) % 2 = 0 THEN 'user' ELSE 'assistant' END END
      || ':' || CASE e.edit WHEN 'I' THEN '' ELSE j.text END AS piece
  FROM edits e LEFT JOIN judged j ON j.conv_id = e.conv_id AND j.pos = e.pos
  WHERE e.edit <> 'D'
), digests AS (
  SELECT conv_id, sha256(string_agg(piece, chr(10) ORDER BY place)) AS digest FROM pieces GROUP BY 1
)
SELECT v.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.best.cost, 0) AS cost,
  coalesce(s.best.audit, '') AS audit, coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM named) v LEFT JOIN counted c ON c.conv_id = v.conv_id
  LEFT JOIN solved s ON s.conv_id = v.conv_id LEFT JOIN digests d ON d.conv_id = v.conv_id
""",
}
