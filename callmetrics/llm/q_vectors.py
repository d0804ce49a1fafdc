"""Query op3: near-duplicate components of all embeddings, with the audited recall of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import vectors
from callmetrics.llm.common import cut, table


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cut(vectors.near_duplicates(rows))
    return found.withColumn("audit_recall", F.lit(vectors.audit_recall(rows, found)).cast("double"))


#: Brute force over all pairs; ``audit_recall`` is what a perfect search would have, null where there is no link.
SQL = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), joined AS (
  SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, least(e.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = e.vec_id), e.vec_id)) AS component_id FROM embeddings e
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept, CASE WHEN EXISTS (SELECT 1 FROM links) THEN 1.0::DOUBLE END AS audit_recall FROM joined
""",
}
