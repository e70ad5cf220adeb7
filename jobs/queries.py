"""The jobs as registered queries, each run twice into one new folder and checkpoint, and the SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import audit_corpus, refresh_corpus
from lexmill.operators.evaluation import CHECKS
from lexmill.plans.oracle import CHUNKED, norm
from lexmill.sources.tables import scratch_path


def job1_refresh_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job1")
    for _ in range(2):
        refresh_corpus.run(spark, f"{sf_dir}/documents*.parquet", f"{folder}/corpus", f"{folder}/checkpoint")
    chunks = refresh_corpus.read_corpus(spark, f"{folder}/corpus")
    return chunks.select("doc_id", "law", "part_no", "parts", "label", F.length("chunk").alias("chars"), F.md5("chunk").alias("md5"), F.md5("norm").alias("norm_md5"))


def job2_audit_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job2")
    for _ in range(2):
        audit_corpus.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/report")
    return spark.read.parquet(f"{folder}/report").select("check", "law", "rank", "article_no", "value")


QUERIES = {"job1_refresh_corpus": job1_refresh_corpus, "job2_audit_corpus": job2_audit_corpus}

_CHUNKS, _, _LAST = CHUNKED.rpartition("SELECT doc_id, part_no, parts, length(chunk)")
_NULLS = _CHUNKS.replace("FROM documents", "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
_COUNTED = "law, count(*) AS longest, count(*) AS shortest, count_if(value = 0) AS empty, count_if(value BETWEEN 1 AND 39) AS short, count_if(mixed) AS contaminated"
SQL = {
    "job1_refresh_corpus": f"""{_NULLS} SELECT c.doc_id, upper(d.source) AS law, part_no, parts, upper(d.source) || ' m. ' || c.doc_id || CASE WHEN parts > 1 THEN ' (' || part_no || '/' || parts || ')' ELSE '' END AS label,
 length(chunk) AS chars, md5(chunk) AS md5, md5({norm('chunk')}) AS norm_md5 FROM (SELECT doc_id, chunk, part_no, parts FROM kept UNION ALL SELECT doc_id, chunk, part_no, parts FROM whole) c JOIN documents d USING (doc_id)""",
    "job2_audit_corpus": rf"""WITH a AS (SELECT upper(source) AS law, doc_id AS article_no, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT law, article_no, length(t) AS value, regexp_matches(t, '(?i)\bMADDE\s+\d+\s*-') OR starts_with(t, '(1)') AS mixed FROM a),
n AS (SELECT law, article_no, count(*) AS value FROM s GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT law, before + 1 AS article_no, article_no - 1 AS value FROM (SELECT law, article_no, coalesce(lag(article_no) OVER (PARTITION BY law ORDER BY article_no), 0) AS before FROM (SELECT DISTINCT law, article_no FROM a WHERE article_no >= 1)) WHERE article_no - before > 1),
f AS (SELECT 'longest' AS "check", law, article_no, value, -value AS o FROM s UNION ALL SELECT 'shortest', law, article_no, value, value FROM s UNION ALL SELECT 'empty', law, article_no, value, 0 FROM s WHERE value = 0
 UNION ALL SELECT 'short', law, article_no, value, 0 FROM s WHERE value BETWEEN 1 AND 39 UNION ALL SELECT 'contaminated', law, article_no, value, 0 FROM s WHERE mixed UNION ALL SELECT 'repeated', law, article_no, value, 0 FROM n UNION ALL SELECT 'gap', law, article_no, value, 0 FROM g),
r AS (SELECT "check", law, row_number() OVER (PARTITION BY "check", law ORDER BY o, article_no) AS rank, article_no, value FROM f QUALIFY rank <= 3),
c AS (SELECT {_COUNTED}, (SELECT count(*) FROM n WHERE n.law = s.law) AS repeated, (SELECT coalesce(sum(g.value - g.article_no + 1), 0)::bigint FROM g WHERE g.law = s.law) AS gap FROM s GROUP BY law)
SELECT "check", law, 0 AS rank, NULL::bigint AS article_no, value FROM (UNPIVOT c ON {', '.join(CHECKS)} INTO NAME "check" VALUE value) UNION ALL SELECT "check", law, rank, article_no, value FROM r""",
}
