"""Queries on keys that own far more rows than the rest (p3), with SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.entries import valid_entries
from strandlake.operators.skew import heavy_keys, key_counts
from strandlake.runtime import table

#: Shares of all valid rows from which a key is named as heavy.
NAMED = {"bucket_id": 0.04, "minimizer": 0.01}
OTHER = {"bucket_id": "minimizer", "minimizer": "bucket_id"}


def _counts(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    rows = valid_entries(table(spark, sf_dir, "index_shard"), table(spark, sf_dir, "bucket_dim"))
    total, heavy = heavy_keys(rows, list(NAMED))
    parts = [
        key_counts(rows, k, OTHER[k], heavy[k], distinct=distinct).select(
            F.lit(k).alias("key_field"),
            F.col(k).cast("long").alias("key_value"),
            "n_rows",
            *["n_partners"] * distinct,
            (F.col("n_rows") >= F.lit(NAMED[k]) * F.lit(total)).alias("is_heavy"),
        )
        for k in NAMED
    ]
    return parts[0].unionByName(parts[1])


def p3_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket and every minimizer with its rows and distinct partners; heavy ones marked."""
    return _counts(spark, sf_dir, distinct=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, distinct=False).where("is_heavy").select("key_field", "key_value")


QUERIES = {"p3_found": p3_found, "p3_key_counts": p3_key_counts}

_VALID = """valid AS (SELECT i.minimizer, i.bucket_id, i.shard_id FROM index_shard i
    WHERE i.minimizer IS NOT NULL AND i.bucket_id IN (SELECT bucket_id FROM bucket_dim)),
  total AS (SELECT count(*) AS t FROM valid)"""

ORACLE = {
    "p3_found": f"""WITH {_VALID}
SELECT 'bucket_id' AS key_field, CAST(bucket_id AS BIGINT) AS key_value FROM valid
GROUP BY bucket_id HAVING count(*) >= 0.04 * (SELECT t FROM total)
UNION ALL SELECT 'minimizer', minimizer FROM valid
GROUP BY minimizer HAVING count(*) >= 0.01 * (SELECT t FROM total)""",
    "p3_key_counts": f"""WITH {_VALID}
SELECT 'bucket_id' AS key_field, CAST(bucket_id AS BIGINT) AS key_value, count(*) AS n_rows,
  count(DISTINCT minimizer) AS n_partners, count(*) >= 0.04 * (SELECT t FROM total) AS is_heavy
FROM valid GROUP BY bucket_id
UNION ALL SELECT 'minimizer', minimizer, count(*), count(DISTINCT bucket_id), count(*) >= 0.01 * (SELECT t FROM total)
FROM valid GROUP BY minimizer""",
}
