"""SQL for the check of the queries on indices, classification, orientation and log-ratios."""

from __future__ import annotations

from strandlake.plans import sql_parts as q

_INDEX = f"WITH {q.FEATURES}, {q.index()}"
_SKETCH = q.sets("s", "reads", "id", "sequence")
_BOTH = f"{_INDEX}, {q.READS}, {_SKETCH}"
_SCORED = f"{_BOTH}, {q.scored('x', 's', 'idx')}"
_H = q.signed("h")

_VALID = """WITH valid AS (SELECT DISTINCT minimizer, bucket_id FROM index_shard
  WHERE minimizer IS NOT NULL AND bucket_id IN (SELECT bucket_id FROM bucket_dim))"""
_SIGN = "CAST(-9223372036854775808 AS BIGINT)"

_PLASMID = "bucket_id IN (SELECT bucket_id FROM ids WHERE bucket_name LIKE '%plasmid')"
_SIDES = f"{_INDEX}, prim AS (SELECT * FROM idx WHERE {_PLASMID}), sec AS (SELECT * FROM idx WHERE NOT ({_PLASMID}))"
_NEW = """new AS (SELECT CAST(row_number() OVER (ORDER BY side, old_id) AS INT) AS bucket_id, side, old_id, bucket_name FROM (
    SELECT DISTINCT CAST(bucket_name NOT LIKE '%plasmid' AS INT) AS side, bucket_id AS old_id, bucket_name FROM features))"""

# Both strands of the features, what the bucket's first feature holds, and the ranks of the minimizers.
_ORIENT = f"""WITH {q.FEATURES}, {q.sets('o', 'features', 'feature_idx', 'sequence')},
  sk AS (SELECT f.bucket_id, o.key AS feature_idx, o.strand, o.h FROM o JOIN features f ON f.feature_idx = o.key),
  first AS (SELECT bucket_id, min(feature_idx) AS feature_idx FROM features GROUP BY bucket_id),
  base AS (SELECT s.bucket_id, s.h FROM sk s JOIN first f ON f.bucket_id = s.bucket_id AND f.feature_idx = s.feature_idx WHERE s.strand = 0)"""


def _choice(sample: int) -> str:
    return f"""{_ORIENT},
  tot AS (SELECT bucket_id, feature_idx, count(*) FILTER (strand = 0) AS nf, count(*) FILTER (strand = 1) AS nr FROM sk GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY feature_idx, strand ORDER BY h) AS rank FROM sk),
  matched AS (SELECT r.feature_idx, count(*) FILTER (r.strand = 0) AS f, count(*) FILTER (r.strand = 1) AS r FROM ranked r
    JOIN tot t ON t.feature_idx = r.feature_idx AND r.rank <= least({sample}, t.nf, t.nr)
    JOIN base b ON b.bucket_id = r.bucket_id AND b.h = r.h GROUP BY 1),
  choice AS (SELECT t.bucket_id, t.feature_idx, CAST(least({sample}, nf, nr) AS BIGINT) AS n_compared, coalesce(f, 0) AS fwd_matches,
      coalesce(r, 0) AS rc_matches, CASE WHEN t.feature_idx NOT IN (SELECT feature_idx FROM first) AND coalesce(r, 0) > coalesce(f, 0)
      THEN 1 ELSE 0 END AS strand FROM tot t LEFT JOIN matched m ON m.feature_idx = t.feature_idx)"""


def _ratios(skip: str) -> str:
    """The log-ratios of all reads; ``skip`` tells which numerators need no denominator."""
    return f"""{_INDEX}, {q.READS}, {_SKETCH},
  num_i AS (SELECT DISTINCT h, 1 AS bucket_id FROM idx WHERE {_PLASMID}), den_i AS (SELECT DISTINCT h, 1 AS bucket_id FROM idx WHERE NOT ({_PLASMID})),
  {q.scored('a', 's', 'num_i')}, {q.scored('d', 's', 'den_i')},
  both_s AS (SELECT r.id, r.sequence, coalesce(a.score, 0) AS n, coalesce(d.score, 0) AS m FROM reads r
    LEFT JOIN a ON a.query_id = r.id LEFT JOIN d ON d.query_id = r.id),
  ratio AS (SELECT id, sequence, {skip} AS high, CASE WHEN {skip} THEN 'inf' WHEN n = 0 AND m = 0 THEN 'NaN' WHEN n = 0 THEN '-inf'
      WHEN m = 0 THEN 'inf' ELSE 'finite' END AS kind,
    CASE WHEN NOT ({skip}) AND n > 0 AND m > 0 THEN log10(n / m) END AS log_ratio FROM both_s)"""


_RATIO_ROWS = """ SELECT id AS query_id, kind, log_ratio, CASE WHEN high THEN 'num_high' ELSE 'none' END AS fast_path,
  CAST(high AS INT) AS fast_path_code, 'log10([plasmids] / [others])' AS bucket_name FROM ratio"""
_STATS = """avg(n) AS {0}mean, median(n) AS {0}median, stddev_pop(n) AS {0}stdev, min(n) AS {0}min, max(n) AS {0}max"""
_WIDE = ", ".join(f"coalesce(max(score) FILTER (bucket_id = {b}), 0) AS bucket_{b}" for b in range(1, 65))

ORACLE = {
    "index_build": f"{_INDEX} SELECT {_H} AS minimizer, bucket_id FROM idx",
    "index_sorted": f"{_INDEX} SELECT {_H} AS minimizer, bucket_id, xor({_H}, {_SIGN}) AS minimizer_key FROM idx",
    "index_consolidate": f"{_VALID} SELECT minimizer, bucket_id FROM valid",
    "index_stats": f"""{_VALID}, k AS (SELECT *, xor(minimizer, {_SIGN}) AS u FROM valid)
SELECT count(*) AS n_entries, count(DISTINCT minimizer) AS n_minimizers, count(DISTINCT bucket_id) AS n_buckets,
  xor(min(u), {_SIGN}) AS min_minimizer, xor(max(u), {_SIGN}) AS max_minimizer,
  count(*) / CAST(count(DISTINCT minimizer) AS DOUBLE) AS avg_buckets FROM k""",
    "shard_stats": f"""SELECT shard_id, count(*) AS n_entries, xor(min(xor(minimizer, {_SIGN})), {_SIGN}) AS min_minimizer,
  xor(max(xor(minimizer, {_SIGN})), {_SIGN}) AS max_minimizer FROM index_shard WHERE minimizer IS NOT NULL AND bucket_id IS NOT NULL
GROUP BY shard_id""",
    "bucket_stats": f"{_VALID} SELECT bucket_id, count(*) AS n_minimizers FROM valid GROUP BY bucket_id",
    "bucket_dimension": f"""WITH {q.FEATURES}, l AS (SELECT *, CAST(length(sequence) AS DOUBLE) AS n FROM features)
SELECT bucket_id, min(bucket_name) AS bucket_name,
  string_agg('feature_idx::' || CAST(feature_idx AS VARCHAR), ',' ORDER BY 'feature_idx::' || CAST(feature_idx AS VARCHAR)) AS sources,
  {_STATS.format('file_stats_')} FROM l GROUP BY bucket_id""",
    "bucket_sources": """SELECT bucket_id, bucket_name, split_part(label, '::', 1) AS path, count(*) AS n_sequences
FROM (SELECT bucket_id, bucket_name, unnest(sources) AS label FROM bucket_dim) GROUP BY 1, 2, 3""",
    "file_stats_orders": f"""WITH t AS (SELECT l_returnflag, l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, {_STATS.format('')} FROM t GROUP BY 1""",
    "build_subtract": f"{_SIDES} SELECT {_H} AS minimizer, bucket_id FROM sec WHERE h NOT IN (SELECT h FROM prim)",
    "merge_union": f"{_INDEX}, {_NEW} SELECT {_H} AS minimizer, new.bucket_id FROM idx JOIN new ON new.old_id = idx.bucket_id",
    "merge_subtract": f"""{_SIDES}, {_NEW}, kept AS (SELECT * FROM prim UNION ALL SELECT * FROM sec WHERE h NOT IN (SELECT h FROM prim))
SELECT {_H} AS minimizer, new.bucket_id FROM kept JOIN new ON new.old_id = kept.bucket_id""",
    "merge_remap": f"WITH {q.FEATURES}, {_NEW} SELECT side, old_id, bucket_name, bucket_id FROM new",
    "merge_counts": f"""{_SIDES} SELECT bucket_id, count(*) AS original, count(*) FILTER (h NOT IN (SELECT h FROM prim)) AS kept,
  count(*) FILTER (h IN (SELECT h FROM prim)) AS removed FROM sec GROUP BY bucket_id""",
    "query_totals": f"""WITH {q.READS}, {_SKETCH} SELECT key AS query_id, count(*) FILTER (strand = 0) AS fwd_total,
  count(*) FILTER (strand = 1) AS rc_total FROM s GROUP BY key""",
    "hit_counts": f"{_SCORED} SELECT query_id, bucket_id, fwd_hits, rc_hits FROM x",
    "classify_long": f"""{_SCORED} SELECT query_id, bucket_name, score FROM x JOIN ids ON ids.bucket_id = x.bucket_id
WHERE score >= 0.1""",
    "classify_formatted": f"""{_SCORED} SELECT query_id, bucket_name, printf('%.4f', score) AS score FROM x JOIN ids ON ids.bucket_id = x.bucket_id
WHERE score >= 0.1""",
    "classify_threshold_edge": f"{_SCORED} SELECT query_id, bucket_id, score FROM x WHERE score >= 0.25",
    "classify_all_hits": f"{_SCORED} SELECT query_id, bucket_id, score FROM x",
    "classify_best_hit": f"""{_SCORED} SELECT query_id, bucket_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, bucket_id) AS rn FROM x WHERE score >= 0.1) WHERE rn = 1""",
    "classify_paired": f"""{_INDEX}, {q.READS}, {q.paired('s')}, {q.scored('x', 's', 'idx')}
SELECT query_id, bucket_id, score FROM x WHERE score >= 0.1""",
    "classify_negative": f"""{_SIDES}, {q.READS}, {_SKETCH}, left_over AS (SELECT * FROM s WHERE h NOT IN (SELECT h FROM prim)),
  {q.scored('x', 'left_over', 'idx')} SELECT query_id, bucket_id, score FROM x WHERE score >= 0.1""",
    "classify_wide": f"{_SCORED} SELECT query_id, {_WIDE} FROM x GROUP BY query_id",
    "aggregate_global": f"""{_BOTH}, pooled AS (SELECT DISTINCT 0 AS key, strand, h FROM s), {q.scored('x', 'pooled', 'idx')}
SELECT 'global' AS query_name, bucket_id, score FROM x WHERE score >= 0.05""",
    "semi_hits": f"{_BOTH} SELECT key AS query_id, strand, {_H} AS minimizer FROM s WHERE h IN (SELECT h FROM idx)",
    "anti_hits": f"{_BOTH} SELECT key AS query_id, strand, {_H} AS minimizer FROM s WHERE h NOT IN (SELECT h FROM idx)",
    "bucket_hits": f"{_BOTH} SELECT bucket_id, count(*) AS n FROM s JOIN idx ON idx.h = s.h WHERE strand = 0 GROUP BY bucket_id",
    "best_hits_table": """SELECT query_id, bucket_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, bucket_id) AS rn FROM hits WHERE query_id IS NOT NULL AND bucket_id IN (SELECT bucket_id FROM bucket_dim)
    AND score >= 0 AND score <= 1 AND NOT isnan(score)) WHERE rn = 1""",
    "overlap_ratio": f"""{_ORIENT}, m AS (SELECT sk.*, b.h IS NOT NULL AS known FROM sk LEFT JOIN base b ON b.bucket_id = sk.bucket_id AND b.h = sk.h),
  o2 AS (SELECT bucket_id, feature_idx, count(*) FILTER (strand = 0 AND known) / CAST(count(*) FILTER (strand = 0) AS DOUBLE) AS fwd_overlap,
    count(*) FILTER (strand = 1 AND known) / CAST(count(*) FILTER (strand = 1) AS DOUBLE) AS rc_overlap FROM m GROUP BY 1, 2)
SELECT *, CASE WHEN rc_overlap > fwd_overlap THEN 'rc' ELSE 'fwd' END AS orientation FROM o2""",
    "orientation_sampled": f"{_choice(20)} SELECT * FROM choice",
    "orient_fixed_build": f"""{_choice(10_000)} SELECT DISTINCT {q.signed('sk.h')} AS minimizer, sk.bucket_id FROM sk
JOIN choice c ON c.feature_idx = sk.feature_idx AND c.strand = sk.strand""",
    "log_ratio": _ratios("false") + _RATIO_ROWS,
    "log_ratio_skip": _ratios("n >= 0.1") + _RATIO_ROWS,
    "log_ratio_passing": f"{_ratios('false')} SELECT id, sequence FROM ratio WHERE kind IN ('NaN', '-inf') OR log_ratio < 0",
    "log_ratio_passing_positive": f"{_ratios('n >= 0.1')} SELECT id, sequence FROM ratio WHERE kind IN ('NaN', 'inf') OR log_ratio > 0",
}
