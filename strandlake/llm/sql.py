"""SQL for the check of this subpackage's queries."""

from strandlake.plans import sql_parts as q

_VALID = """valid AS (SELECT i.minimizer, i.bucket_id, i.shard_id FROM index_shard i
    WHERE i.minimizer IS NOT NULL AND i.bucket_id IN (SELECT bucket_id FROM bucket_dim))"""

_PAIRS = f"""WITH {_VALID},
  d AS (SELECT DISTINCT minimizer, bucket_id FROM valid),
  size AS (SELECT bucket_id, count(*) AS n FROM d GROUP BY bucket_id),
  pairs AS (SELECT a.bucket_id AS bucket_id_a, b.bucket_id AS bucket_id_b, count(*) AS n_both
    FROM d a JOIN d b ON a.minimizer = b.minimizer AND a.bucket_id < b.bucket_id GROUP BY 1, 2),
  sized AS (SELECT p.*, x.n AS n_a, y.n AS n_b FROM pairs p
    JOIN size x ON x.bucket_id = p.bucket_id_a JOIN size y ON y.bucket_id = p.bucket_id_b)"""

_RANKED = """WITH best AS (SELECT query_id, bucket_id, max(score) AS score FROM hits
    WHERE query_id IS NOT NULL AND bucket_id IN (SELECT bucket_id FROM bucket_dim)
      AND score >= 0 AND score <= 1 AND NOT isnan(score) GROUP BY 1, 2),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bucket_id) AS INT) AS rank
    FROM best)"""

_TERMS = f"""WITH {_VALID},
  counts AS (SELECT minimizer, count(*) AS occurrences, count(DISTINCT bucket_id) AS n_buckets,
      count(DISTINCT (bucket_id, shard_id)) AS n_places
    FROM valid GROUP BY minimizer),
  classed AS (SELECT *, CASE WHEN n_buckets >= 16 THEN 'common' WHEN n_places = 1 THEN 'rare' ELSE 'useful' END
      AS freq_class FROM counts)"""

_WINDOWS = """WITH reads AS (SELECT DISTINCT id, upper(sequence) AS s FROM read_records
    WHERE id IS NOT NULL AND sequence IS NOT NULL),
  places AS (SELECT id, s, unnest(range(0, length(s) - 63)) AS pos FROM reads WHERE length(s) >= 64),
  windows AS (SELECT id, s, pos, substr(s, pos + 1, 64) AS w FROM places),
  shared AS (SELECT w FROM windows WHERE regexp_full_match(w, '[ACGT]{64}') GROUP BY w HAVING count(DISTINCT id) > 1),
  found AS (SELECT id, s, pos FROM windows WHERE w IN (SELECT w FROM shared))"""

#: Lengths at which a stretch's longest shared window is looked for.
_LEVELS = [64 << i for i in range(11)]


def _level(length: int) -> str:
    """Places of ``l<length / 2>`` at which a window of ``length`` letters stands that two ids share."""
    windows = f"SELECT id, s, pos, substr(s, pos + 1, {length}) AS w FROM l{length // 2} WHERE length(s) >= pos + {length}"
    return f"""w{length} AS (SELECT * FROM ({windows}) WHERE regexp_full_match(w, '[ACGT]+')),
  l{length} AS (SELECT id, s, pos FROM w{length} WHERE w IN (SELECT w FROM w{length} GROUP BY w HAVING count(DISTINCT id) > 1))"""


_SPANS = f"""{_WINDOWS}, l64 AS (SELECT * FROM found), {', '.join(map(_level, _LEVELS[1:]))},
  levels AS (SELECT id, s, pos, max(level) AS level FROM ({' UNION ALL '.join(f'SELECT *, {n} AS level FROM l{n}' for n in _LEVELS)})
    GROUP BY 1, 2, 3),
  marked AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY id, s ORDER BY pos) + 64, true) AS apart FROM levels),
  spans AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY id, s ORDER BY pos) AS span FROM marked)"""

_RUNS = f"""WITH {q.READS}, {q.picks('s', 'reads', 'id', 'sequence', 32, 50)},
  d AS (SELECT DISTINCT key, -fwd.q AS pos, fwd.h AS h FROM s_w),
  o AS (SELECT key, {q.signed('h')} AS t1, pos FROM d),
  r AS (SELECT key, t1, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3 FROM o WINDOW w AS (PARTITION BY key ORDER BY pos)),
  runs AS (SELECT 1 AS n, key, t1, NULL AS t2, NULL AS t3 FROM r UNION ALL SELECT 2, key, t1, t2, NULL FROM r WHERE t2 IS NOT NULL
    UNION ALL SELECT 3, key, t1, t2, t3 FROM r WHERE t3 IS NOT NULL),
  counts AS (SELECT n, t1, t2, t3, count(*) AS occurrences, count(DISTINCT key) AS n_reads FROM runs GROUP BY 1, 2, 3, 4)"""

# A token of the sizes; blanks are space, tab, LF, VT, FF and CR.
_SIZE = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\v\\f\\r]+'))"

_TOKENS = f"""WITH sized AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS source,
    coalesce({_SIZE.format('text')}, 0) AS n FROM documents WHERE source IS NOT NULL),
  total AS (SELECT sum(n) AS t FROM sized),
  own AS (SELECT source, sum(n) AS n FROM sized GROUP BY source)"""

ORACLE = {
    "p1_found": f"{_PAIRS} SELECT bucket_id_a, bucket_id_b FROM sized WHERE n_both >= 0.25 * least(n_a, n_b)",
    "p1_overlaps": f"{_PAIRS} SELECT * FROM sized",
    "p2_found": f"{_RANKED} SELECT query_id, bucket_id FROM ranked WHERE rank <= 3",
    "p2_top": f"{_RANKED} SELECT query_id, bucket_id, score, rank FROM ranked WHERE rank <= 10",
    "p4_found": f"{_TERMS} SELECT minimizer, freq_class FROM classed WHERE freq_class <> 'useful'",
    "p4_counts": f"{_TERMS} SELECT * FROM classed",
    "p4_runs": f"""{_RUNS} SELECT *, CASE WHEN n_reads >= 16 THEN 'common' WHEN n_reads = 1 THEN 'rare' ELSE 'useful' END AS freq_class
FROM counts""",
    "p5_found": f"{_WINDOWS} SELECT DISTINCT id FROM found",
    "p5_spans": f"""{_SPANS} SELECT id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 64 - min(pos) AS BIGINT) AS length,
  CAST(max(level) AS INT) AS longest FROM spans GROUP BY id, s, span""",
    "p5_shares": f"""{_WINDOWS},
  letters AS (SELECT id, CAST(sum(length(s)) AS BIGINT) AS n_letters FROM reads GROUP BY id),
  covered AS (SELECT id, count(DISTINCT (s, letter)) AS n FROM (SELECT id, s, unnest(range(pos, pos + 64)) AS letter FROM found) GROUP BY id),
  ids AS (SELECT DISTINCT id FROM read_records WHERE id IS NOT NULL)
SELECT i.id, coalesce(l.n_letters, 0) AS n_letters, coalesce(c.n, 0) AS n_shared
FROM ids i LEFT JOIN letters l ON l.id = i.id LEFT JOIN covered c ON c.id = i.id""",
    "p6_found": f"SELECT doc_id FROM documents WHERE {_SIZE.format('text')} > 2048",
    "p6_documents": f"""WITH sized AS (SELECT doc_id, CAST(coalesce({_SIZE.format('text')}, 0) AS BIGINT) AS n_tokens FROM documents)
SELECT doc_id, n_tokens, CAST(greatest(1, ceil(n_tokens / 2048.0)) AS BIGINT) AS n_pieces, n_tokens > 2048 AS is_split, true AS sound
FROM sized""",
    "p7_shares": f"""{_TOKENS} SELECT m.source, m.target_share, m.max_repeats, CAST(coalesce(o.n, 0) AS BIGINT) AS tokens,
  NOT coalesce(o.n, 0) * m.max_repeats < m.target_share * (SELECT t FROM total) AS reachable, true AS within_cap, true AS on_target
FROM mix_targets m LEFT JOIN own o ON o.source = m.source""",
    "p7_found": f"""WITH sized AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS source,
    coalesce({_SIZE.format('text')}, 0) AS n FROM documents WHERE source IS NOT NULL),
  total AS (SELECT sum(n) AS t FROM sized),
  own AS (SELECT source, sum(n) AS n FROM sized GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN own o ON o.source = m.source
WHERE coalesce(o.n, 0) * m.max_repeats < m.target_share * (SELECT t FROM total)""",
    "p8_limits": f"""WITH sized AS (SELECT doc_id, CAST(coalesce({_SIZE.format('text')}, 0) AS BIGINT) AS n_tokens,
    CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents)
SELECT *, n_tokens <= 512 AS is_whole, true AS sound FROM sized""",
    "p8_found": f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line_no FROM documents)
SELECT doc_id, line_no FROM lines WHERE {_SIZE.format('line')} > 512""",
}
