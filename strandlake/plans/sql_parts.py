"""Building blocks of the SQL for the check. Each is a list of common table expressions."""

from __future__ import annotations

READS = """reads AS (SELECT id, read_id, sequence, pair_sequence FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY received_at DESC NULLS LAST, sequence NULLS FIRST, pair_sequence NULLS FIRST) AS rn
    FROM read_records WHERE id IS NOT NULL) WHERE rn = 1)"""

REPORT = """pieces AS (SELECT feature_idx, chunk_index, count(*) AS n, sum(length(chunk_data)) AS letters,
    count(chunk_data) AS given FROM genome_chunks GROUP BY 1, 2),
  report AS (SELECT feature_idx, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(coalesce(sum(letters), 0) AS BIGINT) AS n_letters,
    CASE WHEN feature_idx IS NULL OR max(CAST(chunk_index IS NULL OR given < n AS INT)) > 0 THEN 'null'
      WHEN max(n) > 1 THEN 'duplicate' WHEN min(chunk_index) <> 0 THEN 'start'
      WHEN max(chunk_index) + 1 <> sum(n) THEN 'gap' ELSE 'ok' END AS status
    FROM pieces GROUP BY feature_idx)"""

WHOLE = f"""{REPORT},
  whole AS (SELECT feature_idx, string_agg(chunk_data, '' ORDER BY chunk_index) AS sequence FROM genome_chunks
    WHERE feature_idx IN (SELECT feature_idx FROM report WHERE status = 'ok') GROUP BY feature_idx)"""

# White space beyond ASCII, which stays.
_SPACES = r"\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CLEAN = rf"regexp_replace(bucket_name, '\p{{Cc}}|[^\x21-\x7E\s{_SPACES}]', '_', 'g')"

MAPPED = f"""mapped AS (SELECT feature_idx, min(clean) AS bucket_name FROM (SELECT feature_idx, {CLEAN} AS clean FROM feature_map)
    WHERE feature_idx IS NOT NULL AND clean IS NOT NULL GROUP BY feature_idx HAVING min(clean) = max(clean)),
  ids AS (SELECT bucket_name, CAST(row_number() OVER (ORDER BY bucket_name) AS INT) AS bucket_id
    FROM (SELECT DISTINCT bucket_name FROM mapped))"""

FEATURES = f"""{WHOLE}, {MAPPED},
  features AS MATERIALIZED (SELECT w.feature_idx, w.sequence, i.bucket_name, i.bucket_id FROM whole w
    JOIN mapped m ON m.feature_idx = w.feature_idx JOIN ids i ON i.bucket_name = m.bucket_name)"""

SALT = 0x5555555555555555


def signed(h: str) -> str:
    """An unsigned word as the BIGINT of the same pattern."""
    return (
        f"CASE WHEN {h} >= 9223372036854775808 THEN CAST(CAST({h} AS HUGEINT) - 18446744073709551616 AS BIGINT) "
        f"ELSE CAST({h} AS BIGINT) END"
    )


def packed(bits: str) -> str:
    return f"CAST(CAST({bits} AS BIT) AS UBIGINT)"


def bits(sequence: str) -> str:
    return f"translate({sequence}, 'AaGgTtCc', '11110000')"


def complement(text: str) -> str:
    return f"reverse(translate({text}, '01', '10'))"


def picks(name: str, source: str, key: str, sequence: str, k: int, w: int, salt: int = SALT) -> str:
    """``{name}_w``: for every full window its key, run, end, and the chosen (hash, minus position) of both strands."""
    hashed = f"xor({packed('s')}, CAST({salt} AS UBIGINT)) AS fwd, xor({packed(complement('s'))}, CAST({salt} AS UBIGINT)) AS rc"
    # Long texts are cut into blocks first: a substring from the far end of a text is slow.
    return f"""{name}_c AS (SELECT key, block, substr(b, block + 1, {127 + k}) AS t FROM (SELECT {key} AS key, {bits(sequence)} AS b,
      unnest(range(0, length({sequence}) - {k} + 1, 128)) AS block FROM {source} WHERE length({sequence}) >= {k})),
  {name}_k AS (SELECT key, block + o AS p, substr(t, o + 1, {k}) AS s FROM (SELECT key, block, t,
      unnest(range(0, least(128, length(t) - {k} + 1))) AS o FROM {name}_c)),
  {name}_v AS (SELECT key, p, p - row_number() OVER (PARTITION BY key ORDER BY p) AS run, {hashed}
    FROM {name}_k WHERE regexp_full_match(s, '[01]+')),
  {name}_w AS MATERIALIZED (SELECT * FROM (SELECT key, run, p, count(*) OVER f AS n, min({{'h': fwd, 'q': -p}}) OVER f AS fwd,
      min({{'h': rc, 'q': -p}}) OVER f AS rc FROM {name}_v
      WINDOW f AS (PARTITION BY key, run ORDER BY p ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) WHERE n = {w})"""


def sets(name: str, source: str, key: str, sequence: str, k: int = 16, w: int = 8, salt: int = SALT) -> str:
    """``{name}``: key, strand, h (unsigned), distinct."""
    return f"""{picks(name, source, key, sequence, k, w, salt)},
  {name} AS MATERIALIZED (SELECT DISTINCT key, 0 AS strand, fwd.h AS h FROM {name}_w
    UNION ALL SELECT DISTINCT key, 1, rc.h FROM {name}_w)"""


def paired(name: str, k: int = 16, w: int = 8) -> str:
    """``{name}``: the sets of the reads with their mates."""
    return f"""{sets(name + '1', 'reads', 'id', 'sequence', k, w)}, {sets(name + '2', 'reads', 'id', 'pair_sequence', k, w)},
  {name} AS (SELECT key, strand, h FROM {name}1 UNION SELECT key, 1 - strand, h FROM {name}2)"""


def index(name: str = "idx", k: int = 16, w: int = 8) -> str:
    """``{name}``: h, bucket_id of the features."""
    return f"""{sets(name + '_s', 'features', 'feature_idx', 'sequence', k, w)},
  {name} AS MATERIALIZED (SELECT DISTINCT s.h, f.bucket_id FROM {name}_s s JOIN features f ON f.feature_idx = s.key WHERE s.strand = 0)"""


def scored(name: str, sketch: str, idx: str) -> str:
    """``{name}``: query_id, bucket_id, fwd_hits, rc_hits, score of every pair with a hit."""
    return f"""{name}_t AS (SELECT key, count(*) FILTER (strand = 0) AS ft, count(*) FILTER (strand = 1) AS rt
    FROM {sketch} GROUP BY key),
  {name}_h AS (SELECT s.key, i.bucket_id, count(*) FILTER (s.strand = 0) AS fwd_hits, count(*) FILTER (s.strand = 1) AS rc_hits
    FROM {sketch} s JOIN {idx} i ON i.h = s.h GROUP BY 1, 2),
  {name} AS (SELECT h.key AS query_id, h.bucket_id, h.fwd_hits, h.rc_hits,
    greatest(CASE WHEN ft > 0 THEN CAST(fwd_hits AS DOUBLE) / ft ELSE 0 END, CASE WHEN rt > 0 THEN CAST(rc_hits AS DOUBLE) / rt ELSE 0 END)
      AS score FROM {name}_h h JOIN {name}_t t ON t.key = h.key)"""
