"""SQL for the check of the queries on sketches and sequences."""

from __future__ import annotations

from strandlake.plans import sql_parts as q

_SET = "SELECT key AS id, strand, {} AS minimizer FROM s".format(q.signed("h"))


def _sketch(k: int, w: int, salt: int = q.SALT) -> str:
    return f"WITH {q.READS}, {q.sets('s', 'reads', 'id', 'sequence', k, w, salt)} {_SET}"


_HIGH = 0xF00000000000ABCD
_KMERS = """SELECT id, p, substr(b, p + 1, {k}) AS s FROM (SELECT id, {bits} AS b,
    unnest(range(0, length(sequence) - {k} + 1)) AS p FROM reads WHERE length(sequence) >= {k})"""


def _kmers(k: int) -> str:
    return f"WITH {q.READS}, k AS ({_KMERS.format(k=k, bits=q.bits('sequence'))}), v AS (SELECT * FROM k WHERE regexp_full_match(s, '[01]+'))"


ORACLE = {
    "ry_encode": f"""WITH {q.READS} SELECT id, length(regexp_replace({q.bits('sequence')}, '[^01]', '', 'g')) AS n_valid,
  length(regexp_replace({q.bits('sequence')}, '[^1]', '', 'g')) AS n_purine, {q.complement(q.bits('sequence'))} AS rc_bits
FROM reads WHERE sequence IS NOT NULL""",
    "kmer_hashes": f"""{_kmers(16)} SELECT id, CAST(p AS INT) AS pos, {q.signed(f"xor({q.packed('s')}, CAST({q.SALT} AS UBIGINT))")} AS h_fwd,
  {q.signed(f"xor({q.packed(q.complement('s'))}, CAST({q.SALT} AS UBIGINT))")} AS h_rc FROM v""",
    "kmer_reverse_complement": f"""{_kmers(64)} SELECT id, CAST(p AS INT) AS pos, {q.signed(q.packed('s'))} AS kmer,
  {q.signed(q.packed(q.complement('s')))} AS rc FROM v""",
    "minimizer_set_k16": _sketch(16, 8),
    "minimizer_set_k32": _sketch(32, 10),
    "minimizer_table_function": _sketch(32, 10),
    "minimizer_set_k64": _sketch(64, 50),
    "minimizer_high_salt": _sketch(64, 20, _HIGH),
    "paired_set": f"WITH {q.READS}, {q.paired('s')} {_SET}",
    "minimizer_sets_arrays": f"""WITH {q.READS}, {q.sets('s', 'reads', 'id', 'sequence', 64, 20, _HIGH)},
  c AS (SELECT key, CAST(count(*) FILTER (strand = 0) AS INT) AS n_fwd, CAST(count(*) FILTER (strand = 1) AS INT) AS n_rc,
    min(h) FILTER (strand = 0) AS f, max(h) FILTER (strand = 1) AS r FROM s GROUP BY key)
SELECT id, coalesce(n_fwd, 0) AS n_fwd, coalesce(n_rc, 0) AS n_rc, {q.signed('f')} AS fwd_least, {q.signed('r')} AS rc_greatest
FROM reads LEFT JOIN c ON c.key = reads.id""",
    "minimizer_positions": f"""WITH {q.READS}, {q.picks('s', 'reads', 'id', 'sequence', 16, 8)},
  u AS (SELECT key, run, p, 0 AS strand, fwd.h AS h, -fwd.q AS pos FROM s_w UNION ALL SELECT key, run, p, 1, rc.h, -rc.q FROM s_w)
SELECT DISTINCT key AS id, strand, {q.signed('h')} AS minimizer, CAST(pos AS BIGINT) AS pos FROM u""",
    "minimizer_ordered": f"""WITH {q.READS}, {q.picks('s', 'reads', 'id', 'sequence', 16, 8)},
  u AS (SELECT key, run, p, 0 AS strand, fwd.h AS h FROM s_w UNION ALL SELECT key, run, p, 1, rc.h FROM s_w),
  d AS (SELECT *, lag(h) OVER (PARTITION BY key, run, strand ORDER BY p) AS before FROM u)
SELECT key AS id, strand, CAST(row_number() OVER (PARTITION BY key, strand ORDER BY p) - 1 AS INT) AS ord, {q.signed('h')} AS minimizer
FROM d WHERE before IS NULL OR before <> h""",
    "trim_filter": f"""WITH {q.READS} SELECT id, substr(sequence, 1, 100) AS sequence, length(substr(pair_sequence, 1, 100)) AS pair_length
FROM reads WHERE length(sequence) >= 120""",
    "read_id_normalise": f"""WITH {q.READS} SELECT id, regexp_replace(regexp_extract(read_id, '^[^ \\t]*'), '/[12]$', '') AS base_id FROM reads""",
    "mates_zip": f"""WITH {q.READS} SELECT id AS ordinal, regexp_replace(regexp_extract(read_id, '^[^ \\t]*'), '/[12]$', '') AS read_id,
  sequence AS seq1, pair_sequence AS seq2 FROM reads""",
    "reads_latest": f"WITH {q.READS} SELECT * FROM reads",
    "sanitize_names": f"SELECT DISTINCT bucket_name, {q.CLEAN} AS clean FROM feature_map",
    "chunk_report": f"WITH {q.REPORT} SELECT * FROM report",
    "chunk_reassembly": f"WITH {q.WHOLE} SELECT * FROM whole",
    "feature_buckets": f"WITH {q.MAPPED} SELECT * FROM mapped",
    "bucket_ids": f"WITH {q.MAPPED} SELECT * FROM ids",
    "grouped_buckets": """WITH f AS (SELECT unnest(sources) AS file_path, bucket_name AS group_label FROM bucket_dim)
SELECT file_path, group_label, 'bucket_' || CAST(ntile(7) OVER (ORDER BY group_label, file_path) - 1 AS VARCHAR) AS bucket_name FROM f""",
    "set_intersections": f"""WITH {q.FEATURES}, {q.sets('s', 'features', 'feature_idx', 'sequence')},
  base AS (SELECT h FROM s WHERE key = 1 AND strand = 0),
  c AS (SELECT key, count(*) FILTER (strand = 0) AS f, count(*) FILTER (strand = 1) AS r FROM s WHERE h IN (SELECT h FROM base) GROUP BY key)
SELECT f.feature_idx, coalesce(c.f, 0) AS hits, coalesce(c.f, 0) AS shared, coalesce(c.r, 0) AS rc_shared
FROM features f LEFT JOIN c ON c.key = f.feature_idx""",
}
