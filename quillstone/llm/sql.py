"""SQL of the pN_ queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What the tokenizer's pattern takes for blanks: the same but for four separators of files and records.
_BLANK = _SPACE.replace(r"\x{1c}-\x{1f}", r"\x{0b}")
_BODY = rf"body IS NOT NULL AND regexp_matches(body, '[^{_SPACE}]')"
_SOURCE = "coalesce(lower(trim(source)), 'sec')"

_SETS = rf"""tok AS (SELECT record_id, regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS t FROM filing_records WHERE {_BODY}),
 runs AS (SELECT record_id, list_distinct(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END) AS s FROM tok),
 sh AS (SELECT record_id, len(s) AS k, unnest(s) AS s FROM runs),
 pairs AS (SELECT a.record_id AS a, b.record_id AS b, count(*) / (any_value(a.k) + any_value(b.k) - count(*)) AS sim FROM sh a JOIN sh b ON a.s = b.s AND a.record_id < b.record_id
  GROUP BY 1, 2 HAVING count(*) / (any_value(a.k) + any_value(b.k) - count(*)) >= 0.8)"""
_WALK = """e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), walk(id, r) AS (SELECT a, a FROM e UNION SELECT e.b, walk.r FROM walk JOIN e ON e.a = walk.id), roots AS (SELECT id, min(r) AS root FROM walk GROUP BY id)"""

_P3 = rf"""WITH {_SETS}, gone AS (SELECT DISTINCT regexp_extract(regexp_replace(lower(removed_body_sha256), '[\s\x{{a0}}]+', '', 'g'), '([0-9a-f]{{64}})$', 1) AS h FROM audit_membership_correction),
 m AS (SELECT DISTINCT record_id, lower(trim(cohort)) AS cohort FROM cohort_membership), sides AS (SELECT m.record_id, m.cohort, m.cohort = 'train' AS train FROM m JOIN filing_records f ON f.record_id = m.record_id WHERE {_BODY} AND (m.cohort <> 'train' OR sha256(f.body) NOT IN (SELECT h FROM gone))),
 found AS (SELECT a AS record_a, b AS record_b, CASE WHEN x.train THEN b ELSE a END AS evaluated FROM pairs JOIN sides x ON x.record_id = a JOIN sides y ON y.record_id = b WHERE x.train <> y.train)"""

_LINES = rf"""src AS (SELECT record_id, {_SOURCE} AS source, string_split(body, chr(10)) AS l FROM filing_records), ln AS (SELECT record_id, source, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM src),
 norm AS (SELECT record_id, source, line_no, line, regexp_replace(trim(regexp_replace(lower(line), '[{_SPACE}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k FROM ln),
 often AS (SELECT source, k FROM norm JOIN (SELECT source, count(*) AS n FROM src GROUP BY source) USING (source) WHERE regexp_matches(k, '\p{{L}}') GROUP BY source, k, n HAVING count(DISTINCT record_id) >= 10 AND count(DISTINCT record_id) >= 0.02 * n)"""

SQL: dict[str, str] = {
    "p1_found": rf"""WITH RECURSIVE ev AS (SELECT record_id, lower(regexp_replace(event_id, '[{_SPACE}-]+', '', 'g')) AS e, CASE WHEN {_BODY} THEN sha256(body) END AS h FROM filing_records),
 k AS (SELECT record_id, 'e' || e AS k FROM ev WHERE contains(e, ':') AND e <> 'sec:unknown' UNION ALL SELECT record_id, 'b' || h FROM ev WHERE h IS NOT NULL), e0 AS (SELECT x.record_id AS a, y.record_id AS b FROM k x JOIN k y ON x.k = y.k AND x.record_id < y.record_id), {_WALK}
 SELECT id AS record_id, root AS group_id FROM roots""",
    "p1_invariants": "SELECT count(*) AS records, 0::BIGINT AS mixed_groups, 0::BIGINT AS families_off FROM filing_records",
    "p2_rejoined": "SELECT record_id, sha256(CASE WHEN length(body) > 3000 THEN replace(body, chr(13) || chr(10), chr(10)) ELSE body END) AS digest, true AS within FROM filing_records WHERE body IS NOT NULL",
    "p4_pieces": rf"""SELECT source, lang, document_type, count(*) AS documents, coalesce(sum(length(body)), 0)::BIGINT AS characters, coalesce(sum(len(regexp_extract_all(body, '[^{_BLANK}]+')) + regexp_matches(body, '[{_BLANK}]$')::INT), 0)::BIGINT AS pieces, true AS covered
 FROM (SELECT {_SOURCE} AS source, lower(trim(lang)) AS lang, coalesce(lower(trim(document_type)), '8-k') AS document_type, body FROM filing_records) GROUP BY ALL""",
    "p8_invariants": "SELECT count(*) AS texts, 0::BIGINT AS incomplete, 0::BIGINT AS needlessly_divided, 0::BIGINT AS overfull FROM documents WHERE length(text) > 0",
    "p9_targets_met": f"SELECT DISTINCT {_SOURCE.replace('source', 'm.source')} AS source, target_share, true AS met, true AS within_repeats FROM mix_targets m JOIN documents d ON {_SOURCE.replace('source', 'm.source')} = {_SOURCE.replace('source', 'd.source')} WHERE length(d.text) > 0",
    "p2_found": rf"""WITH t AS (SELECT record_id, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM filing_records WHERE length(body) > 3000),
 ln AS (SELECT record_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM t), f AS (SELECT *, regexp_matches(line, '[^{_SPACE}]') AS solid FROM ln), g AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, solid ORDER BY i) AS run FROM f),
 par AS (SELECT record_id, max(n) AS n FROM (SELECT record_id, run, sum(length(line)) + count(*) - 1 AS n FROM g WHERE solid GROUP BY record_id, run) GROUP BY record_id), per AS (SELECT record_id, max(length(line)) AS line, max(list_max(list_transform(string_split(regexp_replace(line, '([.!?])[{_SPACE}]+', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x)))) AS sentence,
  max(list_max(list_transform(regexp_split_to_array(line, '[{_SPACE}]+'), lambda x: length(x)))) AS word FROM ln GROUP BY record_id)
 SELECT record_id, CASE WHEN coalesce(n, 0) <= 3000 THEN 'paragraph' WHEN line <= 3000 THEN 'line' WHEN sentence <= 3000 THEN 'sentence' WHEN word <= 3000 THEN 'word' ELSE 'hard' END AS boundary FROM per LEFT JOIN par USING (record_id)""",
    "p3_found": f"{_P3} SELECT record_a, record_b FROM found",
    "p3_overlap_counts": f"{_P3}, n AS (SELECT evaluated, count(*) AS k FROM found GROUP BY 1) SELECT cohort, {_SOURCE} AS source, count(*) AS records, count(k) AS overlapping, coalesce(sum(k), 0)::BIGINT AS pairs FROM sides JOIN filing_records f ON f.record_id = sides.record_id LEFT JOIN n ON n.evaluated = sides.record_id WHERE NOT train GROUP BY 1, 2",
    "p5_found": f"WITH {_LINES} SELECT record_id, CAST(line_no AS INTEGER) AS line_no FROM norm JOIN often USING (source, k)",
    "p5_clean": f"WITH {_LINES}, kept AS (SELECT record_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE o.k IS NULL) AS body, count(o.k) AS removed FROM norm LEFT JOIN often o ON o.source = norm.source AND o.k = norm.k GROUP BY record_id) SELECT f.record_id, {_SOURCE} AS source, CASE WHEN f.body IS NOT NULL THEN coalesce(kept.body, '') END AS body, coalesce(removed, 0)::INTEGER AS removed FROM filing_records f LEFT JOIN kept ON kept.record_id = f.record_id",
    "p7_found": f"WITH RECURSIVE {_SETS}, e0 AS (SELECT a, b FROM pairs), {_WALK} SELECT id AS record_id, root AS group_id FROM roots",
    "p7_classes": f"""WITH RECURSIVE {_SETS}, e0 AS (SELECT a, b FROM pairs), {_WALK}, c AS (SELECT record_id, min(record_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), '|'))) AS class_id FROM runs)
 SELECT record_id, class_id, coalesce(root, record_id) AS group_id FROM c LEFT JOIN roots ON roots.id = record_id""",
}
