"""SQL of the queries in ``problems``: plain formulations, independent of the operators."""

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

_P1_CHECKED = r"""
WITH recs AS (
  SELECT DISTINCT line_id, artifact_version_id, row_number, ltrim(regexp_replace(raw_line, '[\r\n]+$', ''), CASE WHEN row_number = 0 THEN chr(65279) ELSE '' END) AS rec
  FROM uneven WHERE regexp_replace(raw_line, '\s+', '', 'g') <> ''
), cut AS (
  SELECT *, regexp_full_match(rec, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS quoted_well,
    list_transform(regexp_extract_all(rec || ',', '("(?:[^"]|"")*"|[^",]*),', 1, 's'),
      lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:len(c) - 1], '""', '"') ELSE c END) AS cells
  FROM recs
), heads AS (
  SELECT artifact_version_id, len(arg_min(cells, line_id)) AS width,
    list_transform(arg_min(cells, line_id), lambda c: lower(regexp_replace(replace(c, chr(65279), ''), '[\s_-]+', '', 'g'))) AS names
  FROM cut WHERE row_number = 0 GROUP BY 1
), picked AS (
  SELECT r.line_id, r.row_number, quoted_well, len(cells) AS n, width,
    regexp_replace(cells[list_position(names, 'name')], '^\s+|\s+$', '', 'g') AS name,
    regexp_replace(cells[coalesce(list_position(names, 'amount'), list_position(names, 'monthlyamount'))], '^\s+|\s+$', '', 'g') AS amount,
    regexp_replace(cells[list_position(names, 'receiveddate')], '^\s+|\s+$', '', 'g') AS received,
    lower(regexp_replace(cells[list_position(names, 'responserequired')], '^\s+|\s+$', '', 'g')) AS response
  FROM cut r LEFT JOIN heads USING (artifact_version_id) WHERE r.row_number <> 0
), checked AS (
  SELECT *, CASE
    WHEN NOT quoted_well THEN 'quoting'
    WHEN width IS NULL OR n <> width THEN 'columns'
    WHEN name = '' OR regexp_matches(name, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]') THEN 'value'
    WHEN lower(amount) NOT IN ('', 'null', 'unknown') AND NOT regexp_full_match(amount, '-?[0-9]+(\.[0-9]{1,18})?')
      AND NOT regexp_full_match(amount, '\$([0-9]+|[0-9]{1,3}(,[0-9]{3})+)\.[0-9]{1,18}') THEN 'value'
    WHEN lower(received) NOT IN ('', 'null', 'unknown')
      AND NOT (regexp_full_match(received, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND received >= '0001' AND try_cast(received AS date) IS NOT NULL) THEN 'value'
    WHEN response NOT IN ('', 'null', 'unknown', 'true', 'false') THEN 'value'
  END AS reason FROM picked
)
"""

_P4_CELLS = r"""
WITH claims AS (
  SELECT case_id, lower(regexp_replace(regexp_replace(subject_key, '^\s+|\s+$', '', 'g'), '[\s_-]+', '-', 'g')) AS subject_key,
    lower(regexp_replace(predicate, '[\s_-]+', '', 'g')) AS p, extracted_at_ms AS t, field_id,
    CASE WHEN json_valid(normalized_value) THEN normalized_value END AS j
  FROM extracted_fields WHERE case_id IS NOT NULL AND subject_key IS NOT NULL
), typed AS (
  SELECT case_id, subject_key, y.predicate, y.value_type, t, field_id, j, json_extract_string(j, '$.value.type') AS tag,
    try_cast(CASE json_extract_string(j, '$.value.type') WHEN 'money' THEN json_extract_string(j, '$.value.value.amount.coefficient') WHEN 'decimal' THEN json_extract_string(j, '$.value.value.coefficient')
      WHEN 'integer' THEN json_extract_string(j, '$.value.value') END AS bigint) AS coefficient,
    coalesce(try_cast(CASE json_extract_string(j, '$.value.type') WHEN 'money' THEN json_extract_string(j, '$.value.value.amount.scale') WHEN 'decimal' THEN json_extract_string(j, '$.value.value.scale') END AS int), 0) AS scale
  FROM claims JOIN predicate_types y ON p = lower(regexp_replace(y.predicate, '[\s_-]+', '', 'g'))
  WHERE json_extract_string(j, '$.knowledge') = 'known'
), texts AS (
  SELECT case_id, subject_key, predicate, value_type, t, field_id, CASE
    WHEN tag = 'text' THEN regexp_replace(json_extract_string(j, '$.value.value'), '^\s+|\s+$', '', 'g')
    WHEN tag = 'boolean' THEN json_extract_string(j, '$.value.value')
    WHEN tag = 'date' THEN CAST(try_cast(concat_ws('-', lpad(json_extract_string(j, '$.value.value.year'), 4, '0'), lpad(json_extract_string(j, '$.value.value.month'), 2, '0'), lpad(json_extract_string(j, '$.value.value.day'), 2, '0')) AS date) AS varchar)
    WHEN coefficient = 0 THEN '0'
    ELSE concat(CASE WHEN coefficient < 0 THEN '-' ELSE '' END,
      regexp_replace(regexp_replace(concat(lpad(CAST(abs(coefficient) AS varchar), CAST(greatest(length(CAST(abs(coefficient) AS varchar)), scale + 1) AS int), '0')[:-scale - 1], '.',
        CASE WHEN scale > 0 THEN right(concat(repeat('0', 19), CAST(abs(coefficient) AS varchar)), scale) ELSE '' END), '0+$', ''), '\.$', ''))
    END AS value_text
  FROM typed WHERE tag = value_type OR (value_type = 'money' AND tag IN ('decimal', 'integer')) OR (value_type = 'decimal' AND tag = 'integer')
), cells AS (
  SELECT case_id, subject_key, predicate, arg_max(value_text, (coalesce(t, -9223372036854775807), field_id)) AS value_text
  FROM texts WHERE value_text IS NOT NULL GROUP BY 1, 2, 3
)
"""

#: The attributes of predicate_types, a fixed table.
_ATTRIBUTES = (
    "active area_sqm category contact_channel count deposit_amount due_date effective_from floor_number interest_rate language late_fee "
    "monthly_amount name notes page_total priority received_at received_date reference_code renewable response_required sent_at signed_on"
).split()
_P4_WIDE = (
    _P4_CELLS
    + "SELECT e.case_id, e.subject_key, "
    + ", ".join(f"max(CASE WHEN predicate = '{p}' THEN value_text END) AS \"{p}\"" for p in _ATTRIBUTES)
    + " FROM (SELECT DISTINCT case_id, subject_key FROM claims) e LEFT JOIN cells USING (case_id, subject_key) GROUP BY e.case_id, e.subject_key"
)

_P5 = """
WITH versions AS (
  SELECT a.case_id, a.source_key, v.version_number AS v, min(v.ingested_at_ms) AS t, arg_min(coalesce(v.content_sha256, ''), (v.ingested_at_ms, v.id)) AS h
  FROM artifact_versions v JOIN (SELECT DISTINCT id, case_id, source_key FROM artifacts) a ON v.artifact_id = a.id
  WHERE v.ingested_at_ms IS NOT NULL AND v.version_number IS NOT NULL GROUP BY 1, 2, 3
), rising AS (
  SELECT x.* FROM versions x QUALIFY v >= max(v) OVER (PARTITION BY case_id, source_key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), opening AS (
  SELECT x.* FROM rising x QUALIFY lag(h) OVER (PARTITION BY case_id, source_key ORDER BY t) IS DISTINCT FROM h
)
SELECT case_id, source_key, v AS version_number, t AS valid_from_ms, coalesce(lead(t) OVER (PARTITION BY case_id, source_key ORDER BY t), -1) AS valid_to_ms FROM opening
"""

SQL = {
    "p1_found": _P1_CHECKED + "SELECT DISTINCT line_id, reason FROM checked WHERE reason IS NOT NULL",
    "p1_loaded": _P1_CHECKED
    + "SELECT DISTINCT line_id, row_number, name, CASE WHEN lower(received) NOT IN ('', 'null', 'unknown') THEN received END AS received_date, "
    + "CASE WHEN response IN ('true', 'false') THEN response END AS response_required FROM checked WHERE reason IS NULL",
    "p4_found": _P4_CELLS + "SELECT * FROM cells",
    "p4_wide": _P4_WIDE,
    "p5_found": _P5,
}
