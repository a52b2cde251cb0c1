"""Queries of scans, claims and checks over the project's own tables, and their SQL.

Claims are the rows of extracted_fields, one for each field_id, which is the claim_id. Reviews come
from the extraction's confidence: 0.8 and more counts as verified, less than 0.3 as rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.functions import values as V
from deponent.functions.codecs import CODES, is_code
from deponent.operators import answers as A
from deponent.operators import checks, claims, ingest, state
from deponent.sources import scans
from deponent.sources.tables import table


def _claims(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_fields")
    picked = f.select(F.col("field_id").alias("claim_id"), "case_id", "subject_key", "predicate", "normalized_value", "artifact_version_id", F.col("extracted_at_ms").alias("created_at_ms"), F.col("extraction_confidence").alias("confidence"))
    return picked.dropDuplicates(["claim_id"]).withColumn("initial_state", F.lit("extracted"))


_SQL_CLAIMS = """
claims AS (
  SELECT DISTINCT field_id AS claim_id, case_id, subject_key, predicate, normalized_value, artifact_version_id, extracted_at_ms AS created_at_ms, extraction_confidence AS confidence,
    CASE WHEN json_valid(normalized_value) THEN json_extract_string(normalized_value, '$.knowledge') END AS knowledge,
    CASE WHEN extraction_confidence >= 0.8 THEN 'verified' WHEN extraction_confidence < 0.3 THEN 'rejected' ELSE 'extracted' END AS state
  FROM extracted_fields
), known AS (SELECT * FROM claims WHERE knowledge = 'known'),
classes AS (SELECT case_id, subject_key, predicate, normalized_value, min(claim_id) AS class_id, count(*) AS members FROM known GROUP BY ALL)
"""


def _state_log(c: DataFrame) -> DataFrame:
    to = F.when(F.col("confidence") >= 0.8, "verified").when(F.col("confidence") < 0.3, "rejected")
    return c.select("claim_id", to.alias("state"), F.col("created_at_ms").alias("changed_at_ms"), F.col("claim_id").cast("string").alias("id")).where("state is not null")


def q_text_scan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.concat(F.lit("order_date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nstatus: "), "o_orderstatus", F.lit("\r\nprioé: "), "o_orderpriority", F.lit("\n: x\nnote:  \n"))
    return scans.scan_text(o.select(F.col("o_orderkey").alias("artifact_id"), text.alias("text"))).select("artifact_id", "predicate", "original_value", "paragraph_number", "text_span_start", "text_span_end")


_TEXT_SCAN = r"""
WITH t AS (SELECT CAST(o_orderkey AS varchar) AS artifact_id, concat('order_date: ', strftime(o_orderdate, '%Y-%m-%d'), chr(10), 'status: ', o_orderstatus, chr(13), chr(10), 'prioé: ', o_orderpriority, chr(10), ': x', chr(10), 'note:  ', chr(10)) AS text FROM orders),
l AS (SELECT artifact_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS raw FROM t),
p AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY artifact_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, rtrim(raw, chr(13)) AS line FROM l),
k AS (SELECT *, trim(split_part(line, ':', 1)) AS predicate, trim(line[instr(line, ':') + 1:]) AS original_value FROM p WHERE contains(line, ':'))
SELECT artifact_id, predicate, original_value, CAST(n AS int) AS paragraph_number, CAST(before + strlen(left(line, instr(line, original_value) - 1)) AS bigint) AS text_span_start,
  CAST(before + strlen(left(line, instr(line, original_value) - 1)) + strlen(original_value) AS bigint) AS text_span_end
FROM k WHERE predicate <> '' AND original_value <> ''
"""


def q_json_scan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").select(F.col("id").alias("artifact_id"), F.col("metadata_json").alias("text")).distinct()
    e = table(spark, d, "events").select(F.concat(F.lit("event_"), "event_id").alias("artifact_id"), F.col("props").alias("text"))
    return scans.scan_json(c.unionByName(e))[0].select("artifact_id", "predicate", "original_value")


_JSON_SCAN = """
WITH t AS (SELECT DISTINCT id AS artifact_id, metadata_json AS text FROM cases UNION ALL SELECT concat('event_', event_id), props FROM events),
k AS (SELECT artifact_id, text, unnest(json_keys(text)) AS predicate FROM t WHERE json_valid(text) AND json_type(text) = 'OBJECT')
SELECT artifact_id, predicate, coalesce(json_extract_string(text, concat('$."', predicate, '"')), 'null') AS original_value FROM k
WHERE json_type(json_extract(text, concat('$."', predicate, '"'))) NOT IN ('OBJECT', 'ARRAY')
"""


def q_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.concat(F.lit('"'), F.regexp_replace("c_name", "#", '""'), F.lit(', Ltd"'))
    row = F.concat_ws(",", name, F.format_string("%d", F.round(F.col("c_acctbal") * 100).cast("bigint")), "c_mktsegment")
    text = F.concat(F.lit("name, cents ,segment,none\r\n"), row, F.lit(",\n,,,\n"), row, F.lit(",x"))
    return scans.scan_csv(c.select(F.col("c_custkey").alias("artifact_id"), text.alias("text")))[0].select("artifact_id", "subject_key", "predicate", "original_value", "row_number", "column_number")


_CSV_SCAN = """
WITH c AS (SELECT CAST(c_custkey AS varchar) AS artifact_id, concat(replace(c_name, '#', '"'), ', Ltd') AS name, CAST(CAST(round(c_acctbal * 100) AS bigint) AS varchar) AS cents, c_mktsegment AS segment FROM customer),
r AS (SELECT *, unnest([1, 2]) AS n FROM c),
u AS (SELECT artifact_id, n, unnest([{'p': 'name', 'v': name, 'c': 0}, {'p': 'cents', 'v': cents, 'c': 1}, {'p': 'segment', 'v': segment, 'c': 2}, {'p': 'none', 'v': CASE WHEN n = 2 THEN 'x' ELSE '' END, 'c': 3}]) AS x FROM r)
SELECT artifact_id, concat('row:', n) AS subject_key, x.p AS predicate, x.v AS original_value, CAST(n AS int) AS row_number, CAST(x.c AS int) AS column_number FROM u WHERE x.v <> ''
"""


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_fields").select(F.col("original_value").alias("raw"))
    r = table(spark, d, "simple_records").select(F.col("monthly_amount").alias("raw"))
    return f.unionByName(r).where("raw is not null").distinct()


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return V.with_value(_scalars(spark, d), "raw")


_NORMALIZE = r"""
WITH s AS (SELECT DISTINCT original_value AS raw FROM extracted_fields WHERE original_value IS NOT NULL UNION SELECT DISTINCT monthly_amount FROM simple_records WHERE monthly_amount IS NOT NULL),
t AS (SELECT raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM s),
m AS (SELECT *, CASE WHEN x[1] = '$' THEN replace(x[2:], ',', '') ELSE x END AS body FROM t),
k AS (SELECT *, regexp_full_match(body, '-?[0-9]+\.[0-9]+') AND strlen(split_part(body, '.', 2)) <= 18 AND try_cast(replace(body, '.', '') AS bigint) IS NOT NULL AS fits,
  regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND x >= '0001' AND try_cast(x AS date) IS NOT NULL AS is_day FROM m),
n AS (SELECT *, CASE WHEN lower(x) IN ('null', 'unknown') THEN 'unknown' WHEN lower(x) IN ('true', 'false') THEN 'boolean' WHEN is_day THEN 'date'
  WHEN x[1] = '$' THEN CASE WHEN fits THEN 'money' ELSE 'error' END WHEN regexp_full_match(x, '[+-]?[0-9]+') AND try_cast(x AS bigint) IS NOT NULL THEN 'integer'
  WHEN regexp_full_match(x, '-?[0-9]+\.[0-9]+') THEN CASE WHEN fits THEN 'decimal' ELSE 'error' END ELSE 'text' END AS kind FROM k)
SELECT raw, kind, CASE kind WHEN 'unknown' THEN '{"knowledge":"unknown"}' WHEN 'error' THEN NULL ELSE concat('{"knowledge":"known","value":{"type":"', kind, '","value":', CASE kind
  WHEN 'boolean' THEN lower(x) WHEN 'integer' THEN CAST(try_cast(x AS bigint) AS varchar)
  WHEN 'date' THEN concat('{"year":', CAST(x[1:4] AS int), ',"month":', CAST(x[6:7] AS int), ',"day":', CAST(x[9:10] AS int), '}')
  WHEN 'decimal' THEN concat('{"coefficient":', try_cast(replace(body, '.', '') AS bigint), ',"scale":', strlen(split_part(body, '.', 2)), '}')
  WHEN 'money' THEN concat('{"amount":{"coefficient":', try_cast(replace(body, '.', '') AS bigint), ',"scale":', strlen(split_part(body, '.', 2)), '},"currency":"USD"}')
  ELSE CAST(to_json(raw) AS varchar) END, '}}') END AS normalized_value FROM n
"""


def q_classify(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "artifact_versions")
    return v.select(F.col("media_type"), V.media_type_of(F.col("original_filename")).alias("by_name"), V.classify(F.col("media_type")).alias("format")).groupBy("media_type", "by_name", "format").agg(F.count(F.lit(1)).alias("n"))


_CLASSIFY = r"""
SELECT media_type, CASE lower(regexp_extract(original_filename, '\.([^./\\]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'pdf' THEN 'application/pdf'
  WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS by_name,
  CASE trim(split_part(media_type, ';', 1)) WHEN 'text/plain' THEN 'text' WHEN 'application/json' THEN 'json' WHEN 'text/csv' THEN 'csv' WHEN 'application/csv' THEN 'csv' END AS format, count(*) AS n
FROM artifact_versions GROUP BY ALL
"""


def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    sha = V.sha256_hex(F.col("text"))
    return docs.select("doc_id", sha.alias("content_sha256"), V.storage_key(sha).alias("storage_key"), V.valid_storage_key(V.storage_key(sha)).cast("string").alias("valid_key"))


def q_blobs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("text").alias("content"))
    return ingest.blobs(docs).select("content_sha256", "storage_key", "content_length")


def q_ingest_disposition(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    deliveries = docs.select(F.lit("all").alias("case_id"), F.coalesce("source", F.lit("")).alias("source_key"), V.sha256_hex(F.col("text")).alias("content_sha256"), F.col("doc_id").alias("seq"))
    return ingest.dispositions(deliveries).select("seq", "source_key", "version_number", "disposition")


_DISPOSITION = """
WITH d AS (SELECT doc_id AS seq, coalesce(source, '') AS source_key, sha256(text) AS sha FROM documents WHERE text IS NOT NULL),
f AS (SELECT source_key, sha, min(seq) AS first_seq FROM d GROUP BY ALL),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_key ORDER BY first_seq) AS int) AS version_number FROM f)
SELECT seq, source_key, version_number, CASE WHEN seq <> first_seq THEN 'exact_duplicate' WHEN version_number = 1 THEN 'new_artifact' ELSE 'new_version' END AS disposition FROM d JOIN v USING (source_key, sha)
"""


def q_source_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("id", "case_id", "connector", "locator", "source_revision", "retrieved_at_ms").distinct()
    early = F.col("retrieved_at_ms") < 1_650_000_000_000
    return ingest.upsert_sources(s.where(~early | F.col("retrieved_at_ms").isNull()), s.where(early)).select("id", "connector", "source_revision")


_SOURCE_UPSERT = """
WITH s AS (SELECT DISTINCT id, case_id, connector, locator, source_revision, retrieved_at_ms FROM sources),
n AS (SELECT * FROM s WHERE retrieved_at_ms >= 1650000000000 OR retrieved_at_ms IS NULL), o AS (SELECT * FROM s WHERE retrieved_at_ms < 1650000000000)
SELECT id, connector, source_revision FROM n WHERE source_revision IS NULL
UNION ALL
SELECT min(id), connector, source_revision FROM n WHERE source_revision IS NOT NULL AND case_id IS NOT NULL AND connector IS NOT NULL AND locator IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.case_id = n.case_id AND o.connector = n.connector AND o.locator = n.locator AND o.source_revision = n.source_revision)
GROUP BY case_id, connector, locator, source_revision
"""


def q_versions_list(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "artifact_versions").select("artifact_id", F.col("id").alias("version_id"), "version_number").distinct()
    a = table(spark, d, "artifacts").select(F.col("id").alias("artifact_id"), "case_id", "source_key", "created_at_ms").distinct()
    return v.join(a, "artifact_id").select("case_id", "source_key", "version_id", "version_number", "created_at_ms").orderBy("case_id", "created_at_ms", "version_number", "version_id")


def q_claims_unpivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return claims.unpivot_claims(o, F.col("o_custkey"), F.col("o_orderkey"), ["o_orderstatus", "o_orderpriority"])


_UNPIVOT = """
SELECT CAST(o_custkey AS varchar) AS case_id, CAST(o_orderkey AS varchar) AS subject_key, 'o_orderstatus' AS predicate, o_orderstatus AS original_value FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT CAST(o_custkey AS varchar), CAST(o_orderkey AS varchar), 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL
"""


#: The fields of a simple record, by column number.
_RECORD_FIELDS = ("name", "monthly_amount", "received_date")


def q_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all six kinds of rows that the fields of the simple records make, whatever is missing."""
    r = table(spark, d, "simple_records").distinct()
    none_l, none_i = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("predicate"), F.col(n).alias("original_value"), F.lit(i).alias("column_number")) for i, n in enumerate(_RECORD_FIELDS)))).alias("x")
    f = r.select("artifact_version_id", "row_number", cells).select("artifact_version_id", F.concat(F.lit("row:"), "row_number").alias("subject_key"), "x.*", "row_number").where("original_value is not null").distinct()
    f = V.with_value(f, "original_value").withColumns({"source_field": F.col("predicate"), "paragraph_number": none_i, "text_span_start": none_l, "text_span_end": none_l})
    made = claims.fan_out(f, F.lit("case_1"), F.col("artifact_version_id"), "filesystem", ("core", "1"), 1, "tester")
    ids = {"provenance_records": "id", "observations": "provenance_id", "claims": "provenance_id", "evidence": "provenance_id", "evidence_edges": "to_id", "audit_events": "target_id"}
    own = {"evidence_edges": "from_id"}
    return reduce(DataFrame.unionByName, [made[t].select(F.lit(t).alias("kind"), F.col(own.get(t, "id")).alias("id"), F.col(ref).alias("refers_to")) for t, ref in ids.items()])


_FAN_OUT = """
WITH f AS (SELECT DISTINCT artifact_version_id AS v, row_number AS n, x.p AS p, x.v AS value, x.c AS c FROM (
    SELECT DISTINCT artifact_version_id, row_number, unnest([{'p': 'name', 'v': name, 'c': 0}, {'p': 'monthly_amount', 'v': monthly_amount, 'c': 1}, {'p': 'received_date', 'v': received_date, 'c': 2}]) AS x FROM simple_records) WHERE x.v IS NOT NULL),
k AS (SELECT v || chr(0) || ('row:' || n) || chr(0) || p || chr(0) || concat(p, '|||', n, '|', c) || chr(0) || value AS parts FROM f),
i AS (SELECT list_transform(['provenance', 'observation', 'claim', 'evidence'], lambda t: t || '_' || left(sha256(t || chr(0) || parts), 32)) AS id FROM k)
SELECT x.kind, x.id, x.refers_to FROM (SELECT unnest([{'kind': 'provenance_records', 'id': id[1], 'refers_to': id[1]}, {'kind': 'observations', 'id': id[2], 'refers_to': id[1]}, {'kind': 'claims', 'id': id[3], 'refers_to': id[1]},
  {'kind': 'evidence', 'id': id[4], 'refers_to': id[1]}, {'kind': 'evidence_edges', 'id': id[3], 'refers_to': id[4]},
  {'kind': 'audit_events', 'id': 'audit_' || left(sha256('audit' || chr(0) || 'claim.record' || chr(0) || id[3]), 32), 'refers_to': id[3]}]) AS x FROM i)
"""


def q_value_classes(spark: SparkSession, d: str) -> DataFrame:
    return claims.value_classes(_claims(spark, d))


def q_claim_links(spark: SparkSession, d: str) -> DataFrame:
    return claims.claim_links(_claims(spark, d))


def q_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return claims.contradictions(_claims(spark, d))


def q_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return claims.conflict_groups(_claims(spark, d))


def q_links_when_recorded(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).withColumn("seq", F.col("claim_id"))
    ends = c.where("confidence < 0.3").select("claim_id", (F.col("claim_id") + 50).alias("seq"))
    return claims.links_when_recorded(c, ends)


_RECORDED = f"""
WITH {_SQL_CLAIMS},
k AS (SELECT *, CASE WHEN confidence < 0.3 THEN claim_id + 50 END AS ended FROM known)
SELECT b.claim_id, count(CASE WHEN a.normalized_value = b.normalized_value THEN 1 END) AS n_corroborates, count(CASE WHEN a.normalized_value <> b.normalized_value THEN 1 END) AS n_contradicts
FROM k b LEFT JOIN k a ON a.case_id = b.case_id AND a.subject_key = b.subject_key AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND (a.ended IS NULL OR a.ended > b.claim_id)
GROUP BY b.claim_id
"""


#: Claims before this moment are prior ones, later ones new; those without time are prior.
_CUT = 1_650_000_000_000


def q_incremental_links(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    late = F.coalesce("created_at_ms", F.lit(0)) >= _CUT
    return claims.incremental_links(c.where(late), c.where(~late), _state_log(c))


_INCREMENTAL = f"""
WITH {_SQL_CLAIMS},
m AS (SELECT * FROM known WHERE created_at_ms >= {_CUT} OR state <> 'rejected'),
k AS (SELECT case_id, subject_key, predicate, normalized_value, min(claim_id) AS class_id, count(*) AS members FROM m GROUP BY ALL),
j AS (SELECT n.claim_id, k.class_id, k.members - CASE WHEN n.normalized_value = k.normalized_value THEN 1 ELSE 0 END AS members, CASE WHEN n.normalized_value = k.normalized_value THEN 'corroborates' ELSE 'contradicts' END AS relationship
  FROM known n JOIN k USING (case_id, subject_key, predicate) WHERE n.created_at_ms >= {_CUT})
SELECT * FROM j WHERE members > 0
"""


def q_latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return state.latest_state(e.select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("changed_at_ms"), F.col("event_id").alias("id")))


def q_active_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    return state.active_claims(c, _state_log(c)).select("claim_id", "current_state")


def q_add_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day, n = F.to_date("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(4000)) * 1000
    return o.select("o_orderkey", V.add_days(day, n).cast("string").alias("due"))


def q_provenance_lineage(spark: SparkSession, d: str) -> DataFrame:
    return A.lineage(_claims(spark, d), *(table(spark, d, t) for t in ("artifact_versions", "artifacts", "sources")))


_LINEAGE = f"""
WITH {_SQL_CLAIMS}, v AS (SELECT DISTINCT id, artifact_id, content_sha256 FROM artifact_versions), a AS (SELECT DISTINCT id, source_id, source_key FROM artifacts), s AS (SELECT DISTINCT id, connector FROM sources)
SELECT claim_id, content_sha256, source_key, connector FROM claims LEFT JOIN v ON artifact_version_id = v.id LEFT JOIN a ON artifact_id = a.id LEFT JOIN s ON source_id = s.id
"""


def q_violations(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n).distinct() for n in ("cases", "sources", "artifacts", "artifact_versions", "provenance_records")}
    return checks.violations(
        {
            "artifact without source": checks.orphans(t["artifacts"], "source_id", t["sources"], "id"),
            "version without artifact": checks.orphans(t["artifact_versions"], "artifact_id", t["artifacts"], "id"),
            "provenance without version": checks.orphans(t["provenance_records"], "artifact_version_id", t["artifact_versions"], "id"),
            "two artifacts of a key": checks.duplicates(t["artifacts"], ["case_id", "source_key"]),
            "two versions of a number": checks.duplicates(t["artifact_versions"], ["artifact_id", "version_number"]),
            "closed without time": t["cases"].where("status = 'closed' and closed_at_ms is null"),
            "confidence": t["provenance_records"].where("confidence < 0 or confidence > 1 or isnan(confidence)"),
            "ids": checks.failing(t["artifacts"], {"id": V.valid_record_id(F.col("id"))}).where("size(errors) > 0"),
            "storage key": t["artifact_versions"].where(~V.valid_storage_key(F.col("storage_key"))),
            "sha": t["artifact_versions"].where(~V.valid_sha256(F.col("content_sha256"))),
            "span": t["provenance_records"].where(~V.valid_span(F.col("text_span_start"), F.col("text_span_end"))),
            "model": t["provenance_records"].where(~V.valid_model(*(F.col(c) for c in ("model_provider", "model_name", "model_version", "model_configuration_json")))),
            "time": t["provenance_records"].where(~V.valid_time(F.col("extracted_at_ms"))),
            "filename": t["artifact_versions"].where(F.col("original_filename").isNotNull() & ~V.valid_filename(F.col("original_filename"))),
            "case status": t["cases"].where(~is_code(F.col("status"), "case_status")),
            "verification state": t["provenance_records"].where(~is_code(F.col("verification_state"), "verification_state")),
        }
    )


_VIOLATIONS = r"""
WITH c AS (SELECT DISTINCT * FROM cases), s AS (SELECT DISTINCT * FROM sources), a AS (SELECT DISTINCT * FROM artifacts), v AS (SELECT DISTINCT * FROM artifact_versions), p AS (SELECT DISTINCT * FROM provenance_records)
SELECT 'artifact without source' AS "constraint", count(*) AS n FROM a WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM s WHERE id IS NOT NULL)
UNION ALL SELECT 'version without artifact', count(*) FROM v WHERE artifact_id IS NOT NULL AND artifact_id NOT IN (SELECT id FROM a WHERE id IS NOT NULL)
UNION ALL SELECT 'provenance without version', count(*) FROM p WHERE artifact_version_id IS NOT NULL AND artifact_version_id NOT IN (SELECT id FROM v WHERE id IS NOT NULL)
UNION ALL SELECT 'two artifacts of a key', count(*) FROM (SELECT 1 FROM a WHERE case_id IS NOT NULL AND source_key IS NOT NULL GROUP BY case_id, source_key HAVING count(*) > 1)
UNION ALL SELECT 'two versions of a number', count(*) FROM (SELECT 1 FROM v WHERE artifact_id IS NOT NULL AND version_number IS NOT NULL GROUP BY artifact_id, version_number HAVING count(*) > 1)
UNION ALL SELECT 'closed without time', count(*) FROM c WHERE status = 'closed' AND closed_at_ms IS NULL
UNION ALL SELECT 'confidence', count(*) FROM p WHERE confidence < 0 OR confidence > 1 OR isnan(confidence)
UNION ALL SELECT 'ids', count(*) FROM a WHERE NOT coalesce(regexp_full_match(id, '[A-Za-z0-9_-]{3,100}'), false)
UNION ALL SELECT 'storage key', count(*) FROM v WHERE NOT coalesce(regexp_full_match(storage_key, 'blobs/[0-9a-f]{2}/[0-9a-f]{64}') AND storage_key[7:8] = storage_key[10:11], false)
UNION ALL SELECT 'sha', count(*) FROM v WHERE NOT coalesce(regexp_full_match(content_sha256, '[0-9a-f]{64}'), false)
UNION ALL SELECT 'span', count(*) FROM p WHERE text_span_end < text_span_start
UNION ALL SELECT 'model', count(*) FROM p WHERE model_provider IS NULL AND coalesce(model_name, model_version, model_configuration_json) IS NOT NULL
UNION ALL SELECT 'time', count(*) FROM p WHERE extracted_at_ms < 0
UNION ALL SELECT 'filename', count(*) FROM v WHERE original_filename IS NOT NULL AND NOT (length(trim(original_filename)) BETWEEN 1 AND 255 AND NOT regexp_matches(original_filename, '[\x00-\x1f\x7f-\x9f]') AND regexp_full_match(original_filename, '[^/]+') AND original_filename NOT IN ('.', '..'))
UNION ALL SELECT 'case status', count(*) FROM c WHERE NOT coalesce(status IN @case_status, false)
UNION ALL SELECT 'verification state', count(*) FROM p WHERE NOT coalesce(verification_state IN @verification_state, false)
"""
for _set in ("case_status", "verification_state"):
    _VIOLATIONS = _VIOLATIONS.replace(f"@{_set}", str(CODES[_set]))


def q_existence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "sources").select("id", "case_id").distinct()
    known = table(spark, d, "cases").where("status = 'open'")
    there, absent = checks.split_existing(c, "case_id", known, "id")
    return there.select("id", F.lit("accepted").alias("outcome")).unionByName(absent.select("id", F.lit("not_found").alias("outcome")))


_EXISTENCE = """
SELECT id, CASE WHEN case_id IN (SELECT id FROM cases WHERE status = 'open' AND id IS NOT NULL) THEN 'accepted' ELSE 'not_found' END AS outcome FROM (SELECT DISTINCT id, case_id FROM sources)
"""


def q_audit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cases").distinct().select(F.col("id").alias("case_id"), F.col("id").alias("target"), F.col("created_at_ms").alias("at"))
    s = table(spark, d, "artifacts").distinct().select("case_id", F.col("id").alias("target"), F.col("created_at_ms").alias("at"))
    who = F.lit("system")
    events = claims.audit(c, "case.create", F.col("target"), F.col("at"), who).unionByName(claims.audit(s, "artifact.ingest", F.col("target"), F.col("at"), who))
    return events.select("id", "case_id", "operation", "target_id", "occurred_at_ms").orderBy("case_id", "occurred_at_ms", "id")


_AUDIT = """
SELECT concat('audit_', left(sha256(concat('audit', chr(0), o, chr(0), target)), 32)) AS id, case_id, o AS operation, target AS target_id, moment AS occurred_at_ms FROM (
  SELECT DISTINCT id AS case_id, id AS target, created_at_ms AS moment, 'case.create' AS o FROM cases
  UNION ALL SELECT DISTINCT case_id, id, created_at_ms, 'artifact.ingest' FROM artifacts)
"""


def q_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What is extracted from all simple records, written as CSV, against what they should hold: an empty
    or missing cell is expected and not found, an amount is found and not expected."""
    r = table(spark, d, "simple_records").where("record_id is not null").dropDuplicates(["record_id"]).select(F.col("record_id").cast("string").alias("artifact_id"), *_RECORD_FIELDS)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    texts = r.select("artifact_id", F.concat_ws("\n", F.lit(",".join(_RECORD_FIELDS)), F.concat_ws(",", *(quoted(n) for n in _RECORD_FIELDS))).alias("text"))
    got = scans.typed_fields(scans.scan_csv(texts)[0]).withColumn("subject_key", F.concat_ws("/", "artifact_id", "subject_key"))
    wanted = F.array(*(F.struct(F.lit(p).alias("predicate"), F.lit(t).alias("type")) for p, t in (("name", "text"), ("received_date", "date"))))
    want = r.select(F.concat("artifact_id", F.lit("/row:1")).alias("subject_key"), F.explode(wanted).alias("x")).select("subject_key", "x.*")
    return checks.extraction_quality(want, got)


_METRICS = r"""
WITH r AS (SELECT DISTINCT record_id, coalesce(name, '') AS name, coalesce(monthly_amount, '') AS amount, coalesce(received_date, '') AS day FROM simple_records WHERE record_id IS NOT NULL),
whole AS (SELECT *, name = '' AND amount = '' AND day = '' AS nothing, regexp_replace(name, '^\s+|\s+$', '', 'g') AS n, regexp_replace(day, '^\s+|\s+$', '', 'g') AS x FROM r),
k AS (SELECT *, lower(n) NOT IN ('null', 'unknown', 'true', 'false') AND left(n, 1) <> '$' AND NOT regexp_full_match(n, '-?[0-9]+\.[0-9]+') AND NOT (regexp_full_match(n, '[+-]?[0-9]+') AND try_cast(n AS bigint) IS NOT NULL)
      AND NOT coalesce(regexp_full_match(n, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND n >= '0001' AND try_cast(n AS date) IS NOT NULL, false) AS named,
    coalesce(regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND x >= '0001' AND try_cast(x AS date) IS NOT NULL, false) AS dated FROM whole)
SELECT 2 * count(*) AS expected, count(CASE WHEN name <> '' THEN 1 END) + count(CASE WHEN amount <> '' THEN 1 END) + count(CASE WHEN day <> '' THEN 1 END) AS extracted,
  count(CASE WHEN name <> '' THEN 1 END) + count(CASE WHEN day <> '' THEN 1 END) AS right_predicates, count(CASE WHEN name <> '' AND named THEN 1 END) + count(CASE WHEN day <> '' AND dated THEN 1 END) AS right_types,
  count(CASE WHEN name <> '' THEN 1 END) + count(CASE WHEN amount <> '' THEN 1 END) + count(CASE WHEN day <> '' THEN 1 END) AS located, count(CASE WHEN amount <> '' THEN 1 END) AS unsupported FROM k
"""

QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
SQL = {
    "q_text_scan": _TEXT_SCAN,
    "q_json_scan": _JSON_SCAN,
    "q_csv_scan": _CSV_SCAN,
    "q_normalize": _NORMALIZE,
    "q_classify": _CLASSIFY,
    "q_content_hash": "SELECT doc_id, sha256(text) AS content_sha256, concat('blobs/', left(sha256(text), 2), '/', sha256(text)) AS storage_key, 'true' AS valid_key FROM documents WHERE text IS NOT NULL",
    "q_blobs": "SELECT DISTINCT sha256(text) AS content_sha256, concat('blobs/', left(sha256(text), 2), '/', sha256(text)) AS storage_key, CAST(strlen(text) AS bigint) AS content_length FROM documents WHERE text IS NOT NULL",
    "q_ingest_disposition": _DISPOSITION,
    "q_source_upsert": _SOURCE_UPSERT,
    "q_versions_list": "SELECT case_id, source_key, v.id AS version_id, version_number, created_at_ms FROM (SELECT DISTINCT id, artifact_id, version_number FROM artifact_versions) v JOIN (SELECT DISTINCT id, case_id, source_key, created_at_ms FROM artifacts) a ON v.artifact_id = a.id",
    "q_claims_unpivot": _UNPIVOT,
    "q_fan_out": _FAN_OUT,
    "q_value_classes": f"WITH {_SQL_CLAIMS} SELECT * FROM classes",
    "q_claim_links": f"WITH {_SQL_CLAIMS}, g AS (SELECT case_id, subject_key, predicate, sum(members) AS total FROM classes GROUP BY ALL) SELECT claim_id, class_id, members - 1 AS n_corroborates, CAST(total - members AS bigint) AS n_contradicts FROM known JOIN classes USING (case_id, subject_key, predicate, normalized_value) JOIN g USING (case_id, subject_key, predicate)",
    "q_contradictions": f"WITH {_SQL_CLAIMS} SELECT concat('contradiction_', left(sha256(concat('contradiction', chr(0), a.class_id, chr(0), b.class_id)), 32)) AS contradiction_id, a.case_id, a.class_id AS class_a, b.class_id AS class_b FROM classes a JOIN classes b ON a.case_id = b.case_id AND a.subject_key = b.subject_key AND a.predicate = b.predicate AND a.class_id < b.class_id",
    "q_conflict_groups": f"WITH {_SQL_CLAIMS} SELECT case_id, subject_key, predicate, count(*) AS n_claims, count(DISTINCT normalized_value) AS n_values, CASE WHEN count(DISTINCT normalized_value) > 1 THEN 'conflicting' ELSE 'claimed' END AS verdict FROM known GROUP BY ALL",
    "q_links_when_recorded": _RECORDED,
    "q_incremental_links": _INCREMENTAL,
    "q_latest_state": "SELECT user_id AS claim_id, arg_max(event_type, (ts, event_id)) AS state, epoch_us(max(ts)) AS changed_at_ms FROM events GROUP BY user_id",
    "q_active_claims": f"WITH {_SQL_CLAIMS} SELECT claim_id, state AS current_state FROM claims WHERE state <> 'rejected'",
    "q_add_days": "SELECT o_orderkey, CASE WHEN year(CAST(o_orderdate AS date) + CAST((o_orderkey % 4000) * 1000 AS int)) <= 9999 THEN strftime(CAST(o_orderdate AS date) + CAST((o_orderkey % 4000) * 1000 AS int), '%Y-%m-%d') END AS due FROM orders",
    "q_provenance_lineage": _LINEAGE,
    "q_violations": _VIOLATIONS,
    "q_existence": _EXISTENCE,
    "q_audit": _AUDIT,
    "q_eval_metrics": _METRICS,
}
