"""Catalog, path, download and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog, downloads, telemetry
from .fixtures import rows, view

_UPPER = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)"
_SUPPORTED = f"lower({_UPPER}) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'tiff', 'tif', 'npy')"
#: Identifiers that are right, odd, without prefix, not UTF-8 and in capitals.
_IDS = """SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'id:' || lower(hex(path)) WHEN 1 THEN 'id:' || hex(path) || '0'
  WHEN 2 THEN hex(path) WHEN 3 THEN 'id:ff' || hex(path) ELSE 'id:' || hex(path) END AS code FROM fx_images"""
_REQUESTS = """SELECT image_id AS request_id, CASE image_id % 4 WHEN 0 THEN 'id:' || lower(hex(path)) WHEN 1 THEN regexp_replace(path, '[^a-zA-Z0-9_-]', '_'{g})
  WHEN 2 THEN 'missing' ELSE 'id:2e2e2f78' END AS requested FROM fx_images"""
_NAMES = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' a/b:c*' || url || ' ' WHEN 2 THEN '<x>|y?' WHEN 3 THEN '\"q\".png' WHEN 4 THEN '' ELSE 'plain' || CAST(page_id AS STRING) END AS name FROM pages"
_UPLOADS = "SELECT upload_id, page_id AS ord, raw_name, CASE WHEN page_id % 31 = 0 THEN 0 WHEN page_id % 97 = 1 THEN 600000000 ELSE size_bytes * 9000 END AS size_bytes FROM fx_upload_names"
_LIMIT = 256 << 20

#: All images, and every eleventh one once more under an id that has no build.
_WITH_UNBUILT = "SELECT image_id FROM fx_images UNION ALL SELECT image_id + 1000000 FROM fx_images WHERE image_id % 11 = 0"

QUERIES = {
    "s1_scan_catalog": lambda s, d: catalog.catalog(view(s, d, "fx_images").select("path")),
    "s2_count_images": lambda s, d: catalog.count_images(view(s, d, "fx_images")),
    "s3_is_supported": lambda s, d: view(s, d, "fx_images").select("image_id", paths.is_supported(F.col("path")).alias("supported")),
    "s4_loader_for": lambda s, d: view(s, d, "fx_images").select("image_id", paths.loader_for(F.col("path")).alias("loader")),
    "k1_encode_image_id": lambda s, d: view(s, d, "fx_images").select("image_id", paths.encode_image_id(F.col("path")).alias("code")),
    "k2_decode_image_id": lambda s, d: rows(s, d, _IDS).select("image_id", paths.decode_image_id(F.col("code")).alias("path")),
    "k3_legacy_id": lambda s, d: view(s, d, "fx_images").select("image_id", paths.legacy_id(F.col("path")).alias("legacy")),
    "k4_is_safe_relative_path": lambda s, d: view(s, d, "fx_upload_names").select("page_id", paths.is_safe_relative_path(F.col("raw_name")).alias("safe")),
    "k5_resolve_ids": lambda s, d: catalog.resolve_ids(rows(s, d, _REQUESTS.format(g="")), view(s, d, "fx_images").select("path")),
    "k6_image_fingerprint": lambda s, d: view(s, d, "fx_images").select("image_id", catalog.fingerprint(F.col("path"), F.col("size_bytes"), F.lit(0)).alias("fingerprint")),
    "k7_normalize_upload_path": lambda s, d: view(s, d, "fx_upload_names").select("page_id", *(c.alias(n) for c, n in zip(paths.upload_path(F.lit("set"), F.col("raw_name")), ("path", "reason"), strict=True))),
    "k8_check_upload_limits": lambda s, d: catalog.check_uploads(rows(s, d, _UPLOADS)),
    "k9_sanitize_filename": lambda s, d: rows(s, d, _NAMES).select("page_id", paths.sanitize_filename(F.col("name")).alias("name")),
    "k10_safe_download_name": lambda s, d: rows(s, d, _NAMES).select("page_id", paths.safe_download_name(F.col("name")).alias("name")),
    "d1_part_size_bytes": lambda s, d: rows(s, d, "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN CAST(page_id % 1500 AS INT) END AS mb FROM pages").select("page_id", downloads.part_size_bytes(F.col("mb")).alias("bytes")),
    "d2_plan_parts": lambda s, d: downloads.plan_parts(view(s, d, "fx_images"), _LIMIT),
    "d3_part_info": lambda s, d: downloads.part_info(downloads.plan_parts(view(s, d, "fx_images"), _LIMIT)),
    "d4_plan_summary": lambda s, d: downloads.plan_summary(downloads.plan_parts(view(s, d, "fx_images"), _LIMIT), _LIMIT),
    "d5_part_lookup": lambda s, d: downloads.part_lookup(rows(s, d, "SELECT DISTINCT project, CAST(image_id % 9 AS INT) AS part FROM fx_images"), downloads.part_info(downloads.plan_parts(view(s, d, "fx_images"), _LIMIT))),
    "d6_needs_zip64": lambda s, d: rows(s, d, "SELECT image_id, size_bytes * 100 AS size_bytes FROM fx_images").select("image_id", downloads.needs_zip64(F.col("size_bytes")).alias("zip64")),
    "t1_endpoint_metrics": lambda s, d: telemetry.endpoint_metrics(view(s, d, "fx_request_log"), s),
    "t3_error_dimension": lambda s, d: telemetry.classify_errors(view(s, d, "fx_request_log").select("event_id", "error_code"), s),
    "t4_severity_rank": lambda s, d: view(s, d, "fx_request_log").groupBy("endpoint").agg(F.max(telemetry.severity_rank(F.expr("CASE error_code div 1000 WHEN 1 THEN 'Warning' WHEN 4 THEN 'Error' WHEN 5 THEN 'Fatal' WHEN 9 THEN 'Odd' ELSE 'Info' END"))).cast("int").alias("severity")),
    "t5_latency_summary": lambda s, d: telemetry.latency_summary(rows(s, d, "SELECT event_type, value FROM events"), "event_type", "value"),
    "t6_pyramid_status": lambda s, d: view(s, d, "fx_build_status").select("image_id", telemetry.pyramid_status(F.col("status_text")).alias("status")),
    "t7_pending_builds": lambda s, d: telemetry.pending_builds(rows(s, d, _WITH_UNBUILT), view(s, d, "fx_build_status")),
    "t8_build_outcomes": lambda s, d: telemetry.build_outcomes(view(s, d, "fx_images").join(view(s, d, "fx_build_status"), "image_id").withColumn("status", telemetry.pyramid_status(F.col("status_text"))).select("project", F.when(F.col("status").isin("ready", "building"), "skipped").when(F.col("status") == "failed", "failed").otherwise("generated").alias("outcome"))),
    "t9_build_progress": lambda s, d: rows(s, d, "SELECT image_id, image_id % 8 AS level, 8 AS levels FROM fx_images").select("image_id", *(c.alias(n) for c, n in zip(telemetry.build_progress(F.col("level"), F.col("levels")), ("progress", "eta_s"), strict=True))),
    "t11_stale_connections": lambda s, d: telemetry.stale_connections(rows(s, d, "SELECT user_id, ts FROM events")),
    "t12_server_info": lambda s, d: telemetry.server_info(view(s, d, "fx_images"), catalog.count_images(view(s, d, "fx_images"))),
}

_PLAN = f"""
WITH RECURSIVE n AS (SELECT project, path, size_bytes, row_number() OVER (PARTITION BY project ORDER BY path, size_bytes) AS i FROM fx_images),
r AS (
  SELECT project, path, size_bytes, i, 0 AS part, greatest(size_bytes, 1) AS used FROM n WHERE i = 1
  UNION ALL
  SELECT n.project, n.path, n.size_bytes, n.i, r.part + CASE WHEN r.used + greatest(n.size_bytes, 1) > {_LIMIT} THEN 1 ELSE 0 END,
    CASE WHEN r.used + greatest(n.size_bytes, 1) > {_LIMIT} THEN greatest(n.size_bytes, 1) ELSE r.used + greatest(n.size_bytes, 1) END
  FROM r JOIN n ON n.project = r.project AND n.i = r.i + 1),
parts AS (SELECT project, part, project || '_images_part' || CASE WHEN part < 999 THEN lpad(CAST(part + 1 AS VARCHAR), 3, '0') ELSE CAST(part + 1 AS VARCHAR) END || '.zip' AS file_name, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM r GROUP BY project, part)
"""
_SEG = "list_filter(list_transform(string_split(replace(trim(raw_name), chr(92), '/'), '/'), lambda x: trim(x)), lambda x: x <> '' AND x <> '.')"
_REASON = f"""CASE WHEN trim(raw_name) = '' THEN 'empty' WHEN trim(raw_name) LIKE '/%' THEN 'absolute'
  WHEN len(list_filter({_SEG}, lambda x: x = '..' OR x LIKE '%:%')) > 0 THEN CASE WHEN list_filter({_SEG}, lambda x: x = '..' OR x LIKE '%:%')[1] = '..' THEN 'parent' ELSE 'colon' END
  WHEN len({_SEG}) = 0 THEN 'empty' END"""
_ERRORS = ", ".join(f"({c}, '{n}', {str(r).lower()}, {ms})" for c, n, r, ms in telemetry.ERRORS)

SQL = {
    "k6_image_fingerprint": "SELECT image_id, left(sha256(path || chr(10) || size_bytes || chr(10) || '0'), 16) AS fingerprint FROM fx_images",
    "s1_scan_catalog": f"SELECT 'id:' || lower(hex(path)) AS id, regexp_extract(path, '([^/]*)$', 1) AS name, path, upper({_UPPER}) AS format FROM fx_images WHERE {_SUPPORTED}",
    "s2_count_images": f"SELECT project, count(*) FILTER (WHERE {_SUPPORTED}) AS images FROM fx_images GROUP BY project",
    "s3_is_supported": f"SELECT image_id, {_SUPPORTED} AS supported FROM fx_images",
    "s4_loader_for": f"SELECT image_id, CASE WHEN NOT {_SUPPORTED} THEN NULL WHEN lower({_UPPER}) = 'npy' THEN 'npy' ELSE 'standard' END AS loader FROM fx_images",
    "k1_encode_image_id": "SELECT image_id, 'id:' || lower(hex(path)) AS code FROM fx_images",
    "k2_decode_image_id": f"WITH i AS ({_IDS}) SELECT image_id, CASE WHEN code LIKE 'id:%' AND length(code) % 2 = 1 AND regexp_full_match(substr(code, 4), '[0-9a-fA-F]*') THEN try(decode(unhex(substr(code, 4)))) END AS path FROM i",
    "k3_legacy_id": "SELECT image_id, regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g') AS legacy FROM fx_images",
    "k4_is_safe_relative_path": "SELECT page_id, raw_name <> '' AND raw_name NOT LIKE '/%' AND NOT list_contains(string_split(raw_name, '/'), '..') AS safe FROM fx_upload_names",
    "k5_resolve_ids": f"""WITH q AS ({_REQUESTS.format(g=", 'g'")}), ok AS (SELECT DISTINCT path FROM fx_images WHERE {_SUPPORTED}),
      old AS (SELECT regexp_replace(path, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS legacy, min(path) AS path FROM ok GROUP BY 1)
      SELECT request_id, requested, coalesce(ok.path, old.path) AS path FROM q LEFT JOIN ok ON q.requested = 'id:' || lower(hex(ok.path)) LEFT JOIN old ON q.requested = old.legacy""",
    "k7_normalize_upload_path": f"SELECT page_id, CASE WHEN {_REASON} IS NULL THEN 'set/' || array_to_string({_SEG}, '/') END AS path, {_REASON} AS reason FROM fx_upload_names",
    "k8_check_upload_limits": f"""WITH u AS ({_UPLOADS}),
      n AS (SELECT *, {_REASON} AS reason, 'uploads/' || array_to_string({_SEG}, '/') AS path, count(*) OVER w AS nth, sum(size_bytes) OVER w AS running FROM u WINDOW w AS (PARTITION BY upload_id ORDER BY ord)),
      v AS (SELECT upload_id, ord, CASE WHEN reason IS NULL THEN path END AS path, CASE WHEN nth > 2000 THEN 'too_many_files' WHEN reason IS NOT NULL THEN 'path_' || reason WHEN NOT {_SUPPORTED} THEN 'unsupported_type'
        WHEN size_bytes > 536870912 THEN 'file_too_large' WHEN running > 2147483648 THEN 'upload_too_large' WHEN size_bytes = 0 THEN 'empty_file' ELSE 'ok' END AS verdict FROM n)
      SELECT *, coalesce(bool_or(verdict <> 'ok') OVER (PARTITION BY upload_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM v""",
    "k9_sanitize_filename": f"WITH n AS ({_NAMES}) SELECT page_id, CASE WHEN trim(regexp_replace(trim(name), '[/\\\\:*?\"<>|]', '_', 'g')) = '' THEN 'project' ELSE regexp_replace(trim(name), '[/\\\\:*?\"<>|]', '_', 'g') END AS name FROM n",
    "k10_safe_download_name": f"WITH n AS ({_NAMES}) SELECT page_id, replace(name, '\"', '_') AS name FROM n",
    "d1_part_size_bytes": "SELECT page_id, CAST(least(greatest(coalesce(CASE WHEN page_id % 9 <> 0 THEN page_id % 1500 END, 256), 16), 1024) AS BIGINT) * 1048576 AS bytes FROM pages",
    "d2_plan_parts": _PLAN + "SELECT project, path, size_bytes, part FROM r",
    "d3_part_info": _PLAN + "SELECT project, part, file_name, files, bytes FROM parts",
    "d4_plan_summary": _PLAN + f"SELECT project, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, {_LIMIT} AS part_size, count(DISTINCT part) AS parts FROM r GROUP BY project",
    "d5_part_lookup": _PLAN + "SELECT q.project, q.part, p.part IS NOT NULL AS found, file_name, coalesce(n, 0) AS available FROM (SELECT DISTINCT project, CAST(image_id % 9 AS INT) AS part FROM fx_images) q LEFT JOIN parts p ON p.project = q.project AND p.part = q.part LEFT JOIN (SELECT project, count(*) AS n FROM parts GROUP BY project) c ON c.project = q.project",
    "d6_needs_zip64": "SELECT image_id, size_bytes * 100 > 4294967295 AS zip64 FROM fx_images",
    "t1_endpoint_metrics": "SELECT e.endpoint, count(l.endpoint) AS requests, count(*) FILTER (WHERE NOT ok) AS errors, coalesce(CAST(sum(latency_ms) // nullif(count(l.endpoint), 0) AS BIGINT), 0) AS avg_latency_ms, coalesce(max(latency_ms), 0) AS max_latency_ms FROM (VALUES ('image_bands'), ('sam_infer'), ('sam_warm')) e(endpoint) LEFT JOIN fx_request_log l ON l.endpoint = e.endpoint GROUP BY e.endpoint",
    "t3_error_dimension": f"""SELECT event_id, error_code, name, CASE error_code // 1000 WHEN 1 THEN 'Image' WHEN 2 THEN 'Pyramid' WHEN 3 THEN 'Model' WHEN 4 THEN 'Connection' WHEN 5 THEN 'Server' WHEN 6 THEN 'Client' ELSE 'Unknown' END AS category,
      coalesce(retryable, false) AS retryable, coalesce(retry_ms, 1000) AS retry_ms FROM fx_request_log LEFT JOIN (VALUES {_ERRORS}) e(code, name, retryable, retry_ms) ON code = error_code WHERE error_code IS NOT NULL""",
    "t4_severity_rank": "SELECT endpoint, max(CASE WHEN error_code IS NULL THEN 0 ELSE CASE error_code // 1000 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 9 THEN NULL ELSE 0 END END) AS severity FROM fx_request_log GROUP BY endpoint",
    "t5_latency_summary": "SELECT event_type, min(value) AS min, list_sort(list(value))[count(*) // 2 + 1] AS median, avg(value) AS mean FROM events GROUP BY event_type",
    "t6_pyramid_status": "SELECT image_id, CASE WHEN trim(status_text) = 'ready' THEN 'ready' WHEN trim(status_text) = 'building' THEN 'building' WHEN trim(status_text) LIKE 'failed:%' THEN 'failed' ELSE 'pending' END AS status FROM fx_build_status",
    "t7_pending_builds": f"SELECT i.image_id, CASE WHEN trim(status_text) LIKE 'failed:%' THEN 'failed' ELSE 'pending' END AS status FROM ({_WITH_UNBUILT}) i LEFT JOIN fx_build_status b ON b.image_id = i.image_id WHERE coalesce(trim(status_text), '') NOT IN ('ready', 'building')",
    "t8_build_outcomes": "WITH o AS (SELECT project, CASE WHEN trim(status_text) IN ('ready', 'building') THEN 'skipped' WHEN trim(status_text) LIKE 'failed:%' THEN 'failed' ELSE 'generated' END AS outcome FROM fx_images JOIN fx_build_status USING (image_id)) SELECT project, count(*) FILTER (WHERE outcome = 'generated') AS generated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o GROUP BY project",
    "t9_build_progress": "SELECT image_id, (image_id % 8) / 8.0::DOUBLE AS progress, CASE WHEN image_id % 8 > 0 THEN (8 - image_id % 8) * 2 END AS eta_s FROM fx_images",
    "t11_stale_connections": """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, floor((epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000)) / 1000.0) AS gap FROM events),
      n AS (SELECT user_id, ms, sum(CASE WHEN gap > 90 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM g)
      SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS beats, min(ms) AS first_ms, max(ms) AS last_ms FROM n GROUP BY user_id, session""",
    "t12_server_info": f"SELECT project, count(*) FILTER (WHERE {_SUPPORTED}) AS images, '1.0.0' AS version FROM fx_images GROUP BY project",
}
