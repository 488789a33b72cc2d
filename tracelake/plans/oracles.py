"""The SQL that each registered query is checked against, on the same tables."""

from __future__ import annotations

from tracelake.plans.adapters import with_views
from tracelake.plans.queries import (
    FUNCTION,
    INSTRUCTIONS,
    INTRO,
    NODEID,
    PATCH_FORMAT,
    RUNTIME,
    SMALL_CAP,
    SYMBOLS,
)

ORACLES: dict[str, str] = {}

# Views that several checks share, on top of the adapter views.
SHARED = {
    "frames": """
SELECT trace_id, CASE kind WHEN 'call' THEN 'exec_path' WHEN 'line' THEN 'step_frames' ELSE 'frames' END AS kind,
  seq AS pos, file, line, func, CASE WHEN kind <> 'call' THEN local_k ->> '$.k' END AS k
FROM trace_events WHERE kind IN ('call', 'line', 'return')""",
    "exec_path": """
SELECT trace_id, pos, file, func, line FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, file, func ORDER BY pos) AS r FROM frames
    WHERE kind = 'exec_path' AND starts_with(file, '/testbed/') AND NOT contains(file, 'site-packages')
      AND NOT ends_with(file, '/conftest.py')) WHERE r = 1) WHERE n <= 500""",
    "traceback": """
SELECT trace_id, pos, file, line, func, k FROM frames
WHERE kind = 'frames' AND NOT contains(file, '<') AND NOT contains(file, 'frozen') AND NOT contains(file, 'site-packages')
  AND ends_with(file, '.py') AND NOT contains(file, '/lib/python') AND NOT ends_with(file, '/conftest.py')""",
    "listed": """
SELECT trace_id, CASE kind WHEN 'frames' THEN 0 ELSE 1 END AS branch, pos, file, line FROM frames
WHERE kind IN ('frames', 'exec_path')""",
    "used_files": """
SELECT trace_id, file, branch, pos, line AS first_line, n_lines FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, file ORDER BY branch, pos) AS r,
    count(*) OVER (PARTITION BY trace_id, file) AS n_lines FROM listed) WHERE r = 1""",
    "ranked_files": """
SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY
  CASE WHEN contains(file, '/tests/') OR regexp_matches(file, '(^|/)test_[^/]*$') THEN 0 ELSE 1 END, branch, pos) AS rank
FROM used_files""",
    "focus": """
SELECT trace_id, file AS test_file, first_line AS focus_line FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY branch, pos) AS r FROM used_files
  WHERE contains(file, '/tests/') OR regexp_matches(file, '(^|/)test_[^/]*$')) WHERE r = 1""",
    "split_source": """
SELECT path, CASE WHEN content = '' THEN [] WHEN ends_with(content, chr(10))
  THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS lines FROM source_files""",
    "parsed": """
SELECT instance_id, variant, recorded_at, output, run_error, status,
  CASE WHEN status = 'passed' THEN 0 WHEN counted IS NULL THEN tally WHEN tally IS NULL THEN counted
    ELSE greatest(counted, tally) END AS failure_count,
  ran AS ran_tests, trim(summary) AS summary_line
FROM (SELECT *,
  CASE WHEN regexp_matches(output, '(?m)^FAILED\\b') OR regexp_matches(output, '\\b[0-9]+\\s+failed\\b') THEN 'failed'
    WHEN regexp_matches(output, '(?m)^OK\\b') THEN 'passed' ELSE 'unknown' END AS status,
  CAST(list_sum(list_transform(regexp_extract_all(output, '(?:failures|errors)=([0-9]+)', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS counted,
  TRY_CAST(nullif(regexp_extract(output, '([0-9]+)\\s+failed\\b', 1), '') AS BIGINT) AS tally,
  TRY_CAST(nullif(regexp_extract(output, 'Ran\\s+([0-9]+)\\s+tests', 1), '') AS BIGINT) AS ran,
  coalesce(nullif(regexp_extract(output, '(?m)^FAILED.*$', 0), ''), nullif(regexp_extract(output, '(?m)^OK.*$', 0), ''),
    nullif(regexp_extract(output, '(?m)^=+.*(?:failed|passed).*$', 0), ''), '') AS summary
  FROM test_outputs)""",
    "judged": """
SELECT instance_id, variant, output, run_error, run_error IS NULL AS success,
  CASE WHEN variant = 'baseline' OR run_error IS NULL THEN status WHEN starts_with(run_error, 'No unified') THEN 'not_run'
    WHEN contains(run_error, 'Patch Apply Failed') THEN 'apply_failed' ELSE 'not_run' END AS status,
  CASE WHEN run_error IS NULL THEN failure_count END AS failure_count,
  CASE WHEN run_error IS NULL THEN ran_tests END AS ran_tests,
  CASE WHEN run_error IS NULL THEN summary_line WHEN starts_with(run_error, 'No unified') THEN 'not run (no patch extracted)'
    ELSE run_error END AS summary_line,
  run_error IS NOT NULL AS run_skipped
FROM parsed""",
    "reasons": """
SELECT *, CASE status WHEN 'passed' THEN NULL WHEN 'apply_failed' THEN 'patch_apply_failed'
    WHEN 'not_run' THEN CASE WHEN contains(t, 'no unified diff') THEN 'no_patch_generated'
      WHEN contains(t, 'unauthorized') OR contains(t, '401') THEN 'llm_request_failed' ELSE 'not_run' END
    WHEN 'failed' THEN CASE WHEN contains(t, 'timed out') OR contains(t, 'timeout') THEN 'test_timeout' ELSE 'tests_failed' END
    ELSE 'unknown' END AS failure_reason,
  CASE WHEN length(e) <= 500 THEN e ELSE concat(e[1:500], '...') END AS raw_error_excerpt
FROM (SELECT *, lower(concat(summary_line, ' ', coalesce(run_error, ''))) AS t,
  trim(coalesce(nullif(run_error, ''), nullif(summary_line, ''), '')) AS e FROM judged)""",
    "pairs": """
SELECT v.instance_id, v.variant, CASE WHEN v.run_skipped OR v.status IN ('apply_failed', 'not_run') THEN 'not_run'
  WHEN b.status <> 'passed' AND v.status = 'passed' THEN 'fixed'
  WHEN v.failure_count < b.failure_count THEN 'improved' WHEN v.failure_count = b.failure_count THEN 'unchanged'
  WHEN v.failure_count > b.failure_count THEN 'regressed' ELSE 'unknown' END AS verdict
FROM judged v JOIN judged b ON v.instance_id = b.instance_id AND b.variant = 'baseline' WHERE v.variant <> 'baseline'""",
    "variant_totals": """
SELECT variant, count(*) AS total_instances, count(*) FILTER (status = 'passed') AS success_count,
  count(*) - count(*) FILTER (status = 'passed') AS failure_count,
  round(count(*) FILTER (status = 'passed') / count(*), 9) AS success_rate,
  round(1.0 * (count(*) - count(*) FILTER (status = 'passed')) / count(*), 9) AS failure_rate
FROM reasons WHERE variant <> 'baseline' GROUP BY variant""",
    "count_texts": """
SELECT variant, string_agg(concat(status, '=', n), ',' ORDER BY concat(status, '=', n)) AS status_counts FROM (
  SELECT variant, status, count(*) AS n FROM reasons WHERE variant <> 'baseline' GROUP BY ALL) GROUP BY variant""",
    "reason_texts": """
SELECT variant, string_agg(concat(failure_reason, '=', n), ',' ORDER BY concat(failure_reason, '=', n)) AS failure_reason_counts FROM (
  SELECT variant, failure_reason, count(*) AS n FROM reasons WHERE variant <> 'baseline' AND status <> 'passed' GROUP BY ALL) GROUP BY variant""",
    "frameworks": """
SELECT instance_id, brand, CASE WHEN contains(s, 'pytest') OR contains(s, 'py.test') THEN 'pytest'
  WHEN contains(s, 'manage.py test') OR contains(s, 'runtests.py') THEN 'django'
  WHEN contains(s, 'unittest') THEN 'unittest' ELSE 'unknown' END AS framework
FROM (SELECT *, lower(eval_script) AS s FROM eval_scripts)""",
    "collection": """
SELECT j.instance_id, j.variant, coalesce(f.framework, 'unknown') AS framework, j.success, j.run_error AS error,
  coalesce(j.failure_count, 0) AS num_failures
FROM judged j LEFT JOIN frameworks f ON j.instance_id = f.instance_id""",
    "chosen": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY ord) AS r FROM traces) WHERE r = 1""",
    "hunk_rows": """
SELECT patch_id, 0 AS file_no, 'b/f.py' AS path, 0 AS hunk_no, patch_id AS old_start, 1 AS old_len, 1 AS new_start, 2 AS new_len,
  concat('-x', chr(10), '+y') AS lines FROM patches WHERE patch_id % 5 = 0
UNION ALL SELECT patch_id, 0, 'b/f.py', 0, patch_id, 2, 7, 3, concat(' a', chr(10), '+b') FROM patches WHERE patch_id % 5 = 1
UNION ALL SELECT patch_id, 0, 'b/f.py', 1, 9, 1, 10, 0, concat('-z', chr(10), 'diff --git a/g.py b/g.py') FROM patches WHERE patch_id % 5 = 1
UNION ALL SELECT patch_id, 1, 'b/g.py', 0, 1, 1, 2, 1, concat('-q', chr(10), '+r') FROM patches WHERE patch_id % 5 = 1""",
    "found": """
SELECT *, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN concat('--- a/f', turn, '.py', chr(10), '+++ b/f.py', chr(10), '@@ -1,2 +1,3 @@',
  chr(10), ' a', chr(10), '+', role, chr(10)) ELSE '' END AS diff FROM messages""",
    "calls": """
SELECT session_id, turn, variant, call_id AS tool_call_id, trim(call_name) AS name,
  CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(raw),
    lambda k: concat(k, '=', json_extract_string(raw, concat('$.', k))))), ',') END AS arguments,
  CASE WHEN trim(call_name) = '' THEN 'Missing function name' WHEN NOT json_valid(raw) THEN 'Function arguments are not valid JSON'
    WHEN json_type(raw) <> 'OBJECT' THEN 'Function arguments must be an object' END AS problem
FROM (SELECT *, coalesce(nullif(call_arguments, ''), '{}') AS raw FROM messages WHERE call_id IS NOT NULL)""",
    "message_texts": """
SELECT session_id, turn, concat('=== ', role, ' ===', chr(10), CASE WHEN content <> '' THEN concat(content, chr(10)) ELSE '' END,
  CASE WHEN call_id IS NOT NULL THEN concat('[tool_call id=', call_id, ' name=', call_name, ']', chr(10), call_arguments, chr(10)) ELSE '' END,
  CASE WHEN tool_call_id IS NOT NULL THEN concat('[tool_call_id=', tool_call_id, ']', chr(10)) ELSE '' END) AS text
FROM messages""",
    "blocks": """
SELECT t.trace_id, t.block_index, concat('Block ', t.block_index, ':', chr(10), 'File: ', t.file, chr(10), 'Function name: ', t.func,
  chr(10), 'Line: ', t.line, chr(10), 'Context:', chr(10), t.context, chr(10), 'Locals: {', chr(10), '  "k": ', to_json(t.k), chr(10), '}') AS block
FROM (SELECT b.*, {context} AS context FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS block_index FROM {rows}) b
  LEFT JOIN split_source s ON b.file = s.path) t""",
}

# The views that each shared view reads.
NEEDS = {
    "frames": ["trace_events"],
    "exec_path": ["frames"],
    "traceback": ["frames"],
    "listed": ["frames"],
    "used_files": ["listed"],
    "ranked_files": ["used_files"],
    "focus": ["used_files"],
    "split_source": ["source_files"],
    "parsed": ["test_outputs"],
    "judged": ["parsed"],
    "reasons": ["judged"],
    "pairs": ["judged"],
    "variant_totals": ["reasons"],
    "count_texts": ["reasons"],
    "reason_texts": ["reasons"],
    "frameworks": ["eval_scripts"],
    "collection": ["judged", "frameworks"],
    "chosen": ["traces"],
    "hunk_rows": ["patches"],
    "found": ["messages"],
    "calls": ["messages"],
    "message_texts": ["messages"],
}


def context(line: str, around: int) -> str:
    """SQL text of the source lines around ``line``, from the array ``s.lines``."""
    n = "len(s.lines)"
    focus = f"least(greatest({line}, 1), {n})"
    first, last = f"greatest({focus} - {around}, 1)", f"least({focus} + {around}, {n})"
    return (
        f"CASE WHEN s.lines IS NULL OR {n} = 0 THEN '<source unavailable>' ELSE array_to_string(list_transform("
        f"range({first}, {last} + 1), lambda i: concat(i, CASE WHEN i = {focus} THEN ' -> : ' ELSE '    : ' END, s.lines[i])), chr(10)) END"
    )


def check(name: str, needs: list[str], select: str, extra: dict[str, str] | None = None) -> None:
    """Register the check of a query: the views it reads, in order, and its select."""
    ordered: list[str] = []

    def visit(view: str) -> None:
        for below in NEEDS.get(view, []):
            visit(below)
        if view not in ordered:
            ordered.append(view)

    for view in needs:
        visit(view)
    base = [v for v in ordered if v not in SHARED]
    derived = [f"{v} AS ({SHARED[v]})" for v in ordered if v in SHARED]
    derived += [f"{v} AS ({sql})" for v, sql in (extra or {}).items()]
    sql = with_views(base, "")
    if derived:
        sql = (sql.rstrip() + ",\n" if base else "WITH ") + ",\n".join(derived) + "\n"
    ORACLES[name] = sql + select


def blocks(rows: str, around: int) -> str:
    return SHARED["blocks"].replace("{rows}", rows).replace("{context}", context("b.line", around))


check(
    "exec_path_summary",
    ["exec_path", "traces"],
    "SELECT t.trace_id, nodeid, exc_type, message, coalesce(e.kept, 0) AS kept FROM traces t LEFT JOIN "
    "(SELECT trace_id, count(*) AS kept FROM exec_path GROUP BY 1) e ON t.trace_id = e.trace_id",
)
check("assembled_frames", ["frames"], "SELECT trace_id, kind, pos, file, line, func, k FROM frames")
check("exec_path_frames", ["exec_path"], "SELECT * FROM exec_path")
check(
    "exec_path_capped",
    ["exec_path"],
    f"SELECT * FROM exec_path QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos) <= {SMALL_CAP}",
)
check(
    "leading_step_frames",
    ["frames"],
    "SELECT trace_id, pos, file, func, line FROM frames WHERE kind = 'step_frames' AND starts_with(file, '/testbed/') "
    f"AND NOT contains(file, 'site-packages') QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos) <= {SMALL_CAP}",
)
check(
    "traceback_frames",
    ["traceback"],
    "SELECT trace_id, pos, file, line, func, concat('\"', k, '\"') AS k FROM traceback",
)
STEP_FRAMES = """
SELECT trace_id, pos, file, line, func, concat('"', k, '"') AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS n FROM (
    SELECT * FROM frames WHERE kind = 'step_frames' AND starts_with(file, '/testbed/') AND NOT contains(file, 'site-packages')
      AND NOT ends_with(file, '/conftest.py')
    QUALIFY row_number() OVER (PARTITION BY trace_id, file, func, line ORDER BY pos) = 1)) WHERE n <= 2000"""
check("step_frames", ["frames"], STEP_FRAMES)
check("sql_step_frames", ["frames"], STEP_FRAMES)
check(
    "sql_exec_path",
    ["exec_path"],
    "SELECT trace_id, pos, file, func, line FROM exec_path QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos) <= 3",
)
check(
    "filtered_trace_frames",
    ["exec_path", "traceback"],
    "SELECT trace_id, 'frames' AS kind, pos, file, line, func, concat('\"', k, '\"') AS k FROM traceback "
    "UNION ALL SELECT trace_id, 'exec_path', pos, file, line, func, NULL FROM exec_path "
    "UNION ALL SELECT trace_id, kind, pos, file, line, func, k FROM frames WHERE kind = 'step_frames'",
)
check(
    "dedup_by_file",
    ["frames"],
    "SELECT trace_id, kind, pos, file, line, func FROM frames "
    "QUALIFY row_number() OVER (PARTITION BY trace_id, kind, file ORDER BY pos) = 1",
)
check(
    "frame_pages",
    ["frames"],
    "SELECT trace_id, kind, row_number() OVER (PARTITION BY trace_id, kind ORDER BY pos) - 1 AS ordinal, "
    "concat(file, ':', line, ':', func) AS place, true AS no_meta FROM frames",
)
check(
    "block_index",
    ["traceback"],
    "SELECT trace_id, pos, file, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS block_index FROM traceback",
)
check(
    "error_location",
    ["frames"],
    "SELECT trace_id, string_split(file, '/')[-1] AS file_name, line, func, 1 AS locals_count, concat('k: ', k) AS locals_preview "
    "FROM frames WHERE kind = 'frames' QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos DESC) = 1",
)
check("select_trace", ["chosen"], "SELECT instance_id, ord, trace_id, nodeid, exc_type, message FROM chosen")
check(
    "find_trace",
    ["traces"],
    f"SELECT instance_id, ord, trace_id, nodeid, exc_type, message FROM traces WHERE nodeid = '{NODEID}'",
)
check(
    "trace_stats",
    ["traces", "frames"],
    "SELECT count(*) AS failures, count(*) FILTER (n > 0) AS failures_with_frames, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_frames, "
    "round(avg(coalesce(n, 0)), 6) AS avg_frames FROM traces t LEFT JOIN "
    "(SELECT trace_id, count(*) AS n FROM frames WHERE kind = 'frames' GROUP BY 1) f ON t.trace_id = f.trace_id",
)
check(
    "exception_histogram",
    ["traces"],
    "SELECT coalesce(exc_type, 'Unknown') AS exc_type, count(*) AS n, min(ord) AS first_seen, "
    "round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM traces GROUP BY 1 ORDER BY n DESC, first_seen",
)
check(
    "file_line_map",
    ["used_files"],
    "SELECT l.trace_id, l.file, l.line, u.branch * 281474976710656 + u.pos AS file_pos, l.branch * 281474976710656 + l.pos AS ord "
    "FROM listed l JOIN used_files u ON l.trace_id = u.trace_id AND l.file = u.file",
)
check(
    "context_files",
    ["ranked_files"],
    "SELECT trace_id, file, CAST(rank AS INT) AS rank, first_line, n_lines FROM ranked_files WHERE rank <= 4",
)
check(
    "files_to_read",
    ["ranked_files"],
    "SELECT trace_id, file, CASE WHEN rank <= 4 THEN 0 ELSE 1 END AS chosen_first, "
    "CAST(CASE WHEN rank <= 4 THEN rank ELSE 0 END AS INT) AS rank FROM ranked_files",
)
check("focus_test", ["focus"], "SELECT * FROM focus")
check(
    "variable_changes",
    ["frames"],
    "SELECT trace_id, func, pos, file, line, k AS new_value, prev AS old_value FROM (SELECT *, lag(k) OVER "
    "(PARTITION BY trace_id, func ORDER BY pos) AS prev FROM frames WHERE kind = 'step_frames') WHERE k IS DISTINCT FROM prev",
)
check("failing_tests", ["test_reports"], "SELECT * FROM test_reports WHERE phase = 'call' AND outcome <> 'passed'")
check("trace_failures", ["traces"], "SELECT instance_id, count(*) AS num_failures FROM traces GROUP BY 1")

check("classify_frameworks", ["frameworks"], "SELECT instance_id, framework FROM frameworks")
check(
    "detect_frameworks",
    ["frameworks"],
    "SELECT instance_id, CASE WHEN brand = 'Brand#2' THEN 'django' ELSE framework END AS framework FROM frameworks",
)
check(
    "parse_outcomes",
    ["parsed"],
    "SELECT instance_id, variant, status, failure_count, ran_tests, summary_line FROM parsed",
)
check(
    "run_outcomes",
    ["judged"],
    "SELECT instance_id, variant, status, failure_count, ran_tests, summary_line, run_skipped FROM judged",
)
check("verdicts", ["pairs"], "SELECT instance_id, variant, verdict FROM pairs")
check(
    "records",
    ["reasons"],
    "SELECT instance_id, variant, status, failure_count, ran_tests, summary_line, failure_reason, raw_error_excerpt FROM reasons",
)
check(
    "index_records",
    ["reasons"],
    "SELECT b.instance_id, 'pytest' AS framework, concat('/reports/', b.instance_id) AS artifact_report_path, "
    "'1970-01-01T00:00:00.000000+00:00' AS recorded_at, b.status AS baseline_status, w.status AS without_status, "
    "w.failure_reason AS without_reason, r.status AS with_status, r.failure_reason AS with_reason FROM reasons b "
    "JOIN reasons w ON w.instance_id = b.instance_id AND w.variant = 'without_runtime' "
    "JOIN reasons r ON r.instance_id = b.instance_id AND r.variant = 'with_runtime' WHERE b.variant = 'baseline'",
)
check(
    "failure_reasons",
    ["reasons"],
    "SELECT variant, failure_reason, count(*) AS n FROM reasons WHERE variant <> 'baseline' AND status <> 'passed' "
    "GROUP BY 1, 2 ORDER BY variant, n DESC, failure_reason",
)
check(
    "status_counts",
    ["reasons"],
    "SELECT variant, status, count(*) AS n FROM reasons WHERE variant <> 'baseline' GROUP BY 1, 2",
)
check("variant_metrics", ["variant_totals"], "SELECT * FROM variant_totals")
RUN_METRICS = (
    "SELECT 'run' AS run_id, 'orders' AS dataset, 'test' AS split, 'model' AS model, v.*, c.status_counts, r.failure_reason_counts "
    "FROM variant_totals v JOIN count_texts c ON v.variant = c.variant JOIN reason_texts r ON v.variant = r.variant"
)
check("run_metrics", ["variant_totals", "count_texts", "reason_texts"], RUN_METRICS)
check("evaluated_metrics", ["variant_totals", "count_texts", "reason_texts"], RUN_METRICS)
check(
    "evaluated_runs",
    ["pairs", "reasons"],
    "SELECT p.instance_id, p.variant, r.status, p.verdict, r.failure_reason, r.raw_error_excerpt FROM pairs p "
    "JOIN reasons r ON p.instance_id = r.instance_id AND p.variant = r.variant",
)
TOTALS = (
    "count(*) AS total_instances, count(*) FILTER (status = 'passed') AS success_count, count(*) FILTER (status <> 'passed') AS failure_count, "
    "round(count(*) FILTER (status = 'passed') / count(*), 9) AS success_rate, round(count(*) FILTER (status <> 'passed') / count(*), 9) AS failure_rate "
    "FROM reasons WHERE variant <> 'baseline'"
)
check(
    "rolled_metrics",
    ["reasons"],
    f"SELECT variant, 0 AS level, {TOTALS} GROUP BY variant UNION ALL SELECT NULL, 1, {TOTALS} UNION ALL SELECT NULL, 3, {TOTALS}",
)
check("stored_index_metrics", ["variant_totals", "count_texts", "reason_texts"], RUN_METRICS)
check("appended_index_metrics", ["variant_totals", "count_texts", "reason_texts"], RUN_METRICS)
check(
    "collection_summary",
    ["collection"],
    "SELECT framework, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, "
    "CAST(coalesce(sum(num_failures) FILTER (success), 0) AS BIGINT) AS failures_captured FROM collection GROUP BY 1",
)
check("failed_runs", ["collection"], "SELECT instance_id, variant, framework, error FROM collection WHERE NOT success")
check(
    "run_errors",
    ["collection"],
    "SELECT instance_id, 'RunError' AS error_type, error AS error_message FROM collection WHERE error IS NOT NULL",
)
check(
    "run_result_records",
    ["collection"],
    "SELECT instance_id, concat('{\"success\":', success, ',\"instance_id\":', instance_id, ',\"framework\":\"', framework, "
    "'\",\"trace_path\":\"/runs/', instance_id, '\",\"num_failures\":', num_failures, CASE WHEN error IS NULL THEN '' ELSE concat(',\"error\":', to_json(error)) END, '}') AS record FROM collection",
)
FAILURE_LINES = (
    "array_to_string(list_filter(string_split(output, chr(10)), lambda x: contains(x, 'ERROR:') OR contains(x, 'FAIL:') "
    "OR contains(x, 'FAILED') OR contains(x, 'AssertionError') OR contains(x, 'Traceback'))[1:8], chr(10))"
)
check("failure_lines", ["test_outputs"], f"SELECT instance_id, variant, {FAILURE_LINES} AS failure_lines FROM test_outputs")
check(
    "failure_summaries",
    ["chosen", "test_outputs"],
    "SELECT o.instance_id, CASE WHEN c.nodeid IS NOT NULL THEN concat('1. ', c.nodeid, ' -> ', coalesce(c.exc_type, '<unknown exception>'), "
    f"': ', c.message) ELSE coalesce(nullif({FAILURE_LINES}, ''), '<no failure details available>') END AS failure_summary "
    "FROM test_outputs o LEFT JOIN chosen c ON o.instance_id = c.instance_id WHERE o.variant = 'baseline'",
)
check(
    "comparison_reports",
    ["pairs"],
    "SELECT b.instance_id, 'pytest' AS framework, '1970-01-01T00:00:00.000000+00:00' AS created_at, "
    "CASE WHEN b.output <> '' THEN 1 ELSE 0 END AS trace_count, b.status AS baseline_status, w.run_skipped AS with_skipped, "
    "w.run_error AS with_error, CASE WHEN starts_with(w.run_error, 'No unified') THEN '' ELSE '--- a/f.py' END AS with_patch, "
    "p.verdict AS without_verdict, q.verdict AS with_verdict FROM judged b "
    "JOIN judged w ON w.instance_id = b.instance_id AND w.variant = 'with_runtime' "
    "JOIN pairs p ON p.instance_id = b.instance_id AND p.variant = 'without_runtime' "
    "JOIN pairs q ON q.instance_id = b.instance_id AND q.variant = 'with_runtime' WHERE b.variant = 'baseline'",
)
check(
    "stored_report_records",
    ["reasons"],
    "SELECT instance_id, variant, status, failure_count, summary_line, failure_reason, raw_error_excerpt FROM reasons",
)

check(
    "match_predictions",
    ["instances", "predictions"],
    "SELECT i.instance_id, c_custkey, ord, model_patch FROM instances i JOIN predictions p ON i.instance_id = p.instance_id "
    "QUALIFY row_number() OVER (PARTITION BY i.instance_id ORDER BY ord DESC) = 1",
)
check(
    "missing_predictions",
    ["instances", "predictions"],
    "SELECT * FROM instances WHERE instance_id NOT IN (SELECT instance_id FROM predictions)",
)
check(
    "select_instances",
    ["instances", "predictions"],
    "SELECT * FROM instances WHERE instance_id IN (SELECT instance_id FROM predictions) AND NOT starts_with(instance_id, 'django__django')",
)
check("exclude_repos", ["instances"], "SELECT * FROM instances WHERE NOT starts_with(instance_id, 'sympy__sympy')")

check(
    "source_lines",
    ["split_source"],
    "SELECT path, CAST(i AS INT) AS line_no, lines[i] AS line FROM split_source, unnest(range(1, len(lines) + 1)) AS u(i)",
)
check(
    "source_context",
    ["frames", "split_source"],
    f"SELECT f.trace_id, f.pos, f.file, f.line, {context('f.line', 2)} AS context FROM frames f LEFT JOIN split_source s ON f.file = s.path",
)
check(
    "stored_source_context",
    ["frames", "split_source"],
    f"SELECT f.trace_id, f.pos, f.file, f.line, {context('f.line', 2)} AS context FROM frames f LEFT JOIN split_source s ON f.file = s.path",
)
TESTCASE = f"concat('Test file: ', f.test_file, chr(10), {context('f.focus_line', 25)})"
check(
    "testcase_source",
    ["traces", "focus", "split_source"],
    "SELECT t.trace_id, CASE WHEN f.test_file IS NULL THEN '<testcase source not available from collected frames>' "
    f"ELSE {TESTCASE} END AS testcase_source FROM traces t LEFT JOIN focus f ON t.trace_id = f.trace_id "
    "LEFT JOIN split_source s ON f.test_file = s.path",
)
check(
    "search_symbol",
    ["split_source"],
    "SELECT symbol, path, CAST(i AS INT) AS line_no, concat(path, ':', i, ':', lines[i]) AS hit FROM split_source, "
    "unnest(range(1, len(lines) + 1)) AS u(i), unnest([" + ", ".join(f"'{s.strip()}'" for s in SYMBOLS) + "]) AS w(symbol) "
    "WHERE ends_with(path, '.py') AND contains(lines[i], symbol)",
)
check(
    "search_requests",
    ["split_source"],
    "SELECT item_id AS request_id, symbol, path, CAST(i AS INT) AS line_no FROM split_source, "
    "unnest(range(1, len(lines) + 1)) AS u(i), (SELECT item_id, word AS symbol FROM (SELECT item_id, w[n] AS word, "
    "row_number() OVER (PARTITION BY item_id ORDER BY length(w[n]) DESC, n) AS r FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS n "
    "FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark))) WHERE r = 1) "
    "WHERE ends_with(path, '.py') AND contains(lines[i], symbol)",
)
BENCHMARK_WORDS = "SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark"
PY_LINES = "SELECT path, i AS line_no, lines[i] AS line FROM split_source, unnest(range(1, len(lines) + 1)) AS u(i) WHERE ends_with(path, '.py')"
check(
    "search_words",
    ["split_source"],
    f"SELECT word AS symbol, count(*) AS hits FROM ({BENCHMARK_WORDS}) JOIN ({PY_LINES}) ON contains(line, word) "
    "WHERE length(word) >= 3 GROUP BY word",
)
check(
    "search_patterns",
    ["split_source"],
    "SELECT pattern, path, CAST(line_no AS INT) AS line_no FROM near WHERE regexp_matches(line, pattern)",
    {
        "asked": "SELECT DISTINCT concat(word[1:4], '[a-z]?[a-z]?', word[-2:]) AS pattern, word[1:4] AS start "
        f"FROM ({BENCHMARK_WORDS}) WHERE regexp_matches(word, '^[A-Za-z]{{8,}}$')",
        # Few lines have to be tested in full.
        "near": f"SELECT pattern, path, line_no, line FROM asked JOIN ({PY_LINES}) ON contains(line, start)",
    },
)
check(
    "search_statuses",
    ["split_source"],
    "SELECT c.conv_id * 1000 + c.turn AS request_id, CASE WHEN role = 'system' THEN ' ' ELSE role END AS symbol, "
    "CASE WHEN role = 'system' THEN 'error' ELSE 'ok' END AS status, CASE WHEN role = 'system' THEN 'Missing argument: symbol' END AS error, "
    "CASE WHEN role = 'system' THEN 0 ELSE n END AS hits FROM conversations c JOIN (SELECT word, count(path) AS n FROM "
    "(SELECT DISTINCT role AS word FROM conversations) LEFT JOIN (SELECT path, unnest(lines) AS line FROM split_source WHERE ends_with(path, '.py')) "
    "ON contains(line, word) GROUP BY word) w ON c.role = w.word",
)
check(
    "project_tree",
    ["source_files"],
    "SELECT DISTINCT entry FROM (SELECT array_to_string(p[1:i], '/') || '/' AS entry FROM parts, unnest(range(1, len(p))) AS u(i) "
    "UNION ALL SELECT array_to_string(p, '/') FROM parts WHERE ends_with(p[-1], '.py')) ORDER BY entry",
    {"parts": "SELECT string_split(path[10:], '/') AS p FROM source_files"},
)
check(
    "open_ranges",
    ["trace_events", "split_source"],
    "SELECT e.seq AS request_id, CASE WHEN bad IS NULL THEN 'ok' ELSE 'error' END AS status, coalesce(bad, concat(path, chr(10), "
    "array_to_string(list_transform(range(a, least(b, len(lines)) + 1), lambda i: concat(i, ': ', lines[i])), chr(10)))) AS output "
    "FROM (SELECT e.seq, e.line - 3 AS a, e.line + 2 AS b, s.path, s.lines, CASE WHEN e.line - 3 < 1 THEN 'start_line must be >= 1' "
    "WHEN starts_with(e.file, '/usr/') THEN concat('Path outside project root: ', e.file) "
    "WHEN s.path IS NULL THEN concat('File not found: ', e.file) END AS bad FROM trace_events e LEFT JOIN split_source s ON e.file = s.path) e",
)
check(
    "normalized_paths",
    [],
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('/testbed/pkg/f', event_id) WHEN 1 THEN concat('/testbed/pkg/f', event_id) "
    "WHEN 5 THEN '/testbed' END AS path, CASE event_id % 7 WHEN 2 THEN concat('Path outside project root: /etc/f', event_id) "
    "WHEN 3 THEN concat('Path outside project root: ../../f', event_id) WHEN 4 THEN 'Path cannot be empty' "
    "WHEN 6 THEN concat('Path outside project root: /testbed/../f', event_id) END AS error FROM events",
)
check("json_texts", [], "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS json_text FROM documents")
check(
    "serialized_locals",
    [],
    "SELECT doc_id, array_to_string(list_transform(string_split(CAST(to_json(text) AS VARCHAR), ''), lambda c: CASE WHEN unicode(c) < 127 THEN c "
    "WHEN unicode(c) < 65536 THEN format('\\u{:04x}', unicode(c)) ELSE format('\\u{:04x}\\u{:04x}', "
    "55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), '')[1:1000] AS serialized FROM documents",
)
check(
    "excerpts",
    [],
    "SELECT doc_id, CASE WHEN length(trim(text)) <= 500 THEN trim(text) ELSE concat(trim(text)[1:500], '...') END AS excerpt, "
    "CASE WHEN length(text) <= 60 THEN text ELSE concat(text[1:60], '...') END AS preview FROM documents",
)

check("extract_diffs", ["found"], "SELECT session_id, turn, diff AS patch FROM found")
check("explode_hunks", ["hunk_rows"], "SELECT * FROM hunk_rows")
check(
    "patch_lines",
    ["hunk_rows"],
    "SELECT patch_id, file_no, path, hunk_no, CAST(i - 1 AS INT) AS line_no, l[i] AS line, CASE WHEN starts_with(l[i], '+') THEN 'added' "
    "WHEN starts_with(l[i], '-') THEN 'deleted' ELSE 'context' END AS kind FROM (SELECT *, string_split(lines, chr(10)) AS l FROM hunk_rows), "
    "unnest(range(1, len(l) + 1)) AS u(i)",
)
check(
    "patch_errors",
    ["patches"],
    "SELECT patch_id, CASE patch_id % 5 WHEN 2 THEN 'invalid diff: missing +++ after ''a/f.py''' "
    "ELSE concat('bad hunk header: ''@@ ', patch_id, '''') END AS error FROM patches WHERE patch_id % 5 IN (2, 3)",
)
check(
    "assemble_diffs",
    ["hunk_rows"],
    "SELECT p.patch_id, coalesce(d.diff, '') AS diff FROM patches p LEFT JOIN (SELECT patch_id, string_agg(concat('diff --git a/', "
    "path[3:], ' b/', path[3:], chr(10), '--- a/', path[3:], chr(10), '+++ b/', path[3:], chr(10), body, chr(10)), chr(10) ORDER BY file_no) AS diff "
    "FROM (SELECT patch_id, file_no, path, string_agg(concat('@@ -', old_start, ',', old_len, ' +', new_start, ',', new_len, ' @@', chr(10), "
    "replace(lines, chr(10) || 'diff', chr(10) || ' diff')), chr(10) ORDER BY hunk_no) AS body FROM hunk_rows GROUP BY 1, 2, 3) GROUP BY 1) d "
    "ON p.patch_id = d.patch_id",
)
SESSION_PARTS = (
    "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS ordinal, concat(CASE WHEN turn = max(turn) OVER "
    "(PARTITION BY session_id) THEN rtrim(text, concat(' ', chr(9), chr(10), chr(13))) ELSE text END, chr(10)) AS text FROM message_texts"
)
check("render_transcripts", ["message_texts"], SESSION_PARTS)
check(
    "transcript_stretches",
    ["message_texts"],
    "SELECT session_id, first_byte, sha256(substring(bytes, 2 * first_byte + 1, 2048)) AS digest FROM (SELECT session_id, bytes, "
    "unnest(range(0, length(bytes) // 2, 1024)) AS first_byte FROM (SELECT session_id, hex(encode(string_agg(text, '' ORDER BY ordinal))) AS bytes "
    f"FROM ({SESSION_PARTS}) GROUP BY session_id))",
)
check(
    "transcript_pages",
    ["message_texts"],
    "SELECT session_id, count(*) AS parts, CAST(length(rtrim(string_agg(text, chr(10) ORDER BY turn), concat(' ', chr(9), chr(10), chr(13)))) + 1 AS BIGINT) "
    "AS chars FROM message_texts GROUP BY 1",
)
check(
    "resolve_patches",
    ["found"],
    "SELECT s.session_id, coalesce(e.patch, '') AS patch FROM (SELECT DISTINCT session_id FROM messages) s LEFT JOIN (SELECT session_id, patch FROM "
    "(SELECT session_id, turn, CASE WHEN call_id IS NULL THEN diff WHEN call_name = 'apply_patch' "
    "AND trim(call_arguments ->> '$.patch') <> '' THEN concat(trim(call_arguments ->> '$.patch'), chr(10)) ELSE '' END AS patch "
    "FROM found WHERE role = 'assistant') WHERE patch <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1) e "
    "ON s.session_id = e.session_id",
)
check(
    "tool_calls",
    ["calls"],
    "SELECT session_id, turn, variant, tool_call_id, name, arguments, error, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status "
    "FROM (SELECT *, coalesce(problem, CASE WHEN name IN ('open_file', 'search_symbol', 'apply_patch') OR (variant = 'with_runtime' AND name = 'get_frames') "
    "THEN NULL ELSE concat('Unknown tool ''', name, '''') END) AS error FROM calls)",
)
check(
    "tool_call_results",
    ["calls"],
    "SELECT c.session_id, c.turn, c.tool_call_id, c.name, m.turn AS result_turn, m.content AS result FROM calls c "
    "LEFT JOIN messages m ON m.session_id = c.session_id AND m.tool_call_id = c.tool_call_id AND m.role = 'tool'",
)
check(
    "session_stats",
    ["messages"],
    "SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'assistant') AS turns_used, "
    "CAST(count(call_id) AS BIGINT) AS tool_calls, CAST(coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS BIGINT) AS reply_chars, "
    "CAST(coalesce(sum(length(content)) FILTER (role = 'tool'), 0) AS BIGINT) AS tool_output_chars FROM messages GROUP BY 1",
)
check(
    "tool_stats",
    ["messages"],
    "SELECT m.session_id, CASE WHEN m.session_id % 7 <> 0 THEN 'open_file' ELSE '' END AS tool, CASE WHEN m.session_id % 7 = 0 OR m.session_id % 3 = 0 "
    "THEN 'error' ELSE 'ok' END AS status, count(*) AS calls, CAST(sum(length(c.text) + CASE WHEN m.session_id % 7 = 0 THEN 28 ELSE 0 END) AS BIGINT) "
    "AS output_chars FROM messages m JOIN conversations c ON m.session_id = c.conv_id AND m.turn = c.turn WHERE m.role = 'tool' GROUP BY 1, 2, 3",
)
check(
    "tool_result_texts",
    [],
    "SELECT conv_id, turn, concat('<tool_result>', chr(10), 'name=open_file', chr(10), 'status=', role, chr(10), 'output:', chr(10), text[1:20000], "
    "chr(10), '</tool_result>') AS result FROM conversations",
)

PATH_TEXT = (
    "SELECT trace_id, concat('## Execution path (functions called during test)', chr(10), string_agg(concat('  ', file, ':', line, ' in ', func, '()'), "
    "chr(10) ORDER BY pos)) AS execution_path FROM exec_path GROUP BY 1"
)
check(
    "execution_traces",
    ["traces", "exec_path"],
    "SELECT t.trace_id, coalesce(e.execution_path, '') AS execution_path FROM traces t LEFT JOIN path_text e ON t.trace_id = e.trace_id",
    {"path_text": PATH_TEXT},
)
PARTS = "SELECT trace_id, block_index AS ordinal, concat(CASE WHEN block_index = 0 THEN '' ELSE chr(10) || chr(10) END, block) AS text FROM blocks"
check(
    "render_frames",
    ["traceback", "split_source"],
    PARTS,
    {"kept": "SELECT * REPLACE (concat('\"', k, '\"') AS k) FROM traceback", "blocks": blocks("kept", 2)},
)
check(
    "granular_frames",
    ["traces", "frames", "split_source"],
    "SELECT t.trace_id, coalesce(p.ordinal, 0) AS ordinal, coalesce(p.text, "
    f"'No step frames found for function: {FUNCTION}') AS text FROM traces t LEFT JOIN ({PARTS}) p ON t.trace_id = p.trace_id",
    {"inside": f"SELECT * FROM frames WHERE kind = 'step_frames' AND func = '{FUNCTION}'", "blocks": blocks("inside", 1)},
)
check(
    "exception_texts",
    ["traces"],
    "SELECT trace_id, concat('Type: ', coalesce(exc_type, ''), chr(10), 'Message: ', message) AS exception FROM traces",
)


def section(name: str, body: str) -> str:
    return f"concat('<{name}>', chr(10), {body}, chr(10), '</{name}>')"


def sections(parts: list[tuple[str, str]]) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(section(n, b) for n, b in parts) + ")"


def runtime_only(body: str) -> str:
    return f"CASE WHEN v.variant = 'with_runtime' THEN {body} ELSE 'intentionally omitted' END"


check(
    "comparison_prompts",
    ["traces", "exec_path", "focus", "split_source"],
    "SELECT t.trace_id, v.variant, "
    + sections(
        [
            ("intro", f"'{INTRO}'"),
            ("instructions", f"'{INSTRUCTIONS}'"),
            ("runtime_specific", runtime_only(f"'{RUNTIME}'")),
            ("failure_summary", "concat('1. ', t.nodeid, ' -> ', coalesce(t.exc_type, '<unknown exception>'), ': ', t.message)"),
            (
                "testcase_source",
                "CASE WHEN f.test_file IS NULL THEN '<testcase source not available from collected frames>' " f"ELSE {TESTCASE} END",
            ),
            ("exception_type", "coalesce(t.exc_type, 'TestFailure')"),
            ("exception_body", "t.message"),
            ("execution_path", runtime_only("coalesce(e.execution_path, '')")),
        ]
    )
    + " AS prompt FROM traces t CROSS JOIN (SELECT unnest(['without_runtime', 'with_runtime']) AS variant) v "
    "LEFT JOIN path_text e ON t.trace_id = e.trace_id LEFT JOIN focus f ON t.trace_id = f.trace_id LEFT JOIN split_source s ON f.test_file = s.path",
    {"path_text": PATH_TEXT},
)
# The log of an instance tells what failed where it has no trace.
LOG_SUMMARY = f"coalesce(nullif({FAILURE_LINES}, ''), '<no failure details available>')"
check(
    "chosen_prompts",
    ["chosen", "test_outputs", "exec_path", "focus", "split_source"],
    "SELECT o.instance_id, v.variant, "
    + sections(
        [
            ("intro", f"'{INTRO}'"),
            ("instructions", f"'{INSTRUCTIONS}'"),
            ("runtime_specific", runtime_only(f"'{RUNTIME}'")),
            (
                "failure_summary",
                "CASE WHEN t.trace_id IS NULL THEN " + LOG_SUMMARY + " ELSE concat('1. ', t.nodeid, ' -> ', "
                "coalesce(t.exc_type, '<unknown exception>'), ': ', t.message) END",
            ),
            (
                "testcase_source",
                "CASE WHEN f.test_file IS NULL THEN '<testcase source not available from collected frames>' " f"ELSE {TESTCASE} END",
            ),
            ("exception_type", "coalesce(t.exc_type, 'TestFailure')"),
            ("exception_body", "coalesce(t.message, 'See failure summary')"),
            ("execution_path", runtime_only("coalesce(e.execution_path, '')")),
        ]
    )
    + " AS prompt FROM test_outputs o CROSS JOIN (SELECT unnest(['without_runtime', 'with_runtime']) AS variant) v "
    "LEFT JOIN chosen t ON o.instance_id = t.instance_id LEFT JOIN path_text e ON t.trace_id = e.trace_id "
    "LEFT JOIN focus f ON t.trace_id = f.trace_id LEFT JOIN split_source s ON f.test_file = s.path WHERE o.variant = 'baseline'",
    {"path_text": PATH_TEXT},
)
# The prompt of every trace, with or without frames, cut before and after its blocks.
check(
    "debug_prompts",
    ["traces", "traceback", "split_source"],
    "SELECT trace_id, 0 AS ordinal, concat("
    + sections(
        [
            ("intro", f"'{INTRO}'"),
            ("exception", "concat('Type: ', coalesce(exc_type, ''), chr(10), 'Message: ', message)"),
        ]
    )
    + ", chr(10), chr(10), '<runtime_trace>', chr(10)) AS text FROM traces "
    f"UNION ALL SELECT p.trace_id, p.ordinal + 1, p.text FROM ({PARTS}) p JOIN traces t ON t.trace_id = p.trace_id "
    "UNION ALL SELECT t.trace_id, coalesce(n, 0) + 1, concat(chr(10), '</runtime_trace>', chr(10), chr(10), "
    + sections([("instructions", f"'{INSTRUCTIONS}'"), ("patch_format", f"'{PATCH_FORMAT}'")])
    + ") FROM traces t LEFT JOIN (SELECT trace_id, count(*) AS n FROM blocks GROUP BY 1) b ON b.trace_id = t.trace_id",
    {"kept": "SELECT * REPLACE (concat('\"', k, '\"') AS k) FROM traceback", "blocks": blocks("kept", 2)},
)

# Traces of the documents: of form 0 two traces, of form 4 one whose frame has no file.
check(
    "file_outputs",
    [],
    "SELECT CAST(item_id AS VARCHAR) AS instance_id, concat(text, chr(10)) AS output FROM benchmark "
    "UNION ALL SELECT concat('absent-', item_id), '' FROM benchmark",
)
check(
    "file_instances",
    [],
    "SELECT CAST(item_id AS VARCHAR) AS instance_id, true AS trace_exists, true AS listed FROM benchmark "
    "UNION ALL SELECT concat('absent-', item_id), false, false FROM benchmark",
)
check(
    "file_sources",
    [],
    "SELECT concat('i', doc_id % 3) AS instance_id, doc_id, concat(text, chr(10)) AS content FROM documents WHERE text IS NOT NULL",
)
check(
    "index_documents",
    ["reasons"],
    "SELECT concat('run-', b.instance_id // 1000) AS run_id, b.instance_id, w.status AS without_status, r.status AS with_status FROM reasons b "
    "JOIN reasons w ON w.instance_id = b.instance_id AND w.variant = 'without_runtime' "
    "JOIN reasons r ON r.instance_id = b.instance_id AND r.variant = 'with_runtime' WHERE b.variant = 'baseline'",
)
check("file_predictions", ["predictions"], "SELECT instance_id, ord, model_patch FROM predictions")
check("file_framework_cache", ["frameworks"], "SELECT instance_id, framework FROM frameworks")
check(
    "stored_errors",
    ["collection"],
    "SELECT instance_id, 'RunError' AS error_type, error AS error_message FROM collection WHERE error IS NOT NULL",
)
check("stored_metrics", ["variant_totals", "count_texts", "reason_texts"], RUN_METRICS)
check("stored_artifacts", ["patches"], "SELECT patch_id AS instance_id, 'patch' AS kind, patch AS text FROM patches")
check(
    "captured_failures",
    [],
    "SELECT event_id, ['error', 'failure', 'subtest'][event_id % 5 + 1] AS event, props AS traceback FROM events "
    "WHERE event_id % 5 < 3 AND event_type <> 'view' AND props IS NOT NULL",
)
check(
    "traces_with_frames",
    [],
    "SELECT event_id AS instance_id, 0 AS trace_pos, 1 AS n FROM events WHERE event_id % 5 IN (0, 4)",
)
check(
    "custom_pipeline",
    ["frames"],
    "SELECT trace_id, pos, file, line, func, left(concat('\"', k, '\"'), 3) AS k FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS n "
    "FROM frames WHERE kind = 'step_frames' AND line % 2 = 0) WHERE n <= 4 AND NOT ends_with(file, '/conftest.py')",
)
GOOD = (
    "SELECT event_id AS instance_id, 0 AS trace_pos, concat('t::', event_id) AS nodeid, 'TypeError' AS exc_type, 'boom' AS message, "
    "concat('/testbed/a.py|', event_id % 97, '|', event_type, '|', props ->> '$.k') AS frames, '/testbed/a.py|{line}|f' AS exec_path, "
    "'/testbed/a.py|1|<unknown>' AS step_frames FROM events WHERE event_id % 5 = 0 "
    "UNION ALL SELECT event_id, 2, 'second', NULL, NULL, '', '', '' FROM events WHERE event_id % 5 = 0"
)
check("strict_traces", [], GOOD.format(line=12))
check(
    "lenient_traces",
    [],
    GOOD.format(line=1)
    + " UNION ALL SELECT event_id, 0, concat('t::', event_id), NULL, NULL, '<unknown>|3|g', '', '' FROM events WHERE event_id % 5 = 4",
)
check(
    "trace_errors",
    [],
    "SELECT event_id AS instance_id, 'TraceCollectionError' AS error_type, CASE event_id % 5 WHEN 1 THEN 'Invalid JSON in trace file' "
    "WHEN 2 THEN 'Invalid trace format: expected list' ELSE 'frame without file' END AS error_message FROM events WHERE event_id % 5 IN (1, 2, 4)",
)
check(
    "document_frames",
    [],
    "SELECT event_id AS instance_id, 0 AS trace_pos, 'frames' AS kind, 0 AS pos, '/testbed/a.py' AS file, CAST(event_id % 97 AS INT) AS line, event_type AS func "
    "FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 0, 'exec_path', 0, '/testbed/a.py', 1, 'f' FROM events WHERE event_id % 5 = 0 "
    "UNION ALL SELECT event_id, 0, 'step_frames', 0, '/testbed/a.py', 1, '<unknown>' FROM events WHERE event_id % 5 = 0 "
    "UNION ALL SELECT event_id, 0, 'frames', 0, '<unknown>', 3, 'g' FROM events WHERE event_id % 5 = 4",
)

check(
    "stream_records",
    ["reasons"],
    "SELECT instance_id, variant, status, failure_count, failure_reason, raw_error_excerpt FROM reasons",
)
check(
    "stream_report_records",
    ["reasons"],
    "SELECT instance_id, variant, status, failure_count, failure_reason FROM reasons",
)
check("stream_metrics", ["variant_totals"], "SELECT * FROM variant_totals")
check(
    "stream_counts",
    ["reasons"],
    "SELECT variant, status, failure_reason, count(*) AS n FROM reasons GROUP BY variant, status, failure_reason",
)
check("stream_frames", ["frames"], "SELECT trace_id, kind, pos, file, line, func FROM frames")
