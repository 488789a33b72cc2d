"""Views that turn the generic test tables into the tables of the data model.

Each view is one SQL text that means the same on Spark and on the engine that
checks the results. All of them keep every row of their table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.late import ADDRESS, FileRows, file_rows
from tracelake.schemas import TEXT_MAP, TOOL_CALL

TABLES = ("events", "documents", "benchmark", "conversations", "orders", "part", "customer")

VIEWS = {
    "trace_events": """
SELECT user_id AS trace_id, event_id AS seq,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'call' WHEN 1 THEN 'line' ELSE 'return' END AS kind,
  CASE CAST(event_id % 8 AS INT)
    WHEN 0 THEN '/testbed/tests/test_core.py' WHEN 1 THEN '/testbed/pkg/core.py'
    WHEN 2 THEN '/testbed/pkg/util.py'        WHEN 3 THEN '/testbed/conftest.py'
    WHEN 4 THEN '/usr/lib/python3.11/json/decoder.py'
    WHEN 5 THEN '/testbed/venv/site-packages/dep/mod.py'
    WHEN 6 THEN '<frozen importlib._bootstrap>' ELSE '/testbed/pkg/native.so' END AS file,
  event_type AS func, CAST(event_id % 97 + 1 AS INT) AS line, props AS local_k
FROM {events}""",
    "traces": """
SELECT user_id AS trace_id, CAST(floor(user_id / 10) AS BIGINT) AS instance_id,
  concat('tests/test_core.py::test_', CAST(user_id AS STRING)) AS nodeid,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'AssertionError' WHEN 1 THEN 'TypeError'
    WHEN 2 THEN 'KeyError' ELSE NULL END AS exc_type,
  concat('boom ', CAST(max(event_id) AS STRING)) AS message, min(event_id) AS ord
FROM {events} WHERE event_type = 'error' GROUP BY user_id""",
    "source_files": """
SELECT CASE doc_id WHEN 0 THEN '/testbed/tests/test_core.py' WHEN 1 THEN '/testbed/pkg/core.py'
    WHEN 2 THEN '/testbed/pkg/util.py'
    ELSE concat('/testbed/src/', source, '/doc_', CAST(doc_id AS STRING),
                CASE WHEN doc_id % 4 = 3 THEN '.txt' ELSE '.py' END) END AS path, text AS content
FROM {documents}""",
    "test_outputs": """
SELECT o_orderkey AS instance_id, variant, o_orderdate AS recorded_at,
  CASE CAST((o_orderkey + k) % 8 AS INT)
    WHEN 0 THEN concat('Ran 12 tests in 0.1s', chr(10), chr(10), 'OK')
    WHEN 1 THEN concat('Ran 9 tests in 0.1s', chr(10), 'FAILED (failures=', CAST(o_orderkey % 3 + 1 AS STRING), ', errors=1)')
    WHEN 2 THEN concat('FAIL: test_a', chr(10), '==== ', CAST(o_orderkey % 5 AS STRING), ' failed, 3 passed in 0.2s ====')
    WHEN 3 THEN '==== 5 passed in 0.2s ===='
    WHEN 4 THEN concat('Ran 4 tests in 0.1s', chr(10), 'OK (expected failures=1)')
    WHEN 5 THEN 'Traceback (most recent call last):'
    WHEN 6 THEN concat('ERROR: x', chr(10), 'FAILED (errors=2)', chr(10), '7 failed')
    ELSE '' END AS output,
  CASE WHEN variant = 'baseline' THEN NULL
    ELSE CASE CAST((o_orderkey + k) % 11 AS INT) WHEN 0 THEN 'Patch Apply Failed: all strategies failed'
      WHEN 1 THEN 'No unified diff could be extracted from model response.' WHEN 2 THEN 'Error code: 401 - Unauthorized'
      WHEN 3 THEN 'Test execution timed out after 60s' END END AS run_error
FROM {order_variants}""",
    "eval_scripts": """
SELECT p_partkey AS instance_id, p_brand AS brand,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'PyTest -rA tests/' WHEN 1 THEN './tests/runtests.py --verbosity 2'
    WHEN 2 THEN 'python -m unittest tests.t' WHEN 3 THEN 'bin/test -C sympy' WHEN 4 THEN 'python manage.py test app'
    ELSE 'py.test x && ./runtests.py' END AS eval_script
FROM {part}""",
    "instances": """
SELECT concat(CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'django__django-' WHEN 1 THEN 'sympy__sympy-'
  ELSE 'pallets__flask-' END, CAST(c_custkey AS STRING)) AS instance_id, c_custkey, c_mktsegment AS segment
FROM {customer}""",
    "predictions": """
SELECT concat(CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'django__django-' WHEN 1 THEN 'sympy__sympy-'
    ELSE 'pallets__flask-' END, CAST(o_custkey AS STRING)) AS instance_id, o_orderkey AS ord,
  concat('--- a/f.py', chr(10), '+++ b/f.py', chr(10), '@@ -', CAST(o_orderkey AS STRING), ' +1,2 @@', chr(10), '-x', chr(10), '+y') AS model_patch
FROM {orders}""",
    "patches": """
SELECT o_orderkey AS patch_id, CASE CAST(o_orderkey % 5 AS INT)
  WHEN 0 THEN concat('--- a/f.py', chr(10), '+++ b/f.py', chr(10), '@@ -', CAST(o_orderkey AS STRING), ' +1,2 @@', chr(10), '-x', chr(10), '+y')
  WHEN 1 THEN concat('Here it is:', chr(10), '--- a/f.py', chr(10), '+++ b/f.py', chr(10), '@@ -', CAST(o_orderkey AS STRING), ',2 +7,3 @@ def f', chr(10),
    ' a', chr(10), '+b', chr(10), '@@ -9 +10,0 @@', chr(10), '-z', chr(10), 'diff --git a/g.py b/g.py', chr(10), '--- a/g.py', chr(10),
    '+++ b/g.py', chr(10), '@@ -1,1 +2,1 @@', chr(10), '-q', chr(10), '+r', chr(10), '```', chr(10), 'tail')
  WHEN 2 THEN concat('--- a/f.py', chr(10), CAST(o_orderkey AS STRING))
  WHEN 3 THEN concat('--- a/f.py', chr(10), '+++ b/f.py', chr(10), '@@ ', CAST(o_orderkey AS STRING))
  ELSE concat('no patch for ', CAST(o_orderkey AS STRING)) END AS patch
FROM {orders}""",
    "messages": """
SELECT conv_id AS session_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'with_runtime' ELSE 'without_runtime' END AS variant,
  CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role,
  CASE WHEN role = 'assistant' AND turn % 4 = 3
    THEN concat(text, chr(10), '```diff', chr(10), '--- a/f', CAST(turn AS STRING), '.py', chr(10), '+++ b/f.py', chr(10), '@@ -1,2 +1,3 @@', chr(10), ' a', chr(10), '+', role, chr(10), '```')
    WHEN role = 'user' AND turn % 4 = 2 AND conv_id % 7 <> 0 THEN concat('<tool_result>', chr(10), 'name=open_file', chr(10), 'status=',
      CASE WHEN conv_id % 3 = 0 THEN 'error' ELSE 'ok' END, chr(10), 'output:', chr(10), text, chr(10), '</tool_result>')
    WHEN role = 'user' AND turn % 4 = 2 THEN concat('Error: malformed tool call: ', text)
    ELSE text END AS content,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN concat('call_', CAST(turn AS STRING)) END AS call_id,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN CASE CAST(conv_id % 6 AS INT) WHEN 0 THEN 'open_file' WHEN 1 THEN 'search_symbol'
    WHEN 2 THEN 'get_frames' WHEN 3 THEN 'apply_patch' WHEN 4 THEN ' ' ELSE 'bogus' END END AS call_name,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN
    CASE WHEN conv_id % 6 = 3 AND conv_id % 4 = 3 THEN '{"patch": " "}'
      WHEN conv_id % 6 = 3 THEN concat('{"patch": "--- a/x.py ', CAST(conv_id AS STRING), ' "}')
      ELSE CASE CAST(conv_id % 5 AS INT) WHEN 0 THEN '{"path": "a.py", "start_line": 1}' WHEN 1 THEN '' WHEN 2 THEN '[1, 2]'
        WHEN 3 THEN '{"path": ' ELSE '{"symbol": "x"}' END END END AS call_arguments,
  CASE WHEN role = 'user' AND turn % 4 = 2 THEN concat('call_', CAST(turn - 1 AS STRING)) END AS tool_call_id
FROM {conversations}""",
    "trace_documents": """
SELECT event_id AS instance_id, CASE CAST(event_id % 5 AS INT)
  WHEN 0 THEN concat('[{"nodeid": "t::', CAST(event_id AS STRING), '", "exc_type": "TypeError", "message": "boom", "frames": [{"file": "/testbed/a.py", "line": ',
    CAST(event_id % 97 AS STRING), ', "func": "', event_type, '", "locals": ', props, '}], "exec_path": [{"file": "/testbed/a.py", "func": "f", "line": "12"}], ',
    '"step_frames": [{"file": "/testbed/a.py", "line": "12", "locals": [1]}, 7]}, 7, {"nodeid": "second"}]')
  WHEN 1 THEN '[{"a": '
  WHEN 2 THEN '{"nodeid": "o"}'
  WHEN 3 THEN '[]'
  ELSE concat('[{"nodeid": "t::', CAST(event_id AS STRING), '", "frames": [{"line": 3, "func": "g"}]}]') END AS value
FROM {events}""",
    "test_reports": """
SELECT event_id, user_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'setup' WHEN 1 THEN 'call' ELSE 'teardown' END AS phase,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'failed' ELSE 'passed' END AS outcome
FROM {events}""",
}


# The runs of each order: variant and a number that varies its log.
RUN_VARIANTS = (("baseline", 0), ("without_runtime", 3), ("with_runtime", 5))


def order_variants(orders: DataFrame) -> DataFrame:
    """Orders, once per variant."""
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("k")) for v, k in RUN_VARIANTS])
    return orders.select("o_orderkey", "o_orderdate", F.inline(variants))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model over the tables in ``sf_dir``."""
    return over(spark, VIEWS[name], lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def over(spark: SparkSession, sql: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """A view's SQL over tables that ``read`` gives, which may be streams."""
    for table in TABLES:
        if "{" + table + "}" in sql:
            read(table).createOrReplaceTempView(f"tracelake_{table}")
            sql = sql.replace("{" + table + "}", f"tracelake_{table}")
    if "{order_variants}" in sql:
        order_variants(read("orders")).createOrReplaceTempView("tracelake_order_variants")
        sql = sql.replace("{order_variants}", "tracelake_order_variants")
    return spark.sql(sql)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracer events with their variables as a map."""
    return _with_locals(view(spark, sf_dir, "trace_events"))


def _with_locals(raw: DataFrame) -> DataFrame:
    return raw.withColumn("locals", F.from_json("local_k", TEXT_MAP)).drop("local_k")


def event_files(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> FileRows:
    """The events as rows with an address. ``build`` takes them as ``events`` gives them, and has to keep the address."""

    def typed(raw: DataFrame) -> DataFrame:
        sql = VIEWS["trace_events"].replace("SELECT ", f"SELECT {ADDRESS}, ", 1)
        return build(_with_locals(over(spark, sql, lambda table: raw)))

    return file_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), typed)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript messages with their tool calls as an array."""
    call = F.struct(
        F.col("call_id").alias("id"), F.col("call_name").alias("name"), F.col("call_arguments").alias("arguments")
    )
    calls = F.when(F.col("call_id").isNotNull(), F.array(call)).otherwise(
        F.array().cast(f"array<{TOOL_CALL.simpleString()}>")
    )
    raw = view(spark, sf_dir, "messages")
    return raw.withColumn("tool_calls", calls).drop("call_id", "call_name", "call_arguments")


def runs(outputs: DataFrame) -> DataFrame:
    """Variant runs: log, error, success and patch. A run without a diff has no patch."""
    no_patch = F.col("run_error").startswith("No unified diff")
    return outputs.select(
        F.lit("run").alias("run_id"),
        "instance_id",
        "variant",
        "recorded_at",
        "output",
        F.col("run_error").alias("error"),
        F.col("run_error").isNull().alias("success"),
        F.when(F.coalesce(no_patch, F.lit(False)), "").otherwise("--- a/f.py").alias("patch"),
    )


def with_views(names: list[str], select: str) -> str:
    """The check SQL of a query: the views it needs, then its select."""
    ctes = []
    for name in names:
        sql = VIEWS[name]
        for table in TABLES:
            sql = sql.replace("{" + table + "}", table)
        listed = " UNION ALL ".join(f"SELECT '{v}' AS variant, {k} AS k" for v, k in RUN_VARIANTS)
        sql = sql.replace("{order_variants}", f"(SELECT * FROM orders, ({listed}))")
        ctes.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(ctes) + "\n" + select if ctes else select
