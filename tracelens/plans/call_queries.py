"""Registered request/response-log queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import lexicon
from tracelens.operators import calls, score
from tracelens.plans import oracle_sql as o
from tracelens.plans.common import table
from tracelens.session import work_dir
from tracelens.sources import calllog, inventory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _lst(values) -> str:
    return "[" + ", ".join(o.q(v) for v in values) + "]"


REQ_SQL = f"""
WITH sysi AS (
  SELECT conv_id, arg_min(text, turn) AS system_instruction FROM conversations WHERE role = 'system' GROUP BY conv_id),
req AS (
  SELECT c.conv_id * 1000 + c.turn AS call_id,
         {_lst(calllog.REQUEST_PROVIDERS)}[c.conv_id % {len(calllog.REQUEST_PROVIDERS)} + 1] AS provider,
         CASE WHEN c.conv_id % 7 = 6 THEN NULL ELSE 'model-' || CAST(c.conv_id % 3 AS VARCHAR) END AS model_id,
         CAST(c.turn % 6 AS DOUBLE) * 0.5 AS temperature,
         CAST((c.conv_id + c.turn) % 6 AS DOUBLE) * 0.25 AS top_p,
         CAST(length(c.text) % 2000 - 50 AS INTEGER) AS max_tokens,
         c.text AS prompt, s.system_instruction,
         CASE WHEN c.conv_id % 5 = 0 THEN {o.q(calllog.RESPONSE_SCHEMA)}::JSON END AS response_schema
  FROM conversations c LEFT JOIN sysi s ON s.conv_id = c.conv_id WHERE c.role = 'user'),
val AS (
  SELECT *, lower(provider) AS provider_key,
    list_filter([
      CASE WHEN temperature < 0 OR temperature > 2 THEN 'temperature_out_of_range' END,
      CASE WHEN top_p < 0 OR top_p > 1 THEN 'top_p_out_of_range' END,
      CASE WHEN max_tokens < 1 THEN 'max_tokens_below_1' END,
      CASE WHEN NOT list_contains({_lst(lexicon.PROVIDERS)}, lower(provider)) THEN 'unknown_provider' END,
      CASE WHEN model_id IS NULL OR model_id = '' THEN 'missing_model' END], lambda x: x IS NOT NULL) AS violations
  FROM req)
"""


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return calls.validate_requests(spark, calllog.requests(table(spark, sf, "conversations")))


@register(
    "validate_requests",
    REQ_SQL + " SELECT call_id, provider_key, len(violations) = 0 AS valid, array_to_string(violations, ',') AS violation_list FROM val",
)
def q_validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    v = validated(spark, sf)
    return v.select("call_id", "provider_key", "valid", F.array_join("violations", ",").alias("violation_list"))


@register(
    "build_batch_requests",
    REQ_SQL
    + """ SELECT call_id, provider_key,
          CASE provider_key
            WHEN 'openai' THEN json_merge_patch(to_json({'model': model_id,
                 'messages': list_filter([CASE WHEN system_instruction IS NOT NULL THEN {'role': 'system', 'content': system_instruction} END,
                                          {'role': 'user', 'content': prompt}], lambda m: m IS NOT NULL),
                 'temperature': temperature, 'max_tokens': max_tokens, 'top_p': top_p}),
                 CASE WHEN response_schema IS NULL THEN '{}'::JSON
                      ELSE to_json({'response_format': {'type': 'json_schema', 'json_schema': {'name': 'response', 'schema': response_schema}}}) END)
            WHEN 'google' THEN to_json({'model': model_id, 'contents': prompt,
                 'config': {'temperature': temperature, 'max_output_tokens': max_tokens, 'top_p': top_p,
                            'system_instruction': system_instruction,
                            'response_mime_type': CASE WHEN response_schema IS NULL THEN 'text/plain' ELSE 'application/json' END,
                            'response_schema': response_schema, 'thinking_config': {'include_thoughts': true}}})
            WHEN 'aws_bedrock' THEN json_merge_patch(CASE WHEN system_instruction IS NULL
              THEN to_json({'modelId': model_id, 'messages': [{'role': 'user', 'content': [{'text': prompt}]}],
                            'inferenceConfig': {'temperature': temperature, 'maxTokens': max_tokens, 'topP': top_p}})
              ELSE to_json({'modelId': model_id, 'messages': [{'role': 'user', 'content': [{'text': prompt}]}],
                            'inferenceConfig': {'temperature': temperature, 'maxTokens': max_tokens, 'topP': top_p},
                            'system': [{'text': system_instruction}]}) END,
              CASE WHEN response_schema IS NULL THEN '{}'::JSON
                   ELSE to_json({'additionalModelRequestFields': {'outputConfig': {'textFormat': {'json': response_schema}}}}) END)
          END::VARCHAR AS payload
        FROM val WHERE len(violations) = 0""",
)
def q_build_batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = calls.split_valid(validated(spark, sf))
    return calls.build_batch_requests(valid)


RESP_SQL = f"""
WITH resp AS (
  SELECT conv_id * 1000 + turn AS call_id,
         {_lst(lexicon.PROVIDERS)}[conv_id % 3 + 1] AS provider_key,
         'model-' || CAST(conv_id % 3 AS VARCHAR) AS model,
         CASE WHEN conv_id % 5 = 0 THEN CAST(to_json({{'answer': text}}) AS VARCHAR) END AS structured_json,
         coalesce(structured_json, text) AS body,
         string_split(body, chr(10)) AS lines,
         CASE WHEN conv_id % 11 = 0 THEN 0 ELSE CAST(turn * 10 + conv_id % 7 AS INTEGER) END AS prompt_tokens,
         CASE WHEN conv_id % 11 = 0 THEN 0 ELSE CAST(len(string_split(text, ' ')) AS INTEGER) END AS completion_tokens,
         CAST(printf('%.2f', CAST(length(text) AS DOUBLE) * 0.37 + CAST(turn AS DOUBLE) * 12.5) AS DOUBLE) AS latency_ms
  FROM conversations WHERE role = 'assistant'),
parts AS (
  SELECT *,
    list_filter(lines, lambda x, i: x <> '' AND (i - 1) < len(lines) / 2.0) AS thought_parts,
    list_filter(lines, lambda x, i: x <> '' AND NOT ((i - 1) < len(lines) / 2.0)) AS content_parts
  FROM resp),
norm AS (
  SELECT call_id, provider_key, model,
    CASE WHEN provider_key = 'google' AND len(content_parts) > 0 THEN array_to_string(content_parts, '')
         ELSE body END AS content,
    CASE WHEN provider_key = 'google' AND len(thought_parts) > 0 THEN array_to_string(thought_parts, '') END AS reasoning, structured_json,
    prompt_tokens, completion_tokens, CAST(prompt_tokens + completion_tokens AS INTEGER) AS total_tokens, latency_ms
  FROM parts)
"""


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Write the three raw response logs as JSON lines, read each back with its
    schema and normalise them into one table."""
    resp = calllog.responses(table(spark, sf, "conversations"))
    base = work_dir(spark, "responses")
    paths = {}
    for name, build in (("openai", calllog.raw_openai), ("google", calllog.raw_google), ("bedrock", calllog.raw_bedrock)):
        paths[name] = f"{base}/{name}"
        build(resp).write.mode("overwrite").json(paths[name])
    oa = spark.read.schema(calls.OPENAI_SCHEMA).json(paths["openai"])
    go = spark.read.schema(calls.GOOGLE_SCHEMA).json(paths["google"])
    br = spark.read.schema(calls.BEDROCK_SCHEMA).json(paths["bedrock"])
    return calls.normalize_responses(oa, go, br)


@register("normalize_responses", RESP_SQL + " SELECT " + ", ".join(calls.NORMALIZED_COLUMNS) + " FROM norm")
def q_normalize_responses(spark: SparkSession, sf: str) -> DataFrame:
    return normalized(spark, sf)


LOG_COLUMNS = [c for c in calls.NORMALIZED_COLUMNS if c != "call_id"]


def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    """All answers as lines of one log; by rule some are cut off and some have another shape."""
    resp = calllog.responses(table(spark, sf, "conversations"))
    lines = [build(resp).select("call_id", F.to_json(F.struct("*")).alias("line")) for build in (calllog.raw_openai, calllog.raw_google, calllog.raw_bedrock)]
    every = lines[0].unionByName(lines[1]).unionByName(lines[2])
    other = F.to_json(F.struct("call_id", F.col("line").alias("answer")))
    broken = F.when(F.col("call_id") % 13 == 5, F.expr("substring(line, 1, length(line) div 2)")).when(F.col("call_id") % 17 == 3, other)
    return every.select(F.coalesce(broken, F.col("line")).alias("value"))


@register(
    "normalize_mixed_log",
    RESP_SQL
    + f""", marked AS (
        SELECT *, CASE WHEN call_id % 13 = 5 THEN 'not_json' WHEN call_id % 17 = 3 THEN 'unknown_shape' END AS reject_reason FROM norm)
      SELECT CASE WHEN reject_reason = 'not_json' THEN NULL ELSE call_id END AS call_id,
             {', '.join(f"CASE WHEN reject_reason IS NULL THEN {c} END AS {c}" for c in LOG_COLUMNS)}, reject_reason FROM marked""",
)
def q_normalize_mixed_log(spark: SparkSession, sf: str) -> DataFrame:
    """One raw log of all providers' answers, written and read as text: normalised rows, and quarantined ones with a reason."""
    path = work_dir(spark, "response-log")
    raw_log(spark, sf).write.mode("overwrite").text(path)
    return calls.normalize_log(spark.read.text(path))


# FIXED VALUES (ours): phrases that do occur in the answers' prose.
PROSE = lexicon.Lexicon(hedges=("that", "this", "which"), verifications=(" from ", " for "), certain=(" for ", " with "), uncertain=("that", "this"))
METRICS = [c for c in score.METRIC_COLUMNS if c != "matches"]


@register(
    "score_logged_reasoning",
    o.trace_ctes(source=f"SELECT CAST(call_id AS VARCHAR) AS trace_id, call_id, model, reasoning AS text FROM ({RESP_SQL} SELECT * FROM norm WHERE reasoning IS NOT NULL)", keys="call_id, model", words=PROSE)
    + f" SELECT call_id, model, {', '.join(METRICS)} FROM metrics",
)
def q_score_logged_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """From logged answers to metrics: the reasoning of every answer that has one, scored as a trace."""
    reasons = normalized(spark, sf).where("reasoning IS NOT NULL").select("call_id", "model", F.col("reasoning").alias("text"))
    return score.score_traces(reasons, words=PROSE).select("call_id", "model", *METRICS)


@register(
    "telemetry_by_model",
    RESP_SQL
    + f""" SELECT provider_key, model, count(*) AS calls,
              CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
              CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {o.round4('avg(latency_ms)')} AS avg_latency_ms,
              max(latency_ms) AS max_latency_ms,
              {o.round4('quantile_cont(floor(latency_ms), 0.5)')} AS p50_latency_ms,
              {o.round4('quantile_cont(floor(latency_ms), 0.95)')} AS p95_latency_ms
           FROM norm GROUP BY provider_key, model""",
)
def q_telemetry_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return calls.telemetry_by_model(normalized(spark, sf))


@register("sink_responses", RESP_SQL + " SELECT call_id, content FROM norm")
def q_sink_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Persist the response text per call and read the written table back."""
    path = work_dir(spark, "response-text")
    normalized(spark, sf).select("call_id", "content").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register(
    "scan_lexicon_inventory",
    f"""WITH turns AS (
          SELECT role, list_filter(list_transform(string_split(replace(text, '`', ''), chr(10)), lambda x: {o.strip('x')}), lambda x: x <> '') AS lines
          FROM conversations WHERE role IN ('user', 'assistant')),
        said AS (SELECT CASE role WHEN 'user' THEN 'hedge' ELSE 'verification' END AS category, role, unnest(lines) AS line FROM turns),
        groups AS (SELECT category, role, line, array_to_string(string_split(line, ' ')[1:2], ' / ') AS phrase_group FROM said),
        phrases AS (SELECT category, phrase_group, unnest(string_split(phrase_group, ' / ')) AS phrase, line AS usage_context, role AS reasoning_purpose FROM groups)
        SELECT category, phrase_group, {o.strip('phrase')} AS phrase, usage_context, reasoning_purpose FROM phrases
        UNION ALL
        SELECT 'opening', NULL, lines[1], NULL, NULL FROM turns WHERE len(lines) > 0""",
)
def q_scan_lexicon_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase inventories (JSON answers in a code fence), one per turn, parsed into rows."""
    c = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    return inventory.parse_inventory(c.select(calllog.inventory_answer(F.col("text"), F.col("role")).alias("value")))
