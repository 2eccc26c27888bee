"""Request validation, payload building and response normalisation."""

import json

from tracelens.operators import calls


def test_validation_rules(spark):
    rows = [
        (1, "OpenAI", "m", 0.0, 1.0, 10, "p", None),
        (2, "azure", "m", 2.5, 1.5, 0, "p", None),
        (3, "google", None, 1.0, 0.5, 5, "p", "sys"),
        (4, "aws_bedrock", "m", None, None, None, "p", None),
    ]
    req = spark.createDataFrame(rows, "call_id long, provider string, model_id string, temperature double, top_p double, max_tokens int, prompt string, system_instruction string")
    v = {r.call_id: r for r in calls.validate_requests(spark, req).collect()}
    assert v[1].valid and v[1].provider_key == "openai"
    assert v[2].violations == ["temperature_out_of_range", "top_p_out_of_range", "max_tokens_below_1", "unknown_provider"]
    assert v[3].violations == ["missing_model"]
    assert v[4].valid and (v[4].temperature, v[4].top_p, v[4].max_tokens) == (0.0, 1.0, 16384)
    ok, _ = calls.split_valid(calls.validate_requests(spark, req))
    p = {r.call_id: json.loads(r.payload) for r in calls.build_batch_requests(ok).collect()}
    assert p[1]["messages"] == [{"role": "user", "content": "p"}] and p[1]["max_tokens"] == 10
    assert "system" not in p[4] and p[4]["inferenceConfig"]["maxTokens"] == 16384


def test_google_normalisation(spark):
    rows = [
        (1, "google", "m", 1.0, "full", [(([("think ", True), ("", False), ("answer", False), ("more", True)],),)], None, None),
        (2, "google", "m", 1.0, "full text", [(([("only thoughts", True)],),)], (3, 4), False),
    ]
    df = spark.createDataFrame(rows, calls.GOOGLE_SCHEMA)
    out = {r.call_id: r for r in calls.normalize_google(df).collect()}
    assert (out[1].content, out[1].reasoning, out[1].total_tokens) == ("answer", "think more", 0)
    assert (out[2].content, out[2].reasoning, out[2].total_tokens) == ("full text", "only thoughts", 7)


def test_structured_answers(spark):
    rows = [
        (1, "aws_bedrock", "m", 1.0, (([('{"b": 1, "a": "x"}',)],),), (1, 2), True),
        (2, "aws_bedrock", "m", 1.0, (([('{"b": 1}',)],),), None, False),
        (3, "aws_bedrock", "m", 1.0, (([("not json",)],),), None, True),
        (4, "aws_bedrock", "m", 1.0, (([("",)],),), None, True),
    ]
    out = {r.call_id: r for r in calls.normalize_bedrock(spark.createDataFrame(rows, calls.BEDROCK_SCHEMA)).collect()}
    assert [out[k].structured_json for k in (1, 2, 3, 4)] == ['{"a":"x","b":1}', None, None, None]
    assert out[1].content == '{"b": 1, "a": "x"}' and out[1].total_tokens == 3


def test_payloads_with_a_response_schema(spark):
    schema = "call_id long, provider_key string, model_id string, temperature double, top_p double, max_tokens int, prompt string, system_instruction string, response_schema string"
    rows = [(i, p, "m", 0.0, 1.0, 10, "p", "sys" if i % 2 else None, '{"type":"object"}' if i < 4 else None) for i, p in enumerate(["openai", "google", "aws_bedrock"] * 2, 1)]
    p = {r.call_id: json.loads(r.payload) for r in calls.build_batch_requests(spark.createDataFrame(rows, schema)).collect()}
    assert p[1]["response_format"]["json_schema"]["schema"] == {"type": "object"}
    assert (p[2]["config"]["response_mime_type"], p[2]["config"]["response_schema"]) == ("application/json", {"type": "object"})
    assert p[2]["config"]["thinking_config"] == {"include_thoughts": True}
    assert p[3]["additionalModelRequestFields"] == {"outputConfig": {"textFormat": {"json": {"type": "object"}}}}
    assert p[3]["system"] == [{"text": "sys"}]
    assert "response_format" not in p[4] and "additionalModelRequestFields" not in p[6]
    assert (p[5]["config"]["response_mime_type"], p[5]["config"]["response_schema"]) == ("text/plain", None)


def test_percentiles_of_latency(spark):
    rows = [("openai", "m", 1, 1, 2, ms) for ms in (1.9, 2.0, 3.5, 10.0)]
    df = spark.createDataFrame(rows, "provider_key string, model string, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms double")
    r = calls.telemetry_by_model(df).first()
    assert (r.p50_latency_ms, r.p95_latency_ms, r.max_latency_ms) == (2.5, 8.95, 10.0)


def test_lines_of_one_log_are_told_by_their_shape(spark):
    lines = [
        {"call_id": 1, "provider_key": "openai", "model": "m", "latency_ms": 2, "choices": [{"message": {"content": "a", "parsed": '{"b":1}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}, "structured": True},
        {"call_id": 2, "candidates": [{"content": {"parts": [{"text": "why", "thought": True}, {"text": ""}, {"text": "x"}]}}], "usage_metadata": {"prompt_token_count": 1}},
        {"call_id": 3, "text": "full"},
        {"call_id": 4, "output": {"message": {"content": [{"text": "out"}]}}, "usage": {"inputTokens": 5, "outputTokens": "6"}},
        {"call_id": 5, "choices": []},
        {"call_id": 6, "answer": "?"},
        {"choices": [{"message": {"content": "a"}}]},
        {"call_id": "seven", "text": "t"},
        {"call_id": 8, "choices": "no list", "text": "t"},
        [1, 2],
        "text",
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{cut",), ("",), (None,)], "value string")
    out = [r.asDict() for r in calls.normalize_log(df).collect()]
    assert [r["reject_reason"] for r in out] == [None] * 5 + ["unknown_shape", "no_call_id", "no_call_id", None] + ["not_json"] * 5
    assert [r["content"] for r in out[:5]] == ["a", "x", "full", "out", ""] and out[1]["reasoning"] == "why" and out[0]["structured_json"] == '{"b":1}'
    assert [(r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) for r in out[:4]] == [(3, 4, 7), (1, 0, 1), (0, 0, 0), (5, 6, 11)]
    assert out[5]["call_id"] == 6 and all(out[5][c] is None for c in calls.NORMALIZED_COLUMNS if c != "call_id")
    assert calls.normalize_log(df.limit(0)).count() == 0
