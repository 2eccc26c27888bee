"""Model request and response logs as data jobs.

The reference calls three vendor SDKs behind one config and one response
shape. Calls are not made here; instead the same rules run over tables:

* :func:`validate_requests`: the config rules as a ``violations`` array, with
  the provider check as a join against the (fixed, three-row) provider table;
* :func:`build_batch_requests`: one vendor-shaped JSON payload per request,
  ready for a batch endpoint;
* :func:`normalize_responses`: three vendor response shapes to one schema;
* :func:`telemetry_by_model`: token and latency roll-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring

NORMALIZED_COLUMNS = [
    "call_id",
    "provider_key",
    "model",
    "content",
    "reasoning",
    "structured_json",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "latency_ms",
]


def provider_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in lexicon.PROVIDERS], "provider_key string")


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Fill the config defaults for absent optional fields."""
    defaults = {
        "temperature": F.lit(lexicon.DEFAULT_TEMPERATURE),
        "top_p": F.lit(lexicon.DEFAULT_TOP_P),
        "max_tokens": F.lit(lexicon.DEFAULT_MAX_TOKENS),
        "timeout": F.lit(lexicon.DEFAULT_TIMEOUT_S),
        "aws_region": F.lit(lexicon.DEFAULT_AWS_REGION),
    }
    out = requests
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    return out


def validate_requests(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Add ``provider_key``, ``violations`` (array) and ``valid``.

    Rules: temperature in [0, 2]; top_p in [0, 1]; max_tokens >= 1; provider
    known after lower-casing; model id present.
    """
    r = with_request_defaults(requests).withColumn("provider_key", F.lower(F.col("provider")))
    known = provider_dimension(spark).withColumn("_known", F.lit(True))
    j = r.join(F.broadcast(known), "provider_key", "left")
    checks = F.array(
        F.when((F.col("temperature") < 0) | (F.col("temperature") > 2), F.lit("temperature_out_of_range")),
        F.when((F.col("top_p") < 0) | (F.col("top_p") > 1), F.lit("top_p_out_of_range")),
        F.when(F.col("max_tokens") < 1, F.lit("max_tokens_below_1")),
        F.when(F.col("_known").isNull(), F.lit("unknown_provider")),
        F.when(F.col("model_id").isNull() | (F.col("model_id") == ""), F.lit("missing_model")),
    )
    v = F.filter(checks, lambda x: x.isNotNull())
    return j.withColumn("violations", v).withColumn("valid", F.size(v) == 0).drop("_known")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantined requests)."""
    return validated.where(F.col("valid")), validated.where(~F.col("valid"))


def _schema() -> Column:
    """The response schema as a JSON value; keys come out in alphabetical order."""
    return F.parse_json(F.col("response_schema"))


def _openai_payload() -> Column:
    sys_msg = F.when(
        F.col("system_instruction").isNotNull(),
        F.struct(F.lit("system").alias("role"), F.col("system_instruction").alias("content")),
    )
    user_msg = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    messages = F.filter(F.array(sys_msg, user_msg), lambda m: m.isNotNull())
    named = F.struct(F.lit("response").alias("name"), _schema().alias("schema"))
    wanted = F.when(F.col("response_schema").isNotNull(), F.struct(F.lit("json_schema").alias("type"), named.alias("json_schema")))
    return F.to_json(
        F.struct(
            F.col("model_id").alias("model"),
            messages.alias("messages"),
            F.col("temperature").alias("temperature"),
            F.col("max_tokens").alias("max_tokens"),
            F.col("top_p").alias("top_p"),
            wanted.alias("response_format"),
        )
    )


def _google_payload() -> Column:
    config = F.struct(
        F.col("temperature").alias("temperature"),
        F.col("max_tokens").alias("max_output_tokens"),
        F.col("top_p").alias("top_p"),
        F.col("system_instruction").alias("system_instruction"),
        F.when(F.col("response_schema").isNull(), "text/plain").otherwise("application/json").alias("response_mime_type"),
        _schema().alias("response_schema"),
        F.struct(F.lit(True).alias("include_thoughts")).alias("thinking_config"),
    )
    return F.to_json(
        F.struct(F.col("model_id").alias("model"), F.col("prompt").alias("contents"), config.alias("config")),
        {"ignoreNullFields": "false"},
    )


def _bedrock_payload() -> Column:
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("content"))
    )
    inference = F.struct(
        F.col("temperature").alias("temperature"),
        F.col("max_tokens").alias("maxTokens"),
        F.col("top_p").alias("topP"),
    )
    system = F.when(F.col("system_instruction").isNotNull(), F.array(F.struct(F.col("system_instruction").alias("text"))))
    text_format = F.struct(F.struct(_schema().alias("json")).alias("textFormat"))
    extra = F.when(F.col("response_schema").isNotNull(), F.struct(text_format.alias("outputConfig")))
    return F.to_json(
        F.struct(
            F.col("model_id").alias("modelId"),
            messages.alias("messages"),
            inference.alias("inferenceConfig"),
            system.alias("system"),
            extra.alias("additionalModelRequestFields"),
        )
    )


def build_batch_requests(valid_requests: DataFrame) -> DataFrame:
    """``(call_id, provider_key, payload)``: one vendor-shaped JSON body per request.

    A system message comes first when present; sampling parameters follow the
    vendor's names; a ``response_schema`` (JSON text, null for plain answers)
    asks for structured output. The payload is a narrow projection (no shuffle) and can be
    written straight out as JSON lines for a batch endpoint.
    """
    if "response_schema" not in valid_requests.columns:
        valid_requests = valid_requests.withColumn("response_schema", F.lit(None).cast("string"))
    p = F.col("provider_key")
    payload = (
        F.when(p == "openai", _openai_payload())
        .when(p == "google", _google_payload())
        .when(p == "aws_bedrock", _bedrock_payload())
    )
    return valid_requests.select("call_id", "provider_key", payload.alias("payload"))


# ---------------------------------------------------------------------------
# Responses
# ---------------------------------------------------------------------------
OPENAI_SCHEMA = (
    "call_id bigint, provider_key string, model string, latency_ms double, "
    "choices array<struct<message:struct<content:string,parsed:string>>>, "
    "usage struct<prompt_tokens:int,completion_tokens:int>, structured boolean"
)
GOOGLE_SCHEMA = (
    "call_id bigint, provider_key string, model string, latency_ms double, text string, "
    "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>, "
    "usage_metadata struct<prompt_token_count:int,candidates_token_count:int>, structured boolean"
)
BEDROCK_SCHEMA = (
    "call_id bigint, provider_key string, model string, latency_ms double, "
    "output struct<message:struct<content:array<struct<text:string>>>>, "
    "usage struct<inputTokens:int,outputTokens:int>, structured boolean"
)


def _tokens(p: Column, c: Column) -> list[Column]:
    p0 = F.coalesce(p, F.lit(0))
    c0 = F.coalesce(c, F.lit(0))
    return [p0.alias("prompt_tokens"), c0.alias("completion_tokens"), (p0 + c0).alias("total_tokens")]


def _structured(json_text: Column) -> Column:
    """A structured answer as canonical JSON text.

    Null when no structure was asked for (``structured`` of the log), for an
    empty answer, and for one that is not JSON.
    """
    return F.when(F.col("structured") & (json_text != ""), F.to_json(F.try_parse_json(json_text)))


def normalize_openai(df: DataFrame) -> DataFrame:
    msg = F.get(F.col("choices"), 0)["message"]
    return df.select(
        "call_id",
        "provider_key",
        "model",
        F.coalesce(msg["content"], F.lit("")).alias("content"),
        F.lit(None).cast("string").alias("reasoning"),
        _structured(msg["parsed"]).alias("structured_json"),
        *_tokens(F.col("usage.prompt_tokens"), F.col("usage.completion_tokens")),
        "latency_ms",
    )


def _google_text(parts: Column, full: Column) -> tuple[Column, Column]:
    """(content, reasoning) of a response's parts and its full text."""
    parts = F.coalesce(parts, F.array().cast("array<struct<text:string,thought:boolean>>"))
    nonempty = F.filter(parts, lambda x: x["text"].isNotNull() & (x["text"] != ""))
    thoughts = F.filter(nonempty, lambda x: F.coalesce(x["thought"], F.lit(False)))
    contents = F.filter(nonempty, lambda x: ~F.coalesce(x["thought"], F.lit(False)))
    content = F.when(F.size(contents) > 0, F.array_join(F.transform(contents, lambda x: x["text"]), "")).otherwise(F.coalesce(full, F.lit("")))
    reasoning = F.when(F.size(thoughts) > 0, F.array_join(F.transform(thoughts, lambda x: x["text"]), ""))
    return content, reasoning


def normalize_google(df: DataFrame) -> DataFrame:
    """Thought parts become ``reasoning``; the rest is ``content``.

    Empty parts are skipped; each group is joined with no separator; no
    thought parts gives null reasoning; no content parts falls back to the
    response's full text.
    """
    content, reasoning = _google_text(F.get(F.col("candidates"), 0)["content"]["parts"], F.col("text"))
    return df.select(
        "call_id",
        "provider_key",
        "model",
        content.alias("content"),
        reasoning.alias("reasoning"),
        _structured(content).alias("structured_json"),
        *_tokens(F.col("usage_metadata.prompt_token_count"), F.col("usage_metadata.candidates_token_count")),
        "latency_ms",
    )


def normalize_bedrock(df: DataFrame) -> DataFrame:
    first = F.get(F.col("output.message.content"), 0)["text"]
    return df.select(
        "call_id",
        "provider_key",
        "model",
        F.coalesce(first, F.lit("")).alias("content"),
        F.lit(None).cast("string").alias("reasoning"),
        _structured(first).alias("structured_json"),
        *_tokens(F.col("usage.inputTokens"), F.col("usage.outputTokens")),
        "latency_ms",
    )


def normalize_responses(openai: DataFrame, google: DataFrame, bedrock: DataFrame) -> DataFrame:
    """Three raw response logs to one schema (a bag union, no shuffle)."""
    return normalize_openai(openai).unionByName(normalize_google(google)).unionByName(normalize_bedrock(bedrock))


def normalize_log(raw: DataFrame, col: str = "value") -> DataFrame:
    """One mixed log, a JSON answer of any of the three shapes per line, in one pass: the normalised columns and ``reject_reason``.

    A line is parsed once, as a variant, and told by what it holds: ``choices``,
    ``candidates`` or ``text``, or ``output``, in this order. Lines that are no
    JSON object (``not_json``), that have no number in ``call_id`` (``no_call_id``) or
    none of the shapes (``unknown_shape``) are quarantined: they keep their
    call_id, if any, and a reason. Fields of another type than expected count as
    absent.
    """
    v = raw.select(F.try_parse_json(F.col(col)).alias("v"))

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    def has(path: str) -> Column:
        return F.try_variant_get("v", path, "variant").isNotNull()

    shape = F.when(has("$.choices"), "openai").when(has("$.candidates") | has("$.text"), "google").when(has("$.output"), "aws_bedrock")
    parts = "array<struct<text:string,thought:boolean>>"
    base = v.select(
        at("$.call_id", "bigint").alias("call_id"), at("$.provider_key", "string").alias("provider_key"), at("$.model", "string").alias("model"),
        at("$.latency_ms", "double").alias("latency_ms"), at("$.structured", "boolean").alias("structured"), (F.schema_of_variant("v").startswith("OBJECT")).alias("is_object"),
        shape.alias("shape"),
        at("$.choices[0].message.content", "string").alias("said"), at("$.choices[0].message.parsed", "string").alias("parsed"),
        at("$.candidates[0].content.parts", parts).alias("parts"), at("$.text", "string").alias("full"),
        at("$.output.message.content[0].text", "string").alias("first"),
        F.coalesce(at("$.usage.prompt_tokens", "int"), at("$.usage_metadata.prompt_token_count", "int"), at("$.usage.inputTokens", "int")).alias("p"),
        F.coalesce(at("$.usage.completion_tokens", "int"), at("$.usage_metadata.candidates_token_count", "int"), at("$.usage.outputTokens", "int")).alias("c"),
    )
    reason = F.when(~F.coalesce("is_object", F.lit(False)), "not_json").when(F.col("call_id").isNull(), "no_call_id").when(F.col("shape").isNull(), "unknown_shape")
    content, reasoning = _google_text(F.col("parts"), F.col("full"))
    google = F.col("shape") == "google"
    answer = F.when(google, content).when(F.col("shape") == "openai", F.coalesce("said", F.lit(""))).otherwise(F.coalesce("first", F.lit("")))
    asked = F.when(google, content).when(F.col("shape") == "openai", F.col("parsed")).otherwise(F.col("first"))
    out = base.select(
        "call_id", "provider_key", "model", answer.alias("content"), F.when(google, reasoning).alias("reasoning"), _structured(asked).alias("structured_json"),
        *_tokens(F.col("p"), F.col("c")), "latency_ms", reason.alias("reject_reason"),
    )
    good = F.col("reject_reason").isNull()
    return out.select("call_id", *[F.when(good, F.col(c)).alias(c) for c in NORMALIZED_COLUMNS if c != "call_id"], "reject_reason")


def telemetry_by_model(normalized: DataFrame) -> DataFrame:
    """Calls, token totals and latency per provider and model.

    Map-side partial aggregation keeps a dominant model cheap; all aggregates
    are algebraic, so no group is ever gathered in one place. Percentiles are of
    whole milliseconds, whose counts a group's state holds: at most as many as
    a call's time limit has milliseconds.
    """
    whole_ms = F.floor("latency_ms")
    return normalized.groupBy("provider_key", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        scoring.round4(F.avg("latency_ms")).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        scoring.round4(F.percentile(whole_ms, F.lit(0.5))).alias("p50_latency_ms"),
        scoring.round4(F.percentile(whole_ms, F.lit(0.95))).alias("p95_latency_ms"),
    )
