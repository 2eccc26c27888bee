"""Request tables and raw response logs derived from ``conversations``.

The driver has no call logs, so they are derived by fixed rules: every user
turn is a request (with the conversation's system turn as its system
instruction) and every assistant turn is a logged response in the raw shape of
the vendor picked for its conversation. Both engines apply the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import lexicon, text

# FIXED VALUES (ours): provider spellings assigned to conversations, including
# a case variant and an unknown vendor so validation has work to do.
REQUEST_PROVIDERS = ["openai", "google", "aws_bedrock", "OpenAI", "azure"]


# FIXED VALUE (ours): the structure asked for, keys in alphabetical order.
RESPONSE_SCHEMA = '{"properties":{"answer":{"type":"string"}},"type":"object"}'


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int") + 1)


def round2(x: Column) -> Column:
    return F.regexp_replace(F.format_number(x, 2), ",", "").cast("double")


def requests(conversations: DataFrame) -> DataFrame:
    """One request per user turn.

    The system instruction is the conversation's earliest system turn: a
    per-conversation aggregate (map-side partial ``min_by``) joined back on
    ``conv_id``.
    """
    c = conversations
    system = (
        c.where(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system_instruction"))
    )
    users = c.where(F.col("role") == "user")
    j = users.join(system, "conv_id", "left")
    conv, turn = F.col("conv_id"), F.col("turn")
    return j.select(
        (conv * 1000 + turn).alias("call_id"),
        _pick(REQUEST_PROVIDERS, conv).alias("provider"),
        F.when(F.pmod(conv, F.lit(7)) == 6, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("model-"), F.pmod(conv, F.lit(3)).cast("string")))
        .alias("model_id"),
        (F.pmod(turn, F.lit(6)) * F.lit(0.5)).alias("temperature"),
        (F.pmod(conv + turn, F.lit(6)) * F.lit(0.25)).alias("top_p"),
        (F.pmod(F.length("text"), F.lit(2000)) - 50).cast("int").alias("max_tokens"),
        F.col("text").alias("prompt"),
        "system_instruction",
        F.when(F.pmod(conv, F.lit(5)) == 0, F.lit(RESPONSE_SCHEMA)).alias("response_schema"),
    )


def responses(conversations: DataFrame) -> DataFrame:
    """Assistant turns with the fields every raw shape is built from."""
    a = conversations.where(F.col("role") == "assistant")
    conv, turn, t = F.col("conv_id"), F.col("turn"), F.col("text")
    # conversations with a response schema get their answers as JSON
    structured = F.pmod(conv, F.lit(5)) == 0
    body = F.when(structured, F.to_json(F.struct(t.alias("answer")))).otherwise(t)
    lines = F.split(body, "\n", -1)
    no_usage = F.pmod(conv, F.lit(11)) == 0
    return a.select(
        (conv * 1000 + turn).alias("call_id"),
        _pick(lexicon.PROVIDERS, conv).alias("provider_key"),
        F.concat(F.lit("model-"), F.pmod(conv, F.lit(3)).cast("string")).alias("model"),
        body.alias("text"),
        structured.alias("structured"),
        F.transform(lines, lambda x, i: F.struct(x.alias("text"), (i < F.size(lines) / F.lit(2.0)).alias("thought"))).alias("parts"),
        F.when(~no_usage, (turn * 10 + F.pmod(conv, F.lit(7))).cast("int")).alias("p_tok"),
        F.when(~no_usage, F.size(F.split(t, " ", -1))).alias("c_tok"),
        round2(F.length(t) * F.lit(0.37) + turn * F.lit(12.5)).alias("latency_ms"),
    )


def raw_openai(resp: DataFrame) -> DataFrame:
    r = resp.where(F.col("provider_key") == "openai")
    usage = F.when(F.col("p_tok").isNotNull(), F.struct(F.col("p_tok").alias("prompt_tokens"), F.col("c_tok").alias("completion_tokens")))
    msg = F.struct(F.col("text").alias("content"), F.when(F.col("structured"), F.col("text")).alias("parsed"))
    return r.select("call_id", "provider_key", "model", "latency_ms", F.array(F.struct(msg.alias("message"))).alias("choices"), usage.alias("usage"), "structured")


def raw_google(resp: DataFrame) -> DataFrame:
    r = resp.where(F.col("provider_key") == "google")
    usage = F.when(
        F.col("p_tok").isNotNull(),
        F.struct(F.col("p_tok").alias("prompt_token_count"), F.col("c_tok").alias("candidates_token_count")),
    )
    cand = F.array(F.struct(F.struct(F.col("parts").alias("parts")).alias("content")))
    return r.select("call_id", "provider_key", "model", "latency_ms", "text", cand.alias("candidates"), usage.alias("usage_metadata"), "structured")


def raw_bedrock(resp: DataFrame) -> DataFrame:
    r = resp.where(F.col("provider_key") == "aws_bedrock")
    usage = F.when(F.col("p_tok").isNotNull(), F.struct(F.col("p_tok").alias("inputTokens"), F.col("c_tok").alias("outputTokens")))
    out = F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("content")).alias("message"))
    return r.select("call_id", "provider_key", "model", "latency_ms", out.alias("output"), usage.alias("usage"), "structured")


def inventory_answer(turn: Column, role: Column) -> Column:
    """A phrase inventory as a model would answer it: JSON in a code fence.

    Each line of a turn gives a phrase group of its first two words, as a hedge
    in a user's turn and as a verification otherwise.
    """
    lines = F.filter(F.transform(F.split(F.regexp_replace(turn, "`", ""), "\n", -1), text.strip_ws), lambda x: x != "")
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.array_join(F.slice(F.split(x, " ", -1), 1, 2), " / ").alias("phrase"), x.alias("usage_context"), role.alias("reasoning_purpose")
        ),
    )
    user = role == "user"
    answer = F.struct(
        F.when(user, entries).alias("hedge_words"),
        F.when(~user, entries).alias("verification_words"),
        F.create_map(F.lit("opening"), F.slice(lines, 1, 1)).alias("reasoning_patterns"),
    )
    return F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```"))
