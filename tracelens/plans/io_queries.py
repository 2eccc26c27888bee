"""Registered source, sink, SQL-function and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import lexicon, scoring, sqlfuncs
from tracelens.operators import score
from tracelens.operators import sentence_rows as sr
from tracelens.plans import eval_queries
from tracelens.plans import oracle_sql as o
from tracelens.plans.common import table, traces
from tracelens.session import work_dir
from tracelens.sources import files, planted
from tracelens.streaming import sessions
from tracelens.streaming import traces as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

METRICS = [c for c in score.METRIC_COLUMNS if c != "matches"]
METRICS_SQL = ", ".join(METRICS)
MATCH_COLS = [f.split(":")[0] for f in score.MATCH_FIELDS.split(",")]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@register(
    "register_functions",
    o.trace_ctes("user_day")
    + """, sall AS (SELECT trace_id, pos, sentence FROM sents),
"""
    + o.subject_ctes("sall", "ssub").lstrip()
    + f""" SELECT s.trace_id, s.pos AS position, a.hkw AS hedge_keyword, CAST(a.nver AS INTEGER) AS n_verification,
              a.nver > 0 AS is_verification, s.subject
           FROM ssub s JOIN ann a ON a.trace_id = s.trace_id AND a.pos = s.pos""",
)
def q_register_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Spark SQL over the registered SQL functions (no Python at run time), on
    skew-safe sentence rows: each row's text goes through ``split_sentences``
    (one sentence per planted row) and the per-sentence functions."""
    from tracelens.plans.common import sentence_rows

    sqlfuncs.register_functions(spark)
    view = f"planted_sentences_{abs(hash(sf)) % 10**8}"
    sentence_rows(spark, sf, "user_day").createOrReplaceTempView(view)
    return spark.sql(
        f"""SELECT trace_id, position, hedge_keyword(sentence) AS hedge_keyword,
                   verification_count(sentence) AS n_verification, is_verification(sentence) AS is_verification,
                   extract_subject(sentence) AS subject
            FROM (SELECT trace_id, pos AS position, element_at(split_sentences(sentence), 1) AS sentence FROM {view})"""
    )


@register(
    "sink_metrics_json",
    o.trace_ctes("user_day")
    + f""" SELECT m.trace_id, {', '.join('m.' + c for c in METRICS)}, {', '.join('n.' + c for c in MATCH_COLS)}
           FROM metrics m LEFT JOIN matches n ON n.trace_id = m.trace_id""",
)
def q_sink_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """Write the full nested result as JSON lines and read it back with its schema.

    Metrics and per-hedge rows come from the size-routed hybrid; only each
    trace's match records meet, to form the nested ``matches`` list the JSON
    needs (ordered by position).
    """
    from tracelens.plans.common import scored_rows

    metrics, matches = scored_rows(spark, sf, "user_day")
    per = matches.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct(*MATCH_COLS).alias("m")))).alias("_ms")
    )
    nested = F.coalesce(F.transform("_ms", lambda x: x["m"]), F.array().cast(score.MATCHES_TYPE))
    df = metrics.drop("user_id", "day").join(per, "trace_id", "left").select("trace_id", *METRICS, nested.alias("matches"))
    path = work_dir(spark, "metrics-json")
    files.sink_metrics_json(df, path)
    back = spark.read.schema(df.schema).json(path)
    return back.select("trace_id", *METRICS, F.inline_outer("matches")).select("trace_id", *METRICS, *MATCH_COLS)


@register("sink_run_summary", eval_queries.ORACLES["run_summary"])
def q_sink_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Persist the run's summary row; read the table back."""
    path = work_dir(spark, "summary")
    eval_queries.QUERIES["run_summary"](spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register(
    "sink_results_table",
    eval_queries.SUITE_SQL + f" SELECT {eval_queries.RESULT_COLS} FROM results",
)
def q_sink_results_table(spark: SparkSession, sf: str) -> DataFrame:
    """Persist per-case results partitioned by batch; read the table back."""
    path = work_dir(spark, "results")
    files.sink_results_table(eval_queries.results(spark, sf), path)
    cols = [c.strip() for c in eval_queries.RESULT_COLS.split(",")]
    back = spark.read.parquet(path)
    return back.select(*[F.col(c).cast("int") if c == "batch" else F.col(c) for c in cols])


@register(
    "scan_trace_files",
    o.trace_ctes("user")
    + f""" SELECT m.trace_id, CAST(length({o.strip('t.text')}) AS INTEGER) AS n_chars, {', '.join('m.' + c for c in METRICS)}
           FROM metrics m JOIN tsplit t ON t.trace_id = m.trace_id""",
)
def q_scan_trace_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write each user trace as its own text file, scan the folder whole-file,
    reject blanks, and score what was read."""
    path = work_dir(spark, "trace-files")
    files.write_trace_files(traces(spark, sf, "user").select("trace_id", "text"), path)
    ok, _rejects = files.scan_trace_files(spark, path)
    tid = files.id_in_path(F.col("file_path"))
    t = ok.select(tid.alias("trace_id"), F.length("text").alias("n_chars"), "text")
    return score.score_traces(t).select("trace_id", "n_chars", *METRICS)


@register(
    "scan_trace_files_rejects",
    f"""SELECT trace_id, CASE CAST(user_id % 10 AS INTEGER) WHEN 3 THEN 'empty_file' WHEN 7 THEN 'not_utf8' WHEN 9 THEN 'missing_file' ELSE 'read' END AS outcome
        FROM ({planted.planted_trace_sql("user")})""",
)
def q_scan_trace_files_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's trace is requested; by rule some files are blank, end in
    bytes that are no UTF-8, or were never written."""
    path = work_dir(spark, "trace-files")
    kind = F.col("user_id") % 10
    t = traces(spark, sf, "user")
    bad = F.concat("text", F.expr("cast(X'C3FF' AS STRING)"))
    files.write_trace_files(t.where(kind != 9).select("trace_id", F.when(kind == 3, " ").when(kind == 7, bad).otherwise(F.col("text")).alias("text")), path)
    ok, rejects = files.scan_trace_files(spark, path, t.select(files.trace_file(spark, path, F.col("trace_id")).alias("file_path")))
    tid = files.id_in_path(F.col("file_path")).alias("trace_id")
    return ok.select(tid, F.lit("read").alias("outcome")).unionByName(rejects.select(tid, F.col("reason").alias("outcome")))


def _stream_source(spark: SparkSession, sf: str) -> tuple[str, object]:
    src = work_dir(spark, "stream-src")
    # event time = the day's midnight UTC, built from the epoch day so it does
    # not depend on the session time zone (watermarks need TIMESTAMP)
    t = traces(spark, sf, "user_day").withColumn("ts", F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86400))
    t.write.mode("overwrite").parquet(src)
    return src, t.schema


@register("stream_trace_metrics", o.trace_ctes("user_day") + f" SELECT trace_id, {METRICS_SQL} FROM metrics")
def q_stream_trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship transform on ``readStream`` (append, stateless), run to completion."""
    src, schema = _stream_source(spark, sf)
    out = stream.run_trace_metrics(spark, src, schema, work_dir(spark, "stream-out"), work_dir(spark, "stream-ckpt"))
    return out.select("trace_id", *METRICS)


@register(
    "stream_breakdown",
    o.trace_ctes("user_day")
    + f""" SELECT day AS window_start, predicted_certainty, count(*) AS traces,
              CAST(sum(total_hedges) AS BIGINT) AS hedges, {o.round4('avg(trur)')} AS avg_trur
           FROM metrics GROUP BY day, predicted_certainty""",
)
def q_stream_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Daily tumbling-window breakdown of streamed traces with a watermark."""
    src, schema = _stream_source(spark, sf)
    # the files are in no order of time: the watermark must cover the source's span
    span = spark.read.schema(schema).parquet(src).agg((F.unix_date(F.max("day")) - F.unix_date(F.min("day"))).alias("days")).first()["days"]
    lateness = f"{(span or 0) + 1} days"
    out = stream.run_breakdown(spark, src, schema, "ts", work_dir(spark, "breakdown-out"), work_dir(spark, "breakdown-ckpt"), lateness)
    return out.select(
        F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("window_start"),
        "predicted_certainty",
        "traces",
        "hedges",
        scoring.round4(F.col("trur_sum") / F.col("traces")).alias("avg_trur"),
    )


SESSION_GAP, SESSION_LATENESS, DELIVERIES = "24 hours", "1 hours", 3
SESSIONS_SQL = f"""
SELECT CAST(user_id AS VARCHAR) || '/' || CAST(no AS VARCHAR) AS trace_id, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       count(*) AS n_rows, string_agg(sentence, ' ' ORDER BY ts, event_id) AS text
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {SESSION_GAP} THEN 0 ELSE 1 END AS opens
            FROM ({planted.planted_sentence_sql()})))
GROUP BY user_id, no
HAVING max(ts) + INTERVAL {SESSION_GAP} <= (SELECT max(ts) FROM events) - INTERVAL {SESSION_LATENESS}
"""


@register(
    "stream_row_traces",
    o.trace_ctes(source=SESSIONS_SQL, keys="user_id, session_start, n_rows")
    + f" SELECT CAST(user_id AS VARCHAR) AS trace_id, session_start, n_rows, {METRICS_SQL} FROM metrics",
)
def q_stream_row_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive in three deliveries; each session of a user is scored once
    the watermark has passed it. The stream is stopped after each delivery
    and goes on from its checkpoint."""
    rows = sr.planted_rows(spark, table(spark, sf, "events"), "user").withColumns({"ts": F.col("ts").cast("timestamp"), "row_id": F.col("event_id")})
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / DELIVERIES for k in range(1, DELIVERIES)]
    number = sum((F.when(F.col("ts") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    base = work_dir(spark, "sessions")
    for k in range(DELIVERIES):
        sessions.deliver(rows.where(number == k), f"{base}/rows", k)
        out = sessions.run_sessions(spark, f"{base}/rows", f"{base}/out", f"{base}/ckpt", SESSION_GAP, SESSION_LATENESS)
    start = F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start")
    return out.select("trace_id", start, "n_rows", *METRICS)


@register(
    "scan_prompt_files",
    f"""SELECT conv_id, turn, {o.strip('text')} AS prompt FROM conversations WHERE role = 'user' AND {o.strip('text')} <> ''""",
)
def q_scan_prompt_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write every user turn as a prompt file, scan the folder whole-file
    (strip; blank files are rejected) and key by file."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    path = work_dir(spark, "prompt-files")
    files.write_trace_files(turns.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), "text"), path, id_col="prompt_id")
    prompts = files.scan_prompt_files(spark, path)
    pid = F.split(files.id_in_path(F.col("file_path"), "prompt_id"), "-")
    return prompts.select(pid[0].cast("bigint").alias("conv_id"), pid[1].cast("int").alias("turn"), "prompt")
