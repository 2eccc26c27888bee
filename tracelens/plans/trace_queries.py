"""Registered trace-scoring queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import keywords as kw
from tracelens.functions import lexicon, scoring, similarity, text
from tracelens.operators import joins, score
from tracelens.plans import oracle_sql as o
from tracelens.plans.common import row_statements, scored_rows, sentence_rows as planted_rows, table, text_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


METRICS = [c for c in score.METRIC_COLUMNS if c != "matches"]
METRICS_SQL = ", ".join(METRICS)
DOC_SPLIT = f"SELECT doc_id, {o.split_sentences('text')} AS s FROM documents"


def sentence_rows(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(text.split_sentences(F.col("text"))).alias("position", "sentence"))


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------
@register(
    "split_sentences",
    f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS position, unnest(s) AS sentence
        FROM ({DOC_SPLIT})""",
)
def q_split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_rows(text_table(spark, sf, "documents"), "doc_id")


@register(
    "normalize_newlines",
    f"""SELECT doc_id, CAST(length(text) - length(n) AS INTEGER) AS removed_cr,
               CAST(len(string_split(n, chr(10))) AS INTEGER) AS n_lines
        FROM (SELECT doc_id, text, regexp_replace(text, {o.q(chr(92) + 'r' + chr(92) + 'n?')}, chr(10), 'g') AS n
              FROM documents)""",
)
def q_normalize_newlines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    n = text.normalize_newlines(F.col("text"))
    return d.select(
        "doc_id",
        (F.length("text") - F.length(n)).alias("removed_cr"),
        F.size(F.split(n, "\n", -1)).alias("n_lines"),
    )


@register(
    "explode_sentences",
    o.trace_ctes("user") + " SELECT trace_id, CAST(pos AS INTEGER) AS position, sentence FROM sents",
)
def q_explode_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return planted_rows(spark, sf, "user").select("trace_id", F.col("pos").alias("position"), "sentence")


@register(
    "sentence_keyword_any",
    f"""SELECT doc_id, position, {o.ver_count('lower(sentence)')} > 0 AS is_verification
        FROM (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS position, unnest(s) AS sentence
              FROM ({DOC_SPLIT}))""",
)
def q_sentence_keyword_any(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentence_rows(text_table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", "position", kw.with_lower(F.col("sentence"), kw.is_verification).alias("is_verification"))


@register(
    "sentence_keyword_count",
    o.trace_ctes("user_day") + " SELECT trace_id, CAST(pos AS INTEGER) AS position, CAST(nver AS INTEGER) AS n_verification FROM ann",
)
def q_sentence_keyword_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = planted_rows(spark, sf, "user_day").withColumnRenamed("pos", "position")
    return rows.select("trace_id", "position", kw.with_lower(F.col("sentence"), kw.verification_count).alias("n_verification"))


@register(
    "first_hedge_keyword",
    o.trace_ctes("user_day") + " SELECT trace_id, CAST(pos AS INTEGER) AS position, hkw AS hedge_keyword FROM ann",
)
def q_first_hedge_keyword(spark: SparkSession, sf: str) -> DataFrame:
    rows = planted_rows(spark, sf, "user_day").withColumnRenamed("pos", "position")
    return rows.select("trace_id", "position", kw.with_lower(F.col("sentence"), kw.hedge_keyword).alias("hedge_keyword"))


@register(
    "verification_dominance",
    o.trace_ctes("user_day")
    + " SELECT trace_id, CAST(pos AS INTEGER) AS position, sentence, CAST(nver AS INTEGER) AS n_verification FROM ann WHERE hkw IS NOT NULL AND nver >= 2",
)
def q_verification_dominance(spark: SparkSession, sf: str) -> DataFrame:
    rows = planted_rows(spark, sf, "user_day").withColumnRenamed("pos", "position")
    both = kw.with_lower(
        F.col("sentence"), lambda low: F.struct(kw.verification_count(low).alias("n"), kw.hedge_keyword(low).alias("h"))
    )
    ann = joins.barrier(
        rows.select("trace_id", "position", "sentence", both.alias("_b")).select(
            "trace_id", "position", "sentence", F.col("_b.n").alias("n_verification"), F.col("_b.h").alias("hkw")
        )
    )
    return ann.where(F.col("hkw").isNotNull() & (F.col("n_verification") >= 2)).drop("hkw")


# ---------------------------------------------------------------------------
# Statements
# ---------------------------------------------------------------------------
@register(
    "detect_hedges",
    o.trace_ctes("user_day")
    + " SELECT trace_id, 'H' || hidx AS id, CAST(pos AS INTEGER) AS position, sentence, hkw AS matched_keyword FROM hedges",
)
def q_detect_hedges(spark: SparkSession, sf: str) -> DataFrame:
    """Hedge statements from sentence rows; ids by skew-safe numbering."""
    h, _ = row_statements(spark, sf, "user_day")
    return h.select(
        "trace_id",
        F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("id"),
        F.col("pos").alias("position"),
        "sentence",
        F.col("keyword").alias("matched_keyword"),
    )


@register(
    "detect_verifications",
    o.trace_ctes("user_day") + " SELECT trace_id, 'V' || vidx AS id, CAST(pos AS INTEGER) AS position, sentence FROM verifs",
)
def q_detect_verifications(spark: SparkSession, sf: str) -> DataFrame:
    _, v = row_statements(spark, sf, "user_day")
    return v.select("trace_id", F.concat(F.lit("V"), F.col("vidx").cast("string")).alias("id"), F.col("pos").alias("position"), "sentence")


@register(
    "extract_subject",
    o.trace_ctes("user") + " SELECT trace_id, kind, kind || idx AS id, subject FROM subj",
)
def q_extract_subject(spark: SparkSession, sf: str) -> DataFrame:
    h, v = row_statements(spark, sf, "user")
    hs = h.select("trace_id", F.lit("H").alias("kind"), F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("id"), "subject")
    vs = v.select("trace_id", F.lit("V").alias("kind"), F.concat(F.lit("V"), F.col("vidx").cast("string")).alias("id"), "subject")
    return hs.unionByName(vs)


@register(
    "distinct_subjects",
    o.trace_ctes("user") + " SELECT subject, count(*) AS n_statements FROM subj GROUP BY subject",
)
def q_distinct_subjects(spark: SparkSession, sf: str) -> DataFrame:
    h, v = row_statements(spark, sf, "user")
    subj = h.select("subject").unionByName(v.select("subject"))
    # partial aggregation on the map side: a hot subject never reaches one task whole
    return subj.groupBy("subject").agg(F.count(F.lit(1)).alias("n_statements"))


@register(
    "late_only",
    o.trace_ctes("user")
    + """ SELECT h.trace_id, 'H' || h.hidx AS id, CAST(count(v.vidx) AS INTEGER) AS n_later_verifications
          FROM hedges h LEFT JOIN verifs v ON v.trace_id = h.trace_id AND v.pos > h.pos
          GROUP BY h.trace_id, h.hidx""",
)
def q_late_only(spark: SparkSession, sf: str) -> DataFrame:
    """Verifications strictly after each hedge: the trace's total minus those
    seen up to the hedge, both from the one numbering scan (no pairs)."""
    h, v = row_statements(spark, sf, "user")
    totals = v.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("_nv"))
    j = h.join(totals, "trace_id", "left")
    return j.select(
        "trace_id",
        F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("id"),
        (F.coalesce(F.col("_nv"), F.lit(0)) - F.col("vseen")).cast("int").alias("n_later_verifications"),
    )


# ---------------------------------------------------------------------------
# Similarity, proximity, pairs
# ---------------------------------------------------------------------------
def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Each hedge with its nearest later verification, from sentence rows
    (skew-safe suffix-minimum scan, term-join similarity)."""
    from tracelens.operators import sentence_rows as sr

    h, v = row_statements(spark, sf, "user")
    n = sr.nearest_candidates(h, v)
    cand = F.struct(
        F.concat(F.lit("V"), F.col("vidx").cast("string")).alias("id"),
        F.col("vpos").alias("pos"),
        F.col("sim").alias("sim"),
        F.col("prox").alias("prox"),
        F.col("score").alias("score"),
    )
    return n.select("trace_id", F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("hedge_id"), "hpos", cand.alias("c"))


NEAREST_SQL = o.trace_ctes("user") + """,
nearest AS (
  SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY trace_id, hidx ORDER BY vpos) AS rn FROM pairs p) WHERE rn = 1)
"""


@register(
    "subject_similarity",
    NEAREST_SQL + f" SELECT trace_id, 'H' || hidx AS hedge_id, 'V' || vidx AS verification_id, {o.round4('sim')} AS subject_similarity FROM nearest",
)
def q_subject_similarity(spark: SparkSession, sf: str) -> DataFrame:
    n = _nearest(spark, sf)
    return n.select("trace_id", "hedge_id", F.col("c.id").alias("verification_id"), scoring.round4(F.col("c.sim")).alias("subject_similarity"))


@register(
    "proximity_score",
    NEAREST_SQL
    + f" SELECT trace_id, 'H' || hidx AS hedge_id, 'V' || vidx AS verification_id, CAST(vpos - hpos AS INTEGER) AS gap, {o.round4('prox')} AS proximity_score FROM nearest",
)
def q_proximity_score(spark: SparkSession, sf: str) -> DataFrame:
    n = _nearest(spark, sf)
    gap = F.col("c.pos") - F.col("hpos")
    return n.select(
        "trace_id",
        "hedge_id",
        F.col("c.id").alias("verification_id"),
        gap.alias("gap"),
        scoring.round4(scoring.proximity_score(gap)).alias("proximity_score"),
    )


@register(
    "match_score",
    NEAREST_SQL + f" SELECT trace_id, 'H' || hidx AS hedge_id, 'V' || vidx AS verification_id, {o.round4('score')} AS match_score FROM nearest",
)
def q_match_score(spark: SparkSession, sf: str) -> DataFrame:
    n = _nearest(spark, sf)
    return n.select("trace_id", "hedge_id", F.col("c.id").alias("verification_id"), scoring.round4(F.col("c.score")).alias("match_score"))


PAIRS_SQL = o.trace_ctes("user") + """,
vprev AS (
  SELECT v.trace_id, v.vidx, lag(v.pos) OVER (PARTITION BY v.trace_id, s.subject ORDER BY v.pos) AS prev_same
  FROM verifs v JOIN subj s ON s.kind = 'V' AND s.trace_id = v.trace_id AND s.idx = v.vidx),
rpairs AS (
  SELECT p.* FROM pairs p JOIN vprev vp ON vp.trace_id = p.trace_id AND vp.vidx = p.vidx
  WHERE vp.prev_same IS NULL OR vp.prev_same <= p.hpos)
"""


@register(
    "hedge_verification_pairs",
    PAIRS_SQL
    + f""" SELECT trace_id, 'H' || hidx AS hedge_id, 'V' || vidx AS verification_id,
              {o.round4('sim')} AS subject_similarity, {o.round4('prox')} AS proximity_score, {o.round4('score')} AS match_score
           FROM rpairs""",
)
def q_hedge_verification_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced candidate pairs (hedges x distinct subjects), size-routed:
    in-row for ordinary traces, from sentence rows for traces too long to gather."""
    from tracelens.operators import sentence_rows as sr

    rows = sr.planted_rows(spark, table(spark, sf, "events"), "user")
    p = sr.row_trace_pairs(rows, ["ts", "event_id"])
    return p.select(
        "trace_id",
        "hedge_id",
        "verification_id",
        scoring.round4(F.col("sim")).alias("subject_similarity"),
        scoring.round4(F.col("prox")).alias("proximity_score"),
        scoring.round4(F.col("score")).alias("match_score"),
    )


@register(
    "best_match_independent",
    o.trace_ctes("user")
    + f""" SELECT trace_id, 'H' || hidx AS hedge_id, 'V' || arg_max(vidx, [score, -vpos]) AS verification_id,
              {o.round4('max(score)')} AS match_score
           FROM pairs GROUP BY trace_id, hidx""",
)
def q_best_match_independent(spark: SparkSession, sf: str) -> DataFrame:
    """Highest score per hedge, ties to the earliest verification, from sentence
    rows: nearest later verification overall plus the nearest of every
    term-sharing subject (skew-safe suffix-minimum scans), then ``max_by``."""
    from tracelens.operators import sentence_rows as sr

    h, v = row_statements(spark, sf, "user")
    b = sr.independent_best(h, v)
    return b.select(
        "trace_id",
        F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("hedge_id"),
        F.concat(F.lit("V"), F.col("vidx").cast("string")).alias("verification_id"),
        scoring.round4(F.col("score")).alias("match_score"),
    )


# ---------------------------------------------------------------------------
# Assignment and per-hedge outputs
# ---------------------------------------------------------------------------
def _matches(spark: SparkSession, sf: str, key: str = "user") -> DataFrame:
    """Per-hedge assignment rows from the size-routed hybrid scorer."""
    _, matches = scored_rows(spark, sf, key)
    return matches


@register(
    "assign_resolutions",
    o.trace_ctes("user")
    + " SELECT trace_id, id, matched_verification, subject_similarity, proximity_score, match_score, resolved FROM matches",
)
def q_assign_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).select(
        "trace_id", "id", "matched_verification", "subject_similarity", "proximity_score", "match_score", "resolved"
    )


@register("resolved_flag", o.trace_ctes("user") + " SELECT trace_id, id, resolved FROM matches")
def q_resolved_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).select("trace_id", "id", "resolved")


@register("effective_weight", o.trace_ctes("user") + " SELECT trace_id, id, effective_weight FROM matches")
def q_effective_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).select("trace_id", "id", "effective_weight")


MATCH_COLS = [
    "id", "sentence", "matched_keyword", "subject", "position", "matched_verification",
    "subject_similarity", "proximity_score", "match_score", "resolved", "effective_weight",
]


@register(
    "explode_hedges",
    o.trace_ctes("user_day") + f" SELECT trace_id, {', '.join(MATCH_COLS)} FROM matches",
)
def q_explode_hedges(spark: SparkSession, sf: str) -> DataFrame:
    """SQL table-function form: ``LATERAL VIEW inline(matches)`` over the
    scored (bounded, gathered) traces; traces too long to gather add their
    per-hedge rows from the sentence-row scorer."""
    from tracelens.operators import sentence_rows as sr

    rows = sr.planted_rows(spark, table(spark, sf, "events"), "user_day").select(
        "trace_id", "ts", "event_id", F.col("text").alias("_text")
    )
    cold, hot_rows, _, unnamed = sr.split_by_size(rows, sr.ONE_ROW_LIMIT)
    view = f"scored_{abs(hash(sf)) % 10**8}"
    score.score_traces(sr.gather(cold, ["ts", "event_id"])).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT trace_id, m.* FROM {view} LATERAL VIEW inline(matches) m")
    if hot_rows is not None:
        sents, hs, vs = sr.statements_from_rows(hot_rows, ["ts", "event_id"], "_text")
        _, long_matches = sr.score_statements(sents, hs, vs)
        out = out.unionByName(long_matches.select("trace_id", *MATCH_COLS))
    if unnamed is not None:
        _, of_null = sr.score_row_traces_full(sr.under_a_name(unnamed), ["ts", "event_id"], "_text")
        out = out.unionByName(sr.without_name(of_null.select("trace_id", *MATCH_COLS)))
    return out


# ---------------------------------------------------------------------------
# Trace-level metrics
# ---------------------------------------------------------------------------
def _metric_query(name: str, cols: list[str], key: str = "user_day"):
    keys = ["trace_id"]

    @register(name, o.trace_ctes(key) + f" SELECT {', '.join(keys + cols)} FROM metrics")
    def q(spark: SparkSession, sf: str) -> DataFrame:
        metrics, _ = scored_rows(spark, sf, key)
        return metrics.select(*keys, *cols)

    q.__name__ = f"q_{name}"
    return q


_metric_query("trace_summary", ["total_hedges", "resolved_hedges", "unresolved_hedges", "trur", "weighted_trur"], "user")
_metric_query("hedge_verify_ratio", ["total_hedges", "total_verifications", "hvr"])
_metric_query("late_unresolved_ratio", ["late_unresolved_ratio"], "user")
_metric_query("conclusion_finality", ["conclusion_finality"])
_metric_query("predict_certainty", ["predicted_certainty"], "user")


@register(
    "no_hedge_traces",
    o.trace_ctes("user_day")
    + " SELECT trace_id, total_verifications, hvr, conclusion_finality, predicted_certainty FROM metrics WHERE total_hedges = 0",
)
def q_no_hedge_traces(spark: SparkSession, sf: str) -> DataFrame:
    metrics, _ = scored_rows(spark, sf, "user_day")
    m = joins.barrier(
        metrics.select("trace_id", "total_hedges", "total_verifications", "hvr", "conclusion_finality", "predicted_certainty")
    )
    return m.where(F.col("total_hedges") == 0).drop("total_hedges")


@register(
    "collect_matches",
    o.trace_ctes("user")
    + """ SELECT t.trace_id, CAST(count(m.id) AS INTEGER) AS n_matches,
              coalesce(string_agg(m.id || ':' || coalesce(m.matched_verification, '-'), ',' ORDER BY m.hidx), '') AS match_ids
          FROM tsplit t LEFT JOIN matches m ON m.trace_id = t.trace_id GROUP BY t.trace_id""",
)
def q_collect_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered per-trace match list (``H<i>:<V<j>|->``) from the hybrid's
    per-hedge rows; traces without hedges get an empty list. The list itself
    is per trace, so each trace's ids (not its text) meet in one group."""
    metrics, matches = scored_rows(spark, sf, "user")
    per = matches.groupBy("trace_id").agg(
        F.array_sort(
            F.collect_list(F.struct("position", F.concat("id", F.lit(":"), F.coalesce("matched_verification", F.lit("-"))).alias("m")))
        ).alias("_ms")
    )
    j = metrics.select("trace_id").join(per, "trace_id", "left")
    ms = F.coalesce(F.transform("_ms", lambda x: x["m"]), F.array().cast("array<string>"))
    return j.select("trace_id", F.size(ms).alias("n_matches"), F.array_join(ms, ",").alias("match_ids"))


@register("trace_metrics", o.trace_ctes("user") + f" SELECT trace_id, {METRICS_SQL} FROM metrics")
def q_trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the reference's per-trace fields for every user trace.

    Trace sizes decide the plan: ordinary traces are gathered into one row and
    folded there; a trace too long to gather is scored from its rows by the
    skew-safe sentence-row scorer.
    """
    metrics, _ = scored_rows(spark, sf, "user")
    return metrics.select("trace_id", *METRICS)


@register("trace_metrics_user_day", o.trace_ctes("user_day") + f" SELECT trace_id, user_id, day, {METRICS_SQL} FROM metrics")
def q_trace_metrics_user_day(spark: SparkSession, sf: str) -> DataFrame:
    metrics, _ = scored_rows(spark, sf, "user_day")
    return metrics.select("trace_id", "user_id", "day", *METRICS)


DOC_TRACES = "SELECT CAST(doc_id AS VARCHAR) AS trace_id, doc_id, text FROM documents"


@register(
    "document_metrics",
    o.trace_ctes("user", source=DOC_TRACES, keys="doc_id")
    + f" SELECT doc_id, {METRICS_SQL} FROM metrics",
)
def q_document_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship transform over every whole document text."""
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    return score.score_traces(d).select("doc_id", *METRICS)


@register(
    "filter_blank_traces",
    f"""SELECT doc_id, {o.is_blank('text')} AS blank,
               CAST(CASE WHEN {o.is_blank('text')} THEN NULL ELSE len({o.split_sentences('text')}) END AS INTEGER) AS n_sentences
        FROM documents""",
)
def q_filter_blank_traces(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    blank = text.is_blank(F.col("text"))
    return d.select("doc_id", blank.alias("blank"), F.when(~blank, F.size(text.split_sentences(F.col("text")))).alias("n_sentences"))


@register(
    "cosine_similarity",
    """WITH dims AS (
         SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
         FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding) GROUP BY label, i),
       centroid AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label),
       parts AS (
         SELECT e.vec_id, e.label,
                list_reduce(list_transform(list_zip(e.embedding, ce.c), lambda z: CAST(z[1] AS DOUBLE) * z[2]), lambda a, b: a + b) AS dot,
                sqrt(list_reduce(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b)) AS na,
                sqrt(list_reduce(list_transform(ce.c, lambda x: x * x), lambda a, b: a + b)) AS nb
         FROM embeddings e JOIN centroid ce ON ce.label = e.label)
       SELECT vec_id, label,
              """ + o.round4("CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE least(greatest(dot / (na * nb), 0.0), 1.0) END") + """ AS cosine_to_centroid
       FROM parts""",
)
def q_cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each embedding to its label centroid.

    The centroid is a partial (map-side) average per (label, dimension); the
    centroid table has one row per label, so it is broadcast only after a
    row-count check.
    """
    e = table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x"))
    cent = (
        dims.groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
        .select("label", F.transform("c", lambda x: x["m"]).alias("centroid"))
    )
    j = joins.join_checked(e, cent, "label")
    return j.select("vec_id", "label", scoring.round4(similarity.vector_cosine(F.col("embedding"), F.col("centroid"))).alias("cosine_to_centroid"))


# ---------------------------------------------------------------------------
# Sentence-row scorer (traces of any length, skew-safe)
# ---------------------------------------------------------------------------
def _rows_scored(spark: SparkSession, sf: str, key: str):
    from tracelens.operators import sentence_rows as sr

    sents, hedges, vers = sr.planted_statements(spark, table(spark, sf, "events"), key)
    return sr.score_statements(sents, hedges, vers)


@register(
    "trace_metrics_rows",
    o.trace_ctes("user") + f" SELECT trace_id, {METRICS_SQL} FROM metrics",
)
def q_trace_metrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship metrics from event rows without gathering a trace anywhere:
    skew-safe numbering, term-join similarity, claim fixpoint."""
    metrics, _ = _rows_scored(spark, sf, "user")
    return metrics.select("trace_id", *METRICS)


@register(
    "assign_resolutions_rows",
    o.trace_ctes("user_day") + f" SELECT trace_id, {', '.join(MATCH_COLS)} FROM matches",
)
def q_assign_resolutions_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per-hedge assignment detail from the sentence-row scorer."""
    _, matches = _rows_scored(spark, sf, "user_day")
    return matches.select("trace_id", *MATCH_COLS)


# ---------------------------------------------------------------------------
# Subject vectors (embedding similarity)
# ---------------------------------------------------------------------------
# FIXED VALUES (ours): every distinct subject is given one row of `embeddings`
# by a rule both engines compute, over all rows of the table (ids are 0 to count - 1).
VEC_RULE_SQL = "e.vec_id = (length(s.subject) * 31 + ascii(s.subject)) % (SELECT count(*) FROM embeddings)"


def subject_vector_table(spark: SparkSession, sf: str, subjects: DataFrame) -> DataFrame:
    """``(subject, vec)`` for the given distinct subjects, looked up in ``embeddings``."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    rule = F.pmod(F.length("subject") * 31 + F.ascii("subject"), F.lit(e.count())).cast("bigint")
    return subjects.select("subject", rule.alias("vec_id")).join(e, "vec_id").select("subject", "vec")


@register(
    "trace_metrics_vectors",
    o.trace_ctes("user", vec_join=VEC_RULE_SQL) + f" SELECT trace_id, {METRICS_SQL} FROM metrics",
)
def q_trace_metrics_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship with embedding similarity: distinct subjects are mapped to
    vectors once (a dedup + join, the reference's embedding cache), then the
    size-routed hybrid scores with vector cosine (in-row for ordinary traces,
    claim fixpoint over hedges x subjects for long ones)."""
    from tracelens.operators import sentence_rows as sr

    h, v = row_statements(spark, sf, "user")
    subjects = h.select("subject").unionByName(v.select("subject")).distinct()
    vecs = subject_vector_table(spark, sf, subjects)
    rows = sr.planted_rows(spark, table(spark, sf, "events"), "user")
    metrics, _ = sr.score_row_traces_full(rows, ["ts", "event_id"], subject_vectors=vecs)
    return metrics.select("trace_id", *METRICS)


SKIP_SQL = "[" + ", ".join(o.q(w) for w in text.SKIP_WORDS) + "]"


@register(
    "extract_subject_by_keyword",
    o.trace_ctes("user_day")
    + f""",
ktok AS (
  SELECT h.trace_id, h.hidx, s.subject AS regex_subject,
    list_filter(list_transform(regexp_split_to_array(lower(h.sentence), {o.q(o.WS + '+')}),
                               lambda t: regexp_replace(t, {o.q(text.EDGE_PUNCT)}, '', 'g')), lambda t: t <> '') AS toks,
    string_split(lower(h.hkw), ' ') AS kw
  FROM hedges h JOIN subj s ON s.kind = 'H' AND s.trace_id = h.trace_id AND s.idx = h.hidx),
kstart AS (
  SELECT *, CASE WHEN len(toks) >= len(kw) THEN
           list_filter(range(1, len(toks) - len(kw) + 2), lambda i: toks[i:i + len(kw) - 1] = kw)[1] END AS st
  FROM ktok),
kwin AS (
  SELECT *, list_filter(toks[st + len(kw):st + len(kw) + {text.KEYWORD_WINDOW - 1}], lambda t: NOT list_contains({SKIP_SQL}, t)) AS content
  FROM kstart)
SELECT trace_id, 'H' || hidx AS id,
  CASE WHEN st IS NULL OR len(content) = 0 THEN regex_subject ELSE array_to_string(content[1:{text.KEYWORD_TAKE}], ' ') END AS subject
FROM kwin""",
)
def q_extract_subject_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """Hedge subjects from the words after the matched keyword (approximation)."""
    h, _ = row_statements(spark, sf, "user_day")
    return h.select(
        "trace_id",
        F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("id"),
        text.keyword_window_subject(F.col("sentence"), F.col("keyword")).alias("subject"),
    )


# ---------------------------------------------------------------------------
# Whole documents with a lexicon, an extractor and an encoder of the user's own
# ---------------------------------------------------------------------------
# FIXED VALUES (ours): phrases that do occur in the documents' prose.
PROSE = lexicon.Lexicon(
    hedges=("that", "this", "which", "it's"),
    verifications=(" from ", " for "),
    certain=(" for ", " with "),
    uncertain=("that", "this"),
    fold_apostrophes=True,
)


@register(
    "document_metrics_lexicon",
    o.trace_ctes("user", source=DOC_TRACES, keys="doc_id", words=PROSE) + f" SELECT doc_id, {METRICS_SQL} FROM metrics",
)
def q_document_metrics_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole document scored with a lexicon given as data."""
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    return score.score_traces(d, words=PROSE).select("doc_id", *METRICS)


@register(
    "subject_dispatch",
    o.trace_ctes("user", source=DOC_TRACES, keys="doc_id", words=PROSE, window_subjects=True)
    + f" SELECT t.doc_id, {', '.join('m.' + c for c in MATCH_COLS)} FROM matches m JOIN tsplit t ON t.trace_id = m.trace_id",
)
def q_subject_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Hedges of whole documents, with subjects from an extractor plug-in that
    sees each distinct (sentence, keyword) pair once."""
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    scored = score.score_traces(d, words=PROSE, extractor=text.keyword_window_extractor())
    return scored.select("doc_id", F.inline("matches")).select("doc_id", *MATCH_COLS)


@register(
    "encoder_similarity",
    o.trace_ctes("user", source=DOC_TRACES, keys="doc_id", words=PROSE, vec_join=VEC_RULE_SQL)
    + f" SELECT t.doc_id, {', '.join('m.' + c for c in MATCH_COLS)} FROM matches m JOIN tsplit t ON t.trace_id = m.trace_id",
)
def q_encoder_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Hedges of whole documents, with similarity from an encoder plug-in that
    sees each distinct subject once."""
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    scored = score.score_traces(d, words=PROSE, encoder=lambda subjects: subject_vector_table(spark, sf, subjects))
    return scored.select("doc_id", F.inline("matches")).select("doc_id", *MATCH_COLS)
