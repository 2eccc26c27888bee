"""Trace scoring over sentence rows, for traces of any length.

:func:`tracelens.operators.score.score_traces` keeps a trace in one row, which
is right for traces that are texts. When traces arrive as rows (one event, turn
or line per row) a trace can be arbitrarily long and one trace may hold a large
share of all rows. This module scores such input without ever gathering a
trace in one task:

* positions, hedge ids and verification ids come from skew-safe numbering
  (:mod:`tracelens.operators.scans`);
* counts and conclusion finality are partial aggregates (the finality window is
  at most three rows per trace);
* a hedge meets verifications through short lists (:mod:`tracelens.operators.candidates`),
  never through all pairs of its trace or all subjects that share a word with it;
* the exclusive greedy assignment folds segments of fixed length in parallel until
  the claims between them stand still (:mod:`tracelens.operators.assignment`),
  which is the sequential greedy's result.

Trace ids must not be null here; :func:`score_row_traces_full` takes the rows
of a null id apart, as one trace, whatever their number.

The output equals the one-row form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.functions import keywords as kw
from tracelens.functions import lexicon, scoring, similarity, text
from tracelens.operators import candidates, joins, scans
from tracelens.operators.assignment import assign


def sentence_rows(rows: DataFrame, order: Sequence[str], text_col: str = "text", trace_col: str = "trace_id") -> DataFrame:
    """``(trace_id, pos, sentence)`` from rows that each hold one or more sentences.

    ``order`` columns must order the rows of a trace uniquely; sentences of one
    row keep their order after it.
    """
    exploded = rows.select(
        F.col(trace_col).alias("trace_id"),
        *[F.col(c) for c in order],
        F.posexplode(text.split_sentences(F.col(text_col))).alias("_sub", "sentence"),
    )
    numbered = scans.group_row_number(exploded, ["trace_id"], [F.col(c) for c in order] + [F.col("_sub")], "pos")
    return numbered.select("trace_id", F.col("pos").cast("int").alias("pos"), "sentence")


def _subject(df: DataFrame) -> DataFrame:
    parts = df.withColumn("_sp", text.subject_parts(F.col("sentence")))
    return parts.withColumn("subject", text.subject_from_parts(F.col("_sp"), F.col("sentence"))).drop("_sp")


def annotate(sents: DataFrame) -> DataFrame:
    """Per-sentence keyword facts: ``nver``, ``keyword`` and the two statement flags."""
    both = kw.with_lower(
        F.col("sentence"), lambda low: F.struct(kw.verification_count(low).alias("nver"), kw.hedge_keyword(low).alias("keyword"))
    )
    ann = joins.barrier(sents.select(*sents.columns, both.alias("_b")).select(*sents.columns, "_b.*"))
    return ann.select(
        "*",
        (F.col("keyword").isNotNull() & (F.col("nver") < 2)).alias("is_hedge"),
        (F.col("nver") > 0).alias("is_ver"),
    )


def _split_statements(numbered: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    hidx, vidx = F.col(f"{name}_is_hedge").cast("int"), F.col(f"{name}_is_ver").cast("int")
    numbered = numbered.withColumn("pos", F.col("pos").cast("int"))
    # `vseen`: verifications at or before the hedge (for "strictly later" counts)
    h = numbered.where("is_hedge").select("trace_id", "pos", "sentence", "keyword", hidx.alias("hidx"), vidx.alias("vseen"))
    v = numbered.where("is_ver").select("trace_id", "pos", "sentence", vidx.alias("vidx"))
    return scans.materialize(_subject(h)), scans.materialize(_subject(v))


def statements(sents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hedges, verifications) with ids, positions and subjects, from numbered
    sentence rows: one skew-safe scan counts hedges and verifications so far."""
    _, found = scans.number_flagged(annotate(sents), ["trace_id"], [F.col("pos")], "_rn", ["is_hedge", "is_ver"])
    return _split_statements(found, "_rn")


def statements_from_rows(rows: DataFrame, order: Sequence[str], text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, hedges, verifications) from unnumbered rows in one numbering
    scan: positions, hedge ids and verification ids together."""

    def annotated(part: DataFrame) -> DataFrame:
        return annotate(part.select("trace_id", *order, F.posexplode(text.split_sentences(F.col(text_col))).alias("_sub", "sentence")))

    keys = [F.col(c) for c in order]
    few = rows.select("trace_id", *order, text_col)
    sents, found = scans.number_flagged(few, ["trace_id"], keys, "pos", ["is_hedge", "is_ver"], each=annotated, within=[F.col("_sub")])
    hedges, vers = _split_statements(found, "pos")
    return sents.select("trace_id", F.col("pos").cast("int").alias("pos"), "sentence"), hedges, vers


def hedge_subject_vectors(hedges: DataFrame, vers: DataFrame, subject_vectors: DataFrame) -> DataFrame:
    """``(trace_id, hidx, subject, sim, hpos)`` for every hedge and every distinct
    verification subject of its trace, with similarity from subject vectors
    (``subject, vec``): cosine, 0 for an empty subject or a missing vector.

    Vectors can make any pair similar, so all hedges x distinct subjects of a
    trace are listed (the reduced pair set); subjects meet hedges through a
    join on the trace, which AQE splits for a hot trace."""
    vecs = subject_vectors.select("subject", F.col("vec").cast("array<double>").alias("vec"))
    subjects = vers.select("trace_id", "subject").distinct().join(vecs, "subject", "left").withColumnRenamed("vec", "vvec")
    hv = hedges.select("trace_id", "hidx", F.col("pos").alias("hpos"), F.col("subject").alias("hsubj")).join(
        vecs.withColumnRenamed("subject", "hsubj").withColumnRenamed("vec", "hvec"), "hsubj", "left"
    )
    pairs = hv.join(subjects, "trace_id")
    empty = (F.col("hsubj") == "") | (F.col("subject") == "") | F.col("hvec").isNull() | F.col("vvec").isNull()
    sim = F.when(empty, F.lit(0.0)).otherwise(similarity.vector_cosine(F.col("hvec"), F.col("vvec")))
    return pairs.select("trace_id", "hidx", "subject", sim.alias("sim"), "hpos")


def _nearest(values: DataFrame, queries: DataFrame, group: list[str]) -> DataFrame:
    """Queries ``(group..., hidx, key=hpos)`` -> ``(trace_id, hidx, vpos)``."""
    q = queries.select(*group, F.col("key"), F.struct(F.col("trace_id").alias("t"), F.col("hidx").alias("h")).alias("qid"))
    out = scans.suffix_min(values, q, group)
    return out.where(F.col("answer").isNotNull()).select(
        F.col("qid.t").alias("trace_id"), F.col("qid.h").alias("hidx"), F.col("answer").cast("int").alias("vpos")
    )


def score_sentence_rows(
    sents: DataFrame,
    threshold: float = lexicon.SIMILARITY_THRESHOLD,
    decay: float = lexicon.PROXIMITY_DECAY,
    weights: tuple[float, float] = lexicon.MATCH_WEIGHTS,
    reduction: float = lexicon.RESOLUTION_WEIGHT_REDUCTION,
) -> tuple[DataFrame, DataFrame]:
    """Score traces given as ``(trace_id, pos, sentence)`` rows.

    Returns ``(metrics, matches)``: one row per trace with the ten scalar
    metric fields, and one row per hedge with the eleven detail fields.
    """
    hedges, vers = statements(sents)
    return score_statements(sents, hedges, vers, threshold, decay, weights, reduction)


def score_statements(
    sents: DataFrame,
    hedges: DataFrame,
    vers: DataFrame,
    threshold: float = lexicon.SIMILARITY_THRESHOLD,
    decay: float = lexicon.PROXIMITY_DECAY,
    weights: tuple[float, float] = lexicon.MATCH_WEIGHTS,
    reduction: float = lexicon.RESOLUTION_WEIGHT_REDUCTION,
    subject_sims: DataFrame | None = None,
    traces: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scoring after statement detection (see :func:`score_sentence_rows`).

    ``traces`` (``trace_id``) adds the traces that have no sentence."""
    best = assign(hedges, vers, threshold, decay, weights, subject_sims=subject_sims)
    resolved = F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False))
    ms = scoring.round4(F.col("score"))
    matches = hedges.join(best.drop("hpos"), ["trace_id", "hidx"], "left").select(
        "trace_id",
        "hidx",
        F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("id"),
        "sentence",
        F.col("keyword").alias("matched_keyword"),
        "subject",
        F.col("pos").alias("position"),
        F.when(resolved, F.concat(F.lit("V"), F.col("vidx").cast("string"))).alias("matched_verification"),
        scoring.round4(F.col("sim")).alias("subject_similarity"),
        scoring.round4(F.col("prox")).alias("proximity_score"),
        ms.alias("match_score"),
        resolved.alias("resolved"),
        scoring.effective_weight(resolved, ms, reduction).alias("effective_weight"),
    )
    n = sents.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    if traces is not None:
        n = traces.join(n, "trace_id", "left").select("trace_id", F.coalesce("n", F.lit(0)).alias("n"))
    nver = vers.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("nver"))
    late = F.col("position") >= F.col("n") / F.lit(2.0)
    reduction_dec = scoring.round4(F.lit(1.0) - F.col("effective_weight")).cast("decimal(20,4)")
    mstats = (
        matches.join(n, "trace_id")
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("total"),
            F.count_if("resolved").cast("int").alias("res"),
            F.sum(reduction_dec).alias("wsum"),
            F.count_if(~F.col("resolved")).alias("unres"),
            F.count_if(~F.col("resolved") & late).alias("late_unres"),
        )
    )
    tail = (
        sents.join(n, "trace_id")
        .where(F.col("pos") >= F.col("n") - lexicon.FINALITY_WINDOW)
        .groupBy("trace_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_t"))
        .select("trace_id", F.array_join(F.transform("_t", lambda x: x["sentence"]), " ").alias("tail"))
    )
    base = n.join(nver, "trace_id", "left").join(mstats, "trace_id", "left").join(tail, "trace_id", "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    res = F.coalesce(F.col("res"), F.lit(0))
    trur = scoring.ratio4(res, total)
    hvr = F.when(total == 0, F.lit(0.0)).otherwise(scoring.hedge_verify_ratio(total, F.coalesce(F.col("nver"), F.lit(0))))
    late_ratio = F.when(F.coalesce(F.col("unres"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        scoring.round4(F.col("late_unres") / F.col("unres"))
    )
    fin = kw.with_lower(F.coalesce(F.col("tail"), F.lit("")), kw.finality_score)
    stage = base.select(
        "trace_id",
        "n",
        total.cast("int").alias("total_hedges"),
        res.cast("int").alias("resolved_hedges"),
        (total - res).cast("int").alias("unresolved_hedges"),
        trur.alias("trur"),
        F.when(total == 0, F.lit(0.0)).otherwise(scoring.round4(F.col("wsum").cast("double") / total)).alias("weighted_trur"),
        F.coalesce(F.col("nver"), F.lit(0)).cast("int").alias("total_verifications"),
        hvr.alias("hvr"),
        late_ratio.alias("late_unresolved_ratio"),
        fin.alias("conclusion_finality"),
    )
    metrics = stage.withColumn(
        "predicted_certainty",
        scoring.predict_certainty(
            F.col("total_hedges"), F.col("trur"), F.col("hvr"), F.col("late_unresolved_ratio"), F.col("conclusion_finality")
        ),
    )
    # a blank trace has the short result: the other fields are null
    short = ["total_verifications", "hvr", "late_unresolved_ratio", "conclusion_finality", "predicted_certainty"]
    metrics = metrics.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in short}).drop("n")
    return metrics, matches


def planted_rows(spark, events: DataFrame, key: str = "user_day") -> DataFrame:
    """Planted traces as ``(trace_id, <key cols>, ts, event_id, text)`` rows."""
    from tracelens.sources import planted

    s = planted.planted_sentences(spark, events).withColumn("trace_id", planted.trace_id_col(key))
    return s.select("trace_id", *planted.TRACE_KEYS[key], "ts", "event_id", F.col("sentence").alias("text"))


def nearest_candidates(
    hedges: DataFrame, vers: DataFrame, decay: float = lexicon.PROXIMITY_DECAY, weights: tuple[float, float] = lexicon.MATCH_WEIGHTS
) -> DataFrame:
    """Each hedge with its nearest later verification (no exclusivity):
    ``(trace_id, hidx, hpos, vidx, vpos, sim, prox, score)``; hedges with no
    later verification are absent. A skew-safe suffix-minimum scan finds the
    verification and carries its id and subject; similarity is that of the two
    subjects, computed where it is used."""
    named = F.col("trace_id").isNotNull()
    vals = vers.where(named).select("trace_id", (F.col("pos") - 1).alias("key"), F.struct(F.col("pos").alias("vpos"), "vidx", "subject").alias("value"))
    asked = F.struct("trace_id", "hidx", F.col("pos").alias("hpos"), F.col("subject").alias("hsubject"))
    near = scans.suffix_min(vals, hedges.where(named).select("trace_id", F.col("pos").alias("key"), asked.alias("qid")), ["trace_id"])
    j = near.where(F.col("answer").isNotNull()).select("qid.*", "answer.*")
    sim = similarity.tf_cosine(F.col("hsubject"), F.col("subject"))
    prox = scoring.proximity_score(F.col("vpos") - F.col("hpos"), decay)
    return j.select("trace_id", "hidx", "hpos", "vidx", "vpos", sim.alias("sim"), prox.alias("prox")).withColumn(
        "score", scoring.match_score(F.col("sim"), F.col("prox"), weights)
    )


def planted_sentence_rows(spark, events: DataFrame, key: str = "user_day") -> DataFrame:
    """Planted traces as sentence rows (no per-trace gathering)."""
    return sentence_rows(planted_rows(spark, events, key), ["ts", "event_id"])


def planted_statements(spark, events: DataFrame, key: str = "user_day") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, hedges, verifications) of planted traces in one numbering scan."""
    return statements_from_rows(planted_rows(spark, events, key), ["ts", "event_id"])



# Rows a trace may have and still be gathered into one row for the one-row scorer.
ONE_ROW_LIMIT = 4_000


METRIC_COLS = [
    "total_hedges", "resolved_hedges", "unresolved_hedges", "trur", "weighted_trur", "total_verifications",
    "hvr", "late_unresolved_ratio", "conclusion_finality", "predicted_certainty",
]
MATCH_COLS = [
    "id", "sentence", "matched_keyword", "subject", "position", "matched_verification",
    "subject_similarity", "proximity_score", "match_score", "resolved", "effective_weight",
]


def split_by_size(r: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """(short-trace rows, long-trace rows or None, long trace ids or None, rows of a null id or None).

    Sizes are a partial aggregate; the long-trace id list is measured, then
    broadcast only when within the byte limit. Joins never match a null id, so
    its rows are told apart here.
    """
    sizes = r.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_rows"))
    long = (F.col("_rows") > max_rows) & F.col("trace_id").isNotNull()
    hot = sizes.where(long).select("trace_id")
    n_null, n_hot, hot_bytes = sizes.agg(F.count_if(F.col("trace_id").isNull()), F.count_if(long), F.sum(F.when(long, joins.row_bytes(["trace_id"])))).first()
    unnamed = r.where("trace_id IS NULL") if n_null else None
    named = r.where("trace_id IS NOT NULL") if n_null else r
    if not n_hot:
        return named, None, None, unnamed
    hot_side = joins.broadcast_if(hot, hot_bytes)
    return named.join(hot_side, "trace_id", "left_anti"), named.join(hot_side, "trace_id", "left_semi"), hot_side, unnamed


def under_a_name(unnamed: DataFrame) -> DataFrame:
    """Rows of a null id under an id of its type, to be scored by themselves."""
    return unnamed.withColumn("trace_id", F.lit("0").cast(unnamed.schema["trace_id"].dataType))


def without_name(df: DataFrame) -> DataFrame:
    return df.withColumn("trace_id", F.lit(None).cast(df.schema["trace_id"].dataType))


def gather(cold: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One text row per (bounded) trace: rows in order, joined by newlines so
    every row boundary stays a sentence boundary."""
    n = int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        cold.repartition(n, "trace_id")
        .groupBy("trace_id", *keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, "_text"))).alias("_rows"))
        .select("trace_id", *keys, F.array_join(F.transform("_rows", lambda x: x["_text"]), "\n").alias("text"))
    )


def row_trace_pairs(rows: DataFrame, order: Sequence[str], text_col: str = "text", max_rows: int = ONE_ROW_LIMIT) -> DataFrame:
    """Reduced candidate pairs ``(trace_id, hedge_id, verification_id, sim, prox, score)``,
    size-routed like :func:`score_row_traces_full`."""
    from tracelens.operators import score

    r = rows.select("trace_id", *order, F.col(text_col).alias("_text"))
    cold, hot_rows, _, unnamed = split_by_size(r, max_rows)
    cols = ["trace_id", "hedge_id", "verification_id", "sim", "prox", "score"]
    out = score.reduced_pairs(score.with_statements(gather(cold, order))).select(*cols)
    if hot_rows is not None:
        _, hs, vs = statements_from_rows(hot_rows, order, "_text")
        p = subject_pairs(hs, vs).select(
            "trace_id",
            F.concat(F.lit("H"), F.col("hidx").cast("string")).alias("hedge_id"),
            F.concat(F.lit("V"), F.col("vidx").cast("string")).alias("verification_id"),
            "sim",
            "prox",
            "score",
        )
        out = out.unionByName(p)
    if unnamed is not None:
        out = out.unionByName(without_name(row_trace_pairs(under_a_name(unnamed), order, "_text", max_rows)))
    return out


def score_row_traces_full(
    rows: DataFrame,
    order: Sequence[str],
    text_col: str = "text",
    max_rows: int = ONE_ROW_LIMIT,
    keys: Sequence[str] = (),
    subject_vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(metrics, matches)`` for traces given as rows (``trace_id, keys..., order..., text``).

    Trace sizes are counted first (a partial aggregate). Traces of at most
    ``max_rows`` rows are gathered into one row each (rows joined by newlines,
    so every row boundary stays a sentence boundary) and scored by the fast
    one-row scorer; longer ones, which could not be gathered safely, go to the
    skew-safe sentence-row scorer. The list of long trace ids is broadcast only
    after it has been counted. ``keys`` are columns constant within a trace
    that are carried to both outputs; ``matches`` has one row per hedge. Rows
    of a null trace id are one trace, scored by itself and with a null id.
    """
    from tracelens.operators import score

    keys = list(keys)
    r = rows.select("trace_id", *keys, *order, F.col(text_col).alias("_text"))
    cold, hot_rows, hot_side, unnamed = split_by_size(r, max_rows)
    metrics_parts, match_parts = [], []
    if hot_rows is not None:
        sents, hs, vs = statements_from_rows(hot_rows.drop(*keys), order, "_text")
        # traces of blank rows only have no sentence, but are traces
        traces = hot_rows.select("trace_id").distinct()
        sims = hedge_subject_vectors(hs, vs, subject_vectors) if subject_vectors is not None else None
        m, mt = score_statements(sents, hs, vs, subject_sims=sims, traces=traces)
        if keys:
            # one row per long trace: as many rows as were counted
            key_rows = hot_rows.select("trace_id", *keys).distinct()
            key_rows = key_rows.join(hot_side, "trace_id", "left_semi")
            m = m.join(key_rows, "trace_id")
            mt = mt.join(key_rows, "trace_id")
        metrics_parts.append(m.select("trace_id", *keys, *METRIC_COLS))
        match_parts.append(mt.select("trace_id", *keys, *MATCH_COLS))
    one_row = score.score_traces(gather(cold, order, keys), subject_vectors=subject_vectors)
    metrics_parts.insert(0, one_row.select("trace_id", *keys, *METRIC_COLS))
    match_parts.insert(0, one_row.select("trace_id", *keys, F.inline("matches")).select("trace_id", *keys, *MATCH_COLS))
    if unnamed is not None:
        for parts, part in zip((metrics_parts, match_parts), score_row_traces_full(under_a_name(unnamed), order, "_text", max_rows, keys, subject_vectors), strict=True):
            parts.append(without_name(part))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return union(metrics_parts), union(match_parts)


def score_row_traces(
    rows: DataFrame,
    order: Sequence[str],
    text_col: str = "text",
    max_rows: int = ONE_ROW_LIMIT,
) -> DataFrame:
    """Per-trace metrics of :func:`score_row_traces_full`."""
    return score_row_traces_full(rows, order, text_col, max_rows)[0]


def independent_best(
    hedges: DataFrame, vers: DataFrame, decay: float = lexicon.PROXIMITY_DECAY, weights: tuple[float, float] = lexicon.MATCH_WEIGHTS
) -> DataFrame:
    """Best later verification per hedge ignoring exclusivity (ties to the
    earliest): the nearest member of each of the hedge's lists, and the best of these."""
    lists, members = candidates.hedge_lists(hedges, vers)
    near = candidates.nearest(lists, members)
    prox = scoring.proximity_score(F.col("vpos") - F.col("hpos"), decay)
    scored = near.withColumn("prox", prox).withColumn("score", scoring.match_score(F.col("sim"), F.col("prox"), weights))
    best = (
        scored.groupBy("trace_id", "hidx")
        .agg(F.max_by(F.struct("vpos", "sim", "prox", "score"), F.struct(F.col("score"), -F.col("vpos"))).alias("b"))
        .select("trace_id", "hidx", "b.*")
    )
    return best.join(vers.select("trace_id", "vidx", F.col("pos").alias("vpos")), ["trace_id", "vpos"])


def subject_pairs(
    hedges: DataFrame, vers: DataFrame, decay: float = lexicon.PROXIMITY_DECAY, weights: tuple[float, float] = lexicon.MATCH_WEIGHTS
) -> DataFrame:
    """Reduced candidate pairs: each hedge with the first later verification of
    every distinct verification subject of its trace.

    Verifications sharing a subject have the same similarity to a hedge, so
    only the first of each can be a best match; the output is hedges x
    distinct subjects. Subjects meet hedges through a join on the trace (AQE
    splits a hot trace's hedge side), and the first later verification per
    (trace, subject) comes from a skew-safe suffix-minimum scan.
    """
    vrows = vers.select("trace_id", "vidx", F.col("pos").alias("vpos"), "subject")
    subjects = vrows.select("trace_id", "subject").distinct()
    queries = hedges.select("trace_id", "hidx", F.col("pos").alias("key")).join(subjects, "trace_id")
    vals = vrows.select("trace_id", "subject", (F.col("vpos") - 1).alias("key"), F.col("vpos").alias("value"))
    first = _nearest(vals, queries, ["trace_id", "subject"])
    own = hedges.select("trace_id", "hidx", F.col("pos").alias("hpos"), F.col("subject").alias("hsubject"))
    j = first.join(vrows, ["trace_id", "vpos"]).join(own, ["trace_id", "hidx"])
    sim = similarity.tf_cosine(F.col("hsubject"), F.col("subject"))
    prox = scoring.proximity_score(F.col("vpos") - F.col("hpos"), decay)
    return j.select("trace_id", "hidx", "vidx", "vpos", sim.alias("sim"), prox.alias("prox")).withColumn(
        "score", scoring.match_score(F.col("sim"), F.col("prox"), weights)
    )
