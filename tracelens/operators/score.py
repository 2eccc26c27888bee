"""Trace scoring: one row per trace in, the 11 metric fields out.

Shape: each trace stays one row. Its sentences, hedges, verifications and the
per-hedge candidate lists are arrays inside that row, so the whole scoring is a
narrow (shuffle-free) projection that Spark runs partition by partition and that
streams with no state. Every step is a separate ``select`` over named columns,
so Catalyst keeps each heavy higher-order expression computed once instead of
inlining it into each consumer.

The exclusive greedy assignment (hedges in order; a verification resolved by an
earlier hedge at similarity <= 0.90 is barred for later hedges unless their own
similarity is > 0.90) is an ``aggregate`` fold over the hedge array whose
accumulator carries the claimed verification indexes and the output records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import keywords as kw
from tracelens.functions import lexicon, scoring, similarity, text
from tracelens.operators import joins

CAND_TYPE = "struct<idx:int,id:string,pos:int,sim:double,prox:double,score:double>"
MATCH_FIELDS = (
    "id:string,sentence:string,matched_keyword:string,subject:string,position:int,"
    "matched_verification:string,subject_similarity:double,proximity_score:double,"
    "match_score:double,resolved:boolean,effective_weight:double"
)
MATCH_TYPE = f"struct<{MATCH_FIELDS}>"
MATCHES_TYPE = f"array<{MATCH_TYPE}>"

METRIC_COLUMNS = [
    "total_hedges",
    "resolved_hedges",
    "unresolved_hedges",
    "trur",
    "weighted_trur",
    "total_verifications",
    "hvr",
    "late_unresolved_ratio",
    "conclusion_finality",
    "predicted_certainty",
    "matches",
]


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, wherever ``fn`` uses it and whatever projections Catalyst merges."""
    return F.get(F.transform(F.array(value), fn), 0)


def _restruct(x: Column, fields: Sequence[str], **extra: Column) -> Column:
    cols = [x[f].alias(f) for f in fields]
    cols += [c.alias(n) for n, c in extra.items()]
    return F.struct(*cols)


# --------------------------------------------------------------------------
# Statement arrays
# --------------------------------------------------------------------------
def annotated_sentences(sentences: Column, whole: Column, words: lexicon.Lexicon = lexicon.DEFAULT) -> Column:
    """``array<struct<pos, sentence, nver, hkw>>`` for the sentences of the text ``whole``.

    A sentence is a run of its text, so it can only hold phrases that the text
    holds: the lexicon is cut down to those once per text (bound as a lambda
    variable), and a sentence is held against the few that are left. ``lower``
    is bound per sentence in the same way (a plain column would be re-lowered
    per keyword).
    """
    present = F.transform(
        F.array(kw.lowered(whole, words)),
        lambda t: F.struct(kw.keyword_hits(t, words.hedges).alias("h"), kw.keyword_hits(t, words.verifications).alias("v")),
    )
    lowered = F.transform(
        sentences, lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"), kw.lowered(s, words).alias("low"))
    )

    def annotate(found: Column) -> Column:
        return F.transform(
            lowered,
            lambda x: F.struct(
                x["pos"].alias("pos"),
                x["sentence"].alias("sentence"),
                F.size(kw.keyword_hits(x["low"], found["v"])).alias("nver"),
                F.get(kw.keyword_hits(x["low"], found["h"]), 0).alias("hkw"),
            ),
        )

    return F.get(F.transform(present, annotate), 0)


def hedge_statements(annotated: Column, subjects: bool = True) -> Column:
    """Hedges: a hedge keyword and fewer than two verification entries; ids H1..Hn."""
    hedges = _numbered(F.filter(annotated, lambda x: x["hkw"].isNotNull() & (x["nver"] < 2)), "H", True, subjects)
    return _with_subjects(hedges) if subjects else hedges


def verification_statements(annotated: Column, subjects: bool = True) -> Column:
    """Verifications: any verification entry; ids V1..Vn."""
    vers = _numbered(F.filter(annotated, lambda x: x["nver"] > 0), "V", False, subjects)
    return _with_subjects(vers) if subjects else vers


def _numbered(stmts: Column, prefix: str, keyword: bool, parts: bool) -> Column:
    return F.transform(
        stmts,
        lambda x, i: F.struct(
            (i + 1).alias("idx"),
            F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"),
            x["pos"].alias("pos"),
            x["sentence"].alias("sentence"),
            (x["hkw"] if keyword else F.lit(None).cast("string")).alias("keyword"),
            *([text.subject_parts(x["sentence"]).alias("sp")] if parts else []),
        ),
    )


def _with_subjects(step1: Column) -> Column:
    base = ["idx", "id", "pos", "sentence", "keyword"]
    step2 = F.transform(
        step1, lambda x: _restruct(x, base, subject=text.subject_from_parts(x["sp"], x["sentence"]))
    )
    step3 = F.transform(step2, lambda x: _restruct(x, base + ["subject"], toks=similarity.subject_tokens(x["subject"])))
    return F.transform(
        step3, lambda x: _restruct(x, base + ["subject", "toks"], n2=similarity.term_norm2(x["toks"]))
    )


def _pair_similarity(h: Column, v: Column, cosines: Column | None) -> Column:
    if cosines is not None:
        known = h["at"].isNotNull() & v["at"].isNotNull()
        return F.when(known, F.get(F.get(cosines, h["at"]), v["at"])).otherwise(F.lit(0.0))
    return similarity.tf_cosine_from_tokens(h["toks"], h["n2"], v["toks"], v["n2"])


def candidate_lists(
    hedges: Column,
    verifications: Column,
    decay: float = lexicon.PROXIMITY_DECAY,
    weights: tuple[float, float] = lexicon.MATCH_WEIGHTS,
    mode: str = "tf_cosine",
) -> Column:
    """Each hedge with its later verifications, scored, in verification order.

    ``mode`` is ``tf_cosine`` (term-count cosine of subjects) or ``vectors``
    (cosine of the subjects' vectors, looked up in the column ``_cos`` of
    :func:`attach_vectors`).
    """

    def cands(h: Column, cosines: Column | None) -> Column:
        later = F.filter(verifications, lambda v: v["pos"] > h["pos"])
        raw = F.transform(
            later,
            lambda v: F.struct(
                v["idx"].alias("idx"),
                v["id"].alias("id"),
                v["pos"].alias("pos"),
                _pair_similarity(h, v, cosines).alias("sim"),
                scoring.proximity_score(v["pos"] - h["pos"], decay).alias("prox"),
            ),
        )
        return F.transform(
            raw, lambda c: _restruct(c, ["idx", "id", "pos", "sim", "prox"], score=scoring.match_score(c["sim"], c["prox"], weights))
        )

    def lists(cosines: Column | None = None) -> Column:
        return F.transform(hedges, lambda h: _restruct(h, ["idx", "id", "pos", "sentence", "keyword", "subject"], cands=cands(h, cosines)))

    return _bound(F.col("_cos"), lists) if mode == "vectors" else lists()


def assign_resolutions(
    scored_hedges: Column,
    threshold: float = lexicon.SIMILARITY_THRESHOLD,
    reduction: float = lexicon.RESOLUTION_WEIGHT_REDUCTION,
    reuse_sim: float = lexicon.REUSE_SIMILARITY,
) -> Column:
    """Greedy exclusive assignment as a fold; returns the ``matches`` array."""
    zero = F.struct(
        F.array().cast("array<int>").alias("claimed"),
        F.array().cast(MATCHES_TYPE).alias("out"),
    )

    def merge(acc: Column, h: Column) -> Column:
        allowed = F.filter(
            h["cands"], lambda c: ~F.array_contains(acc["claimed"], c["idx"]) | (c["sim"] > F.lit(reuse_sim))
        )
        # strict ">" keeps the earliest verification among equal scores
        best = F.aggregate(
            allowed,
            F.lit(None).cast(CAND_TYPE),
            lambda b, c: F.when(b.isNull() | (c["score"] > b["score"]), c).otherwise(b),
        )

        def step(b: Column) -> Column:
            resolved = F.coalesce(b["score"] >= F.lit(threshold), F.lit(False))
            ms = scoring.round4(b["score"])
            rec = F.struct(
                h["id"].alias("id"),
                h["sentence"].alias("sentence"),
                h["keyword"].alias("matched_keyword"),
                h["subject"].alias("subject"),
                h["pos"].alias("position"),
                F.when(resolved, b["id"]).alias("matched_verification"),
                scoring.round4(b["sim"]).alias("subject_similarity"),
                scoring.round4(b["prox"]).alias("proximity_score"),
                ms.alias("match_score"),
                resolved.alias("resolved"),
                scoring.effective_weight(resolved, ms, reduction).alias("effective_weight"),
            )
            claims = resolved & (b["sim"] <= F.lit(reuse_sim))
            return F.struct(
                F.when(claims, F.array_append(acc["claimed"], b["idx"])).otherwise(acc["claimed"]).alias("claimed"),
                F.array_append(acc["out"], rec).alias("out"),
            )

        # bind ``best`` once: a one-element array + transform is a let-binding
        return F.get(F.transform(F.array(best), step), 0)

    return F.aggregate(scored_hedges, zero, merge)["out"]


# --------------------------------------------------------------------------
# Trace-level metrics
# --------------------------------------------------------------------------
def weighted_trur(matches: Column, total: Column) -> Column:
    """Mean of ``round(1 - effective_weight, 4)``; the sum of these 4-dp numbers is exact (decimal)."""
    total_reduction = F.aggregate(
        matches,
        F.lit(0).cast("decimal(20,4)"),
        lambda a, r: (a + scoring.round4(F.lit(1.0) - r["effective_weight"]).cast("decimal(20,4)")).cast("decimal(20,4)"),
    ).cast("double")
    return F.when(total == 0, F.lit(0.0)).otherwise(scoring.round4(total_reduction / total))


def late_unresolved_ratio(matches: Column, n_sentences: Column) -> Column:
    unresolved = F.filter(matches, lambda r: ~r["resolved"])
    late = F.size(F.filter(unresolved, lambda r: r["position"] >= n_sentences / F.lit(2.0)))
    return F.when((F.size(unresolved) == 0) | (n_sentences == 0), F.lit(0.0)).otherwise(
        scoring.round4(late / F.size(unresolved))
    )


def conclusion_finality(sentences: Column, window: int = lexicon.FINALITY_WINDOW, words: lexicon.Lexicon = lexicon.DEFAULT) -> Column:
    """Finality over the last ``window`` sentences (all of them when fewer).

    ``slice(s, -3, 3)`` returns [] for shorter arrays, so the start is clamped.
    """
    n = F.size(sentences)
    tail = F.slice(sentences, F.greatest(n - F.lit(window - 1), F.lit(1)), window)
    return kw.with_lower(F.array_join(tail, " "), lambda low: kw.finality_score(low, words), words)


def with_statements(
    df: DataFrame, text_col: str = "text", words: lexicon.Lexicon = lexicon.DEFAULT, subjects: bool = True
) -> DataFrame:
    """Stage 1: sentences, hedges and verifications as arrays on each row.

    Adds ``_blank``, ``_sents`` (array<string>), ``_hedges`` and ``_vers``
    (array<struct<idx,id,pos,sentence,keyword,subject,toks,n2>>, without the last
    three if ``subjects`` is false); drops ``text_col``.
    """
    keep = [c for c in df.columns if c != text_col]
    t = F.col(text_col)
    s1 = df.select(*keep, t.alias("_whole"), text.is_blank(t).alias("_blank"), text.split_sentences(t).alias("_sents"))
    s2 = s1.select(*keep, "_blank", "_sents", annotated_sentences(F.col("_sents"), F.col("_whole"), words).alias("_ann"))
    return s2.select(
        *keep,
        "_blank",
        "_sents",
        hedge_statements(F.col("_ann"), subjects).alias("_hedges"),
        verification_statements(F.col("_ann"), subjects).alias("_vers"),
    )



def attach_vectors(stmts: DataFrame, subject_vectors: DataFrame | None = None, encoder=None) -> DataFrame:
    """Add ``_cos``, the similarities of a trace's subjects, to a statements frame.

    Distinct subjects over *all* traces are embedded once (the reference's
    per-process embedding cache becomes a ``distinct`` + join), either by
    joining ``subject_vectors`` (``subject, vec``) or by calling ``encoder``, a
    function ``DataFrame[subject] -> DataFrame[subject, vec]`` (for example an
    iterator pandas UDF that loads a model once per worker). The vectors of a
    trace's distinct subjects, one a subject at most, are gathered back per trace row, which is already
    one row, so nothing grows beyond the trace itself. ``_cos`` has a row for each distinct
    hedge subject and a column for each distinct verification subject: a
    cosine is computed once, not for every pair of statements. Each hedge's
    and verification's ``at`` is the place of its subject. Verifications keep
    neither sentence nor keyword, and vectors the type they came in.
    """
    from tracelens.operators.scans import stored

    def names(arr: str) -> Column:
        return F.array_distinct(F.transform(arr, lambda x: x["subject"]))

    def placed(arr: str, known: str, fields: Sequence[str]) -> Column:
        return F.transform(arr, lambda x: _restruct(x, fields, at=(F.array_position(F.col(known), x["subject"]) - 1).cast("int")))

    keep = [c for c in stmts.columns if c not in ("_hedges", "_vers")]
    named = stmts.select(*keep, "_hedges", "_vers", names("_hedges").alias("_hnames"), names("_vers").alias("_vnames"))
    base = named.select(
        *keep,
        placed("_hedges", "_hnames", ["idx", "id", "pos", "sentence", "keyword", "subject"]).alias("_hedges"),
        placed("_vers", "_vnames", ["idx", "id", "pos", "subject"]).alias("_vers"),
        # those of the hedges come first
        F.size("_hnames").alias("_nh"),
        "_vnames",
        F.array_distinct(F.concat("_hnames", "_vnames")).alias("_names"),
    )
    base = base.withColumn("_vat", F.transform("_vnames", lambda s: (F.array_position(F.col("_names"), s) - 1).cast("int"))).drop("_vnames")
    base = stored(base.withColumn("_rid", F.monotonically_increasing_id()), "statements")
    items = base.select("_rid", F.posexplode("_names").alias("k", "subject"))
    distinct = items.select("subject").distinct()
    vecs = encoder(distinct) if encoder is not None else subject_vectors.join(distinct, "subject", "left_semi")
    vecs = vecs.select("subject", "vec")
    per_row = items.join(vecs, "subject", "left").groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("k", "vec"))).alias("_found"))
    once = F.when(F.size("_found") == F.size("_names"), F.col("_found")).otherwise(F.raise_error(F.lit("a subject has two vectors")))
    j = base.join(per_row, "_rid", "left").withColumn("_found", F.when(F.size("_names") > 0, once))

    def found(subject: Column, k: Column) -> Column:
        return F.when(subject != F.lit(""), F.get(F.col("_found"), k)["vec"])

    vectors = F.transform(F.transform("_names", found), lambda v: F.struct(v.alias("vec"), similarity.vector_norm(v).alias("norm")))
    sides = _bound(vectors, lambda held: F.struct(F.slice(held, 1, F.col("_nh")).alias("h"), F.transform("_vat", lambda k: F.get(held, k)).alias("v")))

    def cosine(a: Column, b: Column) -> Column:
        unknown = a["vec"].isNull() | b["vec"].isNull()
        return F.when(unknown, F.lit(0.0)).otherwise(similarity.vector_cosine_from_norms(a["vec"], a["norm"], b["vec"], b["norm"]))

    cosines = _bound(sides, lambda x: F.transform(x["h"], lambda a: F.transform(x["v"], lambda b: cosine(a, b))))
    return j.select(*keep, "_hedges", "_vers", cosines.alias("_cos"))


def attach_subjects(stmts: DataFrame, extractor) -> DataFrame:
    """Give statements the subjects of a user extractor, in place of any they have.

    ``extractor`` maps ``DataFrame[sentence, keyword]`` to
    ``DataFrame[sentence, keyword, subject]`` (a parser wrapped in an iterator
    Arrow UDF, say). It sees each distinct (sentence, keyword) pair once over
    all traces; hedges pass their matched keyword, verifications a null one.
    Its answers, one a pair at most, are joined back and gathered per trace row
    in the order of the statements, hedges first.
    """
    from tracelens.operators.scans import materialize

    base = materialize(stmts.withColumn("_rid", F.monotonically_increasing_id()))

    def items(arr: str) -> Column:
        return F.transform(arr, lambda x: F.struct(x["sentence"].alias("sentence"), x["keyword"].alias("keyword")))

    rows = base.select("_rid", F.posexplode(F.concat(items("_hedges"), items("_vers"))).alias("k", "x")).select("_rid", "k", "x.*")
    distinct = rows.select("sentence", "keyword").distinct()
    found = extractor(distinct).select("sentence", "keyword", F.col("subject").cast("string").alias("subject"))
    cond = (rows["sentence"] == found["sentence"]) & rows["keyword"].eqNullSafe(found["keyword"])
    per_row = (
        rows.join(found, cond, "left")
        .groupBy(rows["_rid"])
        .agg(F.sort_array(F.collect_list(F.struct(rows["k"], F.coalesce(found["subject"], F.lit("")).alias("subject")))).alias("_found"))
    )
    n = F.size("_hedges") + F.size("_vers")
    once = F.when(F.size("_found") == n, F.col("_found")["subject"]).otherwise(F.raise_error(F.lit("the extractor gave a sentence and keyword two subjects")))
    keep = [c for c in stmts.columns if c not in ("_hedges", "_vers")]
    j = base.join(per_row, "_rid", "left").select(*keep, "_hedges", "_vers", F.when(n > 0, once).alias("_subjects"))
    fields = ["idx", "id", "pos", "sentence", "keyword"]

    def with_found(arr: str, before: Column) -> Column:
        with_subject = F.transform(arr, lambda x: _restruct(x, fields, subject=F.get(F.col("_subjects"), before + x["idx"] - 1)))
        with_toks = F.transform(with_subject, lambda x: _restruct(x, fields + ["subject"], toks=similarity.subject_tokens(x["subject"])))
        return F.transform(with_toks, lambda x: _restruct(x, fields + ["subject", "toks"], n2=similarity.term_norm2(x["toks"])))

    return j.select(*keep, with_found("_hedges", F.lit(0)).alias("_hedges"), with_found("_vers", F.size("_hedges")).alias("_vers"))


def score_traces(
    df: DataFrame,
    text_col: str = "text",
    threshold: float = lexicon.SIMILARITY_THRESHOLD,
    decay: float = lexicon.PROXIMITY_DECAY,
    weights: tuple[float, float] = lexicon.MATCH_WEIGHTS,
    reduction: float = lexicon.RESOLUTION_WEIGHT_REDUCTION,
    subject_vectors: DataFrame | None = None,
    encoder=None,
    extractor=None,
    words: lexicon.Lexicon = lexicon.DEFAULT,
) -> DataFrame:
    """Score every trace of ``df[text_col]``; all other columns pass through.

    Adds the 11 reference metric columns. A null or whitespace-only text gets
    zero counts, empty ``matches`` and null for the five fields the reference
    omits in that case. Subjects come from the regex extractor unless
    ``extractor`` is given (see :func:`attach_subjects`); similarity is the
    native term-count cosine unless ``subject_vectors`` or ``encoder``
    supplies subject embeddings (see :func:`attach_vectors`). ``words`` are the
    phrases looked for.
    """
    keep = [c for c in df.columns if c != text_col]
    s3 = with_statements(df, text_col, words, subjects=extractor is None)
    # what is needed of the sentences, before rows are stored or shuffled
    s3 = s3.select(*keep, "_blank", F.size("_sents").alias("_n"), conclusion_finality(F.col("_sents"), words=words).alias("_fin"), "_hedges", "_vers")
    if extractor is not None:
        s3 = attach_subjects(s3, extractor)
    mode = "tf_cosine"
    if subject_vectors is not None or encoder is not None:
        s3 = attach_vectors(s3, subject_vectors, encoder)
        mode = "vectors"
    s4 = s3.select(
        *keep,
        "_blank",
        "_n",
        "_fin",
        F.size("_vers").alias("_nver"),
        candidate_lists(F.col("_hedges"), F.col("_vers"), decay, weights, mode).alias("_scored"),
    )
    s5 = s4.select(
        *keep,
        "_blank",
        "_n",
        "_fin",
        "_nver",
        assign_resolutions(F.col("_scored"), threshold, reduction).alias("matches"),
    )
    total = F.size("matches")
    resolved = F.size(F.filter("matches", lambda r: r["resolved"]))
    s6 = s5.select(
        *keep,
        "_blank",
        "_nver",
        "matches",
        total.alias("total_hedges"),
        resolved.alias("resolved_hedges"),
        "_n",
        "_fin",
    )
    total = F.col("total_hedges")
    trur = scoring.ratio4(F.col("resolved_hedges"), total)
    s7 = s6.select(
        *keep,
        "_blank",
        "_nver",
        "_fin",
        "matches",
        "total_hedges",
        "resolved_hedges",
        trur.alias("trur"),
        weighted_trur(F.col("matches"), total).alias("weighted_trur"),
        F.when(total == 0, F.lit(0.0)).otherwise(scoring.hedge_verify_ratio(total, F.col("_nver"))).alias("hvr"),
        late_unresolved_ratio(F.col("matches"), F.col("_n")).alias("late"),
    )
    blank = F.col("_blank")

    def unless_blank(c: Column) -> Column:
        return F.when(~blank, c)

    out = s7.select(
        *keep,
        F.col("total_hedges").cast("int").alias("total_hedges"),
        F.col("resolved_hedges").cast("int").alias("resolved_hedges"),
        (F.col("total_hedges") - F.col("resolved_hedges")).cast("int").alias("unresolved_hedges"),
        F.col("trur"),
        F.col("weighted_trur"),
        unless_blank(F.col("_nver").cast("int")).alias("total_verifications"),
        unless_blank(F.col("hvr")).alias("hvr"),
        unless_blank(F.col("late")).alias("late_unresolved_ratio"),
        unless_blank(F.col("_fin")).alias("conclusion_finality"),
        unless_blank(
            scoring.predict_certainty(F.col("total_hedges"), F.col("trur"), F.col("hvr"), F.col("late"), F.col("_fin"))
        ).alias("predicted_certainty"),
        F.col("matches"),
    )
    # A later filter on any metric would otherwise be pushed below these
    # projections and carry the whole fold into the filter (computed twice).
    return joins.barrier(out)


def reduced_pairs(stmts: DataFrame) -> DataFrame:
    """Candidate pairs that can win: per hedge, the first later verification of
    each distinct verification subject.

    Every verification with the same subject has the same similarity to a hedge,
    so the nearest one has the best score and wins ties; later ones can never be
    chosen by the independent best match. Emitting only these keeps the pair
    count at hedges x distinct subjects instead of hedges x verifications.
    """
    vers = F.transform(
        "_vers",
        lambda v, i: F.struct(
            v["idx"].alias("idx"),
            v["id"].alias("id"),
            v["pos"].alias("pos"),
            v["toks"].alias("toks"),
            v["n2"].alias("n2"),
            F.aggregate(
                F.slice("_vers", 1, i),
                F.lit(None).cast("int"),
                lambda acc, u: F.when(u["subject"] == v["subject"], u["pos"]).otherwise(acc),
            ).alias("prev_same"),
        ),
    )
    s = stmts.select("trace_id", "_hedges", vers.alias("_v2"))
    pairs = s.select(
        "trace_id",
        F.explode(
            F.transform(
                "_hedges",
                lambda h: F.struct(
                    h["id"].alias("hedge_id"),
                    h["pos"].alias("hpos"),
                    F.transform(
                        F.filter("_v2", lambda v: (v["pos"] > h["pos"]) & (v["prev_same"].isNull() | (v["prev_same"] <= h["pos"]))),
                        lambda v: F.struct(
                            v["id"].alias("verification_id"),
                            v["pos"].alias("vpos"),
                            similarity.tf_cosine_from_tokens(h["toks"], h["n2"], v["toks"], v["n2"]).alias("sim"),
                        ),
                    ).alias("vs"),
                ),
            )
        ).alias("h"),
    )
    flat = pairs.select("trace_id", "h.hedge_id", "h.hpos", F.explode("h.vs").alias("v"))
    prox = scoring.proximity_score(F.col("v.vpos") - F.col("hpos"))
    return flat.select(
        "trace_id",
        "hedge_id",
        F.col("v.verification_id").alias("verification_id"),
        F.col("v.vpos").alias("vpos"),
        F.col("v.sim").alias("sim"),
        prox.alias("prox"),
        scoring.match_score(F.col("v.sim"), prox).alias("score"),
    )
