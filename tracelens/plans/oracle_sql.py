"""DuckDB SQL building blocks for the correctness oracles.

The oracle re-states each query relationally (unnest, window numbering, joins
and a recursive CTE for the greedy assignment) rather than with the nested
arrays the Spark side uses, so the two are independent formulations. Regex
texts are shared with the Spark side: the whitespace class is written so that
Java and RE2 read it the same way.
"""

from __future__ import annotations

from tracelens.functions import lexicon, text
from tracelens.functions.similarity import ARTICLES, TOKEN_SPLIT
from tracelens.sources import planted

WS = text.WS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def round4(x: str) -> str:
    """Python ``round(x, 4)`` (exact-binary half-even), null-preserving."""
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE CAST(printf('%.4f', {x}) AS DOUBLE) END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def split_sentences(x: str) -> str:
    norm = f"regexp_replace({x}, {q(chr(92) + 'r' + chr(92) + 'n?')}, chr(10), 'g')"
    broken = f"regexp_replace({norm}, {q(text.SENTENCE_BREAK)}, '\\1' || chr(10), 'g')"
    return (
        f"coalesce(list_filter(list_transform(string_split({broken}, chr(10)), lambda p: {strip('p')}), "
        f"lambda p: p <> ''), [])"
    )


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def low(x: str, words: lexicon.Lexicon = lexicon.DEFAULT) -> str:
    return f"lower(translate({x}, chr(8216) || chr(8217), chr(39) || chr(39)))" if words.fold_apostrophes else f"lower({x})"


def ver_count(low: str, words: lexicon.Lexicon = lexicon.DEFAULT) -> str:
    return f"len(list_filter({sql_list(words.verifications)}, lambda k: contains({low}, k)))"


def hedge_kw(low: str, words: lexicon.Lexicon = lexicon.DEFAULT) -> str:
    return f"list_filter({sql_list(words.hedges)}, lambda k: contains({low}, k))[1]"


def finality(tail_low: str, words: lexicon.Lexicon = lexicon.DEFAULT) -> str:
    c = f"len(list_filter({sql_list(words.certain)}, lambda k: contains({tail_low}, k)))"
    u = f"len(list_filter({sql_list(words.uncertain)}, lambda k: contains({tail_low}, k)))"
    return f"(CASE WHEN {c} + {u} = 0 THEN 0.0 ELSE {round4(f'({c} - {u}) / ({c} + {u})')} END)"


def subject_ctes(src: str, name: str = "subj") -> str:
    """CTEs ``<name>1..3, <name>`` adding ``subject`` to rows of ``src`` (needs ``sentence``)."""
    p0, opener, verb, head = text.SUBJECT_ABOUT, text.SUBJECT_OPENER, text.SUBJECT_VERB, text.SUBJECT_HEAD
    return f"""
{name}1 AS (SELECT *, {strip('lower(sentence)')} AS _tl FROM {src}),
{name}2 AS (
  SELECT *,
    CASE WHEN regexp_matches(_tl, {q(p0)}) THEN {strip(f"regexp_extract(_tl, {q(p0)}, 1)")} END AS _about,
    regexp_replace(regexp_replace(_tl, {q(opener)}, ''), {q(verb)}, '') AS _cleaned
  FROM {name}1),
{name}3 AS (
  SELECT *,
    {strip(f"regexp_extract(_cleaned, {q(head)}, 1)")} AS _head,
    list_filter(regexp_split_to_array(_cleaned, {q(WS + '+')}), lambda w: w <> '') AS _words
  FROM {name}2),
{name} AS (
  SELECT * EXCLUDE (_tl, _about, _cleaned, _head, _words),
    CASE WHEN _about IS NOT NULL THEN _about
         WHEN _head <> '' THEN _head
         WHEN len(_words) > 0 THEN array_to_string(_words[1:3], ' ')
         ELSE substring(sentence, 1, 30) END AS subject
  FROM {name}3)"""


def window_subject_ctes(src: str, name: str = "subj") -> str:
    """As ``subject_ctes``, but a subject is taken from the words after the hedge keyword ``hkw`` where there are any."""
    skip = sql_list(text.SKIP_WORDS)
    return f"""{subject_ctes(src, name + "r")},
{name}t AS (
  SELECT *,
    list_filter(list_transform(regexp_split_to_array(lower(sentence), {q(WS + '+')}),
                               lambda t: regexp_replace(t, {q(text.EDGE_PUNCT)}, '', 'g')), lambda t: t <> '') AS _toks,
    string_split(lower(hkw), ' ') AS _kw
  FROM {name}r),
{name}s AS (
  SELECT *, CASE WHEN len(_toks) >= len(_kw) THEN
           list_filter(range(1, len(_toks) - len(_kw) + 2), lambda i: _toks[i:i + len(_kw) - 1] = _kw)[1] END AS _st
  FROM {name}t),
{name}w AS (
  SELECT *, list_filter(_toks[_st + len(_kw):_st + len(_kw) + {text.KEYWORD_WINDOW - 1}], lambda t: NOT list_contains({skip}, t)) AS _content
  FROM {name}s),
{name} AS (
  SELECT * EXCLUDE (_toks, _kw, _st, _content, subject),
    CASE WHEN _st IS NULL OR len(_content) = 0 THEN subject ELSE array_to_string(_content[1:{text.KEYWORD_TAKE}], ' ') END AS subject
  FROM {name}w)"""


def trace_ctes(
    key: str = "user_day",
    source: str | None = None,
    keys: str | None = None,
    vec_join: str | None = None,
    words: lexicon.Lexicon = lexicon.DEFAULT,
    window_subjects: bool = False,
) -> str:
    """``WITH`` chain from planted traces to per-trace metrics.

    Defines: traces, tsplit, sents, ann, hedges, verifs, stmts, subj*, toks,
    norms, dots, pairs, greedy, matches, tstats, metrics.
    """
    keys = keys or ", ".join(planted.TRACE_KEYS[key])
    src = source or planted.planted_trace_sql(key)
    thr, reuse, red = lexicon.SIMILARITY_THRESHOLD, lexicon.REUSE_SIMILARITY, lexicon.RESOLUTION_WEIGHT_REDUCTION
    decay, (w_sim, w_prox) = lexicon.PROXIMITY_DECAY, lexicon.MATCH_WEIGHTS
    if vec_join:  # similarity = cosine of subject vectors; vec_join maps s.subject to embeddings e
        sim_ctes = f"""
svec AS (SELECT s.kind, s.trace_id, s.idx, s.subject, CAST(e.embedding AS DOUBLE[]) AS vec
         FROM subj s LEFT JOIN embeddings e ON {vec_join}),
vsim AS (
  SELECT h.trace_id, h.idx AS hidx, v.idx AS vidx,
    CASE WHEN h.subject = '' OR v.subject = '' OR h.vec IS NULL OR v.vec IS NULL THEN 0.0
         ELSE (SELECT CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE least(greatest(dot / (na * nb), 0.0), 1.0) END
               FROM (SELECT list_reduce(list_transform(list_zip(h.vec, v.vec), lambda z: z[1] * z[2]), lambda a, b: a + b) AS dot,
                            sqrt(list_reduce(list_transform(h.vec, lambda x: x * x), lambda a, b: a + b)) AS na,
                            sqrt(list_reduce(list_transform(v.vec, lambda x: x * x), lambda a, b: a + b)) AS nb)) END AS vsimval
  FROM svec h JOIN svec v ON v.trace_id = h.trace_id AND h.kind = 'H' AND v.kind = 'V'),"""
        sim_from = "LEFT JOIN vsim vs ON vs.trace_id = h.trace_id AND vs.hidx = h.hidx AND vs.vidx = v.vidx, LATERAL (SELECT coalesce(vs.vsimval, 0.0) AS sim)"
    else:
        sim_ctes = ""
        sim_from = """LEFT JOIN norms hn ON hn.kind = 'H' AND hn.trace_id = h.trace_id AND hn.idx = h.hidx
  LEFT JOIN norms vn ON vn.kind = 'V' AND vn.trace_id = v.trace_id AND vn.idx = v.vidx
  LEFT JOIN dots d ON d.trace_id = h.trace_id AND d.hidx = h.hidx AND d.vidx = v.vidx,
  LATERAL (SELECT CASE WHEN coalesce(hn.n2, 0) = 0 OR coalesce(vn.n2, 0) = 0 THEN 0.0
                       ELSE least(greatest(coalesce(d.dot, 0) / (sqrt(hn.n2) * sqrt(vn.n2)), 0.0), 1.0) END AS sim)"""
    # exact sum of the 4-dp reductions
    wsum = f"CAST(sum(CAST({round4('1.0 - effective_weight')} AS DECIMAL(20,4))) AS DOUBLE)"
    return f"""
WITH RECURSIVE
traces AS ({src}),
tsplit AS (
  SELECT trace_id, {keys}, text, {is_blank('text')} AS blank, {split_sentences('text')} AS sents
  FROM traces),
sents AS (
  SELECT trace_id, unnest(sents) AS sentence, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS pos
  FROM tsplit),
ann AS (
  SELECT trace_id, pos, sentence, {ver_count(low('sentence', words), words)} AS nver, {hedge_kw(low('sentence', words), words)} AS hkw
  FROM sents),
hedges AS (
  SELECT trace_id, pos, sentence, hkw, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS INTEGER) AS hidx
  FROM ann WHERE hkw IS NOT NULL AND nver < 2),
verifs AS (
  SELECT trace_id, pos, sentence, nver, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS INTEGER) AS vidx
  FROM ann WHERE nver > 0),
stmts AS (
  SELECT 'H' AS kind, trace_id, hidx AS idx, pos, sentence, hkw FROM hedges
  UNION ALL
  SELECT 'V' AS kind, trace_id, vidx AS idx, pos, sentence, CAST(NULL AS VARCHAR) AS hkw FROM verifs),
{window_subject_ctes('stmts') if window_subjects else subject_ctes('stmts')},
toks AS (
  SELECT kind, trace_id, idx, tok, count(*) AS cnt FROM (
    SELECT kind, trace_id, idx,
      unnest(list_filter(regexp_split_to_array(lower(coalesce(subject, '')), {q(TOKEN_SPLIT)}),
                         lambda t: t <> '' AND NOT list_contains({sql_list(ARTICLES)}, t))) AS tok
    FROM subj)
  GROUP BY kind, trace_id, idx, tok),
norms AS (SELECT kind, trace_id, idx, sum(cnt * cnt) AS n2 FROM toks GROUP BY kind, trace_id, idx),
dots AS (
  SELECT ht.trace_id, ht.idx AS hidx, vt.idx AS vidx, sum(ht.cnt * vt.cnt) AS dot
  FROM toks ht JOIN toks vt ON ht.trace_id = vt.trace_id AND ht.tok = vt.tok
  WHERE ht.kind = 'H' AND vt.kind = 'V'
  GROUP BY ht.trace_id, ht.idx, vt.idx),{sim_ctes}
pairs AS (
  SELECT h.trace_id, h.hidx, v.vidx, v.pos AS vpos, h.pos AS hpos, sim,
         exp(-(v.pos - h.pos) / {decay}) AS prox,
         {w_sim} * sim + {w_prox} * exp(-(v.pos - h.pos) / {decay}) AS score
  FROM hedges h
  JOIN verifs v ON v.trace_id = h.trace_id AND v.pos > h.pos
  {sim_from}),
greedy AS (
  SELECT trace_id, 0 AS hidx, CAST([] AS INTEGER[]) AS claimed,
         CAST(NULL AS INTEGER) AS vidx, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS DOUBLE) AS prox,
         CAST(NULL AS DOUBLE) AS score
  FROM (SELECT DISTINCT trace_id FROM hedges)
  UNION ALL
  SELECT g.trace_id, g.hidx + 1,
         CASE WHEN b.score >= {thr} AND b.sim <= {reuse} THEN list_append(g.claimed, b.vidx) ELSE g.claimed END,
         b.vidx, b.sim, b.prox, b.score
  FROM greedy g
  JOIN hedges h ON h.trace_id = g.trace_id AND h.hidx = g.hidx + 1
  LEFT JOIN LATERAL (
    SELECT p.vidx, p.sim, p.prox, p.score FROM pairs p
    WHERE p.trace_id = g.trace_id AND p.hidx = g.hidx + 1
      AND (NOT list_contains(g.claimed, p.vidx) OR p.sim > {reuse})
    ORDER BY p.score DESC, p.vpos ASC LIMIT 1) b ON true),
matches AS (
  SELECT h.trace_id, h.hidx, 'H' || h.hidx AS id, h.sentence, h.hkw AS matched_keyword, s.subject,
         h.pos AS position, coalesce(g.score >= {thr}, false) AS resolved,
         CASE WHEN g.score >= {thr} THEN 'V' || g.vidx END AS matched_verification,
         {round4('g.sim')} AS subject_similarity, {round4('g.prox')} AS proximity_score,
         {round4('g.score')} AS match_score,
         CASE WHEN g.score >= {thr} THEN {round4(f"1.0 - {red} * {round4('g.score')}")} ELSE 1.0 END AS effective_weight
  FROM hedges h
  JOIN greedy g ON g.trace_id = h.trace_id AND g.hidx = h.hidx
  JOIN subj s ON s.kind = 'H' AND s.trace_id = h.trace_id AND s.idx = h.hidx),
mstats AS (
  SELECT trace_id, count(*) AS total, count_if(resolved) AS resolved,
         {wsum} AS wsum
  FROM matches GROUP BY trace_id),
lstats AS (
  SELECT m.trace_id, count(*) AS unres, count_if(m.position >= len(t.sents) / 2.0) AS late
  FROM matches m JOIN tsplit t ON t.trace_id = m.trace_id
  WHERE NOT m.resolved GROUP BY m.trace_id),
vstats AS (SELECT trace_id, count(*) AS nver FROM verifs GROUP BY trace_id),
tails AS (
  SELECT t.trace_id,
    {low("array_to_string(t.sents[greatest(len(t.sents) - 2, 1):], ' ')", words)} AS tail
  FROM tsplit t),
base AS (
  SELECT t.trace_id, {keys}, t.blank,
    CAST(coalesce(ms.total, 0) AS INTEGER) AS total_hedges,
    CAST(coalesce(ms.resolved, 0) AS INTEGER) AS resolved_hedges,
    CASE WHEN coalesce(ms.total, 0) = 0 THEN 0.0 ELSE {round4('ms.resolved / ms.total')} END AS trur,
    CASE WHEN coalesce(ms.total, 0) = 0 THEN 0.0 ELSE {round4('ms.wsum / ms.total')} END AS weighted_trur,
    CAST(coalesce(vs.nver, 0) AS INTEGER) AS nver,
    CASE WHEN coalesce(ms.total, 0) = 0 THEN 0.0 ELSE {round4('ms.total / greatest(1, coalesce(vs.nver, 0))')} END AS hvr,
    CASE WHEN coalesce(ls.unres, 0) = 0 OR len(t.sents) = 0 THEN 0.0 ELSE {round4('ls.late / ls.unres')} END AS late,
    {finality('tl.tail', words)} AS fin
  FROM tsplit t
  LEFT JOIN mstats ms ON ms.trace_id = t.trace_id
  LEFT JOIN lstats ls ON ls.trace_id = t.trace_id
  LEFT JOIN vstats vs ON vs.trace_id = t.trace_id
  LEFT JOIN tails tl ON tl.trace_id = t.trace_id),
metrics AS (
  SELECT trace_id, {keys}, total_hedges, resolved_hedges,
    CAST(total_hedges - resolved_hedges AS INTEGER) AS unresolved_hedges,
    trur, weighted_trur,
    CASE WHEN NOT blank THEN nver END AS total_verifications,
    CASE WHEN NOT blank THEN hvr END AS hvr,
    CASE WHEN NOT blank THEN late END AS late_unresolved_ratio,
    CASE WHEN NOT blank THEN fin END AS conclusion_finality,
    CASE WHEN blank THEN NULL
         WHEN total_hedges = 0 THEN 'Certain'
         WHEN total_hedges < {lexicon.MIN_HEDGES_FOR_CERTAIN} THEN 'Uncertain'
         WHEN trur * {lexicon.TRUR_WEIGHT} + (1.0 / (1.0 + hvr)) * {lexicon.HVR_WEIGHT}
              + (1.0 - late) * (CASE WHEN trur > 0 THEN {lexicon.FINALITY_POSITION_WEIGHTS_RESOLVED[1]} ELSE {lexicon.FINALITY_POSITION_WEIGHTS_UNRESOLVED[1]} END)
              + ((fin + 1.0) / 2.0) * (CASE WHEN trur > 0 THEN {lexicon.FINALITY_POSITION_WEIGHTS_RESOLVED[0]} ELSE {lexicon.FINALITY_POSITION_WEIGHTS_UNRESOLVED[0]} END) >= {lexicon.CERTAIN_CUTOFF} THEN 'Certain'
         ELSE 'Uncertain' END AS predicted_certainty
  FROM base)
"""
