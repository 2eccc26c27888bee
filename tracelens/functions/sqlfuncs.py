"""The scoring scalars as SQL functions, for users who write Spark SQL.

``register_functions(spark)`` creates session-scoped SQL UDFs
(``CREATE TEMPORARY FUNCTION ... RETURN <expr>``). Their bodies are plain SQL
expressions, so Catalyst inlines them into the calling plan: no Python runs.
Local names are bound with a one-element ``transform`` (SQL bodies have no
variables), so each intermediate value is computed once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracelens.functions import lexicon, text


def _arr(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _re(p: str) -> str:
    assert '"' not in p
    return f'r"{p}"'


WS = text.WS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_re(f'^{WS}+|{WS}+$')}, '')"


def _bind(value: str, var: str, body: str) -> str:
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def definitions() -> dict[str, str]:
    """``name -> CREATE TEMPORARY FUNCTION`` statement."""
    split = (
        "coalesce(filter(transform(split(regexp_replace(regexp_replace(t, r'\\r\\n?', '\\n'), "
        f"{_re(text.SENTENCE_BREAK)}, '$1\\n'), '\\n', -1), p -> {_strip('p')}), p -> p <> ''), array())"
    )
    words = f"filter(split(c, {_re(WS + '+')}), w -> w <> '')"
    head = _strip(f"regexp_extract(c, {_re(text.SUBJECT_HEAD)}, 1)")
    after_about = _bind(
        f"regexp_replace(regexp_replace(l, {_re(text.SUBJECT_OPENER)}, ''), {_re(text.SUBJECT_VERB)}, '')",
        "c",
        f"CASE WHEN {head} <> '' THEN {head} "
        f"WHEN size({words}) > 0 THEN array_join(slice({words}, 1, 3), ' ') "
        "ELSE substring(s, 1, 30) END",
    )
    subject = _bind(
        _strip("lower(s)"),
        "l",
        f"CASE WHEN l RLIKE {_re(text.SUBJECT_ABOUT)} THEN {_strip(f'regexp_extract(l, {_re(text.SUBJECT_ABOUT)}, 1)')} "
        f"ELSE {after_about} END",
    )
    def round4(v: str) -> str:
        return f"CAST(regexp_replace(format_number({v}, 4), ',', '') AS DOUBLE)"

    fin_c = f"size(filter({_arr(lexicon.FINALITY_CERTAIN)}, k -> contains(tail, k)))"
    fin_u = f"size(filter({_arr(lexicon.FINALITY_UNCERTAIN)}, k -> contains(tail, k)))"
    finality = _bind(
        "lower(array_join(slice(sents, greatest(size(sents) - 2, 1), 3), ' '))",
        "tail",
        _bind(
            f"named_struct('c', {fin_c}, 'u', {fin_u})",
            "n",
            f"CASE WHEN n.c + n.u = 0 THEN 0.0 ELSE {round4('(n.c - n.u) / (n.c + n.u)')} END",
        ),
    )
    bodies = {
        "split_sentences": ("t STRING", "ARRAY<STRING>", split),
        "strip_ws": ("x STRING", "STRING", _strip("x")),
        "hedge_keyword": ("s STRING", "STRING", _bind("lower(s)", "l", f"get(filter({_arr(lexicon.HEDGE_KEYWORDS)}, k -> contains(l, k)), 0)")),
        "verification_count": ("s STRING", "INT", _bind("lower(s)", "l", f"size(filter({_arr(lexicon.VERIFICATION_KEYWORDS)}, k -> contains(l, k)))")),
        "is_verification": ("s STRING", "BOOLEAN", _bind("lower(s)", "l", f"exists({_arr(lexicon.VERIFICATION_KEYWORDS)}, k -> contains(l, k))")),
        "extract_subject": ("s STRING", "STRING", subject),
        "proximity_score": (f"gap INT, decay DOUBLE DEFAULT {lexicon.PROXIMITY_DECAY}", "DOUBLE", "exp(-gap / decay)"),
        "match_score": (
            f"sim DOUBLE, prox DOUBLE, w_sim DOUBLE DEFAULT {lexicon.MATCH_WEIGHTS[0]}, w_prox DOUBLE DEFAULT {lexicon.MATCH_WEIGHTS[1]}",
            "DOUBLE",
            "w_sim * sim + w_prox * prox",
        ),
        "round4": ("x DOUBLE", "DOUBLE", round4("x")),
        "conclusion_finality": ("sents ARRAY<STRING>", "DOUBLE", finality),
    }
    return {
        name: f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}"
        for name, (args, ret, body) in bodies.items()
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the SQL functions in this session; returns their names."""
    defs = definitions()
    for stmt in defs.values():
        spark.sql(stmt)
    return list(defs)
