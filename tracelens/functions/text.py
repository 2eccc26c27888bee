"""Text expressions: newline normalisation, sentence splitting, stripping and
regex subject extraction.

Everything here returns a ``Column`` built from JVM-side built-ins and
higher-order functions, so Catalyst folds the literals once and the work stays
inside the executor with no Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace, as Python's ``str.isspace`` defines it (Unicode White_Space plus
# the four ASCII separators 0x1C-0x1F). Java's ASCII ``\s`` misses NBSP and the
# other Unicode spaces, so an explicit class is used everywhere. The same class
# text is valid for RE2, which keeps the Spark and DuckDB forms identical.
WS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Sentence boundary: a terminal mark followed by whitespace. Rewriting it to
# "mark + newline" and splitting on newlines equals a look-behind split at the
# mark, a split at blank lines and a split at every remaining newline.
SENTENCE_BREAK = rf"([.!?]){WS}+"

# FIXED VALUES: subject extraction patterns (applied to the lower-cased,
# stripped sentence). Their word lists and terminators must equal the
# reference's; only the whitespace class is spelled out (see WS).
# Step (a): the target of "not sure / uncertain / unsure / not certain about".
SUBJECT_ABOUT = (
    rf"(?s)(?:not{WS}+sure|uncertain|unsure|not{WS}+certain){WS}+about{WS}+(.+?)(?:\.|,|;|$)"
)
# Step (b1): one leading opener phrase.
SUBJECT_OPENER = (
    r"^(?:i think|i believe|let me|maybe|perhaps|possibly|probably|"
    rf"i'm not sure|i am not sure|it seems|it appears|however,?){WS}+"
)
# Step (b2): one leading verb, with an optional article or complementiser.
SUBJECT_VERB = (
    r"^(?:verify|check|confirm|recalculate|validate|test|review|inspect|determine|conclude)"
    rf"{WS}+(?:the{WS}+|that{WS}+|if{WS}+)?"
)
# Step (c): shortest lower-case prefix before an auxiliary verb or punctuation.
SUBJECT_HEAD = (
    r"^([a-z][a-z0-9 \-]*?)"
    rf"(?:{WS}+(?:is|are|was|were|might|could|seems|appears|will|has|have)\b|[,.;:]|$)"
)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def normalize_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def is_blank(c: Column) -> Column:
    """Null, empty or whitespace-only text."""
    return c.isNull() | (strip_ws(c) == F.lit(""))


def split_sentences(text: Column) -> Column:
    """``ARRAY<STRING>`` of stripped, non-empty sentences, in order.

    Null text gives an empty array, so a blank trace scores as zero hedges.
    """
    pieces = F.split(F.regexp_replace(normalize_newlines(text), SENTENCE_BREAK, "$1\n"), "\n")
    stripped = F.transform(pieces, strip_ws)
    return F.coalesce(
        F.filter(stripped, lambda s: s != F.lit("")),
        F.array().cast("array<string>"),
    )


def subject_parts(sentence: Column) -> Column:
    """First half of the regex subject extractor.

    Returns ``struct(about, cleaned)``: the step (a) target when the sentence
    matches it (else null) and the sentence after the opener and verb removal.
    Materialising these as struct fields lets the second half reference them
    without recomputing the regex chain.
    """
    text = strip_ws(F.lower(sentence))
    about = F.when(text.rlike(SUBJECT_ABOUT), strip_ws(F.regexp_extract(text, SUBJECT_ABOUT, 1)))
    cleaned = F.regexp_replace(F.regexp_replace(text, SUBJECT_OPENER, ""), SUBJECT_VERB, "")
    return F.struct(about.alias("about"), cleaned.alias("cleaned"))


def subject_from_parts(parts: Column, sentence: Column) -> Column:
    """Second half of the regex subject extractor (steps c and d)."""
    cleaned = parts["cleaned"]
    head = strip_ws(F.regexp_extract(cleaned, SUBJECT_HEAD, 1))
    words = F.filter(F.split(cleaned, rf"{WS}+"), lambda w: w != F.lit(""))
    first_three = F.array_join(F.slice(words, 1, 3), " ")
    return (
        F.when(parts["about"].isNotNull(), parts["about"])
        .when(head != F.lit(""), head)
        .when(F.size(words) > 0, first_three)
        .otherwise(F.substring(sentence, 1, 30))
    )


def extract_subject(sentence: Column) -> Column:
    """Regex subject of one sentence (single-expression convenience form)."""
    return subject_from_parts(subject_parts(sentence), sentence)


# FIXED VALUES (ours): words skipped when taking content words after a hedge
# keyword (articles, determiners, prepositions, pronouns, auxiliaries). They
# stand in for the part-of-speech filter a parser would apply.
SKIP_WORDS = [
    "a", "an", "the", "this", "that", "these", "those", "of", "to", "in", "on", "at", "for", "with", "by",
    "from", "as", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does",
    "did", "has", "have", "had", "will", "would", "can", "could", "should", "shall", "may", "might", "must",
    "it", "its", "i", "we", "you", "he", "she", "they", "me", "my", "our", "your", "their", "not", "no", "so",
    "if", "then", "than", "there", "here",
]
EDGE_PUNCT = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
KEYWORD_WINDOW = 5
KEYWORD_TAKE = 2


def sentence_tokens(sentence: Column) -> Column:
    """Lower-cased whitespace tokens with edge punctuation removed."""
    parts = F.split(F.lower(sentence), rf"{WS}+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, EDGE_PUNCT, "")), lambda t: t != F.lit(""))


def keyword_window_subject(sentence: Column, keyword: Column) -> Column:
    """Subject from the words just after the matched keyword (approximation).

    Finds the keyword's words (split on spaces) in the sentence tokens, takes
    the next five tokens, drops skip words and keeps the first two. A keyword
    that is not found (one ending in a comma, say) or a window with no content
    word falls back to the regex subject. This re-aims a parser's
    "noun phrase right after the hedge" without part-of-speech tags.
    """
    skip = F.array(*[F.lit(w) for w in SKIP_WORDS])

    def content(x: Column) -> Column:
        """Content words of the window; null where the keyword is not found."""
        n = F.size(x["kw"])
        first = F.get(F.filter(F.sequence(F.lit(1), F.size(x["toks"]) - n + 1), lambda i: F.slice(x["toks"], i, n) == x["kw"]), 0)
        start = F.when(F.size(x["toks"]) >= n, first)
        return F.filter(F.slice(x["toks"], start + n, KEYWORD_WINDOW), lambda t: ~F.array_contains(skip, t))

    def subject(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, KEYWORD_TAKE), " "))

    # tokens and words are bound as lambda variables, so that each is made once per sentence
    parts = F.when(keyword.isNotNull(), F.struct(sentence_tokens(sentence).alias("toks"), F.split(F.lower(keyword), " ").alias("kw")))
    found = F.get(F.transform(F.transform(F.array(parts), content), subject), 0)
    return F.coalesce(found, extract_subject(sentence))


def keyword_window_extractor():
    """``extractor=`` plug-in for :func:`tracelens.operators.score.score_traces`."""

    def run(pairs):
        return pairs.select("sentence", "keyword", keyword_window_subject(F.col("sentence"), F.col("keyword")).alias("subject"))

    return run
