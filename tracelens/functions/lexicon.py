"""Keyword lexicons and label sets.

FIXED VALUES. The phrase lists below must equal the reference's lists entry for
entry and in the same order: detection is by raw substring over lower-cased text,
the first hedge phrase *in list order* is the one reported, and the verification
count includes the duplicated ``therefore``. Do not sort or deduplicate them.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- FIXED VALUES: hedge phrases, in list order (61 entries) -----------------
HEDGE_KEYWORDS: list[str] = [
    "maybe", "perhaps", "might", "could", "possibly", "probably",
    "i think", "i believe", "not sure", "uncertain", "seems", "appears",
    "likely", "unlikely",
    "assume", "aim for", "decent", "typically", "let's assume", "let's say",
    "i'm not certain", "i can't be sure", "i cannot be sure", "not entirely sure",
    "not entirely clear", "not certain", "not obviously", "not obvious",
    "i'm unsure", "i am unsure", "hard to say", "difficult to determine",
    "unclear", "ambiguous",
    "on second thought", "let me reconsider", "i need to reconsider",
    "i might be wrong", "i may have made an error", "hold on,", "wait,", "hmm,",
    "there's a possibility", "there is a possibility", "one possibility",
    "another possibility", "it's possible", "it is possible", "there may be",
    "alternatively",
    "approximately", "roughly", "more or less",
    "i suspect", "i suppose", "i wonder", "i'd guess", "in my estimation",
    "not necessarily", "to some extent", "considering",
]

# --- FIXED VALUES: verification phrases, in list order (73 entries) ----------
# ``therefore`` appears twice on purpose (it counts twice toward dominance).
VERIFICATION_KEYWORDS: list[str] = [
    "verify", "check", "confirm", "recalculate", "validate", "test",
    "review", "inspect", "determine", "conclude", "therefore", "indeed",
    "confirmed",
    "make sure", "count the lines", "double-check", "accuracy", "refine",
    "perfect", "done",
    "it follows that", "as a result", "consequently", "this implies",
    "this indicates", "therefore", "hence", "thus",
    "the conclusion is", "in conclusion", "to conclude", "to summarize",
    "in summary", "the answer is", "the result is", "we can conclude",
    "i can conclude", "i conclude",
    "let me recalculate", "let me recompute", "let me re-examine",
    "let me calculate", "let me compute", "let me confirm", "let me examine",
    "let me verify", "let me check", "i will verify", "i should verify",
    "i should check",
    "upon closer inspection", "upon examination", "upon reflection",
    "after reviewing", "after checking", "after analysis", "having confirmed",
    "having verified", "consistent with", "this is consistent", "aligns with",
    "corroborates", "as demonstrated", "as shown",
    "i am confident", "i'm confident", "i can confirm", "it is confirmed",
    "it is evident", "it is clear", "without doubt", "no doubt", "considering",
]

# --- FIXED VALUES: conclusion-finality phrases (19 and 15 entries) ----------
FINALITY_CERTAIN: list[str] = [
    "therefore", "thus", "hence", "consequently", "as a result",
    "i can conclude", "the answer is", "the conclusion is",
    "with confidence", "can be stated", "has been confirmed",
    "is confirmed", "is verified", "without doubt",
    "definitively", "unambiguously", "can be stated with confidence",
    "the evidence fully supports", "fully supports",
]

FINALITY_UNCERTAIN: list[str] = [
    "still not sure", "still uncertain", "remains unclear",
    "cannot determine", "cannot conclude", "unable to confirm",
    "i'm not sure", "i am not sure", "unclear", "ambiguous",
    "further investigation", "more information needed",
    "insufficient evidence", "inconclusive", "remains open",
]

# --- FIXED VALUES: evaluation label sets ------------------------------------
# Expected labels in the order the accuracy report searches them.
EXPECTED_LABELS: list[str] = [
    "Unresolved Uncertainty",
    "Resolved Uncertainty",
    "Partially Resolved",
    "Certain",
]
PREDICTED_LABELS: list[str] = ["Certain", "Uncertain"]
CERTAINTY_LEVEL_ORDER: list[str] = ["High", "Medium", "Low"]

# --- FIXED VALUES: provider keys and request defaults -----------------------
PROVIDERS: list[str] = ["openai", "google", "aws_bedrock"]
DEFAULT_TEMPERATURE = 0.0
DEFAULT_TOP_P = 1.0
DEFAULT_MAX_TOKENS = 16384
DEFAULT_TIMEOUT_S = 30.0
DEFAULT_AWS_REGION = "us-east-1"
DEFAULT_PROMPT = "Explain the core benefit of the Strategy Design Pattern in exactly two sentences."

# --- FIXED VALUES: scoring defaults -------------------------------------------
SIMILARITY_THRESHOLD = 0.60
PROXIMITY_DECAY = 50.0
MATCH_WEIGHTS = (0.7, 0.3)
RESOLUTION_WEIGHT_REDUCTION = 0.8
REUSE_SIMILARITY = 0.90
FINALITY_WINDOW = 3
CERTAIN_CUTOFF = 0.50
MIN_HEDGES_FOR_CERTAIN = 3
# certainty score: weight of TRUR, of 1/(1+HVR); (finality, position) weights
# when some hedge resolved, and when none did
TRUR_WEIGHT = 0.15
HVR_WEIGHT = 0.45
FINALITY_POSITION_WEIGHTS_RESOLVED = (0.15, 0.25)
FINALITY_POSITION_WEIGHTS_UNRESOLVED = (0.05, 0.35)


@dataclass(frozen=True)
class Lexicon:
    """Phrases a scoring run looks for, in list order (see the fixed lists above).

    ``fold_apostrophes`` lets curly apostrophes in a text match straight ones
    in a phrase; sentences are reported as they stand.
    """

    hedges: tuple[str, ...] = tuple(HEDGE_KEYWORDS)
    verifications: tuple[str, ...] = tuple(VERIFICATION_KEYWORDS)
    certain: tuple[str, ...] = tuple(FINALITY_CERTAIN)
    uncertain: tuple[str, ...] = tuple(FINALITY_UNCERTAIN)
    fold_apostrophes: bool = False


DEFAULT = Lexicon()
