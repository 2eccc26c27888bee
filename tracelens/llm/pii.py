"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Emails, IP addresses, card and phone numbers are found by fixed patterns; they
are the seeds, and so are words that look like keys (``SHAPED``). A lexical
pattern is what stands beside a mention in its line: the two words before it
(the line's start counts as one), the word before it, or the word after it. From the
seeds Spark builds a graph of patterns and instances (the mentioned
strings: seeds, and other words with a digit that no fixed pattern covers) and
scores it in rounds:

* a pattern's confidence is the score-weighted number of its mentions, divided
  by all places where its words occur like that in the corpus, whatever they stand beside;
* an instance's score is 1 for a seed, else the chance that not all of its
  accepted patterns err.

Patterns with enough different instances and a confidence of at least
``LEAST`` are accepted, and stay so; the rounds end when no pattern is added.
All words beside accepted patterns, whatever their length and letters, then
become spans of kind ``id``. Since every occurrence of a pattern's words counts,
ordinary words that merely happen to stand beside seeds never reach that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

KINDS = ("email", "ip", "card", "phone")
FOUND_KIND = "id"
LEAST, MIN_INSTANCES = 0.6, 3
#: What a key or token looks like: letters and digits of one word, several of each.
SHAPED = re.compile(r"(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_=-]{20,200}")
#: Bits of the map of patterns that the counting pass looks for.
BITS = 1 << 23
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the same leftmost matches as without the look behind and the possessive digits, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
QUOTES = "\"'([{<`"
ENDS = QUOTES + ")]}>.,;:!?*#%&$|"
#: Words longer than this stand for themselves by a hash, as instances and as context.
LONG_WORD = 64
LINE_START = "^"
SCAN_SCHEMA = "doc_id long, tk long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<instance:string,patterns:array<string>,seed:boolean>>"


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each fixed kind."""
    digits = DIGIT.search(text) is not None
    ips, cards, phones = [], [], []
    if digits:
        ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                cards.append(m.span())
        phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return {"email": emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones}


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def context_word(word: str) -> str:
    """A word as context: lower case, all digits alike, long words by a hash."""
    word = DIGIT.sub("0", word.lower())
    return word if len(word) <= LONG_WORD else f"#{xxhash.xxh3_64_hexdigest(word)}"


def patterns_at(words: list[str], i: int, last: int | None = None) -> list[str]:
    """The patterns of the words ``i`` to ``last`` of a line of context words."""
    out = []
    if i:
        out = [f"2 {words[i - 2] if i > 1 else LINE_START} {words[i - 1]}", f"1 {words[i - 1]}"]
    if (i if last is None else last) + 1 < len(words):
        out.append(f"r {words[(i if last is None else last) + 1]}")
    return out


WORD = re.compile(r"\S+")


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of each line."""
    start = 0
    for line in text.split("\n"):
        yield start, line
        start += len(line) + 1


def bare(text: str, a: int, b: int) -> tuple[int, int]:
    """A word's bounds without quotes before it and punctuation behind it."""
    word = text[a:b]
    return a + len(word) - len(word.lstrip(QUOTES)), b - (len(word) - len(word.rstrip(ENDS)))


def instance_of(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG_WORD else f"#{xxhash.xxh3_64_hexdigest(word)}"


def mentions(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, list[str], bool]]:
    """(instance, patterns, is a seed) of seeds that begin a word, and of words with a digit outside all seeds."""
    if not DIGIT.search(text) and not spans["email"]:
        return []
    taken = sorted(s for kind in KINDS for s in spans[kind])
    out, k, reach = [], 0, 0
    for start, line in lines_of(text):
        if not DIGIT.search(line) and "@" not in line:
            continue
        places = [(start + m.start(), start + m.end()) for m in WORD.finditer(line)]
        words: list[str] = []
        for i, (a, b) in enumerate(places):
            if (k == len(taken) or taken[k][0] >= b) and not DIGIT.search(text, a, b):
                continue
            p, q = bare(text, a, b)
            while k < len(taken) and taken[k][0] < p:
                reach = max(reach, taken[k][1])
                k += 1
            seed = taken[k] if k < len(taken) and taken[k][0] == p else None
            if p >= q or (seed is None and (p < reach or (k < len(taken) and taken[k][0] < q) or not DIGIT.search(text, p, q))):
                continue
            words = words or [context_word(text[x:y]) for x, y in places]
            last = i
            while seed and last + 1 < len(places) and places[last + 1][0] < seed[1]:
                last += 1
            own = patterns_at(words, i, last)
            if own:
                found = text[p : seed[1]] if seed else text[p:q]
                out.append((instance_of(found), own, seed is not None or SHAPED.fullmatch(found) is not None))
    return out


class _Kept(dict):
    """Results of a function of words; started anew when there are many."""

    def __init__(self, fn: Callable[[str], object]):
        super().__init__()
        self.fn = fn

    def __missing__(self, word: str):
        if len(self) > 1 << 18:
            self.clear()
        out = self[word] = self.fn(word)
        return out


def bit_of(string: str) -> int:
    return xxhash.xxh32_intdigest(string) % BITS


def keys_of(pattern: str) -> list[str]:
    """A pattern, and what its words are in it."""
    kind, *words = pattern.split(" ")
    return [pattern, f"k {words[-1]}"] if kind != "2" else [pattern, f"k {words[1]}", f"b {words[1]}", f"a {words[0]}"]


def folded(text: str) -> str:
    """A text whose words are context words, but for long ones."""
    text = text.lower()
    return DIGIT.sub("0", text) if DIGIT.search(text) else text


def line_words(folded_line: str) -> list[str]:
    words = folded_line.split()
    return [context_word(w) for w in words] if any(map(LONG_WORD.__lt__, map(len, words))) else words


class Wanted:
    """Which strings may be wanted patterns, by a map of fixed size, and which words may be part of one."""

    def __init__(self, table: bytes):
        self.table = table
        self.key, self.first, self.second = (_Kept(lambda w, kind=kind: self._bit(f"{kind} {w}")) for kind in "kab")

    @classmethod
    def of(cls, patterns: Iterable[str]) -> Wanted:
        table = bytearray(BITS // 8)
        for bit in (bit_of(x) for p in patterns for x in keys_of(p)):
            table[bit >> 3] |= 1 << (bit & 7)
        return cls(bytes(table))

    def _bit(self, string: str) -> int:
        bit = xxhash.xxh32_intdigest(string) % BITS
        return self.table[bit >> 3] >> (bit & 7) & 1

    def __contains__(self, pattern: str) -> bool:
        return bool(self._bit(pattern))


def behind(text: str, wanted: Wanted) -> list[tuple[int, int, list[str]]]:
    """(start, end, wanted patterns) of words outside the fixed kinds' spans."""
    key = wanted.key
    if not any(key[w] for w in set(line_words(folded(text)))):
        return []
    taken = sorted(s for own in base_spans(text).values() for s in own)
    out, k, reach = [], 0, 0
    for start, line in lines_of(text):
        places = [(m.start(), m.end()) for m in WORD.finditer(line)]
        words = [context_word(line[a:b]) for a, b in places]
        for i in sorted({j for i, w in enumerate(words) if key[w] for j in (i - 1, i + 1) if 0 <= j < len(words)}):
            own = [p for p in patterns_at(words, i) if p in wanted]
            if not own:
                continue
            p, q = bare(text, start + places[i][0], start + places[i][1])
            while k < len(taken) and taken[k][0] < q:
                reach = max(reach, taken[k][1])
                k += 1
            if p < q and p >= reach:
                out.append((p, q, own))
    return out


def counted_patterns(texts: Iterable[str], wanted: Wanted) -> Counter[str]:
    """How many words of the texts have each wanted pattern beside them."""
    first, second = wanted.first, wanted.second
    before: Counter[str] = Counter()
    after: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    for text in texts:
        for line in folded(text).split("\n"):
            words = line_words(line)
            if len(words) < 2:
                continue
            before.update(words[:-1])
            after.update(words[1:])
            own = [(a, b) for a, b in zip([LINE_START, *words], words[:-1], strict=False) if second[b] and first[a]]
            if own:
                pairs.update(own)
    key = wanted.key
    total = {f"1 {w}": n for w, n in before.items() if key[w]} | {f"r {w}": n for w, n in after.items() if key[w]}
    total |= {f"2 {a} {b}": n for (a, b), n in pairs.items()}
    return Counter({p: n for p, n in total.items() if p in wanted})


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and mentions of each row; ``tk`` is a hash of the text."""
    names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
    item = pa.struct([("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, base, found = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                counts.append([len(spans[k]) for k in KINDS])
                base.append(listed(spans))
                found.append([dict(zip(("instance", "patterns", "seed"), m, strict=True)) for m in mentions(text, spans)])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(base, pa.string()), pa.array(found, pa.list_(item))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, SCAN_SCHEMA)


def bit_map(patterns: DataFrame) -> bytes:
    """A map of fixed size that says which strings may be among ``patterns``."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bit_of(x) for p in batch.column(0).to_pylist() for x in keys_of(p)], pa.int32())], names=["bit"])

    at = patterns.select("pattern").mapInArrow(bits, "bit int").distinct().toArrow().column("bit").to_numpy()
    table = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return table.tobytes()


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): beside how many words each pattern's words stand in all texts.

    The join with ``patterns`` drops strings that only share a bit with one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(patterns))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(shared.value)
        for batch in slices(batches):
            total = counted_patterns([t for t in batch.column(0).to_pylist() if t], wanted)
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["pattern", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return sums.join(patterns.select("pattern"), "pattern")


def accepted_patterns(docs: DataFrame, scanned: DataFrame, least: float = LEAST, min_instances: int = MIN_INSTANCES) -> DataFrame | None:
    """(pattern, confidence) of the patterns that end up accepted; None when there is none."""
    each = scanned.select(F.explode("found").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.seed")
    graph = written(each.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-graph")
    often = graph.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= min_instances)
    often = written(often.select("pattern"), "pii-patterns")
    if often.isEmpty():
        return None
    totals = written(occurrences(docs, often), "pii-totals")
    graph = written(graph.join(often, "pattern", "left_semi"), "pii-graph")
    scores = written(graph.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "pii-scores")
    accepted = None
    while True:
        # sums are made before the totals are joined, so that a frequent pattern is not one task's join
        support = graph.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("support"), F.count_if(F.col("score") >= 0.5).alias("k"))
        found = support.where(F.col("k") >= min_instances).join(totals, "pattern").select("pattern", F.least(F.col("support") / F.col("total"), F.lit(1.0)).alias("confidence"))
        found = found.where(F.col("confidence") >= least)
        if accepted is None:
            accepted = written(found, "pii-accepted")
            if accepted.isEmpty():
                return None
        else:
            more = written(found.join(accepted, "pattern", "left_anti"), "pii-accepted")
            if more.isEmpty():
                return accepted
            accepted = written(accepted.union(more), "pii-accepted")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
        scores = graph.join(accepted, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score"))
        scores = written(scores, "pii-scores")


def discovered(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(tk, more): the spans (start, stop) of words beside accepted ``patterns``, once per text that has any."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(patterns))
    schema = "tk long, start int, stop int, pattern string"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(shared.value)
        for batch in slices(batches):
            rows = [
                (tk, a, b, p)
                for tk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if text
                for a, b, own in behind(text, wanted)
                for p in own
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["tk", "start", "stop", "pattern"])

    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").alias("text"))
    each = texts.mapInArrow(found, schema).distinct().join(patterns.select("pattern"), "pattern", "left_semi")
    return each.groupBy("tk").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, tk, n_email, n_ip, n_card, n_phone, base, spans.

    ``base`` lists the fixed kinds' spans as kind:start:end, by kind and start;
    ``spans`` adds the discovered ones, of kind ``id``. ``tk`` is a 64-bit hash
    of the text: rows of equal text, also repeated rows, have equal spans, and
    each counts as a text of the corpus. Null texts count as
    empty; other columns are left out.
    """
    scanned = written(scan(docs), "pii-scan")
    patterns = accepted_patterns(docs, scanned)
    if patterns is None:
        return scanned.drop("found").withColumn("spans", F.col("base"))
    # a table of its own, so that the join can split a text that many rows share
    more = written(discovered(docs, patterns), "pii-more")
    text = F.transform("more", lambda s: F.concat_ws(":", F.lit(FOUND_KIND), s["start"].cast("string"), s["stop"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), F.coalesce(text, F.array().cast("array<string>"))), lambda s: s != ""), ",")
    return scanned.drop("found").join(more, "tk", "left").withColumn("spans", spans).drop("more")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Each row stays, also repeated ones; null texts stay null, other columns as
    they are.
    """

    @F.pandas_udf("string")
    def masked(texts, spans):
        import pandas as pd

        return pd.Series([masked_text(t, s) for t, s in zip(texts, spans, strict=True)])

    spans = find(docs).where("spans <> ''").groupBy("tk").agg(F.first("spans").alias("__spans"))
    tk = F.xxhash64(F.col("text").cast("string"))
    out = docs.join(spans.withColumnRenamed("tk", "__tk"), tk == F.col("__tk"), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.coalesce("__spans", F.lit(""))))
    return out.withColumn("text", text).select(*docs.columns)


def masked_text(text: str | None, spans: str | None) -> str | None:
    if not spans or text is None:
        return text
    found = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]

