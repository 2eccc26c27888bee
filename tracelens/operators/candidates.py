"""Candidate verifications of a hedge, without meeting all of its trace.

A hedge's best verification maximises ``0.7 * similarity + 0.3 * proximity``.
Proximity falls with distance, so among verifications of equal similarity only
the nearest can win. That turns "all later verifications" into a few lists per
hedge, each read from its nearest member outward:

* every verification of the trace (similarity at least 0);
* the verifications of one subject, where hedge and subject share a *rare*
  term, one that at most ``RARE`` subjects of the trace hold (exact similarity);
* the verifications that hold a given set of *common* terms with given counts
  and length. A class holds all of them whatever else they say, so that its
  similarity to the hedge is a lower bound, and exact for those that share no
  more with the hedge.

The best verification shares some set of terms with the hedge. If one is rare,
it is in that subject's list; if all are common, it is in the class of just
that set; if there is none, it is in the first list. In its own list its
similarity is exact, and it is the nearest allowed member: a nearer one would
score higher. So the nearest allowed member of each list, with the list's
similarity, is enough, and rows grow with hedges and verifications also where
all subjects share a word. A class whose members are those of a larger class
that the hedge also meets is left out.

A subject of k common terms is in 2^k - 1 classes. Subjects with more than
``CLASS_TERMS`` common terms are met through their terms instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import similarity
from tracelens.operators import scans

#: Subjects of a trace that may hold a rare term; common terms a subject may have to be dealt to classes.
RARE, CLASS_TERMS = 16, 6
#: The list of all verifications of a trace.
EVERY = 0


def _with_terms(subjects: DataFrame) -> DataFrame:
    """``terms`` (distinct terms with counts, sorted) and ``n2`` (squared length of the counts) of each subject."""
    toks = subjects.withColumn("_toks", similarity.subject_tokens(F.col("subject")))
    counts = F.transform(F.array_sort(F.array_distinct("_toks")), lambda t: F.struct(t.alias("tok"), F.size(F.filter("_toks", lambda u: u == t)).alias("cnt")))
    n2 = F.aggregate("terms", F.lit(0), lambda acc, x: acc + x["cnt"] * x["cnt"])
    return toks.withColumn("terms", counts).withColumn("n2", n2).drop("_toks").where(F.size("terms") > 0)


def _cosine(dot: Column, a2: Column, b2: Column) -> Column:
    return F.least(F.greatest(dot / (F.sqrt(a2) * F.sqrt(b2)), F.lit(0.0)), F.lit(1.0))


def _dot(a: Column, b: Column) -> Column:
    other = F.map_from_entries(b)
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x["cnt"] * F.coalesce(F.element_at(other, x["tok"]), F.lit(0)))


def _subsets(terms: str) -> Column:
    """All non-empty subsets of a short array, in its order."""
    return F.expr(f"transform(sequence(1, shiftleft(1, size({terms})) - 1), m -> filter({terms}, (t, i) -> shiftright(m, i) % 2 = 1))")


def _subject_class(subject: Column) -> Column:
    return F.xxhash64(F.lit("subject"), subject)


def subject_links(hedges: DataFrame, vers: DataFrame, rare: int = RARE, class_terms: int = CLASS_TERMS) -> tuple[DataFrame, DataFrame]:
    """Lists by subject: ``(trace_id, hsubject, cls, sim)`` for hedge subjects, and ``(trace_id, subject, cls)`` for verification subjects.

    ``sim`` is positive, and at most the similarity of the hedge subject to
    each member of the list.
    """
    hs = scans.materialize(_with_terms(hedges.select("trace_id", "subject").distinct()))
    gs = scans.materialize(_with_terms(vers.groupBy("trace_id", "subject").agg(F.count(F.lit(1)).alias("n"))))

    def by_term(df: DataFrame) -> DataFrame:
        return df.select("trace_id", "subject", F.explode("terms").alias("t")).select("trace_id", "subject", F.col("t.tok").alias("tok"), F.col("t.cnt").alias("cnt"))

    h, g = by_term(hs), by_term(gs)
    spread = scans.materialize(g.groupBy("trace_id", "tok").agg(F.count(F.lit(1)).alias("_held")))
    few = g.join(spread.where(F.col("_held") <= rare), ["trace_id", "tok"], "left_semi")
    pairs = h.select("trace_id", "tok", F.col("subject").alias("hsubject")).join(few.select("trace_id", "tok", "subject"), ["trace_id", "tok"]).drop("tok").distinct()
    often = spread.where(F.col("_held") > rare).drop("_held")
    classes = None
    if not often.isEmpty():

        def common(terms: DataFrame, subjects: DataFrame) -> DataFrame:
            own = terms.join(often, ["trace_id", "tok"], "left_semi").groupBy("trace_id", "subject").agg(F.sort_array(F.collect_list(F.struct("tok", "cnt"))).alias("common"))
            return scans.materialize(subjects.drop("terms").join(own, ["trace_id", "subject"]))

        hc, gc = common(h, hs), common(g, gs)
        many = F.size("common") > class_terms

        def long_terms(df: DataFrame, name: str) -> DataFrame:
            return df.select("trace_id", F.col("subject").alias(name), many.alias(f"{name}_many"), F.explode("common.tok").alias("tok"))

        long_pairs = long_terms(hc, "hsubject").join(long_terms(gc, "subject"), ["trace_id", "tok"]).where(F.col("hsubject_many") | F.col("subject_many"))
        pairs = pairs.unionByName(long_pairs.select("trace_id", "hsubject", "subject")).distinct()
        classes = _class_links(hc.where(~many), gc.where(~many))
    pairs = pairs.join(hs.select("trace_id", F.col("subject").alias("hsubject"), F.col("terms").alias("hterms"), F.col("n2").alias("hn2")), ["trace_id", "hsubject"])
    pairs = pairs.join(gs.select("trace_id", "subject", "terms", "n2"), ["trace_id", "subject"])
    single = scans.materialize(pairs.select("trace_id", "hsubject", "subject", _cosine(_dot(F.col("hterms"), F.col("terms")), F.col("hn2"), F.col("n2")).alias("sim")))
    links = single.select("trace_id", "hsubject", _subject_class(F.col("subject")).alias("cls"), "sim")
    members = single.select("trace_id", "subject", _subject_class(F.col("subject")).alias("cls")).distinct()
    if classes is not None:
        links, members = links.unionByName(classes[0]), members.unionByName(classes[1])
    return links, members


def _class_links(hc: DataFrame, gc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of the classes of common terms, as in :func:`subject_links`."""
    own = gc.select("trace_id", "subject", "n2", "n", F.explode(_subsets("common")).alias("part"))
    own = scans.materialize(own.select("*", F.col("part.tok").alias("toks"), F.xxhash64(F.lit("class"), "part", "n2").alias("cls")))
    found = own.groupBy("trace_id", "toks", "cls").agg(F.first("part").alias("part"), F.first("n2").alias("n2"), F.sum("n").alias("n"))
    asked = hc.select("trace_id", F.col("subject").alias("hsubject"), F.col("n2").alias("hn2"), F.explode(_subsets("common")).alias("hpart"))
    met = asked.select("*", F.col("hpart.tok").alias("toks")).join(found, ["trace_id", "toks"])
    dot = F.aggregate(F.zip_with("hpart", "part", lambda a, b: a["cnt"] * b["cnt"]), F.lit(0), lambda acc, x: acc + x)
    met = met.select("trace_id", "hsubject", F.struct("cls", _cosine(dot, F.col("hn2"), F.col("n2")).alias("sim"), "part", "n2", "n").alias("c"))
    # at most the subsets of one subject times the counts and lengths that occur
    met = met.groupBy("trace_id", "hsubject").agg(F.collect_list("c").alias("all"))

    def within(a: Column, b: Column) -> Column:
        return (a["n"] == b["n"]) & (a["n2"] == b["n2"]) & (F.size(b["part"]) > F.size(a["part"])) & (F.size(F.array_except(a["part"], b["part"])) == 0)

    kept = F.filter("all", lambda a: ~F.exists("all", lambda b: within(a, b)))
    links = scans.materialize(met.select("trace_id", "hsubject", F.explode(kept).alias("c")).select("trace_id", "hsubject", "c.cls", "c.sim"))
    members = own.select("trace_id", "subject", "cls").join(links.select("trace_id", "cls").distinct(), ["trace_id", "cls"], "left_semi")
    return links, members.select("trace_id", "subject", "cls")


def hedge_lists(hedges: DataFrame, vers: DataFrame, subject_sims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lists of each hedge, ``(trace_id, hidx, hpos, cls, sim)``, and their members, ``(trace_id, cls, vidx, vpos)``; both written.

    ``subject_sims`` (``trace_id, hidx, hpos, subject, sim``) gives exact
    similarities in place of the terms'; pairs that are not in it have none.
    """
    every = hedges.select("trace_id", "hidx", F.col("pos").alias("hpos"), F.lit(EVERY).cast("long").alias("cls"), F.lit(0.0).alias("sim"))
    places = vers.select("trace_id", F.lit(EVERY).cast("long").alias("cls"), "vidx", F.col("pos").alias("vpos"))
    if subject_sims is None:
        links, of_subject = subject_links(hedges, vers)
        own = hedges.select("trace_id", "hidx", F.col("pos").alias("hpos"), F.col("subject").alias("hsubject")).join(links, ["trace_id", "hsubject"])
    else:
        own = subject_sims.where("sim > 0").withColumn("cls", _subject_class(F.col("subject")))
        of_subject = own.select("trace_id", "subject", "cls").distinct()
    own = own.select("trace_id", "hidx", "hpos", "cls", "sim")
    held = vers.join(of_subject, ["trace_id", "subject"]).select("trace_id", "cls", "vidx", F.col("pos").alias("vpos"))
    return scans.materialize(every.unionByName(own)), scans.materialize(places.unionByName(held))


def nearest(lists: DataFrame, members: DataFrame) -> DataFrame:
    """The nearest later member of each list: ``(trace_id, hidx, hpos, sim, vpos)``; lists without one are left out."""
    values = members.select("trace_id", "cls", (F.col("vpos") - 1).alias("key"), F.col("vpos").alias("value"))
    asked = lists.select("trace_id", "cls", F.col("hpos").alias("key"), F.struct("trace_id", "hidx", "hpos", "sim").alias("qid"))
    found = scans.suffix_min(values, asked, ["trace_id", "cls"]).where("answer IS NOT NULL")
    return found.select("qid.*", F.col("answer").cast("int").alias("vpos"))
