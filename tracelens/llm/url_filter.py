"""URL verdicts: host rules, and link-graph propagation for hosts that no rule decides.

A rule (host, path, verdict) fits its host and all its subdomains where the
URL's path starts with the rule's; of several the longest decides. URLs meet
rules by equality of (host suffix, path prefix), so neither a long rule list
nor a host with many rules is scanned per URL.

All other URLs get the verdict of their host. Hosts are nodes of a graph:
links between pages, and each host with its parent domain in both directions
(down to two labels). Trust starts at hosts with allowed pages and follows
links; distrust starts at hosts with blocked pages and follows links back, to
those who link there. Each is a personalised PageRank, in whole numbers, so
that sums do not depend on their order:

    score(v) = 15 % of seed(v) + 85 % of sum over edges (u, v) of score(u) / degree(u)

A host is blocked when its distrust reaches ``LEAST`` and exceeds its trust.

DataFrame operations only. Edges and seeds are counted before they are dealt,
each round is one join of host scores with edges and one sum per host, and
every few rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_checked
from .common import written

#: The rules of the registered query (fixed values): host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A seed host's full weight, rounds of propagation (0.85 to the power of 16 is 0.07), and rounds between two writes.
WEIGHT, ROUNDS, WRITE_EVERY = 1_000_000_000, 16, 4
#: Least distrust of a blocked host: a tenth of the weight of a host whose pages are all blocked.
LEAST = WEIGHT // 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or scheme-relative link.
LINK = r"""(?i)<a(?:[ \t\r\n\f][^>]*?)?[ \t\r\n\f]href[ \t\r\n\f]*=[ \t\r\n\f]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"' \t\r\n\f>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host itself and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The (host, path) of ``urls`` that a rule decides, once each: host, path, rule, verdict.

    ``rules`` has host, path and verdict. Of rules of one length ``block``
    wins; null hosts or paths of rules fit nothing. A URL is held against the
    rules of its host's suffixes by path prefixes of the lengths that rules
    have, which are as many as the longest rule path has characters at most.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IS NOT NULL").distinct()
    lengths = sorted(r["n"] for r in rules.select(F.length("rule_path").alias("n")).distinct().collect())
    prefixes = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    each = urls.select("host", "path").distinct().where("host <> ''").withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
    each = each.withColumn("rule_path", F.explode(prefixes))
    fits = join_checked(each, rules, ["rule_host", "rule_path"])
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "verdict", F.concat("rule_host", "rule_path").alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct directed edges (src, dst) between hosts: links of ``pages`` (host, html), and parent domains both ways."""
    linked = pages.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    linked = linked.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).distinct()
    hosts = linked.select(F.col("dst").alias("host")).union(pages.where("host <> ''").select("host")).distinct()
    chain = hosts.select(F.filter(_suffixes(F.col("host")), lambda h: F.instr(h, ".") > 0).alias("up"))
    steps = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("up") - 1, F.lit(0))), lambda k: F.struct(F.get("up", k - 1).alias("src"), F.get("up", k).alias("dst")))).alias("e"))
    steps = steps.select("e.src", "e.dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return linked.union(steps).union(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Trust and distrust of each host that either reaches: host, trust, distrust.

    ``seeds`` has host, kind (``trust`` or ``distrust``) and weight, one row
    per host and kind. Trust goes along ``edges`` (src, dst), distrust against
    them; a host's score is divided among its edges, and what a host without
    any would pass on is lost.
    """
    both = edges.select("src", "dst", F.lit("trust").alias("kind")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust").alias("kind")))
    degrees = both.groupBy("src", "kind").agg(F.count("*").alias("degree"))
    both = written(both.join(degrees, ["src", "kind"]).select(F.col("src").alias("host"), "kind", "dst", "degree"), "host-edges")
    start = seeds.select("host", "kind", F.expr("weight * 15 div 100").alias("score"))
    now = start = written(start, "host-seeds")
    for k in range(1, rounds + 1):
        passed = now.join(both, ["host", "kind"]).select(F.col("dst").alias("host"), "kind", F.expr("score div 20 * 17 div degree").alias("score"))
        now = start.union(passed).groupBy("host", "kind").agg(F.sum("score").alias("score")).where("score > 0")
        if k % WRITE_EVERY == 0 and k < rounds:
            now = written(now, "host-scores")
    of = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind) for kind in ("trust", "distrust")]
    return now.groupBy("host").agg(*of)


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    ``rule`` is the host and path of the rule that decided, null if none did.
    Then the verdict is the host's: ``block`` or ``allow`` by its scores.
    Null URLs and those without ``://`` have an empty host and path, no rule
    and are allowed. Null html has no links. Repeated rows are each judged
    and count as pages of their host; other columns are left out. Without
    rules all is allowed.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    ruled = written(urls.join(decided(urls, rules), ["host", "path"], "left"), "ruled-urls")
    counts = ruled.where("host <> ''").groupBy("host").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("allow", "block")], F.sum("pages").alias("pages"))
    seeds = counts.select("host", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(f"{WEIGHT} * {v} div pages").alias("weight")) for kind, v in (("trust", "allow"), ("distrust", "block"))])).alias("s"))
    scores = propagated(host_edges(rows), seeds.select("host", "s.kind", "s.weight").where("weight > 0"), rounds)
    named = ruled.join(scores, "host", "left").select("host", "path", "rule", "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")])
    by_host = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    named = written(named.withColumn("verdict", F.coalesce("verdict", by_host)), "url-verdicts")
    # a table of its own, so that the join can split a URL that many rows share
    return rows.drop("html").join(named, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def _oracle() -> str:
    rule_rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    rounds = "".join(
        f""",
s{k} AS MATERIALIZED (SELECT host, kind, sum(score)::BIGINT AS score FROM (
  SELECT * FROM s0 UNION ALL SELECT d.dst, kind, s.score // 20 * 17 // d.degree FROM s{k - 1} s JOIN degrees d USING (host, kind)) GROUP BY host, kind HAVING sum(score) > 0)"""
        for k in range(1, ROUNDS + 1)
    )
    return rf"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (VALUES {rule_rows}),
urls AS (SELECT host, path, count(*) AS pages FROM rows GROUP BY host, path),
ruled AS MATERIALIZED (
  SELECT u.*, r.rule_host || r.rule_path AS rule, r.verdict FROM urls u
  LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, r.verdict DESC) = 1),
linked AS (
  SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM rows WHERE host <> ''),
chain AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst
  FROM (SELECT string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) - 1)) AS k FROM (SELECT dst AS host FROM linked UNION SELECT host FROM rows) WHERE host <> '')),
edges AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (SELECT * FROM linked UNION ALL SELECT * FROM chain UNION ALL SELECT dst, src FROM chain) WHERE src <> dst),
sides AS (SELECT src AS host, dst, 'trust' AS kind FROM edges UNION ALL SELECT dst, src, 'distrust' FROM edges),
degrees AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY host, kind) AS degree FROM sides),
counts AS (
  SELECT host, sum(pages)::BIGINT AS n, coalesce(sum(pages) FILTER (verdict = 'allow'), 0)::BIGINT AS a, coalesce(sum(pages) FILTER (verdict = 'block'), 0)::BIGINT AS b FROM ruled WHERE host <> '' GROUP BY host),
s0 AS MATERIALIZED (
  SELECT host, kind, w * 15 // 100 AS score FROM (
    SELECT host, 'trust' AS kind, {WEIGHT} * a // n AS w FROM counts UNION ALL SELECT host, 'distrust', {WEIGHT} * b // n FROM counts) WHERE w > 0){rounds},
scores AS (SELECT host, coalesce(max(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(max(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) >= {LEAST} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM rows JOIN ruled USING (host, path) LEFT JOIN scores USING (host)
"""


ORACLE = _oracle()
