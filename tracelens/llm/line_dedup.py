"""Line deduplication by site-relative frequency.

A line is boilerplate of a host when it stands on at least ``min_pages`` of the
host's pages and on more than ``ratio`` of them. Such lines are dropped from
all of the host's pages, also where they are most or all of a page.

DataFrame operations only. Pages meet by (host, line hash), counts are added
up before they are dealt, and the lines to drop come back to each page by the
page's own key, so a host with most of the pages is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO, MIN_PAGES = 0.08, 3
#: Elements that end a line of text (fixed values).
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = rf"(?i)</?({BLOCKS})\b[^>]*>"


def text_of_html(html: Column) -> Column:
    """The text of a page, a line for each block element; entities stay as they are."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n")
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"[ \t\r\f]+", " ")


def host_of_url(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#:]*)", 2))
    return F.when(host != "", host)


def _hash(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(line, F.lit(1)).alias("y"))


def drop_boilerplate(pages: DataFrame, id_col: str, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, and n_lines and n_dropped.

    Lines are compared without spaces at their ends; blank lines are neither
    counted nor dropped. Each row is a page, also when its id or text is
    repeated; null hosts are one host. A null text stays null, with no lines.
    Columns named n_lines or n_dropped are replaced. A page whose lines all go
    keeps its row, with an empty text. With ``copies_once`` pages of one host
    with equal texts count as one, which tells copies of a page from boilerplate.
    """
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    own_lines = F.array_distinct(F.transform(F.coalesce(lines, F.array().cast("array<string>")), _hash))
    keyed = pages.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.struct(*names).alias("__row"), F.col(text_col).alias("__text"))
    own = pages.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), own_lines.alias("lines"))
    counted = own
    if copies_once:
        counted = pages.select(F.col(host_col).alias("host"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"), own_lines.alias("lines")).dropDuplicates(["host", "tk"])
    each = own.select("id", "host", F.explode("lines").alias("line")).select("id", "host", "line.x", "line.y")
    totals = counted.groupBy("host").agg(F.count("*").alias("total"))
    seen = counted.select("host", F.explode("lines").alias("line")).select("host", "line.x", "line.y")
    often = seen.groupBy("host", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    t, o = totals.alias("t"), often.alias("o")
    common = o.join(t, F.col("o.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > ratio * F.col("total")).select("o.host", "x", "y")
    e, c = each.alias("e"), common.alias("c")
    same = (F.col("e.x") == F.col("c.x")) & (F.col("e.y") == F.col("c.y")) & F.col("e.host").eqNullSafe(F.col("c.host"))
    drop = e.join(c, same, "left_semi").groupBy("id", "host").agg(F.collect_set(F.struct("x", "y")).alias("drop"))
    joined = keyed.join(drop, F.col("__id").eqNullSafe(F.col("id")) & F.col("__host").eqNullSafe(F.col("host")), "left")
    every = F.split("__text", "\n")
    kept = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _hash(F.trim(x))))
    joined = joined.withColumn("__kept", F.when(F.col("drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("__text")))
    changed = F.col("drop").isNotNull()

    def filled(text: str) -> Column:
        return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")

    counts = [F.when(F.col("__text").isNull(), F.lit(0)).otherwise(filled("__text")).alias("n_lines"), F.when(changed, filled("__text") - filled("__kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"__row.{c}").alias(c) for c in names], *counts)


ORACLE = rf"""
WITH texts AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#:]*)', 2)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r\f]+', ' ', 'g') AS text
  FROM pages),
numbered AS (SELECT row_number() OVER () AS r, * FROM texts),
split AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM numbered),
common AS (
  SELECT host, trim(line) AS line FROM split WHERE trim(line) <> '' GROUP BY host, trim(line)
  HAVING count(DISTINCT r) >= {MIN_PAGES}
     AND count(DISTINCT r) > {RATIO} * (SELECT count(*) FROM texts t WHERE t.host IS NOT DISTINCT FROM split.host)),
marked AS (
  SELECT s.*, c.line IS NOT NULL AS dropped FROM split s
  LEFT JOIN common c ON c.line = trim(s.line) AND c.host IS NOT DISTINCT FROM s.host),
joined AS (
  SELECT r, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '') AS kept FROM marked GROUP BY r)
SELECT n.page_id, n.host, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped,
       sha256(CASE WHEN n.text IS NOT NULL THEN j.kept END) AS text_sha256
FROM numbered n LEFT JOIN joined j USING (r)
"""
