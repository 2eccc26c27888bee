"""Size-aware heavy-light Jaccard join of documents' word n-gram sets.

A document's set is its distinct runs of ``n`` words (``N`` unless told), as 64-bit hashes. Sets
are ordered by a global order, rare n-grams first (a sketch of fixed size
counts all n-grams of the corpus). Two sets that reach the similarity share an
element among their first ``a - ceil(t a) + 1``, and two among one more.

* Small sets (up to a boundary) enumerate all two-element subsets of that
  prefix; only sets that share a subset are compared. Such lists are short.
* Large sets have too many subsets; they scan the inverted lists of their
  prefix elements. Sets that a large one may link with by size are in these
  lists, too.

The boundary is where enumerating subsets begins to cost more than scanning
lists (``boundary``). Near copies do not count there as members of lists: they
are contracted before lists are joined, while their subsets would all be keys.

A list of k sets is not expanded into its pairs. First each set is held against
few others: the smallest first member of its lists, and, of the sets that have
one of its minhash values, one taken at random for each value. Near copies share
most of these values, so a group of g copies costs about g pairs for each of
them. Links found are contracted, and the same is done with more values for sets
in different components: these are the groups of which only some pairs link.
Then lists whose members are
not all connected are joined with themselves, by classes of size, and only
over pairs in different components whose sizes, places in the lists and
parity bits still allow a link; of two components few pairs are tested first,
and all only where these do not link. So every link that could join two components
is tested, and the components are exact. Lists of very frequent n-grams are
dealt to several parts before the first step, so that none falls to one task.

Parity bits: of a set's elements that fall to one of ``PARITY`` cells, whether
their number is odd. Where two sets differ in a cell, an element stands in only
one of them, so the cells that differ are at most as many as such elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .graph import components

N, PERCENT = 4, 85
#: Cells of the sketch that orders n-grams, cells of a chunk of it, tasks whose chunks are added up at once.
CELLS, CHUNK, TASKS = 1 << 21, 1 << 12, 256
#: List members a part should have at most.
PART = 5_000
#: Cost of a pair found in a list, in keys made and shuffled.
PAIR_COST = 1
#: Percent that a boundary may cost more than the cheapest.
SLACK = 2
#: Texts whose sets choose the boundary.
SAMPLE = 2_000
#: Elements of such a set's prefix that the driver gets at most.
HEAD = 512
#: Parity bits of a set.
PARITY = 1024
#: Minhash values of a set that are used in the first round and in the second, and an odd factor for each.
ROUNDS = (4, 12)
FACTORS = np.random.default_rng(9).integers(0, 1 << 63, sum(ROUNDS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs of two components that are tested at most before all are.
SOME = (1, 16)
#: Keys of texts that are broadcast to find these among all; more are joined by shuffle.
BROADCAST = 1_000_000
SETS_SCHEMA = "doc_id long, tk long, node long, n int, keys array<long>, rests array<int>, parts array<int>, bits array<long>, marks array<int>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Each text's distinct n-gram hashes, ascending; the whole sequence of a text with fewer words, and nothing without words."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()]
    grams = np.zeros(0, np.uint64)
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        grams = _mixed(grams)
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    empty = pc.equal(texts, "").to_pylist()
    out = []
    for a, b, none in zip(bounds[:-1], bounds[1:], empty, strict=True):
        if none:
            out.append(np.zeros(0, np.uint64))
        elif b - a < n:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + w
            out.append(_mixed(h))
        else:
            out.append(np.unique(grams[a : b - n + 1]))
    return out


def node_of(grams: np.ndarray) -> int:
    """A number for the set, equal for equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def parity(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount(((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def marks(grams: np.ndarray) -> np.ndarray:
    """Minhash values: two sets agree in each with about the chance that is their similarity."""
    return (np.array([(grams * factor).min() for factor in FACTORS], np.uint64) >> np.uint64(16)).astype(np.uint32).view(np.int32)


def needed(a: int, percent: int) -> int:
    """The least overlap of a set of ``a`` elements with one it links with."""
    return -(-percent * a // 100)


def boundary(sizes: np.ndarray, partners: np.ndarray, percent: int = PERCENT) -> int:
    """The largest size of a small set, from the sizes of some sets and the other members of their prefixes' lists.

    A prefix of p elements has p (p + 1) / 2 two-element subsets, each a key;
    scanning costs p keys, and a pair for each other member of p lists. Sets
    up to the boundary enumerate, those that a larger one may link with and
    all larger ones scan. Of the boundaries whose cost for the given sets is the
    least or ``SLACK`` percent more, the largest is taken: pairs grow faster with
    the corpus than keys.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, partners = sizes[order], partners[order]
    prefix = sizes - -(-percent * sizes // 100) + 1
    subsets = np.concatenate([[0], np.cumsum(prefix * (prefix + 1) // 2)])
    scans = np.concatenate([[0], np.cumsum(prefix + PAIR_COST * partners)])
    choices = np.unique(np.concatenate([[0], sizes]))
    low, high = np.searchsorted(sizes, choices, "right"), np.searchsorted(100 * sizes, percent * choices, "right")
    cost = subsets[low] + scans[-1] - scans[high]
    return int(choices[100 * cost <= (100 + SLACK) * cost.min()].max())


def _shared(rows: DataFrame, counts: np.ndarray | Broadcast) -> Broadcast:
    return counts if isinstance(counts, Broadcast) else rows.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))


def others_listed(heads: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    """For each set, how many sets stand in the lists of its ``heads``, without those of its own group.

    Sets are of one group if half of their minhash values (``signs``) agree with
    those of the first set that has one of them: such sets are held against
    each other and contracted before any list is joined.
    """
    group = np.arange(len(heads))
    for seed in range(signs.shape[1] if len(heads) else 0):
        _, first, which = np.unique(signs[:, seed], return_index=True, return_inverse=True)
        pivot = first[which]
        near = 2 * (signs == signs[pivot]).sum(axis=1) >= signs.shape[1]
        for i in np.flatnonzero(near & (group != group[pivot])):
            x, y = group[i], group[pivot[i]]
            group[group == max(x, y)] = min(x, y)
    lengths = np.array([len(h) for h in heads], np.int64)
    _, element = np.unique(np.concatenate([np.zeros(0, np.int64), *heads]), return_inverse=True)
    owner = np.repeat(np.arange(len(heads)), lengths)
    _, pair, inside = np.unique(element * np.int64(len(heads) + 1) + group[owner], return_inverse=True, return_counts=True)
    others = np.bincount(element)[element] - inside[pair] if len(element) else np.zeros(0, np.int64)
    return np.bincount(owner, others, len(heads))


def sampled(rows: DataFrame, counts: np.ndarray | Broadcast, percent: int, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of about ``SAMPLE`` texts' sets, and how many sets that are no near copies stand in the lists of their prefixes.

    The latter from the lists of the sample, times what it stands for. They
    only choose the boundary; no result depends on them.
    """
    total = rows.count()
    shared = _shared(rows, counts)
    share = min(1.0, SAMPLE / max(1, total))
    some = rows.where(F.pmod(F.xxhash64("tk", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * share)).select("tk", "text").dropDuplicates(["tk"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, heads, signs = [], [], []
        for batch in slices(batches):
            for grams in shingle_sets(batch.column(1), n):
                if len(grams):
                    cells = shared.value[(grams % np.uint64(CELLS)).astype(np.int64)]
                    prefix = np.lexsort((grams, cells))[: len(grams) - needed(len(grams), percent) + 1]
                    sizes.append(len(grams))
                    heads.append(np.sort(grams[prefix])[:HEAD].view(np.int64))
                    signs.append(marks(grams))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((sizes, heads, signs), types, strict=True)], names=["size", "head", "marks"])

    found = some.mapInArrow(measured, "size long, head array<long>, marks array<int>").toArrow()
    sizes = found.column("size").to_numpy()
    heads = [np.array(h, np.int64) for h in found.column("head").to_pylist()]
    partners = others_listed(heads, np.array(found.column("marks").to_pylist(), np.int32).reshape(len(heads), len(FACTORS)))
    # a long prefix is known by its smallest HEAD elements
    longer = (sizes - -(-percent * sizes // 100) + 1) / np.maximum(1, [len(h) for h in heads])
    return sizes, np.rint(partners * longer / share).astype(np.int64)


def sketch(rows: DataFrame, n: int = N) -> np.ndarray:
    """How often n-grams of each cell occur in the documents' sets, over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(0), n)
            if sets:
                cells = np.concatenate(sets) % np.uint64(CELLS)
                total += np.bincount(cells.astype(np.int64), minlength=CELLS).astype(np.int32)
        parts = [(k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(CELLS // CHUNK)]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        some = TaskContext.get().partitionId() // TASKS
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([some] * len(parts), pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "some", "counts"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int32)
        for x in group.column("counts"):
            total = np.minimum(total.astype(np.int64) + np.frombuffer(x.as_buffer(), np.int32), np.iinfo(np.int32).max).astype(np.int32)
        return pa.table([group.column("chunk").slice(0, 1), group.column("some").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["chunk", "some", "counts"])

    schema = "chunk int, some int, counts binary"
    sums = rows.select("text").mapInArrow(counted, schema)
    # rows of fixed length; those of up to TASKS tasks are added up first
    sums = sums.groupBy("chunk", "some").applyInArrow(added, schema).groupBy("chunk").applyInArrow(added, schema)
    out = np.zeros(CELLS, np.int64)
    for r in sums.collect():  # CELLS numbers at any size of the corpus
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int32)
    return out


def keyed_sets(rows: DataFrame, counts: np.ndarray | Broadcast, percent: int, n: int = N) -> DataFrame:
    """Each row's set number and size, and the keys under which it is looked for.

    ``rests`` holds how many elements a link found under a key can share at
    most, counted from the key's place in the order; ``parts`` into how many
    parts the key's list is dealt.
    """
    shared = _shared(rows, counts)
    small = boundary(*sampled(rows, shared, percent, n), percent)
    usual = int(np.median(shared.value))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in SETS_SCHEMA.split(", ")]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches, 512):
            out = []
            for grams in shingle_sets(batch.column(2), n):
                size, keys, rests, parts = len(grams), [], [], []
                if not size:
                    out.append((None, 0, [], [], [], [], []))
                    continue
                prefix = size - needed(size, percent) + 1
                if size > 1 and size - needed(size + 1, percent) >= 0:
                    cells = counts[(grams % np.uint64(CELLS)).astype(np.int64)].astype(np.int64)
                    # only the head of the order is needed
                    head = np.argpartition(cells, min(prefix, size - 1))[: prefix + 1]
                    limit = cells[head].max()
                    head = np.flatnonzero(cells <= limit)
                    head = head[np.lexsort((grams[head], cells[head]))][: prefix + 1]
                    first, often = grams[head], 1 + np.maximum(0, cells[head] - 2 * usual) // PART
                    if size <= small:
                        for i, j in combinations(range(len(first)), 2):
                            keys.append(_mixed(first[i : i + 1] * np.uint64(3) + first[j : j + 1])[0])
                            rests.append(size - j + 1)
                            parts.append(min(often[i], often[j]))
                    if 100 * size > percent * small:
                        keys += first[:prefix].tolist()
                        rests += range(size, size - prefix, -1)
                        parts += often[:prefix].tolist()
                out.append((node_of(grams), size, np.array(keys, np.uint64).astype(np.int64), rests, parts, parity(grams), marks(grams)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types[2:], strict=True)]], names=names)

    return rows.mapInArrow(keyed, SETS_SCHEMA)


def possible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and remaining elements of two list members allow a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return sizes & (F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest")) * (100 + percent) >= percent * (na + nb))


def near_enough(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether the parity bits ``a`` and ``b`` of sets with ``na`` and ``nb`` elements allow a link."""
    differ = reduce(Column.__add__, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(PARITY // 64)])
    return (100 + percent) * (na + nb - differ) >= 2 * percent * (na + nb)


def kept_sets(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int = N) -> DataFrame:
    """(node, grams) of the nodes of ``pairs``, made anew from one text of each; written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(nodes.join(wanted, "node", "left_semi").select("tk").distinct(), "texts")
    if texts.count() <= BROADCAST:
        texts = F.broadcast(texts)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = shingle_sets(batch.column(0), n)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "grams"])

    chosen = rows.join(texts, "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text")).select("text")
    return written(chosen.mapInArrow(sets_of, "node long, grams array<long>"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set numbers whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(linked, "a long, b long")


def contracted(pairs: DataFrame, check: Callable[[DataFrame], DataFrame], links: DataFrame) -> DataFrame:
    """``links`` and as many of ``pairs`` (a, b, and their components c < d) as connect what all links among them would.

    ``check`` gives the linked ones of some pairs. A few pairs of each two components are tested, then more, then all;
    pairs within one component by then are passed over.
    """
    for most in (*SOME, None):
        if pairs.isEmpty():
            break
        if most:
            slot = F.pmod(F.xxhash64("a", "b"), F.lit(most))
            tried = written(pairs.groupBy("c", "d", slot.alias("slot")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*"), "tried")
        else:
            tried = pairs.select("a", "b")
        found = written(check(tried), "links")
        links = links.union(found)
        if most:
            of = components(links)
            left = pairs.join(tried, ["a", "b"], "left_anti").select("a", "b").join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            left = left.join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            left = left.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")
            pairs = written(left.select("a", "b", F.least("ca", "cb").alias("c"), F.greatest("ca", "cb").alias("d")), "pairs")
    return links


def alike(nodes: DataFrame, percent: int, start: int, values: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, c, marks) in different components c.

    For each of the minhash values from ``start``, one of its sets with every other whose size allows a link.
    """
    marked = nodes.select("node", "n", "c", F.posexplode(F.slice("marks", start + 1, values)).alias("seed", "mark"))
    pivots = marked.groupBy("seed", "mark").agg(F.min(F.struct(F.xxhash64("node", "seed").alias("at"), "node", "n", "c")).alias("pivot"), F.count("*").alias("k")).where("k > 1")
    sizes = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    pairs = marked.join(pivots, ["seed", "mark"]).where((F.col("c") != F.col("pivot.c")) & sizes)
    return pairs.select(F.greatest("node", "pivot.node").alias("a"), F.least("node", "pivot.node").alias("b")).distinct()


def _grouped(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk, n_shingles and c, the number of its component; null without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    counts = sketch(rows, n)
    keyed = written(keyed_sets(rows, counts, percent, n), "keyed-sets")
    # equal sets are one node from here on
    usable = keyed.where("node IS NOT NULL AND size(keys) > 0")
    nodes = written(usable.groupBy("node").agg(F.min_by(F.struct("tk", "n", "bits", "marks"), "tk").alias("s")).select("node", "s.*"), "nodes")
    once = usable.groupBy("node").agg(F.first(F.struct("n", F.arrays_zip("keys", "rests", "parts").alias("under"))).alias("s"))
    entries = once.select("node", "s.n", F.explode("s.under").alias("e")).select(
        F.when(F.col("e.parts") == 1, F.col("e.keys")).otherwise(F.xxhash64("e.keys", F.pmod("node", F.col("e.parts")))).alias("key"),
        F.when(F.col("e.parts") > 1, F.col("e.keys")).alias("whole"), "node", "n", F.col("e.rests").alias("rest"),
    )
    by_key = Window.partitionBy("key")
    lists = entries.withColumn("pivot", F.min(F.struct("node", "n", "rest")).over(by_key)).withColumn("k", F.count("*").over(by_key))
    lists = written(lists.where("k > 1 OR whole IS NOT NULL").select(F.coalesce("whole", "key").alias("key"), F.col("whole").isNotNull().alias("dealt"), F.struct("node", "n", "rest").alias("m"), "pivot"), "lists")
    # members against their part's first member, and the parts' first members against the list's
    firsts = lists.where("dealt").select("key", F.col("pivot").alias("m")).distinct()
    firsts = firsts.join(firsts.groupBy("key").agg(F.min("m").alias("pivot")), "key")
    star = lists.select("pivot", "m").union(firsts.select("pivot", "m")).where((F.col("m.node") != F.col("pivot.node")) & possible("pivot", "m", percent))
    star = star.groupBy(F.col("m.node").alias("a")).agg(F.min("pivot.node").alias("b"))
    bits = nodes.select("node", "n", "bits")

    def check(pairs: DataFrame) -> DataFrame:
        return verified(pairs, kept_sets(pairs, nodes, rows, n), percent)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
        pairs = pairs.join(bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
        pairs = pairs.where(near_enough(F.col("na"), F.col("nb"), F.col("x"), F.col("y"), percent))
        return written(check(written(pairs.select("a", "b"), "pairs")), "links")

    # sets that stand in no list with others link with nothing
    listed = nodes.select("node", "n", "marks").join(lists.select("m.node").distinct(), "node", "left_semi")
    few, more = ROUNDS
    links = linked(star.union(alike(listed.withColumn("c", F.col("node")), percent, 0, few)).distinct())
    listed = listed.join(components(links).withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    links = links.union(linked(alike(listed, percent, few, more)))
    # lists whose members are not all connected by now
    so_far = components(links)
    members = lists.select("key", F.col("m.node").alias("node"), "m").join(so_far, "node", "left").select("key", "node", "m", F.coalesce("component", "node").alias("c"))
    open_lists = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    members = members.join(open_lists, "key", "left_semi").distinct().join(bits.select("node", "bits"), "node")
    # sizes of linked sets differ by a class at most
    members = written(members.withColumn("size", F.floor(F.ln(F.col("m.n")) / float(np.log(100 / percent))).cast("int")), "open-lists")
    x = members.alias("x")
    y = members.select("key", F.col("m").alias("w"), F.col("c").alias("d"), F.col("bits").alias("others"), F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).alias("y")
    allowed = (F.col("c") < F.col("d")) & possible("m", "w", percent) & near_enough(F.col("m.n"), F.col("w.n"), F.col("bits"), F.col("others"), percent)
    rest = x.join(y, ["key", "size"]).where(allowed)
    rest = written(rest.select(F.col("m.node").alias("a"), F.col("w.node").alias("b"), "c", "d").distinct(), "pairs")
    component = components(contracted(rest, check, links))

    return keyed.select("doc_id", "tk", F.col("n").cast("long").alias("n_shingles"), "node").join(component, "node", "left").select("doc_id", "tk", "n_shingles", F.coalesce("component", "node").alias("c"))


def link_documents(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that is not null among rows reachable
    by links. Rows without words (null, empty or white texts) have no set and
    are their own component. Rows with a repeated doc_id are documents of
    their own. Set numbers have 64 bits; other columns are left out.
    """
    ids = _grouped(docs, percent, n)
    # a table of its own, so that the join below can split a component that holds many rows
    smallest = written(ids.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id")), "smallest")
    out = ids.join(smallest, "c", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """``docs`` with one row of each group of linked ones: the one with the smallest doc_id, nulls last.

    Rows are told apart by doc_id and a 64-bit hash of the text, which also
    decides between rows with one doc_id; of rows equal in both, one stays.
    Rows without words all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tk")
    firsts = _grouped(docs, percent, n).where("c IS NOT NULL").groupBy("c").agg(F.min(order).alias("first"))
    firsts = written(firsts.select(F.col("first.doc_id").alias("__first"), F.col("first.tk").alias("__tk")), "firsts")
    words = F.coalesce(F.length(F.regexp_replace(F.col("text"), r"[\x20\x09-\x0D]+", "")), F.lit(0)) > 0
    keyed = docs.where(words).withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(F.col("text").cast("string"))})
    same = F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__key") == F.col("__tk"))
    left = keyed.join(firsts, same, "left_semi").dropDuplicates(["__id", "__key"]).drop("__id", "__key")
    return left.unionByName(docs.where(~words))


ORACLE = rf"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS g FROM rows),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r
  JOIN sizes p ON p.r = x.r JOIN sizes q ON q.r = y.r
  WHERE 100 * least(p.n, q.n) >= {PERCENT} * greatest(p.n, q.n) GROUP BY x.r, y.r),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
reach(r, s) AS (SELECT r, r FROM rows UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.s),
named AS (SELECT reach.r, min(rows.doc_id) AS component_id FROM reach JOIN rows ON rows.r = reach.s GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM rows JOIN named USING (r) LEFT JOIN sizes USING (r)
"""
