"""Near-duplicates by an LSH forest over MinHash signatures.

Texts with equal shingle sets form a class and are represented once.  Each class
has a signature of MinHash values; each tree of the forest sorts the classes by
the signature read from another place on, by range over all tasks.  Neighbours in
an order whose longest common prefix has ``depth`` values or more are candidates.
So are a region's first class and every other one: a region is a run of such
neighbours, and while it holds more than ``region`` classes it is cut into runs
with a longer common prefix; in a small one all are candidates.  Runs that go on
in the next task are tied over the border.  Candidates are confirmed on the full
sets.  Classes that large regions hold beside their main component then meet all
of the region, whatever its size, behind a finer sketch: first the few that each
looks nearest to are confirmed, then all that are still apart.  Connected classes
take the smallest doc_id.

No region is ever collected: it is read as a part of a sorted order, and compared
in blocks.

Cases: null and empty texts have an empty set, are linked with nothing, and keep
their own doc_id; fewer words than a shingle make one shingle of the whole
sequence; repeated rows belong to one class and get one answer each; a row
without an id gets the smallest id of its component, or null where there is
none; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, text_bytes, tune


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    words: int = 4
    #: Link at 100 * intersection >= percent * union.
    percent: int = 80
    trees: int = 16
    depth: int = 3
    region: int = 6
    #: Values that classes are sorted by, and the longest prefix that is told.
    deepest: int = 16
    #: Pairs whose signatures agree less than this are not confirmed: over four standard deviations below the limit.
    floor: float = 0.55
    #: In large regions, classes outside the region's main component meet all others, dealt out in
    #: blocks of about so many classes on either side.  So many trees at a time.
    crowd_block: int = 500
    crowd_trees: int = 8
    #: So many of the nearest by sketch are confirmed before the rest.
    crowd_first: int = 4
    #: There pairs are compared by so many one-bit MinHash values first, 64 to a word, and
    #: confirmed where they differ in no more than a pair at the limit does, four standard deviations included.
    fine_words: int = 32
    seed: int = 5

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def fine_limit(self) -> int:
        n, differ = 64 * self.fine_words, (1 - self.percent / 100) / 2
        return math.ceil(n * differ + 4 * math.sqrt(n * differ * (1 - differ)))


class WordHash(dict):
    """64-bit hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h ^= w[i : i + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def minhash(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each of several 32-bit rehashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = (x[i : i + 1024, None] ^ flips[None]) * factors[None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(0), out=best)
    return best


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, set_key, signature) of each row; set_key is null without words."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(s.seed)
        flips = rng.integers(0, 1 << 32, s.values, dtype=np.uint32)
        factors = rng.integers(0, 1 << 32, s.values, dtype=np.uint32) | np.uint32(1)
        hashes = WordHash()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in text_bytes(batch.column(1)):
                found = shingle_set(text, s.words, hashes)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(minhash(found, flips, factors).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n", "set_key", "signature"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, set_key binary, signature binary")


def full_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(set_key, shingles) of the classes in ``wanted`` (set_key, doc_id), from the texts again."""
    ids = wanted.select("doc_id").distinct()
    rows = docs.select("doc_id", "text")
    rows = rows.join(ids.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            found = [x for x in (shingle_set(t, s.words, hashes) for t in text_bytes(batch.column(0))) if len(x)]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["set_key", "shingles"])

    found = rows.mapInArrow(lean(run), "set_key binary, shingles binary")
    return found.join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])


def prefix_lengths(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many values each row of a sorted order shares with the one before it."""
    out = np.zeros(len(keys), np.int64)
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(1)
    out[1:] = np.where(tree[1:] == tree[:-1], same, 0)
    return out


def forest_pairs(shared: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a sorted order with these common prefixes, as pairs of places."""
    n = len(shared)
    at = np.flatnonzero(shared >= s.depth)
    pairs, open_rows, depth = [(at - 1, at)], np.ones(n, bool), s.depth
    while open_rows.any():
        first = np.flatnonzero(shared < depth)
        run = np.cumsum(shared < depth) - 1
        size = np.diff(np.append(first, n))[run]
        member = np.flatnonzero(open_rows & (shared >= depth))
        pairs.append((first[run[member]], member))
        small = open_rows & (size <= s.region)
        for step in range(2, s.region):
            left = np.flatnonzero(small[: n - step] & (run[: n - step] == run[step:]))
            pairs.append((left, left + step))
        open_rows &= size > s.region
        if depth >= s.deepest:
            break
        depth = min(s.deepest, max(depth + 1, depth * 5 // 4))
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


PAIR, CROWD, BORDER = 0, 1, 2


def candidates(classes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of classes, a < b, whose whole signatures agree enough; over borders, all.

    And (set_key, tree, region): the rows of larger regions at the least depth,
    and of those that a border cuts.
    """
    wide = min(s.deepest, s.values)
    twice = F.concat("signature", "signature")
    trees = F.sequence(F.lit(0), F.lit(s.trees - 1))
    order = lambda t: F.substring(twice, t * (4 * s.depth) + F.lit(1), F.lit(4 * s.values))
    rows = classes.select("set_key", F.explode(F.transform(trees, lambda t: F.struct(t.alias("tree"), order(t).alias("order")))).alias("t")).select("t.tree", "t.order", "set_key")
    rows = rows.withColumn("region", F.xxhash64("tree", F.substring("order", 1, 4 * s.depth)))
    rows = rows.repartitionByRange("tree", "order", "set_key").sortWithinPartitions("tree", "order", "set_key")
    names = ["kind", "part", "place", "tree", "region", "a", "b", "order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held)
        tree, region = table.column("tree").to_numpy(), table.column("region").to_numpy()
        orders, set_keys = table.column("order").combine_chunks(), table.column("set_key").combine_chunks()
        whole = np.frombuffer(b"".join(orders.to_pylist()), np.uint32).reshape(-1, s.values)
        n, shared = len(whole), prefix_lengths(tree, whole[:, :wide])

        def out(kind: int, at: np.ndarray, a: np.ndarray, b: np.ndarray | None = None, order: bool = False) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(a), 50_000):
                x = a[lo : lo + 50_000]
                right = set_keys.take(pa.array(b[lo : lo + 50_000])) if b is not None else pa.nulls(len(x), pa.binary())
                columns = [
                    pa.array(np.full(len(x), kind, np.int32)), pa.array(np.full(len(x), part, np.int32)), pa.array(at[lo : lo + 50_000].astype(np.int32)),
                    pa.array(tree[x].astype(np.int32)), pa.array(region[x]), set_keys.take(pa.array(x)), right, orders.take(pa.array(x)) if order else pa.nulls(len(x), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        a, b = forest_pairs(shared, s)
        if len(a):
            once = np.unique(a * n + b)
            for lo in range(0, len(once), 50_000):
                a, b = np.divmod(once[lo : lo + 50_000], n)
                close = (whole[a] == whole[b]).sum(1) >= s.floor * s.values
                yield from out(PAIR, a[close], a[close], b[close])
        first = np.flatnonzero(shared < s.depth)
        number = np.cumsum(shared < s.depth) - 1
        large = np.diff(np.append(first, n)) > s.region
        large[[0, -1]] = True
        crowd = np.flatnonzero(large[number])
        yield from out(CROWD, crowd, crowd)
        # For the next task: the first row of every run that is open at the end, by its depth; for the one before: the first row.
        opened = [int(np.flatnonzero(shared < depth)[-1]) for depth in range(s.depth, wide + 1)]
        ends = np.unique([0, *opened, n - 1])
        yield from out(BORDER, ends, ends, order=True)

    schema = "kind int, part int, place int, tree int, region long, a binary, b binary, order binary"
    found = materialize(rows.mapInArrow(lean(run), schema), "forest")
    ends = found.where(F.col("kind") == BORDER).select("part", "place", "tree", "a", "order")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
        pairs, before, part = [], [], None
        for at, _, tree, key, order in rows:
            if at != part:  # the first row of a task, against what is open at the end of the one before
                values = np.frombuffer(order, np.uint32)
                for other in before if part is not None else []:
                    if other[2] == tree and (np.frombuffer(other[4], np.uint32)[: s.depth] == values[: s.depth]).all():
                        pairs.append((other[3], key))
                before, part = [], at
            before.append((at, 0, tree, key, order))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    # At most ``deepest`` rows of each task that has sorted.
    tied = ends.repartition(1).mapInArrow(lean(tie), "a binary, b binary")
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").union(tied)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    return pairs, found.where(F.col("kind") == CROWD).select(F.col("a").alias("set_key"), "tree", "region")


def confirm(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that reach the limit on their full sets."""
    joined = pairs.join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b")), "b")
    joined = joined.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                if 100 * min(len(x), len(y)) < s.percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(lean(run), "a binary, b binary")


def are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node with no other edge to one that is no ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 OR ups > 0 AND downs > 0")
    return not bad.agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; nodes without a link are left out.

    Alternates large-star and small-star steps.  Each is a join with the least
    neighbour of each node, so no node's neighbours are ever gathered.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # No more rows than edges; repeats among them go at the end of the round.
        edges = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(least.select("u", F.col("m").alias("v")).union(small).distinct(), "small-star")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(roots.union(edges.select(F.col("v"), F.col("v")).distinct()), "components")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of what has made ``roots`` and of further links: those connect components, not nodes."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a != b")
    ends = materialize(ends, "between-components")
    if ends.isEmpty():
        return roots
    above = components(ends)
    old = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = above.join(roots.select("node"), "node", "left_anti")
    return materialize(old.union(new.select("node", "root")), "components")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = materialize(sketches(docs, s), "sketches")
    named = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"))
    classes = materialize(named, "classes")
    pairs, crowds = candidates(classes, s)
    pairs = materialize(pairs, "pairs")
    nodes = None if pairs.isEmpty() else linked(docs, classes, pairs, crowds, s)
    if nodes is None:
        labels = classes.select("set_key", F.col("doc_id").alias("component_id"))
    else:
        ids = classes.select("set_key", "doc_id").join(nodes.withColumnRenamed("node", "set_key"), "set_key", "left")
        ids = materialize(ids.withColumn("root", F.coalesce("root", "set_key")), "roots")
        least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        labels = ids.join(least, "root").select("set_key", "component_id")
    rows = found.select("doc_id", "n", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def fine_sketches(sets: DataFrame, s: Settings) -> DataFrame:
    """(set_key, bits): the lowest bits of further MinHash values, as words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(s.seed + 1)
        n = 64 * s.fine_words
        flips = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        factors = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        for batch in batches:
            bits = [np.packbits((minhash(np.frombuffer(x, np.uint64), flips, factors) & np.uint32(1)).astype(np.uint8)).view(np.int64) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], ["set_key", "bits"])

    return sets.select("set_key", "shingles").mapInArrow(lean(run), "set_key binary, bits array<bigint>")


def crowd_members(crowds: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``crowds`` with their component's root; and per region that holds several components:
    its main one, that one's classes and all classes."""
    rows = crowds.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    rows = materialize(rows, "crowds")
    sums = rows.groupBy("region", "root").agg(F.count("*").alias("n"))
    sums = sums.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return rows, sums.where("all > most")


def crowd_pairs(crowds: DataFrame, roots: DataFrame, fine: DataFrame, s: Settings, first: bool = False) -> DataFrame:
    """(a, b): classes of a large region against those of its other components, as far as their sketches agree.

    The region's main component stays out on one side, so a region that is
    linked up already makes no pairs, however large it is.  Both sides are dealt
    into blocks, and each block of one meets each of the other by itself.  Where
    ``fine`` has the classes' regions by tree, a pair counts in the first tree
    that has it in one region, and in no other: it was tested there, or is linked.  With
    ``first`` only the nearest of each class in each block, and of those the
    ``crowd_first`` nearest.
    """
    rows, sums = crowd_members(crowds, roots)
    blocks = lambda n: F.ceil(n / s.crowd_block).cast("int")
    sums = sums.select("region", "main", blocks(F.col("all") - F.col("most")).alias("p"), blocks(F.col("all")).alias("q"))
    held = materialize(rows.join(sums, "region").join(fine, "set_key"), "open-crowds")
    own = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if "regions" not in fine.columns:
        held = held.withColumn("regions", F.array(F.lit(0).cast("long")))
    columns = ["set_key", "root", "main", "tree", "bits", "regions"]
    few = held.where("root != main").select("region", own("p").alias("i"), every("q").alias("j"), F.lit(0).alias("side"), *columns)
    rest = held.select("region", every("p").alias("i"), own("q").alias("j"), F.lit(1).alias("side"), *columns)
    met = few.union(rest).repartition("region", "i", "j").sortWithinPartitions("region", "i", "j", "side", "set_key")

    def compare(x: tuple, y: tuple) -> Iterator[tuple[bytes, bytes, int]]:
        y_key, y_root, main, tree, y_bits, y_regions = y
        limit = replace(s, fine_words=y_bits.shape[1]).fine_limit
        names: dict[bytes, int] = {}
        roots = np.array([names.setdefault(r, len(names)) for r in y_root])  # numpy would cut zeros off the end of bytes
        for key, root, bits, regions in zip(x[0], x[1], x[4], x[5]):
            differ = np.bitwise_count(bits[None] ^ y_bits).sum(1)
            near = np.flatnonzero((differ <= limit) & (roots != names.get(root, -1)))
            near = near[(y_regions[near] == regions).argmax(1) == tree[0]]
            at = [i for i in near.tolist() if y_root[i] == main[i] or key < y_key[i]]
            if first:
                at = sorted(at, key=lambda i: (differ[i], y_key[i]))[:1]
            for i in at:
                yield key, y_key[i], int(differ[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[tuple, list]]:
            place, sides = None, None
            for batch in batches:
                plain = [batch.column(i).to_pylist() for i in range(8)]
                bits, regions = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (8, 9))
                for k, (region, i, j, side, key, root, main, tree) in enumerate(zip(*plain)):
                    if (region, i, j) != place:
                        if place is not None:
                            yield sides
                        place, sides = (region, i, j), [[[] for _ in range(6)] for _ in range(2)]
                    for held, value in zip(sides[side], (key, root, main, tree, bits[k].view(np.uint64), regions[k])):
                        held.append(value)
            if place is not None:
                yield sides

        def out(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array([p[2] for p in pairs], pa.int32())], ["x", "y", "differ"])

        pairs: list = []
        for x, y in groups():
            if x[0] and y[0]:
                for pair in compare(x, (*y[:4], np.stack(y[4]), np.stack(y[5]))):
                    pairs.append(pair)
                    if len(pairs) >= 20_000:
                        yield out(pairs)
                        pairs = []
        yield out(pairs)

    found = met.mapInArrow(lean(run), "x binary, y binary, differ int")
    if first:
        found = found.distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("differ", "y"))).where(F.col("n") <= s.crowd_first)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, crowds: DataFrame, s: Settings) -> DataFrame:
    """(node, root): the components that confirmed candidates make."""
    close = pairs
    nodes = close.select(F.col("a").alias("set_key")).union(close.select("b")).distinct()
    wanted = materialize(classes.select("set_key", "doc_id").join(nodes, "set_key", "left_semi"), "wanted")
    sets = materialize(full_sets(docs, wanted, s), "sets")
    # Then what large regions hold beside their main component, against all of the region: some trees
    # at a time, since what those link or test is left out of the next.
    roots = components(confirm(close, sets, s))
    rows, several = crowd_members(crowds, roots)
    members = rows.join(several.select("region"), "region", "left_semi").select("set_key").distinct()
    members = materialize(classes.select("set_key", "doc_id").join(members, "set_key", "left_semi"), "crowd-members")
    extra = members.join(nodes, "set_key", "left_anti")
    sets = sets.union(materialize(full_sets(docs, extra, s), "extra-sets"))
    fine = materialize(fine_sketches(sets.join(members.select("set_key"), "set_key", "left_semi"), s), "fine")
    twice = F.concat("signature", "signature")
    region = lambda t: F.xxhash64(t, F.substring(twice, t * (4 * s.depth) + F.lit(1), F.lit(4 * s.depth)))
    regions = classes.select("set_key", F.transform(F.sequence(F.lit(0), F.lit(s.trees - 1)), region).alias("regions"))
    fine = materialize(fine.join(regions, "set_key"), "fine-regions")
    tested = close
    # One tree's nearest ones first: they link most of what a region holds apart, and leave few for the rest.
    plan = [(0, 1, True), *((tree, tree + s.crowd_trees, False) for tree in range(0, s.trees, s.crowd_trees))]
    for low, high, first in plan:
        found = crowd_pairs(crowds.where((F.col("tree") >= low) & (F.col("tree") < high)), roots, fine, s, first)
        found = materialize(found.join(tested, ["a", "b"], "left_anti"), "crowd-pairs")
        if not found.isEmpty():
            tested = tested.union(found)
            roots = merged(roots, confirm(found, sets, s))
    return roots
