"""Near-duplicate documents by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017), banding and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, materialise, numbered, ship

#: Coordinates of a sketch, and how often a pair of the least similarity may share no band.
COORDINATES, MISSED = 128, 1e-7
#: A pair whose sketches agree in so many deviations fewer coordinates than the mean of the least similarity isn't compared.
DEVIATIONS = 5.8
#: Documents of a block and their shingles, at most: a block with a longer document holds this one only. Pairs with one
#: leader that are handled together.
BLOCK, BLOCK_SHINGLES, LEADER_ROWS = 256, 1 << 21, 2000
#: Documents are dealt to all blocks of a group only if this makes so many rows a document at most, or nothing else helps.
COPIES = 3

_ROUND_BITS = np.uint64(48)


def band_width(percent: int) -> int:
    """Coordinates of a band: the most for which a pair of this similarity shares none once in 1 / MISSED pairs at most.

    At 80 there are 32 bands of 4, at 50 there are 64 of 2. Below 12 not even bands of one coordinate are enough.
    """
    miss = [(1 - (percent / 100) ** width) ** (COORDINATES // width) for width in range(1, 9)]
    if not 0 < percent <= 100 or miss[0] > MISSED:
        raise ValueError(f"sketches of {COORDINATES} coordinates don't find pairs of a similarity of {percent} %")
    return max(width for width, m in enumerate(miss, 1) if m <= MISSED)


def least_agreeing(percent: int) -> int:
    """Of 128 coordinates, 76 at 80 and 31 at 50."""
    s = percent / 100
    return max(0, math.floor(COORDINATES * s - DEVIATIONS * math.sqrt(COORDINATES * s * (1 - s))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct k-word shingles (A-Z lower-cased); fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    x = h[: len(h) - k + 1]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) ^ h[j : len(h) - k + 1 + j]
    return np.unique(_mix(x + np.uint64(k)))


def sketch(elements: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The sketch of a set that isn't empty: for each coordinate, the least (round, hash) of those that fall there.

    In each of the first `size` rounds every element falls into a hashed coordinate; in round size + i, all fall into
    coordinate i. So every coordinate fills. Several rounds are made at once; a later round never undoes an earlier
    one, since rounds are compared first.
    """
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    at, step = 0, max(1, math.ceil(1.2 * size * math.log(size) / len(elements)))
    low = np.uint64((1 << 48) - 1)
    with np.errstate(over="ignore"):
        while at < 2 * size and out.max() == np.iinfo(np.uint64).max:
            rounds = np.arange(at, min(at + step, 2 * size), dtype=np.uint64)[:, None]
            x = _mix(elements[None, :] ^ _mix(rounds + np.uint64(0x51ED270B)))
            place = np.where(rounds < size, (x >> _ROUND_BITS) % np.uint64(size), rounds % np.uint64(size))
            np.minimum.at(out, place.ravel().astype(np.int64), ((rounds << _ROUND_BITS) | (x & low)).ravel())
            at += step
    return out


def band_keys(s: np.ndarray, width: int = 4) -> np.ndarray:
    groups = s[: len(s) // width * width].reshape(-1, width)
    x = np.arange(len(groups), dtype=np.uint64) + np.uint64(1)
    for j in range(width):
        x = _mix(x ^ groups[:, j])
    return x.view(np.int64)


def _sketch_rows(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = COORDINATES // width
        for batch in batches:
            n, digests, keys, marks = [], [], [], []
            for text in batch.column(3).cast(pa.binary()):
                elements = shingle_set(text.as_py(), k)
                n.append(len(elements))
                digests.append(xxhash.xxh3_128_digest(elements.tobytes()))
                s = sketch(elements) if len(elements) else np.zeros(COORDINATES, np.uint64)
                keys.append(band_keys(s, width))
                marks.append((_mix(s) >> np.uint64(56)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(marks, pa.binary())],
                ["node", "told", "doc_id", "n_shingles", "digest", "bands", "marks"],
            )

    return run


def _set_rows(k: int):
    """Sets of (node, digest, text), where the text has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, digests, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lo in range(0, batch.num_rows, 500):
                sets = [shingle_set(x.as_py(), k).tobytes() for x in texts.slice(lo, 500)]
                same = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, digests[lo : lo + 500])], pa.bool_())
                yield pa.RecordBatch.from_arrays([nodes.slice(lo, 500), pa.array(sets, pa.binary())], ["node", "elements"]).filter(same)

    return run


def _elements(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def common_elements(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def common_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every two sets: a product of the sets' 0/1 matrix, some columns at a time."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    shared = np.bincount(column) > 1  # an element of one set is in no intersection
    here = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[here]], owner[here]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_elements(batch.column(2)), _elements(batch.column(3))):
                common = common_elements(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those of the edges a, b that join two parts which the edges before them don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((max(x, y), min(x, y)))
    return kept


def block_edges(comp: np.ndarray, side: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components in a block, checked on full sets: those that join something, fewer than there are rows.

    side: 0 in a block that is compared with itself, else 1 and 2 for the two that are compared.
    """
    one, two = (side != 2).nonzero()[0], (side != 1).nonzero()[0]
    n = np.array([len(x) for x in sets])
    small, large = np.minimum(n[one][:, None], n[two][None, :]), np.maximum(n[one][:, None], n[two][None, :])
    i, j = ((comp[one][:, None] != comp[two][None, :]) & (100 * small >= percent * large)).nonzero()
    i, j = one[i], two[j]
    if not side.any():
        i, j = i[i < j], j[i < j]
    least = least_agreeing(percent)
    near = [(marks[i[lo : lo + 4096]] == marks[j[lo : lo + 4096]]).sum(axis=1) >= least for lo in range(0, len(i), 4096)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    i, j = i[near], j[near]
    if not len(i):
        return []
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) > 4 * len(used):
        common = common_matrix([sets[x] for x in used])[at[: len(i)], at[len(i) :]]
    else:
        common = np.array([common_elements(sets[x], sets[y]) for x, y in zip(i, j)])
    linked = 100 * common >= percent * (n[i] + n[j] - common)
    return spanning(comp[i[linked]].tolist(), comp[j[linked]].tolist())


def _block_rows(percent: int):
    """block_edges() of every (key, i, j) of sorted rows key, i, j, side, comp, marks, elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        name = None

        def done() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            sets = [x for c in t.column("elements").chunks for x in _elements(c)]
            edges = block_edges(t.column("comp").to_numpy(), t.column("side").to_numpy(), marks, sets, percent)
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *((names[1:] != names[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and tuple(names[lo]) != name:
                    yield done()
                    held = []
                name = tuple(names[lo])
                held.append(table.slice(lo, hi - lo))
        if held:
            yield done()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars (Kiveris et al., 2014): doc, component (its least doc).

    edges: a, b with a > b. Each half of a round is one aggregation and one join, in which nodes of many edges are dealt to
    many tasks. A document without edges has no row.
    """

    def star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
        around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = around.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
        least = materialise(least.withColumn("low", F.least("a", "low")), "least")
        met = attach_by_key(around, least, "a", "degree", total)
        if large:
            out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        return materialise(out.filter(F.col("a") != F.col("b")).distinct(), "stars")

    def done(pairs: DataFrame) -> bool:
        """Whether every node has one edge down or edges up only: stars."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("down")))).alias("e"))
        return ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("up")).filter("down > 1 or down = 1 and up = 0").isEmpty()

    pairs = materialise(edges.filter("a > b").distinct(), "edges")
    while not done(pairs):
        pairs = star(star(pairs, True, 2 * (total := pairs.count())), False, total)
    return pairs.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct()
    )


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, elements) are similar enough.

    A node that leads many pairs is copied to a few tasks (LEADER_ROWS pairs each), so that no task gets all pairs of
    one leader.
    """
    total = pairs.count()
    leads = materialise(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "leads")
    parts = F.ceil(F.col("n") / LEADER_ROWS).cast("int")
    salted = attach_by_key(pairs, leads, "b", "n", total).withColumn("salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("n")
    leaders = leads.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    leaders = leaders.select("b", "y", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    met = salted.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(leaders, ["b", "salt"])
    return met.select("a", "b", "x", "y").mapInArrow(_verify_rows(percent), "a long, b long")


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    a = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    b = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    least = least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return materialise(sized.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long"), "plausible")


def leader_pairs(members: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The leader of each bucket (key, size, leader), and pairs a > b of each node with two of its buckets' leaders.

    A bucket's leader is the node whose buckets are the largest; a node is paired with the most and the least famous
    of its leaders. Pairs grow with the nodes, not with the square of a bucket.
    """
    fame = members.groupBy("node").agg(F.sum("size").alias("fame"))
    famed = members.join(fame, "node").groupBy("key").agg(F.max("size").alias("size"), F.max(F.struct("fame", (-F.col("node")).alias("minus"))).alias("top"))
    famed = materialise(famed, "leaders")
    led = attach_by_key(members.select("key", "node"), famed, "key", "size", total).filter("node <> -top.minus")
    both = led.groupBy("node").agg(F.max("top").alias("first"), F.min("top").alias("last"))
    pairs = both.select(F.col("node").alias("x"), F.explode(F.array(-F.col("first.minus"), -F.col("last.minus"))).alias("y"))
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return famed.select("key", "size", (-F.col("top.minus")).alias("leader")), pairs


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds comp, the component of a node: the node itself where it has none."""
    named = found.select(F.col("doc").alias("node"), F.col("component").alias("comp"))
    return rows.join(named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _edges(found: DataFrame) -> DataFrame:
    return found.filter("doc <> component").select(F.col("doc").alias("a"), F.col("component").alias("b"))


def _in_blocks(dealt: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges that the blocks of dealt (key, i, j, side, node, comp) find."""
    full = dealt.join(reps.select("node", "marks"), "node").join(sets, "node").select("key", "i", "j", "side", "comp", "marks", "elements")
    blocks = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(blocks.mapInArrow(_block_rows(percent), "a long, b long").distinct(), "edges")


def _blocks(size: str, most: str) -> Column:
    """Blocks of a group of `size` nodes, the longest of `most` shingles."""
    return F.ceil(F.col(size) / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.col(most))))).cast("int")


def _block_of(blocks: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), blocks).cast("int")


def link_nodes(reps: DataFrame, sets_of, percent: int) -> DataFrame:
    """Components (doc, component) of nodes: reps (node, n, bands, marks); sets_of(nodes) gives their sets.

    Nodes that share a band meet in a bucket. First each is compared with two leaders. Then every bucket that holds
    several components is dealt into blocks, once, and each block is compared with itself. This is all for buckets of
    one block. Larger ones, joined to a group if they have the same leader, are dealt anew as long as this joins
    components and they hold many; at last the nodes outside a group's largest component are compared with all nodes
    of the group. So every pair of a bucket is compared or already connected, and no bucket has a cap. A block gives
    only edges that join components: never more rows than it has read.
    """
    placed = reps.select("node", "n", F.explode("bands").alias("key"))
    total = reps.count() * (COORDINATES // band_width(percent))
    shared = materialise(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    members = materialise(attach_by_key(placed, shared, "key", "size", total), "members")
    total = members.count()
    leaders, stars = leader_pairs(members, total)
    sets = materialise(sets_of(members.select("node").distinct()), "sets")
    found = components(verify(sets, plausible(stars, reps, percent), percent))

    left = materialise(_with_component(members.drop("size"), found), "left")
    mixed = left.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.max("n").alias("most"),
        F.bit_xor(F.xxhash64("node")).alias("who"), F.sum(F.col("node") % 1_000_003).alias("sum"),
    ).filter("lo <> hi")
    # buckets with the same nodes are one
    mixed = materialise(mixed.groupBy("size", "most", "who", "sum").agg(F.min("key").alias("key")), "mixed")
    open_ = attach_by_key(left, mixed, "key", "size", total).withColumn("blocks", _blocks("size", "most"))
    here = _block_of(F.col("blocks"))
    edges = _in_blocks(open_.select("key", here.alias("i"), here.alias("j"), F.lit(0).alias("side"), "node", "comp"), reps, sets, percent)
    found = _joined(found, edges)

    wide = mixed.withColumn("blocks", _blocks("size", "most")).filter("blocks > 1").drop("blocks")
    if wide.isEmpty():
        return found
    wide = materialise(wide.join(leaders.select("key", "leader"), "key"), "wide")
    group = attach_by_key(left.drop("comp"), wide, "key", "size", total)
    group = materialise(group.select(F.col("leader").alias("key"), "node", "n").distinct(), "group")
    seed = 0
    while True:
        rows = materialise(_with_component(group, found), "group-left")
        parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most"))
        sizes = parts.groupBy("key").agg(F.sum("size").alias("size"), F.max(F.struct("size", "comp")).alias("main"), F.max("most").alias("most"))
        sizes = sizes.select("key", "size", "most", F.col("main.comp").alias("main"), (F.col("size") - F.col("main.size")).alias("rest")).filter("rest > 0")
        sizes = materialise(sizes.withColumn("blocks", _blocks("size", "most")).withColumn("rest_blocks", _blocks("rest", "most")), "group-sizes")
        n, copies = sizes.agg(F.sum("size"), F.sum(F.col("rest") * F.col("blocks") + F.col("size") * F.col("rest_blocks"))).first()
        if not n:
            return found
        met, seed = attach_by_key(rows, sizes, "key", "size", n), seed + 1
        if copies > COPIES * n:
            here = _block_of(F.col("blocks"), seed)
            edges = _in_blocks(met.select("key", here.alias("i"), here.alias("j"), F.lit(0).alias("side"), "node", "comp"), reps, sets, percent)
            if not edges.isEmpty():
                found = _joined(found, edges)
                continue
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        one = met.filter("comp <> main").select("key", _block_of(F.col("rest_blocks")).alias("i"), every("blocks").alias("j"), F.lit(1).alias("side"), "node", "comp")
        two = met.select("key", every("rest_blocks").alias("i"), _block_of(F.col("blocks")).alias("j"), F.lit(2).alias("side"), "node", "comp")
        return _joined(found, _in_blocks(one.unionByName(two), reps, sets, percent))


def _joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    return found if edges.isEmpty() else components(_edges(found).unionByName(edges))


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of k-word shingles have a similarity of `percent` or more; a component is
    named by its smallest doc_id, which is kept. Documents without words are linked with nothing. Equal sets are one
    class, and one row of it goes on to be a node for link_nodes().

    Every row is linked on its own, also where doc_ids repeat; rows of a null doc_id have the component of the others
    of their group, and a null one without any. An empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("told", F.xxhash64("doc_id", "text"))
    schema = "node long, told long, doc_id long, n_shingles long, digest binary, bands array<long>, marks binary"
    rows = texts.select(F.monotonically_increasing_id().alias("node"), "told", "doc_id", "text").mapInArrow(_sketch_rows(k, band_width(percent)), schema)
    rows = materialise(rows, "sketches")
    some = rows.filter("n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    reps = some.drop("doc_id").withColumnRenamed("n_shingles", "n").join(classes.select("node"), "node", "left_semi")
    reps = materialise(reps, "classes-sketched")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Only texts of nodes become sets. Texts and nodes have no size bound, so they meet by a shuffle at any size."""
        wanted = reps.select("told", "node", "digest").join(nodes, "node", "left_semi")
        own = texts.select("told", "text").join(wanted.hint("merge"), "told").distinct()
        return own.select("node", "digest", "text").mapInArrow(_set_rows(k), "node long, elements binary")

    found = link_nodes(reps.select("node", "n", "bands", "marks"), sets_of, percent)
    named = classes.join(found.withColumnRenamed("doc", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach_by_key(named, materialise(lowest, "lowest"), "component", "n", classes.count())
    named = materialise(named.select("digest", "copies", "component_id"), "named")
    linked = attach_by_key(some.select("doc_id", "n_shingles", "digest"), named, "digest", "copies", rows.count())
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_repeats(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group of docs, all its columns: the one of the smallest doc_id, nulls last.

    Every row is linked on its own, also those of a null or repeated doc_id.
    """
    rows, row = numbered(docs)
    links = link(rows.select(F.col(row).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    kept = links.join(rows.select(F.col(row).alias("row"), "doc_id"), "row").groupBy("component_id").agg(F.min(order)["row"].alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(*docs.columns)
