"""Near-duplicate documents by the exact Jaccard similarity of their shingle sets, found by T-occurrence search.

The search in four steps, each exact:

1. Sets. Every document's shingles are hashed; equal sets are one class, so copies cost nothing further. The same pass
   makes a sketch, sized by the number of rows, of how often shingles occur (counts by hash bucket, over all documents).
2. Lists. Sets are ordered by (bucket's frequency, hash). Two sets that reach the threshold share a shingle among
   the first n - ceil(t n) + 1 of each, so only those go into inverted lists. Short lists (up to SHORT classes) give
   pairs, counted; a pair whose count can't reach the needed overlap is gone. Long lists stay lists.
3. Blocks. Classes that surviving pairs connect meet in a block, with others while there is room. Classes that long lists connect are one family, and only
   classes of one family can link; a family of up to BLOCK_CLASSES meets in one block.
4. Search. In a block, each set looks up its own inverted lists: short lists are merged and counted, long ones only
   probed for the candidates left (DivideSkip), and classes reaching the overlap that their sizes ask for are links.

A larger family is dealt over blocks. The groups that links make within a block send their leaders to further rounds,
until they meet in one block or no longer get fewer. What is then in the largest group of its family needs no more
comparisons with the rest of that group; every other class of the family meets all of it, in blocks by size. So a
family of k near copies costs about k comparisons with the leaders, and only classes that share their frequent
shingles without linking are compared all with all.

Links within a block become a spanning forest, and connected components unite them over blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, saved
from quern.llm.shingles import mix, set_id, shingle_set

#: Lists of more classes than this are long.
SHORT = 64
#: log2 of the sketch's buckets: SPREAD more than that of the rows, in these bounds. The upper one is a worker's memory.
SPREAD, LEAST_BITS, MOST_BITS = 2, 20, 23
#: The same for the bits of the filter of wanted classes.
BLOOM_SPREAD, LEAST_BLOOM, MOST_BLOOM = 6, 16, 27
PAIRS_PER_BLOCK = 4_000
#: The most classes, and about the most shingles, that meet in a block.
BLOCK_CLASSES, BLOCK_SHINGLES = 600, 1_000_000
#: Lists of a bucket that counts this many times the mean, and at least LEAST_HEAVY, are long without being looked at.
HEAVY, LEAST_HEAVY = 8, 8_192
#: About so many rows of lists are sorted by a task.
ROWS_PER_TASK = 250_000
#: DivideSkip's weight of probing against merging.
MU = 0.01
PARTS = 16
#: Arrays of tasks are folded in so many groups first, then those.
FOLD_GROUPS = 32


def _in_parts(whole: np.ndarray) -> list[bytes]:
    return [zlib.compress(x.tobytes(), 1) for x in np.split(whole, PARTS)]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def folded(parts: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, dtype: str) -> np.ndarray:
    """An array of fixed size from (part int, task int, body binary): each task's array, cut in PARTS. They are
    folded together on executors in two levels, so that no task reads the arrays of all others."""

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for body in b.column(2):
                one = np.frombuffer(zlib.decompress(body.as_py()), dtype)
                total = one if total is None else how(total, one)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "task", "body"])

    schema = "part int, task int, body binary"
    some = parts.select("part", (F.col("task") % FOLD_GROUPS).alias("task"), "body").groupBy("part", "task").applyInArrow(fold, schema)
    out = np.zeros(size, dtype)
    for r in some.groupBy("part").applyInArrow(fold, schema).collect():  # PARTS rows
        out[r.part * size // PARTS : (r.part + 1) * size // PARTS] = np.frombuffer(zlib.decompress(bytes(r.body)), dtype)
    return out


def _bits_for(n: int, spread: int, least: int, most: int) -> int:
    return max(least, min(most, max(1, n).bit_length() + spread))


def least_overlap(nx, ny, percent: int):
    """The smallest intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def links_among(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """T-occurrence search: all pairs (i, j) of sets that reach the threshold, each by its exact overlap."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes[order])  # by rank in order
    values = np.concatenate([sets[i] for i in order])
    by_value = np.argsort(values, kind="stable")
    ordered = values[by_value]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    lengths = np.diff(np.append(first, len(ordered)))
    list_of = np.empty(len(values), np.int64)
    list_of[by_value] = np.repeat(np.arange(len(first)), lengths)
    posted = owner[by_value]  # ascending rank within a list
    ends = np.cumsum(sizes[order])
    size_of = sizes[order]
    out = []
    for x in range(1, len(sets)):
        n = int(size_of[x])
        own = list_of[ends[x] - n : ends[x]]
        own = own[lengths[own] > 1]
        need = -(-percent * n // 100)  # no set reaches the threshold with less
        if len(own) < need:
            continue
        size = lengths[own]
        longest = int(size.max())
        n_long = min(int(need / (MU * math.log2(longest) + 1)), need - 1, len(own))
        cut = np.argsort(size, kind="stable")
        short, long_ = own[cut[: len(own) - n_long]], own[cut[len(own) - n_long :]]
        # merge the short lists: ranks below x, counted
        k = lengths[short]
        at = np.repeat(first[short] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(int(k.sum()))
        ranks = posted[at]
        counts = np.bincount(ranks[ranks < x], minlength=1)
        found = np.flatnonzero(counts >= max(1, need - n_long))
        if not len(found):
            continue
        found = found[size_of[found] * 100 >= percent * n]
        total = counts[found]
        # probe the long ones for those left, and let go of what can't reach the overlap any more
        asked = least_overlap(n, size_of[found], percent)
        for i, q in enumerate(long_[::-1]):
            if not len(found):
                break
            posts = posted[first[q] : first[q] + lengths[q]]
            place = np.searchsorted(posts, found)
            total = total + (posts[np.minimum(place, len(posts) - 1)] == found)
            if i % 16 == 15:
                alive = total + (len(long_) - 1 - i) >= asked
                found, total, asked = found[alive], total[alive], asked[alive]
        out += [(int(order[y]), int(order[x])) for y in found[total >= asked]]
    return out


def leaders(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """For each of n places the first place of its group, where pairs connect places."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _sets_of(docs: DataFrame, kind: str, width: int, bits: int) -> DataFrame:
    """(id, class, n, null, null, null) of every row, and the parts of each task's counts of shingles by bucket, without ids."""
    names = ["id", "class", "n", "part", "task", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift, id_type = np.zeros(1 << bits, np.uint32), np.uint64(64 - bits), None
        for b in batches:
            id_type = b.schema.types[0]
            for i in range(0, b.num_rows, 300):
                some = b.slice(i, 300)
                made = [shingle_set(t.as_py(), width) for t in some.column(1).cast(pa.binary())]
                at, k = np.unique(np.concatenate(made) >> shift, return_counts=True)
                counts[at.astype(np.int64)] += k.astype(np.uint32)
                classes = pa.array([set_id(s) if len(s) else None for s in made], pa.int64())
                empty = [pa.nulls(len(made), t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), classes, pa.array(map(len, made), pa.int64()), *empty], names=names)
        if counts.any():
            absent = [pa.nulls(PARTS, t) for t in (id_type, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*absent, pa.array(range(PARTS), pa.int32()), pa.array([_task()] * PARTS, pa.int32()), pa.array(_in_parts(counts), pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {kind}, class long, n long, part int, task int, body binary")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)


def _prefixes(docs: DataFrame, rank: bytes, heavy: bytes, percent: int, width: int) -> DataFrame:
    """Rows of the inverted lists: the first shingles of each set, once a task for equal sets. n is negative for lists of heavy buckets."""
    shift = np.uint64(64 - (len(rank).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, is_heavy, seen = np.frombuffer(rank, np.uint8), np.frombuffer(heavy, np.bool_), set()
        for b in batches:
            for i in range(0, b.num_rows, 200):
                lists, classes, sizes, k = [], [], [], []
                for t in b.column(1).slice(i, 200).cast(pa.binary()):
                    s = shingle_set(t.as_py(), width)
                    if not len(s) or (c := set_id(s)) in seen:
                        continue
                    seen.add(c)
                    bucket = (s >> shift).astype(np.int64)
                    first = np.lexsort((s, ranks[bucket]))[: prefix_size(len(s), percent)]
                    lists.append(s[first].view(np.int64))
                    classes.append(c)
                    sizes.append(np.where(is_heavy[bucket[first]], -len(s), len(s)).astype(np.int32))
                    k.append(len(first))
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(classes, k)), pa.array(np.concatenate(sizes))], names=["list", "class", "n"])

    return docs.mapInArrow(run, "list long, class long, n int")


#: A pair of classes with their sizes; or, with nb null, a class `a` of the long list `b`.
FOUND = "a long, b long, na int, nb int"


def _lists(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams lists, sorted by (list, class): a batch of rows and at most SHORT classes of the list before it are in memory."""
    triangles: dict[int, tuple] = {}

    def long_rows(lists: np.ndarray, classes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(lists), pa.array(np.abs(n)), pa.nulls(len(n), pa.int32())], names=["a", "b", "na", "nb"])

    def whole(lists: np.ndarray, classes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What lists give that have no further rows."""
        first = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        k = np.diff(np.append(first, len(lists)))
        of_long = np.repeat(k > SHORT, k)
        if of_long.any():
            yield long_rows(lists[of_long], classes[of_long], n[of_long])
        for size in np.unique(k[(k > 1) & (k <= SHORT)]):
            if size not in triangles:
                triangles[size] = np.triu_indices(size, 1)
            i, j = triangles[size]
            rows = first[k == size][:, None]
            x, y = (rows + i).ravel(), (rows + j).ravel()
            fits = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
            x, y = x[fits], y[fits]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(classes[x]), pa.array(classes[y]), pa.array(n[x]), pa.array(n[y])], names=["a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known_long = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32)), None
        for b in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            heavy = rows[2] < 0
            if heavy.any():
                yield long_rows(*(x[heavy] for x in rows))
                rows = tuple(x[~heavy] for x in rows)
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
            fresh = np.ones(len(rows[0]), bool)  # a class comes once from each task that met it
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            more = rows[0] == known_long if known_long is not None else np.zeros(len(fresh), bool)
            if (more & fresh).any():
                yield long_rows(*(x[more & fresh] for x in rows))
            rows = tuple(x[fresh & ~more] for x in rows)
            held = rows
            if len(rows[0]):
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last:
                    yield from whole(*(x[:last] for x in rows))
                held = tuple(x[last:] for x in rows)
                known_long = None
                if len(held[0]) > SHORT:
                    yield long_rows(*held)
                    known_long = held[0][0]
                    held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield from whole(*held)

    return run


def _candidates(docs: DataFrame, counts: np.ndarray, n_rows: int, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes that may reach the threshold, with their sizes: a, b, na, nb; classes of long lists: class, n, family)."""
    rank = np.minimum(255, 4 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8).tobytes()
    heavy = (counts > max(HEAVY * float(counts.mean()), LEAST_HEAVY)).tobytes()
    rows = _prefixes(docs, rank, heavy, percent, width)
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_PER_TASK))
    dealt = rows.repartition(tasks, F.when(F.col("n") < 0, F.col("class")).otherwise(F.col("list")))
    found = saved(dealt.sortWithinPartitions("list", "class").mapInArrow(_lists(percent), FOUND), "lists")
    share = lambda n: F.ceil(n * percent / 100)
    shared = found.where("nb is not null").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    reach = F.col("shared") + F.greatest(share(F.col("na")), share(F.col("nb"))) - 1 >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    pairs = saved(shared.where(reach).select("a", "b", "na", "nb"), "pairs")
    long_ = found.where("nb is null").select(F.col("a").alias("class"), F.col("b").alias("list"), F.col("na").alias("n"))
    first = long_.groupBy("list").agg(F.min("class").alias("first"))
    # each class of a list hangs on the list's first: one edge for all the lists that two classes share
    edges = saved(long_.join(first, "list").groupBy("class", "first").agg(F.max("n").alias("n")), "long-lists")
    named = connected_components(edges.select(F.col("class").alias("src"), F.col("first").alias("dst")))
    sizes = edges.groupBy("class").agg(F.max("n").alias("n"))
    # a class alone in its lists has no partner there
    families = saved(sizes.join(named, F.col("class") == F.col("node")).select("class", "n", F.col("component").alias("family")), "families")
    return pairs, families


def _bits(classes: np.ndarray, owners: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter of (class, owner), two a pair."""
    key = mix(classes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owners.view(np.uint64))
    return np.unique(np.concatenate([(key >> np.uint64(s)).astype(np.int64) & ((1 << bits) - 1) for s in (0, 32)]))


def _wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, body): the sets of the wanted classes (class, owner), made from the text of the row whose id has that
    hash. A filter keeps other rows from being written; some pass it."""
    bits = _bits_for(wanted.count(), BLOOM_SPREAD, LEAST_BLOOM, MOST_BLOOM)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = _bits(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)
            np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_task()] * PARTS, pa.int32()), pa.array(_in_parts(found), pa.binary())], names=["part", "task", "body"])

    parts = wanted.select("class", "owner").mapInArrow(marked, "part int, task int, body binary")
    bloom = zlib.compress(folded(parts, np.bitwise_or, (1 << bits) // 8, "u1").tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = np.frombuffer(zlib.decompress(bloom), np.uint8), set()
        for b in batches:
            for i in range(0, b.num_rows, 200):
                ids, bodies, owners = [], [], b.column(1).slice(i, 200).to_numpy()
                for k, t in enumerate(b.column(0).slice(i, 200).cast(pa.binary())):
                    s = shingle_set(t.as_py(), width)
                    if len(s) and (c := set_id(s)) not in seen:
                        at = _bits(np.array([c]), owners[k : k + 1], bits)
                        if (found[at >> 3] >> (at & 7) & 1).all():
                            seen.add(c)
                            ids.append(c)
                            bodies.append(s.tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], names=["class", "body"])

    return docs.select("text", F.xxhash64("id").alias("owner")).mapInArrow(run, "class long, body binary")


def _searched(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(block, leader, class) of every class of every block: the first class of its group of links there."""

    def search(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        ids = t.column("class").to_numpy()
        first = np.unique(ids, return_index=True)[1]  # rows of one id, or that passed the filter, may repeat a class
        bodies = t.column("body")
        found = [np.frombuffer(bodies[int(i)].as_py(), np.uint64) for i in first]
        group = leaders(links_among(found, percent), len(found))
        return pa.table({"block": pa.array([key[0].as_py()] * len(found), pa.int64()), "leader": pa.array(ids[first][group]), "class": pa.array(ids[first])})

    return saved(blocks.join(sets, "class").groupBy("block").applyInArrow(search, "block long, leader long, class long"), "searched")


def _size_class(n: Column) -> Column:
    """Sets of which one is at most 4/3 of the other lie in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / math.log(1.34)).cast("int")


def _blocks_needed(classes: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(classes / BLOCK_CLASSES, shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(members: DataFrame, turn: int) -> DataFrame:
    """members (family, class, n) with m, the number of blocks of the family, and the class's block."""
    sizes = members.groupBy("family").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    needed = sizes.select("family", _blocks_needed(F.col("k"), F.col("s")).alias("m"))
    place = F.pmod(F.xxhash64("class", F.lit(turn)), F.col("m"))
    return members.join(needed, "family").withColumn("block", F.xxhash64("family", place, F.lit(turn)))


def _rest_blocks(rest: DataFrame, members: DataFrame) -> DataFrame:
    """(block, class) in which each class of `rest` meets all classes of its family of sizes that allow a link."""

    def packed(some: DataFrame, m: str, at: str) -> tuple[DataFrame, DataFrame]:
        sized = some.select("family", "class", "n", _size_class(F.col("n")).alias("c"))
        needed = sized.groupBy("family", "c").agg(_blocks_needed(F.count("*") * 2, F.sum("n") * 2).alias(m))
        return sized.join(needed, ["family", "c"]).withColumn(at, F.pmod(F.xxhash64("class"), F.col(m)).cast("int")).drop(m), needed

    left, left_needed = packed(rest, "m", "i")
    right, right_needed = packed(members, "m", "j")
    near = F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))
    name = F.xxhash64("family", "lc", "i", "rc", "j").alias("block")
    asked = left.withColumn("rc", near).withColumnRenamed("c", "lc").join(right_needed.withColumnRenamed("c", "rc"), ["family", "rc"])
    asked = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(name, "class")
    given = right.withColumn("lc", near).withColumnRenamed("c", "rc").join(left_needed.withColumnRenamed("c", "lc"), ["family", "lc"])
    given = given.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(name, "class")
    return asked.union(given).distinct()


def _pair_blocks(pairs: DataFrame) -> DataFrame:
    """(block, class): the classes that pairs connect meet in one block, several such groups in each. Pairs of a
    group too large for that are dealt by their first class."""
    named = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    both = pairs.select("a", "b", "na", "nb").join(named.withColumnRenamed("node", "a"), "a")
    classes = both.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("na").alias("n")), F.struct(F.col("b").alias("class"), F.col("nb").alias("n")))).alias("x"), "component").select("x.class", "x.n", "component").distinct()
    sizes = classes.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    small = (F.col("k") <= BLOCK_CLASSES) & (F.col("s") <= BLOCK_SHINGLES)
    total = sizes.where(small).agg(F.sum("k").alias("k"), F.sum("s").alias("s")).first()
    packs = max((total.k or 0) // BLOCK_CLASSES, (total.s or 0) // BLOCK_SHINGLES) + 1
    fit = sizes.withColumn("small", small).select("component", "small")
    met = classes.join(fit.where("small"), "component").select(F.pmod(F.xxhash64("component"), F.lit(packs)).alias("block"), "class")
    wide = both.join(fit.where("not small"), "component")
    total = wide.agg(F.count("*").alias("k"), F.sum(F.col("na") + F.col("nb")).alias("s")).first()
    n = max(total.k // PAIRS_PER_BLOCK, (total.s or 0) // (2 * BLOCK_SHINGLES)) + 1
    return met.union(wide.select((F.pmod(F.xxhash64("a"), F.lit(n)) + packs).alias("block"), F.explode(F.array("a", "b")).alias("class")))


def links(docs: DataFrame, owners: DataFrame, counts: np.ndarray, n_rows: int, percent: int, width: int) -> DataFrame:
    """(src, dst) classes: enough links to connect all that reach the threshold.

    docs has id and text; owners has each class and the hash of the id of a row that has it; n_rows: rows of the lists, about.
    """
    if percent < 75:
        raise ValueError("size classes are made for 75 % and more")
    pairs, families = _candidates(docs, counts, n_rows, percent, width)
    dealt = saved(_dealt(families, 0), "dealt")
    blocks = saved(_pair_blocks(pairs).union(dealt.select("block", "class")).distinct(), "blocks")
    sets = saved(_wanted_sets(docs, saved(blocks.select("class").distinct().join(owners, "class"), "wanted"), width), "bodies")
    searched = _searched(sets, blocks, percent)
    edges = searched.select(F.col("leader").alias("src"), F.col("class").alias("dst"))
    large, members, turn = dealt.where("m > 1").select("family", "class", "n"), dealt, 0
    many, before = members.where("m > 1").count(), None
    while many and (before is None or 2 * many <= before):
        # the leaders of the blocks of large families meet in fewer blocks
        first = searched.where("leader = class").select("block", "class")
        turn += 1
        members = saved(_dealt(members.where("m > 1").join(first, ["block", "class"]).select("family", "class", "n"), turn), "leaders")
        searched = _searched(sets, members.select("block", "class"), percent)
        edges = edges.union(searched.select(F.col("leader").alias("src"), F.col("class").alias("dst")))
        before, many = many, members.where("m > 1").count()
    if turn:
        united = saved(connected_components(edges), "groups")
        named = large.join(united, F.col("class") == F.col("node"), "left").select("family", "class", "n", F.coalesce("component", "class").alias("g"))
        largest = named.groupBy("family", "g").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "g"))["g"].alias("most"))
        rest = saved(named.join(largest, "family").where("g <> most").select("family", "class", "n"), "rest")
        if not rest.isEmpty():
            others = large.join(rest.select("family").distinct(), "family", "left_semi")
            more = _searched(sets, _rest_blocks(rest, others), percent)
            edges = edges.union(more.select(F.col("leader").alias("src"), F.col("class").alias("dst")))
    return edges.where("src <> dst")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: component_id is the smallest id reachable over links, itself included.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of `width`
    words, A-Z lower-cased, parted by ASCII blanks. A document of fewer words has its whole sequence as its only
    shingle. Without words, or with a null text, it has none and links with nothing. Sets are compared by 64-bit
    hashes of their shingles. Repeated rows and equal texts are in one component; a null id is never the smallest
    while another is there; an empty table gives no rows; other columns are not read. percent is 75 to 100.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits = _bits_for(own.count(), SPREAD, LEAST_BITS, MOST_BITS)
    made = saved(_sets_of(own, kind, width, bits), "sets")
    counts = folded(made.where("part is not null").select("part", "task", "body"), _added, 1 << bits, "u4")
    sets = made.where("part is null").select("id", "class", "n")
    n_rows = sets.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0]
    owners = sets.where("class is not null").groupBy("class").agg(F.min(F.xxhash64("id")).alias("owner"))
    united = saved(connected_components(links(own, owners, counts, int(n_rows or 0), percent, width)), "united")
    first = sets.where("class is not null").groupBy("class").agg(F.min("id").alias("first"))
    named = first.join(united, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(lowest, "component").select("class", "component_id")
    return sets.join(by_class, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
