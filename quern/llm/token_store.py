"""Content-addressed store of token ids.

A store is a folder with four tables:

* `chunks`: address binary (sha256 of the ids), n_ids int, ids binary (little-endian unsigned 16-bit,
  compressed with zstandard). Each address is stored once.
* `recipes`: uid long, id, n_tokens long, chunks array<struct<address, n_ids>>, part int: in ascending order of
  id, from part to part and within a part's files.
* `parts`: part int, n_docs long, n_tokens long, root binary: the Merkle root over the part's recipes, each a leaf of
  its document's id, number of ids, and the addresses and lengths of its chunks.
* `manifest`: n_docs long, n_tokens long, root binary: the Merkle root over the parts.

Ids are cut where a rolling hash over the last 8 ids has its low bits zero, so that equal passages of different
documents give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import new_path, remove

WINDOW = 8
LEAST, MEAN_BITS, MOST = 256, 11, 8192
#: The most addresses that a task remembers.
SEEN = 200_000


def _gear():
    import numpy as np

    return np.random.Generator(np.random.PCG64(20_240_607)).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def marks(ids, gear, bits: int = MEAN_BITS):
    """Places after which the rolling hash over WINDOW ids lets a chunk end."""
    import numpy as np

    g = gear[ids]
    h = g.copy()
    for j in range(1, min(WINDOW, len(ids))):
        h[j:] += g[:-j] << np.uint32(4 * j)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def cut_points(found, begin: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the ids from begin to end, given sorted marks; the last is `end`. Chunks have least to most ids but for the last.

    least is more than WINDOW, so that the ids before `begin` don't count.
    """
    import bisect

    ends, at = [], begin
    while end - at > least:
        k = bisect.bisect_left(found, at + least)
        at = min(found[k] if k < len(found) else end, at + most, end)
        ends.append(at)
    if at < end or not ends:
        ends.append(end)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """sha256 tree: leaves and inner nodes are hashed under different prefixes; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


def _zeros() -> list[list[int]]:
    """Matrix k takes a crc32 register over 2**k zero bytes; each is the square of the one before."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]
    out = []
    for k in range(3 + 48):
        if k >= 3:
            out.append(bit)
        bit = [_times(bit, row) for row in bit]
    return out


_ZEROS = _zeros()


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation, from (crc32, length in bytes) of its parts."""
    out = 0
    for crc, n in parts:
        k = 0
        while n and out:
            if n & 1:
                out = _times(_ZEROS[k], out)
            n >>= 1
            k += 1
        out ^= crc
    return out


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, end it with id 0 and write the store at path.

    One pass encodes. Its rows are recipes and chunks; chunks already met by the task are left out before the
    shuffle, so that a chunk of a third of all documents costs one row a task. Chunks are dealt and sorted by
    address, and the first of each is written; recipes are dealt by document. A null text counts as empty: the end id alone. Rows with equal ids stay separate
    documents, next to each other in the order they are read. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        from quern.llm.encoding import borrowed

        gear, press = _gear(), zstandard.ZstdCompressor(level=1, write_content_size=True)
        uid, seen = TaskContext.get().partitionId() << 36, set()
        names = ["kind", "address", "uid", "id", "n_ids", "ids", "chunks"]  # a recipe has its uid for an address
        pair = pa.list_(pa.struct([("address", pa.binary()), ("n_ids", pa.int32())]))
        with borrowed(tokenizer_path) as encoder:
            for b in batches:
                id_type, step = b.schema.types[0], 256
                for i in range(0, b.num_rows, step):
                    part = b.slice(i, step)
                    rows: tuple[list, ...] = tuple([] for _ in names)
                    bodies = [encoder.encode(t) + b"\0\0" for t in part.column(1).to_pylist()]
                    whole = b"".join(bodies)
                    found, begin = marks(np.frombuffer(whole, "<u2"), gear).tolist(), 0
                    for doc, body in zip(part.column(0).to_pylist(), bodies):
                        recipe, at = [], begin
                        begin += len(body) // 2
                        for end in cut_points(found, at, begin):
                            raw = whole[2 * at : 2 * end]
                            address = hashlib.sha256(raw).digest()
                            recipe.append({"address": address, "n_ids": end - at})
                            if address not in seen:
                                seen.add(address)
                                for column, v in zip(rows, ("chunk", address, None, None, end - at, press.compress(raw), None)):
                                    column.append(v)
                            at = end
                        for column, v in zip(rows, ("recipe", uid.to_bytes(8, "big"), uid, doc, None, None, recipe)):
                            column.append(v)
                        uid += 1
                    if len(seen) > SEEN:
                        seen.clear()
                    types = [pa.string(), pa.binary(), pa.int64(), id_type, pa.int32(), pa.binary(), pair]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    schema = f"kind string, address binary, uid long, id {kind}, n_ids int, ids binary, chunks array<struct<address: binary, n_ids: int>>"
    staged = new_path(spark, "store")
    # one sort by (kind, address): it parts equal chunks, and the write by kind needs no other
    place = F.row_number().over(Window.partitionBy("kind", "address").orderBy("n_ids"))
    (
        docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
        # not `place = 1`, for which Spark would sort the tasks' own rows, too
        .withColumn("place", place).where(F.col("place") - 1 == 0).drop("place")
        .write.partitionBy("kind").option("compression", "uncompressed").parquet(staged)
    )
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    chunks_schema = "address binary, n_ids int, ids binary"
    made = jvm.org.apache.hadoop.fs.Path(f"{staged}/kind=chunk")
    if not fs.exists(made):
        spark.createDataFrame([], chunks_schema).write.parquet(f"{path}/chunks")
    elif not fs.rename(made, jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")):
        raise OSError(f"{path}/chunks can't be made")
    recipe_schema = f"uid long, id {kind}, chunks array<struct<address: binary, n_ids: int>>"
    found = spark.read.schema(f"kind string, {recipe_schema}").parquet(staged).where("kind = 'recipe'")
    (
        found.select("uid", "id", F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["n_ids"]).alias("n_tokens"), "chunks")
        .repartitionByRange("id", "uid").sortWithinPartitions("id", "uid").withColumn("part", F.spark_partition_id())
        .write.parquet(f"{path}/recipes")
    )
    remove(spark, staged)
    parts = recipe_roots(recipes(spark, path, kind))
    parts.write.parquet(f"{path}/parts")
    total = spark.read.parquet(f"{path}/parts").orderBy("part").collect()  # a row for each written part, not for each document
    spark.createDataFrame([(sum(r.n_docs for r in total), sum(r.n_tokens for r in total), merkle_root([bytes(r.root) for r in total]))], "n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def recipes(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"uid long, id {kind}, n_tokens long, chunks array<struct<address: binary, n_ids: int>>, part int").parquet(f"{path}/recipes")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address binary, n_ids int, ids binary").parquet(f"{path}/chunks")


def recipe_roots(found: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): each recipe is a leaf; rows of a part are read in ascending order of document."""
    number = lambda c: F.concat(F.lit(b":"), c.cast("string").cast("binary"))
    steps = F.aggregate("chunks", F.lit(b""), lambda a, c: F.concat(a, F.lit(b":"), c["address"], number(c["n_ids"])))
    leaf = F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string").cast("binary"), F.lit(b"")), number(F.col("n_tokens")), steps), 256))

    def roots(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("uid", "ascending")])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n_docs": pa.array([t.num_rows], pa.int64()), "n_tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()), "root": pa.array([merkle_root(t.column("leaf").to_pylist())], pa.binary())})

    return found.select("part", "id", "uid", "n_tokens", leaf.alias("leaf")).groupBy("part").applyInArrow(roots, "part int, n_docs long, n_tokens long, root binary")


def verify_store(spark: SparkSession, path: str, kind: str = "long") -> bool:
    """Whether the Merkle roots and sums of the recipes as read give the parts and the manifest."""
    stored = spark.read.parquet(f"{path}/manifest").first()
    now = recipe_roots(recipes(spark, path, kind)).orderBy("part").collect()
    parts = spark.read.schema("part int, n_docs long, n_tokens long, root binary").parquet(f"{path}/parts").orderBy("part").collect()
    sums = (sum(r.n_docs for r in now), sum(r.n_tokens for r in now))
    return now == parts and merkle_root([bytes(r.root) for r in now]) == bytes(stored.root) and sums == (stored.n_docs, stored.n_tokens)


def read_ids(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(uid, id, n_tokens, ids array<int>): documents put together again from their chunks. A missing or damaged chunk ends the run with an error."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for address, n, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = press.decompress(ids)
                if hashlib.sha256(raw).digest() != address or len(raw) != 2 * n:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                out.append(np.frombuffer(raw, "<u2").astype("i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["address", "part_ids"])

    steps = recipes(spark, path, kind).select("uid", "id", "n_tokens", F.posexplode("chunks").alias("k", "c")).select("uid", "id", "n_tokens", "k", F.col("c.address").alias("address"))
    bodies = chunks(spark, path).mapInArrow(opened, "address binary, part_ids array<int>")
    found = steps.join(bodies, "address", "left").groupBy("uid", "id", "n_tokens").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part_ids"))), lambda x: x["part_ids"])).alias("ids"))
    whole = F.when(F.size("ids") == F.col("n_tokens"), F.col("ids")).otherwise(F.raise_error(F.lit("a chunk is missing")))
    return found.select("uid", "id", "n_tokens", whole.alias("ids"))


def document_digests(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.

    Every stored chunk is opened, held against its address, counted and summed up as the crc32 of its ids in 32
    bits; a document's count and crc32 are put together from those of the chunks as opened, so that no ids are
    shuffled. A chunk that does not give its address, a missing one, and a count other than the recipe's end the
    run with an error. Hold the recipes against the manifest first (verify_store): `start` sums their counts.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            crcs, counts = [], []
            for address, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                raw = press.decompress(ids)
                if hashlib.sha256(raw).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
                counts.append(len(raw) // 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], names=["address", "crc", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, crcs = [], []
            for stated, steps in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if any(s["crc"] is None for s in steps):
                    raise ValueError("a chunk is missing")
                counts.append(sum(s["n"] for s in steps))
                if counts[-1] != stated:
                    raise ValueError("a recipe's number of ids is not that of its chunks")
                crcs.append(combined_crc([(s["crc"], 4 * s["n"]) for s in steps]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["uid", "id", "n_tokens", "ids_crc32"])

    found = recipes(spark, path, kind)
    sums = chunks(spark, path).mapInArrow(opened, "address binary, crc long, n long")
    steps = found.select("uid", "id", "n_tokens", F.posexplode("chunks").alias("k", "c")).select("uid", "id", "n_tokens", "k", F.col("c.address").alias("address"))
    docs = steps.join(sums, "address", "left").groupBy("uid", "id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc"))).alias("steps"))
    crcs = docs.select("uid", "id", "n_tokens", "steps").mapInArrow(whole, f"uid long, id {kind}, n_tokens long, ids_crc32 long")
    # one row for each part of the recipes, so their running sum is one task's work, and small enough to broadcast
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    parts = spark.read.schema("part int, n_docs long, n_tokens long, root binary").parquet(f"{path}/parts").select("part", before)
    within = Window.partitionBy("part").orderBy("id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("part", "uid", (F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("ahead")).join(F.broadcast(parts), "part").select("uid", (F.col("base") + F.col("ahead")).alias("start"))
    return crcs.join(starts, "uid").select("id", "start", "n_tokens", "ids_crc32")
