"""Removal of lines that recur across documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import saved

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a UTF-8 line (stripped, A-Z lower-cased), or None if it has fewer than `least` code points."""
    key = line.strip(BLANKS).lower()  # on bytes, lower() changes A-Z alone
    if len(key) < least:
        return None
    if len(key) < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return key


def bitmap(n_lines: int, dropped: list[int]) -> bytes:
    """zlib-compressed bits, one a line in order from the low bit of the first byte: 1 if the line stays."""
    bits = bytearray(b"\xff" * (-(-n_lines // 8)))
    for k in dropped:
        bits[k // 8] &= ~(1 << k % 8)
    return zlib.compress(bytes(bits))


def dropped_lines(keep: bytes, n_lines: int) -> list[int]:
    bits = zlib.decompress(keep)
    return [k for k in range(n_lines) if not bits[k // 8] >> k % 8 & 1]


def _drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, text_hash, n_lines, places) of lines to drop; docs has id, text, text_hash."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"hi long, lo long, id {kind}, text_hash long, n_lines int, places array<int>"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out: tuple[list, ...] = tuple([] for _ in range(6))
                for doc, text, text_hash in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    if doc is None or not text or len(text) < min_chars:
                        continue
                    own: dict[bytes, list[int]] = {}
                    lines = text.split(b"\n")
                    for k, line in enumerate(lines):
                        if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                            own.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(k)
                    for h, places in own.items():
                        for column, v in zip(out, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc, text_hash, len(lines), places)):
                            column.append(v)
                types = [pa.int64(), pa.int64(), part.schema.types[0], pa.int64(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["hi", "lo", "id", "text_hash", "n_lines", "places"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range, by key, and within a key from the largest document down.

        Memory holds the rows of the fewer than min_docs documents that a key has shown so far. From then on its
        rows are drops at once. `docs` is null for a drop. The first and the last key of the range may go on in
        other ranges: what is not decided of them comes out with the number of documents that it stands for.
        """
        names = ["hi", "lo", "id", "text_hash", "n_lines", "places", "docs"]
        key = keeper = last = None
        held: list[tuple] = []
        n, first, types = 0, True, None
        out: list[tuple] = []

        def close(edge: bool) -> None:
            if edge and held:
                counted = n if n >= min_docs else 0
                previous = None
                for r in held:
                    # the keeper stands for all documents of a key that is decided here, else each for itself
                    out.append((*r, counted if r is held[0] and counted else int(r[2] != previous and not counted)))
                    previous = r[2]
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64()])], names=names)
            out.clear()
            return made

        for b in batches:
            types = b.schema.types
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:2] != key:
                    if key is not None:
                        close(first)
                        first = False
                    key, keeper, last, n = r[:2], r[2], None, 0
                if r[2] != last:
                    last = r[2]
                    n += 1
                    if n == min_docs:
                        out += [(*x, None) for x in held if x[2] != keeper]
                        held[:] = [x for x in held if x[2] == keeper]
                if n >= min_docs and r[2] != keeper:
                    out.append((*r, None))
                else:
                    held.append(r)
            if len(out) >= 10_000:
                yield batch()
        if types:
            close(True)
            yield batch()

    ranged = docs.select("id", "text", "text_hash").mapInArrow(keys, fields).repartitionByRange("hi", "lo", "id").sortWithinPartitions("hi", "lo", F.desc("id"))
    found = saved(ranged.mapInArrow(stream, f"{fields}, docs long"), "line-drops")
    edges = found.where("docs is not null")
    totals = edges.groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    # at most two keys of a range, with at most min_docs documents each, are at its edges
    late = edges.join(totals, ["hi", "lo"]).where(F.col("id") < F.col("keeper"))
    columns = ["id", "text_hash", "n_lines", "places"]
    return found.where("docs is null").select(columns).union(late.select(columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_lines, n_dropped, keep) for each document that loses a line: `keep` is a `bitmap`.

    A line goes if its key has at least min_chars code points, is found in at least min_docs different ids, and
    its document is not the largest id that holds it. The kept text is not returned.

    128-bit hashes of keys, one row a document and key with the key's places, are range-partitioned by (hash,
    document), sorted by hash and by document from the largest down, and streamed: the first row of a key is its
    keeper's. As the document is part of the range, a key of a third of all documents spreads over many
    partitions; only sums of the keys at the edges of partitions meet afterwards.

    Null ids and null or empty texts lose nothing. Rows that share an id count as one document and are told apart
    by text_hash (xxhash64 of the text); repeated rows lose the same lines. Empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dropped = [sorted({k for p in places for k in p}) for places in b.column(3).to_pylist()]
            keep = [bitmap(n, d) for n, d in zip(b.column(2).to_pylist(), dropped)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(map(len, dropped), pa.int32()), pa.array(keep, pa.binary())], names=["id", "text_hash", "n_lines", "n_dropped", "keep"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    by_doc = _drops(named, min_chars, min_docs).groupBy("id", "text_hash", "n_lines").agg(F.collect_list("places").alias("places"))
    return by_doc.mapInArrow(joined, f"id {kind}, text_hash long, n_lines int, n_dropped int, keep binary").withColumnRenamed("id", id_col)


def _with_keep(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """All rows of docs as structs `row`, with id, text and the bitmap or null."""
    maps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(F.col(id_col).alias("k_id"), F.col("text_hash").alias("k_hash"), F.col("keep").alias("k_keep"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    return named.join(maps, (F.col("id") == F.col("k_id")) & (F.col("h") == F.col("k_hash")), "left")


def _kept(text: bytes | None, keep: bytes | None) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    if keep is None:
        return text or b"", len(lines), 0
    gone = set(dropped_lines(keep, len(lines)))
    return b"\n".join([x for k, x in enumerate(lines) if k not in gone]), len(lines), len(gone)


def line_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row, the kept lines joined by newlines. See keep_bitmaps."""
    kind = docs.schema[id_col].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_kept(t.as_py(), k.as_py()) for t, k in zip(b.column(1).cast(pa.binary()), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made], pa.string())], names=["id", "n_lines", "n_dropped", "kept_sha256"])

    both = _with_keep(docs.select(id_col, text_col), min_chars, min_docs, id_col, text_col)
    return both.select("id", F.col(f"row.{text_col}"), "k_keep").mapInArrow(digests, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines dropped from the text; all other columns as they are. Null texts stay null. See keep_bitmaps."""

    @F.pandas_udf("string")
    def kept(text, keep):
        import pandas as pd

        return pd.Series([t if k is None or t is None else _kept(t.encode(), k)[0].decode() for t, k in zip(text, keep)], dtype=object)

    both = _with_keep(docs, min_chars, min_docs, id_col, text_col)
    new = F.when(F.col("k_keep").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept(F.col(f"row.`{text_col}`"), "k_keep"))
    return both.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
