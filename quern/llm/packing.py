"""Packing of documents into sequences of a fixed number of tokens, balanced by attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = b"\0\0"
SCHEMA = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class _Open:
    """Sequences by room left: a heap by cost for each room, and a tree over rooms with the lowest cost below each node."""

    def __init__(self, seq_len: int, count: int):
        self.leaves = 1
        while self.leaves <= seq_len:
            self.leaves *= 2
        self.heaps: list[list] = [[] for _ in range(self.leaves)]
        self.tree: list = [None] * (2 * self.leaves)
        self.heaps[seq_len] = [(0.0, i) for i in range(count)]
        self._up(seq_len)

    def _up(self, room: int) -> None:
        tree, i = self.tree, room + self.leaves
        tree[i] = (*self.heaps[room][0], room) if self.heaps[room] else None
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = b if a is None or (b is not None and b < a) else a

    def take(self, least: int):
        """(cost, sequence, room) of the cheapest sequence with room for `least` more tokens; it leaves its heap."""
        tree, best = self.tree, None
        lo, hi = least + self.leaves, 2 * self.leaves
        while lo < hi:
            if lo & 1:
                if tree[lo] is not None and (best is None or tree[lo] < best):
                    best = tree[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] is not None and (best is None or tree[hi] < best):
                    best = tree[hi]
            lo, hi = lo // 2, hi // 2
        if best is not None:
            heapq.heappop(self.heaps[best[2]])
            self._up(best[2])
        return best

    def roomiest(self) -> int:
        i = 1
        while i < self.leaves:
            i = 2 * i + (self.tree[2 * i + 1] is not None)
        return i - self.leaves

    def put(self, cost: float, seq: int, room: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, seq))
            self._up(room)


def assign(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (item, first token, length, sequence, offset) and the cost of each sequence.

    There are as few sequences as the tokens need. Items go in descending length to the cheapest sequence that
    has room for all of it. Where none has, the item is cut: the roomiest sequence is filled and the rest goes on.
    """
    count = -(-sum(lengths) // seq_len)
    open_, out, costs = _Open(seq_len, count), [], [0.0] * count
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        first, left = 0, lengths[item]
        while left:
            found = open_.take(left) if left <= seq_len else None
            if found is None:
                found = open_.take(open_.roomiest())
            cost, seq, room = found
            n = min(left, room)
            cost += linear * n + quadratic * n * n
            out.append((item, first, n, seq, seq_len - room))
            costs[seq] = cost
            open_.put(cost, seq, room - n)
            first, left = first + n, left - n
    return out, costs


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, linear: float = 1.0, quadratic: float = 1 / 512, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cost-balanced packing; a row for each piece of a document.

    A document is its ids and the end id 0. Pieces of seq_len tokens are cut off its start and fill a sequence
    each: no other place has a lower cost for them. The rests are gathered in blocks of about block_tokens tokens,
    and each block is packed by `assign`, with a cost of linear * n + quadratic * n * n for a piece of n tokens
    (attention stays within a piece). A block wastes less than one sequence of padding. Blocks are made within a
    task, so that no token is shuffled and memory is bounded by block_tokens; sequence_id is the task's number
    times 2**36 plus a counter. A retried task reads the same rows and gives the same pieces.

    A null text counts as empty: one end token. Repeated rows are packed each; an empty table gives no rows;
    other columns are not read. `cost` is the estimated cost of the piece's whole sequence.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        from quern.llm.encoding import borrowed

        sequence = TaskContext.get().partitionId() << 36
        full_cost = linear * seq_len + quadratic * seq_len * seq_len
        block: list[tuple] = []
        held = 0
        rows: tuple[list, ...] = tuple([] for _ in range(8))

        def crc(ids: bytes) -> int:
            return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())

        def row(*values) -> None:
            for column, v in zip(rows, values):
                column.append(v)

        def batch(id_type) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.float64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])
            for c in rows:
                c.clear()
            return out

        def flush() -> None:
            nonlocal sequence, held
            pieces, costs = assign([len(b[2]) // 2 for b in block], seq_len, linear, quadratic)
            for item, first, n, seq, offset in pieces:
                doc, start, ids, total = block[item]
                row(doc, start + first, n, crc(ids[2 * first : 2 * (first + n)]), total, sequence + seq, offset, costs[seq])
            sequence += len(costs)
            held = 0
            block.clear()

        id_type = pa.int64()
        with borrowed(tokenizer_path) as encoder:
            for b in batches:
                id_type = b.schema.types[0]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = encoder.encode(text.as_py()) + END
                    total = len(ids) // 2
                    start = 0
                    for start in range(seq_len, total + 1, seq_len):
                        row(doc, start - seq_len, seq_len, crc(ids[2 * (start - seq_len) : 2 * start]), total, sequence, 0, full_cost)
                        sequence += 1
                    if start < total:
                        block.append((doc, start, ids[2 * start :], total))
                        held += total - start
                        if held >= block_tokens:
                            flush()
                    if len(rows[0]) >= 20_000:
                        yield batch(id_type)
        if block:
            flush()
        if rows[0]:
            yield batch(id_type)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)
