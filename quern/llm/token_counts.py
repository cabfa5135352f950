"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_batches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer text has a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(docs: DataFrame, tokenizer_path: str, context: int = 4096, batch_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: counts as the tokenizer's library gives them, no special tokens added.

    tokenizer_path names a .json file of tokenizers or a .model file of sentencepiece. Rows go to the library in
    batches of about batch_bytes, each text cut at safe boundaries (see encoding); only lengths leave the Python
    worker, and nothing is shuffled. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted
    each; an empty table gives no rows; other columns are not read.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quern.llm.encoding import loaded

        encoder = loaded(tokenizer_path)
        for b in batches:
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).cast(pa.int64())
            n_tokens: list[int] = []
            for i, j in byte_batches(n_bytes.to_pylist(), batch_bytes):
                n_tokens += encoder.counts(b.column(1).slice(i, j - i).to_pylist())
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n, pa.compute.greater(n, context)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
