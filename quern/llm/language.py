"""Language of texts by compression with a raw dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
FINE_LEVEL = 19
#: The most languages that a model may have: their dictionaries are sent to every worker.
MAX_LANGUAGES = 400
#: A language's rows are first sampled in so many slices.
SLICES = 16


def train(docs: DataFrame, docs_per_lang: int = 400, chars_per_doc: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language: a window of chars_per_doc characters of at most docs_per_lang labelled texts, those with the lowest hash of their id.

    The window stands anywhere in its text, by another hash of the id; a shorter text is taken whole. The sample is
    bounded by its two parameters, whatever the size of the table. It is drawn in two levels, SLICES slices of a
    language and then the language, so that no task sorts all rows of a common one. Rows with a null label, or a
    null or empty text, teach nothing.
    """
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("text")]
    slice_, whole = Window.partitionBy("lang", "slice").orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length(text_col) - chars_per_doc, F.lit(0)) + 1) + 1
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col)).where(F.col("lang").isNotNull() & (F.col(text_col) != ""))
        .withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
        .select("id", "lang", F.substring(F.col(text_col), start.cast("int"), F.lit(chars_per_doc)).alias("text"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SLICES)).alias("slice"))
        .withColumn("k", F.row_number().over(slice_)).where(F.col("k") <= docs_per_lang)
        .withColumn("k", F.row_number().over(whole)).where(F.col("k") <= docs_per_lang)
        .select("lang", "k", "text").collect()
    )
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.k, r.text))
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the first of the sample stand last: zstandard prefers near matches
    return {lang: "\n".join(_plain(t) for _, t in sorted(own, reverse=True)).encode() for lang, own in sorted(by_lang.items())}


def _plain(text: str) -> str:
    return text.lower()


class Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, model: dict[str, bytes], level: int, block_chars: int):
        import zstandard

        self.langs = list(model)
        self.block = block_chars
        self.press = []
        for d in model.values():
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(d), source_size=4 * block_chars, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            raw.precompute_compress(compression_params=params)
            self.press.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params).compress)

    def of(self, text: str) -> list[int]:
        """Long texts go block by block: each sees the dictionary, not only what came before it in the text."""
        plain, n = _plain(text), self.block
        blocks = [plain[i : i + n].encode() for i in range(0, len(plain), n)]
        return [sum([len(press(b)) for b in blocks]) for press in self.press]


def classify(docs: DataFrame, model: dict[str, bytes], min_margin: float = 0.002, level: int = 6, block_chars: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row.

    The whole text, lower-cased, is compressed under each language's dictionary; the smallest size wins, the
    first language of the alphabet on a tie. score is the winner's margin over the second as a share of the
    second's size, 0 to 1 (1 where the model has one language). Where it is under min_margin, the text is
    compressed again at FINE_LEVEL, which finds matches of three bytes, and that margin decides. rejected: the margin is under min_margin, or the
    language is `und`: the text is null or empty, has no letter, or the model has no language. Rows are judged
    each by its own text; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    judged = judge(model, min_margin, level, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = judged()
        for b in batches:
            made = [one(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def judge(model: dict[str, bytes], min_margin: float, level: int, block_chars: int):
    """A maker, for the worker, of the function from a text to (language, score, rejected)."""

    def make():
        sizes = Sizes(model, level, block_chars)
        langs, again = sizes.langs, []

        def winner(n: list[int]) -> tuple[int, float]:
            best = min(range(len(n)), key=n.__getitem__)
            second = min((n[i] for i in range(len(n)) if i != best), default=None)
            return best, 1.0 if second is None else (second - n[best]) / second

        def one(text: str | None) -> tuple[str, float, bool]:
            if not text or not langs or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, True
            best, score = winner(sizes.of(text))
            if score < min_margin:
                if not again:
                    again.append(Sizes(model, FINE_LEVEL, block_chars))
                best, score = winner(again[0].of(text))
            return langs[best], score, score < min_margin

        return one

    return make


def accepted(docs: DataFrame, model: dict[str, bytes], min_margin: float = 0.002, level: int = 6, block_chars: int = 1024, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is not rejected. See classify."""
    judged = judge(model, min_margin, level, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = judged()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([not one(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> object:
    """The documents that the model must not learn from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
