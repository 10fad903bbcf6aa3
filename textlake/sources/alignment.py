"""Stand-off annotations joined to tokens by their places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_WORDS = re.compile("[^ \t\n\r\f]+")
#: Characters of texts whose words are held at a time.
SLICE = 1 << 18


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their places; a longer text alone fills a slice, and its words leave in several."""
    rows: list[int] = []
    found: tuple[list, ...] = ([], [], [], [])

    def taken(ids: pa.Array) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
        out = pa.record_batch([ids.take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], ["doc_id", "tok_ix", "word", "beg", "end"])
        for c in (rows, *found):
            c.clear()
        return out

    for batch in batches:
        ids, texts, size = batch.column(0), batch.column(1), 0
        for r in range(batch.num_rows):
            text = texts[r].as_py()
            if text is None:
                continue
            size += len(text)
            for i, m in enumerate(_WORDS.finditer(text)):
                rows.append(r)
                for c, x in zip(found, (i, m.group(), *m.span()), strict=True):
                    c.append(x)
                if len(rows) >= SLICE // 4:
                    yield taken(ids)
            if size >= SLICE:
                yield taken(ids)
                size = 0
        if rows:
            yield taken(ids)


def placed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, tok_ix, word, beg and end of white-space words. Places are running sums, which
    array expressions take square time for and a window a shuffle; the kernel needs neither."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(_places, f"doc_id {kind}, tok_ix int, word string, beg int, end int")


def aligned(tokens: DataFrame, marks: DataFrame, stretch: int = 64) -> DataFrame:
    """Tokens that lie within a mark, with its cat: an interval join in buckets of ``stretch``
    characters, so that it is an equality join and no document is compared with itself."""
    first, last = F.floor(F.col("beg") / stretch), F.floor((F.greatest("end", F.col("beg") + 1) - 1) / stretch)
    spread = marks.select("doc_id", F.col("beg").alias("m_beg"), F.col("end").alias("m_end"), "cat", F.explode(F.sequence(first, last)).alias("bucket"))
    inside = (F.col("beg") >= F.col("m_beg")) & (F.col("end") <= F.col("m_end"))
    return tokens.withColumn("bucket", first).join(spread, ["doc_id", "bucket"]).where(inside).drop("bucket", "m_beg", "m_end")
