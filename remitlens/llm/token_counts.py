"""Token counts with overlap resynchronisation.

A long text is encoded in chunks that overlap. In each overlap a fixed cut (see
``ranks``) is a token boundary of both chunks, and no text beyond the chunks can
move it, so the left chunk counts up to it and the right one from it on. Where an
overlap holds no such cut, it is widened, at most to the end of the text.

Nulls count as empty texts (0 tokens); rows keep their own id, also a null or a
repeated one; other columns of the input are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ranks import RankEncoder, encoder, fixed_cut

#: The rank file of the same vocabulary as byte_bpe_50k.json, with its special token.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIALS = (("<|endoftext|>", 50256),)
CHUNK, OVERLAP, LIMIT = 1 << 15, 256, 512


def spliced_ids(text: str, enc: RankEncoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of ``text``, encoded chunk by chunk and spliced at common boundaries."""
    if len(text) <= chunk + overlap:
        return enc.encode(text)
    ids: list[int] = []
    start = 0  # always a fixed cut
    while True:
        step, width = start + chunk, overlap
        if step + width >= len(text):
            return ids + enc.encode(text[start:])
        while True:
            right = min(len(text), step + width)
            splice = next(
                (q for q in range(step, right + 1) if fixed_cut(text, q) and not enc.inside_special(text, q)),
                None,
            )
            if splice is not None:
                break
            width *= 2
        left = enc.encode(text[start:right])
        # the tokens of the left chunk that end at the splice
        ends = np.cumsum(enc.lengths[left])
        size = len(text[start:splice].encode())
        n = int(np.searchsorted(ends, size)) + 1
        if ends[n - 1] != size:
            raise ValueError("a fixed cut is no boundary of the left chunk")
        ids += left[:n]
        if splice >= len(text):
            return ids
        start = splice


def count_tokens(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    specials: tuple[tuple[str, int], ...] = SPECIALS,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns id, ``n_bytes`` and ``n_tokens`` for every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, specials)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(len(spliced_ids(text, enc, chunk, overlap)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
