"""Byte-level BPE encoding and decoding by monoid tree reduction.

A long text is halved until its parts are short; the halves are encoded on their
own and joined going up. A join re-encodes a window around the seam and grows it
until both its ends are fixed cuts (see ``ranks``) or ends of the node: the
tokens outside then are those of the whole text, since no match of the split
pattern reaches over such a cut. Decoding concatenates the halves' bytes.

Nulls are empty texts; rows keep their own id, also a null or a repeated one;
other columns of the input are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ranks import RankEncoder, cut_after, cut_before, encoder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF, WINDOW = 1 << 14, 64


def tokens_of(ids: list[int], size: int, enc: RankEncoder, tail: bool) -> int:
    """How many ids at the end (or the start) of ``ids`` make up ``size`` bytes."""
    n = total = 0
    lengths = enc.lengths
    while total < size:
        n += 1
        total += int(lengths[ids[-n] if tail else ids[n - 1]])
    if total != size:
        raise ValueError("a fixed cut is no boundary of a half")
    return n


def joined(text: str, seam: int, left: list[int], right: list[int], enc: RankEncoder) -> list[int]:
    """The ids of ``text`` from those of its parts before and after ``seam``."""
    width = WINDOW
    first = last = None
    while first is None or last is None:
        if first is None:
            first = cut_before(text, seam, max(0, seam - width))
        if last is None:
            last = cut_after(text, seam, min(len(text), seam + width))
        width *= 2
    if first == seam == last:
        return left + right
    drop = tokens_of(left, len(text[first:seam].encode()), enc, tail=True)
    skip = tokens_of(right, len(text[seam:last].encode()), enc, tail=False)
    return left[: len(left) - drop] + enc.encode(text[first:last]) + right[skip:]


def tree_encode(text: str, enc: RankEncoder, leaf: int = LEAF) -> list[int]:
    if len(text) <= leaf:
        return enc.encode(text)
    seam = len(text) // 2
    return joined(text, seam, tree_encode(text[:seam], enc, leaf), tree_encode(text[seam:], enc, leaf), enc)


def tree_decode(ids: list[int], enc: RankEncoder, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode(ids)
    seam = len(ids) // 2
    return tree_decode(ids[:seam], enc, leaf) + tree_decode(ids[seam:], enc, leaf)


def encode_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    leaf: int = LEAF,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            # few documents at a time, so that ids and bytes of a batch stay small
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                n, ids, decoded = [], [], []
                for text in part.column(1):
                    found = tree_encode(text.as_py() or "", enc, leaf)
                    n.append(len(found))
                    ids.append(np.asarray(found, "<u4").tobytes())
                    decoded.append(tree_decode(found, enc, leaf))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(decoded, pa.binary())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded binary")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
