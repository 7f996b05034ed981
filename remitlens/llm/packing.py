"""Packing of token ids into rows of fixed length: best fit decreasing.

Each task encodes its documents, appends an end-of-text id, splits what is longer
than a row into pieces (no id is lost) and packs the pieces block by block: a
block holds at most ``block_tokens`` ids, so memory is bounded however large the
partition is. Pieces go by falling length into the row with the least room that
still holds them; a segment tree over the room left finds it in log steps. No
shuffle is needed, and no group is ever gathered.

A packed row has ``ids`` (little-endian unsigned 32-bit, padded with the
end-of-text id to the row length), ``seq_lengths`` (cumulative segment ends,
starting with 0), ``position_ids`` (little-endian unsigned 32-bit, back to 0 at
each segment and over the padding) and, for each segment, its ``doc_ids``,
``pieces`` (number of the piece in its document) and length.

A null text is an empty one, which is its end-of-text id alone. Repeated rows and
null ids are packed like any other; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ranks import encoder
from .token_counts import spliced_ids

VOCABULARY, END = "byte_bpe_50k.tiktoken", 50256
ROW, BLOCK = 2048, 1 << 23

SCHEMA = (
    "pack_id string, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, "
    "seq_lengths array<int>, ids binary, position_ids binary"
)


class RoomTree:
    """Rows by the room they have left: a segment tree over the rooms 0..capacity.

    A leaf holds the rows with just that room, an inner node how many rows lie
    below it, so the smallest room of at least ``need`` is found going down.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room that is at least ``need``, and its room."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return row, room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; no row is longer than ``capacity``."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            rows.append([i])
            tree.add(capacity - lengths[i], len(rows) - 1)
        else:
            row, room = found
            rows[row].append(i)
            tree.add(room - lengths[i], row)
    return rows


def packed_rows(pieces: list[tuple[object, int, np.ndarray]], row: int, end: int) -> Iterator[dict]:
    for members in best_fit([len(p[2]) for p in pieces], row):
        parts = [pieces[i] for i in members]
        sizes = [len(p[2]) for p in parts]
        ids, places = np.full(row, end, "<u4"), np.zeros(row, "<u4")
        ends = [0, *np.cumsum(sizes).tolist()]
        for (_, _, own), a, b in zip(parts, ends, ends[1:]):
            ids[a:b] = own
            places[a:b] = np.arange(b - a)
        matrix = ids.tobytes()
        yield {
            "pack_id": hashlib.sha256(repr([p[:2] for p in parts]).encode() + matrix).hexdigest(),
            "n_tokens": ends[-1],
            "n_segments": len(parts),
            "doc_ids": [p[0] for p in parts],
            "pieces": [p[1] for p in parts],
            "seq_lengths": ends,
            "ids": matrix,
            "position_ids": places.tobytes(),
        }


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    row: int = ROW,
    end: int = END,
    block_tokens: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per packed row of ``row`` ids; see the module for the columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        schema = pa.schema(
            [
                ("pack_id", pa.string()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()),
                ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
                ("seq_lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary()),
            ]
        )

        def flushed(pieces):
            some = []
            for made in packed_rows(pieces, row, end):
                some.append(made)
                if len(some) == 256:
                    yield pa.RecordBatch.from_pylist(some, schema)
                    some = []
            if some:
                yield pa.RecordBatch.from_pylist(some, schema)

        pieces, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*spliced_ids(text.as_py() or "", enc), end], "<u4")
                for k, start in enumerate(range(0, len(ids), row)):
                    pieces.append((key, k, ids[start : start + row]))
                held += len(ids)
                if held >= block_tokens:
                    yield from flushed(pieces)
                    pieces, held = [], 0
        yield from flushed(pieces)

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(pack, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet at ``path``, in any store that Spark writes to."""
    packed.write.mode("overwrite").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed id matrix itself, row by row."""
    return pack_documents(table(spark, sf_dir, "documents"))
