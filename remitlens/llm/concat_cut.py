"""Packing by concatenating and cutting.

All documents, in the order of their ids, are one long run of token ids, cut into
windows of ``row`` ids. The first pass deals documents into ranges of that order and
encodes them there, noting how many ids precede each in its range; prefix sums over
the ranges' totals then give every document its global offset. The second pass reads
the stored ids in order and cuts windows. A window that a reader does not see as a
whole (it spans ranges, or the files of a range were split) leaves as boundary
records, which ``sequences`` puts together; a record holds whole pieces, since a
document is never split between readers.

The order is that of the data (id, null first, then a hash of the text), so the result
does not depend on how Spark splits its input. Only the last window can be short: it is
padded with ``pad`` to ``row`` ids unless its length is a power of two.

A null text is an empty one: its end id alone. Repeated rows are documents of their
own. Other columns are left out; no rows give no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remitlens.session import cut_lineage

from .common import table
from .ordered import ROW_BITS, totals_before
from .words import word_encoder

VOCABULARY, END, ROW = "word_bpe_49k.json", 1, 2048
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 22
#: Ranges up to which their totals (16 bytes each) are sent to every executor.
SENT_RANGES = 100_000


def _stored(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough, else four; the first byte says which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def _loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def _runs_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``TOGETHER`` bytes, or one longer row."""
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > TOGETHER:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(
    docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """First pass: stored ``doc_id``, ``ids``, ``n``, ``part`` and ``before`` (ids of the range before the document)."""
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = word_encoder(vocabulary, end), 0
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.binary_length(texts).fill_null(0).to_numpy()
            for start, stop in _runs_of(sizes):
                ids, ends = enc.encode_all(texts.slice(start, stop - start))
                starts = np.append(0, ends[:-1])
                stored = [_stored(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start).cast(id_type), pa.array(stored, pa.binary()),
                     pa.array(ends - starts), pa.array(before + starts)],
                    names=["doc_id", "ids", "n", "before"],
                )
                before += int(ends[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal rows are told apart by where they were read, so that many copies spread
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("read_at", F.monotonically_increasing_id())
    by = [F.asc_nulls_first("doc_id"), F.col("tie"), F.col("read_at")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    made = rows.mapInArrow(encode, f"doc_id {kind.simpleString()}, ids binary, n bigint, before bigint")
    return cut_lineage(made.withColumn("part", F.shiftright(F.monotonically_increasing_id(), ROW_BITS)), "encoded")


def _offsets(stored: DataFrame) -> DataFrame:
    """Adds ``at``, the global offset of each document."""
    totals = totals_before(stored.select("part", "n"), "part", "n")
    totals = cut_lineage(totals.select(F.col("part").alias("of_part"), F.col("before_n").alias("base")), "totals")
    if totals.count() <= SENT_RANGES:
        totals = F.broadcast(totals)
    return stored.join(totals, F.col("part") == F.col("of_part")).select(
        "doc_id", "ids", (F.col("base") + F.col("before")).alias("at")
    )


def records(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    end: int = END,
    row: int = ROW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Second pass: windows and boundary records.

    Columns ``sequence_id``, ``offset`` (of the record in its window), ``length``, ``ids``
    (little-endian unsigned 32-bit) and ``pieces``: id, ``start`` (the document's ids
    before the piece), ``length``, ``ids_crc32``, ``doc_tokens`` and ``offset`` in the window.
    """
    stored = encoded(docs, vocabulary, end, id_col, text_col)
    kind = docs.schema[id_col].dataType
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "offset"]
    piece = pa.struct([("doc_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in numbers]])
    arrow = pa.schema(
        [("sequence_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
         ("pieces", pa.list_(piece))]
    )
    schema = (
        "sequence_id bigint, offset bigint, length bigint, ids binary, "
        f"pieces array<struct<doc_id: {kind.simpleString()}, {', '.join(f'{c}: bigint' for c in numbers)}>>"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        parts: list[bytes] = []
        pieces: list[dict] = []
        first = at = 0  # global offsets of the record's first id and of what follows it

        def close() -> None:
            if pieces:
                made.append(
                    {
                        "sequence_id": first // row,
                        "offset": first % row,
                        "length": at - first,
                        "ids": b"".join(parts),
                        "pieces": list(pieces),
                    }
                )
                parts.clear()
                pieces.clear()

        for batch in batches:
            for key, data, begin in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = _loaded(data.as_py()).astype("<u4")
                if begin != at or begin % row == 0:
                    close()
                    first = at = begin
                start = 0
                while start < len(ids):
                    if start and at % row == 0:
                        close()
                        first = at
                    size = min(row - at % row, len(ids) - start)
                    own = ids[start : start + size].tobytes()
                    parts.append(own)
                    pieces.append(
                        {
                            "doc_id": key,
                            "start": start,
                            "length": size,
                            "ids_crc32": crc32(own),
                            "doc_tokens": len(ids),
                            "offset": at % row,
                        }
                    )
                    start += size
                    at += size
                if len(made) >= 256:
                    yield pa.RecordBatch.from_pylist(made, arrow)
                    made = []
        close()
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return _offsets(stored).mapInArrow(cut, schema)


def sequences(cut: DataFrame, row: int = ROW, pad: int = END) -> DataFrame:
    """Whole windows from ``records``: ``sequence_id``, ``length``, ``ids`` (padded), ``pieces`` and
    ``seq_lengths`` (cumulative, from 0).

    Boundary records of a window, of at most ``row`` ids in all, are gathered and joined.
    """
    cut = cut_lineage(cut, "records")
    whole = (F.col("offset") == 0) & (F.col("length") == row)
    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "pieces")))
    joined = cut.where(~whole).groupBy("sequence_id").agg(listed.alias("parts"))
    joined = joined.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
        F.flatten("parts.pieces").alias("pieces"),
    )
    every = cut.where(whole).select("sequence_id", "length", "ids", "pieces").unionByName(joined)
    power = F.bitwise_not(F.lit(0).cast("bigint")) + F.col("length")
    full = F.when(F.col("length").bitwiseAND(power) == 0, F.col("length")).otherwise(F.lit(row))
    filler = F.expr(f"unhex(repeat('{pad.to_bytes(4, 'little').hex()}', cast({row} as int)))")
    ids = F.concat("ids", filler).substr(F.lit(1), (4 * full).cast("int"))
    ends = F.transform("pieces", lambda p: p["offset"] + p["length"])
    return every.select(
        "sequence_id", "length", ids.alias("ids"), "pieces",
        F.concat(F.array(F.lit(0).cast("bigint")), ends).alias("seq_lengths"),
    )


def op12_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all records."""
    cut = records(table(spark, sf_dir, "documents"))
    piece = cut.select("sequence_id", F.explode("pieces").alias("p"))
    return piece.select(
        "p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset"
    )
