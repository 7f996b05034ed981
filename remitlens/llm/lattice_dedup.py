"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected on eight random directions and
decoded to the nearest point of the E8 lattice, its home cell; it also probes the
``PROBES`` neighbouring cells that lie nearest. Two vectors meet where one's home is
the other's home or probe. In a cell, cosines come from blocks of a matrix product
in double precision, so every meeting is verified and no pair is ever a row: a cell
returns, per vector, how many links it found first (a pair that meets several times
counts where it meets first) and the edges of a spanning forest of its links.

The lattice is finer for larger labels, so that a cell holds as many strangers at
any size, and the number of tables follows from the share of vectors at the
threshold that miss each other (``tables_for``, measured on random pairs). A cell of
more than ``MOST`` rows is dealt into pairs of blocks, which together compare all.

Equal vectors of a label are one class that stands in for them, with its weight.
Vectors with a null label, or that are null, zero or hold null or non-finite
components, link with nothing. Vectors of different lengths never link. Ids should
be unique; other columns are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

from .common import table
from .components import connected_components

LEAST = 0.93
PROBES, SCALE, LABEL_ROWS, MISSED = 2, 1.7, 20_000, 0.003
MOST = 4096


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


NEIGHBOURS = _neighbours()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    r[rows, worst] += np.where(r.sum(axis=1) % 2 != 0, step, 0.0)
    return r


def decode(z: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even integer points and their shift by a half."""
    a, b = _nearest_even(z), _nearest_even(z - 0.5) + 0.5
    near = ((z - a) ** 2).sum(axis=1) <= ((z - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


@lru_cache(maxsize=64)
def _directions(dim: int, number: int) -> np.ndarray:
    """Eight orthonormal directions (fewer for shorter vectors, then zeros), one table's."""
    drawn = np.random.default_rng([dim, number]).normal(size=(dim, min(dim, 8)))
    out = np.zeros((dim, 8))
    out[:, : min(dim, 8)] = np.linalg.qr(drawn)[0]
    return out * math.sqrt(dim / 8)


def cells(units: np.ndarray, number: int, scale: float, probes: int) -> np.ndarray:
    """Lattice points (doubled, whole) of each row: its home, then the nearest neighbours."""
    z = units @ _directions(units.shape[1], number) * scale
    home = decode(z)
    order = np.argsort(-((z - home) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
    return np.rint(2 * np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[order]], axis=1)).astype(np.int64)


def tables_for(dim: int, least: float, scale: float, probes: int, missed: float = MISSED) -> int:
    """Tables after which at most ``missed`` of the pairs with just that cosine have not met."""
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(2, 4000, max(dim, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least * least) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = cells(x, 0, scale, probes), cells(y, 0, scale, probes)
    met = (a == b[:, :1]).all(axis=2).any(axis=1) | (b == a[:, :1]).all(axis=2).any(axis=1)
    miss = min(max(1 - met.mean(), 1e-3), 0.999)
    return max(2, math.ceil(math.log(missed) / math.log(miss)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _names(points: np.ndarray, labels: np.ndarray, dim: int, number: int) -> np.ndarray:
    """A 64-bit name of each cell within its label, length and table."""
    h = _mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(dim * 1009 + number * 7919 + 1))
    h = np.repeat(h[:, None], points.shape[1], axis=1)
    for k in range(8):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + points[:, :, k].view(np.uint64) + np.uint64(1 << 20))
    return h


def link_counts(
    vectors: np.ndarray, homes: np.ndarray, probes: np.ndarray, here: int, cell: np.uint64,
    weights: np.ndarray, ranks: np.ndarray, sides: np.ndarray | None, least: float,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links found first in this cell, by weight, and spanning edges (row numbers) of all its links.

    Where ``sides`` are given, only rows of different sides are compared.
    """
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    edges = []
    own = homes[:, here] == cell
    for a in range(0, n, 512):
        for b in range(a, n, 512):
            cos = vectors[a : a + 512] @ vectors[b : b + 512].T / np.outer(norms[a : a + 512], norms[b : b + 512])
            i, j = np.nonzero(cos >= least)
            i, j = i + a, j + b
            fine = (i < j) & (own[i] | own[j])
            if sides is not None:
                fine &= sides[i] != sides[j]
            i, j = i[fine], j[fine]
            if not len(i):
                continue
            edges.append((i, j))
            for s in range(0, len(i), 20_000):
                x, y = i[s : s + 20_000], j[s : s + 20_000]
                hx, hy = homes[x], homes[y]
                same = hx == hy
                x_in_y = (probes[y] == hx[:, :, None]).any(axis=2)
                y_in_x = (probes[x] == hy[:, :, None]).any(axis=2)
                met = same | x_in_y | y_in_x
                first = ~met[:, :here].any(axis=1)
                # within a table: the common home, else the home of the smaller id that the other probes
                small_first = ranks[x] < ranks[y]
                at_small = np.where(small_first, x_in_y[:, here], y_in_x[:, here])
                home_small = np.where(small_first, hx[:, here], hy[:, here])
                home_large = np.where(small_first, hy[:, here], hx[:, here])
                due = np.where(same[:, here] | at_small, home_small, home_large)
                first &= due == cell
                np.add.at(counts, x[first], weights[y[first]])
                np.add.at(counts, y[first], weights[x[first]])
    if edges:
        i, j = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while True:  # smallest row number reachable
            least_root = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, least_root)
            np.minimum.at(new, j, least_root)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return counts, [(int(r), k) for k, r in enumerate(root) if r != k]


def near_vectors(
    rows: DataFrame,
    least: float = LEAST,
    probes: int = PROBES,
    scale: float = SCALE,
    label_rows: int = LABEL_ROWS,
    missed: float = MISSED,
    most: int = MOST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    known = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<float>").alias("v"),
    )
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.when(usable, F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join("v", ","))))
    known = known.withColumn("key", key)
    classes = cut_lineage(
        known.where("key is not null")
        .groupBy("key")
        .agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")
        ),
        "vectors",
    )
    largest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))
    largest = largest.agg(F.max("n"), F.max("dim")).first()
    scale = scale * max(1.0, (largest[0] or 1) / label_rows) ** 0.125
    n_tables = tables_for(min(largest[1] or 8, 256), least, scale, probes, missed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            reps, weights, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "weight", "label"))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for s in range(0, len(at), 1000):
                    some = at[s : s + 1000]
                    v = np.stack([flat[starts[i] : starts[i + 1]] for i in some])
                    units = v.astype(np.float64)
                    units /= np.linalg.norm(units, axis=1, keepdims=True)
                    named = np.stack(
                        [_names(cells(units, t, scale, probes), labels[some], dim, t) for t in range(n_tables)], axis=1
                    )
                    every = 1 + probes
                    raw, all_cells = [x.tobytes() for x in v], [x.tobytes() for x in named]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(named.reshape(-1).view(np.int64)),
                            pa.array(np.tile(np.repeat(np.arange(n_tables, dtype=np.int32), every), len(some))),
                            pa.array(np.repeat(reps[some], n_tables * every)),
                            pa.array(np.repeat(weights[some], n_tables * every)),
                            pa.array([x for x in raw for _ in range(n_tables * every)], pa.binary()),
                            pa.array([x for x in all_cells for _ in range(n_tables * every)], pa.binary()),
                        ],
                        names=["cell", "number", "rep", "weight", "v", "cells"],
                    )

    placed = classes.select("rep", "weight", "label", "v").mapInArrow(
        place, "cell bigint, number int, rep bigint, weight bigint, v binary, cells binary"
    )
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
    crowded = cut_lineage(crowded.select("cell", F.ceil(F.col("n") / most).alias("blocks")), "crowded")
    dealt = placed.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "cell", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "number", "rep", "weight", "v", "cells"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            if len(held) < 2:
                return []
            vectors = np.stack([np.frombuffer(h[7], np.float32) for h in held]).astype(np.float64)
            named = np.stack([np.frombuffer(h[8], np.uint64) for h in held]).reshape(len(held), n_tables, 1 + probes)
            name = np.array([held[0][0]], np.int64).view(np.uint64)[0]
            ids = np.array([h[5] for h in held], np.int64)
            sides = None if held[0][1] == held[0][2] else np.array([h[3] for h in held], np.int64)
            weights = np.array([h[6] for h in held], np.int64)
            counts, edges = link_counts(
                vectors, named[:, :, 0], named[:, :, 1:], held[0][4], name, weights, ids, sides, least
            )
            found = [(int(ids[k]), None, int(counts[k])) for k in np.flatnonzero(counts)]
            return found + [(int(ids[x]), int(ids[y]), 0) for x, y in edges]

        def batch_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "n"]
            )

        held, found = [], []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(9)]):
                if held and held[0][:3] != row[:3]:
                    found += flush(held)
                    held = []
                held.append(row)
            if found:
                yield batch_of(found)
                found = []
        yield batch_of(found + flush(held))

    keys = ["cell", "a", "b"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a bigint, b bigint, n bigint")
    found = cut_lineage(found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b is not null")).withColumnRenamed("id", "rep")
    told = (
        classes.select("key", "rep", "weight")
        .join(counts, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    return (
        known.select("vec_id", "key")
        .join(told, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
