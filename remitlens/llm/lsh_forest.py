"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every document's set of word shingles (64-bit hashes) gives ``TREES`` signatures
   of ``DEPTH`` values. Documents with the same set are one class; the smallest id
   speaks for it.
2. Each tree sorts the classes by its signature. A region is a run with a common
   prefix; its depth adapts: it starts at ``DEPTHS[0]`` values and deepens while the
   region holds more than ``MOST`` classes (beyond the last depth, it is dealt into
   blocks that share the region's first class). Neighbours in a region, those with
   the longest common prefix, are candidates.
3. Candidates join into groups. A group of at most ``MOST`` classes is checked as a
   whole, a larger one region by region: breadth-first from one class to those not
   reached yet, on the full sets. Only links that reach a new class are returned, so
   neither candidates nor links of a dense group are ever listed pair by pair.
4. Components of these links. Deepening parts classes, so a region that was too large
   at the first depth then has its largest component's classes and the others dealt
   into blocks; every block of the others is compared with every block. So all pairs
   that share ``DEPTHS[0]`` values in some tree are compared or known to be in one
   component, however large their region is.
5. Components of all links, back to all documents of each class.

Nulls and texts without words have an empty set and link with nothing. Ids should
be unique; rows that share an id share one class id, null ids get a null one. Other
columns are left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

from .common import table
from .components import connected_components

TREES, DEPTH, DEPTHS = 12, 16, (4, 6, 8, 12, 16)
MOST = 2048
BYTES = 4  # of a signature value
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HASHED: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    known = _HASHED
    if len(known) > 1 << 20:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode())
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle."""
    words = _WORDS.findall((text or "").translate(_UPPER))
    if not words:
        return np.empty(0, np.uint64)
    hashed = _word_hashes(words)
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
    return np.unique(total)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    n = TREES * DEPTH
    return (
        draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1),
        draw.integers(0, 1 << 32, n, np.uint32),
    )


def signatures(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Each permutation's smallest value, big-endian, so bytes sort as values."""
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(low), 512):
        part = low[start : start + 512, None] * times[None, :] + plus[None, :]
        least = np.minimum(least, part.min(axis=0))
    return least.astype(">u4")


def features(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` and the signatures of all trees in one binary."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        times, plus = _permutations()
        for batch in batches:
            n, keys, signed = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), size)
                n.append(len(own))
                keys.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                signed.append(signatures(own, times, plus).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "signed"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, n_shingles bigint, set_key binary, signed binary")


def regions(classes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``tree``, ``region`` (key of the adapted prefix), ``rep`` and ``path`` (the whole signature).

    Then ``tree``, ``region`` and ``rep`` of the regions that are too large at the first depth, if any.
    """
    width = BYTES * DEPTH
    rows = classes.select(
        "rep", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(signed, t * {width} + 1, {width}))"))
    ).toDF("rep", "tree", "path")
    done = crowded = None
    for depth in DEPTHS:
        key = rows.withColumn("region", F.substring("path", 1, BYTES * depth))
        sizes = key.groupBy("tree", "region").agg(F.count("*").alias("size"), F.min("rep").alias("first"))
        key = key.join(sizes.where("size > 1"), ["tree", "region"])
        fits = key.where(F.col("size") <= most) if depth != DEPTHS[-1] else key
        part = fits.select("tree", "region", "rep", "path", "size", "first")
        done = part if done is None else done.unionByName(part)
        if depth == DEPTHS[-1] or key.where(F.col("size") > most).isEmpty():
            break
        rows = cut_lineage(key.where(F.col("size") > most).select("rep", "tree", "path", "region"), "deeper")
        if depth == DEPTHS[0]:
            crowded = rows.select("tree", "region", "rep")
    blocks = F.ceil(F.col("size") / most)
    home = F.pmod(F.xxhash64("rep", "tree"), blocks)
    # the first class of a region that is still too large stands in each of its blocks
    at = F.when(blocks == 1, F.array(F.lit(0).cast("bigint"))).when(
        F.col("rep") == F.col("first"), F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    ).otherwise(F.array(home))
    placed = done.withColumn("at", F.explode(at)).select(
        "tree",
        F.concat("region", F.encode(F.concat(F.lit("/"), F.col("at").cast("string")), "UTF-8")).alias("region"),
        "rep",
        "path",
    )
    return placed, crowded


def open_pairs(crowded: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """``rep``, ``group``, ``main``: groups that hold every pair of a region not yet known to be in one component.

    The classes outside a region's largest component (``main``) are dealt into blocks, and so
    are those inside; each of the outer blocks meets every block. ``found`` has ``rep`` and
    ``component_id``. A region within one component has no group.
    """
    named = crowded.join(found, "rep", "left").withColumn("c", F.coalesce("component_id", "rep")).drop("component_id")
    counts = named.groupBy("tree", "region", "c").agg(F.count("*").alias("n"))
    counts = counts.groupBy("tree", "region").agg(F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("most"))
    counts = counts.where(F.col("size") > F.col("most.n")).select(
        "tree",
        "region",
        F.col("most.c").alias("main_c"),
        F.ceil((F.col("size") - F.col("most.n")) / most).alias("outer"),
        F.ceil(F.col("most.n") / most).alias("inner"),
    )
    rows = named.join(counts, ["tree", "region"]).withColumn("main", F.col("c") == F.col("main_c"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("rep", "tree"), F.when(F.col("main"), F.col("inner")).otherwise(F.col("outer"))))
    # pairs of outer blocks, and an outer with an inner block
    both = F.expr("transform(sequence(0L, outer - 1), k -> concat('o', least(home, k), '/', greatest(home, k)))")
    across = F.expr("transform(sequence(0L, inner - 1), k -> concat('m', home, '/', k))")
    inside = F.expr("transform(sequence(0L, outer - 1), k -> concat('m', k, '/', home))")
    rows = rows.withColumn("pair", F.explode(F.when(F.col("main"), inside).otherwise(F.concat(both, across))))
    name = F.encode(F.concat(F.lit("r"), F.col("tree").cast("string"), F.lit("/"), "pair", F.lit("/")), "UTF-8")
    return rows.select("rep", F.concat(name, "region").alias("group"), "main")


def linked_in_group(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that reach a new member, breadth-first; all pairs that may matter are compared."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * common >= percent * (sizes.sum() - common) else []
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(places, kind="stable")
    owners = owner[order]
    starts = np.searchsorted(places[order], np.arange(len(values) + 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    open_ = np.ones(n, bool)
    links = []
    left = n
    for seed in np.argsort(ids, kind="stable"):
        if not open_[seed]:
            continue
        open_[seed] = False
        left -= 1
        queue = deque([seed])
        while queue and left:
            i = queue.popleft()
            own = places[bounds[i] : bounds[i + 1]]
            hit = np.concatenate([owners[starts[p] : starts[p + 1]] for p in own])
            common = np.bincount(hit, minlength=n)
            near = np.flatnonzero(open_ & (100 * common >= percent * (sizes + sizes[i] - common)))
            open_[near] = False
            left -= len(near)
            queue.extend(near)
            links += [(int(ids[i]), int(ids[j])) for j in near]
    return links


def linked_to_main(ids: np.ndarray, sets: list[np.ndarray], main: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For each member outside ``main``, whose members are in one component, a link into it if it has any."""
    inner = np.flatnonzero(main)
    sizes = np.array([len(sets[i]) for i in inner], np.int64)
    values, places = np.unique(np.concatenate([sets[i] for i in inner]), return_inverse=True)
    order = np.argsort(places, kind="stable")
    owners = np.repeat(np.arange(len(inner)), sizes)[order]
    starts = np.searchsorted(places[order], np.arange(len(values) + 1))
    links = []
    for i in np.flatnonzero(~main):
        at = np.flatnonzero(np.isin(values, sets[i], assume_unique=True))
        if not len(at):
            continue
        common = np.bincount(np.concatenate([owners[starts[p] : starts[p + 1]] for p in at]), minlength=len(inner))
        near = np.flatnonzero(100 * common >= percent * (sizes + len(sets[i]) - common))
        if len(near):
            links.append((int(ids[i]), int(ids[inner[near[0]]])))
    return links


def confirmed(docs: DataFrame, groups: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``a``, ``b`` between the members of each group; ``groups`` has ``rep``, ``group`` and ``main``.

    Where a group has ``main`` members, known to be in one component, links from the others to them are sought.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    members = texts.join(groups, "rep").select("group", "rep", "main", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(own, pa.binary())], names=["group", "rep", "main", "own"]
            )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, mains, own):
            # rows that repeat an id are compared once
            first = {i: (m, s) for i, m, s in zip(ids, mains, own)}
            named, sets = np.array(list(first), np.int64), [s for _, s in first.values()]
            main = np.array([m for m, _ in first.values()], bool)
            return linked_to_main(named, sets, main, percent) if main.any() else linked_in_group(named, sets, percent)

        now, ids, mains, own, links = None, [], [], [], []
        for batch in batches:
            for group, rep, main, s in zip(*batch.columns):
                group = group.as_py()
                if group != now:
                    links += flush(ids, mains, own)
                    now, ids, mains, own = group, [], [], []
                ids.append(rep.as_py())
                mains.append(main.as_py())
                own.append(np.frombuffer(s.as_buffer(), np.uint64))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())],
                    names=["a", "b"],
                )
                links = []
        links += flush(ids, mains, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
        )

    hashed = members.mapInArrow(sets, "group binary, rep bigint, main boolean, own binary")
    return hashed.repartition("group").sortWithinPartitions("group").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    known = cut_lineage(features(docs, size, id_col, text_col), "sketches")
    named = known.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut_lineage(
        named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signed").alias("signed")), "classes"
    )
    placed, crowded = regions(classes, most)
    placed = cut_lineage(placed, "regions")
    along = Window.partitionBy("tree", "region").orderBy("path", "rep")
    neighbours = placed.select(F.col("rep").alias("a"), F.lead("rep").over(along).alias("b")).where("b is not null")
    joined = cut_lineage(connected_components(neighbours).withColumnRenamed("id", "rep"), "groups")
    sizes = joined.groupBy("component_id").agg(F.count("*").alias("n"))
    sized = joined.join(sizes, "component_id")
    small = sized.where(F.col("n") <= most).select(
        "rep", F.encode(F.concat(F.lit("c"), F.col("component_id").cast("string")), "UTF-8").alias("group")
    )
    large = placed.join(sized.where(F.col("n") > most).select("rep"), "rep").select(
        "rep", F.concat(F.encode(F.concat(F.lit("t"), F.col("tree").cast("string"), F.lit("/")), "UTF-8"), F.col("region")).alias("group")
    )
    groups = small.unionByName(large).withColumn("main", F.lit(False))
    found = connected_components(confirmed(docs, groups, size, percent, id_col, text_col)).withColumnRenamed("id", "rep")
    if crowded is not None:
        pairs = cut_lineage(open_pairs(crowded, found, most), "pairs")
        links = confirmed(docs, pairs, size, percent, id_col, text_col)
        known_links = found.select(F.col("rep").alias("a"), F.col("component_id").alias("b"))
        found = connected_components(known_links.unionByName(links)).withColumnRenamed("id", "rep")
    speak = classes.select("set_key", "rep").join(found, "rep", "left")
    speak = speak.select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    return (
        known.select("doc_id", "n_shingles", "set_key")
        .join(speak, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
