"""Prefix trie of a conversation log, as balanced parentheses in shards.

A node is a distinct sequence of first turns; its members are the conversations that
start with it, its name is the smallest of them and its depth. On the path of a
conversation the smallest member only changes where the path leaves that of a smaller
conversation, so a path is a short chain of such changes. Ordered by chain and depth
the nodes stand in preorder: a change at a smaller depth comes later, at the same depth the
smaller member comes first. No conversation is gathered in one row, and neither are
the members of a node.

The preorder is cut into shards of about the root of the number of nodes. A shard
writes its nodes as parentheses, ``(`` for a node and then one ``)`` for each subtree
that ends before the next node, with the excess (open less closed) after each. Blocks of
``BLOCK`` parentheses keep their minimal excess, a tree over the blocks the minima of
its halves; ``findclose`` looks for the first place with the excess before the node, in the
block, up and down the tree and in the block found. The nodes between the two places
are the subtree: a cumulative count of ``()`` pairs gives its childless nodes, a cumulative
sum its savings. Nodes that a shard leaves open are its right spine, parentheses
that close nodes of earlier shards its left spine; at one excess these alternate, so
the next closing one in the order of shards ends a spine node, and the totals of the shards
between are a difference of prefix sums.

Turns go by number (null first), equal numbers by a digest of role and text; a
null role or text equals an empty one. Rows that repeat are turns of their own. Rows with a null
conversation id belong to no conversation and are left out, other columns too; an
empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.session import cut_lineage

from .common import crc32_sql, table
from .ordered import places, ranged, totals_before

#: Parentheses of a block, nodes of a shard at least, and turns of a conversation hashed in one window.
BLOCK, LEAST_SHARD, WINDOW = 64, 1024, 4096
#: Ids written into one chunk of the list that is hashed.
CHUNK = 4096


def numbered(turns: DataFrame) -> DataFrame:
    """Stored ``conv_id``, ``content`` (digest of role and text), ``size`` (bytes of the text), ``pos`` and ``n``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", content.alias("content"), F.octet_length(text).cast("bigint").alias("size")
    )
    rows = cut_lineage(rows, "turns")
    return cut_lineage(places(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("content")], "ordered").drop("turn"), "numbered")


def rebuilt(rows: DataFrame, every: int = 5, head: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the one they branched from: (``conv_id``, ``length``) and
    (``conv_id``, ``depth``, ``content``, ``size``).

    Conversation c takes its first ``head`` turns (at most 8) from c - c % ``every``.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % 9 if head is None else head
    convs = rows.where("pos = 0").select("conv_id", "n")
    convs = convs.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    known = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut_lineage(
        convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "convs",
    )
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "content", "size")
    first = rows.where("pos < 8").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base")
    first = first.where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "content", "size")
    return convs.select("conv_id", "length"), own.unionByName(first)


def named_prefixes(paths: DataFrame) -> DataFrame:
    """Stored ``conv_id``, ``depth``, ``size`` and the name of the prefix that ends there (192 bits).

    A name is the XOR of hashes of place and content, so windows of a long conversation
    are hashed apart and joined by the XOR of those before.
    """
    lanes = {
        "k1": F.xxhash64("content", "depth"),
        "k2": F.xxhash64(F.lit(1), "depth", "content"),
        "k3": F.xxhash64(F.lit(2), "content", "depth"),
    }
    rows = paths.withColumn("window", F.expr(f"(depth - 1) div {WINDOW}"))
    rows = cut_lineage(rows.select("conv_id", "window", "depth", "size", *[c.alias(k) for k, c in lanes.items()]), "lanes")
    totals = rows.groupBy("conv_id", "window").agg(*[F.bit_xor(k).alias(k) for k in lanes])
    before = Window.partitionBy("conv_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "window", *[F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(f"b_{k}") for k in lanes])
    running = Window.partitionBy("conv_id", "window").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, ["conv_id", "window"])
    return cut_lineage(
        rows.select(
            "conv_id", "depth", "size",
            *[F.bit_xor(k).over(running).bitwiseXOR(F.col(f"b_{k}")).alias(k) for k in lanes],
        ),
        "named",
    )


def preorder(convs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored nodes (``pos``, ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``saved``) and the
    ends of the conversations (``conv_id``, ``depth`` of the node, ``member``)."""
    key = ["depth", "k1", "k2", "k3"]
    nodes = named.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.min("size").alias("size")
    )
    nodes = cut_lineage(nodes, "nodes")
    least = convs.agg(F.min("conv_id")).scalar()
    owned = named.select("conv_id", *key).join(nodes.select(*key, "owner"), key).select("conv_id", "depth", "owner")
    at_root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), least.alias("owner"))
    runs = owned.unionByName(at_root).groupBy("conv_id", "owner").agg(F.min("depth").alias("start"), F.max("depth").alias("stop"))
    runs = cut_lineage(runs, "runs")

    # the chain of changes of every conversation that owns nodes; its own run is the last one
    own = F.col("owner") == F.col("conv_id")
    chains = runs.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("start")).alias("back"), "owner")), asc=False).alias("chain"),
        F.max(F.when(own, F.col("start"))).alias("start"),
        F.max(F.when(own, F.col("stop"))).alias("stop"),
        F.max_by(F.when(~own, F.col("owner")), F.when(~own, F.col("start"))).alias("parent"),
    )
    chains = cut_lineage(chains.where("start is not null").withColumn("held", F.col("stop") - F.col("start") + 1), "chains")
    sorted_ = ranged(chains, [F.col("chain")], "chains-sorted")
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals_before(sorted_.select("part", "held"), "part", "held")
    owners = sorted_.withColumn("run", F.coalesce(F.sum("held").over(within), F.lit(0))).join(offsets, "part")
    owners = owners.select(
        F.col("conv_id").alias("owner"), "start", "parent", (F.col("run") + F.col("before_held") - F.col("start")).alias("shift")
    )
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.lit(0).cast("bigint").alias("size"))
    root = root.where("owner is not null").withColumn("depth", F.lit(0).cast("bigint"))
    every = nodes.select("depth", "n_convs", "owner", "size").unionByName(root.select("depth", "n_convs", "owner", "size"))
    every = every.join(owners, "owner").select(
        (F.col("shift") + F.col("depth")).alias("pos"),
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("owner")).alias("parent_conv_id"),
        "n_convs",
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    ends = runs.groupBy("conv_id").agg(F.max_by("owner", "stop").alias("owner"), F.max("stop").alias("depth"))
    ends = ends.select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    return cut_lineage(every, "preorder"), ends


class Parentheses:
    """Nodes in preorder by their depths, as parentheses with block minima of the excess.

    ``after`` is the depth of the node that follows the last one, -1 at the end of all.
    """

    def __init__(self, depths: np.ndarray, after: int, block: int = BLOCK):
        m = len(depths)
        closes = depths - np.append(depths[1:], after) + 1
        self.opens = np.arange(m) + np.cumsum(closes) - closes  # places of the opening parentheses
        signs = np.full(int(m + closes.sum()), -1, np.int64)
        signs[self.opens] = 1
        self.depths, self.childless = depths, closes > 0
        self.excess = int(depths[0]) + np.cumsum(signs)
        self.rank = np.cumsum(signs > 0)  # nodes opened up to and with a place
        self.block = block
        n_blocks = -(-len(signs) // block)
        padded = np.full(n_blocks * block, np.iinfo(np.int64).max)
        padded[: len(signs)] = self.excess
        self.padded = padded
        self.leaves = 1 << max(0, (n_blocks - 1).bit_length())
        self.minima = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.minima[self.leaves : self.leaves + n_blocks] = padded.reshape(n_blocks, block).min(axis=1)
        level = self.leaves
        while level > 1:
            half = level // 2
            self.minima[half:level] = self.minima[level : 2 * level].reshape(half, 2).min(axis=1)
            level = half

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from ``at`` to the end of its block with an excess of at most ``goal``; -1 if none."""
        found = np.full(len(at), -1)
        left, place = np.arange(len(at)), at.copy()
        while len(left):
            hit = self.padded[place] <= goal[left]
            found[left[hit]] = place[hit]
            place = place + 1
            stay = ~hit & (place % self.block != 0)
            left, place = left[stay], place[stay]
        return found

    def first_at_most(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place after ``at`` with an excess of at most ``goal``; -1 if the shard has none."""
        start = at + 1
        inner = start % self.block != 0
        found = np.full(len(at), -1)
        found[inner] = self._scan(start[inner], goal[inner])
        left = np.flatnonzero(found < 0)
        node, goals = self.leaves + at[left] // self.block, goal[left]
        # up, until the half to the right holds a small enough minimum
        target = np.zeros(len(left), np.int64)
        open_ = np.arange(len(left))
        while len(open_):
            up = node[open_]
            right = (up % 2 == 0) & (up > 1)
            hit = right & (self.minima[np.minimum(up + 1, 2 * self.leaves - 1)] <= goals[open_])
            target[open_[hit]] = up[hit] + 1
            open_ = open_[~hit & (up > 1)]
            node[open_] //= 2
        # down, to the first block that holds one
        some = np.flatnonzero(target)
        at_node = target[some]
        while True:
            inside = at_node < self.leaves
            if not inside.any():
                break
            down = at_node[inside] * 2
            at_node[inside] = down + (self.minima[down] > goals[some][inside])
        found[left[some]] = self._scan((at_node - self.leaves) * self.block, goals[some])
        return found

    def findclose(self) -> np.ndarray:
        """Per node the place of its closing parenthesis; -1 for the right spine."""
        return self.first_at_most(self.opens, self.depths)

    def foreign_closes(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths of nodes of earlier shards that end here, and the places where they do."""
        lowest = np.minimum.accumulate(self.excess)
        at = np.flatnonzero((lowest < np.append(self.depths[0], lowest[:-1])) & (lowest < self.depths[0]))
        return self.excess[at], at


def subtree_sums(nodes: DataFrame, shard: int | None = None, block: int = BLOCK) -> DataFrame:
    """Nodes of ``preorder`` with ``n_leaves`` and ``saved_tokens`` of their subtrees.

    ``shard``: nodes of a shard, the root of their number if not given.
    """
    if shard is None:
        shard = max(LEAST_SHARD, isqrt(nodes.count()))
    rows = nodes.withColumn("shard", F.expr(f"pos div {shard}"))
    # the first node of a shard closes the shard before it
    peek = rows.where((F.col("pos") % shard == 0) & (F.col("pos") > 0)).withColumn("shard", F.col("shard") - 1)
    dealt = rows.unionByName(peek).repartition("shard").sortWithinPartitions("shard", "pos")
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs"]
    names = ["kind", "shard", "level", "leaves", "saved", *kept]
    columns = ["pos", *kept, "saved", "shard"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, table_ in _runs(batches, columns):
            col = {c: table_[c] for c in columns}
            inside = col["pos"] // shard == at
            after = int(col["depth"][~inside][0]) if not inside.all() else -1
            col = {c: v[inside] for c, v in col.items()}
            m = len(col["pos"])
            trie = Parentheses(col["depth"], after, block)
            leaves = np.append(0, np.cumsum(trie.childless))
            saved = np.append(0, np.cumsum(col["saved"]))
            close = trie.findclose()
            last = np.where(close < 0, m, trie.rank[close])
            levels, places_ = trie.foreign_closes()
            till = trie.rank[places_]
            first = np.arange(m)
            none = np.full(len(levels) + 1, -1)
            out = {
                # 0 a whole subtree, 1 a node of the right spine, 2 the end of one of the left spine, 3 totals
                "kind": np.concatenate([(close < 0).astype(np.int64), np.full(len(levels), 2), [3]]),
                "shard": np.full(m + len(levels) + 1, at),
                "level": np.concatenate([col["depth"], levels, [-1]]),
                "leaves": np.concatenate([leaves[last] - leaves[first], leaves[till], [leaves[m]]]),
                "saved": np.concatenate([saved[last] - saved[first], saved[till], [saved[m]]]),
                **{c: np.concatenate([col[c], none]) for c in kept},
            }
            yield pa.RecordBatch.from_arrays([pa.array(out[c].astype(np.int64)) for c in names], names=names)

    # the parent of the root is null; -1 stands for it in the arrays, its depth of 0 tells it
    solved = dealt.select("pos", *kept, "saved", "shard").na.fill(-1, ["parent_conv_id"])
    solved = cut_lineage(solved.mapInArrow(solve, ", ".join(f"{c} bigint" for c in names)), "shards")
    totals = solved.where("kind = 3").select("shard", "leaves", "saved")
    before = cut_lineage(totals_before(totals, "shard", "leaves", "saved"), "before")
    spine = solved.where("kind in (1, 2)").join(before, "shard")
    # sums from the first shard on up to an end, and before the start of an open node
    spine = spine.join(totals.select("shard", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved")), "shard")
    for c in ("leaves", "saved"):
        edge = F.when(F.col("kind") == 2, F.col(f"before_{c}") + F.col(c)).otherwise(F.col(f"before_{c}") + F.col(f"all_{c}") - F.col(c))
        spine = spine.withColumn(f"edge_{c}", edge)
    along = Window.partitionBy("level").orderBy("shard", F.desc("kind"))
    spine = spine.withColumns({f"next_{c}": F.lead(f"edge_{c}").over(along) for c in ("leaves", "saved")}).where("kind = 1")
    spine = spine.select(*kept, *[(F.col(f"next_{c}") - F.col(f"edge_{c}")).alias(c) for c in ("leaves", "saved")])
    every = solved.where("kind = 0").select(*kept, "leaves", "saved").unionByName(spine)
    return every.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(shard, its columns) for one shard after the other; rows come sorted by shard."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> tuple[int, dict[str, np.ndarray]]:
        return int(held[0]["shard"][0]), {c: np.concatenate([h[c] for h in held]) for c in columns}

    for batch in batches:
        got = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
        cuts = np.flatnonzero(np.diff(got["shard"])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a == b:
                continue
            if held and held[0]["shard"][0] != got["shard"][a]:
                yield joined()
                held.clear()
            held.append({c: v[a:b] for c, v in got.items()})
    if held:
        yield joined()


def end_digests(ends: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` and ``ends_sha256`` of the nodes where conversations end.

    Lists are written in chunks wherever their ranges lie. SHA-256 takes its bytes in
    order, so the chunks of one node pass through one task, but never lie there together.
    """
    by = ["conv_id", "depth", "member"]
    rows = cut_lineage(ends, "ends").repartitionByRange(*by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            listed = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for node, some in groupby(listed, key=lambda r: r[:2]):
                ids = [r[2] for r in some]
                for k in range(0, len(ids), CHUNK):
                    out.append((*node, ids[k], ",".join(map(str, ids[k : k + CHUNK]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv_id", "depth", "member", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        done = []
        for node, some in groupby(rows_, key=lambda r: r[:2]):
            state = None
            for r in some:
                if state is None:
                    state = sha256()
                else:
                    state.update(b",")
                state.update(r[3].encode())
            done.append((*node, state.hexdigest()))
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["conv_id", "depth", "ends_sha256"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["conv_id", "depth", "ends_sha256"])

    chunks = rows.mapInArrow(write, "conv_id bigint, depth bigint, member bigint, ids string")
    chunks = chunks.repartition("conv_id", "depth").sortWithinPartitions(*by)
    return chunks.mapInArrow(digest, "conv_id bigint, depth bigint, ends_sha256 string")


def trie(convs: DataFrame, paths: DataFrame, shard: int | None = None) -> DataFrame:
    """One row per node; ``convs`` (``conv_id``, ``length``) and ``paths`` as from ``rebuilt``."""
    nodes, ends = preorder(convs, named_prefixes(paths))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    found = subtree_sums(nodes, shard).join(children, ["conv_id", "depth"], "left")
    found = found.join(end_digests(ends), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


ORACLE = f"""
with t as (
  select conv_id, strlen(text) size, sha256(strlen(role) || ':' || role || text) content,
         row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)) - 1 pos,
         count(*) over (partition by conv_id) n
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c0 as (select distinct conv_id, n, {crc32_sql("conv_id::varchar")} % 9 h, conv_id - conv_id % 5 base from t),
c as (select a.*, least(a.h, coalesce(b.n, 0)) taken from c0 a left join c0 b on b.conv_id = a.base),
w as (select c.conv_id, taken + pos - h + 1 depth, content, size from t join c using (conv_id) where pos >= h
      union all select c.conv_id, pos + 1, content, size from t join c on t.conv_id = c.base where pos < h),
p as (select conv_id member, depth, size, string_agg(content, '') over (partition by conv_id order by depth) k from w
      union all select conv_id, 0, 0, '' from c),
nd as (select depth, k, min(member) conv_id, count(*) n_convs, any_value(size) size from p group by 1, 2),
q as (select p.member, p.depth, nd.conv_id from p join nd using (depth, k)),
up as (select nd.*, q.conv_id parent_conv_id from nd left join q on q.member = nd.conv_id and q.depth = nd.depth - 1),
ch as (select parent_conv_id conv_id, depth - 1 depth, count(*) n_children from up where depth > 0 group by 1, 2),
fu as (select up.*, coalesce(n_children, 0) n_children from up left join ch using (conv_id, depth)),
su as (select q.conv_id, q.depth, count(*) filter (where n_children = 0) n_leaves, sum((n_convs - 1) * size)::bigint saved_tokens
       from q join fu on q.member = fu.conv_id and q.depth <= fu.depth group by 1, 2),
la as (select member, max(depth) depth from q group by 1),
en as (select q.conv_id, q.depth, string_agg(member::varchar, ',' order by member) ids from la join q using (member, depth) group by 1, 2)
select fu.conv_id, fu.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from fu join su using (conv_id, depth) left join en using (conv_id, depth)
"""
