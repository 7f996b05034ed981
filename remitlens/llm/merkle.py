"""Merkle manifest of a table: a SHA-256 tree whose parents keep copied hash states.

Every row is a leaf: the digest of its columns, each written as ``-`` if null and else
as its byte count, ``:`` and its value. The leaves of a source go by id; every three
consecutive nodes become their digest until one node, the source's subroot, is left.
The subroots, ordered by source, give the root in the same way.

Going up, nodes are dealt by place into blocks of ``3 ** HEIGHT``; one task reduces a
block to its top, the tops are the next stratum, so any source is split however many
rows it holds. Going down, every block gets the siblings above its top (``lefts``
and ``rights``, level by level) as its first row. Within a block each parent hashes its
children once and keeps a copy of the hash state before every child slot; a changed
leaf resumes the state of its slot with the replacement and the siblings to its right
alone, level by level. For the levels above the block the states are made once per
block.

Nulls are values of their own in every column. Equal ids go by leaf digest (null id
first), so rows that repeat are leaves of their own. Other columns are left out,
whatever their names; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remitlens.session import cut_lineage

from .common import crc32_sql, table
from .ordered import places

#: The columns of a leaf, in order, and the children of a parent.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels that one task reduces: blocks of 243 leaves.
HEIGHT = 5


def leaf_digest(values: list[Column]) -> Column:
    """32 bytes from the values, each of which names its own length."""

    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        )

    return F.unhex(F.sha2(F.concat(*[shown(v) for v in values]), 256))


def grow(nodes: list[bytes], rounds: int | None) -> tuple[list[tuple], list[bytes]]:
    """Levels of (nodes, hash states before each child slot) and what remains.

    ``rounds`` levels, or until one node is left. Digests enter as hex text.
    """
    levels = []
    while len(nodes) > 1 if rounds is None else len(levels) < rounds:
        states, parents = [], []
        for start in range(0, len(nodes), FAN):
            digest, slots = sha256(), []
            for child in nodes[start : start + FAN]:
                slots.append(digest.copy())
                digest.update(child)
            states.append(slots)
            parents.append(digest.hexdigest().encode())
        levels.append((nodes, states))
        nodes = parents
    return levels, nodes


def siblings(levels: list[tuple], i: int) -> tuple[list[bytes], list[bytes]]:
    """What stands left and right of node ``i`` and its parents in their runs, level by level."""
    lefts, rights = [], []
    for nodes, _ in levels:
        run = i - i % FAN
        lefts.append(b"".join(nodes[run:i]))
        rights.append(b"".join(nodes[i + 1 : run + FAN]))
        i //= FAN
    return lefts, rights


def resumed(levels: list[tuple], above: list[tuple], i: int, node: bytes) -> bytes:
    """The root when ``node`` replaces leaf ``i``: states before its slots, then right siblings only."""
    for nodes, states in levels:
        digest = states[i // FAN][i % FAN].copy()
        digest.update(node + b"".join(nodes[i + 1 : i - i % FAN + FAN]))
        node = digest.hexdigest().encode()
        i //= FAN
    for state, right in above:
        digest = state.copy()
        digest.update(node + right)
        node = digest.hexdigest().encode()
    return node


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after the other; they come sorted by key, block and place."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, key=lambda r: (r["key"], r["block"])):
        yield list(block)


def _rounds(n: int, height: int) -> int | None:
    """Levels of a block: all of them where its key has no other block."""
    return None if n <= FAN**height else height


def _dealt(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks as a whole in one task, in order."""
    nodes = nodes.withColumn("block", F.expr(f"pos div {FAN**height}")) if "block" not in nodes.columns else nodes
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _strata(leaves: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Tables of (key, n, pos, digest), each the tops of the blocks before it, down to one node per key."""
    schema = "key string, n bigint, pos bigint, digest binary"
    arrow = pa.schema([("key", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block[0]["n"]
            _, top = grow([r["digest"].hex().encode() for r in block], _rounds(n, height))
            yield pa.RecordBatch.from_pylist(
                [{"key": block[0]["key"], "n": -(-n // FAN**height), "pos": block[0]["block"], "digest": bytes.fromhex(top[0].decode())}],
                arrow,
            )

    strata, most = [leaves.select("key", "n", "pos", "digest")], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        strata.append(cut_lineage(_dealt(strata[-1], height).mapInArrow(reduce, schema), name))
        most = -(-most // FAN**height)
    return strata


def _descend(strata: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """(key, block, lefts, rights) of the blocks of the lowest stratum: siblings from their tops to the root.

    ``tops`` are (key, block 0, lefts, rights) of the keys' last nodes.
    """
    schema = "key string, block bigint, lefts array<string>, rights array<string>"

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, *block in _blocks(batches):
            levels, _ = grow([r["digest"].hex().encode() for r in block], _rounds(block[0]["n"], height))
            out = []
            for i, r in enumerate(block):
                lefts, rights = siblings(levels, i)
                out.append(
                    {
                        "key": r["key"],
                        "block": r["pos"],
                        "lefts": [x.decode() for x in lefts] + above["lefts"],
                        "rights": [x.decode() for x in rights] + above["rights"],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, arrow)

    texts = pa.list_(pa.string())
    arrow = pa.schema([("key", pa.string()), ("block", pa.int64()), ("lefts", texts), ("rights", texts)])
    blocks = tops
    # the last stratum holds the tops themselves; the lowest one is the caller's
    for nodes in strata[-2:0:-1]:
        blocks = cut_lineage(_dealt(_headed(nodes, blocks, height), height).mapInArrow(paths, schema), "paths")
    return blocks


def _headed(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``nodes`` with the siblings above each block as a row before its own."""
    heads = blocks.withColumn("pos", F.lit(-1).cast("bigint"))
    nodes = nodes.withColumn("block", F.expr(f"pos div {FAN**height}"))
    return nodes.unionByName(heads, allowMissingColumns=True)


def manifest(
    docs: DataFrame,
    replaced: dict[str, Column] | None = None,
    columns: tuple[str, ...] = COLUMNS,
    id_col: str = "doc_id",
    source_col: str = "source",
    height: int = HEIGHT,
    proofs: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root`` and ``verified``.

    ``replaced`` gives other values for some columns; ``folded_root`` is the root over
    the leaf of these values and the original siblings. ``proofs`` adds the siblings
    themselves, level by level (``lefts`` and ``rights``), to be kept with the manifest.
    """
    source = F.col(source_col).cast("string")
    hashed = docs.select(
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("+"), source), F.lit("-")).alias("key"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest([(replaced or {}).get(c, F.col(c)) for c in columns]).alias("other"),
    )
    hashed = cut_lineage(hashed, "hashed")
    leaves = cut_lineage(places(hashed, "key", [F.asc_nulls_first("id"), F.col("digest")], "sorted"), "leaves")
    strata = _strata(leaves, height, "stratum")

    # the sources' own tree
    names = leaves.groupBy("key").agg(F.first("source").alias("source"))
    subroots = strata[-1].select("key", "digest").join(names, "key").withColumnRenamed("key", "of")
    subroots = cut_lineage(subroots.withColumn("key", F.lit("")), "subroots")
    subroots = cut_lineage(places(subroots, "key", [F.asc_nulls_first("source")], "sources"), "sources")
    upper = _strata(subroots, height, "upper")
    root = upper[-1].select(F.lower(F.hex("digest")).alias("root"))
    none = F.array().cast("array<string>")
    head = upper[-1].select("key", F.lit(0).cast("bigint").alias("block"), none.alias("lefts"), none.alias("rights"))
    over = _descend(upper, head, height)
    of_source = _headed(subroots, over, height)

    above_schema = "key string, block bigint, subroot string, lefts array<string>, rights array<string>"

    def above_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.list_(pa.string())
        arrow = pa.schema(
            [("key", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("lefts", texts), ("rights", texts)]
        )
        for above, *block in _blocks(batches):
            levels, _ = grow([r["digest"].hex().encode() for r in block], _rounds(block[0]["n"], height))
            out = []
            for i, r in enumerate(block):
                lefts, rights = siblings(levels, i)
                out.append(
                    {
                        "key": r["of"],
                        "block": 0,
                        "subroot": r["digest"].hex(),
                        "lefts": [x.decode() for x in lefts] + above["lefts"],
                        "rights": [x.decode() for x in rights] + above["rights"],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, arrow)

    tops = cut_lineage(_dealt(of_source, height).mapInArrow(above_sources, above_schema), "tops")
    blocks = _descend(strata, tops.drop("subroot"), height)
    blocks = blocks.join(tops.select("key", "subroot"), "key").withColumn("root", root.scalar())

    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", lefts array<string>, rights array<string>" if proofs else ""
    out_schema = (
        f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
        f"folded_root string, verified boolean{extra}"
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *block in _blocks(batches):
            levels, _ = grow([r["digest"].hex().encode() for r in block], _rounds(block[0]["n"], height))
            upper_lefts = [x.encode() for x in head["lefts"]]
            upper_rights = [x.encode() for x in head["rights"]]
            above = [(sha256(left), right) for left, right in zip(upper_lefts, upper_rights)]
            made = {c: [] for c in ("id", "leaf", "proof", "folded", "lefts", "rights")}
            for i, r in enumerate(block):
                lefts, rights = siblings(levels, i)
                lefts, rights = lefts + upper_lefts, rights + upper_rights
                made["id"].append(r["id"])
                made["leaf"].append(r["digest"].hex())
                made["proof"].append(sha256(b"".join(x + y for x, y in zip(lefts, rights))).hexdigest())
                made["folded"].append(resumed(levels, above, i, r["other"].hex().encode()).decode())
                if proofs:
                    made["lefts"].append([x.decode() for x in lefts])
                    made["rights"].append([x.decode() for x in rights])
            n = len(block)
            columns = [
                pa.array(made["id"], id_type),
                pa.array(made["leaf"]),
                pa.array([head["subroot"]] * n),
                pa.array([head["root"]] * n),
                pa.array(made["proof"]),
                pa.array(made["folded"]),
                pa.array([x == head["root"] for x in made["folded"]]),
            ]
            columns += [pa.array(made[c], pa.list_(pa.string())) for c in ("lefts", "rights")] if proofs else []
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    out_names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out_names += ["lefts", "rights"] if proofs else []
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    lowest = leaves.select("key", "n", "pos", "digest", "id", "other")
    return _dealt(_headed(lowest, blocks, height), height).mapInArrow(fold, out_schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the CRC-32 of the id, the line feeds of the text are taken out."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return manifest(table(spark, sf_dir, "documents"), {"text": F.coalesce(tampered, F.col("text"))})


#: Runs of the unrolled SQL: 3 ** 12 rows of a source.
_LEVELS = 12


def _level_sql(name: str, k: int) -> str:
    """Level ``k + 1`` of a tree table and of the proofs that climb it."""
    return f"""
{name}g{k} as (select key, pos // 3 pos, any_value(n) n, max(case when pos % 3 = 0 then digest end) a,
    coalesce(max(case when pos % 3 = 1 then digest end), '') b, coalesce(max(case when pos % 3 = 2 then digest end), '') c
  from {name}{k} group by key, pos // 3),
{name}{k + 1} as (select key, pos, (n + 2) // 3 n, case when n > 1 then sha256(a || b || c) else a end digest from {name}g{k}),
{name}p{k + 1} as (select p.* exclude (pos, sib, fold), p.pos // 3 pos,
    p.sib || case when g.n = 1 then '' when p.pos % 3 = 0 then b || c when p.pos % 3 = 1 then a || c else a || b end sib,
    case when g.n = 1 then fold when p.pos % 3 = 0 then sha256(fold || b || c)
         when p.pos % 3 = 1 then sha256(a || fold || c) else sha256(a || b || fold) end fold
  from {name}p{k} p join {name}g{k} g on g.key = p.key and g.pos = p.pos // 3)"""


def _oracle() -> str:
    def shown(value: str) -> str:
        return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(shown(c if c != "text" else text) for c in COLUMNS) + ")"

    crc = crc32_sql("doc_id::varchar")
    low = ",".join(_level_sql("s", k) for k in range(_LEVELS))
    top = ",".join(_level_sql("r", k) for k in range(_LEVELS))
    return f"""
with h as (select doc_id, source, coalesce('+' || source, '-') key, {leaf("text")} leaf,
       case when doc_id is not null and {crc} % 2 = 0 then replace(text, chr(10), '') else text end text2, lang, n_chars from documents),
l as (select *, {leaf("text2")} other,
      row_number() over (partition by key order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by key) n from h),
s0 as (select key, pos, n, leaf digest from l),
sp0 as (select doc_id, leaf, key, pos, '' sib, other fold from l),
{low},
src as (select distinct key, source from l),
r0 as (select 0 key, row_number() over (order by source nulls first) - 1 pos, count(*) over () n, digest, s.key of from s{_LEVELS} s join src using (key)),
rp0 as (select doc_id, leaf, r0.digest subroot, 0 key, r0.pos, sib, fold from sp{_LEVELS} p join r0 on r0.of = p.key),
{top}
select doc_id, leaf, subroot, digest root, sha256(sib) proof_sha256, fold folded_root, fold = digest verified
from rp{_LEVELS} p join r{_LEVELS} using (key)
"""


ORACLE = _oracle()
