"""Removal of repeated byte strings by a distributed, prefix-aware suffix merge sort.

A byte goes if a ``length``-byte string that also starts earlier covers it. Sorting
every suffix is not needed: among the ``K``-byte strings inside a window of
``length`` bytes, the one with the smallest hash (its *anchor*) is the same in any
copy of the window. So only the suffixes at anchors are sorted, each with the bytes
to its left that such a window can hold.

1. Documents are dealt into groups of about ``GROUP_BYTES`` by a hash. Each group
   sends the hashes of its distinct anchors, and learns which of them occur elsewhere
   too: a suffix with an unshared start cannot be part of a repeat and stays home.
2. Each group sorts its shared suffixes into a run, keeps equal ones once with all
   their places, front-codes the run (length of the prefix shared with the entry
   before, then the rest) and sends a slice of it to each bucket of anchor hashes.
3. A bucket merges its runs with a loser tree. Every run's head carries how many
   bytes it shares with the last winner; a match between heads that differ in this
   is decided without looking at any byte, one between equals starts behind the
   shared bytes, so no known prefix is compared again. Entries with one anchor come
   out next to each other; each is held against the earlier ones: together with the
   bytes on both sides of the anchor, equal stretches of ``length`` bytes are marked.
4. Marks return to the groups, which cut the bytes out.

An anchor that ``HOT`` or more groups share is not merged as a whole: the windows it
stands for are sent one by one to the buckets of their own hashes, where those that
many documents share melt together in their runs and the others spread.

Nulls are empty texts. Documents go by id, null first; those that share an id go in
a fixed order that their texts give. Rows that repeat are documents of their own.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH = 100
K = 50
GROUP_BYTES, BUCKET_BYTES = 16 << 20, 10 << 20
HOT = 64
END, WINDOW = b"\xff", b"\xfe"  # no bytes of UTF-8: the end of a suffix, the start of a whole window
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all ``k``-byte strings, made by doubling their length."""
    one = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(29)
    now, size, power = one, 1, int(_ODD)
    for bit in bin(k)[3:]:
        now = now[:-size] * np.uint64(power) + now[size:]
        size, power = 2 * size, power * power & _MASK
        if bit == "1":
            now = now[:-1] * _ODD + one[size : size + len(now) - 1]
            size, power = size + 1, power * int(_ODD) & _MASK
    now ^= now >> np.uint64(31)
    now *= np.uint64(0x94D049BB133111EB)
    return now ^ (now >> np.uint64(29))


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    now, size = values, 1
    while 2 * size <= width:
        now = least(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return least(now[: len(now) - rest], now[rest:]) if rest else now


def _smallest(data: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Places and hashes of the strings that are the smallest of some window of ``data``,
    and the first and last start of the windows each stands for."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = _gram_hashes(np.frombuffer(data, np.uint8), k)
    width = length - k + 1
    least = _slide(hashes, width, np.minimum)
    # a place is an anchor if the largest minimum of the windows around it is its own hash
    edge = np.zeros(width - 1, np.uint64)
    around = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(around == hashes)
    # the windows of an anchor are the run of its hash among the minima, at or before its place
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([starts[1:], [len(least)]]) - 1
    run = np.searchsorted(starts, at, side="right") - 1
    wrong = np.flatnonzero(least[starts[run]] != hashes[at])
    while len(wrong):
        run[wrong] -= 1
        wrong = wrong[least[starts[run[wrong]]] != hashes[at[wrong]]]
    return at, hashes[at], np.maximum(starts[run], at - width + 1), np.minimum(ends[run], at)


def _in_order(docs: pa.Table) -> list[tuple[int | None, bytes, int]]:
    """The documents of a group by id (null first) and text, and their row numbers."""
    texts = ((t or "").encode() for t in docs["text"].to_pylist())
    rows = zip(docs["doc_id"].to_pylist(), texts, range(docs.num_rows))
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _group_anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Document number, place, hash, first and last window of every anchor.

    Short texts are hashed together; windows over a seam are cut off, and anchors that
    stand for no window inside their document are dropped.
    """
    parts = []
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 1 << 20):
            size += len(texts[stop])
            stop += 1
        sizes = np.array([len(t) for t in texts[start:stop]], np.int64)
        ends = np.cumsum(sizes)
        at, hashes, first, last = _smallest(b"".join(texts[start:stop]), length, k)
        number = np.searchsorted(ends, at, side="right")
        base = (ends - sizes)[number]
        first, last = np.maximum(first - base, 0), np.minimum(last - base, sizes[number] - length)
        inside = first <= last
        parts.append([x[inside] for x in (number + start, at - base, hashes, first, last)])
        start = stop
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


# --- runs: front coding and the merge ---------------------------------------------


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """How many bytes ``a`` and ``b`` share, when the first ``start`` are known to be equal."""
    n = min(len(a), len(b))
    while start < n:
        step = min(16, n - start)
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + step - (diff.bit_length() + 7) // 8
        start += step
    return n


def front_coded(entries: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, rest lengths and rests of sorted entries."""
    shared, rest, last = bytearray(), [], b""
    sizes = bytearray()
    for e in entries:
        n = common_prefix(last, e)
        shared.append(n)
        sizes.append(len(e) - n)
        rest.append(e[n:])
        last = e
    return bytes(shared), bytes(sizes), b"".join(rest)


def merged(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(entry, bytes shared with the entry before, run, number in the run) in sorted order.

    ``head[r]`` is the next entry of run ``r`` and ``lcp[r]`` what it shares with the
    last winner of the games it lost or won, as in a loser tree over strings.
    """
    n = len(runs)
    if not n:
        return
    width = 1 << (n - 1).bit_length()
    head: list[bytes | None] = [None] * width
    lcp, place, at = [0] * width, [0] * width, [0] * width
    for r, (shared, sizes, rest) in enumerate(runs):
        if shared:
            head[r], at[r] = rest[: sizes[0]], sizes[0]

    def game(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's ``lcp`` becomes what it shares with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:  # the head that shares more with the last winner is smaller
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = common_prefix(x, y, lcp[a])
        if x[k:] < y[k:] or (len(x) == len(y) == k and a < b):
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    losers = [0] * width
    winners = [*([0] * width), *range(width)]
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = game(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if width > 1 else 0
    while head[best] is not None:
        r = best
        x = head[r]
        yield x, lcp[r], r, place[r]
        shared, sizes, rest = runs[r]
        i = place[r] = place[r] + 1
        if i < len(shared):
            # the run's next entry shares with the winner what it shares with its predecessor
            known, size = shared[i], sizes[i]
            x = head[r] = x[:known] + rest[at[r] : at[r] + size]
            at[r] += size
        else:
            x, known = None, -1
            head[r] = None
        lcp[r] = known
        # replay the games on the way up: ``best`` is the winner so far, x its head, known its lcp
        node = (width + r) >> 1
        while node:
            other = losers[node]
            theirs = lcp[other]
            if theirs > known:
                if head[other] is not None:
                    losers[node], best = best, other
                    x, known = head[other], theirs
            elif theirs == known and head[other] is not None:
                y = head[other]
                k = common_prefix(x, y, known)
                if x[k:] < y[k:] or (len(x) == len(y) == k and best < other):
                    lcp[other] = k
                else:
                    lcp[best] = k
                    losers[node], best = best, other
                    x, known = y, theirs
            node >>= 1


# --- what equal stretches cover -----------------------------------------------------


def _spans(entries: list[tuple[tuple, bytes, bytes]], length: int, k: int) -> list[tuple[int, int] | None]:
    """For distinct entries of one anchor in document order: bytes left and right of it that are repeated.

    An entry is (order, right, left reversed), where right starts with the anchor.
    """
    found: list[tuple[int, int] | None] = [None]
    if len(entries) <= 8:
        for c in range(1, len(entries)):
            most_left = most_right = -1
            _, right, left = entries[c]
            for e in range(c):
                r, lt = common_prefix(right, entries[e][1], k), common_prefix(left, entries[e][2])
                if r + lt >= length:
                    most_left, most_right = max(most_left, lt), max(most_right, r)
            found.append((most_left, most_right) if most_right >= 0 else None)
        return found
    seen: list[set[bytes]] = [set() for _ in range(length - k + 1)]
    for c, (_, right, left) in enumerate(entries):
        most_left = most_right = -1
        for o in range(max(0, length - len(right)), len(left) + 1):
            window = left[:o] + END + right[: length - o]
            if window in seen[o]:
                most_left, most_right = max(most_left, o), max(most_right, length - o)
            else:
                seen[o].add(window)
        if c:
            found.append((most_left, most_right) if most_right >= 0 else None)
    return found


# --- the job --------------------------------------------------------------------------


def cut_documents(
    docs: DataFrame,
    length: int = LENGTH,
    k: int = K,
    group_bytes: int = GROUP_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    hot: int = HOT,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    as_text: bool = False,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``starts``/``ends`` of the removed runs, ``kept`` (bytes left).

    ``carry`` names further columns of ``docs`` to return (as ``carried``, a struct).
    With ``as_text``, ``kept`` is a string without the characters that a cut has split.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(None).cast("int").alias("none")]).alias("carried"),
    )
    carried_type = rows.schema["carried"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(max(1, -(-total // group_bytes)))
    buckets = int(max(1, -(-total // bucket_bytes)))
    # one exchange of the texts, which all three passes over them share
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(
        groups, "g"
    )

    def by_bucket(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of ``found`` by bucket, the buckets, and where each starts."""
        where = _bucket_of(found, buckets)
        order = np.argsort(where, kind="stable")
        names, starts = np.unique(where[order], return_index=True)
        return order, names, starts

    def announce(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        """The distinct anchor hashes of a group, and whether each stands at several places."""
        hashes = _group_anchors([r[1] for r in _in_order(docs)], length, k)[2]
        found, n = np.unique(hashes, return_counts=True)
        order, names, starts = by_bucket(found)
        return pa.table(
            {
                "g": pa.array([key[0].as_py()] * len(names), pa.int32()),
                "bucket": pa.array(names, pa.int32()),
                "hashes": pa.array([x.tobytes() for x in np.split(found[order], starts[1:])][: len(names)], pa.binary()),
                "again": pa.array([x.tobytes() for x in np.split((n > 1)[order], starts[1:])][: len(names)], pa.binary()),
            }
        )

    def answer(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        """For each group's hashes: 0 if no other place has it, 1 if some has, 2 if many groups do."""
        parts = [np.frombuffer(x, np.uint64) for x in sent["hashes"].to_pylist()]
        _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = np.concatenate([np.frombuffer(x, bool) for x in sent["again"].to_pylist()])
        twice = n > 1
        twice[back[again]] = True
        state = (twice.astype(np.uint8) + (n >= hot))[back]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        states = pa.array([x.tobytes() for x in np.split(state, ends)], pa.binary())
        return pa.table({"g": sent["g"], "bucket": sent["bucket"], "state": states})

    run_schema = pa.schema(
        [("bucket", pa.int32()), ("g", pa.int32())]
        + [(c, pa.binary()) for c in ("shared", "sizes", "rest", "counts", "ids", "numbers", "places")]
    )

    def make_runs(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return run_schema.empty_table()
        rows = _in_order(docs)
        number, place, hashes, first, last = _group_anchors([r[1] for r in rows], length, k)
        found = np.unique(hashes)
        order, _, _ = by_bucket(found)
        states = sorted(zip(told["bucket"].to_pylist(), told["state"].to_pylist()))
        state = np.empty(len(found), np.uint8)
        state[order] = np.frombuffer(b"".join(x for _, x in states), np.uint8)
        state = state[np.searchsorted(found, hashes)]
        entries: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        shared = np.flatnonzero(state == 1)
        where = _bucket_of(hashes[shared], buckets).tolist()
        places = (number[shared].tolist(), place[shared].tolist(), first[shared].tolist(), last[shared].tolist())
        for d, x, a, z, b in zip(*places, where):
            text = rows[d][1]
            # what the anchor's windows hold: from the anchor on, then backwards from it
            entry = text[x : z + length] + END + text[a:x][::-1]
            entries.setdefault(b, {}).setdefault(entry, []).append((d, x))
        many = np.flatnonzero(state == 2)
        for d, a, z in zip(number[many].tolist(), first[many].tolist(), last[many].tolist()):
            text = rows[d][1]
            for start in range(a, z + 1):
                window = text[start : start + length]
                b = window_hash(window) % buckets
                entries.setdefault(b, {}).setdefault(WINDOW + window, []).append((d, start))
        out = []
        for b, held in entries.items():
            run = sorted(held)
            at = [sorted(set(held[e])) for e in run]
            flat = np.array([p for ps in at for p in ps], np.uint32).reshape(-1, 2)
            ids = [rows[ps[0][0]][0] for ps in at]
            shared_, sizes, rest = front_coded(run)
            out.append(
                {
                    "bucket": b, "g": key[0].as_py(), "shared": shared_, "sizes": sizes,
                    "rest": pa.compress(rest, "zstd", asbytes=True),
                    "counts": np.array([len(ps) for ps in at], np.uint32).tobytes(),
                    # a null id comes first
                    "ids": np.array([-(1 << 63) if i is None else i for i in ids], np.int64).tobytes(),
                    "numbers": flat[:, 0].tobytes(), "places": flat[:, 1].tobytes(),
                }
            )
        return pa.Table.from_pylist(out, run_schema)

    def merge(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        sent = {c: sent[c].to_pylist() for c in sent.column_names}
        gs = sent["g"]
        counts = [np.frombuffer(x, np.uint32) for x in sent["counts"]]
        firsts = [[0, *np.cumsum(c, dtype=np.int64).tolist()] for c in counts]
        ids = [np.frombuffer(x, np.int64).tolist() for x in sent["ids"]]
        numbers = [np.frombuffer(x, np.uint32).tolist() for x in sent["numbers"]]
        places = [np.frombuffer(x, np.uint32).tolist() for x in sent["places"]]
        marks: list[list[tuple[int, int, int]]] = [[] for _ in gs]

        def settle(same: list[list[tuple[int, int]]], texts: list[bytes]) -> None:
            """Distinct entries of one anchor: where each occurs, and the entry itself."""
            found = []
            for occurs, entry in zip(same, texts):
                right, _, left = entry.removeprefix(WINDOW).partition(END)
                # the earliest occurrence by id and place; between equal ids by group and number
                _, _, _, _, r, i = first = min(
                    (ids[r][i], gs[r], numbers[r][firsts[r][i]], places[r][firsts[r][i]], r, i) for r, i in occurs
                )
                found.append((first[:4], right, left, occurs, (r, i)))
            found.sort(key=lambda f: f[0])
            covers = _spans([f[:3] for f in found], length, k) if len(found) > 1 else [None]
            for (_, right, left, occurs, first), cover in zip(found, covers):
                whole = len(left) + len(right) >= length
                for r, i in occurs:
                    for j in range(firsts[r][i], firsts[r][i + 1]):
                        x = places[r][j]
                        if whole and not ((r, i) == first and j == firsts[r][i]):
                            marks[r].append((numbers[r][j], x - len(left), x + len(right)))
                        elif cover:
                            marks[r].append((numbers[r][j], x - cover[0], x + cover[1]))

        same: list[list[tuple[int, int]]] = []
        texts: list[bytes] = []
        rests = [pa.decompress(x, sum(n), "zstd", asbytes=True) for x, n in zip(sent["rest"], sent["sizes"])]
        for entry, shared, r, i in merged(list(zip(sent["shared"], sent["sizes"], rests))):
            if texts and shared == len(entry) == len(texts[-1]):
                same[-1].append((r, i))
                continue
            # windows sent one by one repeat only as a whole, and equal ones have melted together
            if texts and (shared < k or entry.startswith(WINDOW)):
                settle(same, texts)
                same, texts = [], []
            same.append([(r, i)])
            texts.append(entry)
        if texts:
            settle(same, texts)
        some = [(g, np.array(m, np.uint32).tobytes()) for g, m in zip(gs, marks) if m]
        return pa.table(
            {"g": pa.array([g for g, _ in some], pa.int32()), "marks": pa.array([m for _, m in some], pa.binary())}
        )

    cut_schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
         ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
         ("kept", pa.string() if as_text else pa.binary())]
    )

    def cut(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = _in_order(docs)
        marks = [np.frombuffer(m, np.uint32).reshape(-1, 3) for m in told["marks"].to_pylist()]
        marks = np.concatenate(marks).astype(np.int64) if marks else np.empty((0, 3), np.int64)
        marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
        bounds = np.searchsorted(marks[:, 0], np.arange(len(rows) + 1))
        out = []
        for n, (doc_id, text, _) in enumerate(rows):
            own = marks[bounds[n] : bounds[n + 1], 1:]
            starts, ends = [], []
            if len(own):
                reach = np.maximum.accumulate(own[:, 1])
                fresh = np.concatenate([[True], own[1:, 0] > reach[:-1]])
                starts = own[fresh, 0].tolist()
                ends = reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(own) - 1]])].tolist()
            left, last = [], 0
            for a, b in zip(starts, ends):
                left.append(text[last:a])
                last = b
            left.append(text[last:])
            removed = sum(ends) - sum(starts)
            whole = b"".join(left)
            out.append(
                (doc_id, len(text), removed, starts, ends, whole.decode("utf-8", "ignore") if as_text else whole)
            )
        made = pa.Table.from_arrays(
            [pa.array([r[i] for r in out], f.type) for i, f in enumerate(cut_schema)], schema=cut_schema
        )
        return made.append_column("carried", docs["carried"].take(pa.array([r[2] for r in rows], pa.int64())))

    by_group = dealt.groupBy("g")
    sent = by_group.applyInArrow(announce, "g int, bucket int, hashes binary, again binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "g int, bucket int, state binary")
    runs = by_group.cogroup(told.groupBy("g")).applyInArrow(
        make_runs,
        "bucket int, g int, shared binary, sizes binary, rest binary, counts binary, ids binary, "
        "numbers binary, places binary",
    )
    marks = runs.groupBy("bucket").applyInArrow(merge, "g int, marks binary")
    return by_group.cogroup(marks.groupBy("g")).applyInArrow(
        cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, "
        f"kept {'string' if as_text else 'binary'}, carried {carried_type}",
    )


def window_hash(window: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
