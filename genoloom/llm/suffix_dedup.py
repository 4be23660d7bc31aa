"""Removal of byte strings that repeat anywhere in the corpus, by sparse enhanced suffix arrays.

A string of ``min_len`` bytes always holds an anchor: the gram (half its length) whose hash is the least in the string.
Equal strings hold the same anchor at the same place, so every repeat is found among the suffixes that start at anchors
of equal key. Such a group gets a suffix array of what follows the anchor with its common-prefix array; a stack scan of it
gives the interval tree, and in each interval the strings before the anchor are scanned the same way. A pair of extensions
is a maximal repeat if its occurrences differ on both sides. Each repeat comes with all its occurrences.

Occurrences whose whole context is equal are one class and never compared; a group with more than ``group_limit`` classes
is settled by counting its windows instead, exactly and spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.llm.text_columns import fresh
from genoloom.session import drop_materialized, materialize

_CHUNK = 1 << 20
_SHARES = 2048
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and powers of the base and of its inverse modulo 2**64."""
    values = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    n = 2 * _CHUNK
    inverse = pow(_BASE, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    powers, inverses = (np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
    return values, powers, inverses


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class RollingHash:
    """Hashes of any substring of a chunk of bytes, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        values, powers, self.inverses = _tables()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers[: len(data)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: block prefixes and suffixes."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors_of(data: bytes, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys, hashes of the contexts) of the anchors of one text; all its bytes are used."""
    gram = min_len // 2
    reach = min_len - gram
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = -1
    for c in range(0, max(1, len(data) - min_len + 1), _CHUNK):
        lo, hi = max(0, c - min_len), min(len(data), c + _CHUNK + 2 * min_len)
        part = np.frombuffer(data, np.uint8, hi - lo, lo)
        if len(part) < min_len:
            break
        h = RollingHash(part)
        at = np.arange(len(part) - gram + 1)
        keys = h(at, at + gram)
        # The upper bits of the key order the grams; equal ones are ordered by place, the first is taken.
        ranked = (keys & _U(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        first, stop = c - lo, min(len(part) - min_len + 1, c - lo + _CHUNK)
        least = _window_min(ranked[first : stop + reach], reach + 1)[: stop - first]
        pos = (least & _U(0xFFFFFF)).astype(np.int64)
        pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
        pos = pos[pos + lo > last]
        if not len(pos):
            continue
        last = int(pos[-1]) + lo
        left, right = np.maximum(pos - reach, 0), np.minimum(pos + gram + reach, len(part))
        context = h(left, right) ^ _mix(((pos - left) * 4096 + (right - pos)).astype(np.uint64))
        found.append((pos + lo, keys[pos], context))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of a common-prefix array: (length, first, last) of each interval of the tree, inner ones first."""
    stack = [(0, 0)]
    for i, value in enumerate([*common, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], need: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): repeats around equal anchors, with all occurrences, that reach at least ``need`` bytes in sum.

    lefts: the bytes before each anchor, nearest first; rights: those after it. Each repeat is maximal: its members differ
    in the next byte on either side.
    """
    if len(lefts) == 2:
        a, b = _common(lefts[0], lefts[1]), _common(rights[0], rights[1])
        if a + b >= need:
            yield a, b, [0, 1]
        return
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [_common(rights[i], rights[j]) for i, j in zip(order, order[1:])]
    for r, lo, hi in _intervals(lcp):
        if hi == lo:
            continue
        own = sorted(range(lo, hi + 1), key=lambda i: lefts[order[i]])
        lcs = [_common(lefts[order[i]], lefts[order[j]]) for i, j in zip(own, own[1:])]
        for length, a, b in _intervals(lcs):
            if a < b and length + r >= need:
                at = own[a : b + 1]
                if min(lcp[min(at) : max(at)]) == r:  # else a deeper interval has them with a longer right side
                    yield length, r, [order[i] for i in at]


def anchors(docs: DataFrame, min_len: int) -> DataFrame:
    """(rid, pos, key, ctx, left, right) of every anchor; docs: (rid, data binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = min_len - min_len // 2
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, cols = batch.slice(at, 256), []
                for rid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(data) >= min_len:
                        pos, key, ctx = anchors_of(data, min_len)
                        size = np.minimum(pos, reach) + np.minimum(len(data) - pos, min_len)
                        cols.append((np.full(len(pos), rid), pos, key.view(np.int64), ctx.view(np.int64), np.minimum(pos, reach), size))
                if cols:
                    rid, pos, key, ctx, left, size = (np.concatenate(c) for c in zip(*cols))
                    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pos), pa.array(key), pa.array(ctx), pa.array(left.astype(np.int32)), pa.array(size.astype(np.int32))], names=["rid", "pos", "key", "ctx", "before", "size"])

    return docs.mapInArrow(run, "rid long, pos long, key long, ctx long, before int, size int")


def repeated_spans(docs: DataFrame, min_len: int = 200, group_limit: int = 256) -> DataFrame:
    """(rid, start, end): byte spans that strings of ``min_len`` bytes found elsewhere cover; spans of a text may overlap.

    docs: (rid long, data binary), with one rid for each different pair of id and text.
    """
    gram, reach = min_len // 2, min_len - min_len // 2
    every = anchors(docs, min_len)
    # Written, so that the join below has a shuffle of its own on both sides and Spark can split a hot key.
    repeated = materialize(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-keys")
    rows = materialize(every.join(repeated, "key"), "suffix-anchors")
    drop_materialized(repeated)
    # Classes of equal context. A class of two or more occurrences is covered as far as its context goes.
    place = F.struct("rid", "pos")
    classes = rows.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.first("before").alias("before"), F.first("size").alias("size"))
    classes = materialize(classes.select("key", "ctx", "n", "at.rid", "at.pos", "before", "size"), "suffix-classes")
    covered = _join_sizes(rows, classes.select("key", "ctx", "n"), ["key", "ctx"], "n", rows.count()).where((F.col("n") > 1) & (F.col("size") >= min_len))
    inside = covered.select("rid", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") - F.col("before") + F.col("size")).alias("end"))
    # Groups with a class of one occurrence and at least one class more need their contexts.
    groups = materialize(classes.groupBy("key").agg(F.count("*").alias("classes"), F.count(F.when(F.col("n") == 1, 1)).alias("single")), "suffix-groups")
    members = _join_sizes(classes, groups, ["key"], "classes", classes.count()).where("classes > 1 and single > 0").select("rid", F.struct("pos", "key", "n", "classes").alias("m"))
    wanted = members.groupBy("rid").agg(F.collect_list("m").alias("ms"))  # at most a text's own anchors
    contexts = materialize(_contexts(docs.join(wanted, "rid"), gram, reach), "suffix-contexts")
    cold = contexts.where(F.col("classes") <= group_limit).repartition("key").sortWithinPartitions("key")
    hot = _hot_windows(contexts.where(F.col("classes") > group_limit), gram, reach)
    return inside.unionByName(_scan_groups(cold, gram, reach)).unionByName(hot)


def _join_sizes(rows: DataFrame, sizes: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of sizes, one row for each group of rows; ``size``: how many rows a group has, of total.

    A group of more than one in _SHARES of all rows would be one task of a join by key. There are fewer than _SHARES such
    groups in any input, so they are broadcast; all others are joined by key.
    """
    limit = total // _SHARES
    told = rows.join(F.broadcast(sizes.where(F.col(size) > limit).withColumn("_hot", F.lit(True))), on, "left")
    cold = told.where("_hot is null").select(*rows.columns).join(sizes.where(F.col(size) <= limit), on)
    hot = told.where("_hot").drop("_hot")
    return hot.unionByName(cold)


def _contexts(joined: DataFrame, gram: int, reach: int) -> DataFrame:
    """The bytes before and after each wanted anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rid, data = batch.column("rid")[i].as_py(), batch.column("data")[i].as_py()
                ms = batch.column("ms")[i].as_py()
                for s in range(0, len(ms), 4096):
                    part = ms[s : s + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([rid] * len(part), pa.int64()), *(pa.array([m[k] for m in part], pa.int64()) for k in ("pos", "key", "n", "classes")),
                            pa.array([data[max(0, m["pos"] - reach) : m["pos"]] for m in part], pa.binary()), pa.array([data[m["pos"] + gram : m["pos"] + gram + reach] for m in part], pa.binary()),
                        ],
                        names=["rid", "pos", "key", "n", "classes", "left", "right"],
                    )

    return joined.select("rid", "data", "ms").mapInArrow(run, "rid long, pos long, key long, n long, classes long, left binary, right binary")


def _scan_groups(contexts: DataFrame, gram: int, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["key"]):
            rid, start, end = [], [], []
            for t in found:
                lefts = [x[::-1] for x in t.column("left").to_pylist()]
                best: dict[int, tuple[int, int]] = {}
                for a, b, members in maximal_repeats(lefts, t.column("right").to_pylist(), reach):
                    for m in members:
                        x, y = best.get(m, (0, 0))
                        best[m] = (max(a, x), max(b, y))
                if best:
                    rids, pos = t.column("rid").to_pylist(), t.column("pos").to_pylist()
                    for m, (a, b) in best.items():
                        rid.append(rids[m])
                        start.append(pos[m] - a)
                        end.append(pos[m] + gram + b)
            if rid:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid, start, end)], names=["rid", "start", "end"])

    return contexts.select("key", "rid", "pos", "left", "right").mapInArrow(run, "rid long, start long, end long")


def _hot_windows(contexts: DataFrame, gram: int, reach: int) -> DataFrame:
    """For groups of very many classes: every window that holds the anchor is counted, and an anchor is covered from its first repeated window to its last."""
    offset = F.explode(F.sequence(F.greatest(F.lit(0), reach - F.length("right")), F.least(F.lit(reach), F.length("left")))).alias("o")
    wide = contexts.where(F.length("left") + F.length("right") >= reach).select("key", "rid", "pos", "n", "left", "right", offset)
    content = F.concat(F.expr("substring(left, length(left) - o + 1, o)"), F.expr(f"substring(right, 1, {reach} - o)"))
    windows = wide.select("rid", "pos", "n", "o", F.xxhash64("key", "o", content).alias("w1"), F.xxhash64(content, "o").alias("w2"))
    windows = materialize(windows, "suffix-windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2")
    ends = windows.join(twice, ["w1", "w2"]).groupBy("rid", "pos").agg(F.max("o").alias("most"), F.min("o").alias("least"))
    return ends.select("rid", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") + gram + reach - F.col("least")).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, group_limit: int = 256, with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row, and the kept bytes and the spans if asked for.

    A text is its UTF-8 bytes (null: empty). A byte goes if a string of ``min_len`` bytes that covers it also starts
    anywhere else, in the same text or another; strings are judged on the input. Repeated rows are copies of each other.
    Texts shorter than ``min_len`` keep all bytes. Rows are told apart by a 64-bit hash of id and text.
    """
    rid, data = fresh(docs, "rid"), fresh(docs, "data")
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), text).alias(rid), F.coalesce(text.cast("binary"), F.lit(b"")).alias(data))
    spans = repeated_spans(keyed.select(F.col(rid).alias("rid"), F.col(data).alias("data")), min_len, group_limit)
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("rid", rid + "2")
    joined = keyed.join(lists, F.col(rid) == F.col(rid + "2"), "left").select(id_col, data, "spans")
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    if with_kept:
        fields += [T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, rows = batch.slice(at, 256), []
                for bytes_, spans_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    removed, parts, last = [], [], 0
                    for s, e in sorted((x["start"], x["end"]) for x in spans_ or ()):
                        if removed and s <= removed[-1][1]:
                            removed[-1][1] = max(removed[-1][1], e)
                        else:
                            removed.append([s, e])
                    for s, e in removed:
                        parts.append(bytes_[last:s])
                        last = e
                    kept = b"".join([*parts, bytes_[last:]])
                    rows.append((len(bytes_), len(bytes_) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept, [{"start": s, "end": e} for s, e in removed]))
                kinds = [pa.int64()] * 3 + [pa.string()] + ([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] if with_kept else [])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))
