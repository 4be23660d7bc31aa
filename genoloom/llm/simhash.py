"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from word shingles. Pairs within ``radius`` differing bits are found so: the 64 bits are grouped
into partitions of correlated bits, every partition gets a threshold of its own (at least -1, which skips it) with
``sum(thresholds) = radius - partitions + 1``, and the thresholds are allocated by dynamic programming on candidate
counts that are measured over all fingerprints. Any linked pair then agrees within its threshold in some partition.
Fingerprints that meet in a bucket are verified there. A bucket with more than ``bucket_limit`` distinct fingerprints is
not compared pair by pair: its fingerprints meet in balls of half the radius instead, exactly and without a quadratic step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.llm.text_columns import fresh
from genoloom.operators.components import connected_components
from genoloom.session import materialize

BITS = 64
SEED = 42
_PIECE = 1 << 16


def fingerprint_of(text: bytes, shingle_words: int) -> int:
    """The signed 64-bit SimHash of UTF-8 text: bit b is 1 if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is exactly space and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    counts = np.zeros(BITS, np.int64)
    for s in range(0, n, _PIECE):
        part = words[s : min(s + _PIECE, n) + shingle_words - 1]
        shingles = zip(*(part[i:] for i in range(shingle_words))) if len(words) >= shingle_words else [words]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in shingles], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp long) of each row's whole text. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = b.column(1).cast(pa.binary()).to_pylist()
                fps = pa.array([fingerprint_of(t or b"", shingle_words) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), fps], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


# --- partitions and thresholds -------------------------------------------------------------------------------------


def bit_statistics(classes: DataFrame, cols: list[str]) -> list[tuple[np.ndarray, int]]:
    """For each column of fingerprints, the 64 x 64 matrix of joint set-bit counts over all rows, and their number; 2,081 sums a column reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, n = np.zeros((len(cols), BITS, BITS), np.int64), 0
        for batch in batches:
            for w in range(len(cols)):
                v = batch.column(w).to_numpy(zero_copy_only=False).astype("<i8")
                x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                joint[w] += np.rint(x.T @ x).astype(np.int64)
            n += batch.num_rows
        if n:
            i, j = np.triu_indices(BITS)
            keys = np.concatenate([w * BITS * BITS + i * BITS + j for w in range(len(cols))])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(np.concatenate([m[i, j] for m in joint]), n))], names=["k", "c"])

    joint, n = np.zeros((len(cols), BITS, BITS)), 0
    for r in classes.select(*cols).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        if r.k < 0:
            n = r.c
        else:
            w, i, j = r.k // (BITS * BITS), r.k // BITS % BITS, r.k % BITS
            joint[w, i, j] = joint[w, j, i] = r.c
    return [(m, n) for m in joint]


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each grows by the bit that correlates most with the bits it has."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        rest = sorted(left)
        own = [max(rest, key=lambda b: corr[b, rest].sum())]
        left.discard(own[0])
        while len(own) < width:
            b = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(b)
            left.discard(b)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _reach(t: int) -> int:
    """Flips that each side makes so that values at most t bits apart meet."""
    return (t + 1) // 2


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least summed cost; costs[i][t + 1] is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t1, extra in enumerate(row):
                k = s + t1 - 1
                if k not in step or c + extra < step[k][0]:
                    step[k] = (c + extra, [*ts, t1 - 1])
        best = step
    return best[total]


#: What a probe (a shuffled row) costs in comparisons of two fingerprints.
PROBE_COST = 250.0


def plan(classes: DataFrame, radius: int, bucket_limit: int, cols: tuple[str, ...] = ("fp",)) -> list[tuple[str, list[int], int]]:
    """(column, bits, threshold) of each partition that is probed, for each column of fingerprints the cheapest over several numbers of partitions."""
    stats = bit_statistics(classes, list(cols))
    sizes = range(1 if radius <= 2 else 2, min(radius + 2, 6) + 1)
    parts = [(w, m, bits) for w, (joint, n) in enumerate(stats) for m in sizes for bits in group_bits(joint, n, m)]
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col(cols[w]).bitwiseAND(F.lit(_mask(bits))).alias("v")) for k, (w, _, bits) in enumerate(parts)))
    c = F.col("c").cast("double")
    pairs = F.when(F.col("c") <= bucket_limit, c * (c - 1) / 2).otherwise(c * (BITS + 1))
    met = classes.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum(pairs).alias("pairs"))
    measured = {r.k: r.pairs for r in met.collect()}  # one row a partition
    out: list[tuple[str, list[int], int]] = []
    for w, (joint, n) in enumerate(stats):
        p = np.diag(joint) / max(n, 1)
        odds = 2 * p * (1 - p) / np.clip(1 - 2 * p * (1 - p), 1e-9, None)  # of one bit to differ
        found = []
        for m in sizes:
            groups, costs = [(k, bits) for k, (x, y, bits) in enumerate(parts) if (x, y) == (w, m)], []
            for k, bits in groups:
                near, row = np.array([1.0]), [0.0]
                for b in bits:
                    near = np.convolve(near, [1.0, odds[b]])
                for t in range(min(radius, len(bits), 4) + 1):
                    probes = n * sum(comb(len(bits), f) for f in range(_reach(t) + 1))
                    row.append(PROBE_COST * probes + measured.get(k, 0.0) * near[: 2 * _reach(t) + 1].sum())
                costs.append(row)
            if -m <= radius - m + 1 <= sum(len(r) - 2 for r in costs):
                cost, ts = allocate(costs, radius - m + 1)
                found.append((cost, m, [(cols[w], bits, t) for (_, bits), t in zip(groups, ts) if t >= 0]))
        out += min(found)[2]
    return out


# --- links ---------------------------------------------------------------------------------------------------------


def _flipped(value, bits: list[int], flips: int):
    """The masked value and all its variants with up to ``flips`` of the given bits changed."""
    masks = [_mask(list(c)) for f in range(1, flips + 1) for c in combinations(bits, f)]
    return F.concat(F.array(value), F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m))) if masks else F.array(value)


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within radius join, at most one for each value."""
    if len(values) == 2:
        a, b = values.tolist()
        return [(a, b)] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius else []
    u, left, out = values.view(np.uint64), np.ones(len(values), bool), []
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(u ^ u[j]) <= radius))
            left[near] = False
            todo.extend(near.tolist())
            out.extend((int(values[j]), x) for x in values[near].tolist())
    return out


def links(classes: DataFrame, radius: int = 2, bucket_limit: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most ``radius`` bits apart, enough to join all that are reachable.

    classes: one row for each distinct ``fp``. The edges form a forest within each bucket, so their number stays in
    proportion to the probes however dense a group is.
    """
    probes = None
    for k, (_, bits, t) in enumerate(plan(classes, radius, bucket_limit)):
        keys = _flipped(F.col("fp").bitwiseAND(F.lit(_mask(bits))), bits, _reach(t))
        own = classes.select(F.lit(k).alias("part"), F.explode(keys).alias("key"), "fp")
        probes = own if probes is None else probes.unionByName(own)
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("c")).where("c > 1")
    met = probes.join(sizes, ["part", "key"])

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verify(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: [{"a": a, "b": b} for a, b in forest(np.ascontiguousarray(g, np.int64), radius)])

    cold = met.where(F.col("c") <= bucket_limit).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    edges = cold.select(F.explode(verify("fps")).alias("e")).select("e.a", "e.b")
    # Hot buckets: values at most radius bits apart share a value that is at most half the radius from both.
    hot = met.where(F.col("c") > bucket_limit).select("fp").distinct()
    half = _reach(radius)
    balls = hot.select("fp", F.explode(_flipped(F.col("fp"), list(range(BITS)), half)).alias("ball"))
    if radius % 2 == 0:  # values in one ball are at most 2 * half = radius apart
        centres = balls.groupBy("ball").agg(F.min("fp").alias("a"), F.count("*").alias("c")).where("c > 1").select("ball", "a")
        star = balls.join(centres, "ball").select("a", F.col("fp").alias("b")).where("a != b")
    else:
        star = balls.alias("x").join(balls.alias("y"), "ball").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        star = star.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return edges.unionByName(star.distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, bucket_limit: int = 1024) -> DataFrame:
    """(id, fp, fingerprint, component_id): component_id is the smallest id reachable by links, the row's own included.

    Texts are lower-cased (A-Z) and cut to words at space and 0x09-0x0D; shingles of ``shingle_words`` words, repeats
    included; texts with fewer words have one shingle, texts without words (and null ones) the fingerprint 0, which links
    like any other. Rows of equal fingerprint are one class, so copies are never paired. Null ids keep their rows and
    are left out of the smallest id. Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-rows")
    classes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-classes")
    labels = connected_components(links(classes, radius, bucket_limit)).withColumnsRenamed({"node": "fp"})
    tied = classes.join(labels, "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = classes.join(labels.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # Written, so that the last join has a shuffle of its own on both sides and Spark can split a fingerprint of very many copies.
    ids = materialize(ids, "simhash-ids")
    return rows.join(ids, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicate documents: SimHash candidates, exact similarity of shingle sets -----------------------------------

WIDE = 4
#: Words of the wide fingerprint that the stage uses: the first INDEXED are probed, all are compared in the cells.
COMPARED, INDEXED = 3, 2
#: Rows of a block of fingerprints and shingles of a block of sets; a cell holds two blocks at most.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 200_000
#: Sets of a block of sets: a small set counts as BLOCK_SHINGLES / BLOCK_SETS shingles, so rows are bounded too.
BLOCK_SETS = 2048
_U = np.uint64


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """The distinct signed 64-bit hashes of a text's word shingles, rising; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    shingles = zip(*(words[i:] for i in range(shingle_words))) if len(words) >= shingle_words else [words]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(x), SEED) for x in shingles], np.uint64).view(np.int64))


def wide_words(shingles: np.ndarray, words: int) -> list[int]:
    """Signed words of a SimHash over a set of hashed shingles, each of which counts once; zeros for the empty set."""
    if not len(shingles):
        return [0] * words
    out = []
    for k in range(words):
        counts = np.zeros(BITS, np.int64)
        for s in range(0, len(shingles), _PIECE):
            h = shingles[s : s + _PIECE].view(np.uint64) * _U(2 * k + 1) + _U((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
            h ^= h >> _U(31)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def wide_fingerprint_of(text: bytes, shingle_words: int, words: int = WIDE) -> list[int]:
    """Signed words of a wide SimHash over the set of a text's shingles; zeros for a text without words."""
    return wide_words(shingle_set(text, shingle_words), words)


_WORDS = [f"w{i}" for i in range(COMPARED)]


def _hashed(docs: DataFrame, shingle_words: int, sets: bool) -> DataFrame:
    """The columns of docs but the text; cid, a hash of the text's shingle set, and w0; then the set itself, or the other words and n, its size.

    (cid, w0) stands for the set.
    """
    rest = [c for c in docs.columns if c != "text"]
    more = [T.StructField("cid", T.LongType()), *(T.StructField(w, T.LongType()) for w in (_WORDS[:1] if sets else _WORDS))]
    more.append(T.StructField("shingles", T.ArrayType(T.LongType())) if sets else T.StructField("n", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                own = [shingle_set(t or b"", shingle_words) for t in b.column("text").cast(pa.binary()).to_pylist()]
                cols = [pa.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in own], pa.uint64()).view(pa.int64())]
                words = [wide_words(x, 1 if sets else COMPARED) for x in own]
                cols += [pa.array([w[i] for w in words], pa.int64()) for i in range(1 if sets else COMPARED)]
                cols.append(pa.array(own, pa.list_(pa.int64())) if sets else pa.array([len(x) for x in own], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], names=[*rest, *(f.name for f in more)])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), *more]))


Part = tuple[int, list[int], int]  # the word, its bits, the flips that each side makes


def _index(classes: DataFrame, radius: int) -> list[Part]:
    """Partitions of the indexed words, with thresholds allocated as for ``links``."""
    names = _WORDS[:INDEXED]
    return [(names.index(c), bits, _reach(t)) for c, bits, t in plan(classes, radius, BLOCK_ROWS, tuple(names))]


def _probes(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """One row for each cell key of each node."""
    values = [F.struct(F.lit(k).alias("part"), _flipped(F.col(_WORDS[w]).bitwiseAND(F.lit(_mask(bits))), bits, flips).alias("values")) for k, (w, bits, flips) in enumerate(parts)]
    one = nodes.select("*", F.explode(F.array(*values)).alias("p"))
    return one.select(*nodes.columns, "p.part", F.explode("p.values").alias("value")).withColumn("key", F.xxhash64("part", "value"))


def _hot_keys(classes: DataFrame, parts: list[Part], block_rows: int) -> DataFrame:
    """(key, blocks): keys that may have more than ``block_rows`` rows, from counts of the values before flips."""
    found = None
    for k, (w, bits, flips) in enumerate(parts):
        cells = sum(comb(len(bits), f) for f in range(flips + 1))
        heavy = classes.groupBy(F.col(_WORDS[w]).bitwiseAND(F.lit(_mask(bits))).alias("v")).agg(F.count("*").alias("c")).where(F.col("c") > block_rows // cells)
        own = heavy.select(F.explode(_flipped(F.col("v"), bits, flips)).alias("v"), "c").groupBy(F.xxhash64(F.lit(k), "v").alias("key")).agg(F.sum("c").alias("c"))
        own = own.select("key", F.ceil((F.col("c") + block_rows) / block_rows).cast("int").alias("blocks"))
        found = own if found is None else found.unionByName(own)
    return materialize(found, "near-hot")


def _distances(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.bitwise_count(x[lo:hi, None, 0] ^ x[None, :, 0])
    for w in range(1, x.shape[1]):
        out += np.bitwise_count(x[lo:hi, None, w] ^ x[None, :, w])  # at most 192: a byte holds it
    return out


_STEP = 256


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (places) of a forest over a symmetric matrix of links, breadth first from the first row of each tree."""
    left, out = near.any(axis=1), []
    for i in np.flatnonzero(left).tolist():
        if left[i]:
            left[i], todo = False, [i]
            for j in todo:
                new = np.flatnonzero(near[j] & left).tolist()
                left[new] = False
                todo.extend(new)
                out.extend((j, k) for k in new)
    return out


_EDGE = "a struct<cid:long,w0:long>, b struct<cid:long,w0:long>"


def _edges(rows: Iterable[tuple[int, int, int, int]]) -> pa.RecordBatch:
    rows = list(rows)
    ends = [pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()), pa.array([r[i + 1] for r in rows], pa.int64())], names=["cid", "w0"]) for i in (0, 2)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _words_of(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)


def _asked(t: pa.Table) -> np.ndarray:
    """The pairs of a cell that are held against each other: of different labels, and in a cell of two blocks, of different blocks."""
    lab, own = t.column("lab").to_numpy(), t.column("own").to_numpy()
    asked = lab[:, None] != lab[None, :]
    if t.column("b1")[0].as_py() != t.column("b2")[0].as_py():
        asked &= own[:, None] != own[None, :]
    return asked


def _near(t: pa.Table, limit: int) -> np.ndarray | None:
    """The asked pairs of a cell that are at most ``limit`` bits apart; None if there are none."""
    x = _words_of(t)
    out = np.concatenate([_distances(x, s, s + _STEP) <= limit for s in range(0, len(x), _STEP)])
    if np.count_nonzero(out) == len(x):  # each row is near to itself only
        return None
    out &= _asked(t)
    return out if out.any() else None


def _compared(cells: DataFrame, near: Callable[[pa.Table], np.ndarray | None]) -> DataFrame:
    """Edges (a, b) of a forest over the links that ``near`` finds in each cell (key, b1, b2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["key", "b1", "b2"]):
            out = set()
            for t in found:
                linked = near(t) if t.num_rows > 1 else None
                if linked is not None:
                    ids = list(zip(t.column("cid").to_pylist(), t.column("w0").to_pylist()))
                    order = sorted(range(len(ids)), key=ids.__getitem__)  # cells of one group then have one root
                    edges = ((ids[order[i]], ids[order[j]]) for i, j in _spanning(linked[np.ix_(order, order)]))
                    out.update((*a, *b) if a < b else (*b, *a) for a, b in edges)
            if out:
                yield _edges(out)

    return cells.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(run, _EDGE).distinct()


def _grid(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows dealt to all pairs of blocks of their key, but for pairs of blocks of the key's commonest label.

    sizes: (key, others, commons, common): numbers of blocks of other rows and of those of the label ``common``. A group that
    is one label already thus costs no more than its rows times the blocks of other rows.
    """
    draw = F.xxhash64("cid", F.lit(5))
    common = F.col("lab") == F.col("common")
    own = F.when(common, F.col("others") + F.pmod(draw, "commons")).otherwise(F.pmod(draw, "others")).cast("int")
    last = F.when(common, F.col("others") - 1).otherwise(F.col("others") + F.col("commons") - 1)
    dealt = rows.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")}).drop("other", "others", "commons", "common")


def _sizes(rows: DataFrame, weight, block: int) -> DataFrame:
    """(key, others, commons, common) of rows (key, lab), with blocks of about ``block`` summed weight."""
    by = rows.groupBy("key", "lab").agg(F.sum(weight).alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "lab")).alias("d"))
    blocks = lambda c: F.greatest(F.ceil(c / block), F.lit(1)).cast("int")
    return by.select("key", blocks(F.col("all") - F.col("d.c")).alias("others"), blocks(F.col("d.c")).alias("commons"), F.col("d.lab").alias("common"))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (cid, w0, ...) with ``lab``, a hash of what the edges join."""
    roots = connected_components(edges).select(F.col("node.cid").alias("cid"), F.col("node.w0").alias("w0"), "root")
    return nodes.join(roots, ["cid", "w0"], "left").withColumn("lab", F.xxhash64(F.coalesce("root", F.struct("cid", "w0")))).drop("root")


def candidates(nodes: DataFrame, parts: list[Part], hot: DataFrame, limit: int, block_rows: int) -> DataFrame:
    """Edges (a, b) that join all nodes of which some cell holds a pair at most ``limit`` bits apart.

    The rows of a hot key first meet in random blocks; what those leave apart meets in a grid of blocks.
    """

    def near(t: pa.Table) -> np.ndarray | None:
        return _near(t, limit)

    own = F.xxhash64("cid", "w0").alias("lab")
    cold = _probes(nodes, parts).join(hot, "key", "left").select("key", "cid", *_WORDS, own, F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("cid", "key"), "blocks").cast("int")).alias("own"))
    met = materialize(_compared(cold.withColumns({"b1": F.col("own"), "b2": F.col("own")}), near), "near-met")
    if hot.isEmpty():
        return met
    told = _labels(nodes, met).select("cid", *_WORDS, "lab")
    rows = materialize(_probes(told, parts).join(hot.select("key"), "key").select("key", "cid", *_WORDS, "lab"), "near-hot-rows")
    return met.unionByName(materialize(_compared(_grid(rows, materialize(_sizes(rows, F.lit(1), block_rows), "near-grid")), near), "near-met"))


def shared_counts(sets: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """How many elements each asked pair of sets has in common (0 elsewhere)."""
    n = len(sets)
    i, j = np.nonzero(np.triu(asked | asked.T, 1))
    out = np.zeros((n, n), np.float32)
    if len(i) <= 4 * n:
        for a, b in zip(i.tolist(), j.tolist()):
            out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(place, minlength=len(values)) > 1
    column, kept = np.cumsum(often) - 1, often[place]
    place, row = column[place[kept]], row[kept]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for s in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(place, [s, s + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[lo:hi], place[lo:hi] - s] = 1
        out += m @ m.T
    return out


def near_links(classes: DataFrame, texts: DataFrame, shingle_words: int, percent: int, radius: int, limit: int, block_rows: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) between classes whose sets share ``percent`` of their union, enough to join all that are reachable.

    Candidates meet by the partitions of two SimHash words and differ in at most ``limit`` bits of all. What candidates join
    is a group; the sets of a group meet in one cell, or in blocks of ``block_shingles`` shingles: random ones first, and
    then a grid for what is left apart. A cell compares whole sets, so no pair is ever a row. A small set weighs as
    much as BLOCK_SETS of them fill a block, and sets too small to share ``percent`` with any other set are no candidates.
    """
    classes = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    parts = _index(classes, radius)
    slim = classes.select("cid", *_WORDS)
    groups = connected_components(candidates(slim, parts, _hot_keys(classes, parts, block_rows), limit, block_rows))
    groups = materialize(groups.select(F.col("node.cid").alias("cid"), F.col("node.w0").alias("w0"), F.xxhash64("root").alias("key")), "near-groups")
    needed = materialize(groups.join(classes.select("cid", "w0", F.col("first.row").alias("row")), ["cid", "w0"]).select("row"), "near-needed")
    sets = _hashed(texts.select("row", "text").join(needed, "row").select("text"), shingle_words, True).dropDuplicates(["cid", "w0"])
    sets = sets.join(slim, ["cid", "w0"]).join(groups, ["cid", "w0"])
    sets = materialize(sets.select("key", "cid", *_WORDS, "shingles", F.greatest(F.size("shingles"), F.lit(block_shingles // BLOCK_SETS)).alias("n")), "near-sets")
    sizes = sets.groupBy("key").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    sizes = materialize(sizes, "near-sizes")

    def near(t: pa.Table) -> np.ndarray | None:
        asked = _near(t, limit)
        if asked is None:
            return None
        own = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in t.column("shingles")]
        size = np.array([len(v) for v in own], np.float32)
        return asked & (shared_counts(own, asked) * (100 + percent) >= (size[:, None] + size[None, :]) * percent)

    columns = ["key", "cid", *_WORDS, "shingles"]
    # Groups of several blocks are dealt twice, so that the blocks of one deal tie those of the other together.
    deal = F.when(F.col("blocks") > 1, F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(3)))
    first = sets.join(sizes, "key").select(*columns, F.xxhash64("cid", "w0").alias("lab"), "blocks", F.explode(deal).alias("deal"))
    first = first.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cid", "deal"), "blocks").cast("int") * 2 + F.col("deal") - 3).otherwise(0))
    links_ = materialize(_compared(first.select(*columns, "lab", "own", F.col("own").alias("b1"), F.col("own").alias("b2")), near), "near-links")
    wide = sizes.where("blocks > 1").select("key")
    if wide.isEmpty():
        return links_
    rest = materialize(_labels(sets.join(wide, "key").select(*columns, "n"), links_), "near-rest")
    return links_.unionByName(materialize(_compared(_grid(rest.drop("n"), materialize(_sizes(rest, F.col("n"), block_shingles), "near-grid")), near), "near-links"))


def keep_one_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, radius: int = 11, limit: int = 48, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs that are the first of their group of near duplicates, with docs' columns.

    Texts are near duplicates if their sets of five-word shingles share ``percent`` of their union or more (the Jaccard
    similarity). Candidates come from SimHash over the sets: those within ``radius`` bits in one of two words of 64 bits all
    meet, most others too, and of 192 bits at most ``limit`` may differ; the sets of every candidate decide. A pair at 0.8
    differs in 9.7 bits a word. Groups are what links reach. The first row has the smallest id, null ids last; of rows with
    the same id and text one stays. Texts without words are copies of each other, and a text of fewer than five words is one
    shingle. Texts are taken whole however long; an empty table gives an empty result.
    """
    key = fresh(docs, "_key")
    text = F.col(text_col).cast("string")
    told = F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.lit(chr(0)), F.coalesce(F.concat(F.lit("t"), text), F.lit("n")))
    keyed = docs.withColumn(key, F.md5(told))
    texts = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("row"), text.alias("text"))
    rows = _hashed(texts, shingle_words, False)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = materialize(rows.groupBy("cid", *_WORDS).agg(F.min(place).alias("first"), F.max("n").alias("n")), "near-classes")
    links_ = near_links(classes, texts, shingle_words, percent, radius, limit, block_rows, block_shingles)
    roots = connected_components(links_).withColumnRenamed("root", "_root")
    named = classes.select(F.struct("cid", "w0").alias("node"), "first")
    firsts = named.join(roots, "node", "left").groupBy(F.coalesce("_root", "node").alias("root")).agg(F.min("first").alias("first"))
    firsts = materialize(firsts.select(F.col("first.row").alias(key)).distinct(), "near-firsts")
    copy = fresh(keyed, "_copy")
    kept = keyed.join(firsts, key).withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))))
    return kept.where(F.col(copy) == 1).select(*docs.columns)
