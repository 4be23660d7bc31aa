"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random onto blocks of eight dimensions, and each block is decoded to its nearest point of
the E8 lattice; the points of a table's blocks, with the label, make its cell. Several tables are used, and in each the
neighbouring cells (the nearest point of the lattice's other coset, one block at a time) are probed as well. Vectors that
share a cell are compared by cosine in double precision; a pair that shares several cells is counted in the least of them.
Large cells are compared in blocks, so no task holds one whole, and equal vectors are one class and never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.operators.components import connected_components
from genoloom.session import materialize

BLOCKS = 2
BLOCK_ROWS = 128
_U = np.uint64


def _nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points with whole coordinates of even sum, and squared distances."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    err = x[odd] - f[odd]
    k = np.abs(err).argmax(axis=1)
    at = np.arange(len(odd))
    f[odd, k] += np.where(err[at, k] >= 0, 1.0, -1.0)
    return f, ((x - f) ** 2).sum(axis=1)


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, neighbour): the nearest E8 point of each row and the nearest one of the other coset, both doubled to integers."""
    whole, dw = _nearest_d8(x)
    half, dh = _nearest_d8(x - 0.5)
    half += 0.5
    first = (dw <= dh)[:, None]
    return np.rint(2 * np.where(first, whole, half)).astype(np.int64), np.rint(2 * np.where(first, half, whole)).astype(np.int64)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """(tables, dim, 8 * BLOCKS) matrices with orthonormal columns as far as dim allows, scaled to keep lengths on average."""
    rng = np.random.default_rng(seed)
    wide = 8 * BLOCKS
    out = []
    for _ in range(tables):
        g = rng.standard_normal((dim, wide))
        out.append(np.linalg.qr(g)[0] * np.sqrt(dim / wide) if dim >= wide else g / np.sqrt(wide))
    return np.stack(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def cell_keys(units: np.ndarray, labels: np.ndarray, tables: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables * (1 + BLOCKS)) keys of the home cell and the probed neighbours; labels: 64-bit hashes."""
    dim = units.shape[1]
    rng = np.random.default_rng(seed + 1)
    weights = rng.integers(0, 2**63, (tables, BLOCKS, 8), dtype=np.uint64) * _U(2) + _U(1)
    cols = []
    for t, m in enumerate(_projections(dim, tables, seed)):
        y = units @ m * scale
        parts = []
        for b in range(BLOCKS):
            points = decode_e8(y[:, 8 * b : 8 * b + 8])
            parts.append([(p.astype(np.uint64) * weights[t, b]).sum(axis=1, dtype=np.uint64) for p in points])
        salt = _mix(labels ^ _U(t + 1)) + _U(dim)
        for probe in range(BLOCKS + 1):
            h = sum((parts[b][1 if probe == b + 1 else 0] for b in range(BLOCKS)), np.zeros(len(units), np.uint64))
            cols.append(_mix(_mix(h) ^ salt))
    return np.stack(cols, axis=1).view(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _hashed(classes: DataFrame, tables: int, scale: float, seed: int) -> DataFrame:
    """classes (cid, lab, dim, v) with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):  # vectors of different length never meet: the length is part of the key
                b = batch.take(pa.array(np.flatnonzero(dims == d)))
                v = _matrix(b.column("v")).astype(np.float64)
                v /= np.linalg.norm(v, axis=1)[:, None]
                keys = cell_keys(v, b.column("lab").to_numpy().view(np.uint64), tables, scale, seed)
                yield b.append_column("keys", pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel())))

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def _first_shared(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the least key that the rows of a and b share."""
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 4096):
        x, y = a[s : s + 4096], b[s : s + 4096]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[s : s + 4096] = np.where(shared, x, np.iinfo(np.int64).max).min(axis=1) == key
    return out


def _forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    left, out = linked.any(axis=1), []
    for i in np.flatnonzero(left):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                j = todo.pop()
                near = np.flatnonzero(linked[j] & left)
                left[near] = False
                todo.extend(near.tolist())
                out.extend((int(ids[j]), int(x)) for x in ids[near])
    return out


def _compare(cells: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n): n links of class a for b null; an edge of a forest otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["key", "b1", "b2"]):
            a, b, n = [], [], []
            for t in found:
                if t.num_rows < 2:
                    continue
                v, keys = _matrix(t.column("v")).astype(np.float64), _matrix(t.column("keys"))
                norm = np.linalg.norm(v, axis=1)
                ids, rows, own = t.column("cid").to_numpy(), t.column("rows").to_numpy(), t.column("own").to_numpy()
                pairs = (v @ v.T) / (norm[:, None] * norm[None, :]) >= threshold
                pairs &= own[:, None] < own[None, :] if t.column("b1")[0].as_py() != t.column("b2")[0].as_py() else np.triu(np.ones_like(pairs), 1)
                i, j = np.nonzero(pairs)
                ok = _first_shared(keys[i], keys[j], t.column("key")[0].as_py())
                i, j = i[ok], j[ok]
                if len(i):
                    linked = np.zeros_like(pairs)
                    linked[i, j] = linked[j, i] = True
                    k = np.flatnonzero(linked.any(axis=1))
                    a.extend(ids[k].tolist())
                    b.extend([None] * len(k))
                    n.extend((linked[k] @ rows).tolist())
                    for x, y in _forest(linked, ids):
                        a.append(x)
                        b.append(y)
                        n.append(0)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    return cells.mapInArrow(run, "a long, b long, n long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = 12, scale: float = 2.0, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Two rows link if their labels are equal and not null, their vectors have the same length, they share a probed cell in
    some table and their cosine is at least ``threshold``. Null vectors, zero vectors and vectors with a null or
    non-finite component link with nothing, nor do rows with a null id; they are components of their own. n_links counts
    rows, so k equal vectors have k - 1 links each besides their others.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & fine, F.lit(False))
    largest = F.array_max(F.transform(v, F.abs))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(ok, F.xxhash64(F.col(label_col), v)).alias("cid"), F.when(ok, F.xxhash64(label_col)).alias("lab"), F.when(ok, F.transform(v, lambda x: x / largest)).alias("v"))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.first("lab").alias("lab"), F.first("v").alias("v"), F.count("*").alias("rows"), F.min("id").alias("first"))
    classes = materialize(_hashed(classes.withColumn("dim", F.size("v")), tables, scale, seed), "embedding-classes")
    probes = classes.select("cid", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = probes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("int")
    met = probes.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(3)), "blocks").cast("int"))
    dealt = met.select("cid", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cid", "key", "own", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    cells = dealt.join(classes.select("cid", "rows", "v", "keys"), "cid").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    found = materialize(_compare(cells, threshold), "embedding-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    told = classes.select("cid", "rows", "first").join(roots, "cid", "left").join(counts, "cid", "left")
    told = materialize(told.select("cid", "first", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "embedding-told")
    least = told.groupBy("root").agg(F.min("first").alias("component_id"))
    told = told.join(least, "root").where("n_links > 0").select("cid", "n_links", "component_id")
    out = rows.select("id", "cid").join(told, "cid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
