"""Values carried along ordered groups over range blocks, so that a hot group is never one task's.

Rows are range-partitioned by group and order and written once; a block holds neighbouring rows of one or more groups. Each
value is formed inside the blocks, and what the blocks before (or after) hold of the same group is added from a small table
with a row for each block and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.session import materialize

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
#: Where a value's rows lie: (rows after the row's own place, first row offset).
_REACH = {"before": (False, -1), "upto": (False, 0), "from": (True, 0), "after": (True, -1)}


def running(df: DataFrame, groups: list[str], order: list[str], values: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """df with a column for each value {name: (kind, column, reach)}.

    kind: sum, max, min, or last (the nearest value that is not null). reach: the rows of the group ``before`` the row,
    ``upto`` it, ``from`` it on, or ``after`` it, in ascending order of the named columns (nulls first). A sum over no rows is 0, other
    kinds are null. Rows that tie in every ordering column come in some order; group columns may be null.
    """
    keyed = df.withColumn("_group", F.struct(*groups))
    for name, (_, column, _) in values.items():
        keyed = keyed.withColumn(f"_v_{name}", column)
    up, down = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    blocks = materialize(keyed.repartitionByRange("_group", *up).withColumn("_block", F.spark_partition_id()), "running")
    totals, local = [], {}
    for name, (kind, _, reach) in values.items():
        after, first = _REACH[reach]
        inner = Window.partitionBy("_block", "_group").orderBy(*(down if after else up)).rowsBetween(Window.unboundedPreceding, first)
        local[name] = _AGGREGATES[kind](f"_v_{name}").over(inner)
        if kind == "last":  # a block's nearest value is its last one for rows behind it, its first one for rows before it
            end = (F.min_by if after else F.max_by)(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.struct(*order)))
        else:
            end = _AGGREGATES[kind](f"_v_{name}")
        totals.append(end.alias(f"_t_{name}"))
    sums = blocks.groupBy("_block", "_group").agg(*totals)
    outer = {}
    for name, (kind, _, reach) in values.items():
        by = F.desc("_block") if _REACH[reach][0] else F.asc("_block")
        outer[f"_o_{name}"] = _AGGREGATES[kind](f"_t_{name}").over(Window.partitionBy("_group").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select("_block", "_group", *(c.alias(n) for n, c in outer.items()))
    out = blocks.select("*", *(c.alias(f"_l_{n}") for n, c in local.items())).join(carried, ["_block", "_group"])
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least, "last": F.coalesce}
    told = [both[kind](F.col(f"_l_{n}"), F.col(f"_o_{n}")).alias(n) for n, (kind, _, _) in values.items()]
    return out.select(*(c for c in df.columns if c not in values), *told)


def whole_blocks(batches: Iterator[pa.RecordBatch], key: str = "_block") -> Iterator[pa.Table]:
    """Tables of equal integer key from batches that are sorted by it; holds one of them and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            k = batch.column(key).to_numpy()
            n = at + int(np.searchsorted(k[at:], k[at], "right"))
            if held and held[-1].column(key)[0].as_py() != k[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, n - at))
            at = n
    if held:
        yield pa.Table.from_batches(held)


def segments(table: pa.Table, key: str) -> list[tuple[int, int]]:
    """(first row, row behind the last) of each run of one value, null included."""
    codes = table.column(key).combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    i = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


# --- a choice of places that don't touch


def _hops(lo: np.ndarray, least: np.ndarray, reach: int) -> np.ndarray:
    """The next place that may be chosen after each one, within a segment; its length where there is none."""
    return np.maximum(np.searchsorted(least, lo + reach, "right"), np.arange(1, len(lo) + 1))


def _exits(lo: np.ndarray, least: np.ndarray, reach: int) -> np.ndarray:
    """The last place of the chain that begins at each one, by pointer doubling."""
    hop = _hops(lo, least, reach)
    at = np.where(hop < len(lo), hop, np.arange(len(lo)))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def choose_disjoint(rows: DataFrame, key: str, order: list[str], reach: int, lo: str = "lo", least: str = "least") -> DataFrame:
    """The rows that a walk along each group keeps: the first, then always the next one whose ``least`` is above the kept row's ``lo`` + reach.

    ``lo`` and ``least`` must not fall along the order; a null ``least`` is above all. A block tells, for its first and last
    group, where a walk that enters with any kept row leaves it (a walk's chains soon meet, so that is short); these are put
    together group by group, and then every block is walked from its own entrance.
    """
    most = np.iinfo(np.int64).max
    plain = rows.withColumn("_lo", F.col(lo).cast("long")).withColumn("_least", F.coalesce(F.col(least).cast("long"), F.lit(int(most))))
    blocks = materialize(plain.repartitionByRange(key, *order).withColumn("_block", F.spark_partition_id()), "choose")
    laid = blocks.repartition("_block").sortWithinPartitions("_block", F.col(key), *order)
    kind, columns = rows.schema[key].dataType.simpleString(), rows.columns

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            own = segments(t, key)
            at, above, exits = [], [], []
            for s, e in {own[0], own[-1]}:
                lo_, least_ = (t.column(c).to_numpy()[s:e] for c in ("_lo", "_least"))
                x = _exits(lo_, least_, reach)
                ends = np.concatenate([np.flatnonzero(x[1:] != x[:-1]), [len(x) - 1]])
                at += [s] * (len(ends) + 1)
                above += [None, *least_[ends].tolist()]
                exits += [int(lo_[x[0]]), *lo_[x[ends]].tolist()]
            yield pa.RecordBatch.from_arrays([t.column(key).combine_chunks().take(pa.array(at)), pa.array([t.column("_block")[0].as_py()] * len(at), pa.int32()), pa.array(above, pa.int64()), pa.array(exits, pa.int64())], names=["_k", "_b", "above", "exit"])

    told = laid.select(key, "_block", "_lo", "_least").mapInArrow(summaries, f"_k {kind}, _b int, above long, exit long")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, state, entry, done = object(), None, None, None, False
        for batch in batches:
            ks, bs, entries = [], [], []
            for i, (k, b, above, leaves) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", "_b", "above", "exit")))):
                if k != group:
                    group, block, state = k, None, None
                if b != block:
                    block, entry, done = b, state, False
                    ks.append(i)
                    bs.append(b)
                    entries.append(entry)
                if not done and ((above is None) if entry is None else (above is not None and above > entry + reach)):
                    state, done = leaves, True
            if ks:
                yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(ks)), pa.array(bs, pa.int32()), pa.array(entries, pa.int64())], names=["_k", "_b", "_entry"])

    entries = told.repartition("_k").sortWithinPartitions("_k", "_b", F.col("above").asc_nulls_first()).mapInArrow(compose, f"_k {kind}, _b int, _entry long")
    entered = blocks.join(entries, (F.col("_block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k", "_b")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            keep = []
            for s, e in segments(t, key):
                lo_, least_ = (t.column(c).to_numpy()[s:e] for c in ("_lo", "_least"))
                hop, entry = _hops(lo_, least_, reach), t.column("_entry")[s].as_py()
                i = 0 if entry is None else int(np.searchsorted(least_, entry + reach, "right"))
                while i < e - s:
                    keep.append(s + i)
                    i = int(hop[i])
            if keep:
                yield from t.select(columns).take(pa.array(keep)).combine_chunks().to_batches()

    return entered.repartition("_block").sortWithinPartitions("_block", F.col(key), *order).mapInArrow(walk, rows.schema)
