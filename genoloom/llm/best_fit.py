"""Packing of tokenised documents into few sequences: bounded-space online best-fit.

Pieces arrive in streams. A stream keeps a fixed number of bins open, in a bitset whose bit f says that a bin with f free
places is open; a piece goes where the least room is left over (the lowest set bit from its length up), and when too many
bins are open the fullest one is closed. Bins that are open when a stream ends hand their pieces on to the next level, which
has fewer streams, so the waste is that of one stream's open bins however many streams there were. Pieces arrive in waves in
random order, the longest of a wave first. Only descriptors of pieces (and ids, where asked for) are dealt out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.llm.packing import token_bytes, token_bytes_with_added
from genoloom.session import materialize

END_ID = 0


class OpenBins:
    """At most ``limit`` open bins, found by free room."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.rooms, self.by_room, self.open, self.made = 0, {}, 0, 0

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        at = bins.pop()
        if not bins:
            self.rooms ^= 1 << room
        self.open -= 1
        return at

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``need`` places; full bins and, beyond the limit, the fullest one are closed."""
        fitting = self.rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = self._take(room)
        else:
            room, at = self.capacity, self.made
            self.made += 1
        left = room - need
        if left:
            self.by_room.setdefault(left, []).append(at)
            self.rooms |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.rooms & -self.rooms).bit_length() - 1)
        return at, self.capacity - room

    def still_open(self) -> list[int]:
        return [b for bins in self.by_room.values() for b in bins]


def best_fit(lengths: np.ndarray, capacity: int, open_bins: int, wave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, whether the bin is open at the end) of each piece of a stream, given in its order of arrival."""
    n = len(lengths)
    order = np.lexsort((-lengths, np.arange(n) // wave))
    bins, placed = OpenBins(capacity, open_bins), np.empty((n, 2), np.int64)
    placed[order] = [bins.place(x) for x in lengths[order].tolist()] if n else np.empty((0, 2))
    left = np.zeros(bins.made, bool)
    left[bins.still_open()] = True
    return placed[:, 0], placed[:, 1], left[placed[:, 0]]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids with the end id; longer ones are cut, the first piece is the short one.

    With ``added_tokens``, the file's special strings get their own ids in texts (the library's default); else they are
    ordinary text.
    """
    encode = token_bytes_with_added if added_tokens else token_bytes
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, cuts, crc, ids = [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    got = encode(text or "", tokenizer_path) + end
                    n = len(got) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n])):
                        part = got[4 * s : 4 * e]
                        row.append(i)
                        cuts.append((k, s, e - s))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                k, s, n = zip(*cuts)
                cols = [b.column(0).take(pa.array(row, pa.int32())), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, crc))]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def _numbered(cut: DataFrame) -> DataFrame:
    """cut with _row, a number of its own for each row once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            yield b.append_column("_row", pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField("_row", T.LongType())]))


def _level(rows: DataFrame, streams: int, level: int, capacity: int, open_bins: int, wave: int) -> DataFrame:
    """rows with sequence_id (the _row of the bin's first piece), offset and _open, each stream packed on its own."""
    draw = F.xxhash64("_row", F.lit(level))
    laid = rows.withColumn("_draw", draw).withColumn("_stream", F.pmod("_draw", F.lit(streams))).repartition("_stream").sortWithinPartitions("_stream", "_draw", "_row")
    fields = [*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["_stream"]):
            for t in found:
                bins, offset, left = best_fit(t.column("length").to_numpy(), capacity, open_bins, wave)
                first = np.flatnonzero(offset == 0)
                lead = np.empty(len(first), np.int64)
                lead[bins[first]] = t.column("_row").to_numpy()[first]
                out = t.drop_columns(["_draw", "_stream"]).append_column("sequence_id", pa.array(lead[bins])).append_column("offset", pa.array(offset)).append_column("_open", pa.array(left))
                yield from out.combine_chunks().to_batches()

    return laid.mapInArrow(run, T.StructType(fields))


def pack_best_fit(cut: DataFrame, capacity: int = 2048, open_bins: int = 1024, stream_pieces: int = 4096, wave: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (a column ``length`` from 1 to capacity, and any others).

    Pieces as long as the capacity are a sequence each. The others go through levels of about ``stream_pieces`` pieces a
    stream; a level takes what the bins left open hold, until one stream takes all or a level leaves over half open. All
    state of a stream is its open bins and one wave. Offsets are gapless from 0 in each sequence. Repeated rows are packed
    once each; an empty table stays empty.
    """
    rows = materialize(_numbered(cut), "best-fit-pieces")
    whole = rows.where(F.col("length") == capacity).select(*cut.columns, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left = [whole], rows.where(F.col("length") < capacity)
    n, level = left.count(), 0
    while n:
        streams = max(1, round(n / stream_pieces))
        packed = materialize(_level(left, streams, level, capacity, open_bins, wave), f"best-fit-{level}")
        still = packed.where("_open").count() if streams > 1 else 0
        if still > n // 2:
            still = 0
        done.append((packed.where("not _open") if still else packed).select(*cut.columns, "sequence_id", "offset"))
        left, n, level = packed.where("_open").select(*rows.columns), still, level + 1
    return reduce(DataFrame.unionByName, done)


def pack_documents_best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = 1024, stream_pieces: int = 4096, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """Packed pieces: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids).

    Null and empty texts are their end id alone. Repeated rows are packed once each. Other columns are not carried along.
    """
    return pack_best_fit(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids, added_tokens), capacity, open_bins, stream_pieces)
