"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.session import materialize

END_ID = 1
_CACHE_ENTRIES, _CACHE_CHARS = 400_000, 64


def _byte_letters() -> dict[str, int]:
    """The letters in which a byte-level vocabulary file writes bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """An encoder with the ids of the tokenizers file at ``path`` (byte-level, no prefix space, ids in merge order).

    The ids are those of the tokenizers library; tests hold them against it. Special strings are ordinary text here;
    ``token_bytes_with_added`` knows them.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in own.get_vocab().items() if piece not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Chunks(dict):
    """Ids, as little-endian 32-bit bytes, of a chunk that follows a space; a bounded number of entries is kept."""

    def __init__(self, encoder):
        self.encode = encoder.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < _CACHE_ENTRIES and len(word) <= _CACHE_CHARS:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    return _Chunks(byte_encoder(path))


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as little-endian 32-bit bytes.

    No token crosses a space that stands before a character that is not white space, so texts are encoded chunk by chunk
    there and frequent chunks come from a bounded cache; a text with other spaces is encoded as a whole.
    """
    head, *rest = text.split(" ")
    chunks = _chunks(path)
    if rest and (any(not w or w[0].isspace() for w in rest)):
        return np.array(chunks.encode(text), "<u4").tobytes()
    return np.array(chunks.encode(head), "<u4").tobytes() + b"".join([chunks[w] for w in rest])


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """A pattern that finds the file's added tokens, longer ones first, and their ids."""
    from tokenizers import Tokenizer

    found = {t.content: (i, t) for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
    for _, t in found.values():
        if t.lstrip or t.rstrip or t.single_word:
            raise ValueError(f"added token with lstrip, rstrip or single_word: {t.content!r}")
    listed = "|".join(re.escape(c) for c in sorted(found, key=len, reverse=True))
    return re.compile(f"({listed})") if listed else None, {c: np.array([i], "<u4").tobytes() for c, (i, _) in found.items()}


def token_bytes_with_added(text: str, path: str) -> bytes:
    """As ``token_bytes``, but added tokens (special strings) of the file get their own ids, as the library gives by default."""
    pattern, ids = _added(path)
    parts = pattern.split(text) if pattern else [text]
    return b"".join([ids[x] if i % 2 else token_bytes(x, path) for i, x in enumerate(parts)])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of capacity: id, start, length, ids_crc32, doc_tokens (and ids).

    With ``added_tokens``, the file's special strings get their own ids in texts (the library's default); else they are
    ordinary text (the library's ``encode_special_tokens``).
    """
    encode = token_bytes_with_added if added_tokens else token_bytes
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    got = encode(text or "", tokenizer_path) + end
                    n = len(got) // 4
                    for s in range(0, n, capacity):
                        part = got[4 * s : 4 * (s + capacity)]
                        row.append(i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                cols = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


class TournamentTree:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger room below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for ``need``; the room is taken."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        had = room[i]
        room[i] = had - need
        at, i = i - self.leaves, i >> 1
        while i:
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
            i >>= 1
        return at, had


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, in the order given; with lengths falling this is first-fit decreasing."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    placed = [tree.place(n) for n in lengths]
    return [b for b, _ in placed], [capacity - had for _, had in placed]


def pack(cut: DataFrame, capacity: int = 2048, group_pieces: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns start, length and any others).

    Every piece draws a group; groups hold about ``group_pieces`` pieces whatever the input's size or its hot documents,
    and are packed each on its own: falling lengths, first bin with room. Pieces as long as the capacity fill a sequence.
    Offsets are gapless from 0 in each sequence. An empty table stays empty.
    """
    drawn = materialize(cut.withColumn("_draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(11))), "pack-pieces")
    groups = max(1, -(-drawn.count() // group_pieces))
    grouped = drawn.withColumn("_group", F.pmod("_draw", F.lit(groups)))
    laid = grouped.repartition("_group").sortWithinPartitions("_group", F.desc("length"), "_draw")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["_group"]):
            for t in found:
                bins, offsets = first_fit(t.column("length").to_pylist(), capacity)
                base = t.column("_group")[0].as_py() << 32
                out = t.drop_columns(["_draw", "_group"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
                yield from out.combine_chunks().to_batches()

    return laid.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """Packed pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    Null and empty texts are their end id alone. Repeated rows are packed once each.
    """
    return pack(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids, added_tokens), capacity, group_pieces)
