"""Alignment of two tokenizers over the same texts, and how many documents hold each linked pair of their tokens.

Both token sequences of a text cut the same bytes; where both cut, a group ends, and tokens whose bytes overlap are linked.
Pairs are counted by external spill counting. While texts are encoded, (pair, document) records gather in a bounded buffer
that is dealt by the radix of the first tokenizer's id and leaves as sorted, zstd-compressed runs: rows of binary data that
Spark writes and shuffles like any others, so a lost executor loses nothing. The runs of a radix, in bundles of bounded size,
are merged k ways with a heap and counted; the bundles' counts are summed. A second pass over the same bundles gets the
radix's pairs in order of the first id, so that each id's highest count falls out of the order, and streams what every
record contributes back to its document. A frequent id only makes more bundles.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.llm.arrow_groups import sorted_groups
from genoloom.llm.packing import _byte_letters, byte_encoder, token_bytes
from genoloom.session import materialize

RADIXES = 16  # parts of the pairs, by the first tokenizer's id
BUFFER = 1 << 20  # records that a task gathers before it writes runs
BUNDLE = 1 << 21  # records of the runs that are merged at once
BLOCK = 1 << 14  # records of a run's blocks
_CACHE_ENTRIES, _CACHE_CHARS = 400_000, 64
_BATCH_CHARS = 1 << 20


# --- the two tokenizers


@lru_cache(maxsize=2)
def byte_level_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file; special strings stand for themselves."""
    from tokenizers import Tokenizer

    own, letters = Tokenizer.from_file(path), _byte_letters()
    special = {i: t.content for i, t in own.get_added_tokens_decoder().items()}
    pieces = {i: special[i].encode() if i in special else bytes(letters[c] for c in p) for p, i in own.get_vocab().items()}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class Pieces(dict):
    """A sentencepiece model: ids, as little-endian 32-bit bytes, of a word behind a space; a bounded number of entries is kept."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.by_word = not any(k and c == "▁" and p[k - 1] != "▁" for p in names for k, c in enumerate(p))

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word, num_threads=1), "<i4").tobytes()
        if len(self) < _CACHE_ENTRIES and len(word) <= _CACHE_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """No piece has a space behind another character, so texts without double spaces are encoded word by word."""
        words = text.split(" ")
        if not self.by_word or "▁" in text or not all(words):
            return np.array(self.model.encode(text, num_threads=1), "<i4").tobytes()
        return b"".join([self[w] for w in words])


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Words(dict):
    """Both sides' ids, as little-endian 32-bit bytes, of a word behind a space; a bounded number of entries is kept.

    None for words that can't stand for themselves: empty ones, those that begin with white space (their space may join
    another token), and those that don't come back byte by byte from both sides.
    """

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.b, self.bytes_a = byte_encoder(path_a).encode_ordinary, _pieces(path_b), byte_level_pieces(path_a)

    def __missing__(self, word: str) -> tuple[bytes, bytes] | None:
        both = self.of(word)
        if len(self) < _CACHE_ENTRIES and len(word) <= _CACHE_CHARS:
            self[word] = both
        return both

    def of(self, word: str) -> tuple[bytes, bytes] | None:
        if not word or word[0].isspace() or "▁" in word or not self.b.by_word:
            return None
        a, b = self.encode_a(" " + word), self.b.model.encode(word, num_threads=1)
        target = (" " + word).encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in a]) != target or b"".join([self.b.bytes[i] for i in b]) != target:
            return None
        return np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()


@lru_cache(maxsize=2)
def _words(path_a: str, path_b: str) -> Words:
    return Words(path_a, path_b)


class Aligner:
    """Aligns batches of texts; see ``batch``."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a, self.b, self.words = path_a, _pieces(path_b), _words(path_a, path_b)
        self.bytes_a, self.bytes_b = byte_level_pieces(path_a), self.b.bytes
        self.len_a, self.len_b = (np.array([len(p) for p in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # how an id is written: first tokenizer inside a group and at its end, then the same for the second
        self.told = np.array([f"{i}{c}".encode() for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for c in ends for i in range(n)], object)
        self.bits_a, self.bits_b = len(self.bytes_a).bit_length(), len(self.bytes_b).bit_length()

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both id sequences, or empty ones if the text is null or empty or doesn't come back byte by byte from both.

        A text whose words all come back is its words' ids; any other one is encoded as a whole.
        """
        if text:
            told = list(map(self.words.__getitem__, text.split(" ")))
            if None not in told:
                return tuple(np.frombuffer(b"".join([x[k] for x in told]), "<i4") for k in (0, 1))
            target = b" " + text.encode("utf-8", "surrogatepass")
            a, b = np.frombuffer(token_bytes(" " + text, self.path_a), "<i4"), np.frombuffer(self.b.encode(text), "<i4")
            if self.len_b[b].sum() == len(target) == self.len_a[a].sum():
                if b"".join([self.bytes_b[i] for i in b.tolist()]) == target == b"".join([self.bytes_a[i] for i in a.tolist()]):
                    return a, b
        return np.empty(0, "<i4"), np.empty(0, "<i4")

    def batch(self, texts: list[str | None], with_groups: bool = False) -> tuple[dict, tuple[np.ndarray, ...]]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256 (and groups) of the texts, and records (text, a, b, links) of their distinct pairs.

        The sequences of all texts are laid end to end; both sides of a text have the same bytes, so a text's end is an end of
        both and the whole batch is one alignment.
        """
        got = [self.ids(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in got], np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in got]) if got else np.empty(0, np.int32) for k in (0, 1))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last_a, last_b = (y[np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))] == x if len(x) else np.empty(0, bool) for x, y in ((end_a, end_b), (end_b, end_a)))
        ends = np.sort(np.concatenate([end_a, end_b[~last_b]]), kind="stable")  # each stretch between two ends is one link
        link_a, link_b = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]
        text_ends = np.cumsum([self.len_a[x[0]].sum() for x in got])
        of = np.searchsorted(text_ends, ends)
        n = len(texts)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(np.searchsorted(text_ends, end_a[last_a]), minlength=n)[:n], "n_links": np.bincount(of, minlength=n)[:n]}
        # ids in writing order: a group's first side, then its second
        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        done_a, done_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + done_b[in_a]] = a + len(self.bytes_a) * last_a
        order[np.arange(len(b)) + (done_a[in_b] if len(b) else 0)] = b + 2 * len(self.bytes_a) + len(self.bytes_b) * last_b
        written, cuts = self.told[order].tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = [b"".join(written[s:e])[:-1] for s, e in zip(cuts[:-1], cuts[1:])]
        out["groups_sha256"] = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        if with_groups:
            out["groups"] = [g.decode() for g in groups]
        key, links = np.unique((of << self.bits_a + self.bits_b) | (link_a.astype(np.int64) << self.bits_b) | link_b, return_counts=True)
        return out, (key >> self.bits_a + self.bits_b, (key >> self.bits_b) & ((1 << self.bits_a) - 1), key & ((1 << self.bits_b) - 1), links.astype(np.int64))


# --- runs


def _shuffled(x: np.ndarray) -> bytes:
    """Differences of neighbours, equal bytes of all numbers side by side."""
    return np.diff(x, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unshuffled(b: memoryview, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, n).T.copy().view(np.int64)[:, 0])


def write_run(keys: np.ndarray, rows: np.ndarray, links: np.ndarray) -> bytes:
    """Records sorted by key as one run: blocks of (number, compressed size, zstd data)."""
    pack, out = zstandard.ZstdCompressor(level=1).compress, []
    for s in range(0, len(keys), BLOCK):
        part = [x[s : s + BLOCK] for x in (keys, rows, links)]
        data = pack(b"".join(map(_shuffled, part)))
        out.append(struct.pack("<II", len(part[0]), len(data)) + data)
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a run, one at a time."""
    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        n, size = struct.unpack_from("<II", run, at)
        data = memoryview(unpack(run[at + 8 : at + 8 + size], max_output_size=24 * n))
        yield tuple(_unshuffled(data[8 * n * k : 8 * n * (k + 1)], n) for k in range(3))
        at += 8 + size


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Records of all runs in order of their keys, in chunks; holds one block of each run.

    The heap holds the last key of each run's block: up to the least of them every run's records are at hand.
    """
    blocks = [read_run(r) for r in runs]
    held = dict(enumerate(next(b) for b in blocks)) if runs else {}
    heap = [(int(h[0][-1]), k) for k, h in held.items()]
    heapq.heapify(heap)
    while heap:
        front, _ = heap[0]
        parts = []
        for k, h in held.items():
            n = int(np.searchsorted(h[0], front, "right"))
            if n:
                parts.append(tuple(x[:n] for x in h))
                held[k] = tuple(x[n:] for x in h)
        used = []
        while heap and heap[0][0] == front:
            used.append(heapq.heappop(heap)[1])
        for k in used:
            following = next(blocks[k], None)
            if following is None:
                del held[k]
            else:
                held[k] = following
                heapq.heappush(heap, (int(following[0][-1]), k))
        keys, rows, links = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        yield keys[order], rows[order], links[order]


class _Spill:
    """A task's records; ``runs`` empties it into one run a radix."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray, rows: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((keys, rows, links))
        self.n += len(keys)

    def runs(self) -> Iterator[tuple[int, bytes, int]]:
        if self.n:
            keys, rows, links = (np.concatenate(x) for x in zip(*self.parts))
            radix = (keys >> 32) % RADIXES
            order = np.lexsort((rows, keys, radix))
            keys, rows, links, radix = keys[order], rows[order], links[order], radix[order]
            cuts = np.searchsorted(radix, np.arange(RADIXES + 1))
            for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > s:
                    yield r, write_run(keys[s:e], rows[s:e], links[s:e]), int(e - s)
            self.parts, self.n = [], 0


# --- Spark


def _aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A row for each document (row, id and its columns) and one for each run (radix, run, records)."""
    longs = ("n_a", "n_b", "n_groups", "n_links")
    texts = ("groups_sha256", *(["groups"] if with_groups else []))
    fields = [T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.StringType()) for c in texts)]
    fields += [T.StructField("radix", T.IntegerType()), T.StructField("run", T.BinaryType()), T.StructField("records", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, spill, at = Aligner(path_a, path_b), _Spill(), TaskContext.get().partitionId() << 33
        id_type = None

        def spilled() -> Iterator[pa.RecordBatch]:
            for r, data, n in spill.runs():
                cols = [pa.nulls(1, pa.int64()), pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in longs), *(pa.nulls(1, pa.string()) for _ in texts)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r], pa.int32()), pa.array([data], pa.binary()), pa.array([n], pa.int64())], names=[f.name for f in fields])

        for batch in batches:
            id_type = batch.column(0).type
            s = 0
            while s < batch.num_rows:
                e, chars, part = s, 0, []
                while e < batch.num_rows and e - s < 256 and chars < _BATCH_CHARS:
                    part.append(batch.column(1)[e].as_py())
                    chars += len(part[-1] or "")
                    e += 1
                got, (of, a, b, links) = aligner.batch(part, with_groups)
                m = e - s
                cols = [pa.array(np.arange(at, at + m)), batch.column(0).slice(s, m), *(pa.array(got[c], pa.int64()) for c in longs), *(pa.array(got[c], pa.string()) for c in texts)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=[f.name for f in fields])
                spill.add((a << 32) | b, at + of, links)
                at, s = at + m, e
                if spill.n >= BUFFER:
                    yield from spilled()
        yield from spilled()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def _counted(bundles: DataFrame) -> DataFrame:
    """(radix, a, b, n): how many records of a pair each bundle holds; a pair may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["radix", "bundle"]):
            for t in found:
                radix = t.column("radix")[0].as_py()
                for keys, _, _ in merge_runs(t.column("run").to_pylist()):
                    k, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), radix, np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["radix", "a", "b", "n"])

    return bundles.repartition("radix", "bundle").sortWithinPartitions("radix", "bundle").mapInArrow(run, "radix int, a int, b int, n long")


def _contributed(bundles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): what the records of each bundle add to each document."""
    per = bundles.select("radix", "bundle").distinct()
    told = pairs.join(per, "radix").select("radix", "bundle", "a", "b", "n", F.lit(None).cast("binary").alias("run"))
    both = told.unionByName(bundles.select("radix", "bundle", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("long").alias("n"), "run"))
    laid = both.repartition("radix", "bundle").sortWithinPartitions("radix", "bundle", F.col("a").asc_nulls_last(), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sorted_groups(batches, ["radix", "bundle"]):
            for t in found:
                pair = t.filter(t.column("a").is_valid())
                a, b, n = (pair.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
                keys = (a << 32) | b
                starts = np.flatnonzero(np.diff(a, prepend=-1))
                most = np.maximum.reduceat(n, starts)
                best = n == np.repeat(most, np.diff(starts, append=len(a)))
                rows, mine, sums = [], [], []
                for k, r, links in merge_runs([x for x in t.column("run").to_pylist() if x is not None]):
                    at = np.searchsorted(keys, k)
                    order = np.argsort(r, kind="stable")
                    cut = np.flatnonzero(np.diff(r[order], prepend=-1))
                    rows.append(r[order][cut])
                    mine.append(np.add.reduceat((links * best[at])[order], cut))
                    sums.append(np.add.reduceat((links * n[at])[order], cut))
                r = np.concatenate(rows)
                order = np.argsort(r, kind="stable")
                cut = np.flatnonzero(np.diff(r[order], prepend=-1))
                cols = [r[order][cut], *(np.add.reduceat(np.concatenate(x)[order], cut) for x in (mine, sums))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["row", "n_best", "count_sum"])

    return laid.mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, tokenizer_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for) of every document.

    A: the byte-level tokenizers file, on a space and the text; B: the sentencepiece model, which adds that space. Groups are
    written ``a1,a2|b1;a3|b2,b3``. n_best counts the links whose pair is held by as many documents as any pair of its A id,
    count_sum adds the documents of each link's pair. Texts that are null or empty, or that don't come back byte by byte from
    both, have no tokens: zeros and ''. Special strings are plain text. Repeated rows are documents of their own, also for
    the counts. Other columns are not carried along.
    """
    table = materialize(_aligned(docs, tokenizer_path, model_path, id_col, text_col, with_groups), "alignment")
    runs = table.where("run is not null").select("radix", "records", "run")
    # a radix's runs are dealt to as many bundles as its records fill: sixteen sums at most come to the driver
    sums = {r.radix: r.n for r in runs.groupBy("radix").agg(F.sum("records").alias("n")).collect()}
    bundles = F.get(F.array(*[F.lit(max(1, -(-sums.get(r, 0) // BUNDLE))) for r in range(RADIXES)]), F.col("radix"))
    dealt = runs.select("radix", F.pmod(F.xxhash64("run"), bundles).cast("int").alias("bundle"), "run")
    pairs = materialize(_counted(dealt).groupBy("radix", "a", "b").agg(F.sum("n").alias("n")), "alignment-pairs")
    back = _contributed(dealt, pairs).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = table.where("run is null").drop("radix", "run", "records").join(back, "row", "left")
    at = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", at("n_best"), at("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
