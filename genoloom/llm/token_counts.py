"""Token counts by greedy longest match over a vocabulary, in one pass over each word.

The vocabulary is a trie. Each node has a failure link, the node to go on from once the tokens that are certain by then
have been popped, and the number of those tokens; following links counts a word's tokens without building them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE_ENTRIES, _CACHE_CHARS = 400_000, 64


class LongestMatch:
    """Greedy longest-match counter. ``begin`` stands before every word; tokens with ``continuing`` in front go on within a word."""

    def __init__(self, vocabulary: Iterable[str], begin: str = "", continuing: str = ""):
        self.begin = begin
        self.next: list[dict[str, int]] = [{}]
        token = [False]

        def add(piece: str) -> int:
            u = 0
            for c in piece:
                v = self.next[u].get(c)
                if v is None:
                    v = self.next[u][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                u = v
            return u

        for piece in vocabulary:
            if piece and piece != continuing:
                token[add(piece)] = True
        self.inner = add(continuing)
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.popped = [0] * n
        todo = deque([0]) if self.inner == 0 else deque([0, self.inner])
        seen = {0, self.inner}
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if v in seen:
                    continue
                seen.add(v)
                if token[v]:
                    self.fail[v], self.popped[v] = self.inner, 1
                else:
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        count, z = count + self.popped[z], self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], count
                todo.append(v)

    def count(self, word: str) -> int:
        """The number of tokens of a word, or 0 if greedy longest match can't cover it."""
        step, fail, popped, u, n = self.next, self.fail, self.popped, 0, 0
        for c in self.begin + word:
            v = step[u].get(c)
            while v is None:
                if fail[u] < 0:
                    return 0
                n += popped[u]
                u = fail[u]
                v = step[u].get(c)
            u = v
        while u != self.inner:
            if fail[u] < 0:
                return 0
            n += popped[u]
            u = fail[u]
        return n


@lru_cache(maxsize=2)
def sentencepiece_matcher(path: str) -> LongestMatch:
    """A counter over the ordinary pieces of a sentencepiece model, whose words begin with U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return LongestMatch((sp.id_to_piece(i) for i in ids), begin="▁")


class _Counts(dict):
    def __init__(self, matcher: LongestMatch):
        self.of = matcher.count

    def __missing__(self, word: str) -> int:
        n = self.of(word)
        if len(self) < _CACHE_ENTRIES and len(word) <= _CACHE_CHARS:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(sentencepiece_matcher(path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of whole texts.

    Words are [^\\x20\\x09-\\x0D]+; a word that the vocabulary can't cover is one unknown token. Null and empty texts have 0
    of each. Frequent words are counted once by each worker, in a bounded cache. Repeated rows are counted each.
    """
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, rows = batch.slice(at, 256), []
                for text in b.column(1).to_pylist():
                    n = [counts[w] for w in _WORD.findall(text or "")]
                    rows.append((len(n), sum(n) + n.count(0), n.count(0)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=[f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))
