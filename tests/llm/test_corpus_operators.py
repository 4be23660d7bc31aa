import collections
import hashlib
import math
import random

import numpy as np
import pytest
from cases import clashing, odd_rows, rows, table
from pyspark.sql import types as T

from genoloom.llm.embedding_dedup import decode_e8, embedding_components
from genoloom.llm.suffix_dedup import anchors_of, maximal_repeats, remove_repeats

# --- suffix-array dedup


def covered(texts, n):
    """Which bytes of each text a repeated string of n bytes covers."""
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out.append(bytes(mark))
    return out


def expected_removal(data, n):
    texts = [(d[1] or "").encode() for d in data]
    exp = []
    for d, t, m in zip(data, texts, covered(texts, n)):
        kept = bytes(b for b, x in zip(t, m) if not x)
        runs = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        exp.append((d[0], len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(exp)


def shared(seed, n=70):
    """Texts over a small alphabet with planted passages, copies and periodic runs."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    passages = [word(rng.randrange(15, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = word(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            t += rng.choice(passages) + word(rng.randrange(0, 40))
        out.append(t)
    out += [out[0], out[0], out[5][:-3], "x" * 130, "ab" * 60, word(30) + "x" * 41 + word(9), "", None]
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("limit", [256, 1])
@pytest.mark.parametrize("data,n", [(shared(1), 20), (shared(2), 33), (odd_rows(), 40)])
def test_removal_equals_brute_force(spark, data, n, limit):
    got = remove_repeats(clashing(table(spark, data)), min_len=n, group_limit=limit)
    assert collections.Counter(tuple(r) for r in got.collect()) == expected_removal(data, n)


def test_removal_whole_documents(spark):
    data = rows(3, 40)
    got = remove_repeats(table(spark, data), with_kept=True).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == expected_removal(data, 200)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed
    assert remove_repeats(table(spark, [])).count() == 0


def test_anchors_hold_in_every_window_and_over_chunks(monkeypatch):
    from genoloom.llm import suffix_dedup as S

    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(3000))
    pos, keys, ctx = anchors_of(data, 40)
    assert all(((pos >= s) & (pos <= s + 20)).any() for s in range(len(data) - 39))
    monkeypatch.setattr(S, "_CHUNK", 256)
    assert all((x == y).all() for x, y in zip((pos, keys, ctx), anchors_of(data, 40)))


def test_maximal_repeats_equal_all_pairs():
    rng = random.Random(4)
    for _ in range(400):
        c = rng.randrange(2, 9)
        side = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 7)))
        lefts, rights = [side() for _ in range(c)], [side() for _ in range(c)]
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        need = rng.randrange(0, 9)
        pairs = [(common(lefts[i], lefts[j]), common(rights[i], rights[j]), i, j) for i in range(c) for j in range(i)]
        want = collections.defaultdict(lambda: (-1, -1))
        for a, b, i, j in pairs:
            if a + b >= need:
                for m in (i, j):
                    want[m] = (max(want[m][0], a), max(want[m][1], b))
        got = collections.defaultdict(lambda: (-1, -1))
        for a, b, members in maximal_repeats(lefts, rights, need):
            assert len({tuple(lefts[m][:a]) for m in members}) == 1 and len({tuple(rights[m][:b]) for m in members}) == 1
            for m in members:
                got[m] = (max(got[m][0], a), max(got[m][1], b))
        assert dict(got) == dict(want)


# --- embeddings

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(seed=0, groups=14, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(rng.integers(1, 12)):
            x = base + rng.standard_normal(dim) * rng.choice([0.004, 0.012, 0.02, 0.05])
            out.append((len(out) * 2, [float(np.float32(v)) for v in x * rng.choice([1, 3])], int(rng.integers(0, 2))))
    out += [(1000 + i, out[0][1], out[0][2]) for i in range(5)]
    out += [(2001, None, 1), (2003, [0.0] * dim, 1), (2005, [float("nan")] + [1.0] * (dim - 1), 1), (2007, [None] + [1.0] * (dim - 1), 1), (2009, [float("inf")] * dim, 1), (2011, out[0][1], None)]
    out += [(2013, [1.0, 2.0, 3.0], 1), (2015, [1.0, 2.0, 3.01], 1), (2017, [], 1), (2019, [1e30] * dim, 0), (2021, [1e30] * dim, 0)]
    return out


def expected_links(data):
    def fine(d):
        return d[0] is not None and d[2] is not None and d[1] and all(x is not None and math.isfinite(x) for x in d[1]) and any(d[1])

    def linked(a, b):
        if not (fine(a) and fine(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98

    near = {i: [j for j in range(len(data)) if j != i and linked(data[i], data[j])] for i in range(len(data))}
    exp, done = [], {}
    for i in sorted(near, key=lambda i: (data[i][0] is None, data[i][0] or 0)):
        if i not in done:
            todo, done[i] = [i], data[i][0]
            while todo:
                for j in near[todo.pop()]:
                    if j not in done:
                        done[j] = data[i][0]
                        todo.append(j)
        exp.append((data[i][0], len(near[i]), done[i], data[i][0] is not None and done[i] == data[i][0]))
    return exp


@pytest.mark.parametrize("block", [128, 3])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    from genoloom.llm import embedding_dedup as E

    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    data = vectors()
    got = embedding_components(spark.createDataFrame(data, VECTORS).selectExpr("*", "1 AS cid", "2 AS rows", "3 AS key", "4 AS v")).collect()
    key = lambda t: (str(t[0]), t[1], str(t[2]), t[3])
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, expected_links(data)))


def test_embeddings_odd_ids_and_empty(spark):
    v = [1.0] + [0.5] * 63
    data = [(None, v, 1), (3, v, 1), (3, v, 1), (5, v, 1)]
    got = sorted((tuple(r) for r in embedding_components(spark.createDataFrame(data, VECTORS)).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False)], key=str)
    assert embedding_components(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_at_the_threshold():
    from genoloom.llm.embedding_dedup import cell_keys

    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rng.standard_normal(x.shape)
    n -= (n * x).sum(axis=1)[:, None] * x
    n /= np.linalg.norm(n, axis=1)[:, None]
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * n
    z = np.zeros(len(x), np.uint64)
    a, b = (cell_keys(v, z, 12, 2.0, 5) for v in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.999


def test_e8_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (300, 8))
    near, other = decode_e8(x)
    for p in (near, other):
        assert ((p % 2).min(axis=1) == (p % 2).max(axis=1)).all() and ((p.sum(axis=1) // 2) % 2 == 0).all()
    d = lambda p: ((x - p / 2) ** 2).sum(axis=1)
    assert (d(near) <= d(other)).all() and d(near).max() <= 1 + 1e-9
    for _ in range(300):  # no lattice point close by is nearer
        step = rng.integers(-1, 2, (300, 8)) * 2
        step[:, 0] += 2 * ((step.sum(axis=1) // 2) % 2)
        assert (d(near + step) >= d(near) - 1e-9).all()
