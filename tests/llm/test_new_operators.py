"""Centroid clustering, bounded-space packing and cross-tokenizer alignment against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import clashing, odd_rows, rows, table
from genoloom.llm.best_fit import OpenBins, best_fit, pack_best_fit, pack_documents_best_fit
from genoloom.llm import token_alignment
from genoloom.llm.centroids import Tighten, cluster_vectors, geometric_drift
from genoloom.llm.token_alignment import Pieces, align_tokenizers, merge_runs, read_run, write_run

# --- centroid clustering


def plain_kmeans(rows, k, rounds, dim, scale=64, seed="1"):
    """The contract in whole Python numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    if not seeds:
        return collections.Counter()
    centres = [v for _, v in seeds]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        of = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), o in zip(kept, of) if o == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [far(v, centres[o]) for (_, v), o in zip(kept, of)]
    per = collections.Counter()
    for o, x in zip(of, d):
        per[o] += x
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, o, x, per[o], sum(d), digest[o]) for (i, _), o, x in zip(kept, of, d))


def vectors(seed, n, dim, groups=9, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    out = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]
    return out + [out[0], out[0], out[3], (None, out[5][1]), (n + 1, None), (n + 2, []), (n + 3, [0.0] * dim), (n + 4, [1.0] * (dim - 1)), (n + 5, [float("nan")] + [1.0] * (dim - 1)), (n + 6, [None] + [1.0] * (dim - 1)), (n + 7, [float("inf")] * dim)]


def vector_table(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)


@pytest.mark.parametrize("seed,n,dim,k,rounds", [(1, 300, 64, 16, 3), (3, 9, 3, 16, 3), (4, 150, 2, 4, 0), (5, 120, 1, 12, 5)])
def test_clusters_equal_plain_kmeans(spark, seed, n, dim, k, rounds):
    data = vectors(seed, n, dim, spread=0.01 if seed == 5 else 0.4)
    got = cluster_vectors(vector_table(spark, data), k=k, rounds=rounds, dim=dim)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_kmeans(data, k, rounds, dim)


def test_clusters_of_large_components_and_equal_vectors(spark):
    rng = random.Random(8)
    data = [(i, [rng.choice([-1, 1]) * 2.0**20 * rng.random() for _ in range(4)]) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]
    got = cluster_vectors(vector_table(spark, data), k=5, dim=4)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_kmeans(data, 5, 3, 4)
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(vector_table(spark, [(1, [1e30] * 4)]), dim=4)


def test_clusters_of_nothing(spark):
    for data in ([], [(1, None)], [(None, [1.0, 2.0])]):
        got = cluster_vectors(vector_table(spark, data), dim=2)
        assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_geometric_drift_bounds_every_gain_and_is_below_full_drift():
    rng = np.random.default_rng(3)
    tighter = 0
    for dim in (2, 3, 16):
        old = rng.normal(0, 50, (6, dim))
        new = old + rng.normal(0, 8, (6, dim))
        radius = rng.uniform(1, 40, 6)
        loosen, drift = geometric_drift(old, new, radius), np.sqrt(((new - old) ** 2).sum(axis=1))
        assert (loosen <= drift[None, :] + 1e-5).all()
        for i in range(6):
            x = rng.normal(size=(4000, dim))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.uniform(0.9, 1, (4000, 1))
            for j in range(6):
                gain = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert gain.max() <= loosen[i, j]
                tighter += i != j and loosen[i, j] < 0.9 * drift[j]
    assert tighter > 20


def test_bounds_spare_scans():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (16, 64))
    v = (centres[rng.integers(0, 16, 4000)] + rng.integers(-9, 10, (4000, 64))).astype(np.int32)
    now = v[:16].astype(np.int64)
    cluster, upper, lower, n = Tighten(now).assign(v, None, None, None)
    assert n == len(v)
    for _ in range(4):
        radius = np.array([upper[cluster == c].max(initial=0) for c in range(16)])
        new = np.array([v[cluster == c].sum(axis=0, dtype=np.int64) // max(1, (cluster == c).sum()) if (cluster == c).any() else now[c] for c in range(16)])
        step, now = Tighten(new, now, radius), new
        cluster, upper, lower, n = step.assign(v, cluster, upper, lower)
        d = ((v[:, None, :].astype(np.int64) - now[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
    assert n < len(v) / 2


# --- bounded-space best-fit

TOKENIZER = "byte_bpe_50k.json"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(TOKENIZER))
    return Tokenizer.from_file(path), path


def check_pieces(got, docs, capacity):
    """The contract's round trip: every id in one piece, only long documents cut, sequences gapless. Returns the number of sequences."""
    own, _ = tokenizer()
    expected = collections.Counter()
    for i, t in [(d[0], d[1]) for d in docs]:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k in range(len(cuts) - 1):
            part = np.array(ids[cuts[k] : cuts[k + 1]], "<u4").tobytes()
            expected[(i, k, cuts[k], len(part) // 4, zlib.crc32(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("data,capacity,stream", [(rows(1), 64, 8), (odd_rows(), 2048, 4096), ([(1, None, None, None, None)], 64, 8), ([(1, "x <|endoftext|> a", "en", "s", 3)] * 5, 1, 5)])
def test_best_fit_packing_round_trip(spark, data, capacity, stream):
    got = pack_documents_best_fit(clashing(table(spark, data)), tokenizer()[1], capacity=capacity, stream_pieces=stream, open_bins=4, with_ids=True).collect()
    check_pieces(got, data, capacity)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_best_fit_of_nothing(spark):
    assert pack_documents_best_fit(table(spark, []), tokenizer()[1]).count() == 0


def plain_best_fit(lengths, capacity, limit):
    """Open bins as a plain list."""
    bins, out, made = [], [], 0
    for n in lengths:
        fitting = [b for b in bins if b[0] >= n]
        if fitting:
            b = min(fitting, key=lambda b: b[0])
        else:
            b = [capacity, made]
            made += 1
            bins.append(b)
        out.append(capacity - b[0])
        b[0] -= n
        bins = [b for b in bins if b[0]]
        if len(bins) > limit:
            bins.remove(min(bins, key=lambda b: b[0]))
    return out, made


@pytest.mark.parametrize("seed", range(6))
def test_bitset_bins_equal_a_plain_search(seed):
    rng = random.Random(seed)
    capacity, limit = rng.choice([(10, 2), (64, 5), (2048, 16), (100, 1)])
    lengths = [rng.randint(1, capacity) for _ in range(900)]
    bins = OpenBins(capacity, limit)
    got = [bins.place(n) for n in lengths]
    offsets, made = plain_best_fit(lengths, capacity, limit)
    assert [o for _, o in got] == offsets and bins.made == made and bins.open <= limit
    assert bins.rooms == sum(1 << r for r, b in bins.by_room.items() if b)


def test_best_fit_comes_near_the_least_number_of_sequences(spark):
    rng = random.Random(2)
    lengths = [min(2047, int(rng.lognormvariate(6.2, 0.8)) + 1) for _ in range(30000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = pack_best_fit(pieces, stream_pieces=4096)
    n = got.select("sequence_id").distinct().count()
    least = -(-sum(lengths) // 2048)
    assert got.count() == len(lengths) and n <= 1.003 * least
    again = pack_best_fit(pieces, stream_pieces=4096)
    assert got.exceptAll(again).count() == 0


def test_waves_and_streams_of_any_size():
    lengths = np.array([5, 9, 1, 10, 3, 3, 7], np.int64)
    for wave in (1, 3, 100):
        bins, offset, left = best_fit(lengths, 10, 3, wave)
        for b in set(bins.tolist()):
            parts = sorted(zip(offset[bins == b], lengths[bins == b]))
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert left.sum() <= 10
    assert [len(x) for x in best_fit(np.empty(0, np.int64), 10, 3, 4)] == [0, 0, 0]


# --- alignment of two tokenizers


def models():
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER)), str(public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(data):
    """The contract with the libraries' own encoders, token by token."""
    import sentencepiece

    from genoloom.llm.token_alignment import byte_level_pieces

    own, _ = tokenizer()
    own.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=models()[1])
    letters = byte_level_pieces(models()[0])
    per, held = [], collections.Counter()
    for i, text in data:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = own.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            at = lambda ids, of: [0, *np.cumsum([len(of(x)) for x in ids]).tolist()]
            piece = lambda x: bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("\u2581", " ").encode()
            if any(b"".join(f(x) for x in ids) != (" " + text).encode() for ids, f in ((a, letters.__getitem__), (b, piece))):
                a, b = [], []
            ea, eb = at(a, letters.__getitem__), at(b, piece)
            links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if ea[x] < eb[y + 1] and eb[y] < ea[x + 1]]
            ends = [0, *sorted(set(ea[1:]) & set(eb[1:]))]
            groups = [",".join(str(v) for v, e in zip(a, ea[1:]) if s < e <= t) + "|" + ",".join(str(v) for v, e in zip(b, eb[1:]) if s < e <= t) for s, t in zip(ends, ends[1:])]
        held.update(set(links))
        per.append((i, len(a), len(b), links, groups))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return collections.Counter((i, na, nb, len(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, k, g in per)


ODD_TEXTS = ["a\u2581b", "<s> hi </s>", "x <|endoftext|> y", "\x00nul", " lead", "trail ", "  ", "\n", "tab\tx", "\ufb01ne \u00e9 e\u0301", "\U0001f600\u200d", "\uff21\uff22", "\u00a0x", "word\u3000word", "\ufffd", "<0x41>", "<unk>"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    if small:  # many runs, blocks and bundles
        monkeypatch.setattr(token_alignment, "BLOCK", 7)
        monkeypatch.setattr(token_alignment, "BUNDLE", 300)
    data = [(r[0], r[1] if r[1] is None else r[1][:400]) for r in rows(3, 25) + odd_rows()] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS * 2)]
    df = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")).repartition(5)
    got = align_tokenizers(df, *models()).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_alignment(data)


def test_alignment_of_nothing_and_its_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(empty, *models()).count() == 0
    one = align_tokenizers(spark.createDataFrame([("k", "hello hello"), (None, None)], "name string, body string"), *models(), id_col="name", text_col="body", with_groups=True).collect()
    got = {r.name: r for r in one}
    assert hashlib.sha256(got["k"].groups.encode()).hexdigest() == got["k"].groups_sha256 and got[None].groups == "" and got["k"].count_sum == got["k"].n_links == got["k"].n_best


def test_pieces_by_word_equal_the_whole_text():
    pieces, rng = Pieces(models()[1]), random.Random(5)
    alphabet = ["a", "the", "Stein", " ", " ", " ", "\n", "\t", ".", "\u00e9", "\U0001f642", "\u2581", "12", "-", "\u4e2d"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        assert np.frombuffer(pieces.encode(t), "<i4").tolist() == pieces.model.encode(t)


def test_ids_word_by_word_equal_the_libraries_own():
    aligner, rng = token_alignment.Aligner(*models()), random.Random(6)
    own, _ = tokenizer()
    own.encode_special_tokens = True
    alphabet = ["a", "the", "Stein", " ", " ", " ", "\n", "\n", "\n\n", "\t", ".", "'s", "\u00e9", "\U0001f642", "\u2581", "12", "-", "\u4e2d", "\x0b", "\u00a0", "\r\n", "<s>", "<|endoftext|>"]
    found = 0
    for _ in range(6000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        a, b = (x.tolist() for x in aligner.ids(t))
        ea, eb = own.encode(" " + t, add_special_tokens=False).ids, aligner.b.model.encode(t)
        whole = b"".join(aligner.bytes_b[i] for i in eb) == (" " + t).encode()
        assert (a, b) == ((ea, eb) if whole else ([], [])), t
        found += whole
    assert found > 3000


@pytest.mark.parametrize("seed", range(4))
def test_merged_runs_hold_every_record_in_order(monkeypatch, seed):
    monkeypatch.setattr(token_alignment, "BLOCK", 5)
    rng = np.random.default_rng(seed)
    runs, all_of = [], []
    for _ in range(9):
        k = np.sort(rng.integers(0, 40, rng.integers(1, 60)) << 32)
        rec = (k, rng.integers(0, 2**50, len(k)), rng.integers(1, 9, len(k)))
        runs.append(write_run(*rec))
        assert [np.concatenate(x).tolist() for x in zip(*read_run(runs[-1]))] == [x.tolist() for x in rec]
        all_of += list(zip(*(x.tolist() for x in rec)))
    merged = [np.concatenate(x).tolist() for x in zip(*merge_runs(runs))]
    assert merged[0] == sorted(merged[0]) and sorted(zip(*merged)) == sorted(all_of)
    assert list(merge_runs([])) == []
