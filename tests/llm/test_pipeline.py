import collections
import random

import numpy as np
import pytest
from cases import SCHEMA, clashing, odd_rows, rows, table
from pyspark.sql import functions as F

from genoloom.llm.quality_classifier import STATISTICS, fit, quality_scores, statistics_of
from genoloom.llm.simhash import keep_one_of_near_duplicates, wide_fingerprint_of


def planted(seed=1, groups=40, clean=120):
    """Documents of random words; groups of edited copies whose five-word shingles stay similar, and exact copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(150, 500))]
    out, group = [], {}
    for g in range(groups):
        base = text()
        for c in range(rng.randrange(2, 6)):
            t = list(base)
            for _ in range(max(1, len(t) // 200) if c else 0):  # an edit changes five shingles
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            group[len(out)] = g
            out.append(" ".join(t))
    for _ in range(clean):
        group[len(out)] = ("clean", len(out))
        out.append(" ".join(text()))
    return [(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(out)], group


def test_one_of_each_group_stays(spark):
    data, group = planted()
    df = clashing(table(spark, data))
    kept = keep_one_of_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    by = collections.Counter(group[i] for i in ids)
    assert len(ids) == len(set(ids)) and set(by) == set(group.values()), "a group or a clean document is lost"
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert set(first.values()) <= set(ids)
    assert sum(n - 1 for n in by.values()) <= 0.05 * (len(group) - len(by)), "too many copies left"


def test_near_dedup_of_odd_rows(spark):
    data = odd_rows()
    kept = keep_one_of_near_duplicates(table(spark, data)).collect()
    assert {r.text for r in kept if r.text and r.text.split()} == {d[1] for d in data if d[1] and d[1].split() and not d[1].endswith((" tail", "different"))}
    assert sum(1 for r in kept if not (r.text or "").split()) == 1
    assert keep_one_of_near_duplicates(table(spark, [])).count() == 0


def test_wide_fingerprint_tells_similarity():
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    edited = list(words)
    for i in range(0, 2000, 100):
        edited[i] = "changed"
    a, b, c = (np.array(wide_fingerprint_of(" ".join(w).encode(), 5), np.int64).view(np.uint64) for w in (words, edited, words[::-1]))
    assert np.bitwise_count(a ^ b).sum() < 40 < 80 < np.bitwise_count(a ^ c).sum()
    assert wide_fingerprint_of(b"", 5) == [0, 0, 0, 0]


def test_stages_take_and_return_documents(spark, tmp_path):
    P = pytest.importorskip("corpus_pipeline")
    data = rows(11, 150) + odd_rows()
    docs = table(spark, data)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)
    empty = table(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_run_equals_its_stages(spark, tmp_path):
    P = pytest.importorskip("corpus_pipeline")
    table(spark, rows(12, 200)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    key = lambda df: collections.Counter(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert key(P.run(spark, str(tmp_path))) == key(docs)


def test_a_lazy_chain_keeps_what_it_reads(spark, tmp_path):
    P = pytest.importorskip("corpus_pipeline")
    docs = table(spark, rows(13, 120))
    chained = P.line_dedup(spark, P.quality_rules(spark, docs, ""), "")
    assert chained.count() > 0


# --- quality classifier


def labelled(n=400):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        w = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if not good:
            w = [x + rng.choice(["$$", " |", "##"]) for x in w] if i % 8 else [x for x in w for _ in range(6)]
        docs.append((i, " ".join(w).capitalize() + ".", "en", "s", 0))
        labels.append((i, int(good)))
    return docs, labels


def test_classifier_learns_and_holds_out(spark):
    import zlib

    docs, labels = labelled()
    df = table(spark, docs + [(1001, "", None, None, 0), (1002, None, None, None, None), (None, "words here", None, None, 0)])
    lab = spark.createDataFrame([*labels, (1001, None), (5000, 1), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(clashing(df).drop("x"), lab).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.95 * len(held)
    wrong = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y) for i, y in labels]
    again = {r.doc_id: r.score for r in quality_scores(df, spark.createDataFrame(wrong, "doc_id long, quality int")).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again), "held-out labels must not matter"


def test_classifier_without_labels(spark):
    df = table(spark, rows(2, 10))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(df, none).collect()} == {0.5}
    assert quality_scores(table(spark, []), none).count() == 0


def test_model_equals_direct_densities(spark):
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(0.6, 1.5, (300, d))])
    y = np.repeat([0, 1], 300)
    m = fit(spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "x array<double>, y long"), 0.2, 0.1)
    z = np.clip((x - m.centre) / m.spread, -8, 8)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (covs[0] + covs[1]) / 2
    logs = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        diff = z - z[y == c].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.raw(x), logs[1] - logs[0], atol=1e-6)
    assert statistics_of(b"") == [0.0] * d and len(statistics_of("Ünï cödé | x.\nx".encode())) == d


def test_schema_of_cases_is_the_documents_table():
    assert [f.name for f in SCHEMA] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert F is not None


def test_near_dedup_is_exact_at_the_limit(spark):
    """Pairs of 100 shingles that share 89 (similarity 0.802) and 88 (0.786): the first kind is found, the second isn't."""
    rng = random.Random(21)
    data, exp = [], set()
    for g in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        shared = 89 if g % 2 else 88
        other = [f"w{rng.randrange(10**9)}" for _ in range(100 - shared)]
        exp |= {2 * g} if g % 2 else {2 * g, 2 * g + 1}
        data += [(2 * g, " ".join(words), "en", "s", 0), (2 * g + 1, " ".join(words[: shared + 4] + other), "en", "s", 0)]
    assert {r.doc_id for r in keep_one_of_near_duplicates(table(spark, data)).collect()} == exp


def test_near_dedup_equals_brute_force(spark):
    """Chains and families of all similarities, one of them larger than a block."""
    rng = random.Random(22)
    texts = []
    for g in range(30):
        t = [f"v{rng.randrange(10**9)}" for _ in range(rng.choice([4, 6, 30, 90]))]
        for _ in range(700 if g == 3 else 12):
            texts.append(" ".join(t))
            new = list(t)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                new[rng.randrange(len(new))] = f"v{rng.randrange(10**9)}"
            t = new if rng.random() < 0.6 else t
    sets = []
    for x in texts:
        w = x.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    kept = keep_one_of_near_duplicates(table(spark, [(i, x, "en", "s", 0) for i, x in enumerate(texts)]))
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_near_dedup_in_a_grid_of_blocks(spark):
    """A family beyond the block size: hot keys, forests of random blocks and the grid keep what whole cells keep."""
    rng = random.Random(23)
    data, base = [], [f"g{rng.randrange(10**9)}" for _ in range(120)]
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(len(t))] = f"g{rng.randrange(10**9)}"
        data.append((i, " ".join(t) if i % 4 else " ".join(f"h{rng.randrange(10**9)}" for _ in range(60)), "en", "s", 0))
    whole = {r.doc_id for r in keep_one_of_near_duplicates(table(spark, data)).collect()}
    assert {r.doc_id for r in keep_one_of_near_duplicates(table(spark, data), block_rows=16, block_shingles=1500).collect()} == whole
    assert {i for i in range(160) if i % 4 == 0} <= whole and len(whole) < 120


def test_near_dedup_of_short_texts_of_one_template(spark):
    """Two shingles can't share 0.8 of their union with others; four and five can. All is one family, more rows than a block of sets takes."""
    few = [f"lorem ipsum dolor sit amet x{i}" for i in range(3000)]
    some = [f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}" for i in range(30)]
    texts = few + few[:5] + some + [f"{t} tail" for t in some[:20]] + [f"head of {t}" for t in some[20:]]
    kept = {r.doc_id for r in keep_one_of_near_duplicates(table(spark, [(i, x, "en", "s", 0) for i, x in enumerate(texts)])).collect()}
    assert kept == set(range(3000)) | set(range(3005, 3035)) | set(range(3055, 3065))


def test_blocks_of_sets_are_bounded_in_rows(spark, monkeypatch):
    from genoloom.llm import simhash

    seen = []
    monkeypatch.setattr(simhash, "BLOCK_SETS", 40)
    real = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda cells, near: seen.append(cells.groupBy("key", "b1", "b2").count().agg(F.max("count")).first()[0]) or real(cells, near))
    words = " ".join(f"w{i}" for i in range(30))
    texts = [f"{words} x{i % 7} y{i // 7}" for i in range(700)]
    kept = keep_one_of_near_duplicates(table(spark, [(i, x, "en", "s", 0) for i, x in enumerate(texts)]), block_rows=100)
    assert kept.count() == 1 and max(x for x in seen if x) <= 2 * 100 + 60
