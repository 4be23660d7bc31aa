"""Annotation comparison against a plain dynamic programme."""

import random

import pytest

from genoloom.operators.alignment import Subsequence, annotation_compare, annotation_summary


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def test_kernel_equals_the_dynamic_programme():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice(["AC", "ACGT", "ACGTN"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(2))
        k = Subsequence(a)
        assert k.length(b) == plain_lcs(a, b)
        longer = max(len(a), len(b))
        exact = plain_lcs(a, b) / longer if longer else None
        for least in (0.5, 0.7, 1.0):
            assert k.identity(b, least) == (exact if exact is not None and exact >= least else None)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    assert Subsequence(long).length(long[:1500] + "A" + long[1500:]) == 3000


def annotations(seed):
    rng = random.Random(seed)
    seqs, a, b = [], [], []
    for r in ("r1", "r2", "r3"):
        s = "".join(rng.choice("ACGT") for _ in range(6000))
        seqs.append((r, s))
        at = 0
        for i in range(40):
            at += rng.randrange(0, 60)
            n, d, kind = rng.randrange(20, 90), rng.choice([1, -1]), rng.random()
            name = lambda: rng.choice(["hypothetical protein", "Hypothetical X", "tail", None])
            if kind < 0.85:
                a.append((r, f"{r}a{i}", at, at + n, d, name()))
            if kind > 0.15:
                b.append((r, f"{r}b{i}", at + rng.choice([0, 0, 3, -2 if at > 2 else 0]), at + n + rng.choice([0, 0, 6]), d, name()))
            at += n
    a += [("r1", "twin", a[3][2], a[3][3], a[3][4], None), ("r1", "empty", 50, 50, 1, None), ("none", "x", 1, 5, 1, None)]
    return seqs, a, b


@pytest.mark.parametrize("seed,skipped", [(1, 10), (2, 3), (3, 0)])
def test_comparison_equals_plain_python(spark, seed, skipped):
    seqs, a, b = annotations(seed)
    schema = "record_id string, feature_id string, start long, stop long, strand int, product string"
    got = annotation_compare(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), spark.createDataFrame(seqs, "seq_id string, seq string"), skipped=skipped)
    known = dict(seqs)
    cut = lambda x: known[x[0]][x[2] : x[3]] if x[4] > 0 else known[x[0]][x[2] : x[3]][::-1].translate(str.maketrans("ACGT", "TGCA"))
    exp, counts = set(), {}
    for r in known:
        sides = [sorted((x for x in d if x[0] == r), key=lambda x: (x[2], x[3], x[1])) for d in (a, b)]
        pairs = []
        for i, x in enumerate(sides[0]):
            for j, y in enumerate(sides[1]):
                if abs(i - j) <= skipped:
                    p, q = cut(x), cut(y)
                    longer = max(len(p), len(q))
                    if longer and plain_lcs(p, q) / longer >= 0.7:
                        pairs.append((x[1], y[1], plain_lcs(p, q) / longer, abs(i - j), len(p) - len(q)))
        best_a = {x: min((p for p in pairs if p[0] == x), key=lambda p: (-p[2], p[3], p[1]))[1] for x in {p[0] for p in pairs}}
        best_b = {y: min((p for p in pairs if p[1] == y), key=lambda p: (-p[2], p[3], p[0]))[0] for y in {p[1] for p in pairs}}
        kept = {(p[0], p[1]): p for p in pairs if best_a[p[0]] == p[1] and best_b[p[1]] == p[0]}
        product = {x[1]: (x[5] or "").lower() for d in sides for x in d}
        for (x, y), p in kept.items():
            h = ["hypothetical" in product[x], "hypothetical" in product[y]]
            change = {(True, True): "Hypothetical", (True, False): "No Longer Hypothetical", (False, True): "Became Hypothetical", (False, False): "Not Hypothetical"}[tuple(h)]
            exp.add((r, x, y, "Exact match" if p[2] == 1 else "Inexact match", round(100 * p[2], 2), "Same Length" if p[4] == 0 else "First Longer" if p[4] > 0 else "Second Longer", change))
        exp |= {(r, x[1], None, "In First but not Second", 0.0, None, None) for x in sides[0] if x[1] not in {k[0] for k in kept}}
        exp |= {(r, None, y[1], "In Second but not First", 0.0, None, None) for y in sides[1] if y[1] not in {k[1] for k in kept}}
    rows = got.collect()
    assert {(r.record_id, r["first"], r.second, r.similarity, r.identity, r.length_class, r.hypothetical) for r in rows} == exp and len(rows) == len(exp)
    x = next(r for r in rows if r["first"] == "r1a0" or r.second == "r1b0")
    assert (x.first_place or x.second_place).startswith("(")
    s = annotation_summary(got).first()
    kinds = [e[3] for e in exp]
    assert (s.exact, s.inexact, s.only_first, s.only_second) == tuple(kinds.count(k) for k in ("Exact match", "Inexact match", "In First but not Second", "In Second but not First"))
    assert s.same_length + s.first_longer + s.second_longer == s.inexact and s.features_first == len(a) - 1
    assert s.hypothetical_change == sum(e[6] in ("No Longer Hypothetical", "Became Hypothetical") for e in exp) and s.hypothetical == sum(e[6] in ("Hypothetical", "Became Hypothetical") for e in exp)


def test_comparison_of_nothing(spark):
    schema = "record_id string, feature_id string, start long, stop long, strand int"
    empty = spark.createDataFrame([], schema)
    assert annotation_compare(empty, empty, spark.createDataFrame([], "seq_id string, seq string")).count() == 0
