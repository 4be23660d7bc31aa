"""Values carried over blocks, and the groups of hits that rest on them, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from genoloom.operators.blocked import choose_disjoint, running
from genoloom.operators.features import upstream_feature
from genoloom.operators.hits import hsp_groups, hsp_windows
from genoloom.plans.hit_queries import QUERIES


def test_running_values_equal_plain_loops(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(200), i, rng.choice([None, rng.randrange(50)])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, at long, i long, v long").repartition(3)
    kinds = {"sum": lambda x: sum(x), "max": lambda x: max(x, default=None), "min": lambda x: min(x, default=None)}
    values = {f"{k}_{r}": (k, F.col("v"), r) for k in (*kinds, "last") for r in ("before", "upto", "from", "after")}
    got = {r.i: r.asDict() for r in running(df, ["g"], ["at", "i"], values).collect()}
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for g, at, i, v in rows:
        groups[g].append((at, i, v))
    for own in groups.values():
        own.sort()
        vs = [v for _, _, v in own]
        for n, (_, i, _) in enumerate(own):
            reach = {"before": vs[:n][::-1], "upto": vs[: n + 1][::-1], "from": vs[n:], "after": vs[n + 1 :]}
            for r, some in reach.items():
                some = [v for v in some if v is not None]
                for k, f in kinds.items():
                    assert got[i][f"{k}_{r}"] == f(some), (k, r)
                assert got[i][f"last_{r}"] == (some[0] if some else None)


def plain_groups(rows, width):
    """(subject, members) by the definition: windows, no subsets, a walk that keeps what shares no hit."""
    out, by = [], collections.defaultdict(list)
    for s, a, b, n, m in rows:
        by[s].append((min(a, b), max(a, b), n, m))
    for s, own in by.items():
        own.sort()
        windows = [frozenset([i, *(j for j in range(i + 1, len(own)) if own[j][1] <= own[i][0] + width)]) for i in range(len(own))]
        maximal = [w for i, w in enumerate(windows) if not any(w < v or (w == v and j < i) for j, v in enumerate(windows))]
        kept = []
        for w in maximal:
            if not any(w & v for v in kept):
                kept.append(w)
        out += [(s, [own[i] for i in sorted(w)]) for w in kept]
    return out


def hit_rows(seed, n, subjects, span, most):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, size = rng.randrange(span), rng.randrange(1, most)
        out.append((rng.choice(subjects), a, a + size, rng.randrange(1, 40), size) if rng.random() < 0.7 else (rng.choice(subjects), a + size, a, rng.randrange(1, 40), size))
    return out + out[:9]


@pytest.mark.parametrize("seed,n,subjects,span,most", [(1, 500, ["x", "x", "x", "y", None], 4000, 60), (2, 400, ["x"], 300, 200), (3, 600, list("abcdefgh"), 900, 130)])
def test_groups_of_hits_equal_the_definition(spark, seed, n, subjects, span, most):
    rows = hit_rows(seed, n, subjects, span, most)
    df = spark.createDataFrame(rows, "subject string, sstart long, sstop long, nident long, length long").repartition(3)
    got = collections.Counter((r.subject, r.start, r.stop, r.hits, r.aligned, round(r.identity, 9)) for r in hsp_groups(df, 100, 1.2).collect())
    exp = collections.Counter((s, w[0][0], max(h[1] for h in w), len(w), sum(h[3] for h in w), round(sum(h[2] for h in w) / 100, 9)) for s, w in plain_groups(rows, 120))
    assert got == exp
    best = hsp_groups(df, 100, 1.2, cutoff=0.3, k=5).collect()
    assert [round(r.identity, 9) for r in best] == sorted((k[5] for k, c in exp.items() for _ in range(c) if k[5] >= 0.3), reverse=True)[:5]


def test_windows_of_hits_equal_the_definition(spark):
    rows = [(s, a, b, n, m) for s, a, b, n, m in hit_rows(5, 500, ["x", "x", "y"], 3000, 130) if s]
    df = spark.createDataFrame(rows, "subject string, sstart long, sstop long, nident long, length long")
    exp = {}
    for s in {r[0] for r in rows}:
        own, reached, best = [(min(a, b), max(a, b), n) for t, a, b, n, _ in rows if t == s], None, None
        for at in sorted({a for a, _, _ in own}):
            inside = [h for h in own if h[0] >= at and h[1] <= at + 120]
            if inside and (reached is None or max(h[1] for h in inside) > reached):
                reached = max(h[1] for h in inside)
                best = max(best or (0, 0), (sum(h[2] for h in inside), -at))
        exp[s] = (-best[1], best[0] / 100)
    assert {r.subject: (r.window_start, r.share) for r in hsp_windows(df, 100).collect()} == exp


def test_windows_of_all_subjects(spark):
    df = spark.createDataFrame([(f"s{i}", 5, 20, 7, 15) for i in range(30)], "subject string, sstart long, sstop long, nident long, length long")
    assert hsp_windows(df, 100, k=None).count() == 30 and hsp_windows(df, 100).count() == 10
    plan = QUERIES["hsp_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Limit" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_disjoint_choice_over_many_blocks(spark, seed):
    rng = random.Random(seed)
    rows, at = [], {"a": 0, "b": 0}
    for i in range(2000):
        g = "a" if rng.random() < 0.9 else "b"
        at[g] += rng.choice([0, 1, 1, 2, 30]) if seed else 1
        rows.append((g, at[g], at[g] + rng.randrange(40), i))
    least = {}
    for g, lo, hi, i in reversed(rows):
        least[g] = min(least.get(g, 10**9), hi)
        rows[i] = (g, lo, least[g], i)
    got = sorted(r.i for r in choose_disjoint(spark.createDataFrame(rows, "g string, lo long, least long, i long").repartition(4), "g", ["lo", "i"], 50).collect())
    exp, last = [], {}
    for g, lo, m, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if g not in last or m > last[g] + 50:
            last[g] = lo
            exp.append(i)
    assert got == sorted(exp) and len(exp) > 10


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], "subject string, sstart long, sstop long, nident long, length long")
    assert hsp_groups(empty, 100).count() == 0 and hsp_windows(empty, 100).count() == 0


def test_upstream_feature_over_blocks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        a = rng.randrange(3000)
        rows.append((rng.choice([1, 1, 1, 2]), f"f{i}", a, a + rng.randrange(1, 90), rng.choice([1, -1, 0])))
    exp = {}
    for r, f, a, b, s in rows:
        side = [x for x in rows if x[0] == r and (x[4] > 0) == (s > 0)]
        if s > 0:
            before = [x for x in side if (x[3], x[2], x[1]) < (b, a, f)]
            u = max(before, key=lambda x: (x[3], x[2], x[1]), default=None)
            exp[f] = (u and u[1], u and a - u[3])
        else:
            after = [x for x in side if (x[2], x[3], x[1]) > (a, b, f)]
            u = min(after, key=lambda x: (x[2], x[3], x[1]), default=None)
            exp[f] = (u and u[1], u and u[2] - b)
    got = upstream_feature(spark.createDataFrame(rows, "record_id long, feature_id string, start long, stop long, strand int"))
    assert {r.feature_id: (r.upstream, r.distance) for r in got.collect()} == exp
