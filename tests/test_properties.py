"""Properties and small exact cases of the operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoloom.functions import sequence as S
from genoloom.operators import intervals as I  # noqa: E741
from genoloom.operators import scans as X
from genoloom.operators.components import connected_components
from genoloom.operators.ordered import ordered_positions


def seqs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, seq string")


def random_dna(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randrange(size))) for _ in range(n)]


def test_reverse_complement_twice_is_the_same(spark):
    df = seqs(spark, [*random_dna(1, 30, 200), "ACGTRYKMSWBDHVNacgt", ""])
    assert df.where(S.reverse_complement(S.reverse_complement(F.col("seq"))) != F.col("seq")).count() == 0


def test_rotate_there_and_back(spark):
    df = seqs(spark, [x for x in random_dna(2, 30, 90) if x])
    for k in (0, 5, 1000):
        assert df.where(S.rotate(S.rotate(F.col("seq"), k), -k) != F.col("seq")).count() == 0


def test_small_exact_values(spark):
    assert spark.range(1).select(S.translate(F.lit("TTGGCTAAATAA"), 11).alias("p")).first().p == "MAK"
    assert spark.range(1).select(S.translate(F.lit("GCTTAAGCT"), 11).alias("p")).first().p == "A"
    assert spark.range(1).select(S.junction_window(F.lit("AACCGGTT"), 4).alias("p")).first().p == "G[GTT]AACC"
    assert [tuple(m) for m in spark.range(1).select(X.matches(F.lit("xGGGGGGx"), "GGG").alias("m")).first().m] == [(1, 4), (4, 7)]


@pytest.mark.parametrize("number", [1, 11])
def test_reading_frames_equal_a_direct_search(spark, number):
    from genoloom.functions import codon as C

    texts = random_dna(3, 6, 900)
    got = {(r.seq_id, r.start, r.stop, r.strand, r.dna) for r in X.orf_scan(seqs(spark, texts), number, 5).collect()}
    comp = str.maketrans("ACGT", "TGCA")
    exp = set()
    for k, t in enumerate(texts):
        for strand, s in ((1, t), (-1, t[::-1].translate(comp))):
            for i in range(len(s) - 2):
                if s[i : i + 3] in C.STARTS[number]:
                    j = next((j for j in range(i, len(s) - 2, 3) if s[j : j + 3] in C.stops(number)), None)
                    if j is not None and (j - i) // 3 + 1 >= 5:
                        lo, hi = (i, j + 3) if strand > 0 else (len(s) - j - 3, len(s) - i)
                        exp.add((k, lo, hi, strand, s[i : j + 3]))
    assert got == exp and all(len(x[4]) % 3 == 0 for x in got)


def spans(seed, n, records=3, reach=400, longest=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(-20, reach)
        out.append((rng.randrange(records), a, a + rng.choice([0, 1, rng.randrange(longest), 5000]), rng.choice([1, -1]), f"f{i}"))
    return out


@pytest.mark.parametrize("width", [1, 7, None])
def test_interval_join_equals_all_pairs(spark, width):
    schema = "record_id long, start long, stop long, strand int, feature_id string"
    a, b = spans(4, 120), spans(5, 120)
    got = sorted((r.feature_id, r.b_feature_id) for r in I.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), width=width).collect())
    exp = sorted((x[4], y[4]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    assert got == exp


def test_merging_again_changes_nothing(spark):
    df = spark.createDataFrame([(r, a, b) for r, a, b, _, _ in spans(6, 200)], "record_id long, start long, stop long")
    once = I.merge_intervals(df)
    assert sorted(map(tuple, I.merge_intervals(once).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("joined", [True, False])
@pytest.mark.parametrize("block", [1, 9, 1 << 16])
def test_merging_in_blocks_equals_merging_at_once(spark, block, joined):
    rows = [(r, a, b) for r, a, b, _, _ in spans(11, 250)] + [(1, 5, 5), (1, 5, 9), (2, 0, 700), (3, 40, 40), (None, 1, 2), (None, 2, 4)]
    df = spark.createDataFrame(rows, "record_id long, start long, stop long")
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(map(tuple, I.merge_intervals(df, joined=joined, block=block).collect()), key=key) == sorted(map(tuple, I.merge_intervals(df, joined=joined, block=None).collect()), key=key)
    assert sorted(map(tuple, I.gaps(df, block=block).collect()), key=key) == sorted(map(tuple, I.gaps(df, block=None).collect()), key=key)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components_equal_union_find(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


def test_a_long_chain_is_one_component(spark):
    got = connected_components(spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == 601 and got.where("root <> 0").count() == 0


def test_ordered_positions(spark):
    rng = random.Random(9)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(30), i) for i in range(500)]
    got = ordered_positions(spark.createDataFrame(data, "g string, k int, i int"), ["g"], [F.col("k"), F.col("i")])
    exp = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted(x for x in data if x[0] == g)):
            exp[d] = n
    assert {(r.g, r.k, r.i): r.position for r in got.collect()} == exp


def test_result_does_not_depend_on_shuffle_partitions(spark):
    df = spark.createDataFrame([(r, a, b) for r, a, b, _, _ in spans(8, 150)], "record_id long, start long, stop long")
    seen = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, I.gaps(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_renumber_keeps_numbers_longer_than_the_digits(spark):
    from genoloom.operators.features import renumber

    genes = spark.createDataFrame([(f"g{i:04}", "r", i, i + 1) for i in range(1005)], "feature_id string, record_id string, start long, stop long")
    members = spark.createDataFrame([("m", "g0999")], "feature_id string, parent string")
    got = {r.feature_id: r.tag for r in renumber(genes, members, "gp", 3).collect()}
    assert got == {f"g{i:04}": f"gp_{i + 1:03}" for i in range(1005)} | {"m": "gp_1000"}


def test_trees_are_walked_to_any_depth(spark):
    from genoloom.operators.features import coding_genes, descendants, filter_tree, fminmax
    from genoloom.operators.qc import qc_parents

    rows = [("r", "gene" if i == 0 else "CDS" if i == 49 else "part", i, 100 + i, 1, f"n{i}", f"n{i - 1}" if i else None) for i in range(50)]
    rows += [("r", "part", 0, 9, 1, f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("r", "part", 0, 9, 1, "tail", "c3"), ("r", "part", 0, 9, 1, "lost", "nobody"), ("r", "part", 0, 9, 1, "self", "self")]
    f = spark.createDataFrame(rows, "record_id string, type string, start long, stop long, strand int, feature_id string, parent string")
    assert {r.feature_id for r in filter_tree(f, F.col("feature_id") == "n0").collect()} == {f"n{i}" for i in range(50)}
    assert descendants(f, f.where("feature_id = 'n10'")).count() == 39 and descendants(f, f.where("feature_id = 'c0'")).count() == 7
    assert [r.feature_id for r in coding_genes(f).collect()] == ["n0"]
    assert [tuple(r) for r in fminmax(f).collect()] == [("n0", 0, 149)]
    told = {(r.feature_id, r.message) for r in qc_parents(f).collect()}
    assert told == {("lost", "parent not found"), ("self", "own parent")} | {(f"c{i}", "cycle") for i in range(7)}


def test_contig_uid_equals_all_rotations(spark):
    import hashlib
    import random

    from genoloom.operators.sequences import contig_uid, least_rotation

    rng = random.Random(3)
    seqs = ["", "A", "AAAA", "ACGT", "GATTACA", "AC" * 300, "ACG" * 200 + "T", "CAAC" * 90] + ["".join(rng.choice("ACGT"[: rng.choice([1, 2, 4])]) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    turn = lambda s: min(s[k:] + s[:k] for k in range(max(len(s), 1)))
    assert all(least_rotation(s) == turn(s) for s in seqs)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    got = {r.seq_id: r.uid for r in contig_uid(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")).collect()}
    assert got == {i: hashlib.md5(min(turn(s), turn(back(s))).encode()).hexdigest() for i, s in enumerate(seqs)}
    assert len(least_rotation("ACGT" * 250_000)) == 1_000_000
