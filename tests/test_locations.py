"""Parts and their bases against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.operators import locations as L

PARTS = L.PARTS


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bases(seq, parts):
    return "".join(turned(seq[max(0, a) : max(0, b)]) if d < 0 else seq[max(0, a) : max(0, b)] for a, b, d in parts)


def fixture(seed, n=250):
    rng = random.Random(seed)
    seqs = [(r, "".join(rng.choice("ACGT") for _ in range(size))) for r, size in (("a", 900), ("b", 40), ("c", 64), ("e", 0))]
    rows = []
    for i in range(n):
        r, k = rng.choice(["a", "a", "b", "c", "d", "e"]), rng.choice([1, 1, 1, 2, 3, 5])
        parts = []
        for _ in range(k):
            a = rng.randrange(-5, 950)
            parts.append((a, a + rng.choice([0, 1, 7, 60, 200]), rng.choice([1, -1])))
        rows.append((r, f"f{rng.randrange(n)} x" if i % 3 else "same id", rng.choice(["CDS", "CDS", "gene"]), min(p[0] for p in parts), max(p[1] for p in parts), parts[0][2], parts if i % 4 else None, rng.choice([None, 0, 1, 2]), rng.choice([None, "tag 1", "tag 2"])))
    rows += rows[:3]
    return seqs, rows


SCHEMA = f"record_id string, feature_id string, type string, start long, stop long, strand int, parts {PARTS}, phase int, locus_tag string"


@pytest.mark.parametrize("tile", [16, 64, 1 << 14])
def test_part_sequences_equal_slices(spark, tile):
    seqs, rows = fixture(1)
    known = dict(seqs)
    got = L.part_sequences(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seqs, "seq_id string, seq string"), tile=tile)
    exp = collections.Counter((r[1], bases(known[r[0]], r[6] or [(r[3], r[4], r[5])])) for r in rows if r[0] in known)
    assert collections.Counter((r.feature_id, r.seq) for r in got.collect()) == exp


@pytest.mark.parametrize("kind", ["all", "unique", "nice"])
def test_extracted_features(spark, kind):
    seqs, rows = fixture(2)
    known = dict(seqs)
    got = L.extract_features(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seqs, "seq_id string, seq string"), kind, tile=32).collect()
    exp, names = collections.Counter(), collections.Counter()
    for r in rows:
        if r[2] != "CDS" or r[0] not in known:
            continue
        parts = [list(p) for p in r[6] or [(r[3], r[4], r[5])]]
        if kind != "nice" and r[7]:
            a, b, d = parts[0]
            parts[0] = [a, max(a, b - r[7]), d] if d < 0 else [min(a + r[7], b), b, d]
        exp[(r[0], r[1], bases(known[r[0]], parts))] += 1
        names[(r[0], ((r[8] or r[1]) if kind == "nice" else r[1]).replace(" ", "-"))] += 1
    assert collections.Counter((r.record_id, r.feature_id, r.seq) for r in got) == exp
    ids = collections.Counter(r.id for r in got)
    if kind == "nice":
        assert ids == collections.Counter(n if k == 0 else f"{n}_{k + 1}" for (_, n), c in names.items() for k in range(c))
    elif kind == "unique":
        assert max(ids.values()) == 1 and {i.split("__", 2)[0] for i in ids} <= set(known)
    else:
        assert ids == collections.Counter(n for (_, n), c in names.items() for _ in range(c))


def test_descriptions(spark):
    rows = [("a", "f1", "CDS", 4, 19, -1, None, 2, None), ("a", "f2", "CDS", 4, 19, 1, None, 1, "t")]
    df, seqs = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("n")).withColumn("product", F.lit("p")), spark.createDataFrame([("a", "ACGT" * 9)], "seq_id string, seq string")
    at = lambda kind: {r.feature_id: r.description for r in L.extract_features(df, seqs, kind).collect()}
    assert at("all") == {"f1": "[Location=[5:17](-);Name=n]", "f2": "[Location=[6:19](+);Name=n]"}
    assert at("nice") == {"f1": "p [Location=[4:19](-);ID=f1]", "f2": "p [Location=[4:19](+);ID=f2]"}
    assert {r.description for r in L.extract_features(df, seqs, describe=False).collect()} == {""}


def test_parts_over_the_origin(spark):
    rng = random.Random(3)
    seqs = [("a", "".join(rng.choice("ACGT") for _ in range(100))), ("b", "ACGT")]
    rows = [("a", f"f{i}", "CDS", s, s + n, d, None, None, None) for i, (s, n, d) in enumerate([(90, 25, 1), (90, 25, -1), (100, 9, 1), (99, 1, 1), (0, 100, -1), (130, 20, -1)])] + [("b", "g", "CDS", 1, 3, 1, None, None, None)]
    df = L.over_origin(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 100)], "record_id string, length int"))
    got = {r.feature_id: r.seq for r in L.part_sequences(df, spark.createDataFrame(seqs, "seq_id string, seq string"), tile=32).collect()}
    circle = seqs[0][1] * 2
    assert got == {r[1]: (turned if r[5] < 0 else str)((circle if r[0] == "a" else seqs[1][1])[r[3] : r[4]]) for r in rows}


@pytest.mark.parametrize("up,down", [(0, 0), (7, 0), (12, 5)])
def test_exported_features(spark, up, down):
    seqs, rows = fixture(4)
    known = dict(seqs)
    df, s = spark.createDataFrame(rows, SCHEMA).withColumn("codon_start", F.col("phase") + 1).withColumn("product", F.lit("p")), spark.createDataFrame(seqs, "seq_id string, seq string")
    exp, proteins = collections.Counter(), collections.Counter()
    table, stops = C.table(11), C.stops(11)
    for r in rows:
        if r[2] != "CDS" or r[0] not in known:
            continue
        parts = [list(p) for p in r[6] or [(r[3], r[4], r[5])]]
        for i, p in enumerate(parts):
            a, b = (up if i == 0 else 0), (down if i == len(parts) - 1 else 0)
            lo, hi = (b, a) if p[2] < 0 else (a, b)
            parts[i] = [max(0, p[0] - lo), p[1] + hi, p[2]]
        told = "p " + ", joined with ".join(f"[start={a + 1},end={b}]" for a, b, _ in parts)
        a, b, d = parts[0]
        n = r[7] or 0
        parts[0] = [a, max(a, b - n), d] if d < 0 else [min(a + n, b), b, d]
        q = bases(known[r[0]], parts)
        exp[(r[1], told, q[:-3] if q[-3:] in stops else q)] += 1
        aa = "".join(table[q[k : k + 3]] for k in range(0, len(q) - 2, 3))
        if len(q) % 3 == 0 and q[:3] in C.STARTS[11] and aa.endswith("*") and "*" not in aa[:-1]:
            aa = "M" + aa[1:]
        proteins[(r[1], aa)] += 1
    got = L.export_features(df, s, ["CDS"], up, down, strip_stops=True, informative=True, tile=32)
    assert collections.Counter((r.feature_id, r.definition, r.seq) for r in got.collect()) == exp
    got = L.export_features(df, s, ["CDS"], up, down, translate=True, tile=32)
    assert collections.Counter((r.feature_id, r.seq) for r in got.collect()) == proteins


def test_location_text_round_trip(spark):
    parts = [[(2, 9, 1)], [(2, 9, -1)], [(2, 9, 1), (20, 30, 1)], [(20, 30, -1), (2, 9, -1)], [(0, 3, -1), (6, 9, 1)], [(90, 100, 1), (0, 5, 1)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], f"i int, parts {PARTS}").withColumn("text", L.location_text(F.col("parts")))
    got = df.withColumn("back", L.parse_location(F.col("text"))).orderBy("i").collect()
    assert [r.text for r in got] == ["3..9", "complement(3..9)", "join(3..9,21..30)", "complement(join(3..9,21..30))", "join(complement(1..3),7..9)", "join(91..100,1..5)"]
    assert all([tuple(p) for p in r.back] == parts[r.i] for r in got)
