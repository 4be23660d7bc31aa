"""Edited genomes, protein stability, intron runs, values below a feature and tree rules against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from genoloom.operators import blocks as B
from genoloom.functions import codon as C
from genoloom.operators import editing as E
from genoloom.operators import features as T
from genoloom.operators import qc
from genoloom.operators import relations as R
from genoloom.operators import sequences as Q

FEATURE = "record_id string, feature_id string, parent string, type string, start long, stop long, strand int"


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_edited_features_lie_on_the_same_bases(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    changes = [("r", 1, 100, 300, 1, None), ("r", 2, None, None, None, "ACGTAC"), ("r", 3, 0, 250, -1, None), ("r", 4, 450, 900, 1, None), ("r", 5, 200, 260, -1, None)]
    rows = []
    for i in range(60):
        a = rng.randrange(0, 480)
        b = min(500, a + rng.randrange(1, 60))
        rows.append(("r", f"g{i}", None, "gene", a, b, rng.choice([1, -1])))
        rows.append(("r", f"c{i}", f"g{i}", "CDS", a, max(a + 1, b - 3), rows[-1][6]))
        rows.append(("r", f"e{i}", f"c{i}", "exon", a, a + 1, rows[-1][6]))
    ch = spark.createDataFrame(changes, "record_id string, n int, start long, stop long, strand int, insert string")
    f, s = spark.createDataFrame(rows, FEATURE), spark.createDataFrame([("r", seq)], "seq_id string, seq string")
    lengths = spark.createDataFrame([("r", 500)], "record_id string, length int")
    new = E.edit_genome(s, ch.withColumn("stop", F.least("stop", F.lit(500)))).first().seq
    got = collections.Counter((r.n, r.feature_id, r.start, r.stop, r.strand) for r in E.edit_features(f, ch, lengths).collect())
    exp, at, by = collections.Counter(), 0, {x[1]: x for x in rows}
    for _, n, a, b, d, ins in changes:
        if ins:
            at += len(ins)
            continue
        b = min(b, 500)
        for _, fid, _, _, lo, hi, strand in rows:
            top = by["g" + fid[1:]]
            if a <= top[4] and top[5] <= b:
                where = (at + lo - a, at + hi - a, strand) if d > 0 else (at + b - hi, at + b - lo, -strand)
                exp[(n, fid, *where)] += 1
                piece = new[where[0] : where[1]]
                assert piece == (seq[lo:hi] if d > 0 else turned(seq[lo:hi]))
        at += b - a
    assert got == exp and len(exp) > 60
    chain = [tuple(r)[1:] for r in E.edit_chain(ch, lengths, "new").orderBy("n").collect()]
    assert chain[0] == (1, 101, 300, "+", "new", 1, 200, "+") and chain[1] == (3, 1, 250, "-", "new", 207, 456, "+") and chain[2][5:7] == (457, 506)


def plain_pi(p):
    pos, neg = dict(Q.POSITIVE_PK), dict(Q.NEGATIVE_PK)
    pos["end"], neg["end"] = Q.FIRST_PK.get(p[0], pos["end"]), Q.LAST_PK.get(p[-1], neg["end"])
    n = lambda k: 1 if k == "end" else p.count(k)
    charge = lambda ph: sum(n(k) / (1 + 10 ** (ph - pk)) for k, pk in pos.items()) - sum(n(k) / (1 + 10 ** (pk - ph)) for k, pk in neg.items())
    ph, lo, hi = Q.PH_START, Q.PH_LEAST, Q.PH_MOST
    while hi - lo > Q.PH_STEP:
        lo, hi = (ph, hi) if charge(ph) > 0 else (lo, ph)
        ph = (lo + hi) / 2
    return ph


def test_isoelectric_point_and_instability(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(1, 200)))) for i in range(200)] + [(900, "K" * 40), (901, "D" * 40), (902, ""), (903, None), (904, "MAGK*")]
    df = spark.createDataFrame(rows, "seq_id long, seq string").withColumn("pi", Q.isoelectric_point(F.col("seq")))
    for r in df.collect():
        assert r.pi is None if not r.seq else r.pi == pytest.approx(plain_pi(r.seq), abs=1e-9), r.seq
    weights = {a + b: rng.uniform(-10, 60) for a in "ACDEFGHIKL" for b in "ACDEFGHIKLMNPQRSTVWY"}
    got = {r.seq_id: r.instability for r in Q.instability_index(df, spark.createDataFrame(list(weights.items()), "pair string, weight double")).collect()}
    for i, p in rows:
        q = p[:-1] if p and p.endswith("*") else p
        assert got[i] is None if not q else got[i] == pytest.approx(10 * sum(weights.get(q[k : k + 2], 0) for k in range(len(q) - 1)) / len(q))


def plain_runs(rows, gap, length, least, overlap):
    """Sets of hits (by number): single linkage of genes along the circle, then all pairs on the subject."""
    out = set()
    for key in {(r[0], r[2]) for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[0], r[2]) == key and r[7] >= least]
        left = set(own)
        while left:
            run, todo = set(), [left.pop()]
            while todo:
                i = todo.pop()
                run.add(i)
                a = rows[i]
                for j in list(left):
                    b = rows[j]
                    if max(a[3], b[3]) - min(a[4], b[4]) <= gap or (length and length - max(a[4], b[4]) + min(a[3], b[3]) <= gap):
                        left.discard(j)
                        todo.append(j)
            ok = len({rows[i][1] for i in run}) > 1
            spans = [(min(rows[i][5:7]), max(rows[i][5:7])) for i in run]
            for x in range(len(spans)):
                for y in range(x):
                    shared = min(spans[x][1], spans[y][1]) - max(spans[x][0], spans[y][0])
                    if overlap < 0 and shared > -overlap or overlap >= 0 and shared > 0 or overlap > 0 and shared <= 0 and -shared < overlap:
                        ok = False
            if ok:
                out.add(frozenset(run))
    return out


@pytest.mark.parametrize("length,overlap", [(None, -1), (3000, -5), (3000, 0), (None, 4)])
def test_intron_runs(spark, length, overlap):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        a, s = rng.randrange(0, 2950), rng.randrange(0, 400)
        rows.append((rng.randrange(14), f"g{rng.randrange(40)}", rng.choice([1, 1, -1]), a, a + rng.randrange(10, 50), s, s + rng.randrange(5, 60), rng.choice([0.2, 0.7, 0.9]), 0, 10, 8, i))
    df = spark.createDataFrame(rows, "subject long, gene string, strand int, start long, stop long, sstart long, sstop long, identity double, qstart long, qstop long, nident long, i long").repartition(3)
    got = collections.defaultdict(set)
    for r in R.intron_runs(df, 400, length, 0.5, overlap).collect():
        got[tuple(r.cluster)].add(r.i)
    exp = plain_runs(rows, 400, length, 0.5, overlap)
    assert {frozenset(v) for v in got.values()} == exp and len(exp) > 3
    f = R.intron_features(df, 400, length, 0.5, overlap).collect()
    kinds = collections.Counter(r.type for r in f)
    assert kinds["gene"] == kinds["mRNA"] == len(exp) and kinds["CDS"] == sum(len({rows[i][1] for i in x}) for x in exp)
    ids = {r.feature_id for r in f}
    assert len(ids) == len(f) and all(r.parent is None or r.parent in ids for r in f)
    assert all(r.stop - r.start == 30 and r.score == 800 and "had 70% identity" in r.note for r in f if r.type == "CDS")


def test_values_of_the_nearest_level_below(spark):
    rows = [
        ("r", "g", None, 0, {}), ("r", "m", "g", 0, {}), ("r", "n", "g", 5, {"other": ["x"]}), ("r", "c", "m", 3, {"Note": ["one", "two"]}), ("r", "d", "n", 1, {"note": ["zero"], "Note": ["half"]}), ("r", "e", "c", 0, {"note": ["deep"]}),
        ("r", "a", "b", 0, {}), ("r", "b", "a", 0, {}),
    ]
    df = spark.createDataFrame(rows, "record_id string, feature_id string, parent string, start long, attrs map<string,array<string>>")
    got = {r.feature_id: r.value for r in E.first_value_below(df, ["Note", "note"]).collect()}
    assert got == {"g": "half; zero; one", "m": "one", "n": "half; zero", "c": "deep"}


def test_report_columns(spark):
    rows = [("r", "g", None, "gene", 0, 30, 1, {}), ("r", "c", "g", "CDS", 0, 30, 1, {"product": ["p"]}), ("r", "h", None, "gene", 40, 52, -1, {"Name": ["n"]})]
    df = spark.createDataFrame(rows, FEATURE + ", attrs map<string,array<string>>")
    terms = spark.createDataFrame([("c", "GO:2"), ("c", "GO:1"), ("c", "GO:2")], "feature_id string, go string")
    seqs = spark.createDataFrame([("r", "ATG" + "C" * 24 + "TAA" + "A" * 30)], "seq_id string, seq string")
    cols = ["id", "location", "strand", "length", "start_codon", "stop_codon", "name", "product", "upstream", "ontology:go"]
    got = {r.id: tuple(r) for r in E.annotation_report(df, cols, seqs=seqs, ontology=terms, below=True).collect()}
    assert got["g"] == ("g", "1..30", "+", 9.0, "ATG", "TAA", None, "p", "c", None)
    assert got["c"] == ("c", "1..30", "+", 9.0, "ATG", "TAA", None, "p", None, "GO:1,GO:2")
    assert got["h"][:4] == ("h", "41..52", "-", None) and got["h"][6] == "n"
    with pytest.raises(ValueError):
        E.annotation_report(df, ["no such"])


def test_tree_rules(spark):
    rows = [
        ("g1", None, "gene", 0, 90), ("m1", "g1", "mRNA", 0, 90), ("c1", "m1", "CDS", 0, 60), ("e1", "m1", "exon", 0, 60), ("e2", "m1", "exon", 50, 90), ("g2", None, "Gene", 0, 90), ("x2", "g2", "CDS", 0, 90), ("y2", "x2", "exon", 0, 9),
        ("g3", None, "gene", 0, 90), ("m3", "g3", "MRNA", 1, 90), ("c3", "m3", "CDS", 5, 95), ("z3", "m3", "gene", 5, 9), ("g4", None, "gene", 0, 50), ("m4", "g4", "mRNA", 0, 50), ("g5", None, "gene", 0, 50), ("m5", "g5", "mRNA", 0, 50), ("e5", "m5", "exon", 0, 40),
    ]
    df = spark.createDataFrame([("r", *x) for x in rows], "record_id string, feature_id string, parent string, type string, start long, stop long")
    got = sorted((r.feature_id, r.message) for r in qc.qc_tree_rules(df).collect())
    assert got == sorted([
        ("m1", "overlapping exons"), ("x2", "unexpected child type of gene"), ("x2", "has features below"), ("g2", "no mRNA"), ("m3", "mRNA bounds differ from the gene"), ("c3", "CDS outside mRNA"), ("z3", "unexpected child type of mRNA"),
        ("z3", "no mRNA"), ("m3", "no CDS at either end"), ("m4", "no CDS or exon"), ("m5", "no exon covers both ends"),
    ])


def test_block_chains_look_at_every_member(spark):
    rows = [(1, "a", 0, 5000), (1, "b", 0, 5000), (2, "a", 5010, 6000), (2, "b", 5010, 6000), (3, "a", 6050, 7000), (3, "b", 90000, 91000), (4, "a", 7100, 7200), (4, "b", 6500, 6600)]
    df = spark.createDataFrame([(lcb, g, a, b, 1) for lcb, g, a, b in rows], "lcb long, genome string, start long, stop long, strand int")
    assert {r.lcb: r.cluster for r in B.block_clusters(df, 100).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {(r.cluster, r.genome): (r.start, r.stop) for r in B.merged_blocks(df, 100).collect()} == {(1, "a"): (0, 6000), (1, "b"): (0, 6000), (3, "a"): (6050, 7200), (3, "b"): (6500, 91000)}


@pytest.mark.parametrize("position,strand", [(120, 1), (120, -1), (120, 0), (-1, 0), (-2, 1), (5, 1), (399, 1), (399, -1)])
def test_safe_reopen(spark, position, strand):
    rng = random.Random(7)
    seqs, rows = [], []
    for r in "abcdef":
        seqs.append((r, "".join(rng.choice("ACGT") for _ in range(400))))
        for _ in range({"e": 0, "f": 1}.get(r, 9)):
            a = rng.randrange(0, 380)
            rows.append((r, a, min(400, a + rng.randrange(5, 60)), rng.choice(["gene", "gene", "remark"])))
    rows.append(("f", 0, 400, "gene"))
    exp = {}
    for r, s in seqs:
        spans = sorted([x[1], x[2]] for x in rows if x[0] == r and x[3] != "remark")
        gaps, at = [], None
        if spans:
            reach = spans[0][1]
            for a, b in [*spans[1:], [400, 401]]:
                if a > reach:
                    gaps.append((reach, a))
                reach = max(reach, b)
        if position < 0:
            best = (gaps[0] if position == -1 else gaps[-1]) if gaps else None
        else:
            held = [g for g in gaps if g[0] < position < g[1]]
            near = [g for g in gaps if (g[1] < position if strand > 0 else g[0] > position)]
            best = held[0] if held else (max(near) if strand > 0 else min(near)) if near else None
        if best:
            at = sum(best) // 2
        cut = s[at:] + s[:at] if at is not None else s
        exp[r] = (at, None if at is None else 400 - at, turned(cut) if strand == -1 and at is not None else cut)
    got = E.safe_reopen(spark.createDataFrame(seqs, "seq_id string, seq string"), spark.createDataFrame(rows, "record_id string, start long, stop long, type string"), position, strand)
    assert {r.record_id: (r.at, r.from_end, r.seq) for r in got.collect()} == exp


def test_edits_from_a_table(spark):
    attrs = {"Name": ["n"], "Alias": ["a", "b"], "Note": ["old"], "kind_of": ["x"]}
    rows = [("f1", "p", 0, 9, 1, attrs), ("f2", None, 5, 9, -1, {}), ("f3", None, 1, 2, 1, {"kind_of": ["x"]}), ("f4", None, 1, 2, 1, attrs)]
    f = spark.createDataFrame(rows, "feature_id string, parent string, start long, stop long, strand int, attrs map<string,array<string>>")
    edits = spark.createDataFrame(
        [("f1", "m", "a", "q", 3, 9, -1, "new", "y"), ("f2", None, "z", None, None, None, None, None, "k"), ("f3", None, None, None, 1, 2, 1, None, "x"), ("f9", "m", None, None, None, None, None, None, None)],
        "feature_id string, name string, alias string, parent string, new_start long, new_stop long, new_strand int, note string, `Kind of` string",
    )
    out, log = T.edit_from_table(f, edits)
    got = {r.feature_id: r for r in out.collect()}
    assert (got["f1"].parent, got["f1"].start, got["f1"].stop, got["f1"].strand) == ("q", 3, 9, -1) and got["f1"].attrs == {"Name": ["m"], "Alias": ["a", "b"], "Parent": ["q"], "Note": ["new"], "kind_of": ["y"]}
    assert got["f2"].attrs == {"Alias": ["z"], "kind_of": ["k"]} and got["f2"].start == 5 and got["f4"].attrs == attrs and got["f3"].attrs == {"kind_of": ["x"]}
    assert {r.feature_id: (r.changed, r.status) for r in log.collect()} == {
        "f1": ("Name, Parent, Start, Strand, Notes, Other Qualifiers", "Success"), "f2": ("Alias, Other Qualifiers", "Success"), "f3": ("None", "No Change"), "f9": ("None", "ID not Found"),
    }


def test_gene_differences(spark):
    schema = "record_id string, feature_id string, start long, stop long, strand int, attrs map<string,array<string>>"
    a = [("r", "a", 0, 9, 1, {"k": ["v"], "l": ["w"]}), ("r", "b", 20, 30, -1, {}), ("r", "c", 40, 50, 1, {}), ("r", "d", 60, 70, 1, {})]
    b = [("r", "a", 0, 12, 1, {"l": ["w"], "k": ["v"]}), ("r", "x", 30, 44, 1, {"k": ["v"]}), ("r", "c", 40, 50, 1, {"k": ["v"]}), ("r", "e", 80, 90, 1, {})]
    got = {(r["first"], r.second): r.differs for r in T.gene_differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {("a", "a"): "", ("b", "x"): "id,qualifiers,strand", ("c", "c"): "qualifiers", ("d", None): None, (None, "e"): None}


@pytest.mark.parametrize("behind,forward", [(1, 1), (2, 0), (0, 3)])
def test_neighbours_of_a_protein(spark, behind, forward):
    rng, table = random.Random(8), C.table(11)
    by = {r: c for c, r in table.items()}
    proteins = ["MKV", "MLLA", "MW"]
    rows, seqs = [], []
    for rec in "ab":
        s, at = "", 0
        for i in range(14):
            p, d = rng.choice(proteins), rng.choice([1, -1])
            q = "ATG" + "".join(by[x] for x in p[1:]) + "TAA"
            rows.append((rec, f"{rec}{i}", "CDS" if i % 5 else "gene", at, at + len(q), d))
            s += q if d > 0 else turned(q)
            at += len(q)
        seqs.append((rec, s))
    cds = [r for r in rows if r[2] == "CDS"]
    exp = set()
    for rec, s in seqs:
        own = sorted((r for r in cds if r[0] == rec), key=lambda r: r[3])
        for n, r in enumerate(own):
            q = s[r[3] : r[4]] if r[5] > 0 else turned(s[r[3] : r[4]])
            p = "".join(table[q[k : k + 3]] for k in range(0, len(q), 3)).rstrip("*")
            if p in proteins[:2]:
                for d in range(-behind, forward + 1):
                    if d and 0 <= n + d < len(own):
                        exp.add((p.lower(), r[1], own[n + d][1], "up" if (d < 0) == (r[5] > 0) else "down", abs(d)))
    f = spark.createDataFrame(rows, "record_id string, feature_id string, type string, start long, stop long, strand int")
    got = T.adjacent_to_protein(f, spark.createDataFrame(seqs, "seq_id string, seq string"), spark.createDataFrame([("mkv", "MKV*"), ("mlla", "mlla")], "query string, protein string"), behind, forward)
    assert {tuple(r) for r in got.collect()} == exp and len(exp) > 10


def test_disambiguation_table(spark):
    rows = [(1, "ACGRYN"), (2, "ACGT"), (3, ""), (4, "nnk")]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    new = {r.seq_id: r.seq for r in Q.disambiguate(df).collect()}
    got = {(r.seq_id, r.pos): (r.code, r.base) for r in Q.disambiguation_table(df).collect()}
    assert got == {(i, k): (c, new[i][k]) for i, s in rows for k, c in enumerate(s) if c.upper() not in "ACGT"} and len(got) == 6


def test_flat_features_for_submission(spark):
    from genoloom.operators.submission import flatten_features

    rows = [
        ("g", None, "gene", 10, 50, 1, {"Name": ["gn"], "product": ["gp"]}), ("m", "g", "mRNA", 10, 60, 1, {}), ("c1", "m", "CDS", 12, 30, 1, {"Note": ["a"], "description": ["b"], "Dbxref": ["x:1"], "ID": ["c1"]}), ("c2", "m", "CDS", 40, 60, 1, {}),
        ("e1", "m", "exon", 2, 8, 1, {}), ("e2", "m", "exon", 12, 60, 1, {}), ("h", None, "gene", 0, 5, -1, {}), ("c3", "h", "CDS", 0, 5, -1, {}), ("t", None, "terminator", 70, 80, 1, {"Note": ["z"]}), ("b", None, "binding_site", 1, 4, 1, {"owner": ["me"], "k": ["v"]}),
        ("u", None, "CDS", 100, 130, -1, {"Name": ["12345678-1234-1234-1234-123456789012"]}), ("w", None, "CDS", 140, 170, -1, {"Name": ["plain"]}),
    ]
    df = spark.createDataFrame([("r", *x) for x in rows], FEATURE + ", attrs map<string,array<string>>")
    got = {r.feature_id: (r.type, r.start, r.stop, [tuple(p) for p in r.parts], r.locus_tag, r.attrs) for r in flatten_features(df, "gp_").collect()}
    assert got == {
        "g": ("gene", 2, 60, [(2, 60, 1)], "gp_002", {}), "h": ("gene", 0, 5, [(0, 5, -1)], "gp_001", {}), "e1": ("RBS", 2, 8, [(2, 8, 1)], "gp_002", {}),
        "c1": ("CDS", 12, 60, [(12, 30, 1), (40, 60, 1)], "gp_002", {"note": ["a", "b"], "db_xref": ["x:1"], "product": ["gp"], "transl_table": ["11"]}),
        "t": ("regulatory", 70, 80, [(70, 80, 1)], None, {"regulatory_class": ["terminator"]}), "b": ("misc_binding", 1, 4, [(1, 4, 1)], None, {"k": ["v"]}),
        "u": ("CDS", 100, 130, [(100, 130, -1)], None, {"transl_table": ["11"]}), "w": ("CDS", 140, 170, [(140, 170, -1)], None, {"product": ["plain"], "transl_table": ["11"]}),
    }
