"""Operators whose queries have no SQL, against plain Python on small fixtures."""

import random
import re

from genoloom.functions import codon as C
from genoloom.operators import editing as E
from genoloom.operators import scans as X

STOPS = C.stops(11)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_suppress_stops(spark):
    rng = random.Random(1)
    rows = [(f"f{i}", dna(rng, 30) + rng.choice(["TAG", "TAA", "GGG"]), dna(rng, rng.randrange(0, 200))) for i in range(300)]
    exp = {}
    for name, seq, rest in rows:
        codons = [rest[k : k + 3] for k in range(0, min(len(rest), 120) - 2, 3)]
        first = next((k + 1 for k, c in enumerate(codons) if c in STOPS and c != "TAG"), 0)
        if seq.endswith("TAG") and first:
            exp[name] = first
    got = {r.feature_id: r.added for r in E.suppress_stops(spark.createDataFrame(rows, "feature_id string, seq string, rest string"), "TAG").collect()}
    assert got == exp and len(exp) > 50


def test_block_split(spark):
    rng = random.Random(2)
    rows = [(b, f"g{g}", "".join(rng.choice("ACGT---") if (k // 30 + g) % 3 else "A" for k in range(rng.choice([95, 130])))) for b in range(30) for g in range(3)]
    exp = set()
    for b in range(30):
        own = [(g, s) for x, g, s in rows if x == b]
        runs = []
        for k in range(0, max(len(s) for _, s in own), 25):
            parts = [(g, s[k : k + 25]) for g, s in own if len(s) > k]
            sig = ",".join(sorted(g for g, p in parts if (len(p) - p.count("-")) / len(p) >= 0.6))
            stop = k + max(len(p) for _, p in parts)
            if runs and runs[-1][2] == sig:
                runs[-1][1] = stop
            else:
                runs.append([k, stop, sig])
        exp |= {(b, *r) for r in runs}
    got = {tuple(r) for r in E.block_split(spark.createDataFrame(rows, "lcb long, genome string, seq string"), 25, 0.6).select("lcb", "start", "stop", "members").collect()}
    assert got == exp


def test_require_sd_widens_over_the_best_motif(spark):
    rng = random.Random(3)
    rows, seqs, exp = [], [], {}
    for i in range(200):
        s = "".join(rng.choice("ACT") for _ in range(300))  # no G, so nothing but what is planted
        gap, motif = rng.randrange(1, 24), rng.choice(X.SD_MOTIFS)
        at = 150 - gap - len(motif)
        s = s[:at] + motif + s[at + len(motif) :]
        minus = i % 2
        rows.append((i, f"f{i}", 150 if not minus else 100, 200 if not minus else 150, -1 if minus else 1))
        seqs.append((i, turned(s) if minus else s))
        # The best of all motifs in the window before the start: longest, then nearest.
        up = s[150 - 17 - 7 : 150 - 3]
        hits = [(-len(m), len(up) - x.end() + 3, m) for m in X.SD_MOTIFS for x in re.finditer(m, up) if len(up) - x.end() + 3 <= 17]
        if hits:
            size, gap, _ = min(hits)
            at = 150 - gap + size
            exp[f"f{i}"] = (100, 300 - at) if minus else (at, 200)
    genes = spark.createDataFrame(rows, "record_id long, feature_id string, start long, stop long, strand int")
    found = {r.feature_id: (r.start, r.stop) for r in E.require_sd(genes, spark.createDataFrame(seqs, "seq_id long, seq string")).collect()}
    assert found == exp and len(exp) > 100


def test_frameshift_scan(spark):
    rng = random.Random(4)
    table = C.table(11)
    rows = [(f"f{i}", "".join(rng.choice(["AAA", "GGG", "TTT", "AAG", "GGA", "CTT"]) for _ in range(rng.randrange(3, 40))), dna(rng, rng.randrange(0, 90))) for i in range(60)]
    pep = lambda s: [table[s[k : k + 3]] for k in range(0, len(s) - 2, 3)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    exp = set()
    for name, seq, rest in rows:
        n, whole = len(seq), seq + rest
        if n < 12:
            continue
        over = min(n, 60) - min(n, 60) % 3
        for at in range(max(n - over, 9), n - 2, 3):
            for shift in (-2, -1, 1, 2):
                a, b = at - 6, at - 6 + shift
                here, there, tail = whole[a : a + 6], whole[b : b + 6], whole[b:]
                if distance(here, there) <= 5 and distance(pep(here), pep(there)) <= 1:
                    codons = [tail[k : k + 3] for k in range(0, len(tail) - 2, 3)]
                    if next((k for k, c in enumerate(codons) if c in STOPS), len(codons)) >= n / 6:
                        exp.add((name, at, shift))
    got = {(r.feature_id, r.at, r["shift"]) for r in X.frameshift_scan(spark.createDataFrame(rows, "feature_id string, seq string, rest string")).collect()}
    assert got == exp and len(exp) > 20


def proteins_of(seqs, least, most=None):
    """{id: protein} of every in-frame start before each stop, both strands, of ``least`` codons or more."""
    table, out = C.table(11), {}
    for name, seq in seqs:
        for d, s in ((1, seq), (-1, turned(seq))):
            for f in range(3):
                codons = [s[k : k + 3] for k in range(f, len(s) - 2, 3)]
                first = 0
                for i, c in enumerate(codons):
                    if c in STOPS:
                        for j in range(first, i):
                            if codons[j] in C.STARTS[11] and i - j + 1 >= least:
                                a, b = f + 3 * j, f + 3 * (i + 1)
                                a, b = (a, b) if d > 0 else (len(s) - b, len(s) - a)
                                p = "".join(table[x] for x in codons[j:i])
                                if most is None or len(p) <= most:
                                    out[f"{name}:{a}:{b}:{d}"] = p
                        first = i + 1
    return out


def long_frames(seed, n=12):
    """Records with reading frames whose residues favour runs and boxes."""
    rng = random.Random(seed)
    by = {}
    for c, r in C.table(11).items():
        by.setdefault(r, []).append(c)
    out = []
    for i in range(n):
        size = rng.choice([40, 90, 150, 210])
        p = [rng.choice("FIWLVMYCATGSPRKDE") for _ in range(size)]
        at = rng.randrange(8, 30)
        p[at : at + 18] = [rng.choice("FIWLVMYCATGSP") for _ in range(18)]
        p[12:16] = list("LAGC") if rng.random() < 0.7 else list("AWGC")
        if size > 100:
            p[85:110] = [rng.choice("FIWLVMYCATGSP") for _ in range(25)]
        s = dna(rng, 20) + "ATG" + "".join(rng.choice(by[x]) for x in p) + "TAA" + dna(rng, 20)
        out.append((f"s{i}", turned(s) if i % 2 else s))
    return out


def test_reading_frames_of_odd_sequences(spark, monkeypatch):
    monkeypatch.setattr(X, "_ORF_TEXT", 500)
    rng = random.Random(8)
    seqs = [(i, "".join(rng.choice("ACGTACGTACGTNacgt\u00e9") for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 400, 3000, 0, 700])] + [(9, None), (10, "ATG" * 300 + "TAA")]
    exp, table = set(), C.table(11)
    for i, seq in seqs:
        for way in (1, -1) if seq else ():
            s = seq.upper() if way > 0 else turned(seq.upper())
            for a in range(len(s) - 2):
                if s[a : a + 3] in C.STARTS[11]:
                    b = next((k + 3 for k in range(a, len(s) - 2, 3) if s[k : k + 3] in STOPS), None)
                    if b and (b - a) // 3 >= 8:
                        exp.add((i, a if way > 0 else len(s) - b, b if way > 0 else len(s) - a, way, (b - a) // 3, s[a:b], "".join(table.get(s[k : k + 3], "X") for k in range(a, b, 3))))
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    got = X.orf_scan(df, 11, 8)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == exp and len(rows) == len(exp) > 300
    assert {r[:5] for r in exp} == {tuple(r) for r in X.orf_scan(df, 11, 8, with_sequence=False).collect()}


def test_subsection_lays_cuts_in_few_bins(spark, monkeypatch):
    rng, widths = random.Random(9), []
    features = [(i % 3, at := rng.randrange(3000), at + rng.randrange(1, 90), f"f{i}") for i in range(400)]
    cuts = [(i % 3, at := rng.randrange(2500), at + (900 if i else 5000), i) for i in range(12)]
    join = E.I.overlap_join
    monkeypatch.setattr(E.I, "overlap_join", lambda *a, **k: widths.append(k.get("width")) or join(*a, **k))
    got = E.subsection(spark.createDataFrame(features, "record_id long, start long, stop long, feature_id string"), spark.createDataFrame(cuts, "record_id long, start long, stop long, cut long"))
    exp = {(c, f, a - lo, b - lo) for r, lo, hi, c in cuts for k, a, b, f in features if k == r and lo <= a and b <= hi}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == exp and len(rows) == len(exp) > 100 and widths[0] >= 900


def test_no_motif_lies_before_the_record(spark):
    genes = spark.createDataFrame([(1, "f0", 0, 90, 1), (1, "f1", 1, 90, 1), (1, "f2", 2, 90, 1), (1, "f6", 6, 90, 1)], "record_id long, feature_id string, start long, stop long, strand int")
    seqs = spark.createDataFrame([(1, "AGGTTT" * 40)], "seq_id long, seq string")
    found = {(r.feature_id, r.motif, r.gap, r.start, r.stop) for r in X.sd_scan(genes, seqs, top_only=False).collect()}
    assert found == {("f6", "AGG", 3, 0, 3)}


def run_size(p, least, most, size_least, size_most):
    region = p[least - 1 : least - 1 + min(most, len(p)) + 2 - least]
    return next((n for n in range(size_most, size_least - 1, -1) if re.search(f"[{X.HYDROPHOBIC}]{{{n}}}", region)), None)


def after_box(p, least, most, least_after, most_after):
    region = p[least - 1 : least - 1 + most + 6 - least]
    for box in X.LIPOBOXES:
        m = re.search(box, region)
        if m:
            after = len(p) - (p.find(m[0]) + len(m[0])) + 1
            if least_after <= after <= most_after:
                return after
    return None


def test_candidates(spark):
    seqs = long_frames(5, 50)
    df = spark.createDataFrame(seqs, "seq_id string, seq string")
    exp = {k: run_size(p, 10, 30, 10, 20) for k, p in proteins_of(seqs, 60).items() if not p.startswith("I")}
    exp = {k: v for k, v in exp.items() if v}
    assert {r.seq_id: r["size"] for r in E.inner_candidates(df).collect()} == exp and len(exp) > 5
    boxed = {k: after_box(p, 10, 50, 30, 185) for k, p in proteins_of(seqs, 30).items()}
    boxed = {k: v for k, v in boxed.items() if v}
    assert {r.seq_id: r.after for r in E.outer_candidates(df).collect()} == boxed and len(boxed) > 5
    one = {k: run_size(p, 75, 200, 15, 25) for k, p in proteins_of(seqs, 100, 200).items() if after_box(p, 10, 30, 60, 160)}
    one = {k: v for k, v in one.items() if v}
    assert {r.seq_id: r["size"] for r in E.single_candidates(df).collect()} == one and len(one) > 2
    s, sizes = E.length_summary(E.inner_candidates(df)).first(), sorted(exp.values())
    middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    assert (s.n, s.least, s.most, s.median) == (len(sizes), sizes[0], sizes[-1], middle) and abs(s["mean"] - sum(sizes) / len(sizes)) < 1e-9


def test_sar_table(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("FIWLVMYCATGSPFIWLVMYCATGSPKRDE") for _ in range(rng.randrange(5, 70)))) for i in range(200)]
    exp = set()
    for i, p in rows:
        head, hits = p[:50], []
        for n in range(6, 9):
            for a in range(max(len(head) - n, 0)):
                w = head[a : a + n]
                if re.fullmatch(f"[{X.HYDROPHOBIC}]+|K[{X.HYDROPHOBIC}]+|[{X.HYDROPHOBIC}]+K", w):
                    hits.append((-n, a))
        if hits:
            n, a = min(hits)
            exp |= {(i, "inside", 0, a), (i, "membrane", a, a - n), (i, "outside", a - n, len(p))}
    got = {tuple(r) for r in E.sar_table(spark.createDataFrame(rows, "seq_id long, seq string"), 6, 9).collect()}
    assert got == exp and len(exp) > 100
