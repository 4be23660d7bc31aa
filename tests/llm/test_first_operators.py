import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from cases import clashing, odd_rows, rows, table
from tokenizers import Tokenizer

from genoloom.llm.line_dedup import dedup_lines
from genoloom.llm.mixing import mix_documents, mix_plan
from genoloom.llm.packing import TournamentTree, first_fit, pack_documents, pieces
from genoloom.llm.pii import find_spans, luhn, personal_data, redact
from genoloom.llm.quality_rules import keep_quality, quality_verdicts
from genoloom.llm.simhash import allocate, forest, group_bits, links, simhash_components
from genoloom.llm.token_counts import LongestMatch, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(values, linked):
    """Smallest member reachable, by plain search."""
    root = {}
    for v in sorted(values):
        if v in root:
            continue
        todo = [v]
        root[v] = v
        while todo:
            x = todo.pop()
            for y in values:
                if y not in root and linked(x, y):
                    root[y] = v
                    todo.append(y)
    return root


@pytest.mark.parametrize("data", [rows(), odd_rows()])
def test_simhash_equals_brute_force(spark, data):
    got = simhash_components(clashing(table(spark, data))).collect()
    assert len(got) == len(data)
    exp = collections.Counter((d[0], f"{simhash(d[1]):016x}") for d in data)
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == exp
    fps = {simhash(d[1]) for d in data}
    root = closure(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d in data:
        if d[0] is not None:
            k = root[simhash(d[1])]
            first[k] = min(first.get(k, d[0]), d[0])
    assert all(r.component_id == first.get(root[int(r.fingerprint, 16)]) for r in got)


def test_simhash_empty(spark):
    assert simhash_components(table(spark, [])).count() == 0


@pytest.mark.parametrize("radius,limit", [(2, 1024), (2, 3), (1, 1024), (3, 1024), (6, 1024), (1, 3)])
def test_links_join_what_is_near(spark, radius, limit):
    rng = np.random.default_rng(radius * 7 + limit)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, radius + 3), replace=False):
                b ^= 1 << int(bit)
            fps.add(b - (1 << 64) if b >= 1 << 63 else (b + (1 << 64) if b < -(1 << 63) else b))
    fps = {int(np.array([f & (2**64 - 1)], "<u8").view("<i8")[0]) for f in fps}
    edges = [(r.a, r.b) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, limit).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    got = collections.defaultdict(set)
    for a, b in edges:
        got[a].add(b)
        got[b].add(a)
    assert closure(fps, lambda a, b: b in got[a]) == closure(fps, near)


def test_allocation_is_least_and_adds_up():
    costs = [[0, 5, 9], [0, 1, 50], [0, 7, 8]]
    best, ts = allocate(costs, 0)
    assert sum(ts) == 0 and best == min(costs[0][a] + costs[1][b] + costs[2][c] for a in range(3) for b in range(3) for c in range(3) if a + b + c - 3 == 0)


def test_correlated_bits_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 40] = x[:, 3]
    groups = group_bits((x.T @ x).astype(float), len(x), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40} <= set(g) for g in groups)


@pytest.mark.parametrize("data", [rows(), odd_rows()])
def test_quality_counts_equal_brute_force(spark, data):
    got = quality_verdicts(clashing(table(spark, data))).collect()
    key = lambda t: tuple(str(x) for x in t)
    exp = []
    for d in data:
        t = d[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        exp.append((d[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert sorted(map(key, exp)) == sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_keeps_clean_and_drops_symbols(spark):
    import random

    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in"] + ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    clean = [" ".join(rng.choice(words) + ("." if i % 9 == 0 else "") for i in range(150)) for _ in range(60)]
    junk = [" ".join(rng.choice(words) + rng.choice(["$$$", "###", " |"]) for i in range(150)) for _ in range(8)]
    df = table(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + junk)])
    assert {r.doc_id for r in keep_quality(df).collect()} == set(range(60))
    assert keep_quality(df).columns == df.columns
    assert keep_quality(table(spark, [])).count() == 0


@pytest.mark.parametrize("min_sites", [2, 3])
@pytest.mark.parametrize("data", [rows(2, 80), odd_rows()])
def test_line_dedup_equals_brute_force(spark, data, min_sites):
    data = [(d[0], None if d[1] is None else d[1].replace(" ", "\n", 3), *d[2:]) for d in data]
    df = clashing(table(spark, data))
    got = dedup_lines(df, min_sites=min_sites)
    assert got.columns == df.columns
    sites, first = collections.defaultdict(set), {}
    for d in data:
        for i, line in enumerate((d[1] or "").split("\n")):
            s = line.strip(" \t\r")
            if WORD.search(s):
                sites[s].add(d[3])
                if d[0] is not None:
                    first[s] = min(first.get(s, (d[0], i)), (d[0], i))
    exp = []
    for d in data:
        t = d[1]
        if t is not None and d[0] is not None:
            kept = [x for i, x in enumerate(t.split("\n")) if not (WORD.search(x) and len(sites[x.strip(" \t\r")]) >= min_sites and first[x.strip(" \t\r")] != (d[0], i))]
            t = "\n".join(kept)
        exp.append((d[0], t, d[3]))
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got.collect()) == collections.Counter(exp)


def expected_mix(data):
    size = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for d in data:
        by[d[3]] += size(d[1])
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-8")))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(w[s] for s in order if s not in capped)
        level = (sum(by.values()) - sum(3 * by[s] for s in capped)) / rest
        new = {s for s in order if s not in capped and w[s] * level > 3 * by[s]}
        if not new:
            return by, {s: 3 * by[s] if s in capped else w[s] * level for s in order}
        capped |= new


@pytest.mark.parametrize("data", [rows(), odd_rows(), rows(9, 400)])
def test_mix(spark, data):
    df = clashing(table(spark, data))
    got = mix_plan(df).collect()
    by, target = expected_mix(data)
    assert len(got) == len(data)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == by[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in by)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(mix_plan(df.repartition(3)).collect()) == key(got)
    mixed = mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_empty(spark):
    assert mix_plan(table(spark, [])).count() == 0


@pytest.mark.parametrize("data", [rows(), odd_rows()])
def test_packing_round_trip(spark, data):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    got = pack_documents(clashing(table(spark, data)), BPE, capacity=256, group_pieces=30, with_ids=True).collect()
    exp = collections.Counter((d[0], tuple(t.encode(d[1] or "", add_special_tokens=False).ids + [1])) for d in data)
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.doc_id, r.doc_tokens].append(r)
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for (doc, n), copies in collections.Counter((d, len(i)) for d, i in exp.elements()).items():
        assert sum(r.length for r in parts[doc, n]) == n * copies
    for (doc, ids), copies in exp.items():
        at = collections.defaultdict(list)
        for r in parts[doc, len(ids)]:
            at[r.start].append(tuple(r.ids))
        assert all(sum(p == ids[s : s + 256] for p in ps) >= copies for s, ps in at.items())
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 256
    assert pack_documents(table(spark, []), BPE).count() == 0


def test_tokens_equal_the_tokenizers_library(spark):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    odd = ["<|endoftext|> a", " a", "a  b", "a  b", "　x y z", "don't 'll  \n\n x", "x\u0085y \u0085 z", "日本 語", "\x1c a \x1c b"]
    texts = [d[1] for d in rows(4, 80)] + odd
    got = {r.doc_id: r for r in pieces(table(spark, [(i, x, None, None, 0) for i, x in enumerate(texts)]), BPE, 1 << 30).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_tournament_is_first_fit():
    import random

    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 40))), reverse=True)
        room, exp = [100] * len(sizes), []
        for s in sizes:
            b = next(i for i, r in enumerate(room) if r >= s)
            exp.append((b, 100 - room[b]))
            room[b] -= s
        assert list(zip(*first_fit(sizes, 100))) == exp
    assert TournamentTree(1, 5).place(5) == (0, 5)


def greedy(vocabulary, word):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 0
        word, n = word[k:], n + 1
    return n


def test_longest_match_equals_greedy():
    import random

    rng = random.Random(8)
    for _ in range(120):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        m = LongestMatch(vocabulary)
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            assert m.count(w) == greedy(vocabulary, w), (vocabulary, w)
    m = LongestMatch({"un", "##aff", "##able", "##a", "##ab"}, continuing="##")
    assert (m.count("unaffable"), m.count("unab"), m.count("aff")) == (3, 2, 0)


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    data = odd_rows()
    got = collections.Counter(tuple(r) for r in token_counts(clashing(table(spark, data)), PIECES).collect())
    exp = collections.Counter()
    for d in data:
        n = [greedy(vocabulary, "▁" + w) for w in WORD.findall(d[1] or "")]
        exp[d[0], len(n), sum(n) + n.count(0), n.count(0)] += 1
    assert got == exp


def base_spans(text):
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def test_personal_data_base_equals_regexes(spark):
    import random

    rng = random.Random(6)
    bits = ["@", ".", "a", "b1", "1", "22", "300", "+", " ", "-", "(", ")", "4111111111111111", "1.2.3.4", "x@y.z", "é", "٣", "\n", "+1 (456) 555-2186", "_", "5500005555555559 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    for t in texts:
        found = find_spans(t)
        assert {k: found[k] for k in base_spans(t)} == base_spans(t), t
    data = [(i, t, None, None, 0) for i, t in enumerate(texts[:200] + ["", None])]
    for r in personal_data(clashing(table(spark, data))).collect():
        b = base_spans(data[r.doc_id][1] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in ("email", "ip", "card", "phone") for s, e in b[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(b[k]) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)


def test_personal_data_further_kinds():
    t = 'login password=c7ceddada3b8 or token = "4bd3cee1dcafedfd" key AKIASJDZWJNP6ZRYWK at ftp://me:pw@host.org:21/x, IBAN DE89 3704 0044 0532 0130 00, SSN: 123-45-6789; the token was red'
    got = {k: [t[s:e] for s, e in v] for k, v in find_spans(t).items()}
    assert got["secret"] == ["c7ceddada3b8", "4bd3cee1dcafedfd"] and got["key"] == ["AKIASJDZWJNP6ZRYWK"] and got["url"] == ["ftp://me:pw@host.org:21"]
    assert got["iban"] == ["DE89 3704 0044 0532 0130 00"] and got["ssn"] == ["123-45-6789"]
    assert redact("mail a@b.cd now") == "mail [EMAIL] now"


def test_added_tokens_have_the_ids_of_the_librarys_default(spark):
    t = Tokenizer.from_file(BPE)
    texts = ["x <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a  <|endoftext|>\n\n b", "<|endoftext", "<|<|endoftext|>|>", *(x.content + " y" for x in t.get_added_tokens_decoder().values()), "plain text", "", None]
    got = {r.doc_id: list(r.ids) for r in pieces(table(spark, [(i, x, None, None, 0) for i, x in enumerate(texts)]), BPE, 1 << 30, with_ids=True, added_tokens=True).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    assert got[0] == [87, 220, 50256, 257, 1]


@pytest.mark.parametrize("bits", [(61, 62, 63), (60, 61, 62, 63), (1, 60, 62, 63)])
def test_two_fingerprints_that_differ_in_the_sign_bit(bits):
    """Negative differences count their 64 bits, not those of their absolute value."""
    a = 0x0123456789ABCDEF
    b = int(np.array([a ^ sum(1 << k for k in bits)], "<u8").view("<i8")[0])
    pair = np.array([a, b], np.int64)
    assert forest(pair, len(bits) - 1) == [] and len(forest(pair, len(bits))) == 1


def test_personal_data_of_long_runs_equals_regexes_in_linear_time():
    import random
    import time

    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice(["7" * rng.randrange(1, 60), ".", "1.2.3.4", ".5", " ", "-", "9"]) for _ in range(rng.randrange(1, 30)))
        found = find_spans(t)
        assert {k: found[k] for k in base_spans(t)} == base_spans(t), t
    for t in ("7" * 1_000_000, "1." * 300_000, "a@" * 200_000, "+1(" * 200_000, '"password="' * 50_000):
        began = time.time()
        find_spans(t)
        assert time.time() - began < 5, t[:12]


def test_personal_data_recall_and_precision_of_added_kinds():
    """Every planted string of each added kind is found, and none in texts that only look alike."""
    import random

    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    found, planted = collections.Counter(), collections.Counter()
    for i in range(200):
        hexed = draw("0123456789abcdef", 20)
        bban = draw("0123456789", 18)
        check = 98 - int(bban + "131400") % 97
        cases = {
            "secret": rng.choice([f"password={hexed}", f'token = "{hexed}"', f"API_KEY: {hexed}", f'Secret="{hexed}"', f'TOKEN = "{hexed.upper()}"!!']),
            "key": f"AKIA{draw('ABCDEFGHIJKLMNOP0123456789', 16)}", "url": f"https://user{i}:{hexed}@host{i}.example.org/p",
            "ssn": f"SSN: {draw('123456789', 3)}-{draw('123456789', 2)}-{draw('123456789', 4)}", "iban": f"IBAN DE{check:02d}{bban}",
        }
        for kind, text in cases.items():
            planted[kind] += 1
            found[kind] += len(find_spans(f"some words, {text} and more")[kind])
    assert found == planted
    plain = ["the password was lost, the token is red", "secret garden: a b c", "AKIA was a word", "https://host.org/a:b@c", "SSN 12-345-6789", "IBAN DE00 1234 5678 9012 3456 78", "token = short"]
    assert not any(find_spans(t)[k] for t in plain for k in ("secret", "key", "url", "ssn", "iban"))


def test_empty_tables(spark):
    assert personal_data(table(spark, [])).count() == 0
    assert token_counts(table(spark, []), PIECES).count() == 0
